"""Search of files for a few hundred or thousand queries in one pass, without a shuffle of texts, lines or pairs.

A task knows all queries. Words are looked up once for the terms that they hold, as a set of bits; the bits of a line's
words, taken together, are its terms. What follows is arithmetic over lines, queries and places of tokens, in numpy, and
each task passes on the best files of each query alone.
"""

from __future__ import annotations

import re
from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of bits that a worker keeps of words that it met, and the longest word that it keeps.
KEPT_BYTES, KEPT_WORD = 96_000_000, 64
#: Lines, and queries, that are looked at together.
LINES, QUERIES = 128, 512


def _holder(terms: list[str]) -> Callable[[str], int]:
    """The terms that a word holds, as bits by their place in the list."""
    least = min(map(len, terms), default=1)
    steps: dict[str, int] = {}  # beginnings of terms, with the bit of the term that ends there
    for k, t in enumerate(terms):
        for n in range(least, len(t) + 1):
            steps[t[:n]] = steps.get(t[:n], 0) | (1 << k if n == len(t) else 0)
    step, most = steps.get, KEPT_BYTES // (len(terms) // 8 + 200) // 2
    kept: dict[str, int] = {}
    before: dict[str, int] = {}

    def of(word: str) -> int:
        out, size = 0, len(word)
        for i in range(size - least + 1):
            end = i + least
            while (bit := step(word[i:end])) is not None:
                out |= bit
                end += 1
                if end > size:
                    break
        return out

    def look(word: str) -> int:
        nonlocal kept, before
        found = kept.get(word)
        if found is None:
            found = before.get(word)
            if found is None:
                found = of(word)
            if len(word) <= KEPT_WORD:
                if len(kept) >= most:
                    kept, before = {}, kept
                kept[word] = found
        return found

    return look


class _Best:
    """The best entries of a query, by score and then path."""

    def __init__(self, limit: int):
        self.limit, self.rows = limit, []

    def add(self, total: float, path: str, rest: Callable[[], tuple]) -> float:
        """The least total that may still come in."""
        if len(self.rows) < self.limit or (-total, path) < self.rows[-1][:2]:
            insort(self.rows, (-total, path, rest()), key=lambda r: r[:2])
            del self.rows[self.limit :]
        return -self.rows[-1][0] if len(self.rows) == self.limit else -np.inf


class _Part:
    """Some of the queries with tokens, as arrays over queries and places of tokens."""

    def __init__(self, plans: list[dict], terms: dict[str, int], first: int):
        self.plans, self.first = plans, first
        width = max(len(p["tokens"]) for p in plans)
        self.at, self.weight = np.full((len(plans), width), len(terms)), np.zeros((len(plans), width), np.float32)
        for q, p in enumerate(plans):
            for k, t in enumerate(p["terms"]):
                self.at[q, k], self.weight[q, k] = terms[t["term"]], t["weight"]
        self.n = np.array([len(p["tokens"]) for p in plans])
        self.strict = [(q, re.compile("|".join(map(re.escape, p["written"])))) for q, p in enumerate(plans) if p["written"]]
        self.least = np.full(len(plans), -np.inf)

    def held(self, bits: np.ndarray) -> np.ndarray:
        return np.take(bits, self.at.ravel(), axis=1).reshape(len(bits), *self.at.shape)


def scanner(plans: list[dict], limit: int, lines_per_file: int, sought: int | None, relaxed: bool | None, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of Arrow batches (path, name: the folded path, lines, folded) to the best exact and relaxed files of
    each query.

    plans: query_id, query, tokens, terms (term, weight), folded, plain (whether an exact match is of folded text), written
    (tokens that relaxed lines must hold as they are written, or none). `sought`: the first tokens that others look for.
    """
    named = sorted((p for p in plans if p["tokens"]), key=lambda p: len(p["tokens"]))
    bare = [p for p in plans if not p["tokens"]]
    plans = named + bare
    names = sorted({t["term"] for p in named for t in p["terms"]})
    terms = {t: k for k, t in enumerate(names)}
    size = len(names) // 8 + 1  # one bit at least is never set, for places without a token

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _holder(names)
        parts = [_Part(named[a : a + QUERIES], terms, a) for a in range(0, len(named), QUERIES)]
        exact, loose = [_Best(limit) for _ in plans], [_Best(limit) for _ in plans]

        def bits_of(masks: list[int]) -> np.ndarray:
            raw = np.frombuffer(b"".join(m.to_bytes(size, "little") for m in masks), np.uint8).reshape(len(masks), size)
            return np.unpackbits(raw, axis=1, bitorder="little").view(bool)

        def mask(line: str) -> int:
            out = 0
            for w in set(line.split()):
                out |= look(w)
            return out

        def hits_of(p: dict, numbers, folded: list[str], line: Callable[[int], str]) -> list[int]:
            return [int(k) for k in numbers if (p["folded"] in folded[k] if p["plain"] else p["query"] in line(int(k)))]

        def file(path: str, name: str, folded: list[str], line: Callable[[int], str]) -> None:
            if relaxed is not True:
                for q, p in enumerate(bare, len(named)):
                    if hits := hits_of(p, range(len(folded)), folded, line)[:lines_per_file]:
                        joined = " ".join(folded[k].strip() for k in hits)
                        exact[q].add(100.0 if p["folded"] in joined else 0.0, path, lambda k=hits[0], n=len(hits): (k, line(k), 0.0, (), n))
            masks = list(map(mask, folded))
            at = np.array([k for k, m in enumerate(masks) if m], dtype=np.int64)
            if not len(at):
                return
            name_bits = bits_of([mask(name)])
            for part in parts:
                one_part(part, path, folded, line, masks, at, part.held(name_bits)[0].sum(1))

        def one_part(part: _Part, path, folded, line, masks, at, in_path) -> None:
            n_queries, width = part.at.shape
            count, best, best_line = np.zeros(n_queries, np.int64), np.full(n_queries, -1.0, np.float32), np.zeros(n_queries, np.int64)
            found, blocks, near = np.zeros((n_queries, width), bool), [], {}
            for a in range(0, len(at), LINES):
                numbers = at[a : a + LINES]
                held = part.held(bits_of([masks[k] for k in numbers]))
                if relaxed is not True:
                    for k, q in np.argwhere(held.sum(2) == part.n):  # a line that holds all tokens may hold the query
                        near.setdefault(int(q), []).append((int(numbers[k]), held[k, q]))
                if relaxed is False or (count >= lines_per_file).all():
                    continue
                have = held[:, :, :sought].any(2)
                for q, pattern in part.strict:
                    have[:, q] = [pattern.search(line(int(k))) is not None for k in numbers]
                keep = have & (have.cumsum(0) + count <= lines_per_file)
                weight = np.where(keep, (held * part.weight).sum(2), -1)
                at_most, top = weight.argmax(0), weight.max(0)
                better = top > best
                best_line[better], best[better] = numbers[at_most[better]], top[better]
                found |= (held & keep[:, :, None]).any(0)
                count += keep.sum(0)
                blocks.append((numbers, keep))
            for q, lines in near.items():
                p, rows = part.plans[q], dict(lines)
                if hits := hits_of(p, rows, folded, line)[:lines_per_file]:
                    of = np.array([rows[k] for k in hits])
                    weights, own = (of * part.weight[q]).sum(1), of.any(0)
                    k, phrase = int(weights.argmax()), p["folded"] in " ".join(folded[k].strip() for k in hits)
                    total = float((own * part.weight[q]).sum() * 10 + weights[k] * 2 + in_path[q] * 3 + 100 * phrase)
                    exact[part.first + q].add(total, path, lambda q=q, k=k, w=weights, own=own, hits=hits: (hits[k], line(hits[k]), float(w[k]), own[: part.n[q]].copy(), len(hits)))
            if relaxed is False:
                return
            total = (found * part.weight).sum(1) * 10 + best * 2 + in_path * 3
            matched = (count > 0) & (part.n >= 2)
            for q in np.flatnonzero(matched & (found.sum(1) == part.n)):  # a line break may part the words of a query
                kept = [k for numbers, keep in blocks for k in numbers[keep[:, q]]]
                if part.plans[q]["folded"] in " ".join(folded[k].strip() for k in kept):
                    total[q] += 100
            for q in np.flatnonzero(matched & (total >= part.least)):
                k = int(best_line[q])
                part.least[q] = loose[part.first + q].add(float(total[q]), path, lambda q=q, k=k: (k, line(k), float(best[q]), found[q, : part.n[q]].copy(), int(count[q])))

        for batch in batches:
            path, name, lines, folded = (batch.column(c) for c in ("path", "name", "lines", "folded"))
            for i in range(len(batch)):
                file(path[i].as_py(), name[i].as_py(), folded[i].as_py(), lambda k, i=i, lines=lines: lines[i][k].as_py())
        rows = []
        for q, p in enumerate(plans):
            for kind, best in ((False, exact[q]), (True, loose[q])):
                for total, path, (k, text, weight, found, count) in best.rows:
                    terms_found = [t for t, f in zip(p["tokens"], found, strict=True) if f] if len(found) else []
                    rows.append({"query_id": p["query_id"], "path": path, "relaxed": kind, "total": -total, "line_no": k + 1, "line": text, "weight": weight, "matched_terms": " ".join(terms_found), "n_found": len(terms_found), "matched_line_count": count})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run
