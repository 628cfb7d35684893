"""BPE encoding by traversal of a prefix-sharing trie, and decoding.

Every prefix of a word has one encoding, which ends in one token: its last-token state. The state of a longer
prefix follows from the states of shorter ones: it is the one token that ends there and may stand after the
state at its start. So distinct words are put into a trie, the trie is walked depth first, and the states of
a prefix are computed once for all the words that share it. The trie is held as the sorted list of its words;
their order is that of the depth-first walk, and the common prefix of two neighbours is the path they share.

Two tokens may stand side by side if merging their bytes would leave the border between them; this is found by
undoing their merges, latest first, and looking for a pair across the border that would have merged earlier.

Defined results: a null or empty text has no tokens, and digests of the empty string. Rows that repeat are each
returned. Very long texts are encoded whole, in one task. An empty table gives an empty result. Columns other than the
id and the text are ignored. Memory holds the words of a few megabytes of text and a bounded cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.byte_bpe import pieces, special_pattern, special_tokens, token_bytes, vocabulary
from lodestone.session import spread, table

TOKENIZER = "byte_bpe_50k.json"
#: Pieces that a worker keeps encoded; the cache begins anew beyond it.
CACHE_PIECES = 800_000
#: Characters of text whose new words are put into one trie.
TRIE_CHARS = 4_000_000

_DIGESTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


class TrieEncoder:
    """Encoder and decoder of one byte-level vocabulary."""

    def __init__(self, path: str):
        model = vocabulary(path)["model"]
        vocab, by_id = model["vocab"], token_bytes(path)
        to_bytes = {t: by_id[i] for t, i in vocab.items()}
        made = set()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # tokens in the order in which they come to be: single bytes, then merges; all work is on these numbers
        order = {to_bytes[t]: n for n, t in enumerate(sorted((t for t in vocab if len(to_bytes[t]) == 1), key=lambda t: to_bytes[t]))}
        self.parts: list[tuple[int, int]] = [(n, n) for n in range(len(order))]
        self.pair: dict[tuple[int, int], int] = {}
        for left, right in merges:
            a, b = order[to_bytes[left]], order[to_bytes[right]]
            if (whole := to_bytes[left] + to_bytes[right]) in made:
                raise ValueError(f"two merges make {whole!r}")
            made.add(whole)
            n = order[whole] = len(self.parts)
            self.parts.append((a, b))
            self.pair[a, b] = n
        self.ids = [vocab_id for _, vocab_id in sorted((order[b], i) for i, b in by_id.items() if b in order)]
        self.by_id = by_id | {i: s.encode() for s, i in special_tokens(path).items()}
        self.specials, self.special_pattern = special_tokens(path), special_pattern(path)
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.adjacent: dict[tuple[int, int], bool] = {}
        self.ends: dict = {}  # tokens by their bytes from the last to the first; under -1 the token
        for token, n in order.items():
            if self._reachable(n):
                at = self.ends
                for byte in reversed(token):
                    at = at.setdefault(byte, {})
                at[-1] = n
        self.lengths = [0] * len(self.parts)
        for token, n in order.items():
            self.lengths[n] = len(token)

    def _reachable(self, n: int) -> bool:
        """Whether merging the token's own bytes gives it: its two parts must stand side by side until it is made."""
        a, b = self.parts[n]
        return a == b == n or self._may_adjoin(a, b, n)

    def _may_adjoin(self, a: int, b: int, before: int | None = None) -> bool:
        """Whether no merge earlier than those already undone, or than `before`, joins a pair across the border."""
        limit = len(self.parts) if before is None else before
        while True:
            if self.pair.get((a, b), limit) < limit:
                return False
            whole_a, whole_b = self.parts[a] == (a, a), self.parts[b] == (b, b)
            if whole_a and whole_b:
                return True
            # undo the later merge; at equal numbers the right one, as the left one is made first
            if whole_b or (not whole_a and a > b):
                limit, a = a, self.parts[a][1]
            else:
                limit, b = b + 1, self.parts[b][0]

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct words."""
        ends, adjacent, lengths, ids = self.ends, self.adjacent, self.lengths, self.ids
        out, state, before = {}, [-1], b""
        if len(adjacent) > 2_000_000:
            adjacent.clear()
        for word in sorted(words):
            n, shared = len(word), 0
            for x, y in zip(word, before):
                if x != y:
                    break
                shared += 1
            del state[shared + 1 :]
            for end in range(shared + 1, n + 1):
                at, start = ends, end
                while True:
                    start -= 1
                    at = at.get(word[start])
                    if at is None:
                        raise AssertionError(f"no token ends at byte {end} of {word!r}")
                    if -1 in at:
                        token = at[-1]
                        if not start:
                            break
                        key = state[start], token
                        ok = adjacent.get(key)
                        if ok is None:
                            ok = adjacent[key] = self._may_adjoin(*key)
                        if ok:
                            break
                state.append(token)
            back, at = [], n
            while at:
                token = state[at]
                back.append(ids[token])
                at -= lengths[token]
            back.reverse()
            out[word], before = back, word
        return out

    def encode_pieces(self, distinct: Iterable[str]) -> dict[str, list[int]]:
        """Ids of pieces without special tokens."""
        single, cut = {}, {}
        for p in distinct:
            if p.isalpha() or (p[0] == " " and p[1:].isalpha()):  # the pre-tokenizer takes letters after a blank as one word
                single[p] = p.encode()
            else:
                cut[p] = [w.encode() for w in self.words.findall(p)]
        done = self.encode_words({*single.values(), *(w for words in cut.values() for w in words)})
        out = {p: done[w] for p, w in single.items()}
        for p, words in cut.items():
            out[p] = [i for w in words for i in done[w]]
        return out

    def cut(self, text: str) -> list[str]:
        """The text's pieces; a special token is a piece of its own."""
        if self.special_pattern is None or not any(s in text for s in self.specials):
            return pieces(text)
        return [p for part in self.special_pattern.split(text) for p in ([part] if part in self.specials else pieces(part))]

    def encode(self, text: str) -> list[int]:
        """Ids of one text, without added special tokens."""
        parts = self.cut(text)
        ids = self.encode_pieces({p for p in parts if p not in self.specials})
        return [i for p in parts for i in ([self.specials[p]] if p in self.specials else ids[p])]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids, special tokens included; bytes that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.by_id.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


class _Cache:
    """What the digests need of each piece: its ids as text, each after a comma, and its bytes decoded."""

    def __init__(self, own: TrieEncoder):
        self.own, self.id_text = own, {i: b",%d" % i for i in own.by_id}
        self.clear()

    def clear(self):
        self.texts = {s: self.id_text[i] for s, i in self.own.specials.items()}
        self.decoded = {s: self.own.by_id[i] for s, i in self.own.specials.items()}

    def add(self, distinct: set[str]):
        if len(self.texts) > CACHE_PIECES:
            self.clear()
        by_id, id_text = self.own.by_id.__getitem__, self.id_text.__getitem__
        for p, ids in self.own.encode_pieces(distinct - self.texts.keys()).items():
            self.texts[p] = b"".join(map(id_text, ids))
            self.decoded[p] = b"".join(map(by_id, ids))


_caches: dict[str, _Cache] = {}


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _caches:
            _caches[path] = _Cache(encoder(path))
        cache = _caches[path]

        def done(rows: list[tuple[int, list[str]]]) -> pa.RecordBatch:
            cache.add({p for _, parts in rows for p in parts})
            out = []
            for doc_id, parts in rows:
                ids = b"".join(map(cache.texts.__getitem__, parts))
                out.append((doc_id, ids.count(b","), hashlib.sha256(ids[1:]).hexdigest(), hashlib.sha256(b"".join(map(cache.decoded.__getitem__, parts))).hexdigest()))
            return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=_DIGESTS.names)

        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                rows.append((doc_id, cache.own.cut(text)))
                held += len(text)
                if held > TRIE_CHARS:
                    yield done(rows)
                    rows, held = [], 0
            if rows:
                yield done(rows)

    return run


def bpe_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256. `path`: a byte-level BPE tokenizer's file."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_digests(path or public_tokenizers.path(TOKENIZER)), _DIGESTS)


def op5_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(spread(table(spark, sf_dir, "documents")))


QUERIES = {"op5_trie_bpe": op5_trie_bpe}
ORACLE: dict[str, str] = {}
