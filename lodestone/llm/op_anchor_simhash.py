"""SimHash near-dedup by anchor-point covering.

Anchors are the words of a covering code: two blocks of 23 bits of the fingerprint, each covered by the perfect
binary Golay code, whose words lie within 3 bits of any 23 bits. Every fingerprint has one home anchor, with at
most 3 differing bits in each block. A fingerprint that differs from it in at most t bits lies within 3 bits plus
its share of those t of the home anchor in each block; so fingerprints are replicated to every anchor within the
covering radius plus threshold, and fingerprints are compared at each anchor that is home to one of them. No link
is missed. There are 2^24 anchors; a fingerprint goes to about 61 of them at a threshold of 2.

Equal fingerprints are one node from the start. An anchor that is home to very many is split: each part has some of
the home fingerprints and meets all of the anchor's, block by block. At an anchor only a forest of its links is kept,
never all pairs. Components come from alternating stars over the links; only counts, and one row for each PART_HOMES
fingerprints at most that share a home, reach the driver.

Defined results: a null text counts as empty; a text without words has fingerprint zero, linked like any other; one
with fewer words than a shingle has a single shingle. A bit that is set in just half of the hashes is 0. A null id
never names a component unless all its ids are null. Rows that repeat are each returned. Very long texts are hashed
whole, in one task, and counted in blocks of shingles. An empty table gives an empty result. Columns other than the id,
the text and, where named, the row's are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.components import components
from lodestone.session import cut_lineage, spread, table

SHINGLE_WORDS = 3
MOST_BITS = 2
SEED = 42

#: The Golay code of length 23: its generator polynomial, length and covering radius.
GENERATOR, LENGTH, RADIUS = 0b110001110101, 23, 3
#: Rows gathered before anchors are compared, and pairs compared at once.
ROWS_AT_ONCE = 400_000
PAIRS_AT_ONCE = 2_000_000
#: Home fingerprints of an anchor, or of a part of one, about.
PART_HOMES = 20_000

_ROWS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("fp", T.LongType())])
_PLACED = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("away", T.BooleanType()), T.StructField("fp", T.LongType())])
_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def simhash(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint: each bit is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z, and the white space of ASCII
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    whole, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, [whole[a:b] for a, b in zip(starts, ends, strict=True)], repeat(SEED)), dtype="<u8", count=n)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_py(), shingle_words) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=_ROWS.names)

    return run


class Cosets:
    """For each syndrome of the code, the error patterns of weight up to RADIUS + most, by weight beyond RADIUS."""

    def __init__(self, most: int):
        bit = []
        for i in range(LENGTH):
            x = 1 << i
            for k in range(LENGTH - 1, 10, -1):
                if x >> k & 1:
                    x ^= GENERATOR << (k - 11)
            bit.append(x)
        low, high = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 11, dtype=np.int64)
        for i in range(LENGTH):
            half, at = (low, i) if i < 12 else (high, i - 12)
            half[np.arange(len(half)) >> at & 1 == 1] ^= bit[i]
        self.low, self.high = low, high
        self.lists = []  # by excess: first places, counts, patterns
        for excess in range(most + 1):
            weights = range(RADIUS + 1) if not excess else (RADIUS + excess,)
            patterns = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(LENGTH), w)], dtype=np.int64)
            s = self.syndrome(patterns)
            patterns = patterns[np.argsort(s, kind="stable")]
            counts = np.bincount(s, minlength=1 << 11)
            self.lists.append((np.concatenate(([0], np.cumsum(counts)[:-1])), counts, patterns))

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 0xFFF] ^ self.high[words >> 12]


@lru_cache(maxsize=4)
def cosets(most: int) -> Cosets:
    return Cosets(most)


def anchors(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, whether it isn't the home, and fingerprint, for all anchors within the covering radius plus `most`."""
    code, mask = cosets(most), (1 << LENGTH) - 1
    first, second = fps & mask, fps >> LENGTH & mask
    s, t = code.syndrome(first), code.syndrome(second)
    out = []
    for i in range(most + 1):
        for j in range(most + 1 - i):
            (at_a, n_a, pat_a), (at_b, n_b, pat_b) = code.lists[i], code.lists[j]
            each = n_a[s] * n_b[t]
            row = np.repeat(np.arange(len(fps)), each)
            k = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            wide = n_b[t[row]]
            a = first[row] ^ pat_a[at_a[s[row]] + k // np.maximum(wide, 1)]
            b = second[row] ^ pat_b[at_b[t[row]] + k % np.maximum(wide, 1)]
            out.append((b << LENGTH | a, np.full(len(row), i + j > 0), fps[row]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def homes_of(fps: np.ndarray) -> np.ndarray:
    """The home anchor of each fingerprint."""
    anchor, away, fp = anchors(fps, 0)
    order = np.argsort(fp, kind="stable")
    return anchor[order][np.searchsorted(fp[order], fps)]


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(homes_of(batch.column(0).to_numpy(zero_copy_only=False)))], names=["anchor"])


def split(anchor: np.ndarray, away: np.ndarray, fp: np.ndarray, parts: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows at anchors with parts go to each of them; a home row is at home in one. A part's number stands above the anchor's bits."""
    if not parts:
        return anchor, away, fp
    hot, n = np.array(sorted(parts), dtype=np.int64), np.array([parts[k] for k in sorted(parts)], dtype=np.int64)
    at = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
    each = np.where(hot[at] == anchor, n[at], 1)
    row = np.repeat(np.arange(len(anchor)), each)
    part = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    mixed = fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    own = ((mixed ^ (mixed >> np.uint64(32))) % each.astype(np.uint64)).astype(np.int64)
    return anchor[row] | part << 2 * LENGTH, away[row] | (part != own[row]), fp[row]


def _placed(most: int, parts: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in split(*anchors(fps[at : at + 2000], most), parts)], names=_PLACED.names)

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one link for each node: (node, smallest node that it reaches)."""
    nodes, places = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _near(home: np.ndarray, rest: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one anchor with very many rows: home x with x < y, in blocks, or by looking up every y where that is less work."""
    found_a, found_b = [], []
    if most <= 2 and len(rest) > 20_000:
        rest = np.sort(rest)
        masks = np.array([sum(1 << i for i in c) for w in range(1, most + 1) for c in combinations(range(64), w)], dtype=np.uint64).view(np.int64)
        for x in home:
            y = x ^ masks
            y = y[rest[np.minimum(np.searchsorted(rest, y), len(rest) - 1)] == y]
            y = y[y > x]
            found_a.append(np.full(len(y), x))
            found_b.append(y)
    else:
        rows = max(1, PAIRS_AT_ONCE // max(1, len(rest)))
        for at in range(0, len(home), rows):
            part = home[at : at + rows]
            i, j = np.nonzero((np.bitwise_count((part[:, None] ^ rest[None, :]).view(np.uint64)) <= most) & (part[:, None] < rest[None, :]))
            found_a.append(part[i])
            found_b.append(rest[j])
    return np.concatenate(found_a), np.concatenate(found_b)


def compare(anchor: np.ndarray, away: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links found at whole anchors; rows are sorted by anchor, those at home first. A pair is found at the home of its smaller member."""
    start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    size = np.diff(np.append(start, len(anchor)))
    homes = np.add.reduceat((~away).astype(np.int64), start)
    pairs = homes * size
    a, b = [], []
    for g in np.flatnonzero(pairs > PAIRS_AT_ONCE):
        x, y = _near(fp[start[g] : start[g] + homes[g]], fp[start[g] : start[g] + size[g]], most)
        a.append(x)
        b.append(y)
    todo = np.flatnonzero((pairs > 0) & (pairs <= PAIRS_AT_ONCE) & (size > 1))
    ends = np.cumsum(pairs[todo])
    while len(todo):
        n = max(1, int(np.searchsorted(ends, PAIRS_AT_ONCE, side="right")))
        part, todo = todo[:n], todo[n:]
        ends = ends[n:] - ends[n - 1]
        group = np.repeat(part, pairs[part])
        k = np.arange(len(group)) - np.repeat(np.cumsum(pairs[part]) - pairs[part], pairs[part])
        x, y = fp[start[group] + k // size[group]], fp[start[group] + k % size[group]]
        ok = (np.bitwise_count((x ^ y).view(np.uint64)) <= most) & (x < y)
        a.append(x[ok])
        b.append(y[ok])
    if not sum(map(len, a)):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return forest(np.concatenate(a), np.concatenate(b))


def _compared(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def links(parts) -> pa.RecordBatch:
            a, b = compare(*parts, most)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=_LINKS.names)

        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
            rows += batch.num_rows
            if rows >= ROWS_AT_ONCE:
                parts = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(parts[0], parts[0][-1]))  # the last anchor may go on
                if cut:
                    yield links([x[:cut] for x in parts])
                elif parts[1][-1]:  # all of one anchor, and all its homes are here: they are kept to meet the rest
                    yield links(parts)
                    parts = [x[~parts[1]] for x in parts]
                held, rows = [tuple(x[cut:] for x in parts)], len(parts[0]) - cut
        if rows:
            yield links([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, row_col: str | None = None, shingle_words: int = SHINGLE_WORDS, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per input row: doc_id, row (a number that tells rows apart, if `row_col` names one), fp (signed 64 bits),
    root (the fingerprint that names the component), component_id. Texts are not shuffled."""
    row = F.col(row_col).cast("long") if row_col else F.lit(None).cast("long")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), F.col(text_col).alias("text"))
    rows = cut_lineage(texts.mapInArrow(_fingerprints(shingle_words), _ROWS))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    crowded = nodes.select("fp").mapInArrow(_homes, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > PART_HOMES)
    parts = {r["anchor"]: -(-r["n"] // PART_HOMES) for r in crowded.toLocalIterator()}
    placed = nodes.select("fp").mapInArrow(_placed(most_bits, parts), _PLACED)
    links = placed.repartition("anchor").sortWithinPartitions("anchor", "away").mapInArrow(_compared(most_bits), _LINKS)
    roots = cut_lineage(components(links))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = cut_lineage(named.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("least").alias("component_id")))
    labels = cut_lineage(named.join(least, "root", "left").select("fp", "root", F.coalesce("component_id", "least").alias("component_id")))
    return rows.join(labels, "fp").select("doc_id", "row", "fp", "root", "component_id")


def op10_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(spread(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_anchor_simhash": op10_anchor_simhash}
ORACLE: dict[str, str] = {}
