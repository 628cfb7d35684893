"""Best-fit packing by non-negative least squares over length patterns.

Documents become token pieces of at most `capacity`. The histogram of their lengths (at most `capacity` bins) is
all that reaches the driver. Patterns of one, two or three lengths that fill a sequence are enumerated, and the
number of times that each repeats is fitted to the histogram by non-negative least squares. Repeats are rounded so
that their sum stays, by largest remainders, and held to the pieces there are. Only what is left then is packed best
fit first, bin by bin of the histogram. The outcome is a plan of bounded size: intervals of ranks within a length,
each with its pattern's sequences. Pieces are ranked within their length by gapless numbers and find their place by
search in the plan.

Defined results: a null or empty text is a document of the end token alone. Rows that repeat an id are packed each;
their pieces are told apart by place only, and pieces that tie in everything may stand in either one's place. An empty
table gives an empty result. Columns other than the id and the text are ignored. A very long text is encoded in one
task and held as 4 bytes a token.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.byte_bpe import pieces, special_pattern, special_tokens, token_bytes, vocabulary
from lodestone.llm.numbering import gapless
from lodestone.session import cut_lineage, spread, table

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 1024
END_ID = 2
#: Pieces of text that a worker keeps encoded.
CACHE_PIECES = 800_000
#: Steps of the least-squares fit, and the most patterns of three lengths it is given.
FIT_STEPS = 3000
TRIPLES = 60_000
#: Room that a sequence taken from the fit may waste, as a share of the capacity.
LOOSE = 64

_PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


class PieceIds(dict):
    """Ids of pieces of text as unsigned 32-bit numbers; a piece met again is not encoded again.

    The ids are those of the tokenizers library. As each merge of such a vocabulary makes the token whose id is
    next, the ids are ranks too, and tiktoken's faster merging of a piece gives the same ids.
    """

    def __init__(self, path: str):
        ranks = {b: i for i, b in token_bytes(path).items()}
        merges = vocabulary(path)["model"]["merges"]
        if sorted(ranks.values()) != list(range(len(ranks))) or len(merges) != len(ranks) - 256:
            raise ValueError(f"{path}: ids are not the ranks of merges")
        self.encode = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.specials, self.special_pattern = special_tokens(path), special_pattern(path)

    def __missing__(self, piece: str) -> bytes:
        special = self.specials.get(piece)
        out = self[piece] = array("I", self.encode(piece) if special is None else (special,)).tobytes()
        return out

    def cut(self, text: str) -> list[str]:
        if self.special_pattern is None or not any(s in text for s in self.specials):
            return pieces(text)
        return [p for part in self.special_pattern.split(text) for p in ([part] if part in self.specials else pieces(part))]

    def ids(self, text: str) -> bytes:
        if len(self) > CACHE_PIECES:
            self.clear()
        return b"".join(map(self.__getitem__, self.cut(text)))


@lru_cache(maxsize=2)
def piece_ids(path: str) -> PieceIds:
    return PieceIds(path)


def cut_lengths(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: only the first may be shorter than the capacity."""
    first = n % capacity or capacity if n > capacity else n
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def _token_pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = piece_ids(path), np.array([end_id], dtype="<u4").tobytes()

        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(own.ids(text.as_py() or "") + end)
                for k, (start, length) in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    out.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=_PIECES.names)

    return run


def enumerate_patterns(lengths: np.ndarray, capacity: int, triples: int = TRIPLES) -> np.ndarray:
    """Patterns of the given lengths (descending, 0 for none): rows of three indices into `lengths`, or -1.

    One length alone; each length with the longest that fits beside it; each pair of the shorter ones with the
    longest third that fits. The pairs are thinned evenly beyond `triples`; lengths are not.
    """
    n, asc = len(lengths), np.sort(lengths)
    index = {int(v): i for i, v in enumerate(lengths)}

    def longest(room: np.ndarray) -> np.ndarray:
        at = np.searchsorted(asc, room, side="right") - 1
        return np.where(at >= 0, asc[np.maximum(at, 0)], 0)

    singles = [(i, -1, -1) for i in range(n)]
    second = longest(capacity - lengths)
    pairs = [(i, index[int(b)], -1) for i, (a, b) in enumerate(zip(lengths, second, strict=True)) if b]
    a, b = np.triu_indices(n)
    room = capacity - lengths[a] - lengths[b]
    third = np.where(room > 0, longest(np.maximum(room, 0)), 0)
    keep = np.flatnonzero((third > 0) & (third <= np.minimum(lengths[a], lengths[b])))
    if len(keep) > triples:
        keep = keep[np.linspace(0, len(keep) - 1, triples).astype(np.int64)]
    deep = [(int(a[k]), int(b[k]), index[int(third[k])]) for k in keep]
    return np.array(singles + pairs + deep, dtype=np.int64).reshape(-1, 3)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, waste: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Non-negative repeat counts x that least-squares fit A x to the histogram, by accelerated projected gradient.

    A counts the lengths in each pattern; a small price on wasted room chooses among patterns that fit alike.
    """
    n, valid = len(counts), patterns >= 0
    flat, column = patterns[valid], np.nonzero(valid)[0]

    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, weights=x[column], minlength=n)

    def back(y: np.ndarray) -> np.ndarray:
        return np.bincount(column, weights=y[flat], minlength=len(patterns))

    probe = np.ones(len(patterns))
    for _ in range(30):
        probe = back(times(probe))
        size = np.linalg.norm(probe)
        probe /= size
    scale = counts.sum() / max(n, 1)
    x = ahead = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        slope = back(times(ahead) - counts) + 0.01 * scale * waste
        new = np.maximum(ahead - slope / size, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def fitted(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, repeats) by the least-squares fit, rounded; takes the pieces out of `left`.

    Whole repeats are taken first, then one more by largest remainders until the repeats add up to the fit's own sum.
    A sequence that isn't full leaves room that the residual can use, so only tight patterns are taken from the fit.
    """
    lengths = np.array(sorted((v for v, n in left.items() if n), reverse=True), dtype=np.int64)
    patterns = enumerate_patterns(lengths, capacity)
    used = np.where(patterns >= 0, lengths[np.maximum(patterns, 0)], 0)
    waste = 1 - used.sum(axis=1) / capacity
    x = fit_repeats(patterns, np.array([left[int(v)] for v in lengths], dtype=np.float64), waste)
    tight = np.flatnonzero((used.sum(axis=1) >= capacity - max(1, capacity // LOOSE)) & (x > 0))
    out: list[tuple[tuple[int, ...], int]] = []

    def take(k: int, repeats: int) -> int:
        shape = tuple(int(v) for v in used[k] if v)
        need = {v: shape.count(v) for v in shape}
        repeats = min(repeats, *(left[v] // m for v, m in need.items()))
        if repeats:
            out.append((shape, repeats))
            for v, m in need.items():
                left[v] -= m * repeats
        return repeats

    whole = np.floor(x[tight]).astype(np.int64)
    remainder = x[tight] - whole
    open_ = round(x[tight].sum()) - sum(take(k, n) for k, n in zip(tight.tolist(), whole.tolist(), strict=True) if n)
    for i in np.lexsort((waste[tight], -remainder)):
        if open_ <= 0 or not remainder[i]:
            break
        open_ -= take(int(tight[i]), 1)
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, repeats) that use up the histogram; of a size that only the capacity bounds."""
    left = {length: n for length, n in histogram.items() if n > 0}
    out: list[tuple[tuple[int, ...], int]] = []
    if n := left.pop(capacity, 0):
        out.append(((capacity,), n))
    if left:
        out += fitted(left, capacity)
    return out + best_fit(left, capacity)


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Pack a histogram bin by bin: open a sequence with the longest length left, add the longest that fits until
    none does, and repeat that while its lengths last. Each round uses up a length or halves one, so rounds are few."""
    out, left = [], {v: n for v, n in left.items() if n > 0}
    lengths = sorted(left)
    while lengths:
        room, shape, taken = capacity, [], {}
        at = len(lengths) - 1
        while at >= 0:
            v = lengths[at]
            can = min(room // v, left[v] - taken.get(v, 0))
            if can > 0:
                shape += [v] * can
                taken[v] = taken.get(v, 0) + can
                room -= v * can
            at = min(at, int(np.searchsorted(lengths, room, side="right"))) - 1
        repeats = min(left[v] // m for v, m in taken.items())
        out.append((tuple(shape), repeats))
        for v, m in taken.items():
            left[v] -= m * repeats
        lengths = [v for v in lengths if left[v]]
    return out


def intervals(planned: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan by length: ranks from `lo` on lie `times` to a sequence, at `at`, in sequences from `first` on."""
    rank: dict[int, int] = {}
    rows, first = [], 0
    for shape, repeats in planned:
        offset = 0
        for v in dict.fromkeys(shape):
            times = shape.count(v)
            rows.append((v, rank.get(v, 0), times, offset, first))
            rank[v] = rank.get(v, 0) + times * repeats
            offset += v * times
        first += repeats
    rows.sort()
    return {name: np.array(x, dtype=np.int64) for name, x in zip(("length", "lo", "times", "at", "first"), zip(*rows, strict=True), strict=True)} if rows else {}


def _placer(table_: dict[str, np.ndarray]):
    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        v, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        starts = np.searchsorted(table_["length"], v, side="left")
        ends = np.searchsorted(table_["length"], v, side="right")
        # the last interval of the length that begins at or before the rank, for all rows at once
        lo, hi = starts.copy(), ends.copy()
        while (open_ := hi - lo > 1).any():
            mid = (lo + hi) // 2
            below = table_["lo"][np.minimum(mid, len(table_["lo"]) - 1)] <= r
            lo, hi = np.where(open_ & below, mid, lo), np.where(open_ & ~below, mid, hi)
        k = r - table_["lo"][lo]
        return pd.DataFrame({"sequence_id": table_["first"][lo] + k // table_["times"][lo], "offset": table_["at"][lo] + k % table_["times"][lo] * v})

    return place


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Texts are not shuffled."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = cut_lineage(texts.mapInArrow(_token_pieces(path or public_tokenizers.path(TOKENIZER), capacity, end_id), _PIECES))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    found = intervals(plan(histogram, capacity))
    ranked = gapless(cut, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "rank", sum(histogram.values()))
    if not found:
        return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.withColumn("place", _placer(found)("length", "rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")


def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread(table(spark, sf_dir, "documents")))


QUERIES = {"op8_pattern_packing": op8_pattern_packing}
ORACLE: dict[str, str] = {}
