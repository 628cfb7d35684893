"""LM scoring by deleted interpolation.

The probability of a token after its context is a mixture of maximum-likelihood estimates: the bigram's, the
unigram's and the uniform one. The weights depend on the bucket of the context's frequency (powers of two) and are
learned by expectation-maximisation: the training rows of one part are held out, estimates come from the counts of
the others, and the weights maximize the likelihood of the held-out bigrams. Scores use all training counts.

Counts are exact and cover every training row. Texts are worked on in chunks of bounded size. Each chunk asks for
the counts of its distinct words and bigrams, dealt by ranges of their hashes to partitions; a partition adds up what
all chunks counted, and answers each chunk in the order of the hashes. So a word of any frequency crosses the shuffle
once for each chunk, no row of a hot word meets another, and a text is scored where its chunk is. Words and bigrams are
known by 64-bit hashes; tokens of a chunk travel as numbers of its words. To learn the weights only the held-out texts
travel, with what the others counted of their words and bigrams; to score, all texts, with all counts.

Rows of a partition are put in order first, so that work done again after a lost executor cuts the same chunks,
whatever order its rows come in.

Defined results: a null text counts as empty and has the end token alone. Without training rows, counts are 0 and all
probabilities are uniform. Rows that repeat are each counted and returned; rows that tie in id and text have equal
scores. A very long text is a chunk of its own, worked on in one task with about 30 bytes a token. An empty table gives
an empty result. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import cut_lineage, spread, table

#: Characters of text in a chunk, about.
CHUNK_CHARS = 8_000_000
#: Partitions of the counts for each partition of the input.
PARTS = 2
#: Training rows whose remainder this is are held out to learn the weights; and rounds of expectation-maximisation.
DELETED, FOLDS = 0, 7
ROUNDS = 40
#: Buckets of context frequency: 2^0, 2^1 and so on; the last takes all above.
BUCKETS = 24
#: Steps in which a factor of ten of a probability is told when held-out bigrams are gathered for the weights.
GRAIN = 40

END, START = b"\x00end", b"\x00start"  # no word holds a byte 0 first
_MIX = np.uint64(0x9E3779B97F4A7C15)

_ASKED = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("chunk", T.StringType()), T.StructField("data", T.BinaryType())])
_ANSWERS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("chunk", T.StringType()), T.StructField("counts", T.BinaryType()), T.StructField("rest", T.BinaryType())])
_TEXTS = T.StructType([T.StructField("chunk", T.StringType()), T.StructField("data", T.BinaryType())])
_CELLS = T.StructType([T.StructField("cell", T.LongType()), T.StructField("n", T.LongType())])
_SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case; then the end token."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def key_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of bigrams from the keys of their words."""
    x = (context * _MIX) ^ (word + (context >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, byte plane by byte plane: of small numbers only the low bytes take room."""
    head = np.array([len(a) for a in arrays], dtype="<i8").tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"" for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpack(data: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = np.frombuffer(raw, dtype="<i8", count=len(types)), 8 * len(types), []
    for n, kind in zip(sizes.tolist(), types, strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=at).reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


class Chunk:
    """Some texts as numbers of the chunk's distinct words, with the keys of its words and bigrams."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, words: np.ndarray, word_keys: np.ndarray):
        """ids: of the texts (minimum of int64: null); sizes: tokens of each; words: places in word_keys, text after text."""
        self.ids, self.sizes, self.words, self.word_keys = ids, sizes, words, word_keys
        first = np.cumsum(sizes) - sizes
        before = np.empty(len(words), dtype=np.int64)
        before[1:] = words[:-1]
        before[first] = len(word_keys) - 1  # the start, which is the last word of every chunk
        self.before = before
        pair = before * len(word_keys) + words
        distinct, self.pair_of = np.unique(pair, return_inverse=True)
        self.pair_keys = pair_keys(word_keys[distinct // len(word_keys)], word_keys[distinct % len(word_keys)])

    def folds(self, folds: int) -> np.ndarray:
        """Remainder of each text's row."""
        return np.array([zlib.crc32(b"" if i == np.iinfo(np.int64).min else b"%d" % i) % folds for i in self.ids.tolist()], dtype=np.int64)

    def only(self, texts: np.ndarray) -> Chunk:
        """The marked texts alone, with the keys of their own words and bigrams."""
        mine = np.repeat(texts, self.sizes)
        held, words = np.unique(self.words[mine], return_inverse=True)
        return Chunk(self.ids[texts], self.sizes[texts], words, np.append(self.word_keys[held], self.word_keys[-1]))

    def counts(self, fold: int | None, folds: int) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of words then bigrams, and those of them in the deleted part; the start counts the texts."""
        remainder = self.folds(folds)
        out = []
        for texts in (remainder != fold if fold is not None else np.ones(len(remainder), dtype=bool), remainder == deleted_part(fold)):
            mine = np.repeat(texts, self.sizes)
            words = np.bincount(self.words[mine], minlength=len(self.word_keys))
            words[-1] = texts.sum()
            out.append(np.concatenate((words, np.bincount(self.pair_of[mine], minlength=len(self.pair_keys)))).astype("<u4"))
        return out[0], out[1]

    @property
    def keys(self) -> np.ndarray:
        return np.concatenate((self.word_keys, self.pair_keys))

    def data(self) -> bytes:
        return pack(self.ids.astype("<i8"), self.sizes.astype("<i4"), self.words.astype("<i4"), self.word_keys.astype("<u8"))

    @classmethod
    def of(cls, data: bytes) -> Chunk:
        ids, sizes, words, keys = unpack(data, "<i8", "<i4", "<i4", "<u8")
        return cls(ids, sizes.astype(np.int64), words.astype(np.int64), keys)


def deleted_part(fold: int | None) -> int:
    """The remainder of the training rows that are held out to learn the weights."""
    return DELETED if fold != DELETED else DELETED + 1


def ranges(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and where in it each partition's range begins and the last one ends."""
    order = np.argsort(keys)
    first = np.array([(p << 64) // parts for p in range(parts)], dtype=np.uint64)
    return order, np.append(np.searchsorted(keys[order], first), len(keys))


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def chunks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[str, Chunk]]:
    """Texts of a partition in chunks of about so many characters. A chunk is named by what it holds, so that work that
    is done again finds its own answers."""
    ids, sizes, words, numbers, held, name = [], [], [], _Numbers(), 0, xxhash.xxh3_128()

    def done() -> tuple[str, Chunk]:
        keys = np.array([key_of(w) for w in numbers] + [key_of(START)], dtype=np.uint64)
        name.update(np.array(ids, dtype="<i8").tobytes() + keys.tobytes())
        return name.hexdigest(), Chunk(np.array(ids, dtype=np.int64), np.array(sizes, dtype=np.int64), np.concatenate(words).astype(np.int64), keys)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            own = tokens(text)
            ids.append(np.iinfo(np.int64).min if doc_id is None else doc_id)
            sizes.append(len(own))
            words.append(np.fromiter(map(numbers.__getitem__, own), dtype=np.int32, count=len(own)))
            name.update(b"%d " % len(own))
            name.update(words[-1].tobytes())
            held += len(text or "")
            if held >= chars:
                yield done()
                ids, sizes, words, numbers, held, name = [], [], [], _Numbers(), 0, xxhash.xxh3_128()
    if ids:
        yield done()


def _asker(chars: int, parts: int, fold: int | None, folds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, chunk in chunks(batches, chars):
            keys, (counts, deleted) = chunk.keys, chunk.counts(fold, folds)
            order, ends = ranges(keys, parts)
            rows = []
            for p in range(parts):
                at = order[ends[p] : ends[p + 1]]
                if len(at):
                    words = (at < len(chunk.word_keys) - 1).astype("<u1")  # neither bigrams nor the start count as tokens
                    rows.append((p, name, pack(keys[at].astype("<u8"), counts[at], deleted[at], words)))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.binary()), strict=True)], names=_ASKED.names)

    return run


def _teller(chars: int, part: int | None, folds: int):
    """The chunks with all their texts, or with those of one part alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, chunk in chunks(batches, chars):
            if part is not None:
                mine = chunk.folds(folds) == part
                if not mine.any():
                    continue
                chunk = chunk.only(mine)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([chunk.data()], type=pa.binary())], names=_TEXTS.names)

    return run


def _answer(asked: pd.DataFrame) -> pd.DataFrame:
    """Add up the counts of one partition of keys: for each chunk all counts of its keys, and, of the keys that its
    deleted part holds, the counts without the deleted part. The row of chunk '' tells tokens and distinct tokens."""
    asked = asked.sort_values("chunk")
    found = [unpack(d, "<u8", "<u4", "<u4", "<u1") for d in asked["data"]]
    keys = np.concatenate([f[0] for f in found])
    distinct, place = np.unique(keys, return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate([f[1] for f in found]), minlength=len(distinct)).astype("<u8")
    deleted = np.bincount(place, weights=np.concatenate([f[2] for f in found]), minlength=len(distinct)).astype("<u8")
    words = np.zeros(len(distinct), dtype=bool)
    words[place[np.concatenate([f[3] for f in found]) == 1]] = True
    out, at = [], 0
    for name, f in zip(asked["chunk"], found, strict=True):
        mine = place[at : at + len(f[0])]
        at += len(f[0])
        held = mine[f[2] > 0]
        out.append((name, pack(counts[mine]), pack(counts[held] - deleted[held]) if len(held) else None))
    total = (counts[words].sum(), (counts[words] > 0).sum(), deleted[words].sum(), (counts[words] > deleted[words]).sum())
    out.append(("", pack(np.array(total, dtype="<u8")), None))
    part = int(asked["part"].iloc[0])
    return pd.DataFrame({"part": [part] * len(out), "chunk": [o[0] for o in out], "counts": [o[1] for o in out], "rest": [o[2] for o in out]})


def _joined(texts: pd.DataFrame, answers: pd.DataFrame, parts: int) -> list[tuple[Chunk, np.ndarray]]:
    """The chunk with the counts of its words and bigrams in its own order; equal chunks may be there several times."""
    if not len(texts):
        return []
    chunk = Chunk.of(texts["data"].iloc[0])
    keys = chunk.keys
    order, ends = ranges(keys, parts)
    got = dict(zip(answers["part"].tolist(), answers["data"], strict=True))
    counts = np.empty(len(keys), dtype=np.int64)
    for p in range(parts):
        at = order[ends[p] : ends[p + 1]]
        if len(at):
            counts[at] = unpack(got[p], "<u8")[0]
    return [(chunk, counts)] * len(texts)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency; 0 for a context never seen."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def _gather(parts: int, n: int):
    """Held-out bigrams by bucket and by the logarithms of their two estimates: at most BUCKETS cells times a grid."""

    def run(_key: tuple, texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        cells, sizes = [], []
        for chunk, left in _joined(texts, answers, parts):
            words, pairs = left[: len(chunk.word_keys)], left[len(chunk.word_keys) :]
            bigram, context, word = pairs[chunk.pair_of], words[chunk.before], words[chunk.words]
            cell = (bucket_of(context) << 40) | (grain(bigram, context) << 20) | grain(word, np.full(len(word), n))
            c, k = np.unique(cell, return_counts=True)
            cells.append(c)
            sizes.append(k)
        return pd.DataFrame({"cell": np.concatenate(cells) if cells else np.empty(0, dtype=np.int64), "n": np.concatenate(sizes) if sizes else np.empty(0, dtype=np.int64)})

    return run


def grain(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """0 for an estimate of zero, else its logarithm in steps, below 2^20."""
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where((part > 0) & (whole > 0), -np.log10(part / np.maximum(whole, 1)), -1.0)
    return np.where(x < 0, 0, np.minimum(np.rint(np.maximum(x, 0) * GRAIN).astype(np.int64), (1 << 20) - 2) + 1)


def learn_weights(cells: np.ndarray, n: np.ndarray, distinct: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of bigram, unigram and uniform estimates for each bucket, by expectation-maximisation."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    bucket, second, first = cells >> 40, cells >> 20 & 0xFFFFF, cells & 0xFFFFF
    estimate = np.stack([np.where(second > 0, 10 ** (-(second - 1) / GRAIN), 0), np.where(first > 0, 10 ** (-(first - 1) / GRAIN), 0), np.full(len(cells), 1 / (distinct + 1))], axis=1)
    for _ in range(rounds):
        share = weights[bucket] * estimate
        whole = share.sum(axis=1, keepdims=True)
        share = share / np.maximum(whole, 1e-300) * n[:, None]
        new = np.stack([np.bincount(bucket, weights=share[:, k], minlength=BUCKETS) for k in range(3)], axis=1).astype(np.float64)
        new += np.array([1e-3, 1e-3, 1e-2])  # no estimate is ever ruled out
        new[0, 0] = 0
        weights = new / new.sum(axis=1, keepdims=True)
    return weights


def _scorer(parts: int, total: tuple[int, int], weights: np.ndarray, fold: int | None, folds: int):
    n, distinct = total

    def run(_key: tuple, texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for chunk, counts in _joined(texts, answers, parts):
            words, pairs = counts[: len(chunk.word_keys)], counts[len(chunk.word_keys) :]
            bigram, context, word = pairs[chunk.pair_of], words[chunk.before], words[chunk.words]
            w = weights[bucket_of(context)]
            p = w[:, 0] * (bigram / np.maximum(context, 1)) + w[:, 1] * (word / max(n, 1)) + w[:, 2] / (distinct + 1)
            first = np.cumsum(chunk.sizes) - chunk.sizes
            base = np.add.reduceat(np.log10((word + 1) / (n + distinct + 1)), first)
            out.append(pd.DataFrame({
                "doc_id": pd.array([None if i == np.iinfo(np.int64).min else i for i in chunk.ids.tolist()], dtype="Int64"),
                "held_out": chunk.folds(folds) == fold if fold is not None else np.zeros(len(chunk.ids), dtype=bool),
                "n_tokens": chunk.sizes,
                "n_known": np.add.reduceat((word > 0).astype(np.int64), first),
                "base_score": base,
                "score": np.add.reduceat(np.log10(p), first),
            }))
        return pd.concat(out) if out else pd.DataFrame({f.name: [] for f in _SCORES})

    return run


def ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids and texts, each partition's rows in an order that follows from the rows alone."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).sortWithinPartitions("doc_id", "text")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, fold: int | None = 2, folds: int = FOLDS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows outside the held-out fold (all rows if `fold` is None).
    """
    texts = ordered(docs, id_col, text_col)
    parts = max(1, PARTS * texts.rdd.getNumPartitions())
    asked = texts.mapInArrow(_asker(chunk_chars, parts, fold, folds), _ASKED)
    answers = cut_lineage(asked.repartition(parts, "part").groupBy("part").applyInPandas(_answer, _ANSWERS))
    sums = np.zeros(4, dtype=np.int64)
    for r in answers.filter("chunk = ''").select("counts").toLocalIterator():  # a few numbers from each partition
        sums += unpack(bytes(r["counts"]), "<u8")[0].astype(np.int64)
    total = int(sums[0]), int(sums[1])

    def at_chunks(work, schema: T.StructType, told: int | None, answer: str) -> DataFrame:
        asking = texts.mapInArrow(_teller(chunk_chars, told, folds), _TEXTS)
        mine = answers.filter((F.col("chunk") != "") & F.col(answer).isNotNull()).select("part", "chunk", F.col(answer).alias("data"))
        return asking.groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInPandas(work, schema)

    gathered = at_chunks(_gather(parts, int(sums[0] - sums[2])), _CELLS, deleted_part(fold), "rest")
    cells = gathered.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float64), total[1])
    scored = at_chunks(_scorer(parts, total, weights, fold, folds), _SCORES, None, "counts")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total[0]).cast("long").alias("train_tokens"), "base_score", "score")


def op3_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spread(table(spark, sf_dir, "documents")))


QUERIES = {"op3_deleted_interpolation": op3_deleted_interpolation}
ORACLE: dict[str, str] = {}
