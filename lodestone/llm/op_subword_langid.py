"""Language ID by averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its subwords: the 2-, 3- and 4-grams of each word between borders, hashed
into a fixed number of buckets. Embeddings and softmax are trained by stochastic gradient descent in numpy on a
bounded sample of labelled rows, of every language; of each row the whole text is taken, as counts of buckets. As mean and softmax layer are linear, their product is one row of scores for
each bucket, and a whole text is scored by the mean of its subwords' rows.

A temperature and a threshold of rejection are fitted on labelled rows kept from training: the threshold is the
least at which accepted rows reach the wanted accuracy.

Defined results: `und` with score 0, rejected, if a text is null or has no letter (Unicode category L). If no row has
a label, every language is `und`. Rows that repeat are each returned; rows that repeat an id count once in the sample.
Languages that tie in a score go to the first in the alphabet. Very long texts are scored whole, in blocks of words. An
empty table gives an empty result. Columns other than those named are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import spread, table

#: Bounds of the training sample: rows for each language, and of all languages, which share them where they are many.
ROWS_PER_LANGUAGE = 600
TRAINING_ROWS = 6_000
BUCKETS = 1 << 14
DIMENSIONS = 16
EPOCHS = 5
BATCH = 32
RATE = 0.5
#: Share of the sample kept for calibration, and the accuracy that accepted rows must reach.
CALIBRATION = 5
ACCURACY = 0.98

#: Runs of letters, and of the numerals that aren't decimal digits, which are cut out later.
LETTERS = re.compile(r"[^\W\d_]+")
#: Words hashed at once.
BLOCK_WORDS = 100_000

_PREDICTED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def subwords(words: list[str], buckets: int) -> np.ndarray:
    """Hash buckets of the 2-, 3- and 4-grams of each word between borders, for all words at once."""
    points = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le"), dtype="<u4")
    border = points == ord(">")
    out, h, inside = [], points, ~border
    for n in (2, 3, 4):
        h = h[: len(points) - n + 1] * np.uint32(0x9E3779B1) + points[n - 1 :]
        inside = inside[: len(h)]
        out.append(h[inside])
        inside = inside & ~border[n - 1 :]  # the next character would lie in another word
    h = np.concatenate(out)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return ((h ^ (h >> np.uint32(13))) % np.uint32(buckets)).astype(np.int64)


def letters(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    words = LETTERS.findall((text or "").lower())
    if "".join(words).isalpha():
        return words
    return "".join(c if c.isalpha() else " " for c in " ".join(words)).split()


def bucket_counts(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """How many subwords of the whole text fall in each bucket."""
    words, out = letters(text), np.zeros(buckets, dtype=np.int64)
    for at in range(0, len(words), BLOCK_WORDS):
        out += np.bincount(subwords(words[at : at + BLOCK_WORDS], buckets), minlength=buckets)
    return out


class SubwordModel:
    """Bucket scores: the embeddings times the softmax layer, which is all that predictions need."""

    def __init__(self, languages: list[str], scores: np.ndarray, bias: np.ndarray, buckets: int, temperature: float = 1.0, threshold: float = 0.0):
        self.languages, self.scores, self.bias, self.buckets, self.temperature, self.threshold = languages, scores, bias, buckets, temperature, threshold

    def logits(self, words: list[str]) -> np.ndarray:
        total, n = np.zeros(len(self.bias)), 0
        for at in range(0, len(words), BLOCK_WORDS):
            ids = subwords(words[at : at + BLOCK_WORDS], self.buckets)
            total += np.ones(len(ids)) @ self.scores[ids]
            n += len(ids)
        return total / n + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, its probability, and whether it is rejected."""
        words = letters(text)
        if not words or not self.languages:
            return "und", 0.0, True
        p = softmax(self.logits(words) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)

    @classmethod
    def train(cls, rows: list[tuple[str, np.ndarray, np.ndarray]], *, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, seed: int = 7) -> SubwordModel:
        """rows: (language, buckets, shares of the text's subwords in them); every CALIBRATION-th is kept for calibration."""
        rows = [r for r in rows if len(r[1])]
        languages = sorted({lang for lang, _, _ in rows})
        if not languages:
            return cls([], np.zeros((buckets, 0)), np.zeros(0), buckets)
        random = np.random.default_rng(seed)
        place = {lang: k for k, lang in enumerate(languages)}
        label = np.array([place[lang] for lang, _, _ in rows])
        kept = np.arange(len(rows)) % CALIBRATION == CALIBRATION - 1
        fit = np.flatnonzero(~kept) if (~kept).any() else np.arange(len(rows))
        embed, layer, bias = random.normal(0, 0.1, (buckets, dimensions)), np.zeros((dimensions, len(languages))), np.zeros(len(languages))
        weight = len(fit) / (len(languages) * np.maximum(np.bincount(label[fit], minlength=len(languages)), 1))
        steps, step = max(1, epochs * -(-len(fit) // BATCH)), 0
        for _ in range(epochs):
            order = random.permutation(fit)
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                rate = RATE * (1 - step / steps)
                step += 1
                share = np.zeros((len(part), buckets))
                for k, i in enumerate(part):
                    share[k, rows[i][1]] = rows[i][2]
                layer_slope, bias_slope, mean_slope = slopes(share @ embed, layer, bias, label[part], weight[label[part]] / len(part))
                layer -= 8 * rate * layer_slope
                bias -= rate * bias_slope
                embed -= 100 * rate * share.T @ mean_slope
        out = cls(languages, embed @ layer, bias, buckets)
        mine = np.flatnonzero(kept)
        out.calibrate(np.array([rows[i][2] @ out.scores[rows[i][1]] + bias for i in mine]), label[mine])
        return out

    def calibrate(self, logits: np.ndarray, label: np.ndarray, accuracy: float = ACCURACY) -> None:
        """Fit the temperature by likelihood, then the least threshold at which accepted rows reach the accuracy."""
        if not len(label):
            return
        grid = np.exp(np.linspace(np.log(0.3), np.log(20), 60))
        self.temperature = float(grid[np.argmin([-np.log(softmax(logits / t)[np.arange(len(label)), label] + 1e-12).mean() for t in grid])])
        p = softmax(logits / self.temperature)
        best, right = p.max(axis=1), p.argmax(axis=1) == label
        order = np.argsort(-best, kind="stable")
        good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= accuracy)
        # half way to the random guess below the least certain row that may be accepted, so that rows like it are kept
        self.threshold = float((best[order][good[-1]] + 1 / len(self.languages)) / 2) if len(good) else 1.0


def slopes(mean: np.ndarray, layer: np.ndarray, bias: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of the weighted log loss of the softmax layer: of the layer, the bias and the mean embeddings."""
    slope = softmax(mean @ layer + bias)
    slope[np.arange(len(label)), label] -= 1
    slope *= weight[:, None]
    return mean.T @ slope, slope.sum(axis=0), slope @ layer.T


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _predictor(shared, fold: int | None, folds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held_out = doc_id is not None and fold is not None and zlib.crc32(str(doc_id).encode()) % folds == fold
                out.append((doc_id, held_out, *model.predict(text.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True) if out else ((),) * 5, (pa.int64(), pa.bool_(), pa.string(), pa.float64(), pa.bool_()), strict=True)], names=_PREDICTED.names)

    return run


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [bucket_counts(t.as_py(), buckets) for t in batch.column(1)]
            at = [np.flatnonzero(c) for c in counts]
            share = [(c[i] / max(1, c.sum())).astype("<f4").tobytes() for c, i in zip(counts, at, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.astype("<u4").tobytes() for i in at], type=pa.binary()), pa.array(share, type=pa.binary())], names=["lang", "at", "share"])

    return run


def training_rows(rows: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, most: int = TRAINING_ROWS, buckets: int = BUCKETS) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, buckets, shares) of a bounded sample, by the hash of the id: of each language as many rows, at least one.

    Beside them, one count for each language reaches the driver. Texts of rows that aren't sampled stay where they are.
    """
    rows = rows.filter("lang is not null")
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return []
    each = max(1, min(rows_per_language, most // len(counts)))
    draw = F.xxhash64("doc_id", F.lit("sample"))
    # the ids that may be among the first of their language by hash, then those that are
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, (2 * each + 50) / r["count"]))])
    ids = rows.select("lang", "doc_id").filter(F.pmod(draw, F.lit(1 << 30)) / F.lit(1 << 30) < share[F.col("lang")]).distinct()
    first = Window.partitionBy("lang").orderBy(F.pmod(draw, F.lit(1 << 30)), "doc_id")
    ids = ids.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= each).select("lang", F.col("doc_id").alias("chosen"))
    mine = rows.join(F.broadcast(ids.withColumnRenamed("lang", "of")), (F.col("lang") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("chosen")))
    mine = mine.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")
    out = [(r["lang"], bytes(r["at"]), bytes(r["share"])) for r in mine.mapInArrow(_counted(buckets), "lang string, at binary, share binary").collect()]
    out.sort(key=lambda r: (zlib.crc32(r[1]), r))  # the order of rows must not matter
    return [(lang, np.frombuffer(at, dtype="<u4").astype(np.int64), np.frombuffer(part, dtype="<f4").astype(np.float64)) for lang, at, part in out]


def train_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, fold: int | None = 2, folds: int = 4) -> SubwordModel:
    """Learn from the labelled rows outside the held-out fold (all rows if `fold` is None)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    if fold is not None:
        rows = rows.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds != fold)
    return SubwordModel.train(training_rows(rows))


def predict_language(docs: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text", *, fold: int | None = 2, folds: int = 4) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, rejected. The model's size is fixed by its parameters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_predictor(shared, fold, folds), _PREDICTED)


def keep_accepted(docs: DataFrame, model: SubwordModel, text_col: str = "text") -> DataFrame:
    """The rows, whole, whose language is not rejected; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not shared.value.predict(t.as_py())[2] for t in batch.column(place)], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_subword_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return predict_language(docs, train_language_model(docs))


QUERIES = {"op6_subword_langid": op6_subword_langid}
ORACLE: dict[str, str] = {}
