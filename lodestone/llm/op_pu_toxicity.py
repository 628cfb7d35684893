"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words and of word beginnings is trained in numpy from confirmed toxic rows
and unlabelled text. The risk is corrected by the class prior p: p E+[loss(+)] + max(0, Eu[loss(-)] - p E+[loss(-)]);
where the second part falls below zero, the step climbs out of it, so that unlabelled toxic rows aren't learned as clean.

The toxic rows are a bounded sample of the labelled ones, by hash of their ids; copies in it count once. The unlabelled
side covers every document that may be learned from: how many hold each word or beginning that enough toxic rows of
the sample hold, which picks the features; then every document's set of picked features, counted where equal, whose
risk and slope the executors add up for each step. Only the first steps, which bring the weights near, run on a
bounded sample of those sets. One toxic row in CALIBRATION and labelled clean rows, both kept from training, then set
the scale of the scores: 0.5 where what a text holds speaks for neither label.

Scoring covers every whole text: a text's score is the logistic of the weights of the features it holds.

Defined results: null and empty texts have the score of no features. Without toxic rows to learn from, every score
is 0. Rows that repeat are each returned; ties in the sample's hash go to the smaller id, ties among features to the
first in the alphabet. Very long texts are rows like any other, as their set of features is bounded. An empty table
gives an empty result. Labels, and columns other than those named, are never inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import cut_lineage, spread, table

#: Bounds of the sample of labelled rows, of each label, and the share of them (one in so many) that is kept to calibrate.
LABELLED_ROWS = 3000
CALIBRATION = 6
#: The most features, which bounds the model; the most likely toxic ones are taken.
MOST_FEATURES = 4096
#: Different sets of features that a task gathers before it passes their counts on, and those that the first steps use.
TASK_SETS = 50_000
FIRST_SETS = 5000
#: Characters of a word's beginnings that are features beside the whole word.
BEGINNINGS = (4, 5)
#: Share of the toxic rows that hold a feature, at least; never under LEAST_ROWS rows.
LEAST_SHARE = 0.01
LEAST_ROWS = 3
#: Chance of being toxic that a feature alone must give, with so many square roots of its toxic rows left out.
LEAST_LIKELY, CHANCE = 0.4, 1.5
STEPS = 400
RATE = 0.1
#: Steps over all documents, from where the first ones got.
WHOLE_STEPS = 20
WHOLE_RATE = 0.05
DECAY = 1e-4
THRESHOLD = 0.7
#: Words whose features a worker keeps.
CACHE_WORDS = 400_000

WORDS = re.compile(r"\w+")

_SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def features(word: str) -> tuple[str, ...]:
    """A word in lower case, and its beginnings marked by a hyphen."""
    return (word, *(word[:n] + "-" for n in BEGINNINGS if len(word) >= n))


class PuModel:
    """Weights of features, and a bias."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float):
        self.index, self.weights, self.bias = {f: i for i, f in enumerate(names)}, weights, bias
        self.at: dict[str, tuple[int, ...]] = {}

    def held(self, text: str | None) -> set[int]:
        """Places of the features that the text holds."""
        words = set(WORDS.findall((text or "").lower()))
        if len(self.at) > CACHE_WORDS:
            self.at.clear()
        out: set[int] = set()
        for w in words:
            at = self.at.get(w)
            if at is None:
                at = self.at[w] = tuple(self.index[f] for f in features(w) if f in self.index)
            if at:
                out.update(at)
        return out

    def score(self, text: str | None) -> float:
        x = self.bias + sum(self.weights[i] for i in self.held(text))
        return float(1 / (1 + np.exp(-min(max(x, -40), 40))))

    def __getstate__(self):
        return self.index, self.weights, self.bias

    def __setstate__(self, state):
        (self.index, self.weights, self.bias), self.at = state, {}


#: The mean loss of calling rows clean at given weights and bias, and its slopes: those of the weights, then the bias's.
Clean = Callable[[np.ndarray, float], tuple[float, np.ndarray]]


class Rows:
    """Rows as the places of their features; each row counts n times."""

    def __init__(self, held, n=None):
        part = [np.asarray(x, dtype=np.int64) for x in held]
        self.flat = np.concatenate(part) if part else np.empty(0, dtype=np.int64)
        self.row = np.repeat(np.arange(len(part)), [len(x) for x in part]).astype(np.int64)
        self.n = np.ones(len(part)) if n is None else np.asarray(n, dtype=np.float64)

    def margins(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.flat], minlength=len(self.n)) + b

    def slopes(self, each: np.ndarray, n_features: int) -> np.ndarray:
        """Of the weights, then the bias: sums of each row's own slope."""
        return np.append(np.bincount(self.flat, weights=(each * self.n)[self.row], minlength=n_features), each @ self.n)

    def as_clean(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        """The sum of the losses of calling the rows clean, and its slopes."""
        margin = self.margins(w, b)
        return float(np.logaddexp(0, margin) @ self.n), self.slopes(sigmoid(margin), len(w))

    def as_toxic(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        margin = self.margins(w, b)
        return float(np.logaddexp(0, -margin) @ self.n), self.slopes(-sigmoid(-margin), len(w))

    def mean_clean(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        loss, slope = self.as_clean(w, b)
        return loss / self.n.sum(), slope / self.n.sum()


def nonnegative_risk(positive: Rows, clean: Clean, prior: float, w: np.ndarray, b: float) -> tuple[float, float, np.ndarray]:
    """The risk of calling toxic rows clean, the corrected risk of calling clean rows toxic before it is held at zero,
    and the slopes of the step: of both where the second isn't negative, else out of the negative one."""
    n = positive.n.sum()
    (missed, toxic), (loss_p, clean_p), (loss_u, clean_u) = positive.as_toxic(w, b), positive.as_clean(w, b), clean(w, b)
    missed, negative = prior * missed / n, loss_u - prior * loss_p / n
    rest = clean_u - prior * clean_p / n
    return missed, negative, prior * toxic / n + rest if negative >= 0 else -rest


def train(positive: Rows, clean: Clean, n_features: int, prior: float, start: tuple[np.ndarray, float] | None = None, *, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weights (not below 0: a feature was picked because it speaks for toxicity) and bias that minimize the
    non-negative risk."""
    w, b = start or (np.zeros(n_features), float(np.log(prior / (1 - prior))))
    first, second = [np.zeros(n_features + 1) for _ in range(2)]
    for step in range(1, steps + 1):
        slope = nonnegative_risk(positive, clean, prior, w, b)[2] + decay * np.append(w, 0)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        move = rate * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]
    return w, float(b)


def calibrate(margin: np.ndarray, toxic: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Factor and shift of the margins, by regularized logistic regression (Newton's method) on labelled rows, both
    labels weighing the same; 1 and 0 where one of them is missing."""
    if not toxic.any() or toxic.all():
        return 1.0, 0.0
    x, t = np.column_stack((margin, np.ones(len(margin)))), np.array([1.0, 0.0])
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum()) * len(toxic)
    for _ in range(rounds):
        p = sigmoid(x @ t)
        slope = x.T @ (weight * (p - toxic)) + np.array([1.0, 0.0]) * (t[0] - 1)
        curve = x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag([1.0, 1e-6])
        move = np.linalg.solve(curve, slope)
        t = t - move * min(1.0, 2.0 / max(1e-12, float(np.abs(move).max())))
    return (float(t[0]), float(t[1])) if t[0] > 0 else (1.0, 0.0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _held_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic, names = [], []
        for flag, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held = {f for w in set(WORDS.findall((text.as_py() or "").lower())) for f in features(w)}
            toxic += [flag] * len(held)
            names += held
        for at in range(0, len(names), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(toxic[at : at + 100_000], type=pa.bool_()), pa.array(names[at : at + 100_000], type=pa.string())], names=["toxic", "feature"])


def _counted(names: list[str]):
    """How many of a task's rows hold each of the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, found, rows = PuModel(names, np.zeros(len(names)), 0.0), Counter(), 0
        for batch in batches:
            for text in batch.column(0):
                found.update(model.held(text.as_py()))
            rows += batch.num_rows
        found[-1] = rows
        yield pa.RecordBatch.from_arrays([pa.array(list(found), type=pa.int32()), pa.array(list(found.values()), type=pa.int64())], names=["feature", "n"])

    return run


def _sets(names: list[str]):
    """The different sets of features that rows hold, with how many rows do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, found = PuModel(names, np.zeros(len(names)), 0.0), Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([list(x) for x in found], type=pa.list_(pa.int32())), pa.array(list(found.values()), type=pa.int64())], names=["held", "n"])

        for batch in batches:
            found.update(tuple(sorted(model.held(text.as_py()))) for text in batch.column(0))
            if len(found) > TASK_SETS:
                yield told()
                found.clear()
        yield told()

    return run


def _marked(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PuModel(names, np.zeros(len(names)), 0.0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sorted(model.held(t.as_py())) for t in batch.column(2)], type=pa.list_(pa.int32()))], names=["toxic", "kept", "held"])

    return run


def over_all(sets: DataFrame, n_features: int) -> Clean:
    """The loss of calling all documents clean, added up by the executors: n_features + 3 numbers reach the driver."""

    def clean(w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n_features + 3)
            for batch in batches:
                rows = Rows(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False))
                loss, slope = rows.as_clean(w, b)
                total += np.append(slope, (loss, rows.n.sum()))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, type=pa.int64()), pa.array(total[at])], names=["at", "value"])

        total = np.zeros(n_features + 3)
        for r in sets.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
            total[r["at"]] = r["value"]
        return total[-2] / max(total[-1], 1), total[:-2] / max(total[-1], 1)

    return clean


def first_sets(sets: DataFrame, most: int = FIRST_SETS) -> Rows:
    """A sample of the sets that stands for all: by priority, their count over a hash of theirs between 0 and 1. Those
    that many rows hold are in it for sure, and each of the others counts for as many rows as its kind has on average."""
    part = (F.pmod(F.xxhash64("held"), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))
    near = sets.withColumn("priority", F.col("n") / part).orderBy(F.desc("priority"), "held").limit(most + 1).toPandas()
    least = near.priority.iloc[most] if len(near) > most else 0.0
    return Rows(near.held[:most], np.maximum(near.n[:most].to_numpy(np.float64), least))


def fold_of(doc_id, folds: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, fold: int | None = 1, folds: int = 3) -> PuModel | None:
    """Learn from rows outside the held-out fold (all if `fold` is None); None without a toxic row.

    Only ids, features and counts are shuffled or collected, but for the texts of the labelled sample.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if fold is not None:
        docs = docs.filter(fold_of(F.col("doc_id"), folds) != fold)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).alias("toxic")).filter("doc_id is not null and toxic is not null")
    marks = docs.select("doc_id").join(marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")  # each document counts
    marks = cut_lineage(marks.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.count("*").alias("n")))
    shares = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    if not shares.get(True):
        return None
    prior = min(0.9, max(0.001, shares[True] / sum(shares.values())))
    draw = F.xxhash64("doc_id", F.lit("sample"))
    sides = [marks.filter(F.col("toxic") == flag).select("doc_id", "toxic").orderBy(draw, "doc_id").limit(LABELLED_ROWS) for flag in (True, False)]
    chosen = F.broadcast(sides[0].union(sides[1]))
    kept = F.pmod(F.xxhash64("doc_id", F.lit("kept")), F.lit(CALIBRATION)) == 0
    rows = cut_lineage(docs.join(chosen, "doc_id").groupBy("toxic", F.coalesce("text", F.lit("")).alias("text")).agg(F.min(kept).alias("kept")).select("toxic", "kept", "text"))
    n_toxic = rows.filter("toxic and not kept").count()
    if n_toxic < LEAST_ROWS:
        rows, n_toxic = rows.withColumn("kept", F.lit(False)), rows.filter("toxic").count()
    least = min(n_toxic, max(LEAST_ROWS, int(LEAST_SHARE * n_toxic)))
    held = rows.filter("toxic and not kept").select("toxic", "text").mapInArrow(_held_features, "toxic boolean, feature string").groupBy("feature").agg(F.count("*").alias("p"))
    # at most n_toxic / least times the features of a text; those that some toxic rows share
    shared = {r["feature"]: r["p"] for r in held.filter(F.col("p") >= least).collect()}
    names = sorted(shared)
    seen = {r["feature"]: r["n"] for r in docs.select("text").mapInArrow(_counted(names), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    n_all = seen.get(-1, 0)
    # of the toxic rows that hold a feature, so many are left out as chance could bring
    likely = {f: prior * (shared[f] - CHANCE * shared[f] ** 0.5) / n_toxic / ((seen.get(k, 0) + 1) / n_all) for k, f in enumerate(names)}
    names = sorted((f for f in names if likely[f] >= LEAST_LIKELY), key=lambda f: (-shared[f], f))[:MOST_FEATURES]

    sets = cut_lineage(docs.select("text").mapInArrow(_sets(names), "held array<int>, n long").groupBy("held").agg(F.sum("n").alias("n")))
    sample = rows.mapInArrow(_marked(names), "toxic boolean, kept boolean, held array<int>").toPandas()
    positive = Rows(sorted(map(list, sample.held[sample.toxic & ~sample.kept])))  # the order of rows must not matter
    weights, bias = train(positive, first_sets(sets).mean_clean, len(names), prior)
    weights, bias = train(positive, over_all(sets, len(names)), len(names), prior, (weights, bias), steps=WHOLE_STEPS, rate=WHOLE_RATE)
    known = sample[~sample.toxic | (sample.kept if (sample.kept & sample.toxic).any() else True)]
    factor, shift = calibrate(Rows(known.held).margins(weights, bias), known.toxic.to_numpy(bool))
    return PuModel(names, weights * factor, bias * factor + shift)


def _scorer(shared, fold: int | None, folds: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            scores = [model.score(t.as_py()) if model else 0.0 for t in batch.column(1)]
            held_out = [fold is not None and zlib.crc32(("" if i is None else str(i)).encode()) % folds == fold for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held_out, type=pa.bool_()), pa.array(scores, type=pa.float64()), pa.array([int(s >= threshold) for s in scores], type=pa.int32())], names=_SCORED.names)

    return run


def score_toxicity(docs: DataFrame, model: PuModel | None, id_col: str = "doc_id", text_col: str = "text", *, fold: int | None = 1, folds: int = 3, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. The model holds at most MOST_FEATURES features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scorer(shared, fold, folds, threshold), _SCORED)


def keep_clean(docs: DataFrame, model: PuModel | None, text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, whole, that are not predicted toxic; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value is None or shared.value.score(t.as_py()) < threshold for t in batch.column(place)], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op4_pu_toxicity": op4_pu_toxicity}
ORACLE: dict[str, str] = {}
