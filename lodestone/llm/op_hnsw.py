"""Approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards by the hash of their row; a shard holds a bounded number of vectors on average. Each shard,
of whatever size, builds a graph of its distinct vectors, stored as flat arrays of neighbours, one for each level.
Nearness is the inner product: vectors get one more component that makes all lengths equal, so that the largest inner
product is the nearest in angle. Points are inserted in batches that grow with the graph: a batch searches the graph
built so far, all its points at once, and its points are neighbours of each other too. A search goes down the levels
with all that it found on the one above, so that clusters apart from each other are reached.

Queries are searched in every shard in blocks of bounded size, and the shards' results are merged by exact inner
product in double precision. Work and shuffled queries are therefore queries times shards, that is, with a twentieth of
the rows as queries, the square of the table: the price of an index whose every shard is searched.

Copies of a vector are one point of the graph, with the ids that a result can need.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components, and rows with a null id,
take no part. Only vectors of equal dimension meet; very long ones are rows like any other. Rows that repeat an id and a
vector count once. Rows of one id with different vectors are rows of their own: each is a candidate for the other, and
as queries each has its own list of ranks under their id. A query never returns its own row; ties go to the smaller id.
With fewer candidates than wanted, all are returned. An empty table gives an empty result. Columns other than the id
and the vector are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import cut_lineage, table

#: Vectors in a shard, on average, and shards at least; neighbours of a point on the lowest level (half on others);
#: breadth of searches, on the lowest level and above.
SHARD_VECTORS = 13_000
LEAST_SHARDS = 2
NEIGHBOURS = 24
BUILD_BREADTH = 64
SEARCH_BREADTH = 128
UPPER_BREADTH = 32
#: Points inserted at once: as many as the graph holds, between these.
FIRST_BATCH, BATCH = 32, 512
#: Queries that meet a shard in one task, and of these the ones searched at once.
TASK_QUERIES = 16_384
BLOCK = 512

_INDEX = T.StructType([T.StructField("shard", T.LongType()), T.StructField("dimension", T.IntegerType()), T.StructField("graph", T.BinaryType())])
_FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("query", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


class Graph:
    """Distinct vectors, and for each level a flat array of neighbours (-1: none) of the points on it."""

    def __init__(self, vectors: np.ndarray, neighbours: int = NEIGHBOURS, breadth: int = BUILD_BREADTH, seed: int = 11):
        self.vectors = vectors
        longest = np.einsum("ij,ij->i", vectors, vectors).max(initial=0.0)
        rest = np.sqrt(np.maximum(longest - np.einsum("ij,ij->i", vectors, vectors), 0))
        self.points = np.column_stack((vectors, rest)).astype(np.float32)
        n = len(vectors)
        random = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - random.random(n)) / np.log(neighbours / 2)).astype(np.int64), 8)
        self.links = []
        self.entry = -1
        self.level[0] = self.level.max()  # the first point is on all levels
        self.entry = 0
        width = [neighbours * 2 if k == 0 else neighbours for k in range(int(self.level[0]) + 1)]
        self.links = [np.full((n if k == 0 else int((self.level >= k).sum()), w), -1, dtype=np.int32) for k, w in enumerate(width)]
        self.place = [np.arange(n)] + [np.where(self.level >= k, np.cumsum(self.level >= k) - 1, -1) for k in range(1, len(width))]
        at = 0
        while at < n:
            end = min(n, at + min(BATCH, max(FIRST_BATCH, at)))
            self._insert(np.arange(at, end), neighbours, breadth)
            at = end

    def _insert(self, batch: np.ndarray, neighbours: int, breadth: int) -> None:
        """Link a batch of points; those with smaller numbers are in the graph."""
        old = batch[0]
        starts = np.full((len(batch), 1), self.entry)
        for k in range(len(self.links) - 1, -1, -1):
            mine = self.level[batch] >= k
            if old:
                found, near = self._search(self.points[batch], starts, k, breadth if mine.any() else UPPER_BREADTH)
                starts = found[:, :UPPER_BREADTH]
            else:
                found, near = np.zeros((len(batch), 0), dtype=np.int64), np.zeros((len(batch), 0), dtype=np.float32)
            own = batch[mine]
            if not len(own):
                continue
            each = self.points[own] @ self.points[own].T
            np.fill_diagonal(each, -np.inf)
            top = min(2 * neighbours, len(own) - 1)
            beside = np.argpartition(-each, top - 1, axis=1)[:, :top] if top > 0 else np.zeros((len(own), 0), dtype=np.int64)
            ids = np.concatenate((found[mine], own[beside]), axis=1)
            scores = np.concatenate((near[mine], np.take_along_axis(each, beside, axis=1)), axis=1)
            scores[ids < 0] = -np.inf
            chosen = self._diverse(own, ids, scores, neighbours)
            self.links[k][self.place[k][own], :neighbours] = chosen
            self._link_back(own, chosen, k)

    def _diverse(self, own: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
        """Neighbours, nearest first, that are nearer to the point than to a neighbour already taken; the rest fill up."""
        order = np.argsort(-scores, axis=1, kind="stable")[:, : 3 * most]
        ids, scores = np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)
        valid = np.isfinite(scores)
        at = self.points[np.maximum(ids, 0)]
        between = np.einsum("bid,bjd->bij", at, at)
        taken = np.zeros(ids.shape, dtype=bool)
        for j in range(ids.shape[1]):
            blocked = (taken & (between[:, j, :] > scores[:, j, None])).any(axis=1)
            taken[:, j] = valid[:, j] & ~blocked & (taken.sum(axis=1) < most)
        rank = np.argsort(np.where(taken, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(valid, rank, axis=1), np.take_along_axis(ids, rank, axis=1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _link_back(self, own: np.ndarray, chosen: np.ndarray, k: int) -> None:
        """Link the chosen neighbours back; a full list keeps its nearest and most diverse."""
        links, width = self.links[k], self.links[k].shape[1]
        source, target = np.repeat(own, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        for at in range(0, len(nodes), 2048):
            part, n = nodes[at : at + 2048], count[at : at + 2048]
            most = int(n.max())
            new = np.full((len(part), most), -1, dtype=np.int64)
            row = np.repeat(np.arange(len(part)), n)
            column = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            new[row, column] = source[first[at] : first[at] + len(row)]
            ids = np.concatenate((links[self.place[k][part]].astype(np.int64), new), axis=1)
            again = np.sort(ids, axis=1)
            ids = np.where(np.concatenate((np.zeros((len(part), 1), dtype=bool), again[:, 1:] == again[:, :-1]), axis=1), -1, again)
            short = (ids >= 0).sum(axis=1) <= width
            kept = np.full((len(part), width), -1, dtype=np.int64)
            packed = -np.sort(-ids, axis=1)[:, :width]
            kept[short, : packed.shape[1]] = packed[short]
            if (~short).any():
                full = ids[~short]
                scores = np.einsum("bd,bjd->bj", self.points[part[~short]], self.points[np.maximum(full, 0)])
                scores[full < 0] = -np.inf
                kept[~short] = self._diverse(part[~short], full, scores, width)
            links[self.place[k][part]] = kept

    def _search(self, queries: np.ndarray, starts: np.ndarray, k: int, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """Best `breadth` points of level k for each query, nearest first (-1: none), and their products; all queries
        at once, each from its own starts (-1: none), at most `breadth` of them."""
        n, rows = len(queries), np.arange(len(queries))
        given = starts >= 0
        row, column = np.nonzero(given)
        ids = np.full((n, breadth), -1, dtype=np.int64)
        scores = np.full((n, breadth), -np.inf, dtype=np.float32)
        open_ = np.zeros((n, breadth), dtype=bool)
        seen = np.zeros((n, len(self.points)), dtype=bool)
        ids[:, : starts.shape[1]], open_[:, : starts.shape[1]] = starts, given
        scores[row, column] = np.einsum("ij,ij->i", queries[row], self.points[starts[row, column]])
        seen[row, starts[row, column]] = True
        active = rows
        while len(active):
            best = np.where(open_[active], scores[active], -np.inf).argmax(axis=1)
            more = open_[active, best]
            active, best = active[more], best[more]
            if not len(active):
                break
            open_[active, best] = False
            near = self.links[k][self.place[k][ids[active, best]]].astype(np.int64)
            fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
            near = np.where(fresh, near, -1)
            row, column = np.nonzero(fresh)
            seen[active[row], near[row, column]] = True
            value = np.full(near.shape, -np.inf, dtype=np.float32)
            value[row, column] = np.einsum("ij,ij->i", queries[active[row]], self.points[near[row, column]])
            both = np.concatenate((scores[active], value), axis=1)
            order = np.argpartition(-both, breadth - 1, axis=1)[:, :breadth]
            ids[active] = np.take_along_axis(np.concatenate((ids[active], near), axis=1), order, axis=1)
            open_[active] = np.take_along_axis(np.concatenate((open_[active], fresh), axis=1), order, axis=1)
            scores[active] = np.take_along_axis(both, order, axis=1)
            open_[active] &= np.isfinite(scores[active])
        order = np.argsort(-scores, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)

    def search(self, queries: np.ndarray, breadth: int = SEARCH_BREADTH) -> np.ndarray:
        """Points near each query, at most `breadth`; -1: none."""
        own = np.column_stack((queries, np.zeros(len(queries)))).astype(np.float32)
        starts = np.full((len(queries), 1), self.entry)
        for k in range(len(self.links) - 1, 0, -1):
            starts = self._search(own, starts, k, min(UPPER_BREADTH, breadth))[0]
        return self._search(own, starts, 0, breadth)[0]


def _flat(graph: Graph, ids: np.ndarray, first: np.ndarray) -> bytes:
    """The graph's flat arrays, and the ids of each distinct vector, as one binary value."""
    out = io.BytesIO()
    np.savez(out, vectors=graph.vectors, points=graph.points, level=graph.level, entry=graph.entry, ids=ids, first=first, **{f"links{k}": x for k, x in enumerate(graph.links)})
    return out.getvalue()


def _opened(data: bytes) -> tuple[Graph, np.ndarray, np.ndarray]:
    x = np.load(io.BytesIO(data))
    g = Graph.__new__(Graph)
    g.vectors, g.points, g.level, g.entry = x["vectors"], x["points"], x["level"], int(x["entry"])
    g.links = [x[f"links{k}"] for k in range(sum(name.startswith("links") for name in x.files))]
    g.place = [np.arange(len(g.level))] + [np.where(g.level >= k, np.cumsum(g.level >= k) - 1, -1) for k in range(1, len(g.links))]
    return g, x["ids"], x["first"]


def _indexer(copies: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        vectors = np.array(rows["vector"].tolist(), dtype=np.float64).reshape(len(rows), -1)
        _, first, copy_of = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        copy_of = copy_of.ravel()
        shuffled = np.random.default_rng(5).permutation(len(first))  # np.unique sorts; a graph wants any order
        place = np.empty(len(first), dtype=np.int64)
        place[shuffled] = np.arange(len(first))
        copy_of, first = place[copy_of], first[shuffled]
        order = np.argsort(copy_of, kind="stable")
        starts = np.searchsorted(copy_of[order], np.arange(len(first)))
        rank = np.arange(len(order)) - starts[copy_of[order]]
        order = order[rank < copies]  # larger ids of copies can be in no result
        starts = np.searchsorted(copy_of[order], np.arange(len(first) + 1))
        return pd.DataFrame({"shard": [key[0]], "dimension": [key[1]], "graph": [_flat(Graph(vectors[first]), rows["vec_id"].to_numpy()[order], starts)]})

    return run


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, results: int = 20, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """One row per shard and dimension: its graph. Every vector is indexed; the number of shards follows the rows."""
    rows = usable(vectors, id_col, vector_col)
    shards = max(LEAST_SHARDS, -(-rows.count() // shard_vectors))
    return rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards))).groupBy("shard", F.size("vector").alias("dimension")).applyInPandas(_indexer(results + 1), _INDEX)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part; rows that repeat both count once."""
    vector = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return rows.filter(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()).dropDuplicates(["vec_id", "vector"])


def _searcher(results: int, breadth: int):
    def run(_key: tuple, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(queries):
            graph, ids, first = _opened(index["graph"].iloc[0])
            for at in range(0, len(queries), BLOCK):
                part = queries.iloc[at : at + BLOCK]
                own = np.array(part["vector"].tolist(), dtype=np.float64).reshape(len(part), -1)
                for query_id, query, q, found in zip(part["vec_id"], part["query"], own, graph.search(own, breadth), strict=True):
                    found = found[found >= 0]
                    score = graph.vectors[found] @ q
                    n = first[found + 1] - first[found]
                    at_ids = np.repeat(first[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    vec_id, same = ids[at_ids], np.repeat((graph.vectors[found] == q).all(axis=1), n)
                    score = np.repeat(score, n)
                    other = (vec_id != query_id) | ~same
                    vec_id, score = vec_id[other], score[other]
                    best = np.lexsort((vec_id, -score))[:results]
                    out.append(pd.DataFrame({"query_id": query_id, "query": query, "vec_id": vec_id[best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({f.name: pd.Series(dtype="int64" if f.name != "score" else "float64") for f in _FOUND})

    return run


def search_index(index: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, results: int = 20, breadth: int = SEARCH_BREADTH) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest found to each query, its own row left out.

    Each query goes to every shard of its dimension, in blocks of bounded size that meet the shard in tasks of their
    own; a query gets at most `results` rows from each.
    """
    own = usable(queries, id_col, vector_col)
    blocks = max(1, -(-own.count() // TASK_QUERIES))
    own = own.withColumn("query", F.xxhash64("vec_id", "vector")).withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    shards = index.select(F.col("shard").alias("to_shard"), F.col("dimension").alias("in_dimension")).distinct()
    asked = own.join(shards, F.size("vector") == F.col("in_dimension"))
    dealt = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = dealt.groupBy("shard", "dimension", "block").cogroup(asked.groupBy("to_shard", "in_dimension", "block")).applyInPandas(_searcher(results, breadth), _FOUND)
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= results).select("query_id", "rank", "vec_id", "score")


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search_index(cut_lineage(build_index(vectors)), vectors.filter("vec_id % 20 = 0"))


QUERIES = {"op1_hnsw": op1_hnsw}
ORACLE: dict[str, str] = {}
