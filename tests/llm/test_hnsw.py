import numpy as np
from pyspark.sql import types as T

from lodestone.llm.op_hnsw import Graph, build_index, search_index


def frame(spark, rows):
    return spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType())]))


def brute(vectors, query, k=20):
    s = {i: float(np.dot(np.float64(v), np.float64(vectors[query]))) for i, v in vectors.items() if i != query and len(v) == len(vectors[query])}
    return sorted(s.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_graph_recall_on_vectors_of_unequal_length():
    r = np.random.default_rng(0)
    v = r.normal(size=(4000, 24)) * r.uniform(0.5, 2, (4000, 1))
    g, q = Graph(v), r.normal(size=(100, 24))
    assert g.links[0].shape[0] == 4000 and g.links[0].dtype == np.int32
    found = g.search(q)
    hits = [len(set(np.argsort(-(v @ x))[:20]) & set(sorted(f, key=lambda k: -(v[k] @ x) if k >= 0 else 1e9)[:20])) for x, f in zip(q, found, strict=True)]
    assert np.mean(hits) / 20 >= 0.9


def test_shards_are_merged_exactly_with_ties_copies_and_odd_rows(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(60)]  # copies
    odd = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] * 8), (904, [float("inf")] + [1.0] * 7), (905, []), (940, [1.0, 2.0]), (941, [2.0, 1.0])]
    df = frame(spark, [(i, v, "clash") for i, v in rows + odd])
    found = search_index(build_index(df, shard_vectors=90), df.filter("vec_id % 20 = 0")).collect()
    vectors = dict(rows) | {940: [1.0, 2.0], 941: [2.0, 1.0]}
    got = {}
    for x in sorted(found, key=lambda x: (x.query_id, x["rank"])):
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert set(got) == {i for i in vectors if i % 20 == 0}
    for q, near in got.items():
        want = brute(vectors, q)
        assert [i for i, _ in near] == [i for i, _ in want]
        assert np.allclose([s for _, s in near], [s for _, s in want], atol=1e-12)


def test_large_shards_reach_the_recall(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=16).astype(np.float32).tolist()) for i in range(3000)]
    df = frame(spark, [(i, v, "x") for i, v in rows])
    found = search_index(build_index(df, shard_vectors=1500), df.filter("vec_id % 20 = 0")).collect()
    by = {}
    for x in found:
        by.setdefault(x.query_id, set()).add(x.vec_id)
    recall = np.mean([len(by[q] & {i for i, _ in brute(dict(rows), q)}) / 20 for q in by])
    assert len(by) == 150 and recall >= 0.9


def test_graph_reaches_clusters_apart_from_each_other():
    r = np.random.default_rng(2)
    for n, spread in ((200, 0.3), (800, 0.05), (4000, 0.05)):
        v = (r.normal(size=(n // 40, 1, 32)) + spread * r.normal(size=(n // 40, 40, 32))).reshape(-1, 32)[r.permutation(n)]
        found = Graph(v).search(v[:80])
        assert np.mean([len(set(np.argsort(-(v @ x))[:20]) & set(f.tolist())) for x, f in zip(v[:80], found, strict=True)]) / 20 >= 0.95


def test_graphs_of_few_points():
    for n in (1, 2, 3, 40):
        v = np.random.default_rng(n).normal(size=(n, 4))
        found = Graph(v).search(v)
        assert all(set(f[f >= 0].tolist()) == set(range(n)) for f in found)


def test_repeated_ids_and_rows(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 2.0]), (21, [1.0, 0.0]), (21, [1.0, 0.0]), (22, [0.5, 0.5])]
    df = frame(spark, [(i, v, "x") for i, v in rows])
    got = search_index(build_index(df), df.filter("vec_id = 20")).select("rank", "vec_id", "score").collect()
    first = [(1, 21, 1.0), (2, 22, 0.5), (3, 20, 0.0)]  # of [1, 0]; the other row of the id is a candidate
    second = [(1, 22, 1.0), (2, 20, 0.0), (3, 21, 0.0)]  # of [0, 2]
    assert sorted(map(tuple, got)) == sorted(first + second)


def test_queries_in_several_blocks_of_several_shards(spark, monkeypatch):
    import lodestone.llm.op_hnsw as m

    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=6).astype(np.float32).tolist()) for i in range(400)]
    df = frame(spark, [(i, v, "x") for i, v in rows])
    index = build_index(df, shard_vectors=100)
    assert index.count() == 4
    whole = sorted(map(tuple, search_index(index, df).collect()))
    monkeypatch.setattr(m, "TASK_QUERIES", 60)
    assert sorted(map(tuple, m.search_index(index, df).collect())) == whole and len(whole) == 400 * 20


def test_empty_table(spark):
    df = frame(spark, [])
    assert search_index(build_index(df), df).collect() == []
