import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import functions as F

import lodestone.llm.op_anchor_simhash as m
from lodestone.llm.components import components
from lodestone.llm.op_anchor_simhash import anchors, compare, cosets, homes_of, simhash, simhash_components, split
from tests.llm.conftest import ODD


def brute_hash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for x in root:
            for y in root:
                if bin(x ^ y).count("1") <= 2 and root[x] != root[y]:
                    root[x] = root[y] = min(root[x], root[y])
                    changed = True
    return root


def test_simhash_is_the_plain_one():
    r = random.Random(4)
    for text in [t for _, t in ODD[:7]] + [" ".join(r.choice("A b C É d e".split()) for _ in range(r.randrange(30))) for _ in range(50)]:
        assert simhash(text) == brute_hash(text)


def test_the_code_covers_and_replicas_are_complete():
    code = cosets(2)
    assert (code.lists[0][1] == 1).all()  # each syndrome has one word within the covering radius
    r = np.random.default_rng(0)
    x = r.integers(0, 1 << 62, 50)
    for bits in ([0], [5, 30], [22, 23], [44, 60], [63 - 1, 50]):
        y = x.copy()
        for b in bits:
            y ^= np.int64(1) << np.int64(b)
        ax, away, fx = anchors(x, 2)
        ay, _, fy = anchors(y, 2)
        reach = set(zip(ay.tolist(), fy.tolist(), strict=True))
        home = dict(zip(fx[~away].tolist(), ax[~away].tolist(), strict=True))
        assert len(home) == len(x)
        assert all((home[int(a)], int(b)) in reach for a, b in zip(x, y, strict=True))


def test_links_equal_brute_force(spark):
    r = random.Random(7)
    fps = set()
    for _ in range(40):
        f = r.getrandbits(64)
        for _ in range(r.randrange(12)):
            fps.add(f - (1 << 64) if f >> 63 else f)
            f ^= 1 << r.randrange(64) | 1 << r.randrange(64)
    x = np.array(sorted(fps), dtype=np.int64)
    a, away, f = anchors(x, 2)
    order = np.lexsort((f, away, a))
    left, right = compare(a[order], away[order], f[order], 2)
    links = spark.createDataFrame([(int(p), int(q)) for p, q in zip(left, right, strict=True)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    want = brute_components([int(v) & (1 << 64) - 1 for v in x])
    same = lambda roots: {frozenset(k for k in roots if roots[k] == v) for v in roots.values()}
    unsigned = {int(v) & (1 << 64) - 1: got.get(int(v), int(v)) for v in x}
    assert same(unsigned) == same(want)


def test_large_anchors_are_compared_in_full():
    r = np.random.default_rng(2)
    for n, homes in ((3000, 3000), (24_000, 60)):  # in blocks, and by looking up
        fps = np.unique(np.int64(12345) ^ (r.integers(0, 1 << 18, n) << np.int64(46)))
        r.shuffle(fps)
        away = np.arange(len(fps)) >= homes
        a, b = compare(np.zeros(len(fps), dtype=np.int64), away, fps, 2)
        root = dict(zip(a.tolist(), b.tolist(), strict=True))
        find = lambda x: root.get(x, x)
        for x in fps[: min(homes, 60)]:
            near = fps[(np.bitwise_count((fps ^ x).view(np.uint64)) <= 2) & (fps > x)]
            assert {find(int(y)) for y in near} <= {find(int(x))}


def test_chain_of_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[501] == 500
    assert components(links.limit(0)).collect() == []


def test_rows(documents):
    rows = [*ODD, (20, "a b"), (0, "")]
    got = simhash_components(documents(rows).withColumn("at", F.monotonically_increasing_id()), row_col="at").collect()
    assert len(got) == len(rows) == len({r.row for r in got})
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == by[3].component_id == 0 and by[20].component_id == 5
    assert all(r.fp & (1 << 64) - 1 == brute_hash(dict(rows)[r.doc_id]) for r in got)
    assert simhash_components(documents([])).collect() == []


def test_all_rows_equal_brute_force(documents, monkeypatch):
    r = random.Random(11)
    rows = list(ODD)
    for k in range(60):
        words = [f"w{r.randrange(400)}" for _ in range(r.randrange(3, 120))]
        for c in range(r.randrange(1, 6)):
            rows.append((100 + 10 * k + c, " ".join(words)))
            words[r.randrange(len(words))] = f"w{r.randrange(400)}"
    fps = {brute_hash(t) for _, t in rows}
    root = brute_components(list(fps))
    least = {}
    for i, t in rows:
        k = root[brute_hash(t)]
        least[k] = min(x for x in (least.get(k), i) if x is not None) if (least.get(k), i) != (None, None) else None
    want = sorted((str(i), brute_hash(t), str(least[root[brute_hash(t)]])) for i, t in rows)
    for homes in (m.PART_HOMES, 0.5):  # all anchors in parts, too
        monkeypatch.setattr(m, "PART_HOMES", homes)
        got = m.simhash_components(documents(rows)).collect()
        assert sorted((str(x.doc_id), x.fp & (1 << 64) - 1, str(x.component_id)) for x in got) == want
        assert len({x.root for x in got}) == len(set(root.values()))


def test_a_crowded_anchor_in_parts_that_stream_by(monkeypatch):
    r = np.random.default_rng(3)
    fps = np.unique(np.int64(999) ^ (r.integers(0, 1 << 18, 1500) << np.int64(46)))  # all of one home
    home = homes_of(fps)
    assert len(set(home.tolist())) == 1
    a, away, f = split(*anchors(fps, 2), {int(home[0]): 5})
    assert sum(~away & (a & (1 << 46) - 1 == home[0])) == len(fps)  # each is at home in one part
    order = np.lexsort((away, a))
    monkeypatch.setattr(m, "ROWS_AT_ONCE", 700)
    parts = [x[order] for x in (a, away, f)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 97]) for x in parts], names=["anchor", "away", "fp"]) for i in range(0, len(a), 97)]
    links = [(x, y) for b in m._compared(2)(iter(batches)) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    nodes, root = fps.tolist(), {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for x, y in links:
        root[find(x)] = find(y)
    near = [(x, int(y)) for x in nodes for y in fps[(np.bitwise_count((fps ^ x).view(np.uint64)) <= 2) & (fps > x)]]
    assert near and all(find(x) == find(y) for x, y in near) and len({find(x) for x in nodes}) > 1
