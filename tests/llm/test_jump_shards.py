import zlib

import numpy as np

from lodestone.llm.op_jump_shards import jump_hash, jump_shards
from tests.llm.conftest import ODD


def brute(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_vectorized_hash_is_the_sequential_one():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2)
    for n in (1, 2, 40, 41, 1000):
        assert jump_hash(keys, n).tolist() == [brute(int(k), n) for k in keys]


def test_growth_moves_rows_only_into_the_new_shard():
    keys = np.arange(20000, dtype=np.uint64) * np.uint64(11400714819323198485)
    a, b = jump_hash(keys, 40), jump_hash(keys, 41)
    assert set(b[a != b].tolist()) == {40}
    assert abs((a != b).mean() - 1 / 41) < 0.005


def test_rows_slots_and_sizes(documents):
    got = jump_shards(documents(ODD)).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ODD)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want


def test_empty_table(documents):
    assert jump_shards(documents([])).collect() == []
