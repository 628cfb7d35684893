import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from lodestone.llm.op_deleted_interpolation import BUCKETS, bucket_of, learn_weights, score_texts
from tests.llm.conftest import ODD


def split(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})), None]


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7


def corpus(n=300):
    r = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        at, text = 0, []
        for _ in range(r.randrange(40)):
            at = (at * 3 + r.choice([1, 2, 5])) % 60
            text.append(words[at])
        out.append((100 + i, " ".join(text)))
    return out


def brute(rows):
    one, two, start = Counter(), Counter(), 0
    for i, t in rows:
        if fold(i) != 2:
            w = split(t)
            one.update(w)
            two.update(zip(["^", *w], w, strict=False))
            start += 1
    return one, two, start


def test_counts_and_base_equal_brute_force_whatever_the_chunks(documents):
    rows = ODD + corpus()
    one, _, _ = brute(rows)
    n, v = sum(one.values()), len(one)
    results = []
    for chars in (500, 8_000_000):
        got = score_texts(documents(rows).repartition(3), chunk_chars=chars).collect()
        assert len(got) == len(rows)
        want = sorted((str(i), len(split(t)), sum(one[w] > 0 for w in split(t)), round(sum(math.log10((one[w] + 1) / (n + v + 1)) for w in split(t)), 6)) for i, t in rows)
        assert sorted((str(x.doc_id), x.n_tokens, x.n_known, round(x.base_score, 6)) for x in got) == want
        assert all(x.train_tokens == n and x.held_out == (fold(x.doc_id) == 2) for x in got)
        results.append(sorted((str(x.doc_id), x.n_tokens, round(x.score, 6)) for x in got))
    assert results[0] == results[1]


def test_scores_are_the_mixture_of_exact_estimates(documents, monkeypatch):
    import lodestone.llm.op_deleted_interpolation as m

    rows = corpus(120)
    fixed = np.tile([0.5, 0.3, 0.2], (BUCKETS, 1))
    fixed[0] = (0, 0.6, 0.4)
    monkeypatch.setattr(m, "learn_weights", lambda *a, **k: fixed)
    one, two, start = brute(rows)
    n, v = sum(one.values()), len(one)
    for x in m.score_texts(documents(rows)).collect():
        w, want = split(dict(rows)[x.doc_id]), 0.0
        for h, t in zip(["^", *w], w, strict=False):
            c = start if h == "^" else one[h]
            a = fixed[int(bucket_of(np.array([c]))[0])]
            want += math.log10(a[0] * (two[h, t] / c if c else 0) + a[1] * one[t] / n + a[2] / (v + 1))
        assert abs(want - x.score) < 1e-6


def test_em_finds_the_weights_that_made_the_data():
    r = np.random.default_rng(0)
    cells = np.array([(3 << 40) | (41 << 20) | 121, (3 << 40) | (0 << 20) | 41, (3 << 40) | (41 << 20) | 41])
    n = np.array([900.0, 100.0, 50.0]) + r.random(3)
    w = learn_weights(cells, n, 1000, rounds=200)[3]
    assert abs(w.sum() - 1) < 1e-9 and w[0] > w[1] > w[2]


def test_model_beats_base_on_held_out_text(documents):
    got = [x for x in score_texts(documents(corpus())).collect() if x.held_out]
    assert sum(x.score for x in got) > 1.2 * sum(x.base_score for x in got)


def test_repeated_rows_and_empty_table(documents):
    got = score_texts(documents([(1, "a b"), (1, "a b"), (1, "c d")])).collect()
    assert len(got) == 3 and len({round(x.score, 9) for x in got}) <= 2
    assert score_texts(documents([])).collect() == []


def test_chunks_do_not_depend_on_the_order_of_a_partitions_rows(documents):
    import lodestone.llm.op_deleted_interpolation as m

    rows = ODD + corpus(80)
    names = []
    for own in (rows, rows[::-1], rows[40:] + rows[:40]):
        told = m.ordered(documents(own).coalesce(1), "doc_id", "text").mapInArrow(m._teller(500, None, 7), m._TEXTS)
        names.append(sorted(x.chunk for x in told.collect()))
    assert len(names[0]) > 5 and names[0] == names[1] == names[2]


def test_weights_do_not_depend_on_the_chunks(documents, monkeypatch):
    import lodestone.llm.op_deleted_interpolation as m

    learn, seen = m.learn_weights, []
    monkeypatch.setattr(m, "learn_weights", lambda cells, n, distinct: seen.append(sorted(zip(cells.tolist(), n.tolist(), strict=True))) or learn(cells, n, distinct))
    rows = corpus(150)
    for chars in (300, 8_000_000):
        m.score_texts(documents(rows).repartition(2), chunk_chars=chars).collect()
    assert seen[0] == seen[1] and sum(n for _, n in seen[0]) == sum(len(split(t)) for i, t in rows if fold(i) == 0)
