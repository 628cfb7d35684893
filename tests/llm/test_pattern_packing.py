import math
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lodestone.llm.op_pattern_packing import best_fit, cut_lengths, enumerate_patterns, fit_repeats, fitted, intervals, pack, plan
from tests.llm.conftest import ODD


def test_plan_uses_each_piece_once_and_is_tight():
    r = np.random.default_rng(0)
    for n in (1, 50, 20000):
        lengths = np.clip(r.lognormal(5.5, 1.1, n).astype(int), 1, 1024)
        histogram = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))
        used, sequences = {}, 0
        for shape, repeats in plan(histogram):
            assert sum(shape) <= 1024 and repeats > 0
            sequences += repeats
            for v in shape:
                used[v] = used.get(v, 0) + repeats
        assert used == histogram
        assert sequences <= math.ceil(lengths.sum() / 1024) * 1.01 + 1


def test_the_fit_places_most_pieces_and_no_more_sequences_are_needed_than_by_best_fit():
    r = np.random.default_rng(4)
    for n in (300, 1500, 200_000):
        lengths = np.clip(r.lognormal(5.8, 0.9, n).astype(int), 1, 1023)
        histogram = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))
        left = dict(histogram)
        placed = sum(len(shape) * repeats for shape, repeats in fitted(left, 1024))
        assert placed > 0.5 * n and placed + sum(left.values()) == n and min(left.values()) >= 0
        assert sum(k for _, k in plan(histogram)) <= 1.002 * sum(k for _, k in best_fit(histogram, 1024)) + 1


def test_fit_is_the_least_squares_one():
    lengths = np.array([700, 600, 424, 324])
    patterns = enumerate_patterns(lengths, 1024)
    counts = np.array([30.0, 20.0, 20.0, 30.0])
    x = fit_repeats(patterns, counts, np.zeros(len(patterns)))
    a = np.stack([(patterns == k).sum(axis=1) for k in range(4)]).astype(float)
    assert (x >= 0).all() and np.linalg.norm(a @ x - counts) < 1e-6


def test_best_fit_of_awkward_lengths():
    assert sum(n for _, n in best_fit({600: 7, 424: 3}, 1024)) == 7
    assert plan({}) == [] and intervals([]) == {}


def test_only_the_first_piece_may_be_shorter():
    assert cut_lengths(1024, 1024) == [(0, 1024)]
    assert cut_lengths(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]
    assert cut_lengths(1, 1024) == [(0, 1)]


def test_rows(documents):
    r = random.Random(1)
    rows = [(i, t) for i, t in ODD if i != 4] + [(100 + i, " ".join(r.choice(["the", "onthe", "erin"]) for _ in range(r.randrange(700)))) for i in range(60)]
    got = pack(documents(rows)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        own = sorted(by[i], key=lambda x: x.piece)
        assert [(x.start, x.length) for x in own] == cut_lengths(len(ids), 1024)
        assert all(x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes()) for x in own)
    sequences = {}
    for x in got:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(sequences) <= math.ceil(sum(x.length for x in got) / 1024) + 1


def test_repeated_rows_and_empty_table(documents):
    got = pack(documents([(1, "a b"), (1, "a b")])).collect()
    assert len({(x.sequence_id, x.offset) for x in got}) == 2
    assert pack(documents([])).collect() == []
