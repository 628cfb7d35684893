import random
import re

import pytest

from lodestone.llm.op_exact_dedup import MODULI, Polynomial, exact_groups, fingerprint, normalized
from tests.llm.conftest import ODD


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    return {k: min(v)[2] if not min(v)[1] else None for k, v in groups.items()}, {k: len(v) for k, v in groups.items()}


def check(rows, got):
    keep, size = brute(rows)
    texts = sorted(((i, re.sub(r"[\x20\x09-\x0D]", "", t or "")) for i, t in rows), key=str)
    assert len(got) == len(rows)
    want = sorted(((i, keep[t], size[t]) for i, t in texts), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == want
    assert sum(r.kept for r in got) == len(keep)


def test_odd_rows(documents):
    check(ODD, exact_groups(documents(ODD)).collect())


def test_empty_table(documents):
    assert exact_groups(documents([])).collect() == []


def test_combined_fingerprints_do_not_depend_on_chunks():
    data = bytes(random.Random(3).randrange(256) for _ in range(5000))
    assert len({fingerprint(data, [Polynomial(m, b, n) for m, b in MODULI], n) for n in (64, 1000, 1 << 16)}) == 1
    h = Polynomial(*MODULI[0])
    assert h.combine(fingerprint(data[:77], [h]), fingerprint(data[77:], [h]), len(data) - 77) == fingerprint(data, [h])


@pytest.mark.parametrize("chunk", [4, 1 << 16])
def test_colliding_fingerprints_are_told_apart(documents, chunk):
    rows = [(i, random.Random(i % 40).choice("abcdef") * 5 + str(i % 40)) for i in range(120)]
    got = exact_groups(documents(rows), moduli=((7, 3),), chunk_bytes=chunk, filter_bits=1 << 15).collect()
    check(rows, got)


def test_normalized_deletes_ascii_white_space_only():
    assert normalized("a \t\n\v\f\rb\x1c\x85") == "ab\x1c\x85".encode()
