import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm.op_trie_bpe import TrieEncoder, bpe_digests
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return TrieEncoder(PATH), Tokenizer.from_file(PATH)


def test_ids_and_round_trip_equal_the_library(both):
    own, library = both
    parts = ["a", "the", "  ", " ", "\n", "\t", "\x85", " ", "　", "1", "²", "'s", "'re", "!!", "<|endoftext|>", "é", "漢字", "😀", "\x1c", "ing", " hello", "\r\n", "aaaa", "Ⅷ", "ß", "́", "\x00"]
    r = random.Random(5)
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        ids = own.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_decode_of_cut_characters_equals_the_library(both):
    own, library = both
    ids = own.encode("漢字 😀")[:-1]
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_shared_prefixes_have_the_encodings_of_single_words(both):
    own, library = both
    r = random.Random(2)
    words = {"".join(r.choice("etaon") for _ in range(r.randrange(1, 12))).encode() for _ in range(2000)}
    for word, ids in own.encode_words(words).items():
        assert ids == library.encode(word.decode(), add_special_tokens=False).ids


def test_rows(documents, both):
    got = {str(r.doc_id): r for r in bpe_digests(documents(ODD)).collect()}
    for i, t in ODD:
        ids, r = both[1].encode(t or "", add_special_tokens=False).ids, got[str(i)]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(both[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_digests(documents([])).collect() == []
