"""Shared parts of byte-level BPE: the vocabulary file and the cutting of texts into independent pieces.

Pieces are cut before a blank that a character other than white space follows, before a lone newline, and around
special tokens. No token spans such a place under the pre-tokenizer of the vocabulary, so the ids of a text are the ids of its
pieces in order, and a piece that is met again need not be encoded again.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

#: White space of the pre-tokenizer: the Unicode property, without the separators 1C to 1F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ADJACENT = re.compile(f"[{SPACE}][{SPACE}]")
_CUT = re.compile(f" (?=[^{SPACE}])")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> dict:
    """The tokenizer's file, parsed once for each process."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(maxsize=4)
def special_tokens(path: str) -> dict[str, int]:
    return {t["content"]: t["id"] for t in vocabulary(path)["added_tokens"]}


@lru_cache(maxsize=1)
def byte_of_char() -> dict[str, int]:
    """Byte that each character of the vocabulary stands for: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    to_byte = byte_of_char()
    return {i: bytes(to_byte[c] for c in token) for token, i in vocabulary(path)["model"]["vocab"].items()}


def pieces(text: str) -> list[str]:
    """Cut a text without special tokens; the pieces joined are the text.

    Where no two characters of white space are adjacent, a token ends before every blank and newline.
    """
    if not text:
        return []
    if _ADJACENT.search(text):
        first, *rest = _CUT.split(text)
        out = [first, *(" " + p for p in rest)]
    else:
        out = []
        for k, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            out.append("\n" + first if k else first)
            out += [" " + p for p in rest]
    return out if out[0] else out[1:]


def special_pattern(path: str) -> re.Pattern | None:
    names = sorted(special_tokens(path), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
