"""Text expressions: folding, white space, bounds, lines and Markdown."""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of Unicode text, as a Java class.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
TRUNCATED = " [truncated]"
SNIPPET_TRUNCATED = "\n[truncated]"


@lru_cache(maxsize=1)
def _folded() -> tuple[str, str, list[tuple[str, str]]]:
    """Lower-case characters that folding changes: one to one (from, to), and one to several."""
    changed = [(c, c.casefold()) for c in map(chr, range(sys.maxunicode + 1)) if c.lower() == c != c.casefold()]
    single = [(c, f) for c, f in changed if len(f) == 1]
    return "".join(c for c, _ in single), "".join(f for _, f in single), [(c, f) for c, f in changed if len(f) > 1]


def _ranges(chars: str) -> str:
    """A Java class of the characters, neighbours as ranges."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out) + "]"


def fold(x: Column) -> Column:
    """Full case folding: lower case, final sigma and its like as the plain letter, sharp s and ligatures as letters."""
    source, target, several = _folded()
    low = F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))  # the one that is frequent
    pairs = F.split(F.lit(" ".join(c + f for c, f in several)), " ")  # one literal, which keeps plans small
    full = F.aggregate(pairs, F.translate(low, source, target), lambda out, p: F.replace(out, F.left(p, F.lit(1)), F.substring(p, 2, 9)))
    # texts of ASCII and Latin letters end at the first test, which is two ranges
    return F.when(low.rlike(r"[^\x00-\xB4\xB6-\u0148]") & low.rlike(_ranges(source + "".join(c for c, _ in several))), full).otherwise(low)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def collapse(x: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(x, f"{SPACE}+", " "))


def compact(x: Column, limit: int, marker: str = TRUNCATED) -> Column:
    """Collapsed text of at most `limit` characters; what is cut ends with the marker."""
    text = collapse(x)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(limit - len(marker)))), F.lit(marker)))


def is_truncated(x: Column) -> Column:
    return F.coalesce(F.endswith(x, F.lit(TRUNCATED)) | F.endswith(x, F.lit(SNIPPET_TRUNCATED)), F.lit(False))


def lines(x: Column) -> Column:
    """Lines of a text, without a last empty one; CRLF, CR and the other line ends of Unicode count."""
    parts = F.split(x, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def newline_lines(x: Column) -> Column:
    """Lines that only a newline ends, without a last empty one; an empty text is one empty line."""
    parts = F.split(x, "\n", -1)
    return F.when(F.endswith(x, F.lit("\n")), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def numbered_lines(docs: DataFrame, keys: list[str], text_col: str = "text", *, most_bytes: int | None = 1_000_000, cut: Callable[[Column], Column] = lines) -> DataFrame:
    """One row per line, as `cut` finds them: keys, line_no (from 1), line. Larger files than `most_bytes` are skipped."""
    if most_bytes is not None:
        docs = docs.filter(F.octet_length(text_col) <= most_bytes)
    return docs.select(*keys, F.posexplode(cut(F.col(text_col))).alias("pos", "line")).select(*keys, (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def clean_markdown(x: Column) -> Column:
    """Line ends as newlines, no blanks before them, at most three in a row, one at the end; blank text is empty."""
    text = F.regexp_replace(F.regexp_replace(x, "\r\n?", "\n"), "[ \t]+\n", "\n")
    text = strip(F.regexp_replace(text, "\n{4,}", "\n\n\n"))
    return F.when(text == "", text).otherwise(F.concat(text, F.lit("\n")))


def markdown_title(x: Column) -> Column:
    """The first heading of level one, or null."""
    title = F.regexp_extract(x, r"(?md)^#\s+(.+?)\s*$", 1)
    return F.when(title != "", title)


def dedupe_lines(x: Column, limit: int, marker: str = SNIPPET_TRUNCATED) -> Column:
    """Lines without blank ones, those of three dots, and repeats of the line kept before; cut to `limit` characters."""
    kept = F.filter(F.transform(lines(x), strip), lambda v: (v != "") & (v != "..."))
    kept = F.aggregate(kept, F.array().cast("array<string>"), lambda out, v: F.when(F.coalesce(F.try_element_at(out, F.lit(-1)) == v, F.lit(False)), out).otherwise(F.concat(out, F.array(v))))
    text = F.array_join(kept, "\n")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.left(text, F.lit(limit - len(marker))), f"{SPACE}+$", ""), F.lit(marker)))


def markdown_links(docs: DataFrame, keys: list[str], text_col: str = "text", base_col: str | None = None) -> DataFrame:
    """Inline links in order, images included: keys, pos, text, url; http(s) only, the first of each (text, url)."""
    from lodestone.functions.urls import join_url
    from lodestone.operators.merge import first_of_each

    pattern = r"""\[([^\]]+)\]\(([^)\s]+)(?:\s+['"][^'"]*['"])?\)"""
    found = docs.select(*keys, *([base_col] if base_col else []), F.posexplode(F.arrays_zip(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1)).alias("text"), F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(2)).alias("href"))).alias("pos", "link"))
    url = join_url(F.col(base_col), F.col("link.href")) if base_col else F.col("link.href")
    rows = found.select(*keys, F.col("pos").cast("long").alias("pos"), collapse(F.col("link.text")).alias("text"), url.alias("url")).filter(F.col("url").rlike("^https?://"))
    return first_of_each(rows, [*keys, "text", "url"], ["pos"])
