"""Cutting Markdown into hashed anchors of line ranges."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions.ids import anchor_id, sha256
from lodestone.functions.text import collapse, lines, numbered_lines, strip
from lodestone.session import row_by_row

HEADING = r"^#{1,6}\s+"
ITEM = r"^(?:[-*+]\s+|\d+[.)]\s+)"
PREVIEW = 240
_BLOCK = T.StructType([T.StructField(n, T.LongType() if n.startswith("line_") else T.StringType()) for n in ("kind", "heading", "line_start", "line_end", "sha256", "preview")])
_BLOCKS = T.ArrayType(_BLOCK)


def line_kind(line: Column) -> Column:
    """heading, code, table, list, paragraph, or null for a blank line."""
    text = strip(line)
    left = F.regexp_replace(line, r"^\s+", "")
    return (
        F.when(text == "", None)
        .when(left.rlike(HEADING), "heading")
        .when(F.startswith(left, F.lit("```")) | F.startswith(left, F.lit("~~~")), "code")
        .when(F.startswith(left, F.lit("|")), "table")
        .when(left.rlike(ITEM), "list")
        .otherwise("paragraph")
    )


def anchors(docs: DataFrame, keys: list[str], text_col: str = "markdown") -> DataFrame:
    """One row per block: keys, pos, anchor_id, kind, heading, line_start, line_end, sha256, preview.

    Native form for documents without code fences (others are cut by `fenced_anchors`): blocks are the longest runs
    of lines of one kind, each heading is its own, and a heading holds until the next. Work is within one document.
    """
    rows = numbered_lines(docs.withColumn("_text", F.col(text_col)), keys, "_text", most_bytes=None).withColumn("kind", line_kind(F.col("line")))
    order = Window.partitionBy(*keys).orderBy("line_no")
    before = F.lag("kind").over(order)
    rows = rows.withColumn("_new", F.col("kind").isNotNull() & ((F.col("kind") == "heading") | ~before.eqNullSafe(F.col("kind"))))
    rows = rows.withColumn("_block", F.sum(F.col("_new").cast("int")).over(order)).filter("kind is not null")
    blocks = rows.groupBy(*keys, "_block").agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.first("kind").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    order = Window.partitionBy(*keys).orderBy("line_start")
    title = F.when(F.col("kind") == "heading", strip(F.regexp_replace(F.regexp_replace("text", r"^\s+", ""), HEADING, "")))
    blocks = blocks.withColumn("heading", F.last(title, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("sha256", sha256(F.col("text")))
    return blocks.select(*keys, (F.row_number().over(order) - 1).cast("long").alias("pos"), anchor_id(F.col("sha256")).alias("anchor_id"), "kind", "heading", "line_start", "line_end", "sha256", F.left(collapse(F.col("text")), F.lit(PREVIEW)).alias("preview"))


def cut_blocks(markdown: str) -> list[tuple]:
    """(kind, heading, line_start, line_end, sha256, preview) of each block of one document, code fences included."""
    all_lines, out, heading, at = markdown.splitlines(), [], None, 0

    def kind_of(line: str) -> str | None:
        left = line.lstrip()
        if not left:
            return None
        if re.match(HEADING, left):
            return "heading"
        if left[:3] in ("```", "~~~"):
            return "code"
        return "table" if left[0] == "|" else "list" if re.match(ITEM, left) else "paragraph"

    while at < len(all_lines):
        kind = kind_of(all_lines[at])
        end = at + 1
        if kind == "heading":
            heading = re.sub(HEADING, "", all_lines[at].lstrip()).strip()
        elif kind == "code":
            fence = all_lines[at].lstrip()[:3]
            closing = (i for i in range(end, len(all_lines)) if all_lines[i].lstrip()[:3] == fence)
            end = next(closing, len(all_lines) - 1) + 1
        elif kind:
            while end < len(all_lines) and kind_of(all_lines[end]) == kind:
                end += 1
        if kind:
            text = "\n".join(all_lines[at:end])
            out.append((kind, heading, at + 1, end, hashlib.sha256(text.encode()).hexdigest(), " ".join(text.split())[:PREVIEW]))
        at = end
    return out


def fenced_anchors(docs: DataFrame, keys: list[str], text_col: str = "markdown") -> DataFrame:
    """As `anchors`, for any document: a fence closes at a line that begins with its three characters, or at the end.

    The state of a fence runs from line to line, so each document is cut in Python, in Arrow batches.
    """

    @F.arrow_udf(_BLOCKS)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        blocks = lambda t: [dict(zip(_BLOCK.names, b, strict=True)) for b in cut_blocks(t)] if t is not None else []
        return row_by_row(((b,) for b in batches), blocks, lambda out: 1 + sum(100 + len(b["preview"]) for b in out), to_arrow_type(_BLOCKS))

    rows = docs.select(*keys, F.posexplode(cut(F.col(text_col))).alias("pos", "b"))
    return rows.select(*keys, F.col("pos").cast("long").alias("pos"), anchor_id(F.col("b.sha256")).alias("anchor_id"), "b.*")


def anchor_mismatches(docs: DataFrame, found: DataFrame, keys: list[str], text_col: str = "markdown") -> DataFrame:
    """Anchors whose range is not in the document, or whose lines have another hash: keys, pos, failure."""
    rows = found.join(docs.select(*keys, lines(F.col(text_col)).alias("_lines")), keys)
    inside = (F.col("line_start") >= 1) & (F.col("line_end") >= F.col("line_start")) & (F.col("line_end") <= F.size("_lines"))
    text = F.array_join(F.slice("_lines", F.greatest("line_start", F.lit(1)).cast("int"), F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(0)).cast("int")), "\n")
    failure = F.when(~inside, "anchor range invalid").when(sha256(text) != F.col("sha256"), "anchor sha256 mismatch")
    return rows.select(*keys, "pos", failure.alias("failure")).filter("failure is not null")
