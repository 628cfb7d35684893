"""Hashes and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File endings of raw artifacts by media type.
EXTENSIONS = {
    "text/html": ".html",
    "application/xhtml+xml": ".html",
    "application/json": ".json",
    "application/ld+json": ".json",
    "application/pdf": ".pdf",
    "text/markdown": ".md",
    "text/plain": ".txt",
    "application/xml": ".xml",
    "application/rss+xml": ".xml",
    "application/atom+xml": ".xml",
}
HEADERS = ("content-type", "content-length", "etag", "last-modified", "cache-control")


def sha256(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def receipt_id(source_sha256: Column, at: Column) -> Column:
    return F.concat(F.lit("tf_"), F.left(source_sha256, F.lit(16)), F.lit("_"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"))


def anchor_id(sha: Column) -> Column:
    return F.concat(F.lit("a_"), F.left(sha, F.lit(12)))


def crawl_id(root: Column, created_at: Column) -> Column:
    return F.concat(F.lit("crawl_"), F.left(sha256(F.concat_ws("|", root, created_at)), F.lit(16)))


def page_folder(url: Column) -> Column:
    return F.left(sha256(url), F.lit(20))


def media_type(content_type: Column) -> Column:
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return F.when(kind == "", "application/octet-stream").otherwise(kind)


def raw_name(content_type: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.concat(F.lit("raw"), F.coalesce(F.try_element_at(known, media_type(content_type)), F.lit(".bin")))


def safe_headers(headers: Column) -> Column:
    """The headers that may be kept, names in lower case."""
    return F.map_filter(F.transform_keys(headers, lambda k, _: F.lower(k)), lambda k, _: k.isin(*HEADERS))


def charset(content_type: Column) -> Column:
    found = F.regexp_extract(content_type, r"(?i)charset=([^;\s]+)", 1)
    return F.when(found == "", "utf-8").otherwise(F.lower(F.trim(found, F.lit("\"'"))))


def safe_child(path: Column) -> Column:
    """Whether a relative path stays inside its folder."""
    return F.coalesce((path != "") & ~F.startswith(path, F.lit("/")) & ~F.array_contains(F.split(path, "/"), "..") & ~F.contains(path, F.lit("\x00")), F.lit(False))
