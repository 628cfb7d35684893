"""Responses of search providers, which arrive as tables, parsed into candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.govern import bounded
from lodestone.functions.text import dedupe_lines, is_truncated
from lodestone.functions.urls import source_class

SNIPPET = 1200
CANDIDATE = "title:string,locator:string,snippet:string,published_at:string,metadata:map<string,string>"


def titled_text(raw: DataFrame, limit: int, keys: list[str], column: str = "stdout") -> DataFrame:
    """Candidates of a provider that answers in blocks `Title: / URL: / Published: / Highlights:`.

    A block without URL is none. Without any block, bare URLs of the text are candidates.
    """
    blocks = raw.select(*keys, column, F.posexplode(F.slice(F.split(F.col(column), r"(?m)^Title:\s*", -1), F.lit(2), F.lit(100_000))).alias("pos", "block"))
    url = F.regexp_extract("block", r"(?m)^URL:\s*(\S+)", 1)
    published = F.trim(F.regexp_extract("block", r"(?md)^Published:\s*(.+)$", 1))
    highlights = F.regexp_extract("block", r"(?ms)^Highlights:\s*(.*?)(?=\n---\s*$|\z)", 1)
    rows = blocks.select(*keys, "pos", F.trim(F.substring_index("block", "\n", 1)).alias("title"), url.alias("locator"), dedupe_lines(highlights, SNIPPET).alias("snippet"), F.when(~F.lower(published).isin("", "n/a", "null"), published).alias("published_at")).filter("locator <> ''")
    bare = raw.join(rows.select(*keys).distinct(), keys, "left_anti").select(*keys, F.posexplode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(column), F.lit(r"https?://[^\s)]+"), F.lit(0)), lambda u: F.regexp_replace(u, "[.,]+$", "")))).alias("pos", "locator"))
    bare = bare.select(*keys, "pos", F.col("locator").alias("title"), "locator", F.lit("").alias("snippet"), F.lit(None).cast("string").alias("published_at"))
    return _listed(rows.unionByName(bare), keys, limit)


def _listed(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    from pyspark.sql import Window

    rows = rows.withColumn("idx", (F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1).cast("long")).filter(F.col("idx") < limit).drop("pos")
    return rows.withColumn("snippet_truncated", is_truncated(F.col("snippet"))).withColumn("source_class", source_class(F.col("locator")))


def repository_rows(raw: DataFrame, keys: list[str], column: str = "stdout") -> DataFrame:
    """Candidates of a code host's JSON list: rank counts the rows without a URL, which are left out."""
    shape = "array<struct<fullName:string,url:string,description:string,stargazersCount:bigint,license:struct<key:string>>>"
    rows = raw.select(*keys, F.posexplode(F.from_json(column, shape)).alias("pos", "r")).filter("r.url <> ''")
    return rows.select(*keys, (F.col("pos") + 1).cast("long").alias("rank"), F.coalesce("r.fullName", F.lit("GitHub repository")).alias("title"), F.col("r.url").alias("locator"), F.coalesce("r.description", F.lit("")).alias("snippet"), F.col("r.stargazersCount").alias("stars"), F.col("r.license.key").alias("license"))


def command_responses(raw: DataFrame, specs: DataFrame, limit: int, keys: list[str], column: str = "stdout") -> tuple[DataFrame, DataFrame]:
    """Candidates and attempts of command providers. raw: keys, provider, exit_code, stdout; specs: name, scope.

    A response must be JSON of the shape agreed and name its own provider and scope; candidates are cut and bounded.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    shape = f"provider string, scope string, candidates array<struct<{CANDIDATE}>>, warnings array<string>"
    rows = raw.join(specs.select(F.col("name").alias("provider"), F.col("scope").alias("of_scope")), "provider").withColumn("r", F.from_json(column, shape))
    problem = F.when(F.col("exit_code") != 0, "search_failed").when(F.octet_length(column) > 2_000_000, "provider_protocol_error").when(F.col("r").isNull() | F.col("r.candidates").isNull() | (F.col("r.provider") != F.col("provider")) | (F.col("r.scope") != F.col("of_scope")), "provider_protocol_error")
    rows = rows.withColumn("code", problem)
    found = rows.filter("code is null").select(*keys, "provider", F.posexplode(F.slice("r.candidates", 1, limit)).alias("pos", "c")).select(*keys, "provider", F.col("pos").cast("long").alias("idx"), "c.title", "c.locator", "c.snippet", "c.published_at")
    attempts = rows.select(*keys, "provider", F.when(F.col("code").isNull(), "success").otherwise("failed").alias("status"), "code", F.when(F.col("code").isNull(), F.least(F.size("r.candidates"), F.lit(limit))).otherwise(0).cast("long").alias("candidate_count"))
    return bounded(found), attempts
