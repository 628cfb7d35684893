"""Robots rules by authority, from a boundary table."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.urls import authority, scheme

MOST_BYTES = 512 * 1024
#: Parts into which one authority's URLs are dealt, each of which meets its rules once.
PARTS = 64


def _allowed(agent: str):
    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def check(bodies: pd.Series, urls: pd.Series) -> pd.Series:
        def one(body, mine):
            if body is None:
                return None
            rules = RobotFileParser()
            rules.parse(body.splitlines())
            return [rules.can_fetch(agent, u) for u in mine]

        return pd.Series([one(b, u) for b, u in zip(bodies, urls, strict=True)], dtype="object")

    return check


def robots_status(urls: DataFrame, robots: DataFrame, *, agent: str, fail_closed: bool = True) -> DataFrame:
    """urls (column url) with robots_status and robots_allowed. robots: authority, status_code (null: no answer), body.

    A 4xx answer allows all; a 5xx one or none blocks, unless the policy fails open.
    """
    key = F.concat(scheme(F.col("url")), F.lit("://"), F.lower(authority(F.col("url"))))
    rules = robots.select(F.lower("authority").alias("_authority"), F.col("status_code").alias("_code"), F.left("body", F.lit(MOST_BYTES)).alias("_body"))
    # each authority's rules meet the distinct paths asked of it in one row, not in one for each URL
    asked = urls.select(key.alias("_authority"), "url").distinct().groupBy("_authority", (F.pmod(F.xxhash64("url"), F.lit(PARTS))).alias("_part")).agg(F.collect_list("url").alias("_urls"))
    judged = asked.join(rules, "_authority", "left")
    code = F.col("_code")
    allowed = _allowed(agent)(F.when(code.between(200, 299), F.coalesce("_body", F.lit(""))), F.col("_urls"))
    verdicts = judged.select("_authority", "_code", F.explode(F.arrays_zip(F.col("_urls").alias("u"), F.coalesce(allowed, F.transform("_urls", lambda u: F.lit(None).cast("boolean"))).alias("ok"))).alias("z")).select("_authority", "_code", F.col("z.u").alias("_url"), F.col("z.ok").alias("_allowed"))
    rows = urls.join(verdicts, urls["url"] == verdicts["_url"], "left")
    status = F.when(code.between(200, 299), F.when(F.col("_allowed"), "allowed").otherwise("blocked")).when(code.between(400, 499), "unavailable").otherwise(F.lit("blocked" if fail_closed else "unavailable"))
    return rows.withColumn("robots_status", status).withColumn("robots_allowed", F.col("robots_status") != "blocked").drop("_authority", "_code", "_url", "_allowed")
