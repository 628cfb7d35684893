"""Redaction, bounds, governance rules and the error taxonomy."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import collapse, compact, lines

# Patterns and bounds that results depend on.
SECRET_KEY = r"(?i)(?:authorization|cookie|credential|password|secret|token|api[_-]?key)"
BEARER = r"(?i)(bearer\s+)[^\s,;]+"
ASSIGNED = r"(?i)((?:token|secret|password|api[_-]?key)\s*[=:]\s*)[^\s,;]+"
PROVIDER_KEY = r"""(?i)(exaApiKey=)[^\s&"']+"""
ANSI = r"\x1b\[[0-9;]*m"
RATE_LIMIT = r"(?i)(?:http\s*)?429|rate[ -]?limit"
ERROR_TEXT = 320
BOUNDS = {"title": 300, "locator": 2000, "snippet": 1600, "published_at": 100}
METADATA_KEYS, ITEMS, KEY_TEXT, VALUE_TEXT, DEEP_TEXT = 32, 20, 100, 1000, 500
WARNINGS, WARNING_TEXT = 20, 500

#: code, exit status, whether it may be tried again
ERRORS = (
    ("engine_error", 5, False),
    ("invalid_input", 2, False),
    ("policy_blocked", 3, False),
    ("adapter_unavailable", 4, False),
    ("fetch_failed", 5, True),
    ("rate_limited", 5, True),
    ("search_failed", 5, True),
    ("provider_protocol_error", 5, False),
    ("verification_failed", 6, False),
    ("interrupted", 130, False),
)


def error_taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ERRORS), "code string, exit_status int, retryable boolean")


def redact(x: Column) -> Column:
    """Text without terminal colours, bearer tokens and assigned secrets."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, ANSI, ""), BEARER, "$1[redacted]"), ASSIGNED, "$1[redacted]")


def provider_error(x: Column) -> Column:
    """A command provider's diagnostic, redacted and bounded."""
    text = redact(F.coalesce(x, F.lit("")))
    return compact(F.when(text == "", "provider exited without a diagnostic").otherwise(text), ERROR_TEXT)


def public_error(x: Column, fallback: str) -> Column:
    """message and rate_limited of a public provider's diagnostic; lines of stack traces are left out."""
    plain = F.regexp_replace(F.coalesce(x, F.lit("")), ANSI, "")
    limited = plain.rlike(RATE_LIMIT)
    kept = F.filter(F.transform(lines(plain), collapse), lambda v: (v != "") & ~F.startswith(v, F.lit("at ")) & ~F.startswith(v, F.lit("StreamableHTTPError:")))
    text = F.array_join(F.transform(kept, lambda v: F.regexp_replace(F.regexp_replace(v, BEARER, "$1[redacted]"), PROVIDER_KEY, "$1[redacted]")), " ")
    message = compact(F.when(text == "", fallback).otherwise(text), ERROR_TEXT)
    return F.struct(F.when(limited, "upstream search rate limit reached (HTTP 429)").otherwise(message).alias("message"), limited.alias("rate_limited"))


def safe_map(m: Column) -> Column:
    """The first keys of a flat map, without those that name secrets; keys and values bounded."""
    kept = F.filter(F.slice(F.map_entries(m), 1, METADATA_KEYS), lambda e: ~e["key"].rlike(SECRET_KEY))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(F.left(e["key"], F.lit(KEY_TEXT)).alias("key"), compact(e["value"], VALUE_TEXT).alias("value"))))


def _cut(text: str, limit: int) -> str:
    text = " ".join(text.split())
    return text if len(text) <= limit else text[: limit - len(" [truncated]")].rstrip() + " [truncated]"


def safe_value(value: Any, depth: int = 0) -> Any:
    """A nested JSON value within bounds of depth, length and text, without secret keys."""
    if depth >= 2:
        return _cut(str(value), DEEP_TEXT)
    if isinstance(value, str):
        return _cut(value, VALUE_TEXT)
    if isinstance(value, list):
        return [safe_value(v, depth + 1) for v in value[:ITEMS]]
    if isinstance(value, dict):
        return {str(k)[:KEY_TEXT]: safe_value(v, depth + 1) for k, v in list(value.items())[:ITEMS] if not re.search(SECRET_KEY, str(k))}
    return value


@F.pandas_udf(T.StringType())
def safe_json(raw: pd.Series) -> pd.Series:
    """Nested metadata as JSON, within bounds; null if it is no object. Depth has no native form, so batches pass through Arrow."""

    def one(text):
        try:
            value = json.loads(text) if isinstance(text, str) else None
        except ValueError:
            return None
        if not isinstance(value, dict):
            return None
        kept = {str(k)[:KEY_TEXT]: safe_value(v) for k, v in list(value.items())[:METADATA_KEYS] if not re.search(SECRET_KEY, str(k))}
        return json.dumps(kept, ensure_ascii=False, sort_keys=True)

    return raw.map(one)


def bounded(candidates: DataFrame) -> DataFrame:
    """Candidates with each text column within its bound."""
    return candidates.withColumns({c: compact(F.col(c), n) for c, n in BOUNDS.items() if c in candidates.columns})


def bounded_warnings(x: Column) -> Column:
    return F.transform(F.slice(x, 1, WARNINGS), lambda w: compact(w, WARNING_TEXT))


def scope_violations(specs: DataFrame, scopes: list[str], *, allow_sensitive: bool = False) -> DataFrame:
    """rule and name of each broken rule of the chosen scopes. specs: name, scope, sensitivity, isolated."""
    mine = specs.filter(F.col("scope").isin(scopes))
    hidden = mine.filter(F.lit(not allow_sensitive) & F.col("sensitivity").isin("account-visible", "internal")).select(F.lit("sensitive scope needs consent").alias("rule"), "name")
    mixed = mine.filter("isolated").filter(F.lit(len(scopes) > 1)).select(F.lit("isolated provider must be the only scope").alias("rule"), "name")
    flags = mine.groupBy("scope").agg(F.bool_or("isolated").alias("some"), F.bool_and("isolated").alias("every"))
    partly = flags.filter("some and not every").select(F.lit("all providers of an isolated scope must be isolated").alias("rule"), F.col("scope").alias("name"))
    return hidden.unionAll(mixed).unionAll(partly)


def manifest_violations(specs: DataFrame) -> DataFrame:
    """rule and name of each broken rule of a manifest. specs: name, scope, sensitivity, isolated, command (array)."""
    name = r"^[a-z][a-z0-9_-]{0,63}$"
    rules = [
        ("reserved provider name", F.col("name").isin("workspace", "exa", "github")),
        ("reserved scope", F.col("scope").isin("auto", "local", "public")),
        ("name pattern", ~F.col("name").rlike(name) | ~F.col("scope").rlike(name)),
        ("internal provider must be isolated", (F.col("sensitivity") == "internal") & ~F.col("isolated")),
        ("empty command part", (F.size("command") == 0) | F.exists("command", lambda c: (c == "") | F.contains(c, F.lit("\x00")))),
    ]
    out = specs.groupBy("name").count().filter("count > 1").select(F.lit("duplicate provider name").alias("rule"), "name")
    for rule, broken in rules:
        out = out.unionAll(specs.filter(broken).select(F.lit(rule).alias("rule"), "name"))
    return out
