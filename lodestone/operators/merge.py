"""Merging of candidate lists, attempts, and folds over providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(locator: Column) -> Column:
    """A locator without the slashes at its end."""
    return F.regexp_replace(locator, "/+$", "")


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def round_robin(candidates: DataFrame, limit: int, *, query: str = "query_id", group: str = "group_no", index: str = "idx", locator: str = "locator") -> DataFrame:
    """Merge ordered lists: the first candidates of all groups, then the second ones, and so on.

    Of candidates with one canonical locator the first in that order stays; later ones of a list move up. Adds `rank`
    from 1 to `limit`. The first window deals rows out by locator, so one query's long lists are not in one task before they are cut.
    """
    rows = candidates.withColumn("_key", canonical(F.col(locator)))
    rows = first_of_each(rows, [query, "_key"], [index, group])
    order = Window.partitionBy(query).orderBy(index, group)
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit).drop("_key")


def provider_ranks(candidates: DataFrame, limit: int, **names: str) -> DataFrame:
    """Merged candidates with their rank in the provider's own list (from 1) beside the merged one."""
    return round_robin(candidates, limit, **names).withColumn("provider_rank", (F.col(names.get("index", "idx")) + 1).cast("long"))


def attempts_with_counts(attempts: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts with the number of their candidates; those without any have 0."""
    counts = candidates.groupBy(*keys).agg(F.count("*").alias("candidate_count"))
    return attempts.join(counts, keys, "left").withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)).cast("long"))


def outcome(attempts: DataFrame, query: str = "query_id") -> DataFrame:
    """For each query: all_failed (nothing found and no attempt succeeded), partial (found though one failed)."""
    found, ok, failed = F.sum("candidate_count"), F.bool_or(F.col("status") == "success"), F.bool_or(F.col("status") == "failed")
    return attempts.groupBy(query).agg(found.cast("long").alias("candidates"), (~ok & (found == 0)).alias("all_failed"), (failed & (found > 0)).alias("partial"))


def pick_provider(results: DataFrame, *, query: str = "query_id", order: str = "provider_no") -> DataFrame:
    """Ordered choice of one provider: all attempts up to and with the first that found something."""
    first = F.min(F.when(F.col("candidate_count") > 0, F.col(order))).over(Window.partitionBy(query))
    return results.withColumn("_first", first).filter(F.col("_first").isNull() | (F.col(order) <= F.col("_first"))).withColumn("picked", F.coalesce(F.col(order) == F.col("_first"), F.lit(False))).drop("_first")


def sensitivity(rows: DataFrame, keys: list[str], column: str = "sensitivity") -> DataFrame:
    """The strictest sensitivity of each key: internal, then account-visible, else public-or-project."""
    level = F.max(F.when(F.col(column) == "internal", 2).when(F.col(column) == "account-visible", 1).otherwise(0))
    return rows.groupBy(*keys).agg(F.when(level == 2, "internal").when(level == 1, "account-visible").otherwise("public-or-project").alias("sensitivity"))


def expand_scopes(scopes: list[str] | None) -> list[str]:
    """Scopes in order, each once; none means local, auto means local and public and stands alone."""
    wanted = list(dict.fromkeys(s.strip().lower() for s in scopes or ["local"]))
    if "auto" in wanted:
        if len(wanted) > 1:
            raise ValueError("auto can't be combined with other scopes")
        return ["local", "public"]
    return wanted


def distinct_in_order(values: Column) -> Column:
    """Warnings, each once, as first seen."""
    return F.array_distinct(values)


def sorted_distinct(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def check_adapters(adapters: dict[str, object], limit: int, reserved: tuple[str, ...]) -> None:
    """Injected adapters must be named as their keys say, by names that aren't reserved; limits are positive."""
    if limit < 1:
        raise ValueError("invalid_input: limit must be at least 1")
    for name, adapter in adapters.items():
        if name in reserved or getattr(adapter, "name", None) != name:
            raise ValueError(f"invalid_input: adapter name {name!r}")
