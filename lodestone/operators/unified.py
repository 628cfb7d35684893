"""Unified search: scopes, provider specs, attempts and merged candidates of a table of queries in one call.

Local candidates come from a search of files; what public and command providers answered are tables. Each of a query's
sources is a group; groups are merged in turn, and the attempts tell what became of each source.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import govern, urls
from lodestone.functions.text import compact
from lodestone.operators import merge

#: Public providers in the order in which they are asked, and how many warnings are kept.
PUBLIC = ("exa", "github")
PARTIAL = "public search returned partial results after a provider failure"
SHARED = ("provider", "scope", "title", "locator", "snippet", "source_class", "evidence_state", "sensitivity", "published_at", "provider_rank")


class Found(NamedTuple):
    """candidates: query_id, rank and the shared columns; attempts: query_id, seq, provider, scope, status,
    candidate_count, code, message; outcomes: query_id, status (success, partial or failed), error_code, warnings."""

    candidates: DataFrame
    attempts: DataFrame
    outcomes: DataFrame


def first_variant(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Answers to a provider's first request; those to the relaxed one only where the first found nothing. rows: keys,
    variant (from 0), and any others."""
    least = F.min("variant").over(Window.partitionBy(*keys))
    return rows.withColumn("_least", least).filter("variant = _least").drop("_least")


def _attempted(queries: DataFrame, names: list[tuple[int, str, str]], states: DataFrame, counts: DataFrame) -> DataFrame:
    """One row for each query and source: what was recorded of it, or success where nothing was."""
    said = states.select("query_id", "provider", "available", F.col("error_code").alias("_code"), F.col("error_message").alias("_message"))
    # the sources are few and stated by the caller: one row of each query is made for each of them
    rows = queries.select("query_id", F.explode(F.array(*[F.struct(F.lit(r[0]).alias("seq"), F.lit(r[1]).alias("provider"), F.lit(r[2]).alias("scope")) for r in names])).alias("s")).select("query_id", "s.*")
    rows = rows.join(said, ["query_id", "provider"], "left").join(counts, ["query_id", "provider"], "left")
    status = F.when(~F.coalesce("available", F.lit(True)), "skipped").when(F.col("_code").isNotNull(), "failed").otherwise("success")
    rows = rows.withColumn("status", status)
    safe = govern.public_error(F.col("_message"), "provider failed")
    return rows.select(
        "query_id",
        "seq",
        "provider",
        "scope",
        "status",
        F.when(F.col("status") == "success", F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("candidate_count"),
        F.when(F.col("status") == "skipped", "adapter_unavailable").when(F.col("status") == "failed", F.when(safe["rate_limited"], "rate_limited").otherwise(F.col("_code"))).alias("code"),
        F.when(F.col("status") == "skipped", "provider is unavailable").when(F.col("status") == "failed", safe["message"]).alias("message"),
    )


def search_everywhere(queries: DataFrame, *, scopes: list[str] | None = None, local: DataFrame | None = None, results: DataFrame, states: DataFrame, specs: DataFrame | None = None, provider: str = "auto", limit: int = 8, allow_sensitive: bool = False) -> Found:
    """Search the chosen scopes for each query.

    local: candidates in the shape of `search.candidates`; results: query_id, provider, variant, idx, title, locator,
    snippet, published_at; states: query_id, provider, available, error_code, error_message; specs: pos, name, scope,
    sensitivity, source_class, isolated. `provider`: of the public ones, one by name, `all`, or `auto`: in order, up to
    the first that finds something. Raises on unknown scopes and on broken rules of sensitivity and isolation.
    """
    if limit < 1:
        raise ValueError("invalid_input: limit must be at least 1")
    wanted = merge.expand_scopes(scopes)
    mine = [] if specs is None else specs.filter(F.col("scope").isin(wanted)).orderBy("scope", "pos").collect()  # a manifest, stated by the caller
    known = {"local", "public", *(r["scope"] for r in mine)}
    if unknown := [s for s in wanted if s not in known]:
        raise ValueError(f"adapter_unavailable: unknown search scope: {unknown[0]}")
    if specs is not None and (broken := govern.scope_violations(specs, wanted, allow_sensitive=allow_sensitive).orderBy("rule", "name").head()):
        raise PermissionError(f"policy_blocked: {broken['rule']}: {broken['name']}")
    if "public" in wanted and provider not in ("auto", "all", *PUBLIC):
        raise ValueError(f"adapter_unavailable: {provider}")
    empty = F.lit(None).cast("string")
    groups, attempts = [], []
    answers = first_variant(results, ["query_id", "provider"]).filter("locator <> ''")
    bad = states.filter(~F.coalesce("available", F.lit(True)) | F.col("error_code").isNotNull()).select("query_id", "provider")
    answers = answers.join(bad, ["query_id", "provider"], "left_anti")
    order = Window.partitionBy("query_id", "provider").orderBy("idx", "locator")
    answers = answers.withColumn("idx", (F.row_number().over(order) - 1).cast("long")).filter(F.col("idx") < limit)
    counts = answers.groupBy("query_id", "provider").agg(F.count("*").alias("n"))
    seq = 0
    for scope in wanted:
        if scope == "local":
            if local is not None:
                rows = local.withColumn("published_at", empty) if "published_at" not in local.columns else local
                groups.append(rows.filter(F.col("idx") < limit).withColumn("provider_rank", (F.col("idx") + 1).cast("long")).withColumn("group_no", F.lit(seq).cast("long")))
                n = groups[-1].groupBy("query_id").agg(F.count("*").alias("n"))
                own = queries.join(n, "query_id", "left")
                attempts.append(own.select("query_id", F.lit(seq).alias("seq"), F.lit("workspace").alias("provider"), F.lit(scope).alias("scope"), F.lit("success").alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("candidate_count"), empty.alias("code"), empty.alias("message")))
            seq += 1
        elif scope == "public":
            names = PUBLIC if provider in ("auto", "all") else (provider,)
            tries = _attempted(queries, [(seq + k, p, scope) for k, p in enumerate(names)], states, counts)
            if provider == "auto":
                tries = merge.pick_provider(tries, order="seq").drop("picked")
            attempts.append(tries)
            found = answers.join(tries.select("query_id", "provider", "seq"), ["query_id", "provider"])
            merged = merge.round_robin(found.withColumn("group_no", F.col("seq").cast("long")), limit)
            merged = merged.withColumn("provider_rank", (F.col("idx") + 1).cast("long")).withColumn("idx", F.col("rank") - 1).drop("rank", "seq")
            groups.append(merged.withColumn("group_no", F.lit(seq).cast("long")).withColumns({"scope": F.lit(scope), "source_class": urls.source_class(F.col("locator")), "evidence_state": F.lit("candidate-only"), "sensitivity": F.lit("public")}))
            seq += len(names)
        else:
            own = [r for r in mine if r["scope"] == scope]
            attempts.append(_attempted(queries, [(seq + k, r["name"], scope) for k, r in enumerate(own)], states, counts))
            for r in own:
                state = "candidate-only-internal" if r["sensitivity"] == "internal" else "candidate-only"
                rows = answers.filter(F.col("provider") == r["name"]).withColumn("provider_rank", (F.col("idx") + 1).cast("long")).withColumn("group_no", F.lit(seq).cast("long"))
                groups.append(rows.withColumns({"scope": F.lit(scope), "source_class": F.lit(r["source_class"]), "evidence_state": F.lit(state), "sensitivity": F.lit(r["sensitivity"])}))
                seq += 1
    columns = ["query_id", "group_no", "idx", *SHARED]
    every = None
    for g in groups:
        every = g.select(*columns) if every is None else every.unionByName(g.select(*columns))
    tried = attempts[0] if attempts else None
    for a in attempts[1:]:
        tried = tried.unionByName(a)
    if tried is None:
        raise ValueError("adapter_unavailable: no source to search")
    merged = merge.round_robin(every, limit) if every is not None else None
    out = govern.bounded(merged.select("query_id", "rank", *SHARED))
    number = out.groupBy("query_id").agg(F.count("*").alias("found"))
    folded = tried.groupBy("query_id").agg(F.bool_or(F.col("status") == "success").alias("ok"), F.bool_or((F.col("status") == "failed") & (F.col("scope") == "public")).alias("public_failed"), F.sum(F.when(F.col("scope") == "public", F.col("candidate_count"))).alias("public_found"), F.bool_or(F.col("status") == "failed").alias("failed"))
    ends = queries.select("query_id").join(folded, "query_id", "left").join(number, "query_id", "left")
    found, ok = F.coalesce("found", F.lit(0)), F.coalesce("ok", F.lit(False))
    lost = (found == 0) & ~ok
    warnings = F.filter(F.array(F.when(F.col("public_failed") & (F.col("public_found") > 0), PARTIAL)), lambda w: w.isNotNull())
    return Found(out, tried, ends.select("query_id", F.when(lost, "failed").when(F.col("failed") & (found > 0), "partial").otherwise("success").alias("status"), F.when(lost, "search_failed").alias("error_code"), found.cast("long").alias("candidates"), F.transform(govern.bounded_warnings(warnings), lambda w: compact(w, 320)).alias("warnings")))
