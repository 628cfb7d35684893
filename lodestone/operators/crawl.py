"""Crawls as supersteps over tables: frontier, transitions, status and pacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.ids import crawl_id, page_folder
from lodestone.functions.urls import normalize, normalize_any, same_origin
from lodestone.session import cut_lineage, numbered

MOST_ATTEMPTS = 2
DONE = ("complete", "failed", "blocked")


def transition(error_code: Column, retryable: Column, attempts: Column) -> Column:
    """Status of a page after a try: complete, pending again, blocked or failed."""
    return F.when(error_code.isNull(), "complete").when(retryable & (attempts < MOST_ATTEMPTS), "pending").when(error_code == "policy_blocked", "blocked").otherwise("failed")


def status_counts(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Pages of each status, and those processed, for each crawl."""
    status = F.when(F.col("status") == "running", "pending").otherwise(F.col("status"))
    counts = [F.count_if(status == s).alias(s) for s in ("complete", "failed", "blocked", "pending")]
    return pages.groupBy(*keys).agg(*counts).withColumn("processed", F.col("complete") + F.col("failed") + F.col("blocked"))


def crawl_status(counts: DataFrame, max_pages: Column) -> DataFrame:
    """Status of each crawl from its counts."""
    done = F.when(F.col("pending") > 0, F.when(F.col("processed") >= max_pages, "partial").otherwise("running"))
    done = done.when((F.col("complete") > 0) & ((F.col("failed") > 0) | (F.col("blocked") > 0)), "partial").when(F.col("complete") > 0, "complete").otherwise("failed")
    return counts.withColumn("crawl_status", done)


def summary_line(counts: DataFrame) -> DataFrame:
    """One line for each crawl: its status, and the pages completed of all."""
    total = F.col("processed") + F.col("pending")
    return counts.withColumn("summary", F.concat_ws(" ", "crawl_status", F.concat(F.col("complete").cast("string"), F.lit("/"), total.cast("string"))))


def failures_by_code(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Pages by error code; those that wait for another try count too."""
    return pages.filter("error_code is not null").groupBy(*keys, "error_code").agg(F.count("*").alias("pages"))


def recover(pages: DataFrame) -> DataFrame:
    """State from which an interrupted crawl goes on: running pages wait again."""
    return pages.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


def pacing(requests: DataFrame, min_interval: float = 1.0, *, host: str = "host", at: str = "at") -> DataFrame:
    """How long each request of a host waits, so that the one before went out an interval earlier. `at`, and the wait, in
    the interval's unit. A request goes out at s(i) = max(at(i), s(i-1) + d), which is i * d + max over k <= i of at(k) - k * d."""
    order = Window.partitionBy(host).orderBy(at, *[c for c in requests.columns if c not in (host, at)])
    shift = F.row_number().over(order) * F.lit(float(min_interval))
    rows = requests.withColumn("_shift", shift).withColumn("_free", F.col(at) - F.col("_shift"))
    latest = F.max("_free").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("wait", F.greatest(F.lit(0.0), (latest - F.col("_free")).cast("double"))).drop("_shift", "_free")


def job(spark: SparkSession, root: str, reader: str, policy, created_at: str) -> DataFrame:
    """The one row that a new crawl is known by: crawl_id, root_url, reader, policy_sha256, created_at, max_pages, max_depth."""
    if (url := normalize_any(root)) is None:
        raise ValueError(f"invalid_input: not a URL to crawl: {root}")
    row = spark.createDataFrame([(url, reader, policy.digest(), created_at, policy.max_pages, policy.max_depth)], "root_url string, reader string, policy_sha256 string, created_at string, max_pages int, max_depth int")
    return row.select(crawl_id(F.col("root_url"), F.col("created_at")).alias("crawl_id"), "*")


def resumed(earlier: DataFrame, pages: DataFrame, root: str, reader: str, policy) -> DataFrame:
    """The state from which a crawl goes on, if it is the same one: its root, reader and policy must match its job's row."""
    was = earlier.first()
    if was is None:
        raise ValueError("invalid_input: no crawl state to resume")
    for name, there, here in (("root URL", was["root_url"], normalize_any(root)), ("reader", was["reader"], reader), ("policy", was["policy_sha256"], policy.digest())):
        if there != here:
            raise ValueError(f"invalid_input: resume {name} does not match existing crawl")
    return recover(pages)


def receipt(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """One receipt for each job: its row, status, counts, failures_by_code and its pages by depth and order, at most max_pages
    of which the policy's bound is 1,000. pages: crawl_id, url, depth, status, bundle_path, error_code, added_seq."""
    counts = status_counts(pages, ["crawl_id"])
    codes = failures_by_code(pages, ["crawl_id"]).groupBy("crawl_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_code", "pages")))).alias("failures_by_code"))
    shown = recover(pages).groupBy("crawl_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "added_seq", F.struct("url", "depth", "status", "bundle_path", "error_code").alias("page")))), lambda x: x["page"]).alias("pages"))
    rows = jobs.join(counts, "crawl_id", "left").join(codes, "crawl_id", "left").join(shown, "crawl_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("complete", "failed", "blocked", "pending", "processed")})
    rows = crawl_status(rows, F.col("max_pages"))
    return rows.withColumn("failures_by_code", F.coalesce("failures_by_code", F.create_map().cast("map<string,bigint>"))).withColumnRenamed("crawl_status", "status")


def crawl(root: str, links: DataFrame, results: DataFrame, *, max_pages: int = 20, max_depth: int = 1, state: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """Breadth-first crawl of recorded pages: url, depth, status, discovered_from, attempts, bundle_path, error_code, added_seq.

    links: url, pos, target; results: url, attempt (from 1), error_code (null: success), retryable. A superstep takes
    all waiting pages of one depth in the order in which they were found, up to what is left of the budget, tries them,
    and adds the targets of same origin that no page has yet. State is cut off each superstep. `state`: that of an
    interrupted crawl, as `resumed` gives it; `held`: urls of valid bundles, whose pages are complete without a try.
    """
    spark = links.sparkSession
    columns = ["url", "depth", "status", "discovered_from", "attempts", "bundle_path", "error_code", "added_seq"]
    null = F.lit(None).cast("string")
    if state is None:
        state = spark.range(1).select(normalize(F.lit(root)).alias("url"), F.lit(0).alias("depth"), F.lit("pending").alias("status"), null.alias("discovered_from"), F.lit(0).alias("attempts"), null.alias("bundle_path"), null.alias("error_code"), F.lit(0).cast("long").alias("added_seq")).filter("url is not null")
    state = cut_lineage(state.select(columns))
    edges = links.select(normalize(F.col("url")).alias("source"), "pos", normalize(F.col("target")).alias("target"), same_origin(F.col("target"), F.lit(root)).alias("same")).filter("target is not null and same")
    edges = cut_lineage(edges.drop("same"))
    results = cut_lineage(results.select(normalize(F.col("url")).alias("url"), F.col("attempt").cast("int").alias("attempt"), F.col("error_code").alias("new_error"), "retryable", F.lit(True).alias("known")))
    there = cut_lineage((held.select(normalize(F.col("url")).alias("url")) if held is not None else state.select("url").limit(0)).distinct().withColumn("held", F.lit(True)))
    for depth in range(max_depth + 1):
        # a waiting page keeps its turn: tried again at once, it ends before the next depth begins
        while True:
            used = state.filter(F.col("status").isin(*DONE)).count()
            if used >= max_pages:
                break
            waiting = state.filter((F.col("status") == "pending") & (F.col("depth") == depth)).orderBy("added_seq").limit(max_pages - used).select("url", (F.col("attempts") + 1).alias("attempt"))
            tried = waiting.join(results, ["url", "attempt"], "left").join(there, "url", "left")
            error = F.when(F.col("held"), null).when(F.col("known").isNull(), "fetch_failed").otherwise(F.col("new_error"))
            tried = tried.select("url", (F.col("attempt") - F.when(F.col("held"), 1).otherwise(0)).alias("attempt"), error.alias("new_error"), transition(error, F.coalesce("retryable", F.lit(False)), F.col("attempt")).alias("new_status"))
            done = F.col("new_status") == "complete"
            state = state.join(tried, "url", "left").withColumn("bundle_path", F.when(done, F.concat(F.lit("pages/"), page_folder(F.col("url")))).otherwise(F.col("bundle_path")))
            state = cut_lineage(state.select("url", "depth", F.coalesce("new_status", "status").alias("status"), "discovered_from", F.coalesce("attempt", "attempts").alias("attempts"), "bundle_path", F.when(F.col("new_status").isNotNull(), F.col("new_error")).otherwise(F.col("error_code")).alias("error_code"), "added_seq"))
            if state.filter((F.col("status") == "pending") & (F.col("depth") == depth)).isEmpty():
                break
        if depth == max_depth:
            break
        last = state.agg(F.max("added_seq")).first()[0] or 0
        found = state.filter((F.col("status") == "complete") & (F.col("depth") == depth)).select(F.col("url").alias("source"), "added_seq").join(edges, "source")
        first = found.groupBy("target").agg(F.min(F.struct("added_seq", "pos", "source")).alias("by")).join(state.select(F.col("url").alias("target")), "target", "left_anti")
        first = numbered(first, ["by.added_seq", "by.pos", "target"], "place")
        new = first.select(F.col("target").alias("url"), F.lit(depth + 1).alias("depth"), F.lit("pending").alias("status"), F.col("by.source").alias("discovered_from"), F.lit(0).alias("attempts"), null.alias("bundle_path"), null.alias("error_code"), (F.lit(last) + F.col("place")).alias("added_seq"))
        state = cut_lineage(state.unionByName(new))
    return state
