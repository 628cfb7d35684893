import pytest
from pyspark.sql import functions as F

from lodestone.functions.govern import safe_json
from lodestone.operators import crawl, unified
from lodestone.plans.policy import Policy

RESULTS = "query_id long, provider string, variant int, idx long, title string, locator string, snippet string, published_at string"
STATES = "query_id long, provider string, available boolean, error_code string, error_message string"
SPECS = "pos int, name string, scope string, sensitivity string, source_class string, isolated boolean"


def run(spark, results, states=(), specs=(), **options):
    queries = spark.createDataFrame([(1,)], "query_id long")
    rows = [(1, p, v, i, f"t{u}", u, "s " * 900, None) for p, v, i, u in results]
    return unified.search_everywhere(queries, results=spark.createDataFrame(rows, RESULTS), states=spark.createDataFrame([(1, *s) for s in states], STATES), specs=spark.createDataFrame(list(specs), SPECS), **options)


def listed(found):
    return [(r.provider, r.locator, r.provider_rank) for r in found.candidates.orderBy("rank").collect()]


def test_public_providers(spark):
    both = [("exa", 0, 0, "https://docs.python.org/1"), ("exa", 0, 1, "https://x/2"), ("github", 0, 0, "https://github.com/a"), ("github", 0, 1, "https://x/2/")]
    every = run(spark, both, scopes=["public"], provider="all", limit=4)
    assert listed(every) == [("exa", "https://docs.python.org/1", 1), ("github", "https://github.com/a", 1), ("exa", "https://x/2", 2)]
    assert [r.source_class for r in every.candidates.orderBy("rank").collect()] == ["official-candidate", "open-source-candidate", "web-candidate"]
    assert every.candidates.first().snippet.endswith("[truncated]")
    auto = run(spark, both, scopes=["public"])
    assert {p for p, _, _ in listed(auto)} == {"exa"} and [r.provider for r in auto.attempts.collect()] == ["exa"]
    failed = run(spark, both, [("exa", True, "fetch_failed", "HTTP 429 from https://s/?exaApiKey=abc")], scopes=["public"])
    assert {p for p, _, _ in listed(failed)} == {"github"}
    assert [(r.status, r.code, r.candidate_count) for r in failed.attempts.orderBy("seq").collect()] == [("failed", "rate_limited", 0), ("success", None, 2)]
    out = failed.outcomes.first()
    assert (out.status, out.warnings) == ("partial", [unified.PARTIAL])
    named = run(spark, both, scopes=["public"], provider="github")
    assert {p for p, _, _ in listed(named)} == {"github"}


def test_the_relaxed_request_counts_only_without_an_answer_to_the_first(spark):
    rows = [("exa", 0, 0, "https://a"), ("exa", 1, 0, "https://b"), ("github", 1, 0, "https://c")]
    assert [u for _, u, _ in listed(run(spark, rows, scopes=["public"], provider="all"))] == ["https://a", "https://c"]


def test_command_providers_and_their_rules(spark):
    specs = [(0, "papers", "research", "account-visible", "paper", False), (1, "notes", "research", "public", "note", False), (2, "vault", "internal", "internal", "vault", True)]
    rows = [("papers", 0, 0, "p:1"), ("papers", 0, 1, "p:2"), ("notes", 0, 0, "n:1"), ("vault", 0, 0, "v:1")]
    with pytest.raises(PermissionError, match="consent"):
        run(spark, rows, specs=specs, scopes=["research"])
    got = run(spark, rows, specs=specs, scopes=["research"], allow_sensitive=True, limit=2)
    assert listed(got) == [("papers", "p:1", 1), ("notes", "n:1", 1)]
    with pytest.raises(PermissionError, match="only scope"):
        run(spark, rows, specs=specs, scopes=["internal", "research"], allow_sensitive=True)
    alone = run(spark, rows, specs=specs, scopes=["internal"], allow_sensitive=True).candidates.first()
    assert (alone.evidence_state, alone.sensitivity, alone.source_class) == ("candidate-only-internal", "internal", "vault")
    with pytest.raises(ValueError, match="unknown search scope: x"):
        run(spark, rows, specs=specs, scopes=["x"])
    lost = run(spark, rows, [("papers", False, None, None), ("notes", True, "provider_protocol_error", "bad")], specs, scopes=["research"], allow_sensitive=True)
    assert lost.outcomes.first().error_code == "search_failed" and sorted(r.status for r in lost.attempts.collect()) == ["failed", "skipped"]


def test_nested_metadata_in_batches(spark):
    df = spark.createDataFrame([('{"citations": 12, "api_token": "x", "a": {"b": {"c": 1}}}',), ("[1]",), ("no",), (None,)], "x string")
    assert [r.y for r in df.select(safe_json("x").alias("y")).collect()] == ['{"a": {"b": {"c": "1"}}, "citations": 12}', None, None, None]


def test_a_crawl_is_resumed_and_reuses_bundles(spark):
    links = spark.createDataFrame([("https://s/0", k, f"https://s/{k + 1}") for k in range(4)], "url string, pos int, target string")
    results = spark.createDataFrame([(f"https://s/{k}", a, "fetch_failed" if k == 3 else None, True) for k in range(5) for a in (1, 2)], "url string, attempt int, error_code string, retryable boolean")
    policy = Policy(max_pages=10, max_depth=1)
    job = crawl.job(spark, "https://S/0", "auto", policy, "2024-01-01T00:00:00Z")
    part = crawl.crawl("https://s/0", links, results, max_pages=2, max_depth=1)
    first = {r.url: r for r in part.collect()}
    assert [first[f"https://s/{k}"].status for k in range(5)] == ["complete", "complete", "pending", "pending", "pending"] and first["https://s/0"].bundle_path.startswith("pages/")
    stopped = part.withColumn("status", F.when(F.col("url") == "https://s/2", "running").otherwise(F.col("status")))
    state = crawl.resumed(job, stopped, "https://s/0", "auto", policy)
    held = spark.createDataFrame([("https://s/4",)], "url string")
    whole = crawl.crawl("https://s/0", links, results, max_pages=10, max_depth=1, state=state, held=held)
    got = {r.url: (r.status, r.attempts, r.error_code) for r in whole.collect()}
    assert got == {"https://s/0": ("complete", 1, None), "https://s/1": ("complete", 1, None), "https://s/2": ("complete", 1, None), "https://s/3": ("failed", 2, "fetch_failed"), "https://s/4": ("complete", 0, None)}
    for root, reader, own, message in (("https://s/1", "auto", policy, "root URL"), ("https://s/0", "jina", policy, "reader"), ("https://s/0", "auto", Policy(), "policy")):
        with pytest.raises(ValueError, match=message):
            crawl.resumed(job, part, root, reader, own)
    told = crawl.receipt(job, whole.crossJoin(job.select("crawl_id"))).first()
    assert told.status == "partial" and told.failures_by_code == {"fetch_failed": 1} and [p.url for p in told.pages][0] == "https://s/0" and len(told.pages) == 5
    assert crawl.receipt(job, whole.limit(0).crossJoin(job.select("crawl_id"))).first().status == "failed"
    with pytest.raises(ValueError):
        crawl.job(spark, "ftp://x", "auto", policy, "t")
