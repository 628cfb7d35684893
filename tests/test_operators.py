import hashlib
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import anchors, crawl, documents, merge, search, verify


def test_search_exact_then_relaxed(spark):
    files = spark.createDataFrame([("a/x.txt", "Alpha Beta gamma\nbeta only\n"), ("b.txt", "only gamma\nAlpha"), ("alpha.txt", "none\ngamma here"), ("c.txt", None)], "path string, text string")
    queries = spark.createDataFrame([(1, "alpha  beta"), (2, "gamma alpha zeta"), (3, "absent"), (4, " ")], "query_id long, query string")
    got = search.search(files, queries, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.locator, r.relevance_score, r.query_relaxed) for r in got] == [
        (1, "a/x.txt:1", 124.0, False),
        (2, "a/x.txt:1", 24.0, True),
        (2, "b.txt:1", 22.0, True),
        (2, "alpha.txt:2", 15.0, True),
    ]
    assert got[1].matched_terms == "gamma alpha" and got[1].term_coverage == 0.667 and got[1].query_variant == "gamma|alpha|zeta"
    smart = search.search(files, spark.createDataFrame([(1, "Beta gamma")], "query_id long, query string"), 5, case_mode="smart", relaxed=False).collect()
    assert [r.locator for r in smart] == ["a/x.txt:1"]
    loose = lambda q: sorted(r.path for r in search.search(files, spark.createDataFrame([(1, q)], "query_id long, query string"), 5, case_mode="smart").collect())
    assert loose("Alpha Zeta") == ["a/x.txt", "b.txt"] and loose("alpha zeta") == ["a/x.txt", "b.txt"] and loose("ALPHA zeta") == []


def loop_search(files, queries, limit):
    """The plain loop over pairs."""
    from lodestone.functions.query import LOW_SIGNAL, STOPWORDS

    out = []
    for qid, raw in queries:
        q = " ".join(raw.split())
        found = [t for t in re.findall(r"[\w@.-]+", q) if len(t) > 1 and t.casefold() not in STOPWORDS]
        tokens = list(dict.fromkeys(found))[:12]
        weigh = lambda text: sum(0.25 if t.casefold() in LOW_SIGNAL else 1.0 for t in tokens if t.casefold() in text)
        for variant in (False, True):
            rows = []
            for path, text in files:
                every = [(k, x.strip()) for k, x in enumerate(text.splitlines(), 1)]
                if variant:
                    hits = [h for h in every if len(tokens) > 1 and any(t.casefold() in h[1].casefold() for t in tokens)][:8]
                else:
                    hits = [h for h in every if q and q.casefold() in h[1].casefold()][:8]
                if hits:
                    joined = " ".join(x.casefold() for _, x in hits)
                    best = min((-weigh(x.casefold()), k) for k, x in hits)
                    mine = [t for t in tokens if t.casefold() in joined]
                    total = weigh(joined) * 10 - best[0] * 2 + 3 * sum(t.casefold() in path.casefold() for t in tokens) + 100 * (q.casefold() in joined)
                    rows.append((-round(total, 2), path, best[1], " ".join(mine), len(hits), variant))
            if rows:
                out += [(qid, k, path, line, -s, terms, n, v) for k, (s, path, line, terms, n, v) in enumerate(sorted(rows)[:limit], 1)]
                break
    return sorted(out)


@pytest.mark.parametrize("scanned", [0, 24])
def test_search_is_the_loop_over_pairs(spark, monkeypatch, scanned):
    monkeypatch.setattr(search, "SCANNED", scanned)
    r = random.Random(12)
    words = "ab abc bcd Straße STRASSE ΟΔΟΣ οδος ﬁn code search xx.y a-b 漢字 漢字仮名 ! -- É".split()
    files = [(f"{r.choice(words)}/{i}.txt", "\n".join(" ".join(r.choice(words) for _ in range(r.randrange(6))) for _ in range(r.randrange(14)))) for i in range(40)]
    queries = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 5)))) for i in range(60)] + [(90, "!"), (91, ""), (92, "--  !"), (93, "ab " * 20)]
    got = search.search(spark.createDataFrame(files, "path string, text string"), spark.createDataFrame(queries, "query_id long, query string"), 4).collect()
    assert sorted((x.query_id, x["rank"], x.path, x.line_no, x.relevance_score, x.matched_terms, x.matched_line_count, x.query_relaxed) for x in got) == loop_search(files, queries, 4)


def test_search_of_few_and_of_many_queries_give_the_same(spark, monkeypatch):
    r = random.Random(5)
    words = "ab abc bcd Straße STRASSE ΟΔΟΣ οδος ﬁn code Code search xx.y a-b 漢字 漢字仮名 ! -- É Ab".split() + ["q" * 70, "b" * 9000]
    files = [(f"{r.choice(words[:-2])}/{i}.txt", r.choice(["\n", "\r\n", "\u2028"]).join(" ".join(r.choice(words) for _ in range(r.randrange(6))) for _ in range(r.randrange(40)))) for i in range(60)]
    queries = [(i, " ".join(r.choice(words[:-1]) for _ in range(r.randrange(1, 6)))) for i in range(40)] + [(90, "!"), (91, ""), (92, "--  !"), (93, "ab " * 20), (94, "Ab code"), (95, "qq bb"), (96, "Code! É")]
    files, queries = spark.createDataFrame(files, "path string, text string"), spark.createDataFrame(queries, "query_id long, query string")
    for case_mode, relaxed in (("fold", None), ("smart", None), ("smart", True), ("fold", False)):
        both = []
        for most in (4096, 0):
            monkeypatch.setattr(search, "SCANNED_QUERIES", most)
            both.append(sorted(map(str, search.search(files, queries, 3, case_mode=case_mode, relaxed=relaxed).collect())))
        assert both[0] == both[1] and len(both[0]) > 20


def test_search_passes_on_the_best_files_of_a_task_alone():
    import pyarrow as pa

    from lodestone.operators.line_scan import scanner

    plans = [{"query_id": i, "query": f"ab cd y{i}", "folded": f"ab cd y{i}", "tokens": ["ab", "cd", f"y{i}"], "terms": [{"term": t, "weight": 1.0} for t in ("ab", "cd", f"y{i}")], "plain": True, "written": None} for i in range(50)]
    kinds = {"query_id": pa.int64(), "path": pa.string(), "relaxed": pa.bool_(), "total": pa.float64(), "line_no": pa.int64(), "line": pa.string(), "weight": pa.float64(), "matched_terms": pa.string(), "n_found": pa.int64(), "matched_line_count": pa.int64()}
    files = pa.RecordBatch.from_pylist([{"path": f"{i:03}", "name": f"{i:03}", "lines": ["Ab cd"], "folded": ["ab cd"]} for i in range(400)])
    out = list(scanner(plans, 2, 8, None, None, pa.schema(kinds.items()))(iter([files])))
    assert sorted((r["query_id"], r["path"]) for b in out for r in b.to_pylist()) == [(i, p) for i in range(50) for p in ("000", "001")]


def test_scans_in_small_blocks_give_the_same(monkeypatch):
    import pyarrow as pa

    from lodestone.operators import line_scan

    r = random.Random(6)
    words = "ab abc bcd cd da x yy zz abcd".split()
    plans = [{"query_id": i, "query": (q := " ".join(t)), "folded": q, "tokens": t, "terms": [{"term": x, "weight": r.choice([0.25, 1.0])} for x in t], "plain": i % 3 > 0, "written": t[:2] if i % 4 == 0 else None} for i, t in enumerate([list(dict.fromkeys(r.choice(words) for _ in range(r.randrange(1, 4)))) for _ in range(30)])]
    lines = [[" ".join(r.choice(words) for _ in range(r.randrange(5))) for _ in range(r.randrange(60))] for _ in range(50)]
    files = pa.RecordBatch.from_pylist([{"path": f"{i:03}", "name": f"ab{i:03}", "lines": v, "folded": v} for i, v in enumerate(lines)])
    kinds = {"query_id": pa.int64(), "path": pa.string(), "relaxed": pa.bool_(), "total": pa.float64(), "line_no": pa.int64(), "line": pa.string(), "weight": pa.float64(), "matched_terms": pa.string(), "n_found": pa.int64(), "matched_line_count": pa.int64()}
    scan = lambda: sorted(str(x) for b in line_scan.scanner(plans, 3, 8, 6, None, pa.schema(kinds.items()))(iter([files])) for x in b.to_pylist())
    whole = scan()
    for name, value in (("LINES", 7), ("QUERIES", 4), ("KEPT_BYTES", 2000), ("KEPT_WORD", 2)):
        monkeypatch.setattr(line_scan, name, value)
        assert scan() == whole and len(whole) > 100


def test_search_plan_has_no_nested_loop(spark):
    files = spark.createDataFrame([("a", "x yy zz")], "path string, text string")
    plan = search.search(files, spark.createDataFrame([(1, "yy zz")], "query_id long, query string"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_search_counts_eight_lines_of_a_file(spark):
    files = spark.createDataFrame([("f", "\n".join(["zz aa"] * 9 + ["bb"]))], "path string, text string")
    r = search.search(files, spark.createDataFrame([(1, "aa bb")], "query_id long, query string"), 5).first()
    assert (r.matched_line_count, r.matched_terms, r.line_no) == (8, "aa", 1)


def loop_merge(groups, limit):
    seen, out = set(), []
    for i in range(max(map(len, groups), default=0)):
        for g, group in enumerate(groups):
            if i < len(group) and len(out) < limit and group[i].rstrip("/") not in seen:
                seen.add(group[i].rstrip("/"))
                out.append((g, i))
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "a/", "b", "c//", "d", "e"]), max_size=6), min_size=1, max_size=4), st.integers(1, 8))
def test_merge_is_the_loop(spark, groups, limit):
    rows = [(1, g, i, x) for g, group in enumerate(groups) for i, x in enumerate(group)]
    df = spark.createDataFrame(rows, "query_id long, group_no long, idx long, locator string")
    got = merge.round_robin(df, limit).orderBy("rank").collect()
    assert [(r.group_no, r.idx) for r in got] == loop_merge(groups, limit)


def test_scopes_and_provider_choice(spark):
    assert merge.expand_scopes(None) == ["local"] and merge.expand_scopes(["auto"]) == ["local", "public"]
    with pytest.raises(ValueError):
        merge.expand_scopes(["auto", "x"])
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 3), (1, 2, 5), (2, 0, 0)], "query_id long, provider_no int, candidate_count long")
    assert sorted(tuple(r) for r in merge.pick_provider(df).select("query_id", "provider_no", "picked").collect()) == [(1, 0, False), (1, 1, True), (2, 0, False)]


MARKDOWN = ["# A\ntext\nmore\n\n- x\n* y\n1. z\ncont\n| a |\n| b |\n## B\n\n\nlast\n", "", "\n \n", "#no\n####### seven\n"]


def test_native_anchors_are_the_sequential_ones(spark):
    r = random.Random(1)
    docs = MARKDOWN + ["\n".join(r.choice(["# h", "text", "", "  ", "- i", "| t", "9) n", "#x"]) for _ in range(30)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, markdown string")
    a, b = anchors.anchors(df, ["id"]), anchors.fenced_anchors(df, ["id"])
    order = ["id", "pos", "anchor_id", "kind", "heading", "line_start", "line_end", "sha256", "preview"]
    assert a.select(order).orderBy("id", "pos").collect() == b.select(order).orderBy("id", "pos").collect()
    assert anchors.anchor_mismatches(df, a, ["id"]).isEmpty()
    bad = a.withColumn("line_end", F.when(F.col("pos") == 0, F.col("line_end") + 1000).otherwise(F.col("line_end"))).withColumn("sha256", F.when(F.col("pos") == 1, "x").otherwise(F.col("sha256")))
    assert {r.failure for r in anchors.anchor_mismatches(df, bad, ["id"]).collect()} == {"anchor range invalid", "anchor sha256 mismatch"}


def test_fences():
    got = anchors.cut_blocks("a\n```py\n# no heading\n```\nb\n~~~\nopen")
    assert [(k, s, e) for k, _, s, e, _, _ in got] == [("paragraph", 1, 1), ("code", 2, 4), ("paragraph", 5, 5), ("code", 6, 7)]


def test_html(spark):
    page = "<html><head><title> T &amp; t </title><script>no()</script></head><body><nav><a href='/n'>nav</a></nav><main><h2>Over<b>view</b></h2><p>Text " + "long " * 40 + "<p>second<ul><li>one<li>two</ul><a href='x?a=1'>go</a><a href='x?a=1'>go</a><a href='mailto:z'>m</a></main></body></html>"
    d = documents.convert(page, "https://h.example/d/e")
    assert d["title"] == "T & t" and "## Over**view**" in d["markdown"] and "no()" not in d["markdown"] and "- one\n- two" in d["markdown"]
    assert d["links"] == [{"text": "go", "url": "https://h.example/d/x?a=1"}]
    assert {"text": "nav", "url": "https://h.example/n"} in documents.convert(page, "https://h.example/d/e", "document")["links"]
    assert documents.convert("", "")["markdown"] == ""
    assert documents.convert("<b>deep " * 5000, "")["markdown"].count("deep") == 5000
    df = spark.createDataFrame([(1, page, "https://h.example/"), (2, None, None)], "id long, html string, url string")
    got = {r.id: r for r in documents.html_markdown(df, ["id"]).collect()}
    assert got[1].n_links == 1 and got[2].markdown == ""


def test_json_and_routes(spark):
    df = spark.createDataFrame([('{"b":1,"a":[2]}',), ("no",)], "x string")
    assert [r.y for r in df.select(documents.json_markdown("x").alias("y")).collect()] == ['```json\n{\n  "a": [\n    2\n  ],\n  "b": 1\n}\n```\n', "```json\nno\n```\n"]
    assert documents.reader_route("auto", allow_remote=True) == ["direct", "jina"] and documents.reader_route("jina") == ["jina"]
    with pytest.raises(ValueError):
        documents.reader_route("other")
    codes = spark.createDataFrame([(200,), (429,), (503,), (404,)], "c int")
    assert [r.y for r in codes.select(documents.http_outcome(F.col("c")).alias("y")).collect()] == ["success", "retryable", "retryable", "failed"]


def queue_crawl(links, fails, pages, depth_limit):
    state, order, seq = {"https://s/0": [0, "pending", 0, 0]}, [], 1
    while sum(s[1] in crawl.DONE for s in state.values()) < pages:
        waiting = sorted((s[0], s[3], u) for u, s in state.items() if s[1] == "pending")
        if not waiting:
            break
        depth, _, u = waiting[0]
        s = state[u]
        s[2] += 1
        if fails.get(u, 0) >= s[2]:
            s[1] = "pending" if s[2] < crawl.MOST_ATTEMPTS else "failed"
            continue
        s[1] = "complete"
        order.append(u)
        if depth < depth_limit:
            for v in links.get(u, []):
                if v.startswith("https://s/") and v not in state:
                    state[v] = [depth + 1, "pending", 0, seq]
                    seq += 1
    return {u: (s[0], s[1], s[2]) for u, s in state.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_crawl_is_the_queue(spark, seed):
    r = random.Random(seed)
    n, budget = 14, 7 + seed
    links = {f"https://s/{i}": [f"https://{r.choice('sso')}/{r.randrange(n)}" for _ in range(3)] for i in range(n)}
    fails = {f"https://s/{i}": r.choice([0, 0, 1, 2]) for i in range(1, n)}
    rows = [(u, k, v) for u, out in links.items() for k, v in enumerate(out)]
    results = [(u, a, "fetch_failed" if fails.get(u, 0) >= a else None, True) for u in links for a in (1, 2)]
    got = crawl.crawl("https://s/0", spark.createDataFrame(rows, "url string, pos int, target string"), spark.createDataFrame(results, "url string, attempt int, error_code string, retryable boolean"), max_pages=budget, max_depth=3).collect()
    assert {x.url: (x.depth, x.status, x.attempts) for x in got} == queue_crawl(links, fails, budget, 3)


@pytest.mark.parametrize("budget", [60, 1000])
def test_deep_and_wide_crawl_is_the_queue(spark, budget):
    n = 400
    links = {f"https://s/{i}": [f"https://s/{(i + 1) % n}", f"https://s/{(i * 7 + 3) % n}", f"https://o/{i}"] for i in range(n)}
    fails = {f"https://s/{i}": 2 for i in range(4, n, 5)}
    rows = [(u, k, v) for u, out in links.items() for k, v in enumerate(out)]
    results = [(u, a, "fetch_failed" if fails.get(u, 0) >= a else None, True) for u in links for a in (1, 2)]
    got = crawl.crawl("https://s/0", spark.createDataFrame(rows, "url string, pos int, target string"), spark.createDataFrame(results, "url string, attempt int, error_code string, retryable boolean"), max_pages=budget, max_depth=10).collect()
    want = queue_crawl(links, fails, budget, 10)
    assert {x.url: (x.depth, x.status, x.attempts) for x in got} == want
    assert max(d for d, _, _ in want.values()) > 4 and any(s == "pending" for _, s, _ in want.values()) == (budget == 60)


def test_pacing_and_recovery(spark):
    df = spark.createDataFrame([("h", 0.0), ("h", 0.25), ("h", 5.0), ("g", 0.1)], "host string, at double")
    burst = spark.createDataFrame([("h", 0.0, i) for i in range(4)] + [("h", 3.5, 4), ("h", 9.0, 5)], "host string, at double, n int")
    assert sorted((r.n, r.wait) for r in crawl.pacing(burst).collect()) == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 3.0), (4, 0.5), (5, 0.0)]
    assert sorted((r.host, r.at, r.wait) for r in crawl.pacing(df).collect()) == [("g", 0.1, 0.0), ("h", 0.0, 0.0), ("h", 0.25, 0.75), ("h", 5.0, 0.0)]
    assert crawl.recover(spark.createDataFrame([("running",), ("failed",)], "status string")).collect()[0].status == "pending"


def test_crawl_verification(spark):
    schema = "crawl_id long, url string, depth int, status string, bundle_path string, error_code string"
    good = [(1, "u", 0, "complete", "p", None), (1, "v", 1, "failed", None, "fetch_failed")]
    stated = spark.createDataFrame([(1, "partial", 20, 1)], "crawl_id long, status string, max_pages int, max_depth int")
    pages = spark.createDataFrame(good, schema)
    assert verify.crawl_violations(stated, pages, pages).isEmpty()
    bad = spark.createDataFrame([(1, "u", 3, "complete", None, None), (1, "u", 3, "complete", None, None)], schema)
    assert {r.failure for r in verify.crawl_violations(stated, pages, bad).collect()} == {"duplicate URL", "page exceeds max_depth", "complete page lacks bundle_path", "crawl status mismatch", "page projection mismatch"}
    codes = spark.createDataFrame([(1, "fetch_failed", 2)], "crawl_id long, error_code string, n long")
    assert verify.code_violations(codes, pages).count() == 1


def test_layout_and_summary(spark):
    receipts = spark.createDataFrame([(1, "complete"), (2, "complete"), (3, "partial")], "id long, status string")
    artifacts = spark.createDataFrame([(1, "raw", "raw.html"), (1, "normalized", "n"), (1, "anchors", "a"), (1, "links", "l"), (2, "raw", "x.html"), (2, "raw", "raw.md"), (2, "links", "l"), (3, "raw", "raw.txt")], "id long, role string, path string")
    bad = verify.layout_violations(receipts, artifacts, ["id"])
    got = {r.id: (r.valid, r.failures) for r in verify.summary(receipts, bad, ["id"]).collect()}
    assert got[1] == (True, []) and got[3] == (True, []) and len(got[2][1]) == 5


def test_small_rules(spark):
    df = spark.createDataFrame([("a/b.HTM",), ("c.json",), ("d.yml",), ("e.pdf",), ("none",)], "p string")
    assert [r.k for r in df.select(documents.normalizer_by_suffix(F.col("p")).alias("k")).collect()] == ["html", "json", "text", "external", "external"]
    tries = spark.createDataFrame([(1, "skipped", True, True), (1, "failed", True, False), (2, "skipped", True, True)], "id long, status string, remote boolean, authenticated boolean")
    assert sorted(tuple(r) for r in documents.used_flags(tries, ["id"]).collect()) == [(1, True, False), (2, False, False)]
    pages = spark.createDataFrame([(1, "u", "complete", "p"), (1, "v", "complete", "q"), (1, "w", "complete", "r"), (1, "x", "failed", None)], "crawl_id long, url string, status string, bundle_path string")
    receipts = spark.createDataFrame([("p", "u"), ("q", "z")], "bundle_path string, requested_url string")
    assert sorted((r.url, r.failure) for r in verify.page_bundle_violations(pages, receipts).collect()) == [("v", "page URL does not match bundle"), ("w", "missing bundle")]
    assert verify.target_kind({"receipt.json", "crawl-receipt.json"}) == "bundle"
    counts = crawl.crawl_status(crawl.status_counts(pages, ["crawl_id"]), F.lit(20))
    assert crawl.summary_line(counts).first().summary == "partial 3/4"
    with pytest.raises(ValueError):
        merge.check_adapters({"exa": None}, 1, ("exa",))


def test_paths_flags_and_source_of_a_bundle(spark):
    body = b"raw bytes"
    sha = hashlib.sha256(body).hexdigest()
    stated = spark.createDataFrame([(1, "raw", "raw.html"), (1, "links", "links.json"), (2, "raw", "raw.html"), (2, "links", "l.json"), (3, "raw", "raw.a"), (3, "raw", "raw.b"), (4, "raw", "raw.html")], "id int, role string, path string")
    there = spark.createDataFrame([(1, "raw.html", body), (2, "raw.html", body), (3, "raw.a", body), (3, "raw.b", body)], "id int, path string, body binary")
    receipts = spark.createDataFrame([(1, ["direct"], False, False, 9, sha), (2, ["jina"], False, True, 8, "0"), (3, ["firecrawl"], True, True, 1, "0"), (4, ["direct"], False, True, 1, "0")], "id int, route array<string>, remote_adapter_used boolean, authenticated_adapter_used boolean, source_bytes long, source_sha256 string")
    attempts = spark.createDataFrame([(1, "skipped", True, True), (4, "failed", True, True)], "id int, status string, remote_adapter boolean, authenticated_adapter boolean")
    found = lambda df: sorted((r.id, r.failure) for r in df.collect())
    assert found(verify.path_violations(stated, ["id"])) == [(2, "unexpected links artifact path: l.json")]
    remote, authenticated = (f"{x} adapter policy flag does not match route" for x in ("remote", "authenticated"))
    assert found(verify.flag_violations(receipts, attempts, ["id"])) == [(2, authenticated), (2, remote), (4, remote)]
    assert found(verify.source_violations(receipts, stated, there, ["id"])) == [(2, "source byte count does not match raw artifact"), (2, "source sha256 does not match raw artifact")]
