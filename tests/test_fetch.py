import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.functions import urls
from lodestone.operators import fetch

SCHEMA = "url string, adapter string, remote boolean, authenticated boolean, available boolean, final_url string, status_code int, content_type string, body binary, fetched_at timestamp, robots_status string, provided_markdown string, error_code string, error_message string, retryable boolean"
AT = datetime.datetime(2024, 1, 2, 3, 4, 5)
LONG = "long " * 60


def row(url, adapter="direct", status=200, body=b"", kind="text/plain", **more):
    base = {"url": url, "adapter": adapter, "remote": adapter != "direct", "authenticated": adapter == "firecrawl", "available": True, "final_url": url, "status_code": status, "content_type": kind, "body": body, "fetched_at": AT, "robots_status": "allowed", "provided_markdown": None, "error_code": None, "error_message": None, "retryable": None}
    return tuple((base | more)[c.split()[0]] for c in SCHEMA.split(", "))


def made(spark, rows, **options):
    tries = fetch.tried(spark.createDataFrame(rows, SCHEMA), **options)
    same = {k: v for k, v in options.items() if k in ("reader", "min_chars")}
    return tries, {r.url: r for r in fetch.bundles(tries, **same).collect()}


def test_a_thin_answer_falls_back_and_stays_the_raw_artifact(spark):
    rows = [row("u", body=b"thin"), row("u", "jina", body=LONG.encode(), provided_markdown=LONG), row("u", "firecrawl", body=b"x")]
    tries, got = made(spark, rows, allow_remote=True, allow_authenticated=True)
    b = got["u"]
    assert bytes(b.body) == b"thin" and b.markdown == LONG.strip() + "\n" and b.route == ["direct", "jina"] and b.status == "complete"
    assert b.remote_adapter_used and not b.authenticated_adapter_used and "direct_returned_thin_content" in b.warnings and "raw_origin_not_preserved" in b.warnings
    assert made(spark, rows)[1]["u"].route == ["direct"] and made(spark, rows)[1]["u"].status == "partial"
    files = {r.role: r for r in fetch.artifacts(fetch.bundles(tries)).collect()}
    assert set(files) == {"raw", "normalized", "anchors", "links"} and bytes(files["links"].body) == b"[]\n"


def test_failures_policy_robots_and_sizes(spark):
    rows = [row("a", status=404), row("b", status=429), row("c", robots_status="blocked"), row("d", body=b"x" * 50), row("e", available=False), row("f", status=None, body=None, error_code="fetch_failed", error_message="reset", retryable=True), row("g")]
    blocked = spark.createDataFrame([("g", "host is not allowed"), ("a", None)], "url string, block_reason string")
    tries, got = made(spark, rows, max_bytes=40, blocked=blocked)
    say = {u: (r.status, r.error_code, r.error_message, r.retryable) for u, r in got.items()}
    assert say == {
        "a": ("failed", "fetch_failed", "HTTP status 404", False),
        "b": ("failed", "fetch_failed", "HTTP status 429", True),
        "c": ("failed", "policy_blocked", "robots rules disallow the URL", False),
        "d": ("failed", "fetch_failed", "response exceeded max_bytes", False),
        "e": ("failed", "adapter_unavailable", "no reader adapter is available", False),
        "f": ("failed", "fetch_failed", "reset", True),
        "g": ("failed", "policy_blocked", "host is not allowed", False),
    }
    assert fetch.artifacts(fetch.bundles(tries)).isEmpty()
    records = {r.url: r for r in fetch.attempt_records(tries).collect()}
    assert (records["a"].http_status, records["e"].status, records["e"].code) == (404, "skipped", "adapter_unavailable")
    with pytest.raises(ValueError):
        made(spark, rows, reader="other")


def test_named_readers_need_consent_and_end_at_once(spark):
    rows = [row("u", "jina", body=b"t", provided_markdown="t"), row("u", body=LONG.encode())]
    assert made(spark, rows, reader="jina")[1]["u"].error_message == "remote adapters are disabled by policy"
    b = made(spark, rows, reader="jina", allow_remote=True)[1]["u"]
    assert b.route == ["jina"] and b.status == "partial" and b.warnings.count("jina_returned_thin_content") == 0


def test_conversions(spark):
    page = b"<title>T</title><main><p>" + LONG.encode() + b"<a href='/x'>go</a></main>"
    rows = [row("https://h.example/a", body=page, kind="Text/HTML; charset=utf-8"), row("j", body=b'{"b":1,"a":2}', kind="application/json"), row("l", body="é [t](https://h.example/q)".encode("latin-1"), kind="text/plain; charset=ISO-8859-1"), row("z", body=b"PK", kind="application/zip")]
    tries, got = made(spark, rows)
    assert got["https://h.example/a"].title == "T" and got["https://h.example/a"].links[0].url == "https://h.example/x"
    assert got["j"].markdown == '```json\n{\n  "a": 2,\n  "b": 1\n}\n```\n' and got["l"].markdown.startswith("é ") and got["l"].links[0].text == "t"
    assert got["z"].status == "partial" and got["z"].markdown is None and "normalization_unavailable" in got["z"].warnings
    assert [(r.adapter, r.status) for r in fetch.attempt_records(tries).filter("url = 'z'").orderBy("seq").collect()] == [("direct", "success"), ("direct:normalize", "failed")]


def test_responses_of_remote_readers(spark):
    body = ['{"data":{"markdown":"m","rawHtml":"<p>h","metadata":{"sourceURL":"https://h.example/f","statusCode":201}}}', '{"markdown":"only"}', '{"data":{"html":"<p>"}}', "no json", '{"data":{"markdown":"m","metadata":{"statusCode":"x"}}}']
    df = spark.createDataFrame([(str(i), 200, b.encode()) for i, b in enumerate(body)], "url string, status_code int, body binary")
    got = {r.url: r for r in fetch.firecrawl_result(df).collect()}
    assert (bytes(got["0"].body), got["0"].final_url, got["0"].status_code, got["0"].provided_markdown) == (b"<p>h", "https://h.example/f", 201, "m")
    assert bytes(got["1"].body) == b"only" and got["1"].error_code is None and got["1"].content_type.startswith("text/markdown")
    assert [got[k].error_message for k in "234"] == ["Firecrawl response has no markdown", "invalid Firecrawl JSON response", "invalid Firecrawl status code"]
    assert fetch.jina_result(df).first().provided_markdown == body[0]


def test_local_files(spark):
    files = [("d/a.html", b"<title>T</title><p>x"), ("b.json", b'{"unfinished":'), ("c.TXT", b"# H\ntext"), ("e.pdf", b"%PDF"), ("big.md", b"x" * 5000), ("gone.md", None)]
    df = spark.createDataFrame([(p, b, AT) for p, b in files], "path string, body binary, read_at timestamp")
    got = {r.url: r for r in fetch.ingested(df, max_bytes=4000).collect()}
    assert got["d/a.html"].title == "T" and got["d/a.html"].final_url == "manual://a.html" and got["c.TXT"].title == "H" and got["c.TXT"].raw_path == "raw.txt"
    assert "invalid_json_syntax" in got["b.json"].warnings and got["b.json"].markdown == '```json\n{"unfinished":\n```\n' and got["b.json"].title == "b"
    assert got["e.pdf"].status == "partial" and got["e.pdf"].raw_path == "raw.pdf"
    assert got["big.md"].error_message == "input file exceeds max_bytes: 4000" and got["gone.md"].error_code == "invalid_input"


def test_addresses_and_names_of_a_policy(spark):
    cases = {"https://127.0.0.1/": "non-public IP targets are blocked", "https://169.254.169.254/latest": "non-public IP targets are blocked", "https://[::1]/": "non-public IP targets are blocked", "http://0.0.0.0/": "non-public IP targets are blocked", "https://8.8.8.8/": None, "https://mixed.example/": "host resolves to a private address", "https://open.example/": None, "https://gone.example/": "host could not be resolved", "https://Bücher.example:443/a#f": None, "https://u:p@open.example/": "credentials embedded in URLs are not allowed", "ftp://open.example/": "only http and https URLs are supported", "https://a.local/": "local hostnames are blocked"}
    dns = spark.createDataFrame([("mixed.example", "93.184.216.34"), ("mixed.example", "127.0.0.1"), ("open.example", "93.184.216.34"), ("xn--bcher-kva.example", "93.184.216.34")], "host string, address string")
    rows = {r.url: r for r in urls.validated(spark.createDataFrame([(u,) for u in [*cases, None]], "url string"), dns).collect()}
    assert {u: r.block_reason for u, r in rows.items() if u} == cases and rows[None].error_code == "invalid_input"
    assert rows["https://Bücher.example:443/a#f"].normalized_url == "https://xn--bcher-kva.example/a" and rows["https://gone.example/"].retryable
    free = urls.validated(spark.createDataFrame([("https://10.0.0.1/",), ("https://gone.example/",)], "url string"), dns, deny_private=False)
    assert [r.block_reason for r in free.collect()] == [None, None]
    assert rows["ftp://open.example/"].error_code == "invalid_input" and rows["https://u:p@open.example/"].error_code == "policy_blocked"
    assert spark.createDataFrame([("https://h",)], "u string").select(F.isnull(urls.ascii_url(F.lit(None).cast("string"))).alias("x")).first().x


def test_bundles_of_one_reader_are_verified_without_a_shuffle(spark):
    from lodestone import catalog

    plan = catalog.queries()["bundle_verification"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_bundles_as_rows_break_the_rules_that_tables_do(spark):
    from lodestone.operators import verify

    markdown = "# H\n\ntext\n"
    line = fetch.anchor_lines(markdown)
    good = {"raw.txt": b"r", "normalized.md": markdown.encode(), "anchors.jsonl": "".join(x + "\n" for x in line).encode(), "links.json": b"[]\n"}
    roles = {"raw": "raw.txt", "normalized": "normalized.md", "anchors": "anchors.jsonl", "links": "links.json"}
    changed = {  # what is stored, what is stated, the receipt
        "good": ({}, {}, {}),
        "bytes": ({"normalized.md": b"\xff\n", "anchors.jsonl": b"\xff"}, {}, {}),
        "lines": ({"normalized.md": b"# G\n", "anchors.jsonl": b"\n{}\n" + good["anchors.jsonl"]}, {}, {}),
        "links": ({"links.json": b'[{"text":"t"}]'}, {}, {"link_count": 2}),
        "lone": ({"normalized.md": None, "anchors.jsonl": None, "links.json": None, "more": b"m"}, {}, {}),
        "paths": ({}, {"normalized": "../n.md", "links": "anchors.jsonl"}, {"source_bytes": 7}),
        "flags": ({"raw.txt": b"rr"}, {"raw": "RAW"}, {"route": ["jina"], "authenticated_adapter_used": True}),
    }
    import hashlib

    stored, stated, receipts, tries = [], [], [], []
    for name, (files, paths, receipt) in changed.items():
        stored += [(name, p, b) for p, b in (good | files).items() if b is not None]
        stated += [(name, r, paths.get(r, p), hashlib.sha256(good[p]).hexdigest(), len(good[p])) for r, p in roles.items()]
        base = {"status": "complete", "route": ["direct"], "remote_adapter_used": False, "authenticated_adapter_used": False, "source_bytes": 1, "source_sha256": hashlib.sha256(b"r").hexdigest(), "normalized_chars": len(markdown), "anchor_count": len(line), "link_count": 0}
        receipts.append((name, *(base | receipt).values()))
        tries += [(name, "success", False, False), (name, "skipped", True, True)]
    stated += [("good", "raw", "raw.txt", "x", 1), ("no receipt", "raw", "raw.txt", "x", 1)]
    stored.append(("not stated", "raw.txt", b""))
    r = spark.createDataFrame(receipts, "url string, status string, route array<string>, remote_adapter_used boolean, authenticated_adapter_used boolean, source_bytes long, source_sha256 string, normalized_chars long, anchor_count long, link_count long")
    s, t = spark.createDataFrame(stated, "url string, role string, path string, sha256 string, bytes long"), spark.createDataFrame(stored, "url string, path string, body binary")
    a = spark.createDataFrame(tries, "url string, status string, remote_adapter boolean, authenticated_adapter boolean")
    files = verify.artifact_violations(s, t, ["url"]).selectExpr("url", "concat_ws(': ', failure, path) AS failure").distinct()
    want = [files, verify.layout_violations(r, s, ["url"]), verify.path_violations(s, ["url"]), verify.flag_violations(r, a, ["url"]), verify.source_violations(r, s, t, ["url"]), verify.file_violations(r, s, t, ["url"])]
    want = sorted((x.url, x.failure) for part in want for x in part.collect())
    assert sorted((x.url, x.failure) for x in verify.bundle_violations(r, s, t, a, ["url"]).collect()) == want and len({f for _, f in want}) > 20


def test_workers_pass_results_on_before_a_batch_ends():
    import pyarrow as pa

    from lodestone.operators import documents
    from lodestone.session import PASSED_ON

    n, text = 40, "word " * (PASSED_ON // 50)
    columns = [pa.array([v] * n) for v in (text.encode(), "text/plain", "https://h.example/", None, "direct")]
    parts = list(fetch._normalized.func(iter([columns])))
    assert [len(p) for p in parts] != [n] and sum(map(len, parts)) == n and max(p.nbytes for p in parts) < 3 * PASSED_ON
    page = "".join(f"<a href='/{'p' * 90}{i}'>link {i}</a>" for i in range(1000))
    for made in (documents._linked("document"), documents._converted):
        parts = list(made.func(iter([(pa.array([page] * n), pa.array(["https://h.example/"] * n))])))
        assert len(parts) > 5 and sum(map(len, parts)) == n and max(p.nbytes for p in parts) < 3 * PASSED_ON
    assert list(fetch._normalized.func(iter([]))) == [] and documents.links_of_html(page, "https://h.example/") == documents.convert(page, "https://h.example/")["links"]
