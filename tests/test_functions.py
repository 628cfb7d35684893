from pyspark.sql import functions as F

from lodestone.functions import govern, ids, query, text, urls
from lodestone.sources.providers import command_responses, repository_rows, titled_text
from lodestone.sources.workspace import chosen, read_folder, ripgrep_matches


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y





def test_folding_is_that_of_python(spark):
    for x in ("οδος ΟΔΟΣ ﬁ ſ Straße ẞ", "ŉ ǰ ΐ ᾳ ſt ﬗ", "plain ASCII", "Ꭰꭰ ᏸ", "İI", ""):
        assert one(spark, lambda X: text.fold(X), x) == x.casefold()


def test_text(spark):
    assert one(spark, lambda X: text.collapse(X), " a \t b\n") == "a b"
    assert one(spark, lambda X: text.compact(X, 20), "word " * 10) == "word wor [truncated]"
    assert one(spark, lambda X: text.lines(X), "a\r\nb\rc\n") == ["a", "b", "c"]
    assert one(spark, lambda X: text.clean_markdown(X), "a  \r\n\n\n\n\n\nb \n") == "a\n\n\nb\n"
    assert one(spark, lambda X: text.clean_markdown(X), " \n") == ""
    assert one(spark, lambda X: text.markdown_title(X), "x\n# Title here  \ny") == "Title here"
    assert one(spark, lambda X: text.markdown_title(X), "## no") is None
    assert one(spark, lambda X: text.dedupe_lines(X, 100), "a\n\na\n...\nb\na") == "a\nb\na"
    assert one(spark, lambda X: text.dedupe_lines(X, 20), "y" * 50).endswith("\n[truncated]")


def test_markdown_links(spark):
    df = spark.createDataFrame([(1, "[a](/x) ![i](y.png \"t\") [a](/x) [m](mailto:q)", "https://h.example/d/e")], "id long, text string, base string")
    got = text.markdown_links(df, ["id"], "text", "base").orderBy("pos").collect()
    assert [(r.text, r.url) for r in got] == [("a", "https://h.example/x"), ("i", "https://h.example/d/y.png")]


def test_queries(spark):
    assert one(spark, lambda X: query.tokens(X), "How to search the Search code-path of a b cc_d 什么 ß") == ["search", "Search", "code-path", "cc_d"]
    assert one(spark, lambda X: query.relaxed_pattern(query.tokens(X)), "a.b c-d") == r"a\.b|c\-d"
    assert one(spark, lambda X: query.relaxed_pattern(query.tokens(X)), "single") is None
    assert one(spark, lambda X: query.host_variants(X), 'best vector store "exact phrase" lang:go -old') == ['best vector store "exact phrase" lang:go -old', "vector store lang:go -old"]
    assert one(spark, lambda X: query.host_variants(X), "vector lang:go") == ["vector lang:go"]


def test_urls(spark):
    cases = {
        "HTTPS://Example.COM:443/a/../B?q=1#f": "https://example.com/a/../B?q=1",
        " http://h.example. ": "http://h.example/",
        "http://h:8080/": "http://h:8080/",
        "https://[2001:DB8::1]:443/x": "https://[2001:db8::1]/x",
        "ftp://h/": None,
        "https://user@h/": None,
        "https:///x": None,
    }
    for url, want in cases.items():
        assert one(spark, lambda X: urls.normalize(X), url) == want, url
        assert urls.normalize_any(url) == want, url
    assert urls.normalize_any("https://Bücher.example/") == "https://xn--bcher-kva.example/"
    assert one(spark, lambda X: urls.canonical_host(X), "Bücher.example.") == "xn--bcher-kva.example"
    assert one(spark, lambda X: urls.source_class(X), "https://a.docs.python.org/3") == "official-candidate"
    assert one(spark, lambda X: urls.source_class(X), "https://github.com/x") == "open-source-candidate"
    assert one(spark, lambda X: urls.block_reason(X, denied=("bad.example",)), "https://a.bad.example/") == "host is not allowed"
    assert one(spark, lambda X: urls.block_reason(X, allowed=("ok.example",)), "https://a.ok.example/") is None
    assert one(spark, lambda X: urls.block_reason(X), "https://printer.local/") == "local hostnames are blocked"
    for address, want in {"8.8.8.8": True, "10.0.0.1": False, "::ffff:127.0.0.1": False, "2606:4700::1": True, "x": None}.items():
        assert one(spark, lambda X: urls.is_public_ip(X), address) is want
    assert urls.normalize_domains([" .Example.COM ", "a.b"]) == ["a.b", "example.com"]


def test_resolution(spark):
    df = spark.createDataFrame([("u1", "a"), ("u2", "b"), ("u3", "c")], "url string, host string")
    dns = spark.createDataFrame([("a", "8.8.8.8"), ("b", "8.8.8.8"), ("b", "10.1.1.1")], "host string, address string")
    got = {r.url: (r.block_reason, r.retryable) for r in urls.resolved_reason(df, dns).collect()}
    assert got == {"u1": (None, False), "u2": ("host resolves to a private address", False), "u3": ("host could not be resolved", True)}


def test_ids(spark):
    assert one(spark, lambda X: ids.raw_name(X), "Text/HTML; charset=x") == "raw.html"
    assert one(spark, lambda X: ids.raw_name(X), None) == "raw.bin"
    assert one(spark, lambda X: ids.charset(X), 'text/html; Charset="Latin-1"') == "latin-1"
    assert [one(spark, lambda X: ids.safe_child(X), p) for p in ("a/b", "/a", "a/../b", "")] == [True, False, False, False]
    assert len(one(spark, lambda X: ids.page_folder(X), "https://x/")) == 20


def test_governance(spark):
    assert one(spark, lambda X: govern.redact(X), "Bearer abc, token = xyz; api-key:1 \x1b[31mred") == "Bearer [redacted], token = [redacted]; api-key:[redacted] red"
    assert one(spark, lambda X: govern.provider_error(X), "") == "provider exited without a diagnostic"
    r = one(spark, lambda X: govern.public_error(X, "none"), "boom\n  at f (x.js)\nexaApiKey=1&x")
    assert (r.message, r.rate_limited) == ("boom exaApiKey=[redacted]&x", False)
    assert one(spark, lambda X: govern.public_error(X, "none"), "HTTP 429").rate_limited
    assert govern.safe_value({"a": {"b": {"c": 1}, "password": 2}, "l": list(range(30))}) == {"a": {"b": "{'c': 1}"}, "l": [str(i) for i in range(20)]}
    assert one(spark, lambda X: govern.safe_json(X), '{"token": 1, "k": " a  b "}') == '{"k": "a b"}'
    assert one(spark, lambda X: govern.safe_json(X), "[1]") is None
    specs = spark.createDataFrame([("exa", "s", "public", False, ["x"]), ("ok", "auto", "internal", False, [""]), ("ok", "t", "public", True, ["x"])], "name string, scope string, sensitivity string, isolated boolean, command array<string>")
    got = {(r.rule, r.name) for r in govern.manifest_violations(specs).collect()}
    assert got == {("reserved provider name", "exa"), ("reserved scope", "ok"), ("internal provider must be isolated", "ok"), ("empty command part", "ok"), ("duplicate provider name", "ok")}


def test_workspace(spark, tmp_path):
    for p in ("a.md", "src/b.py", "build/c.py", "d.bin", "e/.git/x.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(f"line {p}\n")
    (tmp_path / "big.txt").write_text("x" * 2000)
    assert [r.path for r in read_folder(spark, str(tmp_path), most_bytes=1000).orderBy("path").collect()] == ["a.md", "src/b.py"]
    assert one(spark, lambda X: chosen(X, ["*.Md"]), "a.md") is False
    raw = spark.createDataFrame([('{"type":"match","data":{"path":{"text":"a"},"lines":{"text":" x\\n"},"line_number":3}}',), ("junk",), ('{"type":"begin"}',), ('{"type":"match","data":{"path":{"text":"../a"},"lines":{"text":"x"},"line_number":3}}',)], "value string")
    assert [tuple(r) for r in ripgrep_matches(raw).collect()] == [("a", 3, "x")]


def test_provider_texts(spark):
    raw = spark.createDataFrame([(1, "Title: A\nURL: https://x/a\nPublished: N/A\nHighlights:\none\none\n---\nTitle: B\nno url\nTitle: C\nURL: https://x/c\nPublished: 2024\n"), (2, "see https://y/z.")], "query_id long, stdout string")
    got = titled_text(raw, 5, ["query_id"]).orderBy("query_id", "idx").collect()
    assert [(r.query_id, r.title, r.locator, r.snippet, r.published_at) for r in got] == [(1, "A", "https://x/a", "one", None), (1, "C", "https://x/c", "", "2024"), (2, "https://y/z", "https://y/z", "", None)]
    hub = spark.createDataFrame([(1, '[{"url":""},{"fullName":"a/b","url":"https://github.com/a/b","stargazersCount":3}]')], "query_id long, stdout string")
    assert [(r["rank"], r.title, r.stars) for r in repository_rows(hub, ["query_id"]).collect()] == [(2, "a/b", 3)]


def test_command_responses(spark):
    specs = spark.createDataFrame([("p", "s")], "name string, scope string")
    good = '{"provider":"p","scope":"s","candidates":[{"title":"t","locator":"l","snippet":"n"},{"title":"u","locator":"m","snippet":"n"}]}'
    raw = spark.createDataFrame([(1, "p", 0, good), (2, "p", 0, good.replace('"s"', '"z"')), (3, "p", 1, ""), (4, "p", 0, "junk")], "query_id long, provider string, exit_code int, stdout string")
    found, attempts = command_responses(raw, specs, 1, ["query_id"])
    assert [(r.query_id, r.title) for r in found.collect()] == [(1, "t")]
    assert {(r.query_id, r.status, r.code, r.candidate_count) for r in attempts.collect()} == {(1, "success", None, 1), (2, "failed", "provider_protocol_error", 0), (3, "failed", "search_failed", 0), (4, "failed", "provider_protocol_error", 0)}
