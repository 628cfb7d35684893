import json

import pytest

from lodestone.plans.cli import main
from lodestone.plans.contracts import CONTRACTS, load_manifest, schema
from lodestone.plans.policy import Policy, load_policy
from lodestone.sources.bundles import artifact_refs, json_lines, read_bundles, write_bundles
from lodestone.sources.robots import robots_status


def test_policy():
    assert Policy().digest() == Policy().digest() != Policy(max_pages=3).digest()
    assert load_policy('{"denied_domains": ["B.example.", "a.example"]}').denied_domains == ["a.example", "b.example"]
    assert Policy().override(allow_authenticated=True, max_depth=None).allow_remote
    for bad in ('{"max_pages": 0}', '{"unknown": 1}', '{"timeout_seconds": 0}', "[]"):
        with pytest.raises(ValueError):
            load_policy(bad)
    with pytest.raises(ValueError):
        Policy().override(max_pages=5000)


def test_command_line(capsys, tmp_path):
    assert main(["doctor"]) == 0 and {c["name"] for c in json.loads(capsys.readouterr().out)} >= {"java", "pyarrow"}
    assert main(["search"]) == 2 and json.loads(capsys.readouterr().err)["error"] == "invalid_input"
    (tmp_path / "p.json").write_text("{}")
    assert main(["policy", str(tmp_path / "p.json")]) == 0


def test_search_of_a_folder(spark, capsys, tmp_path):
    (tmp_path / "a.md").write_text("one\nneedle here\n")
    assert main(["search", "needle here", "--root", str(tmp_path)]) == 0
    assert json.loads(capsys.readouterr().out)[0]["locator"] == "a.md:2"


def test_robots(spark):
    urls = spark.createDataFrame([("https://a/x",), ("https://a/no/y",), ("https://b/x",), ("https://c/x",), ("https://d/x",)], "url string")
    robots = spark.createDataFrame([("https://a", 200, "User-agent: *\nDisallow: /no/"), ("https://b", 404, None), ("https://c", 503, None)], "authority string, status_code int, body string")
    got = {r.url: (r.robots_status, r.robots_allowed) for r in robots_status(urls, robots, agent="x").collect()}
    assert got == {"https://a/x": ("allowed", True), "https://a/no/y": ("blocked", False), "https://b/x": ("unavailable", True), "https://c/x": ("blocked", False), "https://d/x": ("blocked", False)}


def test_bundles(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "bundle long, pos int, kind string")
    body = json_lines(rows, ["bundle"], ["pos"]).first().body
    assert body == '{"kind": "a", "pos": 0}\n{"kind": "b", "pos": 1}\n'
    artifacts = spark.createDataFrame([(1, "anchors", "anchors.jsonl", body)], "bundle long, role string, path string, body string")
    assert artifact_refs(artifacts, ["bundle"]).first().bytes == len(body)
    write_bundles(artifacts, str(tmp_path / "out"))
    assert read_bundles(spark, str(tmp_path / "out")).count() == 1
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        write_bundles(artifacts, str(tmp_path / "out"))


def test_contracts_and_manifest():
    assert len(CONTRACTS) == 9 and all(schema(c)["additionalProperties"] is False for c in CONTRACTS)
    with pytest.raises(ValueError):
        schema("other")
    spec = {"name": "papers", "scope": "research", "command": ["p"]}
    assert load_manifest(json.dumps({"providers": [spec]}).encode())[0]["timeout_seconds"] == 60.0
    bad = [{"name": "exa"}, {"scope": "local"}, {"name": "X"}, {"sensitivity": "internal"}, {"sensitivity": "x"}, {"command": [""]}, {"command": []}, {"timeout_seconds": 301}, {"more": 1}, {"isolated": 1}]
    for change in bad:
        with pytest.raises(ValueError, match="invalid_input"):
            load_manifest(json.dumps({"providers": [spec | change]}).encode())
    for raw in (json.dumps({"providers": [spec, spec]}).encode(), b"[]", b"no", b" " * 1_000_001, json.dumps({"other": 1}).encode()):
        with pytest.raises(ValueError, match="invalid_input"):
            load_manifest(raw)


def run(capsys, *argv):
    status = main([str(a) for a in argv])
    said = capsys.readouterr()
    return status, json.loads(said.out or said.err)


def test_ingest_and_verify(spark, capsys, tmp_path):
    (tmp_path / "a.md").write_text("# Title\n\n" + "text " * 60 + "\n\n[l](https://h.example/x)\n")
    out = tmp_path / "bundle"
    status, receipt = run(capsys, "ingest", tmp_path / "a.md", "--output", out)
    assert status == 0 and receipt["status"] == "complete" and receipt["title"] == "Title" and {p.name for p in out.iterdir()} == {"raw.md", "normalized.md", "anchors.jsonl", "links.json", "receipt.json"}
    assert set(CONTRACTS["evidence"].names) <= set(receipt)
    assert run(capsys, "verify", out) == (0, {"kind": "bundle", "valid": True, "failures": [], "verified_pages": 0, "schema_version": "1.0"})
    (out / "raw.md").write_text("changed")
    (out / "more").write_text("x")
    status, said = run(capsys, "verify", out)
    assert status == 6 and {"sha256 mismatch: raw.md", "unexpected bundle entry: more"} <= set(said["failures"])
    assert run(capsys, "ingest", tmp_path / "a.md", "--output", out)[0] == 2  # never over another
    assert run(capsys, "ingest", tmp_path / "none.md", "--output", tmp_path / "n")[1]["error"] == "invalid_input" and not (tmp_path / "n").exists()
    (out / "link").symlink_to(out / "raw.md")
    assert run(capsys, "verify", out)[0] == 6
    assert run(capsys, "verify", tmp_path / "none")[0] == 2


def test_fetch_of_recorded_results(spark, capsys, tmp_path):
    from tests.test_fetch import SCHEMA, row

    spark.createDataFrame([row("https://h.example/a", body=b"word " * 50), row("https://h.example/b", status=404)], SCHEMA).write.parquet(str(tmp_path / "r"))
    status, receipt = run(capsys, "fetch", "https://h.example/a", "--results", tmp_path / "r", "--output", tmp_path / "a")
    assert status == 0 and receipt["route"] == ["direct"] and run(capsys, "verify", tmp_path / "a")[0] == 0
    assert run(capsys, "fetch", "https://h.example/b", "--results", tmp_path / "r", "--output", tmp_path / "b")[1] == {"error": "fetch_failed", "message": "fetch_failed: HTTP status 404", "retryable": True}
    assert run(capsys, "fetch", "https://127.0.0.1/", "--results", tmp_path / "r", "--output", tmp_path / "c")[0] == 3
    assert run(capsys, "fetch", "https://h.example/a", "--results", tmp_path / "r", "--output", tmp_path / "c", "--deny-domain", "h.example")[1]["error"] == "policy_blocked"


def test_crawl_resume_and_verify(spark, capsys, tmp_path):
    spark.createDataFrame([("https://s/0", k, f"https://s/{k + 1}") for k in range(3)], "url string, pos int, target string").write.parquet(str(tmp_path / "l"))
    spark.createDataFrame([(f"https://s/{k}", 1, "fetch_failed" if k == 3 else None, False) for k in range(4)], "url string, attempt int, error_code string, retryable boolean").write.parquet(str(tmp_path / "r"))
    base = ["crawl", "https://s/0", "--links", tmp_path / "l", "--results", tmp_path / "r", "--output", tmp_path / "out"]
    assert run(capsys, *base, "--resume")[0] == 2
    status, receipt = run(capsys, *base)
    assert status == 0 and receipt["status"] == "partial" and receipt["failures_by_code"] == {"fetch_failed": 1}
    assert run(capsys, *base)[0] == 2 and run(capsys, *base, "--resume", "--max-pages", 3)[0] == 2
    assert run(capsys, *base, "--resume")[1]["pages"] == receipt["pages"]
    status, said = run(capsys, "verify", tmp_path / "out")
    assert status == 0 and said["valid"] and said["verified_pages"] == 3
    told = json.loads((tmp_path / "out" / "crawl-receipt.json").read_text())
    (tmp_path / "out" / "crawl-receipt.json").write_text(json.dumps(told | {"status": "complete", "reader": "jina", "failures_by_code": {}, "crawl_state_sha256": "0"}))
    assert set(run(capsys, "verify", tmp_path / "out")[1]["failures"]) == {"crawl status mismatch", "crawl state metadata mismatch: reader", "failures_by_code mismatch", "crawl state sha256 mismatch"}
