"""Command line: search, fetch, ingest, crawl, verify, policy, schema and doctor.

Network answers are tables, given by path: `fetch` and `crawl` read recorded results, and a table of addresses where
the policy asks for one. Single bundles become folders of files; everything else is a table.
"""

from __future__ import annotations

import argparse
import datetime
import importlib.util
import json
import shutil
import sys
from pathlib import Path

from lodestone.functions.govern import ERRORS
from lodestone.plans.contracts import CONTRACTS, load_manifest, schema
from lodestone.plans.policy import Policy, load_policy

EXIT = {code: status for code, status, _ in ERRORS}
RETRY = {code: retryable for code, _, retryable in ERRORS}
READERS = ("auto", "direct", "jina", "firecrawl")
SCHEMA_VERSION = "1.0"


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise ValueError(f"invalid_input: {message}")


class Failed(ValueError):
    """A failure whose message begins with its code."""


def _positive(raw: str) -> int:
    value = int(raw)
    if value < 1:
        raise argparse.ArgumentTypeError("must be positive")
    return value


def doctor(manifest: str | None = None) -> list[dict]:
    """Fixed checks of what the engine can use here, and one for each provider of a manifest."""
    checks = [("java", shutil.which("java"), "Spark"), ("ripgrep", shutil.which("rg"), "ripgrep output as a source")]
    modules = [("pyarrow", "Arrow batches"), ("duckdb", "oracle tests"), ("tokenizers", "BPE encoding"), ("tiktoken", "packing"), ("xxhash", "fingerprints")]
    checks += [(m, importlib.util.find_spec(m), what) for m, what in modules]
    for spec in load_manifest(Path(manifest).read_bytes()) if manifest else ():
        checks.append((spec["name"], shutil.which(spec["command"][0]), f"command provider of scope {spec['scope']}"))
    return [{"name": n, "status": "ok" if found else "off", "capability": what} for n, found, what in checks]


def _policy(args) -> Policy:
    own = Policy()
    if args.policy:
        own = load_policy(Path(args.policy).read_text(encoding="utf-8"))
    return own.override(allow_remote=args.allow_remote or None, allow_authenticated=args.allow_authenticated or None, require_https=args.require_https or None, max_bytes=args.max_bytes, min_normalized_chars=args.min_normalized_chars, max_pages=getattr(args, "max_pages", None), max_depth=getattr(args, "max_depth", None), allowed_domains=args.allow_domain, denied_domains=args.deny_domain)


def _policy_flags(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--policy")
    parser.add_argument("--allow-remote", action="store_true")
    parser.add_argument("--allow-authenticated", action="store_true")
    parser.add_argument("--require-https", action="store_true")
    parser.add_argument("--max-bytes", type=_positive)
    parser.add_argument("--min-normalized-chars", type=_positive)
    parser.add_argument("--allow-domain", action="append")
    parser.add_argument("--deny-domain", action="append")


def _publish(made, attempts, policy: Policy, output: str) -> dict:
    """Write the one bundle of `made` as files with its receipt."""
    from lodestone.operators import fetch
    from lodestone.sources.bundles import publish

    row = made.first()
    if row is None:
        raise Failed("fetch_failed: no result was recorded for the URL")
    if row["status"] == "failed":
        raise Failed(f"{row['error_code']}: {row['error_message']}")
    files = fetch.artifacts(made).collect()
    refs = [{k: f[k] for k in ("role", "path", "media_type", "sha256", "bytes")} for f in files]
    keep = ("receipt_id", "final_url", "status", "route", "source_sha256", "source_bytes", "normalized_chars", "anchor_count", "link_count", "remote_adapter_used", "authenticated_adapter_used", "robots_status", "title", "method", "warnings")
    told = [{k: a[k] for k in ("adapter", "status", "code", "message", "retryable", "http_status", "method", "raw_bytes", "remote", "authenticated")} for a in attempts]
    receipt = {k: row[k] for k in keep} | {"requested_url": row["url"], "policy_sha256": policy.digest(), "artifacts": refs, "attempts": told, "schema_version": SCHEMA_VERSION}
    body = json.dumps(receipt, ensure_ascii=False, indent=2, sort_keys=True) + "\n"
    publish([*((f["path"], bytes(f["body"])) for f in files), ("receipt.json", body.encode())], output)
    return receipt


def fetch_url(spark, url: str, results: str, output: str, policy: Policy, reader: str = "auto", dns: str | None = None) -> dict:
    """A bundle of one URL from a table of recorded results."""
    from pyspark.sql import functions as F

    from lodestone.functions import urls
    from lodestone.operators import fetch

    asked = spark.createDataFrame([(url,)], "url string")
    addresses = spark.read.parquet(dns) if dns else spark.createDataFrame([], "host string, address string")
    known = bool(dns) and policy.deny_private_networks
    rule = asked.select("url", urls.block_reason(urls.ascii_url(F.col("url")), denied=policy.denied_domains, allowed=policy.allowed_domains, subdomains=policy.allow_subdomains, require_https=policy.require_https, deny_private=policy.deny_private_networks).alias("block_reason"), F.when(urls.problem(F.col("url")).isNotNull(), "invalid_input").otherwise("policy_blocked").alias("error_code"))
    if known:
        rule = urls.validated(asked, addresses, denied=policy.denied_domains, allowed=policy.allowed_domains, subdomains=policy.allow_subdomains, require_https=policy.require_https)
    if (bad := rule.filter("block_reason is not null").first()) is not None:
        raise Failed(f"{bad['error_code']}: {bad['block_reason']}")
    rows = spark.read.parquet(results).filter(F.col("url") == url)
    tries = fetch.tried(rows, reader=reader, allow_remote=policy.allow_remote, allow_authenticated=policy.allow_authenticated, max_bytes=policy.max_bytes, min_chars=policy.min_normalized_chars)
    return _publish(fetch.bundles(tries, reader=reader, min_chars=policy.min_normalized_chars), fetch.attempt_records(tries).orderBy("seq").collect(), policy, output)


def ingest(spark, path: str, output: str, policy: Policy, source_url: str | None = None) -> dict:
    """A bundle of one local file."""
    from lodestone.operators import fetch

    body = Path(path).read_bytes() if Path(path).is_file() else None
    now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None, microsecond=0)
    files = spark.createDataFrame([(path, body, now)], "path string, body binary, read_at timestamp")
    made = fetch.ingested(files, source_url=source_url, max_bytes=policy.max_bytes, min_chars=policy.min_normalized_chars)
    attempt = {"adapter": "local-file", "status": "success", "code": None, "message": None, "retryable": False, "http_status": None, "method": None, "raw_bytes": None, "remote": False, "authenticated": False}
    return _publish(made, [attempt], policy, output)


def run_crawl(spark, url: str, links: str, results: str, output: str, policy: Policy, reader: str = "auto", resume: bool = False) -> dict:
    """Crawl recorded pages; the job, its state and receipt are in the output folder, from which it can be resumed."""
    from lodestone.operators import crawl, verify

    folder = Path(output)
    if resume and not (folder / "job.json").is_file():
        raise Failed("invalid_input: no crawl state to resume")
    if not resume and folder.exists() and any(folder.iterdir()):
        raise Failed(f"invalid_input: crawl output folder is not empty: {output}")
    state = None
    if resume:
        job = spark.createDataFrame([json.loads((folder / "job.json").read_text())], "crawl_id string, root_url string, reader string, policy_sha256 string, created_at string, max_pages int, max_depth int")
        state = crawl.resumed(job, spark.read.parquet(str(folder / "state")), url, reader, policy)
    else:
        job = crawl.job(spark, url, reader, policy, datetime.datetime.now(datetime.UTC).isoformat())
    pages = crawl.crawl(url, spark.read.parquet(links), spark.read.parquet(results), max_pages=policy.max_pages, max_depth=policy.max_depth, state=state)
    folder.mkdir(parents=True, exist_ok=True)
    row = job.first().asDict()
    (folder / "job.json").write_text(json.dumps(row))
    pages.write.mode("overwrite").parquet(str(folder / "state"))
    from pyspark.sql import functions as F

    own = spark.read.parquet(str(folder / "state")).withColumn("crawl_id", F.lit(row["crawl_id"]))
    made = crawl.receipt(job, own).join(verify.state_digests(own), "crawl_id", "left").withColumnRenamed("state_sha256", "crawl_state_sha256").first()
    receipt = made.asDict(recursive=True) | {"schema_version": SCHEMA_VERSION}
    (folder / "crawl-receipt.json").write_text(json.dumps(receipt, ensure_ascii=False, indent=2, sort_keys=True) + "\n")
    return receipt


def verify_folder(spark, folder: str) -> dict:
    """kind, valid, failures, verified_pages and schema_version of a bundle's or a crawl's folder."""
    from pyspark.sql import functions as F

    from lodestone.operators import verify
    from lodestone.sources.bundles import read_bundle

    root = Path(folder)
    if not root.is_dir():
        raise Failed(f"invalid_input: not a folder: {folder}")
    kind = verify.target_kind({p.name for p in root.iterdir()})
    key = F.lit(1)
    if kind == "bundle":
        files = read_bundle(folder)
        try:
            receipt = json.loads(dict(files)["receipt.json"])
            fields = {k: receipt[k] for k in ("status", "route", "remote_adapter_used", "authenticated_adapter_used", "source_bytes", "source_sha256", "normalized_chars", "anchor_count", "link_count")}
            stated = [(1, a["role"], a["path"], a["sha256"], a["bytes"]) for a in receipt["artifacts"]]
            attempts = [(1, a["status"], a["remote"], a["authenticated"]) for a in receipt["attempts"]]
        except (KeyError, TypeError, ValueError) as e:
            return {"kind": kind, "valid": False, "failures": [f"invalid receipt: {e!r}"], "verified_pages": 0, "schema_version": SCHEMA_VERSION}
        receipts = spark.createDataFrame([(1, *fields.values())], "id int, status string, route array<string>, remote_adapter_used boolean, authenticated_adapter_used boolean, source_bytes long, source_sha256 string, normalized_chars long, anchor_count long, link_count long")
        there = spark.createDataFrame([(1, n, b) for n, b in files if n != "receipt.json"], "id int, path string, body binary")
        bad = verify.bundle_violations(receipts, spark.createDataFrame(stated, "id int, role string, path string, sha256 string, bytes long"), there, spark.createDataFrame(attempts, "id int, status string, remote_adapter boolean, authenticated_adapter boolean"), ["id"])
        pages = 0
    else:
        receipt = json.loads((root / "crawl-receipt.json").read_text())
        state = spark.read.parquet(str(root / "state")).withColumn("crawl_id", F.lit(receipt["crawl_id"]))
        shape = "crawl_id string, url string, depth int, status string, bundle_path string, error_code string"
        stated = spark.createDataFrame([(receipt["crawl_id"], *(p[k] for k in ("url", "depth", "status", "bundle_path", "error_code"))) for p in receipt["pages"]], shape)
        names = ("crawl_id", "root_url", "reader", "policy_sha256", "created_at", "max_pages", "max_depth")
        ddl = "crawl_id string, root_url string, reader string, policy_sha256 string, created_at string, max_pages int, max_depth int"
        own = spark.createDataFrame([(*(receipt[n] for n in names), receipt["status"], receipt["crawl_state_sha256"])], f"{ddl}, status string, crawl_state_sha256 string")
        job = spark.createDataFrame([tuple(json.loads((root / "job.json").read_text())[n] for n in names)], ddl)
        codes = spark.createDataFrame([(receipt["crawl_id"], k, v) for k, v in receipt["failures_by_code"].items()], "crawl_id string, error_code string, n long")
        bad = verify.crawl_violations(own, state, stated).select("failure").unionByName(verify.state_violations(own, job, state).select("failure")).unionByName(verify.code_violations(codes, stated).select("failure"))
        pages = sum(p["status"] == "complete" for p in receipt["pages"])
    found = sorted({r["failure"] for r in bad.withColumn("key", key).collect()})
    return {"kind": kind, "valid": not found, "failures": found, "verified_pages": 0 if found else pages, "schema_version": SCHEMA_VERSION}


def build_parser() -> argparse.ArgumentParser:
    parser = _Parser(prog="lodestone")
    commands = parser.add_subparsers(dest="command", required=True)
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("--root", default=".")
    search.add_argument("--limit", type=_positive, default=8)
    search.add_argument("--include", action="append")
    search.add_argument("--format", choices=("json", "pretty"), default="json")
    commands.add_parser("doctor").add_argument("--providers")
    commands.add_parser("policy").add_argument("file")
    commands.add_parser("schema").add_argument("contract", choices=sorted(CONTRACTS))
    fetched = commands.add_parser("fetch")
    fetched.add_argument("url")
    fetched.add_argument("--dns")
    local = commands.add_parser("ingest")
    local.add_argument("path")
    local.add_argument("--source-url")
    crawled = commands.add_parser("crawl")
    crawled.add_argument("url")
    crawled.add_argument("--links", required=True)
    crawled.add_argument("--max-pages", type=_positive)
    crawled.add_argument("--max-depth", type=int)
    crawled.add_argument("--resume", action="store_true")
    for p in (fetched, crawled):
        p.add_argument("--results", required=True)
        p.add_argument("--reader", choices=READERS, default="auto")
    for p in (fetched, local, crawled):
        p.add_argument("--output", required=True)
        _policy_flags(p)
    commands.add_parser("verify").add_argument("path")
    return parser


def _run(args) -> object:
    if args.command == "doctor":
        return doctor(args.providers)
    if args.command == "policy":
        return {"policy_sha256": load_policy(Path(args.file).read_text(encoding="utf-8")).digest()}
    if args.command == "schema":
        return schema(args.contract)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    if args.command == "fetch":
        return fetch_url(spark, args.url, args.results, args.output, _policy(args), args.reader, args.dns)
    if args.command == "ingest":
        return ingest(spark, args.path, args.output, _policy(args), args.source_url)
    if args.command == "crawl":
        return run_crawl(spark, args.url, args.links, args.results, args.output, _policy(args), args.reader, args.resume)
    if args.command == "verify":
        return verify_folder(spark, args.path)
    from lodestone.operators.search import search as run
    from lodestone.sources.workspace import DEFAULT_GLOBS, read_folder

    if not args.query.strip():
        raise Failed("invalid_input: search query must not be empty")
    files = read_folder(spark, args.root, args.include or DEFAULT_GLOBS)
    return [r.asDict() for r in run(files, spark.createDataFrame([(1, args.query)], "query_id long, query string"), args.limit).orderBy("rank").collect()]


def main(argv: list[str] | None = None) -> int:
    try:
        args = build_parser().parse_args(argv)
        out = _run(args)
        if args.command == "search" and args.format == "pretty":
            print("\n".join(f"{r['rank']}. {r['locator']}  {r['snippet']}" for r in out))
            return 0
        print(json.dumps(out, ensure_ascii=False, indent=2, default=str))
        return EXIT["verification_failed"] if args.command == "verify" and not out["valid"] else 0
    except (ValueError, KeyError, OSError) as e:
        code = str(e).split(":")[0] if str(e).split(":")[0] in EXIT else "invalid_input"
        print(json.dumps({"error": code, "message": str(e), "retryable": RETRY[code]}), file=sys.stderr)
        return EXIT[code]


if __name__ == "__main__":
    sys.exit(main())
