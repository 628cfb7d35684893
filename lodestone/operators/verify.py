"""Verification as queries that return violations; an empty result is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.ids import safe_child, sha256
from lodestone.functions.text import bind, lines
from lodestone.operators.anchors import anchor_mismatches
from lodestone.operators.crawl import crawl_status, failures_by_code, status_counts

DERIVED = ("normalized", "anchors", "links")
_RECEIPT = ("status", "route", "remote_adapter_used", "authenticated_adapter_used", "source_bytes", "source_sha256", "normalized_chars", "anchor_count", "link_count")
_ANCHOR = "kind string, heading string, line_start bigint, line_end bigint, sha256 string, preview string, anchor_id string"
DERIVED_PATHS = {"normalized": "normalized.md", "anchors": "anchors.jsonl", "links": "links.json"}


def artifact_violations(stated: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, failure. stated: keys, role, path, sha256, bytes; there: keys, path, body. One full outer join."""
    found = there.select(*keys, "path", F.octet_length("body").cast("long").alias("_bytes"), sha256(F.col("body")).alias("_sha"), F.lit(True).alias("_there"))
    # a path that is stated twice is one row for each statement
    times = stated.groupBy(*keys, "path").agg(F.count("*").alias("_times"))
    rows = stated.withColumn("_stated", F.lit(True)).join(times, [*keys, "path"]).join(found, [*keys, "path"], "full_outer")
    checks = [
        ("duplicate artifact path", F.col("_times") > 1),
        ("unsafe artifact path", F.col("_stated") & ~safe_child(F.col("path"))),
        ("missing artifact", F.col("_stated") & F.col("_there").isNull()),
        ("byte count mismatch", F.col("_stated") & (F.col("_bytes") != F.col("bytes"))),
        ("sha256 mismatch", F.col("_stated") & (F.col("_sha") != F.col("sha256"))),
        ("unexpected bundle entry", F.col("_stated").isNull()),
    ]
    return rows.select(*keys, "path", F.explode(F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in checks]), lambda x: x.isNotNull())).alias("failure"))


def layout_violations(receipts: DataFrame, artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, failure: roles of a bundle against its status. receipts: keys, status; artifacts: keys, role, path."""
    roles = artifacts.groupBy(*keys).agg(F.count_if(F.col("role") == "raw").alias("raws"), F.count("*").alias("n"), F.collect_set("role").alias("roles"), F.count_if((F.col("role") == "raw") & ~F.col("path").rlike(r"^raw\.[a-z]+$")).alias("odd"))
    rows = receipts.join(roles, keys, "left")
    derived = F.size(F.array_intersect(F.coalesce("roles", F.array().cast("array<string>")), F.array(*[F.lit(r) for r in DERIVED])))
    checks = [
        ("duplicate artifact role", F.col("n") > F.size("roles")),
        ("bundle must hold exactly one raw artifact", F.coalesce("raws", F.lit(0)) != 1),
        ("unexpected raw artifact path", F.col("odd") > 0),
        ("derived artifacts must appear together", ~derived.isin(0, len(DERIVED))),
        ("complete receipt must hold derived artifacts", (F.col("status") == "complete") & (derived < len(DERIVED))),
    ]
    return rows.select(*keys, F.explode(F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in checks]), lambda x: x.isNotNull())).alias("failure"))


def path_violations(artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, failure: derived artifacts of another file name than theirs. artifacts: keys, role, path."""
    odd = F.lit(False)
    for role, path in DERIVED_PATHS.items():
        odd = odd | ((F.col("role") == role) & (F.col("path") != path))
    return artifacts.filter(odd).select(*keys, F.concat(F.lit("unexpected "), "role", F.lit(" artifact path: "), "path").alias("failure"))


def flag_violations(receipts: DataFrame, attempts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, failure: policy flags against the route and the tries.

    receipts: keys, route (array), remote_adapter_used, authenticated_adapter_used; attempts: keys, status,
    remote_adapter, authenticated_adapter.
    """
    tried = attempts.filter("status <> 'skipped'").groupBy(*keys).agg(F.bool_or("remote_adapter").alias("_remote"), F.bool_or("authenticated_adapter").alias("_authenticated"))
    rows = receipts.join(tried, keys, "left")
    no = F.lit(False)
    remote = F.coalesce(F.arrays_overlap("route", F.array(F.lit("jina"), F.lit("firecrawl"))), no) | F.coalesce("_remote", no)
    authenticated = F.coalesce(F.array_contains("route", "firecrawl"), no) | F.coalesce("_authenticated", no)
    checks = [
        ("remote adapter policy flag does not match route", ~F.col("remote_adapter_used").eqNullSafe(remote)),
        ("authenticated adapter policy flag does not match route", ~F.col("authenticated_adapter_used").eqNullSafe(authenticated)),
    ]
    return rows.select(*keys, F.explode(F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in checks]), lambda x: x.isNotNull())).alias("failure"))


def source_violations(receipts: DataFrame, stated: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """keys, failure: the source a receipt states against its raw artifact, where the bundle has just one.

    receipts: keys, source_bytes, source_sha256; stated: keys, role, path; there: keys, path, body.
    """
    found = there.select(*keys, "path", F.octet_length("body").cast("long").alias("_bytes"), sha256(F.col("body")).alias("_sha"))
    raw = stated.filter("role = 'raw'").join(found, [*keys, "path"]).groupBy(*keys).agg(F.count("*").alias("_n"), F.first("_bytes").alias("_bytes"), F.first("_sha").alias("_sha")).filter("_n = 1")
    checks = [
        ("source byte count does not match raw artifact", ~F.col("source_bytes").eqNullSafe(F.col("_bytes"))),
        ("source sha256 does not match raw artifact", ~F.col("source_sha256").eqNullSafe(F.col("_sha"))),
    ]
    return receipts.join(raw, keys).select(*keys, F.explode(F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in checks]), lambda x: x.isNotNull())).alias("failure"))


def derived_violations(receipts: DataFrame, markdown: DataFrame, anchors: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """keys, failure: counts and hashes of derived artifacts. receipts: keys, normalized_chars, anchor_count, link_count."""
    n_anchors, n_links = anchors.groupBy(*keys).agg(F.count("*").alias("_a")), links.groupBy(*keys).agg(F.count("*").alias("_l"))
    rows = receipts.join(markdown.select(*keys, F.length("markdown").alias("_c")), keys, "left").join(n_anchors, keys, "left").join(n_links, keys, "left")
    checks = [("normalized character count mismatch", "normalized_chars", "_c"), ("anchor count mismatch", "anchor_count", "_a"), ("link count mismatch", "link_count", "_l")]
    counts = rows.select(*keys, F.explode(F.filter(F.array(*[F.when(F.col(a) != F.coalesce(F.col(b), F.lit(0)), F.lit(name)) for name, a, b in checks]), lambda x: x.isNotNull())).alias("failure"))
    return counts.unionByName(anchor_mismatches(markdown, anchors, keys).select(*keys, "failure"))


def file_violations(receipts: DataFrame, stated: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """keys, failure: what the derived files of bundles hold, against each other and the receipt.

    receipts: keys, normalized_chars, anchor_count, link_count; stated: keys, role, path; there: keys, path, body
    (binary). Lines of anchors and links that can't be read are failures of their own, and counted as not there.
    """
    files = stated.filter(F.col("role").isin(*DERIVED)).dropDuplicates([*keys, "role"]).join(there.select(*keys, "path", F.col("body").cast("binary").alias("body")), [*keys, "path"])
    texts = files.select(*keys, "role", F.try_validate_utf8(F.col("body").cast("string")).alias("text"))
    wrong = texts.filter(F.col("text").isNull() & (F.col("role") != "links")).select(*keys, F.concat("role", F.lit(" artifact is not UTF-8")).alias("failure"))
    none = receipts.join(files.select(*keys).distinct(), keys, "left_anti").filter("normalized_chars <> 0").select(*keys, F.lit("normalized character count must be zero without derived artifacts").alias("failure"))
    anchor_lines = F.filter(F.split("text", "\n"), lambda v: F.trim(v) != "")
    rows = texts.filter("role = 'anchors' and text is not null").select(*keys, F.posexplode(anchor_lines).alias("pos", "line")).withColumn("a", F.from_json("line", _ANCHOR))
    fine = F.col("a.kind").isNotNull() & F.col("a.line_start").isNotNull() & F.col("a.line_end").isNotNull() & F.col("a.sha256").isNotNull()
    odd = rows.filter(~F.coalesce(fine, F.lit(False))).select(*keys, F.concat(F.lit("invalid anchor line "), (F.col("pos") + 1).cast("string")).alias("failure"))
    found = rows.filter(F.coalesce(fine, F.lit(False))).select(*keys, "pos", "a.*")
    listed = texts.filter("role = 'links'").withColumn("l", F.from_json("text", "array<struct<text:string,url:string>>"))
    whole = F.col("l").isNotNull() & F.coalesce(F.forall("l", lambda x: x["url"].isNotNull() & x["text"].isNotNull()), F.lit(False)) & F.startswith(F.ltrim(F.coalesce("text", F.lit(""))), F.lit("["))
    bad = listed.filter(~F.coalesce(whole, F.lit(False))).select(*keys, F.lit("invalid links artifact").alias("failure"))
    links = listed.filter(F.coalesce(whole, F.lit(False))).select(*keys, F.explode("l").alias("link"))
    markdown = texts.filter("role = 'normalized' and text is not null").select(*keys, F.col("text").alias("markdown"))
    derived = derived_violations(receipts.join(files.select(*keys).distinct(), keys, "left_semi"), markdown, found, links, keys)
    return reduce(DataFrame.unionByName, [wrong, none, odd, bad, derived])


def bundle_violations(receipts: DataFrame, stated: DataFrame, there: DataFrame, attempts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, failure: every rule of evidence bundles. receipts: keys, status, route, remote_adapter_used,
    authenticated_adapter_used, source_bytes, source_sha256, normalized_chars, anchor_count, link_count; attempts: keys,
    status, remote_adapter, authenticated_adapter; stated and there as for `artifact_violations`. A bundle becomes one row:
    each of its files is shuffled once."""
    gathered = lambda rows, name, *columns: rows.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias(name))
    parts = [
        gathered(stated, "stated", "role", "path", "sha256", "bytes"),
        gathered(there, "there", "path", F.col("body").cast("binary").alias("body")),
        gathered(attempts, "attempts", "status", "remote_adapter", "authenticated_adapter"),
    ]
    rows = receipts.select(*keys, *_RECEIPT, F.lit(True).alias("known"))
    rows = reduce(lambda out, part: out.join(part, keys, "left" if "attempts" in part.columns else "full_outer"), parts, rows)
    for part in parts:
        name = part.columns[-1]
        rows = rows.withColumn(name, F.coalesce(name, F.filter(F.array(F.lit(None).cast(part.schema[name].dataType.elementType)), lambda x: x.isNotNull())))
    return packed_violations(rows.withColumn("known", F.coalesce("known", F.lit(False))), keys)


def _present(checks: list[tuple[str, Column]]) -> Column:
    """The names of the checks that hold, as an array."""
    return F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in checks]), lambda x: x.isNotNull())


def _artifact_failures(stated: Column, found: Column) -> Column:
    """As `artifact_violations`, of one bundle. found: structs of path, bytes, sha."""

    def of(s: Column) -> Column:
        own = F.filter(found, lambda f: f["path"] == s["path"])
        checks = [
            ("duplicate artifact path", F.size(F.filter(stated, lambda o: o["path"] == s["path"])) > 1),
            ("unsafe artifact path", ~safe_child(s["path"])),
            ("missing artifact", F.size(own) == 0),
            ("byte count mismatch", F.exists(own, lambda f: f["bytes"] != s["bytes"])),
            ("sha256 mismatch", F.exists(own, lambda f: f["sha"] != s["sha256"])),
        ]
        return F.transform(_present(checks), lambda x: F.concat_ws(": ", x, s["path"]))

    more = F.filter(found, lambda f: ~F.coalesce(F.exists(stated, lambda s: s["path"] == f["path"]), F.lit(False)))
    return F.array_distinct(F.concat(F.flatten(F.transform(stated, of)), F.transform(more, lambda f: F.concat_ws(": ", F.lit("unexpected bundle entry"), f["path"]))))


def _layout_failures(stated: Column) -> Column:
    """As `layout_violations` and `path_violations`, of one bundle."""
    roles = F.array_distinct(F.filter(F.transform(stated, lambda s: s["role"]), lambda r: r.isNotNull()))
    raw = F.filter(stated, lambda s: s["role"] == "raw")
    derived = F.size(F.array_intersect(roles, F.array(*[F.lit(r) for r in DERIVED])))
    checks = [
        ("duplicate artifact role", F.size(stated) > F.size(roles)),
        ("bundle must hold exactly one raw artifact", F.size(raw) != 1),
        ("unexpected raw artifact path", F.exists(raw, lambda s: ~s["path"].rlike(r"^raw\.[a-z]+$"))),
        ("derived artifacts must appear together", ~derived.isin(0, len(DERIVED))),
        ("complete receipt must hold derived artifacts", (F.col("status") == "complete") & (derived < len(DERIVED))),
    ]
    odd = F.filter(stated, lambda s: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in DERIVED_PATHS.items() for x in pair]), s["role"]) != s["path"], F.lit(False)))
    return F.concat(F.when(F.col("known"), _present(checks)).otherwise(F.array().cast("array<string>")), F.transform(odd, lambda s: F.concat(F.lit("unexpected "), s["role"], F.lit(" artifact path: "), s["path"])))


def _receipt_failures(stated: Column, found: Column) -> Column:
    """As `flag_violations` and `source_violations`, of one bundle."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    used = F.filter("attempts", lambda a: a["status"] != "skipped")
    remote = yes(F.arrays_overlap("route", F.array(F.lit("jina"), F.lit("firecrawl")))) | yes(F.exists(used, lambda a: a["remote_adapter"]))
    authenticated = yes(F.array_contains("route", "firecrawl")) | yes(F.exists(used, lambda a: a["authenticated_adapter"]))
    raw = F.flatten(F.transform(F.filter(stated, lambda s: s["role"] == "raw"), lambda s: F.filter(found, lambda f: f["path"] == s["path"])))
    one = lambda name: F.get(raw, 0)[name]
    checks = [
        ("remote adapter policy flag does not match route", ~F.col("remote_adapter_used").eqNullSafe(remote)),
        ("authenticated adapter policy flag does not match route", ~F.col("authenticated_adapter_used").eqNullSafe(authenticated)),
        ("source byte count does not match raw artifact", (F.size(raw) == 1) & ~F.col("source_bytes").eqNullSafe(one("bytes"))),
        ("source sha256 does not match raw artifact", (F.size(raw) == 1) & ~F.col("source_sha256").eqNullSafe(one("sha"))),
    ]
    return F.when(F.col("known"), _present(checks)).otherwise(F.array().cast("array<string>"))


def _file_failures(stated: Column, there: Column) -> Column:
    """As `file_violations`, of one bundle."""
    empty = F.array().cast("array<string>")
    some = lambda *checks: F.filter(F.array(*checks), lambda x: x.isNotNull())

    def file(role: str) -> Column:
        path = F.get(F.filter(stated, lambda s: s["role"] == role), 0)["path"]
        return bind(F.get(F.filter(there, lambda f: f["path"] == path), 0), lambda f: F.struct(f.isNotNull().alias("there"), F.try_validate_utf8(f["body"].cast("string")).alias("text")))

    def parsed(x: Column) -> Column:
        rows = F.transform(F.filter(F.split(x["anchors"]["text"], "\n"), lambda v: F.trim(v) != ""), lambda v, k: F.struct((k + 1).alias("n"), F.from_json(v, _ANCHOR).alias("a")))
        return F.struct(F.coalesce(rows, F.array().cast(f"array<struct<n:int,a:struct<{_ANCHOR.replace(' ', ':')}>>>".replace(",:", ","))).alias("rows"), F.from_json(x["links"]["text"], "array<struct<text:string,url:string>>").alias("links"))

    def fine(r: Column) -> Column:
        return r["a"]["kind"].isNotNull() & r["a"]["line_start"].isNotNull() & r["a"]["line_end"].isNotNull() & r["a"]["sha256"].isNotNull()

    def mismatch(all_lines: Column, a: Column) -> Column:
        inside = (a["line_start"] >= 1) & (a["line_end"] >= a["line_start"]) & (a["line_end"] <= F.size(all_lines))
        part = F.array_join(F.slice(all_lines, F.greatest(a["line_start"], F.lit(1)).cast("int"), F.greatest(a["line_end"] - a["line_start"] + 1, F.lit(0)).cast("int")), "\n")
        return F.when(~inside, "anchor range invalid").when(sha256(part) != a["sha256"], "anchor sha256 mismatch")

    def of(x: Column) -> Column:
        held = x["normalized"]["there"] | x["anchors"]["there"] | x["links"]["there"]
        markdown, listed = x["normalized"]["text"], x["links"]["text"]
        own = some(
            F.when(x["normalized"]["there"] & markdown.isNull(), "normalized artifact is not UTF-8"),
            F.when(x["anchors"]["there"] & x["anchors"]["text"].isNull(), "anchors artifact is not UTF-8"),
            F.when(~held & (F.col("normalized_chars") != 0), "normalized character count must be zero without derived artifacts"),
            F.when(held & (F.col("normalized_chars") != F.coalesce(F.length(markdown), F.lit(0))), "normalized character count mismatch"),
        )

        def rest(y: Column) -> Column:
            whole = F.coalesce(y["links"].isNotNull() & F.forall(y["links"], lambda v: v["url"].isNotNull() & v["text"].isNotNull()) & F.startswith(F.ltrim(listed), F.lit("[")), F.lit(False))
            odd = F.transform(F.filter(y["rows"], lambda r: ~F.coalesce(fine(r), F.lit(False))), lambda r: F.concat(F.lit("invalid anchor line "), r["n"].cast("string")))
            found = F.filter(y["rows"], lambda r: F.coalesce(fine(r), F.lit(False)))
            counts = some(
                F.when(x["links"]["there"] & ~whole, "invalid links artifact"),
                F.when(held & (F.col("anchor_count") != F.size(found)), "anchor count mismatch"),
                F.when(held & (F.col("link_count") != F.when(whole, F.size(y["links"])).otherwise(0)), "link count mismatch"),
            )
            wrong = bind(lines(markdown), lambda v: F.filter(F.transform(found, lambda r: mismatch(v, r["a"])), lambda m: m.isNotNull()))
            return F.concat(odd, counts, F.when(markdown.isNotNull(), wrong).otherwise(empty))

        return F.concat(own, bind(parsed(x), rest))

    return bind(F.struct(*[file(r).alias(r) for r in DERIVED]), of)


def packed_violations(bundles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, failure: every rule of evidence bundles, each of which is one row; nothing is shuffled.

    bundles: keys, known (whether there is a receipt), the columns of receipts as in `bundle_violations`, and arrays of
    structs: stated (role, path, sha256, bytes), there (path, body: binary), attempts (status, remote_adapter,
    authenticated_adapter).
    """
    facts = F.transform("there", lambda f: F.struct(f["path"].alias("path"), F.octet_length(f["body"]).cast("long").alias("bytes"), F.sha2(f["body"], 256).alias("sha")))
    stated = F.col("stated")
    of = bind(facts, lambda found: F.concat(_artifact_failures(stated, found), _layout_failures(stated), _receipt_failures(stated, found), _file_failures(stated, F.col("there"))))
    return bundles.select(*keys, F.explode(of).alias("failure"))


def state_digests(pages: DataFrame) -> DataFrame:
    """crawl_id, state_sha256 of the state of each crawl; its pages are bounded by the policy."""
    row = F.to_json(F.struct("url", "depth", "status", "bundle_path", "error_code", "added_seq"))
    return pages.groupBy("crawl_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n").cast("binary"), 256).alias("state_sha256"))


def state_violations(stated: DataFrame, jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """crawl_id, failure: crawl receipts against their job's row and state. stated and jobs: crawl_id, root_url, reader,
    policy_sha256, created_at, max_pages, max_depth; stated also crawl_state_sha256."""
    names = ("root_url", "reader", "policy_sha256", "created_at", "max_pages", "max_depth")
    other = jobs.select("crawl_id", F.struct(*names).alias("_job"))
    rows = stated.join(other, "crawl_id", "left").join(state_digests(pages), "crawl_id", "left")
    checks = [F.when(F.col("_job").isNull(), "invalid crawl state"), F.when(~F.col("crawl_state_sha256").eqNullSafe(F.col("state_sha256")), "crawl state sha256 mismatch")]
    checks += [F.when(F.col("_job").isNotNull() & ~F.col(n).eqNullSafe(F.col(f"_job.{n}")), f"crawl state metadata mismatch: {n}") for n in names]
    return rows.select("crawl_id", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("failure"))


def crawl_violations(stated: DataFrame, pages: DataFrame, stated_pages: DataFrame) -> DataFrame:
    """crawl_id, url, failure: a crawl receipt against its state.

    stated: crawl_id, status, max_pages, max_depth; pages (state) and stated_pages: crawl_id, url, depth, status,
    bundle_path, error_code.
    """
    none = F.lit(None).cast("string").alias("url")
    limits = stated_pages.join(stated.select("crawl_id", "max_depth"), "crawl_id")
    twice = stated_pages.groupBy("crawl_id", "url").count().filter("count > 1").select("crawl_id", "url", F.lit("duplicate URL").alias("failure"))
    rules = [("page exceeds max_depth", F.col("depth") > F.col("max_depth")), ("complete page lacks bundle_path", (F.col("status") == "complete") & F.col("bundle_path").isNull()), ("page that isn't complete has bundle_path", (F.col("status") != "complete") & F.col("bundle_path").isNotNull())]
    own = [limits.filter(broken).select("crawl_id", "url", F.lit(name).alias("failure")) for name, broken in rules]
    folded = crawl_status(status_counts(stated_pages, ["crawl_id"]).join(stated.select("crawl_id", "max_pages", F.col("status").alias("_status")), "crawl_id"), F.col("max_pages"))
    status = folded.filter("crawl_status <> _status").select("crawl_id", none, F.lit("crawl status mismatch").alias("failure"))
    sides = [p.select("crawl_id", "url", F.struct("depth", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")).alias("status"), "error_code").alias(name)) for p, name in ((pages, "_a"), (stated_pages, "_b"))]
    differ = sides[0].join(sides[1], ["crawl_id", "url"], "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("crawl_id", "url", F.lit("page projection mismatch").alias("failure"))
    return reduce(DataFrame.unionByName, [twice, *own, status, differ])


def page_bundle_violations(pages: DataFrame, receipts: DataFrame) -> DataFrame:
    """crawl_id, url, failure: complete pages whose bundle is missing or was made for another URL.

    pages: crawl_id, url, status, bundle_path; receipts: bundle_path, requested_url.
    """
    rows = pages.filter("status = 'complete'").join(receipts, "bundle_path", "left")
    failure = F.when(F.col("requested_url").isNull(), "missing bundle").when(F.col("requested_url") != F.col("url"), "page URL does not match bundle")
    return rows.select("crawl_id", "url", failure.alias("failure")).filter("failure is not null")


def target_kind(names: set[str]) -> str:
    """What a folder holds, by its file names: a bundle before a crawl."""
    for name, kind in (("receipt.json", "bundle"), ("crawl-receipt.json", "crawl")):
        if name in names:
            return kind
    raise ValueError("invalid_input: no receipt in the folder")


def code_violations(stated_codes: DataFrame, pages: DataFrame) -> DataFrame:
    """crawl_id, error_code, failure: stated failure counts (crawl_id, error_code, n) against the pages."""
    rows = stated_codes.join(failures_by_code(pages, ["crawl_id"]), ["crawl_id", "error_code"], "full_outer")
    return rows.filter(~F.coalesce("n", F.lit(0)).eqNullSafe(F.coalesce("pages", F.lit(0)))).select("crawl_id", "error_code", F.lit("failures_by_code mismatch").alias("failure"))


def summary(ids: DataFrame, violations: DataFrame, keys: list[str]) -> DataFrame:
    """keys, valid, failures (sorted) for each bundle or crawl."""
    bad = violations.groupBy(*keys).agg(F.array_sort(F.collect_set("failure")).alias("failures"))
    return ids.select(*keys).distinct().join(bad, keys, "left").select(*keys, F.col("failures").isNull().alias("valid"), F.coalesce("failures", F.array().cast("array<string>")).alias("failures"))
