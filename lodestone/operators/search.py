"""Search of a corpus for a table of queries: exact lines first, relaxed ones where there are none.

Up to SCANNED_QUERIES queries are known to every task, and files are scanned for all of them in one pass (`line_scan`); no
text, line or pair is shuffled. More queries remain a table: their distinct terms are sought in the vocabulary of the
texts, whose words are cut into pairs and triples of characters, which meet the terms that begin with them by an equi-join;
the words that hold a term then meet the texts, of which the lines that hold each term are stored. Queries meet files by
the terms that they share, so no text is tried for a query that has none of its terms; scores of relaxed lines follow from
the stored lines alone. Texts are read again only for the pairs in which one line may hold the whole query, and for the
ranked results; they are never shuffled for small sets. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.functions import query as Q
from lodestone.functions.text import bind, compact, fold, lines, strip
from lodestone.operators.line_scan import scanner
from lodestone.session import cut_lineage

LINES_PER_FILE = 8
MOST_BYTES = 1_000_000
SNIPPET = 500
#: Rows of a counted table that may be broadcast.
FEW = 50_000
#: Terms so few that every line is scanned for each of them.
SCANNED = 24
#: Queries so few that all are scanned for in one pass over the files.
SCANNED_QUERIES = 4096


def workspace(docs: DataFrame) -> DataFrame:
    """Documents as files: path source/doc_id.txt, and text."""
    return docs.select(F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")


def planned(queries: DataFrame) -> DataFrame:
    """query_id, query, tokens, folded, and terms (folded tokens with their weights), of the queries that aren't empty."""
    q = queries.select("query_id", Q.normalized(F.col("query")).alias("query")).filter("query is not null")
    q = q.withColumn("tokens", Q.tokens(F.col("query")))
    return q.withColumn("folded", fold(F.col("query"))).withColumn("terms", F.transform("tokens", lambda t: F.struct(fold(t).alias("term"), Q.weight(t).alias("weight"))))


def _weights(terms: Column, folded: Column) -> Column:
    """Sum of the weights of the terms that the folded text holds."""
    return F.aggregate(terms, F.lit(0.0), lambda out, t: out + F.when(F.contains(folded, t["term"]), t["weight"]).otherwise(0.0))


def scored(hits: Column, folded_path: Column) -> Column:
    """Score, best line and terms of one file's kept lines (structs of line_no, snippet, folded)."""
    terms = F.col("terms")
    weighed = F.transform(hits, lambda h: F.struct((-_weights(terms, h["folded"])).alias("w"), h["line_no"].alias("line_no"), h["snippet"].alias("snippet")))
    in_path = F.size(F.filter(terms, lambda t: F.contains(folded_path, t["term"])))
    n = F.size("tokens")

    def score(x: Column) -> Column:
        best, combined = x["best"], x["combined"]
        found = F.filter(F.arrays_zip(F.col("tokens"), terms.alias("terms")), lambda z: F.contains(combined, z["terms"]["term"]))
        total = _weights(terms, combined) * 10 - best["w"] * 2 + in_path * 3 + F.when(F.contains(combined, F.col("folded")), 100).otherwise(0)
        return F.struct(
            F.round(total, 2).alias("relevance_score"),
            best["line_no"].alias("line_no"),
            best["snippet"].alias("snippet"),
            F.round(-best["w"], 2).alias("best_line_weight"),
            F.array_join(F.transform(found, lambda z: z["tokens"]), " ").alias("matched_terms"),
            F.when(n > 0, F.round(F.size(found) / n, 3)).otherwise(0.0).alias("term_coverage"),
            F.size(hits).cast("long").alias("matched_line_count"),
        )

    return bind(F.struct(F.array_min(weighed).alias("best"), F.array_join(F.transform(hits, lambda h: h["folded"]), " ").alias("combined")), score)


def _grams(word: Column) -> Column:
    """Distinct pairs and triples of neighbouring characters."""

    def of(chars: Column) -> Column:
        pair = lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1))
        n = F.size(chars)
        two = F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2), pair)).otherwise(F.array().cast("array<string>"))
        three = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.concat(pair(i), F.get(chars, i + 2)))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(two, three))

    return bind(F.split(word, ""), of)


def _few(rows: DataFrame) -> DataFrame:
    """A materialized table, to be broadcast if it is small by count."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def postings(files: DataFrame, terms: DataFrame) -> DataFrame:
    """path, term, lines: the lines (from 1; 0 is the path itself) that hold each term. files: path, lines (texts of
    lines); terms: term, of two characters or more, without white space."""
    keyed = cut_lineage(terms.select("term", F.left("term", F.lit(3)).alias("gram")).distinct())
    every = F.concat(F.array("name"), "lines")
    if keyed.count() <= SCANNED:  # so few that each is sought in each line
        sought = F.array(*[F.lit(r["term"]) for r in keyed.select("term").collect()]).cast("array<string>")
        at = F.transform(every, lambda v, k: F.struct(k.alias("k"), v.alias("v")))
        numbers = lambda t: F.transform(F.filter(at, lambda x: F.contains(x["v"], t)), lambda x: x["k"])
        return files.select("path", F.explode(F.transform(sought, lambda t: F.struct(t.alias("term"), numbers(t).alias("lines")))).alias("p")).select("path", "p.term", "p.lines").filter(F.size("lines") > 0)
    each = files.select("path", F.posexplode(every).alias("line_no", "line"))
    words = each.select("path", "line_no", F.explode(F.array_distinct(F.split("line", " "))).alias("word")).filter(F.length("word") > 1)
    grams = words.select("word").distinct().select("word", F.explode(_grams(F.col("word"))).alias("gram"))
    holding = _few(cut_lineage(grams.join(_few(keyed), "gram").filter(F.contains("word", F.col("term"))).select("word", "term")))
    found = words.join(holding, "word").select("path", "term", "line_no").repartition("path").distinct()  # one shuffle for both
    return found.groupBy("path", "term").agg(F.array_sort(F.collect_list("line_no")).alias("lines"))


def _paired(post: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, path and what follows from the lines of the terms that they share, for relaxed lines. asked: query_id, n, place, token, term, weight, seek (whether lines with it alone are kept)."""
    pairs = post.join(asked, "term").groupBy("query_id", "path").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "token", "weight", "seek", "lines"))).alias("t"))
    inside = F.filter(F.flatten(F.transform(F.filter("t", lambda x: x["seek"]), lambda x: x["lines"])), lambda k: k > 0)
    pairs = pairs.withColumn("kept", F.slice(F.array_sort(F.array_distinct(inside)), 1, LINES_PER_FILE))
    # tokens whose terms are equal, and terms sought as they are written, may be there twice; a place counts once
    held = F.filter("t", lambda x: ~F.startswith(x["token"], F.lit("\x00")))
    pairs = pairs.withColumn("t", held)

    def weight(k: Column) -> Column:
        return F.aggregate("t", F.lit(0.0), lambda out, x: out + F.when(F.array_contains(x["lines"], k), x["weight"]).otherwise(0.0))

    best = F.array_min(F.transform("kept", lambda k: F.struct((-weight(k)).alias("w"), k.alias("line_no"))))
    found = F.filter("t", lambda x: F.arrays_overlap(x["lines"], F.col("kept")))
    pairs = pairs.withColumn("best", best).withColumn("found", found)
    total = F.aggregate("found", F.lit(0.0), lambda out, x: out + x["weight"]) * 10 - F.col("best.w") * 2 + F.size(F.filter("t", lambda x: F.array_contains(x["lines"], 0))) * 3
    return pairs.select(
        "query_id",
        "path",
        "kept",
        total.alias("total"),
        F.col("best.line_no").cast("long").alias("line_no"),
        F.round(-F.col("best.w"), 2).alias("best_line_weight"),
        F.array_join(F.transform("found", lambda x: x["token"]), " ").alias("matched_terms"),
        F.round(F.size("found") / F.col("n"), 3).alias("term_coverage"),
        F.size("kept").cast("long").alias("matched_line_count"),
        ((F.size("kept") > 0) & (F.col("n") >= 2)).alias("loose"),
        (F.size("found") == F.col("n")).alias("all_kept"),
    )


_FOUND = (("path", T.StringType()), ("relaxed", T.BooleanType()), ("total", T.DoubleType()), ("line_no", T.LongType()), ("line", T.StringType()), ("weight", T.DoubleType()), ("matched_terms", T.StringType()), ("n_found", T.LongType()), ("matched_line_count", T.LongType()))
_RANKED = ("query_id", "query", "tokens", "path", "relevance_score", "line_no", "best_line_weight", "matched_terms", "term_coverage", "matched_line_count")


def _top(rows: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance_score"), "path")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit)


def search(files: DataFrame, queries: DataFrame, limit: int = 8, *, case_mode: str = "fold", relaxed: bool | None = None, cut: Callable[[Column], Column] = lines) -> DataFrame:
    """Ranked candidates of each query: query_id, rank, path, line_no, locator, snippet, score columns, variant.

    files: path (each once), text; queries: query_id (each once), query. `relaxed`: only the exact variant (False), only
    the relaxed one (True), or relaxed for the queries without exact matches. Files over 1 MB are skipped. Queries
    without a token meet every file, and have no relaxed lines. case_mode `smart`: an exact query, or the pattern of
    the first six tokens that relaxed lines must match, is taken as it is written if it has an upper-case letter. `cut`:
    the lines of a text.
    """
    if case_mode not in ("fold", "smart"):
        raise ValueError("case_mode is fold or smart")
    smart = case_mode == "smart"
    plans = cut_lineage(planned(queries))
    if plans.count() <= SCANNED_QUERIES:
        return _results(_scan(files, plans, limit, smart, relaxed, cut))
    few = plans.count() * Q.MOST_TOKENS <= FEW

    def small(rows: DataFrame) -> DataFrame:
        """A table of at most MOST_TOKENS rows for each query, to be broadcast if the queries are few."""
        return F.broadcast(rows) if few else rows

    files = files.filter((F.octet_length("text") <= MOST_BYTES) & F.col("path").isNotNull())
    plain = cut(F.col("text"))
    tokens = plans.select("query_id", F.size("tokens").alias("n"), F.posexplode(F.arrays_zip("tokens", F.col("terms"))).alias("place", "z"))
    own = F.lit(True)
    if smart:
        pattern = F.array_join(F.slice("tokens", 1, Q.PATTERN_TOKENS), "|")
        tokens = tokens.join(plans.select("query_id", (pattern != F.lower(pattern)).alias("strict")), "query_id")
        own = (F.col("place") < Q.PATTERN_TOKENS) & ~F.col("strict")
    asked = tokens.select("query_id", "n", "place", F.col("z.tokens").alias("token"), F.col("z.terms.term").alias("term"), F.col("z.terms.weight").alias("weight"), own.alias("seek"))
    folded_files = files.select("path", fold(F.col("path")).alias("name"), F.transform(plain, fold).alias("lines"))
    post = postings(folded_files, asked.select("term"))
    if smart:  # lines are kept for tokens as they are written, which are marked so as not to count as terms
        strict = tokens.filter(F.col("strict") & (F.col("place") < Q.PATTERN_TOKENS)).select("query_id", "n", "place", F.col("z.tokens").alias("written"))
        mark = lambda c: F.concat(F.lit("\x00"), c)
        asked = asked.unionByName(strict.select("query_id", "n", "place", mark(F.col("written")).alias("token"), mark(F.col("written")).alias("term"), F.lit(0.0).alias("weight"), F.lit(True).alias("seek")))
        as_written = postings(files.select("path", F.lit("").alias("name"), plain.alias("lines")), strict.select(F.col("written").alias("term")))
        post = post.unionByName(as_written.select("path", mark(F.col("term")).alias("term"), "lines"))
    post = cut_lineage(post)

    def read(rows: DataFrame) -> DataFrame:
        """The rows with their files' lines, and the folded path; only these files' texts are cut and folded."""
        each = F.transform(plain, lambda v, k: F.struct((k + 1).cast("long").alias("line_no"), strip(v).alias("snippet"), fold(strip(v)).alias("folded"), v.alias("line")))
        return files.join(rows, "path").withColumn("path_folded", fold(F.col("path"))).withColumn("lines", each).drop("text")

    def holds(v: Column) -> Column:
        inside = F.contains(fold(v["line"]), F.col("folded"))
        return F.when(F.col("query") == F.lower("query"), inside).otherwise(F.contains(v["line"], F.col("query"))) if smart else inside

    exact = None
    if relaxed is not True:
        every = post.select("path", "term").join(small(tokens.select("query_id", "n", F.col("z.terms.term").alias("term"))), "term")
        near = every.groupBy("query_id", "path").agg(F.count("*").alias("found"), F.first("n").alias("n")).filter("found = n").select("query_id", "path")
        bare = plans.filter(F.size("tokens") == 0).select("query_id")
        if not bare.isEmpty():
            near = near.unionByName(bare.withColumn("all", F.lit(1)).join(files.select("path", F.lit(1).alias("all")), "all").select("query_id", "path"))
        near = read(_few(cut_lineage(near))).join(small(plans), "query_id")
        hits = near.withColumn("hits", F.slice(F.filter("lines", holds), 1, LINES_PER_FILE)).filter(F.size("hits") > 0)
        hits = hits.select("query_id", "query", "tokens", "path", scored(F.col("hits"), F.col("path_folded")).alias("s")).select("query_id", "query", "tokens", "path", "s.*")
        exact = cut_lineage(_top(hits, limit).withColumn("relaxed", F.lit(False)))
    loose = None
    if relaxed is not False:
        if exact is not None:
            asked = asked.join(small(exact.select("query_id").distinct()), "query_id", "left_anti")
        pairs = cut_lineage(_paired(post, small(asked)).filter("loose"))
        # a line break may part the words of a query, which then stands in the kept lines as they are joined
        whole = read(_few(cut_lineage(pairs.filter("all_kept")))).join(small(plans.select("query_id", F.col("folded").alias("phrase"))), "query_id")
        joined = F.array_join(F.transform(F.filter("lines", lambda v: F.array_contains(F.col("kept").cast("array<bigint>"), v["line_no"])), lambda v: v["folded"]), " ")
        whole = whole.withColumn("total", F.col("total") + F.when(F.contains(joined, F.col("phrase")), 100).otherwise(0))
        names = [c for c in _RANKED if c not in ("query", "tokens", "relevance_score")]
        score = F.round("total", 2).alias("relevance_score")
        ranked = _top(pairs.filter("not all_kept").select(*names, score), limit).drop("rank").unionByName(whole.select(*names, score))
        top = _few(cut_lineage(_top(ranked, limit)))
        line = F.get(F.col("lines"), (F.col("line_no") - 1).cast("int"))["snippet"]
        loose = read(top).withColumn("snippet", line).join(small(plans.select("query_id", "query", "tokens")), "query_id").withColumn("relaxed", F.lit(True))
    columns = [*_RANKED, "snippet", "rank", "relaxed"]
    parts = [x.select(*columns) for x in (exact, loose) if x is not None]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _results(rows)


def _scan(files: DataFrame, plans: DataFrame, limit: int, smart: bool, relaxed: bool | None, cut: Callable[[Column], Column]) -> DataFrame:
    """What `search` ranks, in one pass over the files; the queries are few enough for each task to know them all."""
    pattern = F.array_join(F.slice("tokens", 1, Q.PATTERN_TOKENS), "|")
    strict = F.lit(smart) & (pattern != F.lower(pattern))
    known = plans.select("query_id", "query", "tokens", "terms", "folded", (~F.lit(smart) | (F.col("query") == F.lower("query"))).alias("plain"), F.when(strict, F.slice("tokens", 1, Q.PATTERN_TOKENS)).alias("written"))
    shape = T.StructType([plans.schema["query_id"], *[T.StructField(n, k) for n, k in _FOUND]])
    run = scanner([r.asDict(True) for r in known.collect()], limit, LINES_PER_FILE, Q.PATTERN_TOKENS if smart else None, relaxed, to_arrow_schema(shape))
    files = files.filter((F.octet_length("text") <= MOST_BYTES) & F.col("path").isNotNull())
    rows = files.select("path", fold(F.col("path")).alias("name"), cut(F.col("text")).alias("lines"), cut(fold(F.col("text"))).alias("folded")).mapInArrow(run, shape)
    if relaxed is None:  # relaxed rows only for queries without exact ones
        rows = rows.withColumn("_first", F.min("relaxed").over(Window.partitionBy("query_id"))).filter("relaxed = _first")
    elif not relaxed:
        rows = rows.filter("not relaxed")
    rows = cut_lineage(_top(rows.withColumn("relevance_score", F.round("total", 2)), limit)).join(F.broadcast(plans.select("query_id", "query", "tokens")), "query_id")
    n = F.size("tokens")
    return rows.withColumns({"best_line_weight": F.round("weight", 2), "snippet": strip(F.col("line")), "term_coverage": F.when(n > 0, F.round(F.col("n_found") / n, 3)).otherwise(0.0)})


def _results(rows: DataFrame) -> DataFrame:
    return rows.select(
        "query_id",
        "rank",
        "path",
        "line_no",
        F.concat_ws(":", "path", F.col("line_no").cast("string")).alias("locator"),
        compact(F.col("snippet"), SNIPPET).alias("snippet"),
        "relevance_score",
        "best_line_weight",
        "matched_terms",
        "term_coverage",
        "matched_line_count",
        F.col("relaxed").alias("query_relaxed"),
        F.when(F.col("relaxed"), Q.relaxed_pattern(F.col("tokens"))).otherwise(F.col("query")).alias("query_variant"),
    )


def candidates(found: DataFrame, *, provider: str = "workspace", scope: str = "local") -> DataFrame:
    """Search results in the shape that all providers share, for merging."""
    return found.select(
        "query_id",
        F.lit(provider).alias("provider"),
        F.lit(scope).alias("scope"),
        (F.col("rank") - 1).alias("idx"),
        F.col("path").alias("title"),
        "locator",
        "snippet",
        F.lit("workspace-source").alias("source_class"),
        F.lit("local-source-match").alias("evidence_state"),
        F.lit("project").alias("sensitivity"),
    )
