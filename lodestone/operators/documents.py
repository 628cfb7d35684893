"""Documents: HTML and JSON to Markdown, routes with fallback, and receipts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions.ids import media_type, raw_name, receipt_id, sha256
from lodestone.session import row_by_row

MIN_CHARS = 160
DROPPED = {"script", "style", "noscript", "template", "svg"}
BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "ul", "ol", "table", "tr", "blockquote", "pre", "figure", "form", "body", "html", "h1", "h2", "h3", "h4", "h5", "h6", "li", "title"}
VOID = {"br", "hr", "img", "meta", "link", "input", "source", "area", "base", "col", "wbr"}
CONTAINERS = ("main", "article", "body")
#: Elements within elements beyond which a page's markup is taken as text; tags that are never closed nest without end.
MOST_DEPTH = 200


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs=None, parent=None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs or {}, parent, []

    def find(self, tag):
        stack = [self]
        while stack:
            node = stack.pop()
            if node.tag == tag:
                return node
            stack += [c for c in reversed(node.children) if isinstance(c, _Node)]
        return None

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if isinstance(node, _Node):
                stack += list(reversed(node.children))

    def text(self) -> str:
        return " ".join(" ".join(x for x in self.walk() if isinstance(x, str)).split())


class _Tree(HTMLParser):
    """A forgiving tree: an unclosed p, li or tr ends where the next begins; stray end tags are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("")
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.skip += 1
        if self.skip:
            return
        if tag in ("p", "li", "tr") and self.at.tag == tag:
            self.at = self.at.parent
        node = _Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
            return
        node = self.at
        while node and node.tag != tag:
            node = node.parent
        if node and node.parent and not self.skip:
            self.at = node.parent

    def handle_data(self, data):
        if not self.skip:
            self.at.children.append(data)


def parse(markup: str) -> _Node:
    tree = _Tree()
    tree.feed(markup)
    tree.close()
    return tree.root


def _markdown(node: _Node | str, base: str, depth: int = 0) -> str:
    if isinstance(node, str):
        return re.sub(r"\s+", " ", node)
    if depth > MOST_DEPTH:
        return f" {node.text()} "
    inner = "".join(_markdown(c, base, depth + 1) for c in node.children)
    tag, line = node.tag, inner.strip()
    if tag == "title" or tag == "head":
        return ""
    if re.fullmatch("h[1-6]", tag):
        return f"\n\n{'#' * int(tag[1])} {line}\n\n" if line else ""
    if tag == "li":
        return f"\n- {line}" if line else ""
    if tag == "a":
        href = node.attrs.get("href")
        return f"[{line}]({urljoin(base, href)})" if line and href else inner
    if tag in ("b", "strong"):
        return f"**{line}**" if line else ""
    if tag in ("i", "em"):
        return f"*{line}*" if line else ""
    if tag == "code":
        return f"`{line}`" if line else ""
    if tag == "pre":
        return f"\n\n```\n{node.text()}\n```\n\n"
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n---\n\n"
    if tag == "img":
        return f"![{node.attrs.get('alt') or ''}]({urljoin(base, node.attrs.get('src') or '')})"
    return f"\n\n{line}\n\n" if tag in BLOCKS else inner


def clean(text: str) -> str:
    """As functions.text.clean_markdown, for one text."""
    text = re.sub(r"[ \t]+\n", "\n", text.replace("\r\n", "\n").replace("\r", "\n"))
    text = re.sub(r"\n{4,}", "\n\n\n", text).strip()
    return text + "\n" if text else ""


def markdown_title(text: str) -> str | None:
    """As functions.text.markdown_title, for one text."""
    found = re.search(r"(?m)^#\s+(.+?)\s*$", text)
    return found[1] if found else None


def links_of_markdown(text: str, base: str) -> list[dict]:
    """As functions.text.markdown_links, for one text: inline links in order, resolved, the first of each text and target."""
    out = {}
    for name, href in re.findall(r"""\[([^\]]+)\]\(([^)\s]+)(?:\s+['"][^'"]*['"])?\)""", text):
        try:
            url = urljoin(base, href)
        except ValueError:
            continue
        if url.startswith(("http://", "https://")):
            out[" ".join(name.split()), url] = None
    return [{"text": t, "url": u} for t, u in out]


#: Media types and endings of file names that each conversion takes.
HTML_TYPES, JSON_TYPES, XML_TYPES = ("text/html", "application/xhtml+xml"), ("application/json", "application/ld+json"), ("application/xml", "application/rss+xml", "application/atom+xml")
HTML_ENDS, JSON_ENDS, TEXT_ENDS = (".html", ".htm"), (".json",), (".md", ".markdown", ".txt", ".xml", ".csv", ".yaml", ".yml")
TYPES = {".html": "text/html", ".htm": "text/html", ".json": "application/json", ".md": "text/markdown", ".markdown": "text/markdown", ".txt": "text/plain", ".xml": "application/xml", ".csv": "text/csv", ".yaml": "application/yaml", ".yml": "application/yaml", ".pdf": "application/pdf"}


def kind_of_type(content_type: str | None) -> str:
    """As normalizer(), for one media type."""
    kind = (content_type or "").split(";")[0].strip().lower()
    return "html" if kind in HTML_TYPES else "json" if kind in JSON_TYPES else "text" if kind.startswith("text/") or kind in XML_TYPES else "external"


def kind_of_suffix(suffix: str) -> str:
    return "html" if suffix in HTML_ENDS else "json" if suffix in JSON_ENDS else "text" if suffix in TEXT_ENDS else "external"


def type_by_suffix(suffix: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, suffix), F.lit("application/octet-stream"))


def convert(markup: str, base: str = "", scope: str = "content") -> dict:
    """title, markdown, links ([text, url]) and warnings of one page.

    The content is main, else article, else body; one of under 160 characters gives way to the body. `scope`: links
    of the content, or of the whole document.
    """
    root = parse(markup)
    title, content = root.find("title"), _content(root)
    links = _links(root if scope == "document" else content, base)
    markdown = clean(re.sub(r"[ ]{2,}(?!\n)", " ", _markdown(content, base)))
    name = title.text() if title else None
    if not name:
        found = re.search(r"(?m)^#\s+(.+?)\s*$", markdown)
        name = found[1] if found else None
    return {"title": name, "markdown": markdown, "links": links, "warnings": ["decode_replacement_characters_present"] if "�" in markdown else []}


def _content(root: _Node) -> _Node:
    body = root.find("body")
    content = next((n for n in map(root.find, CONTAINERS) if n), root)
    return body if len(content.text()) < MIN_CHARS and body else content


def _links(within: _Node, base: str) -> list[dict]:
    links = {}
    for a in within.walk():
        if isinstance(a, _Node) and a.tag == "a" and a.attrs.get("href"):
            try:
                url = urljoin(base, a.attrs["href"])
            except ValueError:
                continue
            if url.startswith(("http://", "https://")) and (text := a.text()):
                links[text, url] = None
    return [{"text": t, "url": u} for t, u in links]


def links_of_html(markup: str, base: str = "", scope: str = "content") -> list[dict]:
    """The links of `convert` alone."""
    root = parse(markup)
    return _links(root if scope == "document" else _content(root), base)


_LINKS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("url", T.StringType())]))
_CONVERTED = T.StructType([T.StructField("title", T.StringType()), T.StructField("markdown", T.StringType()), T.StructField("links", _LINKS), T.StructField("warnings", T.ArrayType(T.StringType()))])


def _weight(links: list[dict]) -> int:
    return 1 + sum(len(x["text"]) + len(x["url"]) for x in links)


@F.arrow_udf(_CONVERTED)
def _converted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    return row_by_row(batches, lambda m, b: convert(m or "", b or ""), lambda out: len(out["markdown"]) + _weight(out["links"]), to_arrow_type(_CONVERTED))


def _linked(scope: str):
    @F.arrow_udf(_LINKS)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return row_by_row(batches, lambda m, b: links_of_html(m or "", b or "", scope), _weight, to_arrow_type(_LINKS))

    return run


def html_markdown(pages: DataFrame, keys: list[str], html_col: str = "html", base_col: str = "url") -> DataFrame:
    """keys, title, markdown, n_links, warnings. No native form reads HTML, so pages pass through Arrow batches."""
    rows = pages.select(*keys, _converted(F.col(html_col), F.col(base_col)).alias("d"))
    return rows.select(*keys, "d.title", "d.markdown", F.size("d.links").cast("long").alias("n_links"), F.array_join("d.warnings", ",").alias("warnings"))


def html_links(pages: DataFrame, keys: list[str], html_col: str = "html", base_col: str = "url", *, scope: str = "content") -> DataFrame:
    """keys, pos, text, url: links in order, the first of each text and target."""
    rows = pages.select(*keys, F.posexplode(_linked(scope)(F.col(html_col), F.col(base_col))).alias("pos", "link"))
    return rows.select(*keys, F.col("pos").cast("long").alias("pos"), "link.text", "link.url")


def _fenced_json(raw: str | None) -> str | None:
    if raw is None:
        return None
    try:
        body = json.dumps(json.loads(raw), ensure_ascii=False, indent=2, sort_keys=True)
    except ValueError:
        body = raw
    return f"```json\n{body}\n```\n"


@F.arrow_udf(T.StringType())
def json_markdown(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """JSON with sorted keys and indents, fenced; what is no JSON is kept as it is."""
    return row_by_row(((b,) for b in batches), _fenced_json, lambda out: len(out or ""), pa.string())


def normalizer(content_type: Column) -> Column:
    """Which conversion a media type takes: html, json, text, or none that is built in."""
    kind = media_type(content_type)
    return F.when(kind.isin(*HTML_TYPES), "html").when(kind.isin(*JSON_TYPES), "json").when(F.startswith(kind, F.lit("text/")) | kind.isin(*XML_TYPES), "text").otherwise("external")


def normalizer_by_suffix(path: Column) -> Column:
    """Which conversion a local file takes, by the ending of its name."""
    end = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(end.isin(*HTML_ENDS), "html").when(end.isin(*JSON_ENDS), "json").when(end.isin(*TEXT_ENDS), "text").otherwise("external")


def used_flags(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a remote or an authenticated reader was used: any attempt that wasn't skipped. attempts: keys, status, remote, authenticated."""
    used = F.col("status") != "skipped"
    return attempts.groupBy(*keys).agg(F.bool_or(used & F.col("remote")).alias("remote_used"), F.bool_or(used & F.col("authenticated")).alias("authenticated_used"))


def reader_route(reader: str, *, allow_remote: bool = False, allow_authenticated: bool = False, known: tuple[str, ...] = ("direct", "jina", "firecrawl")) -> list[str]:
    """Readers to try in order."""
    if reader != "auto":
        if reader not in known:
            raise ValueError(f"adapter_unavailable: {reader}")
        return [reader]
    return ["direct", *(["jina"] if allow_remote else []), *(["firecrawl"] if allow_remote and allow_authenticated else [])]


def http_outcome(status: Column) -> Column:
    """success, retryable or failed for a status code."""
    return F.when(status.between(200, 299), "success").when(status.isin(408, 425, 429) | (status >= 500), "retryable").otherwise("failed")


def fallback(tries: DataFrame, keys: list[str], min_chars: int = MIN_CHARS) -> DataFrame:
    """Ordered fallback over readers, tried up to the first whose text is long enough.

    tries: keys, route_pos, ok, chars. The raw artifact is the first success, the normalized one the last.
    """
    enough = F.min(F.when(F.col("ok") & (F.col("chars") >= min_chars), F.col("route_pos"))).over(Window.partitionBy(*keys))
    used = tries.withColumn("_stop", enough).filter(F.col("_stop").isNull() | (F.col("route_pos") <= F.col("_stop")))
    ok = F.when(F.col("ok"), F.col("route_pos"))
    out = used.groupBy(*keys).agg(F.count("*").alias("tried"), F.min(ok).alias("raw_pos"), F.max(ok).alias("normalized_pos"), F.coalesce(F.max_by("chars", ok), F.lit(0)).cast("long").alias("chars"))
    return out.withColumn("status", F.when(F.col("chars") >= min_chars, "complete").otherwise("partial"))


def receipts(docs: DataFrame, keys: list[str], *, min_chars: int = MIN_CHARS) -> DataFrame:
    """Receipts of documents: docs has keys, body, markdown (null: not normalized), content_type, fetched_at."""
    chars = F.coalesce(F.length("markdown"), F.lit(0))
    warnings = F.array(F.when(F.col("markdown").isNull(), "normalization_unavailable"), F.when(chars < min_chars, "normalized_content_below_threshold"), F.lit("source_content_is_untrusted_data"))
    sha = sha256(F.col("body"))
    return docs.select(
        *keys,
        sha.alias("source_sha256"),
        F.octet_length("body").cast("long").alias("bytes"),
        chars.cast("long").alias("normalized_chars"),
        receipt_id(sha, F.col("fetched_at")).alias("receipt_id"),
        F.when(chars >= min_chars, "complete").otherwise("partial").alias("status"),
        chars.between(1, min_chars - 1).alias("thin_content"),
        raw_name(F.col("content_type")).alias("raw_path"),
        F.array_sort(F.array_distinct(F.filter(warnings, lambda w: w.isNotNull()))).alias("warnings"),
    )
