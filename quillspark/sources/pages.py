"""Articles and links from landed pages, by column expressions over their markup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as fn
from quillspark.functions.markers import reject_cause
from quillspark.functions.rows import fixed, once
from quillspark.functions.text import parse_time

_TAG = "(?is)"


def _choose(*values: Column) -> Column:
    """The first value that is neither null nor empty; each is computed once, and those behind it not at all."""
    return F.coalesce(*[F.get(F.filter(F.array(v), lambda x: x != ""), F.lit(0)) for v in values])


def _first(html: Column, *patterns: str) -> Column:
    """The first pattern's match that isn't empty, cleaned."""
    return fn.strip_html(_choose(*[F.regexp_extract(html, _TAG + p, 1) for p in patterns]))


#: What a tag holds: quoted values may hold a closing bracket.
_INSIDE = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""


def without_comments(html: Column) -> Column:
    """Markup without what is commented out; most pages have no comment and aren't copied."""
    return F.when(F.contains(html, F.lit("<!--")), F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")).otherwise(html)


def tags(html: Column, name: str) -> Column:
    """The opening tags of a name, in order, whole."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b{_INSIDE}>"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted or not, wherever it stands in the tag; null if it is empty or missing."""
    forms = [rf'(?is)\s(?:{name})\s*=\s*{q}([^{q}]*){q}' for q in "\"'"] + [rf"(?is)\s(?:{name})\s*=\s*([^\s\"'>]+)"]
    return _choose(*[F.regexp_extract(tag, p, 1) for p in forms])


def metas(html: Column) -> Column:
    """array<struct<name, value>>: the meta tags of a page that have both, in order; one pass over the page."""
    found = F.transform(tags(html, "meta"), lambda t: F.struct(F.lower(attribute(t, "property|name")).alias("name"), attribute(t, "content").alias("value")))
    return F.filter(found, lambda m: m["name"].isNotNull() & (F.trim(m["value"]) != ""))


def _elements(node: Column) -> Column:
    """The elements of a JSON list as JSON; none for anything else."""
    return F.coalesce(F.when(node.startswith("["), F.from_json(node, "array<string>")), F.array().cast("array<string>"))


def json_ld(html: Column) -> Column:
    """All JSON-LD objects of a page as JSON, in order: lists and @graph are taken apart, garbled blocks left out."""
    found = F.regexp_extract_all(html, F.lit(_TAG + r"""<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    nodes = F.filter(F.transform(found, lambda b: F.get_json_object(b, "$")), lambda b: b.isNotNull())
    for _ in range(2):  # a list of graphs is as deep as pages go
        nodes = F.flatten(F.transform(nodes, lambda n: F.concat(F.when(n.startswith("["), _elements(n)).otherwise(F.array(n)), _elements(F.get_json_object(n, "$.@graph")))))
    return nodes


@dataclass
class Head:
    """What several cascades read of a page: its markup, meta tags, JSON-LD objects, and whether it is a provider's Markdown."""

    html: Column
    metas: Column
    nodes: Column
    is_md: Column

    def meta(self, *names: str) -> Column:
        """The first meta tag of the first of the names that has one."""
        one = lambda n: F.get(F.filter(self.metas, lambda m: m["name"] == n), F.lit(0))["value"]
        return fn.strip_html(F.coalesce(*[one(n) for n in names]))

    def ld(self, key: str) -> Column:
        """The first string of that key, articles first."""
        return _choose(*self._values(lambda n: _plain(F.get_json_object(n, f"$.{key}"))))

    def _values(self, of) -> list[Column]:
        article = lambda n: F.coalesce(F.lower(F.get_json_object(n, "$.@type")).isin(*ARTICLE_TYPES), F.lit(False))
        first = lambda nodes: F.get(F.filter(F.transform(nodes, of), lambda v: F.trim(v) != ""), F.lit(0))
        return [first(F.filter(self.nodes, article)), first(F.filter(self.nodes, lambda n: ~article(n)))]

    def ld_author(self) -> Column:
        """A string, an object's name, or the first such of a list."""
        name = lambda a: F.coalesce(_plain(a), F.when(a.startswith("{"), F.get_json_object(a, "$.name")))
        given = F.transform(self.nodes, lambda n: F.get_json_object(n, "$.author"))
        names = F.flatten(F.transform(given, lambda a: F.coalesce(F.when(a.startswith("["), F.transform(_elements(a), name)), F.array(name(a)))))
        return F.get(F.filter(names, lambda v: F.trim(v) != ""), F.lit(0))

    def ld_body(self) -> Column:
        """The first articleBody, articles first; a list's parts are joined."""
        body = lambda b: F.when(b.startswith("["), F.array_join(_elements(b), " ")).otherwise(b)
        return _choose(*self._values(lambda n: body(F.get_json_object(n, "$.articleBody"))))

    def header(self, name: str) -> Column:
        """A line of the provider's header block; null for other pages."""
        return F.when(self.is_md, F.nullif(F.trim(F.regexp_extract(self.html, rf"(?im)^{name}:[ \t]*(.*)$", 1)), F.lit("")))


#: The types of JSON-LD that are articles.
ARTICLE_TYPES = ("newsarticle", "article", "blogposting")
MARKDOWN_START, MARKDOWN_CONTENT = r"^\s*Title:", "Markdown Content:"


def _plain(value: Column) -> Column:
    """A JSON value that is a string: no object, no list."""
    return F.when(~value.rlike(r"^[\[{]"), value)


def head(df: DataFrame, html: str = "html", is_md: Column | None = None) -> tuple[DataFrame, Head]:
    """df with the working columns _metas and _nodes, each computed once a page."""
    d = fixed(fixed(df, "_metas", metas(F.col(html))), "_nodes", json_ld(F.col(html)))
    return d, Head(F.col(html), F.col("_metas"), F.col("_nodes"), F.lit(False) if is_md is None else F.coalesce(is_md, F.lit(False)))


def extract_title(h: Head) -> Column:
    page = _choose(h.meta("og:title"), h.meta("twitter:title"), fn.strip_html(h.ld("headline")), _first(h.html, r"<title[^>]*>(.*?)</title>", r"<h1[^>]*>(.*?)</h1>"), h.meta("headline"))
    h1 = F.when(h.is_md, fn.strip_html(F.regexp_extract(h.html, r"(?m)^#[ \t]+(.+)$", 1)))
    return _choose(page, h.header("Title"), h1)


def extract_author(h: Head) -> Column:
    by_class = _first(h.html, r"""<a\b[^>]*\sclass\s*=\s*["']?[^"'>]*author[^>]*>(.*?)</a>""")
    plain = once(by_class, lambda x: F.when(~x.rlike("(?i)@|http") & x.rlike(r"\p{L}"), x))
    return _choose(h.meta("author"), h.meta("article:author"), fn.strip_html(h.ld_author()), plain, h.header("Author"))


def extract_published(h: Head, lastmod: Column, retrieved: Column) -> Column:
    times = [F.regexp_extract(h.html, _TAG + p, 1) for p in (r"""<time[^>]+datetime=["']([^"']+)["']""", r'"datePublished"\s*:\s*"([^"]+)"')]
    raw = _choose(h.meta("article:published_time"), h.ld("datePublished"), *times, h.header("Published Time"))
    return F.coalesce(once(raw, parse_time), lastmod, retrieved)


def extract_body(h: Head, extractor: Column | None = None) -> Column:
    """A provider's Markdown without its header block; the JSON-LD body where the source wants it first; else the text of
    the article region, scripts and styles left out, or of the page where there is no article."""
    at = F.instr(h.html, MARKDOWN_CONTENT)
    below = F.regexp_replace(F.substr(h.html, at + len(MARKDOWN_CONTENT)), r"^[\r\n]+", "")
    markdown = F.when(h.html.rlike(MARKDOWN_START) & (at > 0), below).otherwise(h.html)
    region = _choose(F.regexp_extract(h.html, _TAG + r"<article[^>]*>(.*?)</article>", 1), h.html)
    plain = fn.strip_html(F.regexp_replace(region, _TAG + r"<(script|style)[^>]*>.*?</\1>", " "))
    first = F.lit(None).cast("string") if extractor is None else F.when(extractor == "json-ld-first", F.nullif(F.trim(h.ld_body()), F.lit("")))
    return F.when(h.is_md, markdown).otherwise(F.coalesce(first, plain))


def declared_link(h: Head) -> Column:
    """The address of the first link of that relation, whatever the order of its attributes; else og:url."""
    links = F.transform(tags(h.html, "link"), lambda t: F.struct(F.split(F.lower(F.trim(attribute(t, "rel"))), r"\s+").alias("rel"), F.trim(attribute(t, "href")).alias("href")))
    own = F.get(F.filter(links, lambda x: F.coalesce(F.array_contains(x["rel"], "canonical"), F.lit(False)) & (x["href"] != "")), F.lit(0))["href"]
    return _choose(own, h.meta("og:url"))


def declared_canonical(link: Column, base: Column) -> Column:
    """A declared address made absolute; null if it is of another host."""
    full = fn.absolutize(link, base)
    return F.when(fn.host_of(full) == fn.host_of(base), full)


def id_reused(fetched: Column, declared: Column) -> Column:
    """Both paths have digit runs and none in common."""
    a, b = (F.regexp_extract_all(fn.path_of(x), F.lit(r"(\d+)"), F.lit(1)) for x in (fetched, declared))
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b), F.lit(False))


def articles(landing: DataFrame) -> DataFrame:
    """A row for each page of (url, html, retrieved_at[, lastmod, is_md, extractor, id_guard]): what extract_articles gives, with the cause of rejects, in one pass.

    is_md: the payload is a provider's Markdown; extractor and id_guard: settings of the source (generic
    and on where there is no such column).
    """
    has = lambda name, default: F.coalesce(F.col(name), default) if name in landing.columns else default
    lastmod = F.col("lastmod") if "lastmod" in landing.columns else F.lit(None).cast("timestamp")
    guard, extractor = has("id_guard", F.lit(True)), has("extractor", F.lit("generic")) if "extractor" in landing.columns else None
    bare = F.when(has("is_md", F.lit(False)), F.col("html")).otherwise(without_comments(F.col("html")))
    d, h = head(landing.withColumn("html", bare), "html", has("is_md", F.lit(False)))
    for name, value in (("title", extract_title(h)), ("author", extract_author(h)), ("published_at", extract_published(h, lastmod, F.col("retrieved_at"))), ("content", extract_body(h, extractor)), ("_link", declared_link(h)), ("declared", declared_canonical(F.col("_link"), F.col("url")))):
        d = fixed(d, name, value)
    empty = F.col("title").isNull() | (F.trim("content") == "")
    cause = F.when(empty, reject_cause(h.html, F.lit("no title or body"))).when(guard & id_reused(F.col("url"), F.col("declared")), "reused id")
    d = fixed(d, "cause", cause)
    of_good = {"canonical_url": fn.canonicalize_url(F.coalesce("declared", "url")), "content_hash": fn.content_hash(F.col("title"), F.col("content"))} | {c: F.col(c) for c in ("title", "author", "published_at", "content")}
    d = d.withColumns({c: F.when(F.col("cause").isNull(), v) for c, v in of_good.items()})
    return d.select(*[c for c in landing.columns if c != "html"], "title", "author", "published_at", "content", "canonical_url", "content_hash", "cause")


def extract_articles(landing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, rejects) of pages as articles() takes them; whoever reads both reads the pages twice."""
    d = articles(landing)
    return d.filter("cause is null").drop("cause"), d.filter("cause is not null").select(*[c for c in ("source", "url") if c in landing.columns], "cause")


def hub_links(landing: DataFrame, pattern: str = "") -> DataFrame:
    """(url, link, pos): links of a page in document order, on its own host, with the pattern in the path; the first of each canonical address."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)<a[^>]+href=["']([^"'#]+)|\]\((https?://[^)\s]+)\)"""), F.lit(0))
    d = landing.select("url", F.posexplode(found).alias("pos", "raw"))
    raw = F.regexp_replace(F.regexp_replace("raw", r"""(?i)^<a[^>]+href=["']""", ""), r"^\]\(|\)$", "")
    d = d.withColumn("link", fn.absolutize(raw, F.col("url")))
    d = d.filter(F.col("link").rlike("^https?://") & (fn.host_of(F.col("link")) == fn.host_of(F.col("url"))) & F.contains(fn.path_of(F.col("link")), F.lit(pattern)))
    turn = Window.partitionBy("url", fn.canonicalize_url(F.col("link"))).orderBy("pos")
    return d.withColumn("_t", F.row_number().over(turn)).filter("_t = 1").select("url", "link", "pos")
