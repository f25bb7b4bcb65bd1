"""Search providers as adapters from raw replies to hits, and pre-fetched sources.

No provider is called here: replies are tables that some crawler wrote. An adapter turns one kind of reply into rows
(query, pos, url, title, snippet, domain); a chain takes, for each query, the first provider that has any.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweft.functions import text as X
from claimweft.operators.search import ordered_union, prefer_branch, top_per_key

JSON_REPLY = "web struct<results: array<struct<url: string, title: string, description: string, meta_url: struct<hostname: string>>>>"


def site_query(query: Column, site: Column, style: str = "before") -> Column:
    """The query restricted to a site: before it, after it, or after it without PDF files (``after_no_pdf``)."""
    forms = {
        "before": F.concat(F.lit("site:"), site, F.lit(" "), query), "after": F.concat(query, F.lit(" site:"), site),
        "after_no_pdf": F.concat(query, F.lit(" site:"), site, F.lit(" -filetype:pdf")),
    }
    return F.when(F.coalesce(site, F.lit("")) != "", forms[style]).otherwise(query)


def retried(attempts: DataFrame, query: str = "query", tries: int = 2) -> DataFrame:
    """Of the attempts (query, attempt from 0, status) of each query the first that wasn't turned away for the moment (429,
    500, 503), within ``tries``; a query of which all were has none."""
    allowed = attempts.filter((F.col("attempt") < tries) & ~F.col("status").isin(429, 500, 503))
    return allowed.groupBy(query).agg(F.min_by(F.struct("attempt", "status"), "attempt").alias("_a")).select(query, "_a.attempt", "_a.status")


def result_count(n: Column) -> Column:
    """Between 1 and 20."""
    return F.greatest(F.lit(1), F.least(F.lit(20), n))


def json_hits(replies: DataFrame, query: str = "query", body: str = "body", flag: str | None = None) -> DataFrame:
    """Replies with nested results: tags leave titles and descriptions; the domain is the reply's host, else that of the
    address; results without a valid address or a title are skipped, the others stay."""
    parsed = replies.select(query, *([flag] if flag else []), F.from_json(body, JSON_REPLY).alias("j"))
    rows = parsed.select(query, *([flag] if flag else []), F.posexplode("j.web.results").alias("pos", "r"))
    valid = rows.filter(F.try_parse_url(F.col("r.url"), F.lit("HOST")).isNotNull() & (F.coalesce("r.title", F.lit("")) != ""))
    domain = F.coalesce(F.col("r.meta_url.hostname"), X.host(F.col("r.url")), F.lit(""))
    return valid.select(
        query, *([flag] if flag else []), "pos", F.col("r.url").alias("url"), X.strip_tags(F.col("r.title")).alias("title"), X.strip_tags(F.coalesce("r.description", F.lit(""))).alias("snippet"), domain.alias("domain"))


def item_hits(items: DataFrame, query: str = "query", domain: str | None = None) -> DataFrame:
    """Rows of results: those with an address and a title, and of the wanted domain where one is given."""
    valid = items.filter(F.try_parse_url("url", F.lit("HOST")).isNotNull() & (F.coalesce("title", F.lit("")) != ""))
    return valid if domain is None else valid.filter((F.coalesce(F.col(domain), F.lit("")) == "") | X.in_domain(X.host("url"), F.col(domain)))


def redirect_hits(results: DataFrame, query: str = "query", limit: int = 10, domain: str | None = None) -> DataFrame:
    """Result links behind a redirect: unwrapped, cut to ``limit``, and of the wanted domain. A query that the domain leaves
    without results keeps all of them."""
    return wide_hits(results.withColumn("url", X.unwrap_redirect("url")), query, limit, domain, wide=1)


def wide_hits(results: DataFrame, query: str = "query", limit: int = 10, domain: str | None = None, wide: int = 2) -> DataFrame:
    """The first ``wide`` times ``limit`` results with an address and, where there are titles, a title, of the wanted domain, then cut to ``limit``
    of each query. A query that the domain leaves without results keeps its first ones."""
    titled = F.coalesce("title", F.lit("")) != "" if "title" in results.columns else F.lit(True)
    valid = results.filter((F.coalesce("url", F.lit("")) != "") & titled)
    collected = top_per_key(valid, [query], wide * limit, F.asc("pos"), rank="_n").drop("_n")
    kept = collected
    if domain is not None:
        wanted = collected.filter((F.coalesce(F.col(domain), F.lit("")) == "") | X.in_domain(X.host("url"), F.col(domain)))
        kept = prefer_branch(ordered_union(wanted, collected), [query]).drop("branch")
    return top_per_key(kept, [query], limit, F.asc("pos"), rank="_n").drop("_n")


Adapter = Callable[..., DataFrame]
PROVIDERS: dict[str, Adapter] = {"json": json_hits, "items": item_hits, "redirect": redirect_hits, "wide": wide_hits}


def provider(name: str) -> Adapter:
    if name not in PROVIDERS:
        raise ValueError(f"no provider {name!r}; there are {sorted(PROVIDERS)}")
    return PROVIDERS[name]


def chain(*results: DataFrame, query: str = "query") -> DataFrame:
    """For each query the hits of the first provider that has any."""
    return prefer_branch(ordered_union(*results), [query]).drop("branch")


def fetched_sources(pages: DataFrame, html: str = "html", byte_limit: int = 400_000, text_limit: int = 14_000) -> DataFrame:
    """(url, title, text) of pages that came with a usable type: HTML cut, its text cut, and the host for a missing title.
    An empty title stays empty."""
    cut = pages.withColumn("_html", F.substring(F.col(html), 1, byte_limit))
    title = F.when(F.col("_html").rlike("(?i)<title"), X.html_title("_html")).otherwise(X.host("url"))
    return cut.select("url", title.alias("title"), F.left(X.strip_html("_html"), F.lit(text_limit)).alias("text"))


def without_media(pages: DataFrame, html: str = "html") -> DataFrame:
    """(url, html, error): pages of a browser, without pictures; a page without content keeps its error."""
    return pages.select("url", X.drop_media(html).alias("html"), F.when(F.col(html).isNull(), F.coalesce("error", F.lit("no content"))).alias("error"))
