"""Scalar functions over whole columns. Long results are compared by their digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweft.catalog import query
from claimweft.functions import text as X
from claimweft.functions.html import extract_pages
from claimweft.functions.jsonx import delta_text
from claimweft.models import ports
from claimweft.operators.chunk import lines, long_chunks, page_gate
from claimweft.sinks.text import log_line
from claimweft.sources.tables import read_table, spread

HTML = "concat('<html lang=\"', coalesce(language, ''), '\"><head><title> ', coalesce(title, ''), ' </title></head><body><nav>Home</nav><svg><path d=\"M0\"/></svg><img src=\"a.png\"><p class=\"x\">', replace(coalesce(text, ''), '&', '&amp;amp;'), '</p><!-- c --><footer>end</footer></body></html>')"


def html_pages(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "extracted_page").select("page_id", F.expr(HTML.replace('\\"', '"')).alias("html"))


_SQ = "[ \\t\\r\\n\\x{00a0}]+"


def _sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\r\\n\\x{{00a0}}]+', ' ', 'g'))"


def _sql_strip(x: str) -> str:
    for tag in ("script", "style", "noscript", "header", "nav", "footer", "aside", "form", "svg"):
        x = f"regexp_replace({x}, '(?i)<{tag}\\b[^>]*>[\\s\\S]*?</{tag}>', ' ', 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for e, m in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        x = f"regexp_replace({x}, '(?i){e}', '{m}', 'g')"
    return _sql_squeeze(x)


_SQL_HTML = HTML.replace('\\"', '"')


@query(f"SELECT page_id, md5({_sql_strip(_SQL_HTML)}) AS digest, length({_sql_strip(_SQL_HTML)}) AS n FROM extracted_page")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    out = html_pages(spark, d).select("page_id", X.strip_html("html").alias("t"))
    return out.select("page_id", F.md5("t").alias("digest"), F.length("t").alias("n"))


@query(f"SELECT doc_id, md5({_sql_strip('text')}) AS digest FROM documents WHERE text IS NOT NULL")
def html_strip_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.md5(X.strip_html("text")).alias("digest"))


@query(f"SELECT page_id, {_sql_squeeze('coalesce(title, chr(32))')} AS title, nullif(coalesce(language, ''), '') AS lang FROM extracted_page")
def html_head(spark: SparkSession, d: str) -> DataFrame:
    return html_pages(spark, d).select("page_id", X.html_title("html").alias("title"), X.html_language("html").alias("lang"))


@query(f"SELECT page_id, md5(replace(replace({_SQL_HTML}, '<svg><path d=\"M0\"/></svg>', ''), '<img src=\"a.png\">', '')) AS digest FROM extracted_page")
def html_drop_media(spark: SparkSession, d: str) -> DataFrame:
    return html_pages(spark, d).select("page_id", F.md5(X.drop_media("html")).alias("digest"))


@query("SELECT hit_id, regexp_replace('<b>' || coalesce(title, '') || '</b><i> x', '<[^>]+>', '', 'g') AS title FROM search_hit")
def snippet_tags(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.lit("<b>"), F.coalesce("title", F.lit("")), F.lit("</b><i> x"))
    return read_table(spark, d, "search_hit").select("hit_id", X.strip_tags(marked).alias("title"))


def _sql_markdown(x: str) -> str:
    ws = "[ \\t\\r\\n\\x{00a0}]"
    for pattern, by in (
        ("```[\\s\\S]*?```", " "), ("`[^`]*`", " "), ("!\\[[^\\]]*\\]\\([^)]*\\)", " "), ("\\[([^\\]]*)\\]\\([^)]*\\)", "\\1"), ("<!--[\\s\\S]*?-->", " "), ("<[^>]+>", " "),
        (f"(?m)^#{{1,6}}{ws}+.*$", ""), (f"(?m)^[-=]{{3,}}{ws}*$", ""), (f"(?m)^>{ws}+", ""), ("[*_~]", ""), (f"{ws}+\\n", "\n"), ("\\n{2,}", "\n\n"), ("[ \\t]{2,}", " "), (f"^{ws}+|{ws}+$", ""),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


@query(f"SELECT page_id, md5({_sql_markdown('markdown')}) AS digest, length({_sql_markdown('markdown')}) AS n FROM extracted_page WHERE markdown IS NOT NULL")
def md_plain(spark: SparkSession, d: str) -> DataFrame:
    pages = spread(read_table(spark, d, "extracted_page").select("page_id", "markdown").filter("markdown is not null")).select("page_id", X.plain_markdown("markdown").alias("t"))
    return pages.select("page_id", F.md5("t").alias("digest"), F.length("t").alias("n"))


@query("SELECT page_id, md5(regexp_replace(markdown, '\\*\\*[ \\t]*([^*]*?)[ \\t]*\\*\\*', '**\\1**', 'g')) AS digest FROM extracted_page WHERE markdown IS NOT NULL")
def md_emphasis(spark: SparkSession, d: str) -> DataFrame:
    pages = read_table(spark, d, "extracted_page").filter("markdown is not null")
    return pages.select("page_id", F.md5(X.tight_emphasis("markdown")).alias("digest"))


_A = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_H = f"lower(regexp_extract({_A}, '^(?:[^@]*@)?([^:]*)', 1))"
_CANON = f"CASE WHEN {_H} <> '' THEN regexp_replace({_H} || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') ELSE url END"


@query(f"SELECT page_id, {_CANON} AS canonical FROM extracted_page WHERE url IS NOT NULL")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "extracted_page").filter("url is not null").select("page_id", X.canonical_url("url").alias("canonical"))


@query(f"""SELECT hit_id, {_A} AS authority, {_H} AS host, regexp_replace({_H}, '^www\\.', '') AS bare, array_to_string(list_slice(string_split({_H}, '.'), greatest(1, len(string_split({_H}, '.')) - 1), len(string_split({_H}, '.'))), '.') AS short,
split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS route, CASE WHEN regexp_matches(url, '(?i)^https?://') THEN url ELSE 'https://' || url END AS full_url FROM search_hit WHERE url IS NOT NULL""")
def url_domains(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "search_hit").filter("url is not null").select(
        "hit_id", X.authority("url").alias("authority"), X.host("url").alias("host"), X.bare_domain("url").alias("bare"), X.short_domain("url").alias("short"),
        X.route_domain("url").alias("route"), X.with_scheme("url").alias("full_url"))


@query(f"""WITH x AS (SELECT hit_id, {_H} AS h, lower(coalesce(domain, '')) AS d FROM search_hit WHERE url IS NOT NULL)
SELECT hit_id, (h <> '' AND d <> '' AND (h = d OR h LIKE '%.' || d)) AS same FROM x""")
def domain_match(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "search_hit").filter("url is not null").select("hit_id", X.in_domain(X.host("url"), F.col("domain")).alias("same"))


@query("SELECT hit_id, url AS target FROM search_hit WHERE url IS NOT NULL")
def redirect_unwrap(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.concat(F.lit("https://go.example/l/?uddg="), F.url_encode("url"), F.lit("&rut=1"))
    return read_table(spark, d, "search_hit").filter("url is not null").select("hit_id", X.unwrap_redirect(wrapped).alias("target"))


_Q = "regexp_replace('\"Query: ' || text || '\"', '^[\"''` \\t\\r\\n]+|[\"''` \\t\\r\\n]+$', '', 'g')"


@query(f"SELECT id, coalesce(nullif(left(trim(regexp_replace(split_part({_Q}, chr(10), 1), '(?i)^(query|search)[ \\t]*:[ \\t]*', '')), 200), ''), text) AS cleaned FROM claim")
def query_clean(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit('"Query: '), F.col("text"), F.lit('"'))
    return read_table(spark, d, "claim").select("id", X.clean_query(raw, "text").alias("cleaned"))


@query("""SELECT coalesce(alignment, '-') AS written, CASE WHEN lower(coalesce(alignment, '')) LIKE 'agree%' THEN 'agrees' WHEN lower(coalesce(alignment, '')) LIKE 'disagree%' OR lower(coalesce(alignment, '')) LIKE 'contradict%' THEN 'disagrees' ELSE 'unrelated' END AS label, count(*) AS n
FROM verdict GROUP BY ALL""")
def label_normalise(spark: SparkSession, d: str) -> DataFrame:
    v = read_table(spark, d, "verdict").select(F.coalesce("alignment", F.lit("-")).alias("written"), X.alignment_label("alignment").alias("label"))
    return v.groupBy("written", "label").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN rtrim(left(text, 59)) || '…' ELSE text END AS short FROM documents WHERE text IS NOT NULL")
def truncate_ellipsis(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").filter("text is not null").select("doc_id", X.ellipsis("text", 60).alias("short"))


_S = "(value / 250 - 0.3)"


@query(f"""SELECT event_id, CASE WHEN {_S} < -0.2 THEN 'contradiction' WHEN {_S} < 0.2 THEN 'irrelevant' ELSE 'support' END AS band,
'rgb(' || CAST(floor(CASE WHEN greatest(0, least(1, {_S})) < 0.5 THEN 255.0 ELSE 255 * (2 - 2 * greatest(0, least(1, {_S}))) END + 0.5) AS INT) || ',' || CAST(floor(CASE WHEN greatest(0, least(1, {_S})) < 0.5 THEN 255 * 2 * greatest(0, least(1, {_S})) ELSE 255.0 END + 0.5) AS INT) || ',0)' AS colour FROM events""")
def score_bands(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("value") / 250 - 0.3
    return read_table(spark, d, "events").select("event_id", X.score_band(s).alias("band"), X.score_colour(s).alias("colour"))


_WC = "len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n\\x{00a0}]+'), lambda w: w <> ''))"


@query(f"SELECT page_id, {_WC} AS words FROM extracted_page WHERE text <> '' AND {_WC} >= 80")
def word_gate(spark: SparkSession, d: str) -> DataFrame:
    return page_gate(read_table(spark, d, "extracted_page")).select("page_id", X.word_count("text").cast("bigint").alias("words"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS c FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) FILTER (trim(regexp_replace(c, '[\\t\\r\\x{00a0}]', ' ', 'g')) <> '') AS lines, count(*) FILTER (length(c) >= 250) AS kept, count(*) FILTER (length(c) > 250) AS used FROM l GROUP BY doc_id""")
def chunk_lengths(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").filter("text is not null")
    used = long_chunks(lines(docs, ["doc_id"])).groupBy("doc_id").agg(F.count("*").alias("used"))
    every = lines(docs, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.length("chunk") >= 250).alias("kept"))
    return docs.select("doc_id").join(every, "doc_id", "left").join(used, "doc_id", "left").fillna(0, ["lines", "kept", "used"])


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, 'x' || json_extract_string(props, '$.k') AS delta FROM events""")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    wrapped = F.concat(F.lit('{"choices":[{"delta":{"content":"x'), k, F.lit('"}}]}'))
    return read_table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), delta_text(wrapped, "choices").alias("delta"))


@query("""SELECT c.id, 'Check the claim.' || chr(10) || 'claim: ' || c.text || coalesce(chr(10) || 'quote: ' || c.quote, '') || coalesce(chr(10) || 'title: ' || p.title, '') AS content FROM claim c JOIN extracted_page p USING (page_id)""")
def prompt_text(spark: SparkSession, d: str) -> DataFrame:
    met = read_table(spark, d, "claim").select("id", "page_id", "text", "quote").join(read_table(spark, d, "extracted_page").select("page_id", "title"), "page_id")
    user = ports.prompt("Check the claim.", {"claim": F.col("text"), "quote": F.col("quote"), "title": F.col("title")})
    return met.select("id", ports.chat_messages(F.lit("Be brief."), user)[1]["content"].alias("content"))


@query("SELECT page_id, 'title: ' || coalesce(title, '?') || chr(10) || 'date: ' || coalesce(published, '?') AS lines FROM extracted_page")
def context_lines(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.create_map(F.lit("title"), F.coalesce("title", F.lit("?")), F.lit("date"), F.coalesce("published", F.lit("?")), F.lit("url"), F.coalesce("url", F.lit("?")))
    return read_table(spark, d, "extracted_page").select("page_id", X.context_text(pairs, "url").alias("lines"))


@query("""SELECT event_id, strftime(ts, '%H:%M:%S.%g') || ' ' || rpad(upper(CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END), 5, ' ') || ' ' || rpad(event_type, 18, ' ') || ' ' || '[c' || user_id || '] ' || props AS line FROM events""")
def log_format(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "error").otherwise("info")
    claim = F.concat(F.lit("c"), F.col("user_id").cast("string"))
    return read_table(spark, d, "events").select("event_id", log_line(F.col("ts"), level, F.col("event_type"), F.col("props"), claim).alias("line"))


def _sql_votes() -> str:
    words = "string_split(trim(regexp_replace(regexp_replace(lower(left(text, 1000)), '[^\\p{L}\\p{N}_ \\t\\r\\n]', ' ', 'g'), '[ \\t\\r\\n\\x{00a0}]+', ' ', 'g')), ' ')"
    rows = " UNION ALL ".join(
        f"SELECT doc_id, '{lang}' AS lang, len(list_filter(w, lambda x: x IN ({', '.join(repr(s) for s in stops.split())}))) AS votes FROM w" for lang, stops in ports.STOP_WORDS.items())
    return f"""WITH w AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL), v AS ({rows}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, lang DESC) AS k FROM v),
p AS (SELECT doc_id, max(CASE WHEN k = 1 THEN lang END) AS lang, max(CASE WHEN k = 1 THEN votes END) AS votes, max(CASE WHEN k = 2 THEN votes END) AS next FROM r GROUP BY doc_id)
SELECT doc_id, CASE WHEN votes > 0 AND votes / (votes + next) > 0.5 THEN lang END AS lang, votes, CASE WHEN votes > 0 THEN round(votes / (votes + next), 6) END AS confidence FROM p"""


@query(_sql_votes())
def language_votes(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(read_table(spark, d, "documents").select("doc_id", "text").filter("text is not null"))
    return docs.select("doc_id", ports.language_votes(F.col("text")).alias("v")).select("doc_id", "v.lang", F.col("v.votes").cast("bigint").alias("votes"), "v.confidence")


#: White space of any script, as Python's split takes it.
_SPACE = "[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_LONG = f"length(regexp_replace(replace(coalesce(text, ''), chr(10), '') || 'Morevar a = 1;', '^{_SPACE}', '')) > 400"


@query(f"""SELECT page_id, trim(regexp_replace(coalesce(title, ''), '{_SPACE}', ' ', 'g')) AS title, CASE WHEN page_id % 3 > 0 THEN 'A. Writer' END AS author, CASE page_id % 3 WHEN 0 THEN '2024-05-06' WHEN 1 THEN '2024-01-02' END AS published,
len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda w: w <> '')) AS words, CASE WHEN {_LONG} THEN CASE page_id % 3 WHEN 1 THEN 'schema' ELSE 'article' END ELSE 'document' END AS strategy,
CASE WHEN {_LONG} THEN 1 ELSE 3 END AS noise FROM extracted_page""")
def page_extract(spark: SparkSession, d: str) -> DataFrame:
    """Every page wrapped in HTML with furniture around the article, and read back. Author and date stand in other places
    by the page's number: nowhere and in a time element, in meta elements and beside a marked article, in a byline."""
    pages = spread(read_table(spark, d, "extracted_page").select("page_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text")))
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), "\n", "</p><p>")
    k = F.col("page_id") % 3
    meta = F.when(k == 1, "<meta name='author' content='By A. Writer'><meta property='article:published_time' content='2024-01-02'>").otherwise("")
    byline = F.when(k == 2, "<span class='byline'>by A. Writer</span>").when(k == 0, "<time datetime='2024-05-06'></time>").otherwise("")
    html = F.concat(
        F.lit("<html><head><title>"), F.regexp_replace(F.regexp_replace("title", "&", "&amp;"), "<", "&lt;"), F.lit("</title>"), meta, F.lit("</head><body><nav>Home News</nav><header role='banner'>"), byline,
        F.when(k == 1, "</header><article itemtype='https://schema.org/BlogPosting'><p>").otherwise("</header><article><p>"), safe,
        F.lit("</p><div class='related-links'><a href='/1'>More</a></div><script>var a = 1;</script></article></body></html>"))
    out = extract_pages(pages.select("page_id", html.alias("html")), ["page_id"])
    long = lambda c: F.col(c).cast("bigint")
    return out.select("page_id", "title", "author", "published", long("word_count").alias("words"), "strategy", long("noise_removed").alias("noise"))


@query()
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Markdown that was rendered to HTML, and is read back as the same markdown: headings, lists and paragraphs."""
    pages = read_table(spark, d, "extracted_page").filter("text is not null").select("page_id", "text")
    safe = F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;")
    body = F.concat(F.lit("<article><h1>Head</h1><p>"), F.regexp_replace(safe, "\n", "</p><p>"), F.lit("</p><ul><li>one</li><li><b>two</b></li></ul></article>"))
    out = extract_pages(pages.select("page_id", body.alias("html")), ["page_id"])
    return out.select("page_id", F.md5("markdown").alias("digest"), F.length("markdown").alias("n"))


_CAPS = {"article": (16_000, ""), "source": (10_000, "\n\n[cut]"), "prompt": (12_000, "")}


@query("SELECT doc_id, " + ", ".join(f"md5(CASE WHEN length(text) > {n} THEN left(text, {n}) || '{mark}' ELSE text END) AS {name}" for name, (n, mark) in _CAPS.items()) + " FROM documents WHERE text IS NOT NULL")
def text_caps(spark: SparkSession, d: str) -> DataFrame:
    """Texts as prompts take them: the first characters, with a mark where something is missing."""
    docs = read_table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", *[F.md5(X.capped("text", n, mark)).alias(name) for name, (n, mark) in _CAPS.items()])
