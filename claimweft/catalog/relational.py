"""Joins, sets, ranks and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweft.catalog import query
from claimweft.catalog.texts import _CANON, _H, html_pages
from claimweft.functions import text as X
from claimweft.functions.time import micros
from claimweft.operators import eventlog, locate, search, sets
from claimweft.operators.chunk import lines
from claimweft.models import ports
from claimweft.plans.pipeline import analyse, candidate_sources, verify, verify_sources
from claimweft.sources import providers
from claimweft.sources.tables import read_table, spread

GAP = 3_600_000


@query(f"""WITH h AS (SELECT hit_id, claimId, {_CANON} AS canonical FROM search_hit WHERE url IS NOT NULL)
SELECT claimId, canonical, min(hit_id) AS hit_id FROM h GROUP BY ALL""")
def hits_first(spark: SparkSession, d: str) -> DataFrame:
    hits = read_table(spark, d, "search_hit").filter("url is not null").select("claimId", "hit_id", "url")
    return search.distinct_hits(hits, ["claimId"], F.col("hit_id")).select("claimId", "canonical", "hit_id")


@query(f"""WITH p AS (SELECT c.id, {_CANON.replace('url', 'p.url')} AS own FROM claim c JOIN extracted_page p USING (page_id)),
h AS (SELECT hit_id, claimId, {_CANON} AS canonical FROM search_hit WHERE url IS NOT NULL UNION ALL SELECT -row_number() OVER (ORDER BY c.id), c.id, {_CANON.replace('url', 'p.url')} FROM claim c JOIN extracted_page p USING (page_id))
SELECT hit_id, claimId FROM h WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.id = h.claimId AND p.own = h.canonical)""")
def hits_exclude_own(spark: SparkSession, d: str) -> DataFrame:
    """Each claim's own page is put among its hits, and must be gone afterwards."""
    claims = read_table(spark, d, "claim").select(F.col("id").alias("claimId"), "page_id")
    own = claims.join(read_table(spark, d, "extracted_page").select("page_id", F.col("url").alias("own_url")), "page_id").select("claimId", "own_url")
    hits = read_table(spark, d, "search_hit").filter("url is not null").select("hit_id", "claimId", "url")
    planted = own.select(F.lit(-1).cast("bigint").alias("hit_id"), "claimId", F.col("own_url").alias("url"))
    return search.without_own_page(hits.unionByName(planted), own, "claimId").select("hit_id", "claimId")


@query("""WITH b AS (SELECT hit_id, claimId, CASE WHEN customDomain THEN 0 ELSE 1 END AS branch FROM search_hit), m AS (SELECT claimId, min(branch) AS least FROM b GROUP BY 1)
SELECT b.claimId, b.hit_id, b.branch FROM b JOIN m ON b.claimId = m.claimId AND b.branch = m.least""")
def hits_fallback(spark: SparkSession, d: str) -> DataFrame:
    hits = read_table(spark, d, "search_hit").select("claimId", "hit_id", "customDomain")
    both = search.ordered_union(hits.filter("customDomain"), hits.filter("not customDomain"))
    return search.prefer_branch(both.select("claimId", "hit_id", "branch"), ["claimId"])


@query("""WITH r AS (SELECT hit_id, claimId, customDomain, row_number() OVER (PARTITION BY claimId, customDomain ORDER BY hit_id) AS k FROM search_hit)
SELECT hit_id, claimId, CASE WHEN customDomain THEN 1 ELSE 0 END AS branch, k AS rank FROM r WHERE k <= CASE WHEN customDomain THEN 3 ELSE 5 END""")
def hits_branch_caps(spark: SparkSession, d: str) -> DataFrame:
    hits = read_table(spark, d, "search_hit").select("claimId", "hit_id", "customDomain")
    general = search.top_per_key(hits.filter("not customDomain"), ["claimId"], 5, F.asc("hit_id"))
    trusted = search.top_per_key(hits.filter("customDomain"), ["claimId"], 3, F.asc("hit_id"))
    return search.ordered_union(general, trusted).select("hit_id", "claimId", "branch", F.col("rank").cast("bigint").alias("rank"))


_LAST = """WITH v AS (SELECT claimId, url, CASE WHEN lower(coalesce(alignment, '')) LIKE 'agree%' THEN 'agrees' WHEN lower(coalesce(alignment, '')) LIKE 'disagree%' OR lower(coalesce(alignment, '')) LIKE 'contradict%' THEN 'disagrees' ELSE 'unrelated' END AS label,
row_number() OVER (PARTITION BY claimId, url ORDER BY loaded_at DESC, coalesce(alignment, '') DESC) AS k FROM verdict)"""


@query(f"{_LAST} SELECT h.hit_id, v.label FROM search_hit h LEFT JOIN v ON v.claimId = h.claimId AND v.url = h.url AND v.k = 1")
def hits_with_verdicts(spark: SparkSession, d: str) -> DataFrame:
    verdicts = read_table(spark, d, "verdict").select("claimId", "url", "alignment", "loaded_at")
    last = search.last_verdicts(verdicts, F.col("loaded_at"), F.coalesce("alignment", F.lit("")))
    labelled = last.select("claimId", "url", X.alignment_label("alignment").alias("label"))
    return read_table(spark, d, "search_hit").select("hit_id", "claimId", "url").join(labelled, ["claimId", "url"], "left").select("hit_id", "label")


@query(f"""WITH own AS (SELECT c.id, {_CANON.replace('url', 'p.url')} AS own FROM claim c JOIN extracted_page p USING (page_id)),
h AS (SELECT claimId, {_CANON} AS canonical, min(hit_id) AS hit_id FROM search_hit WHERE url IS NOT NULL GROUP BY ALL),
k AS (SELECT h.claimId, h.hit_id, row_number() OVER (PARTITION BY h.claimId ORDER BY h.hit_id) AS rank FROM h WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.id = h.claimId AND own.own = h.canonical))
SELECT claimId, hit_id, rank FROM k WHERE rank <= 5""")
def claim_sources(spark: SparkSession, d: str) -> DataFrame:
    hits = read_table(spark, d, "search_hit").filter("url is not null").select("claimId", "hit_id", "url", "title", "snippet")
    claims, pages = read_table(spark, d, "claim"), read_table(spark, d, "extracted_page")
    return candidate_sources(claims, hits, pages).select("claimId", "hit_id", F.col("rank").cast("bigint").alias("rank"))


@query("""SELECT DISTINCT split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS domain, min(hit_id) OVER (PARTITION BY split_part(regexp_replace(url, '^https?://', ''), '/', 1)) AS first_hit FROM search_hit WHERE url IS NOT NULL""")
def domains_first(spark: SparkSession, d: str) -> DataFrame:
    hits = read_table(spark, d, "search_hit").filter("url is not null").select("hit_id", X.route_domain("url").alias("domain"))
    return search.first_by(hits, ["domain"], F.col("hit_id")).withColumnRenamed("hit_id", "first_hit")


@query("""SELECT claimId AS query, publisher, publisherSite AS publisher_site, url, coalesce(rating, '—') AS rating, coalesce(nullif(claimText, ''), claimId) AS claim_text FROM fact_check_hit WHERE url IS NOT NULL AND url <> '' AND publisher IS NOT NULL""")
def factcheck_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Replies are nested as the service sends them, sent as JSON, and flattened again."""
    rows = read_table(spark, d, "fact_check_hit")
    review = F.struct(F.struct(F.col("publisher").alias("name"), F.col("publisherSite").alias("site")).alias("publisher"), "url", F.col("rating").alias("textualRating"))
    claim = F.struct(F.nullif("claimText", F.lit("")).alias("text"), F.array(review).alias("claimReview"))
    schema = "array<struct<text:string,claimReview:array<struct<publisher:struct<name:string,site:string>,url:string,textualRating:string>>>>"
    replies = rows.select(F.col("claimId").alias("query"), F.from_json(F.to_json(F.array(claim)), schema).alias("claims"))
    return search.flatten_fact_checks(replies)


@query("SELECT DISTINCT url FROM search_hit WHERE url IS NOT NULL AND " + _H + " LIKE '%.%'")
def urls_addable(spark: SparkSession, d: str) -> DataFrame:
    return search.addable_urls(read_table(spark, d, "search_hit").filter("url is not null").select("url"))


@query("""SELECT c.id, c.page_id, strpos(p.text, coalesce(nullif(c.quote, ''), c.text)) - 1 AS start, strpos(p.text, coalesce(nullif(c.quote, ''), c.text)) > 0 AS found FROM claim c JOIN extracted_page p USING (page_id) WHERE length(trim(coalesce(nullif(c.quote, ''), c.text))) >= 8""")
def locate_exact(spark: SparkSession, d: str) -> DataFrame:
    found = locate.highlights(read_table(spark, d, "claim"), read_table(spark, d, "extracted_page"), exact_only=True)
    return found.select("id", "page_id", F.col("start").cast("bigint").alias("start"), "found")


@query("""WITH t AS (SELECT c.id, c.page_id, p.text AS page, coalesce(nullif(c.quote, ''), c.text) AS needle FROM claim c JOIN extracted_page p USING (page_id)), k AS (SELECT * FROM t WHERE length(trim(needle)) >= 8),
f AS (SELECT id, page_id, trim(regexp_replace(needle, '\\s+', ' ', 'g')) AS n, regexp_replace(page, '\\s+', ' ', 'g') AS flat, strpos(page, needle) AS exact FROM k)
SELECT page_id, count(*) AS claims, count(*) FILTER (exact > 0) AS exact, count(*) FILTER (exact > 0 OR len(list_filter(range(0, greatest(1, (length(n) - 24) // 8 + 1)), lambda i: strpos(flat, left(n, length(n) - 8 * i)) > 0)) > 0) AS found FROM f GROUP BY page_id""")
def locate_shortened(spark: SparkSession, d: str) -> DataFrame:
    """Per page: claims, exact finds, and finds of all three stages."""
    found = locate.highlights(spread(read_table(spark, d, "claim")), read_table(spark, d, "extracted_page"))
    return found.groupBy("page_id").agg(F.count("*").alias("claims"), F.count_if("exact").alias("exact"), F.count_if(F.col("start") >= 0).alias("found"))


@query("""WITH l AS (SELECT page_id, string_split(text, chr(10)) AS a FROM extracted_page WHERE text IS NOT NULL), n AS (SELECT page_id, unnest(range(0, len(a))) AS pos, unnest(a) AS chunk FROM l),
k AS (SELECT page_id, pos, length(chunk) AS length FROM n WHERE trim(regexp_replace(chunk, '[\\t\\r\\x{00a0}]', ' ', 'g')) <> '')
SELECT page_id, pos, length, coalesce(sum(length) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM k""")
def node_offsets(spark: SparkSession, d: str) -> DataFrame:
    pages = read_table(spark, d, "extracted_page").filter("text is not null")
    placed = locate.running_offsets(lines(pages, ["page_id"]), "page_id")
    return placed.select("page_id", F.col("pos").cast("bigint").alias("pos"), F.length("chunk").cast("bigint").alias("length"), "start")


@query("""WITH l AS (SELECT page_id, string_split(text, chr(10)) AS a FROM extracted_page WHERE text IS NOT NULL), n AS (SELECT page_id, unnest(range(0, len(a))) AS pos, unnest(a) AS chunk FROM l),
k AS (SELECT page_id, pos, length(chunk) AS length FROM n WHERE trim(regexp_replace(chunk, '[\\t\\r\\x{00a0}]', ' ', 'g')) <> ''),
s AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM k),
o AS (SELECT c.id, c.page_id, CAST(length(c.text) * 7 AS BIGINT) AS "offset" FROM claim c JOIN l USING (page_id))
SELECT o.page_id, o."offset", s.pos AS node, o."offset" - s.start AS within FROM o LEFT JOIN s ON s.page_id = o.page_id AND s.start <= o."offset" AND o."offset" < s.start + s.length""")
def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    """As-of join of offsets with the text nodes of their page."""
    pages = read_table(spark, d, "extracted_page").filter("text is not null")
    nodes = locate.running_offsets(lines(pages, ["page_id"]), "page_id").withColumn("length", F.length("chunk"))
    offsets = read_table(spark, d, "claim").join(pages.select("page_id"), "page_id").select("page_id", (F.length("text") * 7).cast("bigint").alias("offset"))
    found = locate.node_at(offsets, nodes, "page_id")
    return found.select("page_id", "offset", F.col("node").cast("bigint").alias("node"), "within")


_EV = "SELECT *, epoch_us(ts) AS us FROM events"
_STRETCH = f"""WITH e AS ({_EV}), b AS (SELECT *, us - lag(us) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS gap FROM e),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {GAP * 1000} THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stretch FROM b)"""


@query(f"""WITH RECURSIVE e AS (SELECT event_type, user_id, epoch_us(ts) AS us, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT event_type, user_id, event_id, k, us AS last, true AS emitted FROM e WHERE k = 1
UNION ALL SELECT e.event_type, e.user_id, e.event_id, e.k, CASE WHEN e.us - f.last >= {GAP * 1000} THEN e.us ELSE f.last END, e.us - f.last >= {GAP * 1000} FROM f JOIN e ON e.event_type = f.event_type AND e.user_id = f.user_id AND e.k = f.k + 1)
SELECT event_id FROM f WHERE emitted""")
def log_thin(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.thin_out(read_table(spark, d, "events"), ["event_type", "user_id"], GAP).select("event_id")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def log_last(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.last_rows(read_table(spark, d, "events")).select("event_id")


@query("SELECT event_id FROM (SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' ORDER BY ts DESC, event_id DESC LIMIT 200) WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 3600 SECOND")
def log_backlog(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.backlog(read_table(spark, d, "events"), "2024-01-15 12:00:00", max_age_s=3600).select("event_id")


@query(f"""{_STRETCH} SELECT event_type, user_id, stretch, max(us) AS settled_us, arg_max(value, (us, event_id)) AS value, count(*) AS changes FROM s GROUP BY ALL""")
def log_settled(spark: SparkSession, d: str) -> DataFrame:
    out = eventlog.settled(read_table(spark, d, "events"), ["event_type", "user_id"], GAP, "value")
    return out.select("event_type", "user_id", "stretch", micros("ts").alias("settled_us"), "value", "changes")


@query(f"""{_STRETCH} SELECT event_id, CAST(floor((us - min(us) OVER (PARTITION BY event_type, user_id, stretch)) / 1000000) AS BIGINT) AS elapsed_s FROM s""")
def log_elapsed(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.elapsed(read_table(spark, d, "events"), ["event_type", "user_id"], GAP).select("event_id", "elapsed_s")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, CASE WHEN event_type IN ('signup', 'view') THEN 1 WHEN event_type = 'click' THEN -1 ELSE 0 END AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, greatest(0, c) AS active FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, greatest(0, f.active + e.c) FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT event_id, active FROM f""")
def active_tasks(spark: SparkSession, d: str) -> DataFrame:
    change = F.when(F.col("event_type").isin("signup", "view"), 1).when(F.col("event_type") == "click", -1).otherwise(0)
    events = read_table(spark, d, "events").withColumn("change", change)
    return eventlog.active_count(events, ["user_id"], "change").select("event_id", "active")


def session_events(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    """Events of the log, or of a stream of it, read as those of analysis sessions, one a user."""
    kind = F.create_map(*map(F.lit, ["signup", "claim", "view", "verify", "click", "verdict", "purchase", "progress", "error", "error"]))
    k = F.get_json_object("props", "$.k").cast("int")
    return (read_table(spark, d, "events") if events is None else events).select(
        "user_id", "ts", "event_id", kind[F.col("event_type")].alias("kind"), F.when(F.col("event_type") != "purchase", F.concat(F.lit("c"), (k % 5).cast("string"))).alias("claim"),
        F.lit(None).cast("string").alias("message"), (F.col("value") / 100).alias("value"))


@query("""WITH e AS (SELECT user_id, event_type, 'c' || (CAST(json_extract_string(props, '$.k') AS INT) % 5) AS claim, value / 100 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
i AS (SELECT user_id, claim, min(k) AS born FROM e WHERE event_type = 'signup' GROUP BY ALL),
s AS (SELECT i.user_id, i.claim, i.born, arg_max(CASE WHEN e.event_type = 'view' THEN 'verifying' ELSE 'done' END, e.k) AS status FROM i LEFT JOIN e ON e.user_id = i.user_id AND e.claim = i.claim AND e.k > i.born AND e.event_type IN ('view', 'click', 'error') GROUP BY ALL),
c AS (SELECT s.user_id, count(*) AS n_claims, count(*) FILTER (EXISTS (SELECT 1 FROM e WHERE e.user_id = s.user_id AND e.claim = s.claim AND e.k > s.born AND e.event_type IN ('view', 'click', 'error')) AND status = 'done') AS done,
count(*) FILTER (EXISTS (SELECT 1 FROM e WHERE e.user_id = s.user_id AND e.claim = s.claim AND e.k > s.born AND e.event_type IN ('view', 'click', 'error')) AND status = 'verifying') AS verifying FROM s GROUP BY 1),
t AS (SELECT user_id, count(*) AS n_events, count(*) FILTER (event_type = 'error') AS errors, coalesce(arg_max(least(1, greatest(0, v)), k) FILTER (event_type = 'purchase'), 0) AS progress FROM e GROUP BY 1)
SELECT t.user_id, n_events, errors, round(progress, 6) AS progress, coalesce(n_claims, 0) AS n_claims, coalesce(done, 0) AS done, coalesce(verifying, 0) AS verifying FROM t LEFT JOIN c USING (user_id)""")
def session_states(spark: SparkSession, d: str) -> DataFrame:
    folded = eventlog.fold_states(session_events(spark, d), "user_id")
    long = lambda c: F.col(c).cast("bigint").alias(c)
    return folded.select("user_id", "n_events", long("errors"), F.round("progress", 6).alias("progress"), F.size("claims").cast("bigint").alias("n_claims"), long("done"), long("verifying"))


@query("""WITH e AS (SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS err, user_id, value FROM events) SELECT user_id, sum(err) AS errors, count(*) AS n, round(avg(value), 4) AS mean_value FROM e GROUP BY ROLLUP (user_id)""")
def event_report(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events")
    return events.rollup("user_id").agg(F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors"), F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))


@query()
def analysed_pages(spark: SparkSession, d: str) -> DataFrame:
    return analyse(read_table(spark, d, "extracted_page"))


@query()
def verified_claims(spark: SparkSession, d: str) -> DataFrame:
    claims, pages = read_table(spark, d, "claim"), read_table(spark, d, "extracted_page")
    hits = read_table(spark, d, "search_hit").filter("url is not null")
    return verify(claims, candidate_sources(claims, hits, pages))


@query()
def verified_sources(spark: SparkSession, d: str) -> DataFrame:
    """Each claim against the whole text of its page, as a fetched source."""
    claims, pages = read_table(spark, d, "claim").select("id", "page_id", "text"), read_table(spark, d, "extracted_page").select("page_id", "markdown")
    return verify_sources(claims, claims.select("id", "page_id"), pages, source="page_id")


_STRIP = "regexp_replace({}, '<[^>]+>', '', 'g')"


@query(f"""WITH r AS (SELECT claimId AS query, url, {_STRIP.format("'<b>' || title || '</b>'")} AS title, {_STRIP.format("coalesce(snippet, '')")} AS snippet, title IS NOT NULL AS titled, row_number() OVER (PARTITION BY claimId ORDER BY hit_id) - 1 AS pos FROM search_hit WHERE url IS NOT NULL)
SELECT query, pos, url, title, snippet FROM r WHERE titled""")
def provider_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits sent as a provider's nested JSON, and read back by its adapter."""
    hits = read_table(spark, d, "search_hit").filter("url is not null")
    result = F.struct("hit_id", F.struct("url", F.concat(F.lit("<b>"), "title", F.lit("</b>")).alias("title"), F.col("snippet").alias("description")).alias("r"))
    sent = hits.groupBy(F.col("claimId").alias("query")).agg(F.array_sort(F.collect_list(result)).alias("x"))
    body = F.to_json(F.struct(F.struct(F.transform("x", lambda x: x["r"]).alias("results")).alias("web")))
    found = providers.provider("json")(sent.select("query", body.alias("body")))
    return found.select("query", F.col("pos").cast("bigint").alias("pos"), "url", "title", "snippet")


_RESULTS = """WITH r AS (SELECT claimId AS query, hit_id, url, title, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, row_number() OVER (PARTITION BY claimId ORDER BY hit_id) - 1 AS pos,
first_value(lower(coalesce(domain, ''))) OVER (PARTITION BY claimId ORDER BY hit_id DESC) AS wanted FROM search_hit WHERE url IS NOT NULL), v AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos) AS n FROM r WHERE title <> '' AND url <> ''),
c AS (SELECT *, wanted = '' OR host = wanted OR host LIKE '%.' || wanted AS own FROM v WHERE n <= LIMIT), k AS (SELECT *, bool_or(own) OVER (PARTITION BY query) AS found FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos) AS m FROM k WHERE own OR NOT found)
SELECT query, pos, url FROM o WHERE m <= 2"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Hits as a provider's results; the wanted domain of a claim is that of its last hit."""
    hits = read_table(spark, d, "search_hit").filter("url is not null").select(F.col("claimId").alias("query"), "hit_id", "url", "title", F.lower(F.coalesce("domain", F.lit(""))).alias("domain"))
    last = hits.groupBy("query").agg(F.max_by("domain", "hit_id").alias("wanted"))
    w = Window.partitionBy("query").orderBy("hit_id")
    return hits.drop("domain").withColumn("pos", F.row_number().over(w) - 1).join(last, "query")


@query(_RESULTS.replace("LIMIT", "4"))
def provider_wide(spark: SparkSession, d: str) -> DataFrame:
    """Twice as many results as wanted are collected before those of other domains go."""
    found = providers.provider("wide")(_results(spark, d), limit=2, domain="wanted")
    return found.select("query", F.col("pos").cast("bigint").alias("pos"), "url")


@query(_RESULTS.replace("LIMIT", "2"))
def provider_redirect(spark: SparkSession, d: str) -> DataFrame:
    """Results behind a redirect, cut before those of other domains go."""
    wrapped = F.concat(F.lit("https://go.example/l/?uddg="), F.url_encode("url"), F.lit("&rut=1"))
    found = providers.provider("redirect")(_results(spark, d).withColumn("url", wrapped), limit=2, domain="wanted")
    return found.select("query", F.col("pos").cast("bigint").alias("pos"), "url")


@query("SELECT hit_id, CASE WHEN coalesce(domain, '') <> '' THEN 'site:' || domain || ' ' || title ELSE title END AS before, CASE WHEN coalesce(domain, '') <> '' THEN title || ' site:' || domain || ' -filetype:pdf' ELSE title END AS after, greatest(1, least(20, hit_id % 40)) AS n FROM search_hit")
def site_queries(spark: SparkSession, d: str) -> DataFrame:
    hits = read_table(spark, d, "search_hit")
    ask = lambda style: providers.site_query(F.col("title"), F.col("domain"), style)
    return hits.select("hit_id", ask("before").alias("before"), ask("after_no_pdf").alias("after"), providers.result_count(F.col("hit_id") % 40).alias("n"))


@query("SELECT user_id AS query, arg_min(status, attempt) AS status FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS attempt, CASE event_type WHEN 'error' THEN 503 WHEN 'click' THEN 429 WHEN 'view' THEN 404 ELSE 200 END AS status FROM events) WHERE attempt < 2 AND status NOT IN (429, 500, 503) GROUP BY 1")
def provider_retries(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "click", 429).when(F.col("event_type") == "view", 404).otherwise(200)
    attempts = read_table(spark, d, "events").select(F.col("user_id").alias("query"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("attempt"), status.alias("status"))
    return providers.retried(attempts).select("query", "status")


@query("WITH c AS (SELECT page_id, trim(text) AS text, row_number() OVER (PARTITION BY page_id ORDER BY id) AS n FROM claim WHERE trim(text) <> '') SELECT page_id, 'c' || n AS claim_id, text FROM c WHERE n <= 5")
def claims_accepted(spark: SparkSession, d: str) -> DataFrame:
    """The first five claims with text of each page, numbered anew."""
    found = ports.accepted_claims(read_table(spark, d, "claim").select("page_id", "id", "text"), "page_id", pos="id", n=5)
    return found.select("page_id", "claim_id", "text")


@query("""WITH c AS (SELECT claimId, count(*) FILTER (customDomain) AS own, count(*) AS n FROM search_hit GROUP BY 1) SELECT claimId AS query, CASE WHEN own > 0 THEN own ELSE n END AS hits FROM c""")
def provider_chain(spark: SparkSession, d: str) -> DataFrame:
    hits = read_table(spark, d, "search_hit").select(F.col("claimId").alias("query"), "hit_id", "customDomain")
    return providers.chain(hits.filter("customDomain"), hits).groupBy("query").agg(F.count("*").alias("hits"))


@query("SELECT c.id FROM claim c WHERE NOT EXISTS (SELECT 1 FROM verdict v WHERE v.claimId = c.id)")
def claims_open(spark: SparkSession, d: str) -> DataFrame:
    """Claims without a verdict: those with one are taken out by their ids."""
    return sets.without_ids(read_table(spark, d, "claim").select("id"), read_table(spark, d, "verdict").select(F.col("claimId").alias("id")), "id")


@query("SELECT DISTINCT page_id, text FROM claim c WHERE NOT EXISTS (SELECT 1 FROM claim e WHERE e.page_id = c.page_id AND e.text = c.text AND e.id LIKE '%-1')")
def claims_new(spark: SparkSession, d: str) -> DataFrame:
    claims = read_table(spark, d, "claim").select("id", "page_id", "text")
    return sets.only_new(claims, claims.filter("id like '%-1'"), ["page_id", "text"]).select("page_id", "text")


@query("SELECT h.hit_id, EXISTS (SELECT 1 FROM fact_check_hit f WHERE f.publisherSite = h.domain) AS member FROM search_hit h WHERE h.domain IS NOT NULL")
def hits_of_publishers(spark: SparkSession, d: str) -> DataFrame:
    sites = read_table(spark, d, "fact_check_hit").filter("publisherSite is not null").select(F.col("publisherSite").alias("domain"))
    hits = read_table(spark, d, "search_hit").filter("domain is not null").select("hit_id", "domain")
    return sets.flag_members(hits, sites, "domain").select("hit_id", "member")


@query("""WITH a AS (SELECT user_id, event_type, sum(value) AS v FROM events WHERE value >= 50 GROUP BY ALL), b AS (SELECT user_id, event_type, sum(value) AS v FROM events WHERE value < 50 GROUP BY ALL),
j AS (SELECT abs(coalesce(a.v, 0) - coalesce(b.v, 0)) AS gap FROM a FULL JOIN b USING (user_id, event_type)) SELECT count(*) AS pairs, round(avg(gap), 4) AS mean, round(max(gap), 4) AS largest FROM j""")
def matrix_difference(spark: SparkSession, d: str) -> DataFrame:
    """Two matrices of sums by user and type, of large and of small values; both together hold every event."""
    events = read_table(spark, d, "events").groupBy("user_id", "event_type", (F.col("value") >= 50).alias("large")).agg(F.sum("value").alias("v"))
    out = sets.difference(events.filter("large"), events.filter("not large"), ["user_id", "event_type"], "v")
    return out.select("pairs", F.round("mean", 4).alias("mean"), F.round("largest", 4).alias("largest"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, CASE WHEN value > 400 THEN 0.0 ELSE value END AS held, value > 400 AS shown FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN f.held + e.value > 400 THEN 0.0 ELSE f.held + e.value END, f.held + e.value > 400 FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1) SELECT event_id FROM f WHERE shown""")
def progress_throttle(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.throttle(read_table(spark, d, "events"), "user_id", "value", 400).select("event_id")


@query("SELECT event_id, 'm' || user_id AS base, CASE WHEN value * 1000 < 1000 THEN CAST(CAST(round_even(value * 1000, 0) AS BIGINT) AS VARCHAR) ELSE format('{:,}', CAST(round_even(value * 1000, 0) AS BIGINT)) END AS shown FROM events")
def display_values(spark: SparkSession, d: str) -> DataFrame:
    tag = F.concat(F.lit("m"), F.col("user_id").cast("string"), F.lit(":latest"))
    return read_table(spark, d, "events").select("event_id", X.base_model_name(tag).alias("base"), X.grouped(F.col("value") * 1000).alias("shown"))


@query("""SELECT url, CASE WHEN title IS NULL THEN '' ELSE trim(regexp_replace(title, '[ \\t\\r\\n\\x{00a0}]+', ' ', 'g')) END AS title FROM extracted_page WHERE url IS NOT NULL""")
def source_titles(spark: SparkSession, d: str) -> DataFrame:
    pages = html_pages(spark, d).join(read_table(spark, d, "extracted_page").select("page_id", "url"), "page_id").filter("url is not null")
    return providers.fetched_sources(pages).select("url", "title")


@query("SELECT v.claimId, v.url, CASE WHEN lower(alignment) LIKE 'agree%' THEN 'evidence-agree' ELSE 'evidence-disagree' END AS kind, count(*) AS n FROM verdict v WHERE evidence IS NOT NULL AND evidence <> '' AND (lower(alignment) LIKE 'agree%' OR lower(alignment) LIKE 'disagree%' OR lower(alignment) LIKE 'contradict%') GROUP BY ALL")
def evidence_highlights(spark: SparkSession, d: str) -> DataFrame:
    return locate.evidence_targets(read_table(spark, d, "verdict")).groupBy("claimId", "url", "kind").agg(F.count("*").alias("n"))
