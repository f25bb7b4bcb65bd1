"""Term weights, vectors, graphs, alignment and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweft.catalog import query
from claimweft.functions.fuzzy import partial_ratio_column
from claimweft.functions.text import sentence_parts
from claimweft.models import ports
from claimweft.models.embed import embed
from claimweft.operators import graph, tfidf, vectors
from claimweft.operators.align import best_aligned, strongest
from claimweft.operators.chunk import lines, markdown_chunks
from claimweft.operators.search import top_per_key
from claimweft.operators.select import select_chunks
from claimweft.sources.tables import read_table, spread

# --- Term weights -----------------------------------------------------------------------------------------------------

_TF = """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, unnest(w) AS term FROM t UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t),
tf AS (SELECT doc_id, term, count(*) AS tf FROM k GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), i AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf, df, n FROM df, n),
r AS (SELECT doc_id, term, tf * idf AS raw, df, n FROM tf JOIN i USING (term)), """
_W = _TF + "r2 AS (SELECT * FROM r WHERE df >= 2 AND df <= 0.95 * n), l AS (SELECT doc_id, sqrt(sum(raw * raw)) AS length FROM r2 GROUP BY 1), w AS (SELECT doc_id, term, raw / length AS weight FROM r2 JOIN l USING (doc_id)) "


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "documents").select("doc_id", "text").filter("text is not null"))


@query(_W + "SELECT doc_id, round(sum(weight), 4) AS importance, count(*) AS terms FROM w GROUP BY 1")
def tfidf_importance(spark: SparkSession, d: str) -> DataFrame:
    out = tfidf.importance(tfidf.tfidf(_documents(spark, d).select("doc_id", "text")))
    return out.select("doc_id", F.round("importance", 4).alias("importance"), "terms")


@query(_W + "SELECT doc_id, term, round(weight, 5) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS k FROM w) WHERE k <= 5")
def tfidf_top_terms(spark: SparkSession, d: str) -> DataFrame:
    w = tfidf.tfidf(_documents(spark, d).select("doc_id", "text")).withColumn("_r", F.round("weight", 9))
    return top_per_key(w, ["doc_id"], 5, F.desc("_r"), F.asc("term")).select("doc_id", "term", F.round("weight", 5).alias("weight"))


_WORDS = """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents WHERE text IS NOT NULL), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL), i AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= 0.95 * n),
r AS (SELECT doc_id, term, tf * idf AS raw FROM tf JOIN i USING (term)), l AS (SELECT doc_id, sqrt(sum(raw * raw)) AS length FROM r GROUP BY 1), w AS (SELECT doc_id, term, raw / length AS weight FROM r JOIN l USING (doc_id)) """


@query(_WORDS + """, s AS (SELECT a.doc_id AS query_id, b.doc_id AS id, round(sum(a.weight * b.weight), 6) AS score FROM w a JOIN w b USING (term) WHERE a.doc_id % 100 = 0 AND a.doc_id <> b.doc_id GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 4) AS score, rank FROM k WHERE rank <= 5""")
def tfidf_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The stated queries are the documents whose id is divisible by 100. Terms of up to 0.95 of all documents count, so
    the members of a large group of copies keep their weights and find each other."""
    docs = _documents(spark, d).select("doc_id", "text")
    out = tfidf.cosine_top_blocks(tfidf.tfidf(docs, bigrams=False), docs.filter("doc_id % 100 = 0"), 5)
    return out.select("query_id", "id", F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_ENT = """WITH c AS (SELECT doc_id, unnest(range(0, len(a))) AS pos, unnest(a) AS chunk FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)),
k AS (SELECT * FROM c WHERE trim(regexp_replace(chunk, '[\\t\\r\\x{00a0}]', ' ', 'g')) <> ''), m AS (SELECT doc_id, pos, unnest(regexp_extract_all(chunk, '(?:[A-Z]\\.|[A-ZÀ-Ý][\\p{L}]+)(?: [A-ZÀ-Ý][\\p{L}]+)+')) AS entity FROM k),
e AS (SELECT doc_id, entity, count(*) AS mentions, CASE WHEN regexp_matches(entity, '^[A-Z]\\. ') THEN 1.2 WHEN regexp_matches(entity, '(Institute|Office|Board|Company|Forum|Bureau|Institut|Instituto|Oficina|Red|Netz|Stadtwerke)') THEN 1.1 ELSE 1.0 END AS w FROM m GROUP BY ALL HAVING count(*) >= 2)"""


@query(_ENT + " SELECT doc_id, entity, mentions FROM e")
def entity_candidates(spark: SparkSession, d: str) -> DataFrame:
    chunks = lines(_documents(spark, d), ["doc_id"])
    named = tfidf.entity_mentions(chunks, ["doc_id"])
    return named.groupBy("doc_id", "entity").agg(F.count("*").alias("mentions")).filter("mentions >= 2")


@query(_ENT + """, t AS (SELECT k.doc_id, k.pos, e.entity, e.w, (length(k.chunk) - length(replace(lower(k.chunk), lower(e.entity), ''))) // length(e.entity) AS tf FROM k JOIN e USING (doc_id)), p AS (SELECT * FROM t WHERE tf > 0),
f AS (SELECT doc_id, entity, count(*) AS df FROM p GROUP BY ALL), n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY 1), s AS (SELECT p.doc_id, p.pos, sum(tf * (ln(n / (df + 1)) + 1) * w) AS score FROM p JOIN f USING (doc_id, entity) JOIN n USING (doc_id) GROUP BY ALL),
a AS (SELECT k.doc_id, k.pos, round(coalesce(s.score, 0), 6) AS score FROM k LEFT JOIN s USING (doc_id, pos)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM a) SELECT doc_id, pos, score, rank FROM r WHERE rank <= 3""")
def entity_top_chunks(spark: SparkSession, d: str) -> DataFrame:
    scored = tfidf.entity_scores(lines(_documents(spark, d), ["doc_id"]))
    top = top_per_key(scored, ["doc_id"], 3, F.desc("score"), F.asc("pos"))
    return top.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "score", F.col("rank").cast("bigint").alias("rank"))


_PAIRS = """WITH RECURSIVE v AS (SELECT DISTINCT lower(trim(name)) AS name FROM publisher_list UNION SELECT DISTINCT lower(trim(short_name)) FROM publisher_list),
p AS (SELECT a.name AS a, b.name AS b FROM v a JOIN v b ON a.name < b.name AND (contains(a.name, b.name) OR contains(b.name, a.name)
 OR len(list_intersect(list_distinct(string_split(a.name, ' ')), list_distinct(string_split(b.name, ' ')))) / len(list_distinct(list_concat(string_split(a.name, ' '), string_split(b.name, ' ')))) > 0.5))"""


def _names(spark: SparkSession, d: str) -> DataFrame:
    names = read_table(spark, d, "publisher_list")
    return names.select("name").unionByName(names.select(F.col("short_name").alias("name"))).select(F.lower(F.trim("name")).alias("name")).distinct()


@query(_PAIRS + " SELECT a, b FROM p")
def entity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.name_pairs(_names(spark, d))


@query(_PAIRS + """, u AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT name AS node, name AS seen FROM v UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen), c AS (SELECT node, min(seen) AS component FROM r GROUP BY 1)
SELECT component, arg_min(node, (length(node), node)) AS label, count(*) AS size FROM c GROUP BY 1""")
def entity_components(spark: SparkSession, d: str) -> DataFrame:
    names = _names(spark, d)
    found = graph.connected_components(names.withColumnRenamed("name", "node"), graph.name_pairs(names))
    return graph.shortest_name(found.withColumnRenamed("node", "name"))


# --- Vectors ----------------------------------------------------------------------------------------------------------

_V = "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, label, e, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS n FROM v)"


@query(_V + """, s AS (SELECT q.vec_id AS query_id, r.vec_id AS id, round(list_dot_product(q.n, r.n), 9) AS score FROM u q JOIN u r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, rank FROM k WHERE rank <= 5""")
def cosine_neighbours(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings")
    out = vectors.cosine_top_k(rows.filter("vec_id % 100 = 0"), rows, 5)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(_V + ", c AS (SELECT i, avg(n[i]) AS m FROM u, range(1, 65) t(i) GROUP BY i), m AS (SELECT list(m ORDER BY i) AS m FROM c) SELECT vec_id, round(list_dot_product(n, m), 6) AS importance FROM u, m")
def mean_similarity(spark: SparkSession, d: str) -> DataFrame:
    out = vectors.mean_similarity(read_table(spark, d, "embeddings"))
    return out.select("vec_id", F.round("importance", 6).alias("importance"))


_CENTRE = _V + ", c AS (SELECT label, i, avg(e[i]) AS m FROM v, range(1, 65) t(i) GROUP BY ALL), z AS (SELECT label, list(m ORDER BY i) AS m FROM c GROUP BY 1), x AS (SELECT v.label, v.vec_id, list_distance(v.e, z.m) AS dist FROM v JOIN z USING (label))"


@query(_CENTRE + " SELECT label, arg_min(vec_id, (-round(1 - dist / md, 9), vec_id)) AS vec_id, round(min(dist), 6) AS distance FROM x JOIN (SELECT label, max(dist) AS md FROM x GROUP BY 1) USING (label) GROUP BY label")
def centroid_nearest(spark: SparkSession, d: str) -> DataFrame:
    out = vectors.representatives(read_table(spark, d, "embeddings"), "label")
    return out.select("label", "vec_id", F.round("distance", 6).alias("distance"))


@query(_CENTRE + """, g AS (SELECT i, avg(n[i]) AS m FROM u, range(1, 65) t(i) GROUP BY i), a AS (SELECT list(m ORDER BY i) AS m FROM g), p AS (SELECT vec_id, list_dot_product(n, m) AS imp FROM u, a),
y AS (SELECT x.label, x.vec_id, x.dist, p.imp, max(dist) OVER (PARTITION BY label) AS md, max(imp) OVER (PARTITION BY label) AS mi FROM x JOIN p USING (vec_id)),
q AS (SELECT label, vec_id, round(0.7 * (1 - dist / CASE WHEN md = 0 THEN 1 ELSE md END) + 0.3 * imp / CASE WHEN mi = 0 THEN 1 ELSE mi END, 9) AS score FROM y)
SELECT label, arg_min(vec_id, (-score, vec_id)) AS vec_id, round(max(score), 6) AS score FROM q GROUP BY 1""")
def cluster_importance(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings")
    weighed = rows.join(vectors.mean_similarity(rows), "vec_id")
    out = vectors.representatives(weighed, "label", weight=0.3, importance="importance")
    return out.select("label", "vec_id", F.round("score", 6).alias("score"))


@query()
def kmeans_representatives(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors.kmeans_labels(read_table(spark, d, "embeddings").select("vec_id", "embedding"), 10)
    return vectors.representatives(rows, "cluster").select("cluster", "vec_id", F.round("distance", 6).alias("distance"))


_EDGES = _V + ", g AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.n, b.n), 9) AS s FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id), d AS (SELECT * FROM g WHERE s >= 0.35)"


@query(_EDGES + " SELECT v.vec_id, v.label, count(d.a) AS links FROM v LEFT JOIN d ON v.vec_id IN (d.a, d.b) GROUP BY ALL")
def similar_links(spark: SparkSession, d: str) -> DataFrame:
    """How many vectors of the same label are at least so near, for each vector."""
    rows = read_table(spark, d, "embeddings")
    edges = vectors.similar_edges(rows, 0.35, "label")
    ends = edges.select(F.col("a").alias("vec_id")).unionByName(edges.select(F.col("b").alias("vec_id"))).groupBy("vec_id").agg(F.count("*").alias("links"))
    return rows.select("vec_id", "label").join(ends, "vec_id", "left").select("vec_id", "label", F.coalesce("links", F.lit(0)).alias("links"))


@query(_EDGES.replace("WITH v AS", "WITH RECURSIVE v AS", 1) + """, j AS (SELECT v.label, v.vec_id AS node, coalesce(list(CASE WHEN d.a = v.vec_id THEN d.b ELSE d.a END) FILTER (d.a IS NOT NULL), []) AS near FROM v LEFT JOIN d ON v.vec_id IN (d.a, d.b) GROUP BY ALL),
k AS (SELECT label, list(vec_id) AS left_over, CAST(NULL AS BIGINT) AS seed, CAST([] AS BIGINT[]) AS members FROM v GROUP BY label),
r AS (SELECT * FROM k UNION ALL SELECT x.label, list_filter(x.left_over, lambda y: y <> j.node AND NOT list_contains(j.near, y)), j.node, list_concat([j.node], list_filter(x.left_over, lambda y: list_contains(j.near, y)))
 FROM (SELECT *, list_min(left_over) AS low FROM r WHERE len(left_over) > 0) x JOIN j ON j.node = x.low)
SELECT seed, unnest(members) AS node FROM r WHERE len(members) >= 2""")
def star_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings")
    return graph.star_clusters(rows.select(F.col("vec_id").alias("node")), vectors.similar_edges(rows, 0.35, "label"))


def _sql_pagerank(rounds: int) -> str:
    steps = "".join(
        f""", r{k + 1} AS MATERIALIZED (SELECT b.label, b.node, b.n, b.alone, 0.15 / b.n + 0.85 * (coalesce(f.flow, 0) + l.lost / b.n) AS rank FROM base b
LEFT JOIN (SELECT m.b AS node, sum(r.rank * m.share) AS flow FROM r{k} r JOIN moves m ON m.a = r.node GROUP BY 1) f USING (node) JOIN (SELECT label, sum(CASE WHEN alone THEN rank ELSE 0 END) AS lost FROM r{k} GROUP BY 1) l USING (label))"""
        for k in range(rounds))
    return _EDGES.replace(">= 0.35", ">= 0.2") + f""", h AS (SELECT a, b, s FROM d UNION ALL SELECT b, a, s FROM d), t AS (SELECT a, sum(s) AS total FROM h GROUP BY 1), moves AS MATERIALIZED (SELECT h.a, h.b, h.s / t.total AS share FROM h JOIN t USING (a)),
base AS MATERIALIZED (SELECT v.label, v.vec_id AS node, count(*) OVER (PARTITION BY v.label) AS n, v.vec_id NOT IN (SELECT a FROM moves) AS alone FROM v), r0 AS MATERIALIZED (SELECT label, node, n, alone, 1.0 / n AS rank FROM base){steps} SELECT label, node, round(rank, 6) AS rank FROM r{rounds}"""


@query(_sql_pagerank(10))
def pagerank_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings")
    edges = vectors.similar_edges(rows, 0.2, "label").select("label", "a", "b", F.col("score").alias("weight"))
    out = graph.pagerank(rows.select("label", F.col("vec_id").alias("node")), edges, "label", rounds=10)
    return out.select("label", "node", F.round("rank", 6).alias("rank"))


@query("SELECT label, count(*) AS n, round(avg(list_dot_product(e, e)), 6) AS mean_square FROM (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) GROUP BY 1")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(vectors.dot(F.col("embedding"), F.col("embedding"))), 6).alias("mean_square"))


# --- Selection and alignment ------------------------------------------------------------------------------------------

def _page_chunks(spark: SparkSession, d: str) -> DataFrame:
    pages = read_table(spark, d, "extracted_page").filter("text is not null")
    return pages.select("page_id", F.filter(F.split("text", "\n"), lambda c: F.length(F.trim(c)) >= 20).alias("chunks"))


_MMR = """WITH a AS (SELECT page_id, list_filter(string_split(text, chr(10)), lambda c: length(trim(c)) >= 20) AS c FROM extracted_page WHERE text IS NOT NULL), k AS (SELECT page_id, unnest(range(0, len(c))) AS pos, unnest(c) AS chunk, len(c) AS n FROM a),
t AS (SELECT page_id, pos, n, regexp_extract_all(lower(chunk), '[\\p{L}\\p{N}_]{2,}') AS w FROM k), u AS (SELECT page_id, pos, n, unnest(w) AS term FROM t UNION ALL SELECT page_id, pos, n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t),
f AS (SELECT page_id, pos, n, term, count(*) AS tf FROM u GROUP BY ALL), g AS (SELECT *, count(*) OVER (PARTITION BY page_id, term) AS df FROM f), x AS (SELECT page_id, pos, term, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM g WHERE df >= 2 AND df <= 0.95 * n),
w AS (SELECT page_id, pos, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY page_id, pos)) AS weight FROM x), i AS (SELECT k.page_id, k.pos, k.n, coalesce(sum(w.weight), 0) AS imp FROM k LEFT JOIN w USING (page_id, pos) GROUP BY ALL),
s AS (SELECT p.page_id, p.pos AS a, q.pos AS b, sum(p.weight * q.weight) AS sim FROM w p JOIN w q USING (page_id, term) GROUP BY ALL),
p1 AS (SELECT page_id, arg_min(pos, (-round(imp, 12), pos)) AS p FROM i WHERE n > 3 GROUP BY 1), f1 AS (SELECT i.*, p1.p AS p1, 1 - coalesce(s.sim, 0) AS far FROM i JOIN p1 USING (page_id) LEFT JOIN s ON s.page_id = i.page_id AND s.a = i.pos AND s.b = p1.p),
p2 AS (SELECT page_id, arg_min(pos, (-round(0.5 * imp + 0.5 * far, 12), pos)) AS p FROM f1 WHERE pos <> p1 GROUP BY 1), f2 AS (SELECT f1.*, p2.p AS p2, least(far, 1 - coalesce(s.sim, 0)) AS far2 FROM f1 JOIN p2 USING (page_id) LEFT JOIN s ON s.page_id = f1.page_id AND s.a = f1.pos AND s.b = p2.p),
p3 AS (SELECT page_id, arg_min(pos, (-round(0.5 * imp + 0.5 * far2, 12), pos)) AS p FROM f2 WHERE pos <> p1 AND pos <> p2 GROUP BY 1),
o AS (SELECT page_id, 1 AS rank, p AS pos FROM p1 UNION ALL SELECT page_id, 2, p FROM p2 UNION ALL SELECT page_id, 3, p FROM p3 UNION ALL SELECT page_id, pos + 1, pos FROM i WHERE n <= 3)
SELECT o.page_id, o.rank, round(i.imp, 6) AS importance FROM o JOIN i USING (page_id, pos)"""


@query(_MMR)
def mmr_selection(spark: SparkSession, d: str) -> DataFrame:
    out = select_chunks(_page_chunks(spark, d), "page_id", "chunks", 3, "mmr", 0.5)
    return out.select("page_id", F.col("rank").cast("bigint").alias("rank"), "importance")


@query()
def textrank_selection(spark: SparkSession, d: str) -> DataFrame:
    return select_chunks(_page_chunks(spark, d), "page_id", "chunks", 3, "textrank", 0.5).drop("chunk")


@query()
def topic_selection(spark: SparkSession, d: str) -> DataFrame:
    return select_chunks(_page_chunks(spark, d), "page_id", "chunks", 3, "topics", 0.1).drop("chunk")


def _claim_lines(spark: SparkSession, d: str) -> DataFrame:
    claims = spread(read_table(spark, d, "claim").select("id", "page_id", F.col("text").alias("claim")))
    pages = lines(read_table(spark, d, "extracted_page").filter("text is not null"), ["page_id"])
    return claims.join(pages.select("page_id", "pos", "chunk"), "page_id")


@query()
def claim_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The three lines of its page that align best with each claim."""
    return best_aligned(_claim_lines(spark, d), ["id"], "claim", "chunk", "pos", 3).select("id", "pos", "score", "matches", "mismatches", "gaps", "rank")


def _sql_words(x: str) -> str:
    plain = f"trim(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_ \\t\\r\\n]', ' ', 'g'), '[ \\t\\r\\n\\x{{00a0}}]+', ' ', 'g'))"
    return f"string_split({plain}, ' ')"


def _sql_in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_STOPS = _sql_in(sorted({w for s in ports.STOP_WORDS.values() for w in s.split()}))
_SIDE = "list_filter(list_distinct({w}), lambda w: w <> '' AND w NOT IN {stops}) AS c{k}, len(list_distinct(list_filter({w}, lambda w: w IN {negations}))) % 2 = 1 AS n{k}, list_distinct(regexp_extract_all({x}, '\\d+(?:[.,]\\d+)*')) AS d{k}"
_SIDES = ", ".join(_SIDE.format(w=_sql_words(x), x=x, k=k, stops=_STOPS, negations=_sql_in(ports.NEGATIONS)) for k, x in (("1", "claim"), ("2", "chunk")))


@query(f"""WITH l AS (SELECT page_id, unnest(range(0, len(a))) AS pos, unnest(a) AS chunk FROM (SELECT page_id, string_split(text, chr(10)) AS a FROM extracted_page WHERE text IS NOT NULL)),
k AS (SELECT c.id, l.pos, c.text AS claim, l.chunk FROM claim c JOIN l USING (page_id) WHERE trim(regexp_replace(l.chunk, '[\\t\\r\\x{{00a0}}]', ' ', 'g')) <> ''), s AS (SELECT id, pos, {_SIDES} FROM k),
o AS (SELECT *, CASE WHEN len(c1) > 0 AND len(c2) > 0 THEN len(list_intersect(c1, c2)) / len(list_distinct(list_concat(c1, c2))) ELSE 0.0 END AS overlap FROM s),
g AS (SELECT id, pos, round(CASE WHEN n1 <> n2 OR (len(d1) > 0 AND len(d2) > 0 AND len(list_intersect(d1, d2)) = 0) THEN -overlap ELSE overlap END, 6) AS score FROM o)
SELECT id, arg_max(pos, (abs(score), -pos)) AS pos, arg_max(score, (abs(score), -pos)) AS score FROM g GROUP BY id""")
def claim_alignment(spark: SparkSession, d: str) -> DataFrame:
    """The strongest of all lines of its page for or against each claim, by the rule that stands in for a model."""
    scored = _claim_lines(spark, d).withColumn("score", ports.alignment_score(F.col("claim"), F.col("chunk")))
    best = strongest(scored.select("id", "pos", "score"), ["id"])
    return best.select("id", F.col("pos").cast("bigint").alias("pos"), "score")


@query()
def claim_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Sum of partial ratios of each claim's names with the sentences of its hits, where they reach a half."""
    names = tfidf.entity_mentions(read_table(spark, d, "claim").select("id", F.col("text").alias("chunk")), ["id"])
    hits = read_table(spark, d, "search_hit").filter("snippet is not null").select(F.col("claimId").alias("id"), F.explode(sentence_parts("snippet")).alias("part"))
    ratio = partial_ratio_column(F.lower("entity"), F.col("part")) / 100
    scored = names.join(hits, "id").withColumn("r", ratio)
    return scored.groupBy("id", "entity").agg(F.round(F.sum(F.when(F.col("r") >= 0.5, F.col("r")).otherwise(0.0)), 6).alias("relevance"), F.count("*").alias("parts"))


@query()
def markdown_pieces(spark: SparkSession, d: str) -> DataFrame:
    pages = read_table(spark, d, "extracted_page").filter("markdown is not null")
    pieces = pages.select("page_id", F.posexplode(markdown_chunks(F.col("markdown"))).alias("pos", "chunk"))
    return pieces.groupBy("page_id").agg(F.count("*").alias("pieces"), F.max(F.length("chunk")).alias("longest"), F.sum(F.length("chunk")).alias("chars"))


@query(f"""WITH t AS (SELECT id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT id, {_sql_words("text")} AS w FROM claim)), u AS (SELECT id, w, min(i) AS i FROM t WHERE w <> '' AND w NOT IN {_STOPS} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(w) DESC, i) AS k FROM u), s AS (SELECT id, string_agg(w, ' ' ORDER BY i) AS query FROM r WHERE k <= 6 GROUP BY 1) SELECT c.id, coalesce(s.query, '') AS query FROM claim c LEFT JOIN s USING (id)""")
def claim_queries(spark: SparkSession, d: str) -> DataFrame:
    """Search queries of claims, by the rule that stands in for a model."""
    return read_table(spark, d, "claim").select("id", ports.query_terms(F.col("text")).alias("query"))


@query()
def document_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Stated queries (ids divisible by 100) against all documents, over hashed term vectors."""
    rows = embed(_documents(spark, d)).select("doc_id", "embedding")
    out = vectors.cosine_top_k(rows.filter("doc_id % 100 = 0"), rows, 5, "doc_id")
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")
