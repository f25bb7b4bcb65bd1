from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweft.functions.fuzzy import common_length, partial_ratio
from claimweft.models import ports
from claimweft.operators import align, graph, locate, search, select, tfidf, vectors
from claimweft.operators.chunk import long_chunks, split_markdown


def naive_score(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    top = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (3 if x == y else -2), h[i - 1][j] - 1, h[i][j - 1] - 1)
            top = max(top, h[i][j])
    return top / (3 * min(len(a), len(b))) if a and b else 0.0


def test_alignment_against_plain_recursion():
    rng = random.Random(1)
    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(0, 14))], [rng.choice("abcd") for _ in range(rng.randrange(0, 20))]) for _ in range(300)]
    want = [naive_score(a, b) for a, b in pairs]
    assert np.allclose([align.align(a, b).score for a, b in pairs], want)
    assert np.allclose(align.scores([a for a, _ in pairs], [b for _, b in pairs]), want)
    for a, b in pairs:
        got = align.align(a, b)
        assert got.matches * 3 - got.mismatches * 2 - got.gaps == round(got.score * 3 * max(1, min(len(a), len(b))))


def test_alignment_fixture():
    got = align.align("the quick brown fox".split(), "a quick red fox jumps".split())
    assert round(got.score, 6) == 0.333333
    assert align.align(list("abc"), list("xyz")) == (0.0, "", "", 0, 0, 0)


def test_marginal_relevance_fixture():
    sim = np.array([[1, .95, 0, .2], [.95, 1, 0, .2], [0, 0, 1, 0], [.2, .2, 0, 1]])
    imp = np.array([.9, .8, .1, .7])
    assert select.marginal_relevance(imp, sim, 3) == [0, 3, 2]
    assert select.marginal_relevance(imp, sim, 2) == select.marginal_relevance(imp, sim, 3)[:2]
    assert select.marginal_relevance(imp, sim, 9) == [0, 1, 2, 3] and select.marginal_relevance(imp, sim, 0) == []


def test_stars_fixture(spark):
    sim = np.eye(6)
    for i, j, s in ((0, 1, .8), (1, 2, .9), (3, 4, .7)):
        sim[i, j] = sim[j, i] = s
    assert [g for g in select.stars(sim, .7) if len(g) > 1] == [[0, 1], [3, 4]]
    edges = spark.createDataFrame([(0, 1), (1, 2), (3, 4)], "a int, b int")
    nodes = spark.range(6).select(F.col("id").cast("int").alias("node"))
    got = sorted(map(tuple, graph.star_clusters(nodes, edges).collect()))
    assert got == [(0, 0), (0, 1), (3, 3), (3, 4)]


@pytest.mark.parametrize("seed", [3, 4])
def test_distributed_stars_follow_the_greedy_order(spark, seed):
    rng = random.Random(seed)
    n, sim = 24, np.eye(24)
    edges = [(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.12]
    for a, b in edges:
        sim[a, b] = sim[b, a] = 1
    want = sorted((g[0], x) for g in select.stars(sim, .5) if len(g) > 1 for x in g)
    got = graph.star_clusters(spark.range(n).select(F.col("id").cast("int").alias("node")), spark.createDataFrame(edges, "a int, b int"))
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize(("n", "rounds", "rest"), [(300, 2, 200_000), (24, 2, 0)])
def test_long_chains_keep_their_rest(spark, n, rounds, rest):
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = graph.star_clusters(spark.range(n).withColumnRenamed("id", "node"), edges, max_rounds=rounds, rest=rest)
    assert sorted(map(tuple, got.collect())) == [(i - i % 2, i) for i in range(n)]


def test_components(spark):
    edges = spark.createDataFrame([(5, 6), (6, 7), (9, 7), (1, 2), (2, 2)], "a int, b int")
    nodes = spark.range(11).select(F.col("id").cast("int").alias("node"))
    got = dict(map(tuple, graph.connected_components(nodes, edges).collect()))
    assert {k: v for k, v in got.items() if k != v} == {6: 5, 7: 5, 9: 5, 2: 1}
    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r[1] for r in graph.connected_components(spark.range(41).withColumnRenamed("id", "node"), chain).collect()} == {0}
    assert graph.connected_components(nodes, edges.limit(0)).filter("node <> component").count() == 0


def test_pagerank_against_matrix(spark):
    edges = [("g", 0, 1, 1.0), ("g", 1, 2, 2.0), ("g", 0, 3, 0.5), ("h", 0, 1, 1.0)]
    nodes = spark.createDataFrame([("g", i) for i in range(5)] + [("h", 0), ("h", 1)], "grp string, node int")
    got = {(r.grp, r.node): r["rank"] for r in graph.pagerank(nodes, spark.createDataFrame(edges, "grp string, a int, b int, weight double"), "grp", rounds=30).collect()}
    m = np.zeros((5, 5))
    for _, a, b, w in edges[:3]:
        m[a, b] = m[b, a] = w
    want = select.page_rank(m, tolerance=0, rounds=30)
    assert np.allclose([got["g", i] for i in range(5)], want)
    assert abs(got["h", 0] - 0.5) < 1e-9


def test_cosine_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((60, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>").repartition(3)
    got = [tuple(r) for r in vectors.cosine_top_k(rows.filter("vec_id % 20 = 0"), rows, 4).orderBy("query_id", "rank").select("query_id", "id").collect()]
    u = vectors.unit(m.astype(np.float64))
    want = []
    for q in (0, 20, 40):
        s = np.round(u @ u[q], 9)
        order = [i for i in np.lexsort((np.arange(60), -s)) if i != q][:4]
        want += [(q, int(i)) for i in order]
    assert got == want
    edges = {(r.a, r.b) for r in vectors.similar_edges(rows.withColumn("g", F.lit(1)), 0.3, "g", block=16).collect()}
    full = np.round(u @ u.T, 9)
    assert edges == {(i, j) for i in range(60) for j in range(i + 1, 60) if full[i, j] >= 0.3}
    mean = {r.vec_id: r.importance for r in vectors.mean_similarity(rows).collect()}
    assert np.allclose([mean[i] for i in range(60)], (u @ u.T).mean(1))


def test_vector_expressions(spark):
    row = spark.range(1).select(
        vectors.masked_mean(F.array(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(9.0), F.lit(9.0))), F.array(F.lit(1.0), F.lit(0.0))).alias("m"),
        vectors.normalised(F.array(F.lit(0.0), F.lit(0.0))).alias("z"), vectors.distance(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))).alias("d")).first()
    assert row.m == [1.0, 3.0] and row.z == [0.0, 0.0] and row.d == 5.0


def test_idf_formula(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa cc"), (3, "dd"), (4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.term): r.weight for r in tfidf.tfidf(docs, bigrams=False, min_df=1, max_share=1.0).collect()}
    assert got[3, "dd"] == pytest.approx(1.0)
    a, b = np.log(5 / 3) + 1, np.log(5 / 2) + 1
    assert got[1, "aa"] == pytest.approx(a / np.hypot(a, b))
    assert tfidf.tfidf(docs, min_df=9).count() == 0


def test_names_and_short_ones(spark):
    names = spark.createDataFrame([("Ann Lee",), ("ann",), ("Bob Ross Fan",), ("bob ross",), ("",), ("x",), ("xy zz",)], "name string")
    got = {(r.a, r.b) for r in graph.name_pairs(names).collect()}
    assert got == {("ann", "ann lee"), ("bob ross", "bob ross fan"), ("x", "xy zz")}


def test_locate():
    assert locate.find("alpha  beta gamma", "alpha beta gamma") == 0
    assert locate.find("xx alpha beta gamma delta epsilon zeta", "alpha beta gamma delta epsilon wrong") == 3
    assert locate.find("abc", "zzz") == -1 and locate.find(None, "a") == -1 and locate.find("a", "") == -1


def test_as_of_lookup(spark):
    nodes = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 8, 4)], "k int, pos int, start int, length int")
    offsets = spark.createDataFrame([(1, 0), (1, 4), (1, 5), (1, 8), (1, 11), (1, 12), (2, 0)], "k int, offset int")
    got = {(r.k, r.offset): r.node for r in locate.node_at(offsets, nodes, "k").collect()}
    assert got == {(1, 0): 0, (1, 4): 0, (1, 5): None, (1, 8): 1, (1, 11): 1, (1, 12): None, (2, 0): None}


def test_search_composition(spark):
    hits = spark.createDataFrame([("c", 1, "https://a.x/p?q=1"), ("c", 2, "http://a.x/p/"), ("c", 3, "https://b.x/"), ("d", 4, "https://b.x")], "claimId string, hit_id int, url string")
    assert {r.hit_id for r in search.distinct_hits(hits, ["claimId"], F.col("hit_id")).collect()} == {1, 3, 4}
    own = spark.createDataFrame([("c", "https://b.x/?z")], "claimId string, own_url string")
    assert {r.hit_id for r in search.without_own_page(hits, own, "claimId").collect()} == {1, 2, 4}
    verdicts = spark.createDataFrame([("c", "u1", "agrees", 1), ("c", "u1", "unrelated", 2)], "claimId string, url string, label string, seq int")
    assert search.last_verdicts(verdicts, F.col("seq")).first().label == "unrelated"
    both = search.ordered_union(hits.filter("claimId = 'x'"), hits)
    assert search.prefer_branch(both, ["claimId"]).count() == 4


def test_fact_check_flattening(spark):
    schema = "query string, claims array<struct<text:string,claimReview:array<struct<publisher:struct<name:string,site:string>,url:string,textualRating:string>>>>"
    rows = [("q", [(None, [(("P", None), "u", None), ((None, "s"), "u", "x"), (("P", "s"), None, "x")]), ("t", None)]), ("r", None)]
    got = search.flatten_fact_checks(spark.createDataFrame(rows, schema)).collect()
    assert [(r.publisher, r.rating, r.claim_text) for r in got] == [("P", "—", "q")]


def test_lengths_of_chunks(spark):
    chunks = spark.createDataFrame([("a" * n,) for n in (249, 250, 251)], "chunk string")
    assert [len(r.chunk) for r in long_chunks(chunks).collect()] == [251]
    pieces = split_markdown("\n\n".join(["x" * 300, "y " * 200, "z" * 1200]))
    assert all(250 <= len(p) <= 500 for p in pieces) and "".join(pieces).count("z") == 1000


def test_partial_ratio():
    assert partial_ratio("abc", "xxabcxx") == 100.0 and partial_ratio("", "a") == 0.0
    assert common_length("abcde", "xaxcxe") == 3
    assert 70 < partial_ratio("climate board", "the climat board said") < 100


def test_selection_of_pages(spark):
    pages = spark.createDataFrame([(1, ["the cat sat on the mat", "the cat sat on the mat", "dogs bark at night", "the cat and dogs"]), (2, []), (3, None), (4, ["only one"])], "page_id int, chunks array<string>")
    for name in select.STRATEGIES:
        rows = select.select_chunks(pages, "page_id", "chunks", 2, name, 0.5).collect()
        assert {(r.page_id, r["rank"]) for r in rows} == {(1, 1), (1, 2), (4, 1)}
    assert np.isclose(select.page_rank(np.ones((3, 3))).sum(), 1)


def test_ports(spark):
    rows = spark.createDataFrame([("The council of the town is in the hall", "The council of the town is not in the hall"), ("", "")], "a string, b string")
    got = rows.select(ports.language_votes(F.col("a"))["lang"].alias("lang"), ports.alignment_score(F.col("a"), F.col("b")).alias("s"), ports.alignment_score(F.col("a"), F.col("a")).alias("t")).collect()
    assert got[0].lang == "en" and got[0].s < 0 < got[0].t == 1.0
    assert got[1].lang is None and got[1].s == 0.0
    with pytest.raises(ValueError):
        ports.port("compare", "nothing")
    claims = spark.createDataFrame([("p", 1, " a "), ("p", 2, " "), ("p", 3, "b"), ("p", 4, None), ("p", 5, "c")], "k string, pos int, text string")
    assert [(r.claim_id, r.text) for r in ports.accepted_claims(claims, "k", n=2).orderBy("claim_id").collect()] == [("c1", "a"), ("c2", "b")]


def test_providers(spark):
    from claimweft.sources import providers

    body = '{"web":{"results":[{"url":"https://a.x/1","title":"<b>A</b>","description":null},{"url":"not a url","title":"x"},{"url":"https://b.x/2","title":""},{"url":"https://c.x/3","title":"C","meta_url":{"hostname":"h"}}]}}'
    got = providers.json_hits(spark.createDataFrame([("q", body), ("r", "broken"), ("s", None)], "query string, body string")).orderBy("pos").collect()
    assert [(r.query, r.title, r.snippet, r.domain) for r in got] == [("q", "A", "", "a.x"), ("q", "C", "", "h")]
    links = spark.createDataFrame([("q", 0, "//r/?uddg=https%3A%2F%2Fm.a.org%2F", "a.org"), ("q", 1, "https://b.org", "a.org"), ("r", 0, "https://b.org", "a.org")], "query string, pos int, url string, d string")
    assert {(r.query, r.url) for r in providers.redirect_hits(links, domain="d").collect()} == {("q", "https://m.a.org/"), ("r", "https://b.org")}
    with pytest.raises(ValueError):
        providers.provider("none")
    one = spark.range(1).select(providers.site_query(F.lit("x"), F.lit("a.b")).alias("q"), providers.result_count(F.lit(99)).alias("n")).first()
    assert (one.q, one.n) == ("site:a.b x", 20)
    pages = spark.createDataFrame([("https://h.x/p", "<title> </title><p>a</p>"), ("https://i.x/p", "<p>b</p>")], "url string, html string")
    assert [(r.title, r.text) for r in providers.fetched_sources(pages).collect()] == [("", "a"), ("i.x", "b")]


def test_sets(spark):
    from claimweft.operators import sets

    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "k int, t string"), spark.createDataFrame([(2, "y")], "k int, t string")
    assert sets.is_contained(b, a, "t") and not sets.is_contained(a, b, "t")
    assert sorted(r.k for r in sets.without_ids(a, b, "k").collect()) == [1, 3]
    assert [r.t for r in sets.only_new(a, b, ["t"]).collect()] == ["x"]
    assert sorted((r.branch, r.k) for r in sets.ahead(b, a).collect()) == [(0, 2), (1, 1), (1, 2), (1, 3)]
    assert sum(r.member for r in sets.flag_members(a, b, "t").collect()) == 1


def test_hashed_vectors(spark):
    from claimweft.models.embed import HashedEncoder, embed

    m = HashedEncoder(16).encode(["the council met", "the council met", "", None, "other words here"])
    assert np.allclose(m[0], m[1]) and not m[2].any() and not m[3].any() and np.isclose(np.linalg.norm(m[4]), 1)
    assert len(embed(spark.createDataFrame([("a b",), (None,)], "text string")).first().embedding) == 64


def test_copies_of_a_third_of_all_rows_are_neighbours(spark, tmp_path):
    from claimweft.catalog.analytics import tfidf_neighbours

    rows = [(i, "shared letter about river water" if i % 3 == 0 else f"note{i // 10} on topic{i % 7} near place{i % 5}") for i in range(0, 303)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {(r.query_id, r.rank): (r.id, r.score) for r in tfidf_neighbours(spark, f"file://{tmp_path}").collect()}
    assert [got[0, k] for k in range(1, 6)] == [(3, 1.0), (6, 1.0), (9, 1.0), (12, 1.0), (15, 1.0)]
    assert [got[300, k] for k in range(1, 6)] == [(0, 1.0), (3, 1.0), (6, 1.0), (9, 1.0), (12, 1.0)]


@pytest.mark.parametrize("block", [2, 2_000])
def test_block_products_equal_the_join(spark, block):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k + k) % 13}" for k in range(2, 9))) for i in range(60)], "doc_id long, text string")
    w, asked = tfidf.tfidf(docs, bigrams=False), docs.filter("doc_id % 12 = 0")
    want = sorted(map(tuple, tfidf.cosine_top(w, asked, 4).select("query_id", "id", "score", "rank").collect()))
    assert sorted(map(tuple, tfidf.cosine_top_blocks(w, asked, 4, block=block, slice_rows=7).select("query_id", "id", "score", "rank").collect())) == want
    assert tfidf.cosine_top_blocks(w, asked.limit(0), 4).count() == 0


def test_preprocessing_of_selectors():
    assert select.without_stops("Der Rat, das Amt!") == "rat amt"
    assert select.long_words("Der Rat in xy prüfte das") == "rat prüfte"
    pages = ["The council met in the town hall.", "The council met in the old hall.", "Berries were frozen all winter."]
    assert select.by_textrank([select.without_stops(p) for p in pages], 1, 1.0)[0] in ([0], [1])


def test_source_texts_keep_their_rows(spark):
    from claimweft.plans.pipeline import verify_sources

    good = "The council in Anford was glad that it had repaired the old bridge within two weeks. " * 4
    against = "It was said that the council in Anford has not repaired the old bridge within two weeks. " * 4
    claims = spark.createDataFrame([("c1", "The council in Anford repaired the old bridge within two weeks."), ("c2", "Zzz qqq.")], "id string, text string")
    sources = spark.createDataFrame([("a", good), ("b", None), ("c", "short"), ("d", "# Head\n\n" + against)], "source_id string, markdown string")
    links = spark.createDataFrame([("c1", s) for s in "abcde"] + [("c2", "a"), ("c1", "a")], "id string, source_id string")
    got = {(r.id, r.source_id): r for r in verify_sources(claims, links, sources).collect()}
    assert len(got) == 6
    assert got["c1", "a"].verdict == "agrees" and got["c1", "d"].verdict == "disagrees" and got["c1", "a"].note is None
    assert [got["c1", s].note for s in "bce"] == ["no text"] * 3 and got["c2", "a"].note == "nothing alike" and got["c2", "a"].score == 0


def test_provider_names_and_branches(spark):
    from claimweft.sources import providers

    assert sorted(providers.PROVIDERS) == ["items", "json", "redirect", "wide"]
    with pytest.raises(ValueError):
        providers.provider("other")
    rows = spark.createDataFrame([("q", i, f"https://{h}.test/{i}", "t", "b.test") for i, h in enumerate("aaabb")], "query string, pos int, url string, title string, site string")
    assert [r.pos for r in providers.wide_hits(rows, limit=2, domain="site").orderBy("pos").collect()] == [3]
    assert [r.pos for r in providers.redirect_hits(rows, limit=2, domain="site").orderBy("pos").collect()] == [0, 1]
    assert [r.pos for r in providers.item_hits(rows, domain="site").orderBy("pos").collect()] == [3, 4]


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from claimweft.session import _shared_base

    conf = SimpleNamespace(get=lambda key, default: None)
    with pytest.raises(ValueError):
        _shared_base(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert _shared_base(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]"))).startswith("file:")
