from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from claimweft.functions import text as X
from claimweft.functions.html import decode_numeric, extract
from claimweft.functions.jsonx import array_objects, closed_objects, extract_json, json_value, parse_json


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("url, want", [("https://A.example.com/x/?id=1", "a.example.com/x"), ("http://a.example.com/x#t", "a.example.com/x"), ("not a url", "not a url"), ("https://h.test:8080//", "h.test")])
def test_canonical_url(spark, url, want):
    assert one(spark, X.canonical_url(F.lit(url))) == want
    assert one(spark, X.canonical_url(X.canonical_url(F.lit(url)))) in (want, want)


@pytest.mark.parametrize("url, domain, want", [("https://m.a.org/p", "a.org", True), ("https://ba.org", "a.org", False), ("", "a.org", False), ("https://a.org", None, False)])
def test_in_domain(spark, url, domain, want):
    assert one(spark, X.in_domain(X.host(F.lit(url)), F.lit(domain).cast("string"))) is want


@pytest.mark.parametrize("label, want", [("Agrees", "agrees"), ("agree.", "agrees"), ("contradicts", "disagrees"), ("DISAGREE", "disagrees"), ("maybe", "unrelated"), (None, "unrelated")])
def test_alignment_label(spark, label, want):
    assert one(spark, X.alignment_label(F.lit(label).cast("string"))) == want


def test_clean_query(spark):
    assert one(spark, X.clean_query(F.lit(' "Query: foo bar"\nmore '), F.lit("claim"))) == 'foo bar"'
    assert one(spark, X.clean_query(F.lit(' "" '), F.lit("claim"))) == "claim"


def test_ellipsis(spark):
    assert one(spark, X.ellipsis(F.lit("abcdefg"), 5)) == "abcd…"
    assert one(spark, X.ellipsis(F.lit("abc"), 5)) == "abc"


def test_double_decoded_entities(spark):
    assert one(spark, X.strip_html(F.lit("<p>&amp;lt;b&amp;gt;</p><script>x</script>"))) == "<b>"
    assert decode_numeric("&#65;&#x42;&#65601;") == "ABA"


def test_plain_markdown(spark):
    assert one(spark, X.plain_markdown(F.lit("# H\n\none **two**\n\n[l](u) x"))) == "one two\nl x"


@pytest.mark.parametrize("score, colour, band", [(-0.3, "rgb(255,0,0)", "contradiction"), (0.0, "rgb(255,0,0)", "irrelevant"), (0.25, "rgb(255,128,0)", "support"), (0.5, "rgb(255,255,0)", "support"), (1.0, "rgb(0,255,0)", "support"), (-0.2, "rgb(255,0,0)", "irrelevant")])
def test_scores(spark, score, colour, band):
    assert one(spark, X.score_colour(F.lit(score))) == colour
    assert one(spark, X.score_band(F.lit(score))) == band


def test_jaccard(spark):
    split = lambda s: F.split(F.lit(s), " ")
    assert one(spark, F.round(X.jaccard(split("a b"), split("b c")), 6)) == 0.333333
    assert one(spark, X.jaccard(F.array().cast("array<string>"), split("a"))) == 0.0


def test_occurrences(spark):
    assert one(spark, X.occurrences(F.lit("Aa aab"), F.lit("aa"))) == 2
    assert one(spark, X.occurrences(F.lit("abc"), F.lit(""))) == 0


def test_tolerant_json(spark):
    assert json_value('text ```json\n{"a":1}\n``` more') == '{"a":1}'
    assert json_value('[{"a":1}') is None
    assert json_value('x {"a":"}"} y') == '{"a":"}"}'
    assert json_value(None) is None
    assert closed_objects('[\n {"a":1},\n {"b":2}]') == ['{"a":1}', '{"b":2}']
    assert closed_objects('[{"a":1},{"b":2') == ['{"a":1}']
    assert closed_objects('["x", 3, {"a":"]"}]') == ['{"a":"]"}']
    assert one(spark, extract_json(F.lit('<think>{"b":1}</think>{"a":1}'))) == '{"a":1}'
    assert one(spark, parse_json(F.lit('so: {"a": 3}'), "a int"))["a"] == 3
    assert one(spark, array_objects(F.lit('[{"a":1}'))) == ['{"a":1}']


def test_context_and_redirect(spark):
    pairs = F.create_map(F.lit("title"), F.lit("T"), F.lit("url"), F.lit("u"))
    assert one(spark, X.context_text(pairs, "url")) == "title: T"
    assert one(spark, X.unwrap_redirect(F.lit("//x/?uddg=https%3A%2F%2Fa.b%2Fc&r=1"))) == "https://a.b/c"


def test_extract_page():
    body = "word " * 120
    html = f"""<html lang="de"><head><title> A
      B </title><meta name="author" content="by Ann Lee"><meta property="article:published_time" content="2024-01-02"></head>
      <body><nav>Home</nav><article><p>{body}<p>second <b>line</b><div class="newsletter-box">Join</div><script>x()</script></article><article>short</article><footer>f</footer></body></html>"""
    got = extract(html)
    assert (got["title"], got["author"], got["published"], got["language"]) == ("A B", "Ann Lee", "2024-01-02", "de")
    assert got["strategy"] == "article" and got["noise_removed"] == 1  # the short article is no candidate
    assert got["text"].split("\n") == [body.strip(), "second line"] and got["word_count"] == 122
    assert extract(None)["text"] == "" and extract("<p>unclosed <b>x")["text"] == "unclosed x"


def test_every_page_is_extracted(spark):
    from claimweft.catalog.texts import page_extract
    from claimweft.session import shared_folder

    base = shared_folder(spark, "pages")
    rows = [
        (1, "Plain title", "plain words here " * 60), (2, "Übersicht – „neu“", "Für die Straße – “quoted” & <b> "  * 40), (3, "  two  spaces ", "long enough text " * 2_000),
        (4, None, "no title at all " * 50), (5, "Short", "few words"), (6, "No text", None), (7, "Zeilen", ("eine Zeile ü\n" * 60).strip()),
    ]
    spark.createDataFrame(rows, "page_id long, title string, text string").write.parquet(f"{base}/extracted_page.parquet")
    got = {r.page_id: r for r in page_extract(spark, base).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7]
    for page, title, text in rows:
        r = got[page]
        assert (r.title, r.words) == (" ".join((title or "").split()), len((text or "").split()))
        assert r.strategy == (("schema" if page % 3 == 1 else "article") if len(text or "") > 400 else "document")
        assert r.author == (None if page % 3 == 0 else "A. Writer")


def test_markdown_rules_of_underlines_and_quotations(spark):
    text = "Title\n---\n-\n--\n>no blank\n> quoted\n==\n===\n#tag stays\n## head goes\na  b"
    assert one(spark, X.plain_markdown(F.lit(text))) == "Title\n\n-\n--\n>no blank\nquoted\n==\n\n#tag stays\n\na b".replace("\n\n", "\n")


LONG = "word " * 100


@pytest.mark.parametrize("kind", ["NewsArticle", "Article", "BlogPosting", "ReportageNewsArticle"])
def test_marked_articles(kind):
    got = extract(f"<body><main><p>{LONG}{LONG}</p></main><div itemtype='https://schema.org/{kind}'><p>{LONG}</p></div></body>")
    assert got["strategy"] == "schema" and got["word_count"] == 100
    assert extract(f"<body><main><p>{LONG}</p></main><div itemtype='https://schema.org/Recipe'><p>{LONG}</p></div></body>")["strategy"] == "main"
    short = extract(f"<body><article>teaser</article><article><p>{LONG}</p></article><article>teaser</article></body>")
    assert short["strategy"] == "article"


def test_noise_goes_rule_by_rule():
    html = """<body><nav><div class="share">in nav</div></nav><div class="Newsletter box"><aside>first</aside><p class="social">with it</p></div><header role="banner">b</header>
    <section aria-label="More stories">m</section><div id="x-comments">c</div><div class="top-banner">t</div><div class="top-banner" role="img">kept</div><p class="sidebar promo">kept too</p></body>"""
    got = extract(html)
    # The aside goes before the box around it and counts; the paragraph in the box goes with it and doesn't.
    assert got["text"] == "kept\nkept too" and got["noise_removed"] == 7


def test_markdown_of_a_tree():
    html = """<article><h2>Head <em>line</em></h2><p>One <b>bold</b> and <a href="/u">link</a>.<br>next</p><ol><li>a</li><li>b</li></ol><blockquote><p>q</p></blockquote>
    <pre>x = 1
 y</pre><p><img src="p.png" alt="pic"> <code>c</code> <del>d</del></p><hr>loose<table><tr><th>k</th><td>v</td></tr></table></article>"""
    assert extract(html)["markdown"] == "## Head *line*\n\nOne **bold** and [link](/u).\nnext\n\n1. a\n2. b\n\n> q\n\n```\nx = 1\n y\n```\n\n![pic](p.png) `c` ~~d~~\n\n---\n\nloose\n\n| k | v |"


def test_caps(spark):
    assert one(spark, X.capped(F.lit("abcdef"), 3, "…")) == "abc…" and one(spark, X.capped(F.lit("abc"), 3, "…")) == "abc"
