from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweft.llm import blocks, canonical, lang, leak, queries, residue, spam, split, tokenize

DATA = Path("/root/testdata/sf0.001")
LONG = "The council met. " * 20_000
ODD = [None, "", "  \n ", "\x00\x01", "😀" * 50, LONG, "<|endoftext|>", "a" * 5000, "中文" * 300]


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


@pytest.fixture(scope="module")
def code(spark):
    return lang.fit_language_code(table(spark, "lang_sample"), table(spark, "eval_item"))


# --- 6: tokens

def test_ids_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{tokenize.TOKENIZER_DIR}/byte_bpe_50k.json")
    tokenizer.encode_special_tokens = True
    rows = spark.createDataFrame(list(enumerate(ODD + ODD)), "doc_id int, text string").withColumn("ids", F.lit(7)).withColumn("x.y", F.lit("kept"))
    got = tokenize.encode_documents(rows, with_offsets=True)
    assert got.columns == ["doc_id", "text", "x.y", "ids", "offsets"]
    for r in got.collect():
        assert r.ids == (tokenizer.encode(r.text, add_special_tokens=False).ids if r.text else [])
        assert len(r.offsets) == len(r.ids) and all(0 <= a < b <= len(r.text) for a, b in r.offsets)
    back = tokenize.decode_documents(got.select("doc_id", "text", "ids"))
    assert all(r.decoded == (r.text or "") for r in back.collect())
    assert tokenize.encode_documents(rows.limit(0)).count() == 0


def test_split_characters_are_joined_again():
    decoder = tokenize.PieceDecoder(f"{tokenize.TOKENIZER_DIR}/byte_bpe_50k.json")
    ids = tokenize.PieceEncoder(f"{tokenize.TOKENIZER_DIR}/byte_bpe_50k.json").encode("x𐍈y")
    assert decoder.decode(ids) == "x𐍈y"
    assert decoder.offsets(ids)[0] == (0, 1) and decoder.offsets(ids)[-1] == (2, 3) and {o for o in decoder.offsets(ids)[1:-1]} == {(1, 2)}
    assert "�" in decoder.decode(ids[1:2])


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tokenize.PieceEncoder(f"{tokenize.TOKENIZER_DIR}/word_bpe_49k.json")


# --- 5: pieces

def check_pieces(text, limit, overlap):
    run, pieces = split.split_text(text, limit, overlap)
    words = text.split()
    covered = []
    for k, p in enumerate(pieces):
        own = p["piece"].split()
        assert len(own) == p["n_words"] <= limit
        assert own == words[p["first_word"]:p["first_word"] + p["n_words"]]
        if k:
            before = pieces[k - 1]["piece"].split()
            assert own[:p["n_overlap"]] == before[-p["n_overlap"]:] and p["n_overlap"] == min(overlap, len(before))
        covered += own[p["n_overlap"]:]
    assert covered == words
    return run, pieces


def test_pieces_keep_their_rules():
    rng = random.Random(2)
    for _ in range(60):
        words = [rng.choice(["a", "b.", "c?\"", "d\n", "e\n\nf", "g…)"]) if rng.random() < rng.choice([.02, .2]) else "w" for _ in range(rng.randrange(1, 900))]
        check_pieces(" ".join(words), 40, 5)
    run, pieces = check_pieces("w " * 1000, 400, 40)
    assert run == 1000 and [p["n_words"] for p in pieces] == [400, 400, 280] and {p["boundary"] for p in pieces[1:]} == {split.FORCED}
    run, pieces = check_pieces("\n".join(["w " * 99 + "end."] * 8), 400, 40)
    assert run == 100 and all(p["boundary"] == split.LINE for p in pieces[1:])
    assert split.split_text(None, 400, 40) == (0, []) and split.split_text(" \n", 400, 40) == (0, [])


def test_split_table(spark):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "page_id int, text string, Pieces string")
    got = {r.page_id: r for r in split.split_oversized(rows).collect()}
    assert len(got[5].pieces) > 100 and [len(got[i].pieces) for i in (0, 1, 2, 7)] == [0, 0, 0, 1]
    with pytest.raises(ValueError):
        split.split_oversized(rows, limit=10, overlap=10)


# --- 4: canonical entries

def plain_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_tree_gives_every_entry_within_the_threshold():
    rng = random.Random(3)
    names = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    tree = canonical.BKTree()
    for i, n in enumerate(names):
        tree.add(n, i)
    for _ in range(100):
        q = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 9)))
        assert all(canonical.distance(q, n) == plain_distance(q, n) for n in names[:20])
        for t in (0, 1, 3):
            assert {e for _, _, e in tree.within(q, t)} == {i for i, n in enumerate(names) if plain_distance(q, n) <= t}


@pytest.mark.parametrize("shard", [50_000, 2])
def test_mapping(spark, shard):
    reference = spark.createDataFrame([(1, "True", ["Wahr", None]), (2, "Mostly true", None), (3, "The Example Ledger", ["Beispiel & Co"]), (4, None, [None]), (5, "tru", [])], "rid int, label string, aliases array<string>")
    values = ["TRUE", "Verdict: «Mostly  true»", "Ledger, The Exmaple", "Ｗａｈｒ", "waһr", "Beispiel &amp; Co.", "nothing like it", "", None, " \t", "Truee", "True"] + ["True"] * 30
    rows = spark.createDataFrame([(i, v, 0) for i, v in enumerate(values)], "i int, v string, ref_id int")
    got = {r.i: r for r in canonical.map_to_canonical(rows, "v", reference, "rid", ["label", "aliases"], shard_entries=shard).collect()}
    assert [got[i].ref_id for i in (0, 1, 2, 3, 5, 6, 10, 11)] == [1, 2, 3, 1, 3, 0, 1, 1]
    assert not {7, 8, 9} & set(got) and len(got) == len(values) - 3 and got[6].distance is None
    assert {r.ref_id for r in canonical.map_to_canonical(rows, "v", reference.limit(0), "rid", ["label"]).collect()} == {0}


def test_ties_go_to_the_lowest_id(spark):
    reference = spark.createDataFrame([(9, "abcdex"), (4, "abcdey")], "rid int, label string")
    got = canonical.map_to_canonical(spark.createDataFrame([("abcdez",)], "v string"), "v", reference, "rid", ["label"]).first()
    assert (got.ref_id, got.distance, got.ambiguous) == (4, 1, True)


# --- 7: leaks

def test_leaks(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    items = spark.createDataFrame([(1, "Do it.\n" + passage), (2, "Do it.\nshort one"), (3, None), (4, "Do it.\n" + passage)], "item_id long, text string")
    w = passage.split()
    changed = w[5:30]
    changed[8], changed[17] = "XX", "YY"
    added = w[20:41]
    added.insert(10, "also")
    docs = {
        1: passage, 2: "x " + " ".join(changed).upper().replace(" ", "\n") + " y", 3: " ".join(w[:19]), 4: "a b " + ", ".join(added), 5: "Do it. " + " ".join(w[i] for i in range(0, 60, 2)),
        6: None, 7: "", 8: "q " * 50_000 + passage, 9: "&quot;" + passage.replace("word", "w&ouml;rd").replace("w&ouml;rd", "wôrd") + "&quot;", 10: passage,
    }
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = {(r.doc_id, r.item_id) for r in leak.find_leaks(rows, items).collect()}
    assert got == {(d, i) for d in (1, 2, 4, 8, 9, 10) for i in (1, 4)}
    assert {(r.doc_id, r.item_id) for r in leak.find_leaks(rows, items, block_words=10).collect()} == got
    assert leak.find_leaks(rows.limit(0), items).count() == 0 and leak.find_leaks(rows, items.limit(0)).count() == 0


def test_passages_of_many_items_leak_for_all_of_them(spark):
    shared, own = " ".join(f"common{i}" for i in range(40)), lambda k: " ".join(f"own{k}x{i}" for i in range(30))
    rows = [(i, "Do it.\n" + shared) for i in range(6)] + [(i, f"Do it.\n{own(i)} {shared} {own(i + 100)}") for i in range(6, 12)] + [(12, "Do it.\n" + own(12))]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b " + shared + " c"), (2, shared), (3, own(12)), (4, "nothing of it " * 20)], "doc_id long, text string")
    want = {(d, i) for d in (1, 2) for i in range(12)} | {(3, 12)}
    for words in (2_000_000, 90):
        assert {(r.doc_id, r.item_id) for r in leak.find_leaks(docs, items, block_words=words).collect()} == want


def test_word_alignment_against_plain_recursion():
    rng = np.random.default_rng(5)
    for _ in range(100):
        a, b = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(0, 4, rng.integers(1, 20))
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -2), h[i, j + 1] - 1, h[i + 1, j] - 1)
        path = leak.smith_waterman(a, b)
        score = sum(-1 if i < 0 or j < 0 else 2 if a[i] == b[j] else -2 for i, j in path)
        assert score == h.max()


# --- 8: stuffed pages

def test_keywords_in_rotation_are_odd(spark, prose):
    things = [f"{a}{b} {b}{a}" for a in ("solar", "tyre", "magnet", "phone", "detox") for b in ("ora", "eno", "ista", "umi", "ante")]
    page = " ".join(f"{thing} " * (2 + i % 4) for i, thing in enumerate(things))
    article = "\n".join(r.text for r in table(spark, "claim").filter("page_id < 60 and text rlike '[.]$'").select("text").limit(40).collect())
    rows = spark.createDataFrame([(1, page), (2, article)], "doc_id long, text string")
    got = {r.doc_id: r.odd_share for r in spam.find_stuffed(rows, prose).collect()}
    assert got[1] > 0.5 and got[2] <= 0.5


def test_each_side_finds_what_the_other_cannot(spark, prose):
    things = [a + b for a in ("sleep ", "solar", "used ", "snel", "gouttes ", "cover ") for b in ("drops", "charger", "tyres", "krediet", "sommeil", "telefono", "quote")]
    lists = {1: "Tags: " + ",".join(things), 2: " ".join(sorted(things)), 3: "; ".join(things), 4: "\n".join(things), 5: "keywords= " + ", ".join(t.replace(" ", "_") for t in things)}
    repeated = {6: "Looking for used tyres? Used tyres here. Our used tyres are the used tyres you need when you search used tyres. " * 8}
    rows = spark.createDataFrame(list({**lists, **repeated}.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in spam.find_stuffed(rows, prose).collect()}
    assert {k: got[k].high_share for k in lists if got[k].high_share <= 0.5} == {}
    assert all(got[k].low_share > 0.5 >= got[k].high_share for k in repeated)


def test_word_costs_are_those_of_a_cache(prose):
    reader, draw = spam.Reader(prose), random.Random(3)
    for n in (1, 5, 99, 100, 101, 250):
        words = [f"word{draw.randint(0, 9)}x{'abcdef'[draw.randint(0, 5)]}" for _ in range(n)]
        pages = reader.pages(["Nothing here", " ".join(words), "", "one two two"])
        want = []
        for i, w in enumerate(words):
            a = i // 100 * 100
            around = words[a:a + 100] if a + 100 <= n or not a else words[-100:]
            want.append(-np.log(spam.CACHE * (around.count(w) - 1) / max(1, len(around) - 1) + (1 - spam.CACHE) / spam.VOCABULARY))
        assert np.allclose(pages.word_costs()[2:2 + n], want)
        assert pages.words.tolist() == [2, n, 3]


def test_scores_do_not_depend_on_neighbours(spark, prose):
    texts = [r.text for r in table(spark, "documents").filter("text <> ''").limit(60).collect()]
    together = np.array(spam.Scorer(prose).scores(texts))
    alone = np.array([spam.Scorer(prose).scores([t]) for t in texts])[:, :, 0].T
    assert np.allclose(together, alone)


def test_the_prose_model_is_that_of_all_rows(spark):
    draw = random.Random(7)
    words = [f"{a}{b}" for a in ("river", "council", "Bridge", "tariff", "ledger", "Harbour") for b in ("", "ed", "ing", "s", "ly")] + ["the", "of", "and", "was"] * 6
    texts = {" ".join(draw.choices(words, k=draw.randint(4, 30))) + draw.choice((".", "!", "", "; then 12.")) for _ in range(9_000)}
    texts |= {f"Row {i} was marked {c} by the council." for i, c in enumerate("§%&+=<>@|$")} | {f"Bridge {i} of the bridge, the bridge. " * 40 for i in range(3)}
    labelled = [("en", f"the council of the river and {w} was late.") for w in words[:30]]
    samples, passages = spark.createDataFrame(labelled, "lang string, text string"), spark.createDataFrame([("Read this.\nThe mayor\nwas late.",), ("No passage",)], "text string")
    sentences = spark.createDataFrame([(t,) for t in sorted(texts)] + [(None,)], "text string")
    model = spam.fit_prose_model(samples, passages, sentences)
    assert len(texts) > 8_000 and set("§%&+=<>@|$") <= set(model.raw) and {"the", "of", "and", "was", "late"} <= model.function_words

    pages = spam.Reader(model).pages([*dict.fromkeys(t for _, t in labelled), "The mayor\nwas late.", "", *sorted(texts)])
    ids, at = pages.ids.tolist(), np.flatnonzero(~pages.leads).tolist()
    one, two, three = Counter(ids[i] for i in at), Counter(tuple(ids[i - 1:i + 1]) for i in at), Counter(tuple(ids[i - 2:i + 1]) for i in at)
    after, kinds, pair, pair_kinds = Counter(), Counter(a for a, _ in two), Counter(), Counter(k[:2] for k in three)
    for (a, _), n in two.items():
        after[a] += n
    for k, n in three.items():
        pair[k[:2]] += n

    def nats(a, b, c):
        p2 = (two[b, c] + kinds[b] * one[c] / len(at)) / (after[b] + kinds[b])
        return -np.log(max(spam.FLOOR, (three[a, b, c] + pair_kinds[a, b] * p2) / (pair[a, b] + pair_kinds[a, b])))

    costs = model.costs(pages)
    assert np.allclose(costs[at], [nats(*ids[i - 2:i + 1]) for i in at]) and costs[pages.leads].sum() == 0
    means, stretches = model.class_means(pages), model.stretch_means(pages)
    assert np.allclose([model.mean, model.word_mean], [costs.sum() / len(at), pages.word_costs().mean()])
    assert np.allclose([model.high, model.low], [means.mean() + spam.HIGH * means.std(), spam.LOW * stretches.min()], rtol=1e-5)

    # Neither the order of rows nor repeated rows matter.
    again = spam.fit_prose_model(samples.union(samples), passages, sentences.union(sentences).repartition(5))
    assert (again.mean, again.word_mean, again.high, again.low, again.raw) == (model.mean, model.word_mean, model.high, model.low, model.raw)
    nothing = spam.fit_prose_model(samples.limit(0), passages.limit(0), sentences.limit(0))
    assert spam.find_stuffed(sentences.limit(1).withColumn("doc_id", F.lit(1)), nothing).count() == 1


@pytest.fixture(scope="module")
def prose(spark):
    return spam.fit_prose_model(table(spark, "lang_sample"), table(spark, "eval_item"), table(spark, "claim"))


def test_stuffed_pages(spark, prose):
    article = "\n".join(r.text for r in table(spark, "claim").filter("page_id < 20 and text rlike '[.]$'").select("text").limit(25).collect())
    texts = {
        1: "cheap loan online, best solar charger, " * 30, 2: "#CheapLoan #BestDeal #SolarCharger " * 12, 3: "\n".join(f"Place{i} thing - https://a{i}.test/go/{i}" for i in range(30)),
        4: "Buy cheap loan online at the best cheap loan price. " * 20, 5: article.split("\n")[0] + "\n" + "used tyres price " * 60,
        6: article, 7: article + "\nSources:\nhttps://a.test/1\nhttps://b.test/2", 8: article + "\nTags: town, council, water", 9: None, 10: "", 11: "one two", 12: LONG[:17],
        13: article + "\n" + "We check so that you know. " * 5,
    }
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("nats", F.lit("clash"))
    odd = {r.doc_id: r.odd_share for r in spam.find_stuffed(rows, prose).collect()}
    assert {d for d, s in odd.items() if s > 0.5} == {1, 2, 3, 4, 5}
    assert {11, 12} <= set(odd) and not {9, 10} & set(odd)  # texts of any length are scored
    assert spam.find_stuffed(rows.limit(0), prose).count() == 0
    assert spam.find_stuffed(spark.createDataFrame([(1, t) for t in ODD], "doc_id long, text string"), prose).count() > 0


# --- 1: languages

def test_held_out_accuracy(spark, code):
    # Prose only: lists of search words mix languages and have no right label.
    docs = table(spark, "documents").filter("lang in ('en','de','fr','es','it','nl') and kind in ('article', 'review', 'claim_note') and text rlike '[.!?]'")
    found = lang.detect_column(docs.select("lang", "text", F.lit(1).alias("found_lang")), code, "text")
    total, right = found.filter("found_sure >= 0.3").agg(F.count("*"), F.count_if(F.expr("lang = found_lang"))).first()
    assert total > 50 and right / total > 0.97


def test_codewords_are_apart():
    c = lang.codewords(6)
    assert c.shape == (6, 16) and min((c[i] != c[j]).sum() for i in range(6) for j in range(i)) >= 7


def test_declared(spark):
    cases = {"de-AT": "de", "GER": "de", "Deutsch": "de", "es-419": "es", "n/a": None, "xx": None, " ": None, None: None, "pt": "pt", "italiano": "it", "nl_BE": "nl", "auto": None, "-": None, "12": None}
    rows = spark.createDataFrame([(k,) for k in cases], "label string").select("label", lang.declared("label").alias("d")).collect()
    assert {r.label: r.d for r in rows} == cases == {k: lang.declared_language(k) for k in cases}


def test_odd_texts_have_a_defined_language(spark, code):
    rows = spark.createDataFrame(list(enumerate(ODD + ["12 34", "Das Amt prüfte die Zahlen.\nThe office checked the numbers again today."])), "k int, text string")
    got = {r.k: r for r in lang.detect_column(rows, code, "text").collect()}
    assert [got[i].found_lang for i in (0, 1, 2, 3, 9)] == [None] * 5 and got[5].found_lang == "en"
    by_line = {r.line_no: r.lang for r in lang.detect_lines(rows.filter("k = 10"), code, "k").collect()}
    assert by_line == {1: "de", 2: "en"}
    assert lang.detect_lines(rows.limit(0), code, "k").count() == 0


# --- 2 and 3: residue and furniture

NAMES = ["Anna Keller", "Berta Lind", "Carl Moor", "Dora Nilsson", "Emil Olsen", "Frida Park"]
TEMPLATES = [
    "The council in {} counted {} cases of flu last week.", "The mayor of {} promised {} new houses before the vote.", "A reader from {} sent us {} photos of the flood.",
    "The river near {} rose by {} centimetres within one night.",
]


def hits_of(spark, texts, urls=None):
    return spark.createDataFrame([(i, t, urls[i] if urls else f"https://h{i}.test/{i}") for i, t in enumerate(texts)], "hit_id long, snippet string, url string").withColumn("src", F.lit(0))


def cases_of(rows, prose):
    return {r.row_id for r in residue.find_residue(residue.snippet_signs(rows, prose)).collect()}


@pytest.fixture(scope="module")
def prose_vocabulary(spark):
    return residue.prose_words(table(spark, "claim")) | {w for t in TEMPLATES for w in t.lower().strip(".").split()}


def test_forms_are_induced_from_aligned_slots(spark, prose_vocabulary):
    filled = [t.format(n.split()[1], 10 + k) for t in TEMPLATES for k, n in enumerate(NAMES)]
    # None of these forms is listed anywhere; "[w]" is also a form that only prose uses here.
    unfilled = [t.format(v, 7) for v in ("<<CustomerName>>", "____", "%(place)s", "⟦ort⟧", "§town§", "undefined") for t in TEMPLATES]
    prose = ["The council said [sic] that the mayor was late and the river rose.", 'The letter opened with “Dear <<CustomerName>>” and the council was sorry.', "The council in <<lone>> was late."]
    texts = filled + unfilled + prose
    got = cases_of(hits_of(spark, texts), prose_vocabulary)
    assert got == set(range(len(filled), len(filled) + len(unfilled))) | {len(texts) - 1}


def test_error_templates_need_no_list(spark, prose_vocabulary):
    notices = [
        "Sie haben keine Zugriffsrechte für diesen Inhalt.", "Página não encontrada.", "Kindly enable quantum widgets to browse further.", "Mefisto dolor quamvis bonorum ipsetur.",
        "Fout 599 – knooppunt onbereikbaar (abc123-77).",
    ]
    reports = [f"{n} admitted that the portal of {c} Library stayed blank without quantum widgets, according to {d} Herald." for n, c, d in zip(NAMES, ("Abel", "Bern", "Cork", "Doha", "Essen", "Faro"), "UVWXYZ")]
    news = [t.format(n.split()[1], 10 + k) for t in TEMPLATES for k, n in enumerate(NAMES)]
    texts = notices * 4 + reports + news + [None, "", " \n"]
    got = cases_of(hits_of(spark, texts), prose_vocabulary)
    assert got == set(range(4 * len(notices)))
    assert cases_of(hits_of(spark, texts).limit(0), prose_vocabulary) == set()
    assert cases_of(hits_of(spark, ODD + ODD), prose_vocabulary) is not None
    assert cases_of(hits_of(spark, texts).drop("url").withColumn("url.x", F.lit(1)), prose_vocabulary) == got


def test_an_address_counts_once(spark, prose_vocabulary):
    """Names become fixed text of a template only where it recurs on several addresses."""
    report = "Zyx Qwert admitted gadgets vanished from Plok Vumm overnight."
    many = [f"https://a{i}.test/x" for i in range(4)]
    assert cases_of(hits_of(spark, [report] * 4, many), prose_vocabulary) == {0, 1, 2, 3}
    assert cases_of(hits_of(spark, [report] * 4, ["https://a.test/x", "http://www.a.test/x/", "https://a.test/x?utm=1", "https://A.test/x#top"]), prose_vocabulary) == set()


def test_pages_without_an_article_are_cases(spark, prose_vocabulary):
    plain = "\n".join(blocks.plain_line(x) for x in PAGE.split("\n") if x.strip())
    notice = "This viewer requires quantum widgets to be switched on.\n\n© 2024 Anford Post. All rights reserved."
    rows = spark.createDataFrame([(1, PAGE, plain), (2, notice, notice.replace("\n\n", "\n")), (3, None, None), (4, "", " "), (5, notice, notice)], "page_id long, markdown string, text string")
    signs = residue.page_signs(rows, prose_vocabulary)
    assert {r.row_id for r in residue.find_residue(signs).collect()} == {2, 5}
    assert residue.find_residue(residue.page_signs(rows.limit(0), prose_vocabulary)).count() == 0


PAGE = """Home | News | Sport

Accept all

# A council decides

The council in Anford decided on Monday to repair the bridge. Residents had asked for it for years. The work starts in May.

Nobody from the board was present when the folder was opened, and the minutes do not mention it. The mayor will report in June.

## Most read

[The mayor funded the pay deal](/123)

[A leaked memo](/124)

© 2024 Anford Post. All rights reserved.

Cookie settings"""


def test_article_is_kept(spark):
    text = "\n".join(blocks.plain_line(x) for x in PAGE.split("\n") if x.strip() and not x.startswith("#"))
    rows = spark.createDataFrame([(1, PAGE, text), (2, None, text), (3, PAGE, None), (4, "", ""), (5, PAGE, text), (6, "\n\n".join([PAGE] * 60), "")], "page_id long, markdown string, text string").withColumn("text_lines", F.lit(1))
    got = {r.page_id: r for r in blocks.find_furniture(rows).collect()}
    lines = PAGE.split("\n")
    kept = [x for i, x in enumerate(lines, 1) if x.strip() and i not in got[1].markdown_lines]
    assert kept == [x for x in lines if x.startswith(("# A", "The council", "Nobody"))]
    assert got[1] .markdown_lines == got[5].markdown_lines and got[3].text_lines == [] and got[4].markdown_lines == []
    assert {1, 2} <= set(got[2].text_lines) and len(got[6].markdown_lines) > 300
    article = {r.page_id: r.article for r in blocks.article_text(rows.withColumn("article", F.lit("old"))).collect()}
    assert article[1].startswith("The council in Anford") and "All rights" not in article[1] and article[3] is None
    assert blocks.find_furniture(rows.limit(0)).count() == 0


def test_handing_down_takes_linear_time():
    import time

    lines = [f"line {i} of the page" for i in range(8_000)]
    began = time.perf_counter()
    rows = blocks.handed_down("\n".join(lines), list(range(8_000)), np.zeros(8_000), "\n".join(f"other {x}" for x in lines))
    assert [p for _, p in rows] == [None] * 8_000 and time.perf_counter() - began < 0.3
    again = blocks.handed_down("a\nb\na\nb", [0, 1, 2, 3], np.array([0.0, 0.1, 0.2, 0.3]), "b\nb\na\na")
    assert again == [(0, 0.1), (1, 0.3), (2, None), (3, None)]


def test_text_is_the_plain_form_of_its_markdown(spark):
    for r in table(spark, "extracted_page").filter("markdown is not null and text is not null").collect():
        at = [i for i, x in enumerate(r.markdown.split("\n")) if x.strip()]
        rows = blocks.handed_down(r.markdown, at, np.zeros(len(at)), r.text)
        assert all(p is not None for _, p in rows)


def test_training_lowers_the_loss(capsys):
    pages = [("menu\n\nThe council met and decided on the bridge today.\n\nmenu", [1, -1, 0, -1, 1])] * 60
    weights = blocks.fit(pages, epochs=3, batch=16)
    losses = [float(x.split(":")[1].split()[0]) for x in capsys.readouterr().out.splitlines()]
    assert losses[-1] < losses[0]
    at, p = blocks.BlockLabeller(weights).pages(blocks.Reader(), [pages[0][0]])[0]
    assert at == [0, 2, 4] and p[1] < 0.5 < min(p[0], p[2])


# --- the queries

@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries(spark, name):
    got = queries.queries()[name](spark, str(DATA))
    rows = got.collect()
    columns = {
        "p1_found": ["src", "row_key", "line_no", "lang"], "p2_found": ["src", "row_id"], "p3_found": ["page_id", "field_name", "line_no"], "p4_found": ["fc_id", "field_name", "ref_id"],
        "p5_found": ["page_id", "forced"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
    }
    if name in columns:
        assert got.columns == columns[name]
        assert len({str(r) for r in rows}) == len(rows)
    assert rows
