"""Plain re-computations of the queries that SQL can't express, over the smallest test tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq

from claimweft.catalog.relational import candidate_sources
from claimweft.functions.fuzzy import partial_ratio
from claimweft.models import ports
from claimweft.models.embed import embed
from claimweft.operators.chunk import split_markdown

STOPS = {w for s in ports.STOP_WORDS.values() for w in s.split()}
VERB = re.compile(r"(?i)\b(is|are|was|were|has|had|ist|sind|war|hat|hatte|est|sont|a|ont|es|son|fue|era|ha|hanno|heeft|zijn|werd)\b|[^\W\d_]{3,}(ed|te|ten|é|ó|ò|de|den)\b")


def table(d, name):
    return pq.read_table(f"{d}/{name}.parquet").to_pylist()


def naive_score(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    top = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (3 if x == y else -2), h[i - 1][j] - 1, h[i][j - 1] - 1)
            top = max(top, h[i][j])
    return top / (3 * min(len(a), len(b))) if a and b else 0.0


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def overlap(claim, source):
    """The rule that stands in for a model, on sets."""
    def side(x):
        plain = re.sub(r"[^\w \t\r\n]", " ", x.lower()).split()
        return {w for w in plain if w not in STOPS}, len(set(plain) & set(ports.NEGATIONS)) % 2, set(re.findall(r"\d+(?:[.,]\d+)*", x))

    (a, n, i), (b, m, j) = side(claim), side(source)
    score = len(a & b) / len(a | b) if a and b else 0.0
    return round(-score if n != m or i and j and not i & j else score, 6)


def verdict(score):
    return "disagrees" if score < -0.2 else "agrees" if score >= 0.2 else "unrelated"


# --- selection

def cosines(chunks, min_df, max_share):
    bags = []
    for c in chunks:
        t = re.findall(r"\w{2,}", c.lower())
        bags.append(Counter(t) + Counter(f"{x} {y}" for x, y in zip(t, t[1:])))
    n, df = len(chunks), Counter(t for b in bags for t in b)
    rows = []
    for b in bags:
        row = {t: k * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in b.items() if min_df <= df[t] <= max_share * n}
        length = math.sqrt(sum(x * x for x in row.values())) or 1.0
        rows.append({t: x / length for t, x in row.items()})
    return rows, [[sum(x * q.get(t, 0.0) for t, x in p.items()) for q in rows] for p in rows]


def pagerank(sim):
    n = len(sim)
    rank = [1 / n] * n
    for _ in range(50):
        lost = sum(r for r, row in zip(rank, sim) if sum(row) == 0)
        new = [0.15 / n + 0.85 * (sum(rank[j] * sim[j][i] / sum(sim[j]) for j in range(n) if sum(sim[j])) + lost / n) for i in range(n)]
        moved, rank = sum(abs(x - y) for x, y in zip(new, rank)), new
        if moved < n * 1e-5:
            break
    return rank


def picked_by_relevance(imp, sim, n):
    chosen = [max(range(len(imp)), key=lambda i: (round(imp[i], 12), -i))]
    while len(chosen) < n:
        score = {i: round(0.5 * imp[i] + 0.5 * min(1 - sim[i][j] for j in chosen), 12) for i in range(len(imp)) if i not in chosen}
        chosen.append(max(score, key=lambda i: (score[i], -i)))
    return chosen


def chunks_of(d):
    for r in table(d, "extracted_page"):
        if r["text"] is not None:
            kept = [c for c in r["text"].split("\n") if len(c.strip(" ")) >= 20]
            if kept:
                yield r, kept


def check_textrank(spark, d, got):
    want = {}
    for r, kept in chunks_of(d):
        _, sim = cosines(kept, 1, 0.9)
        imp = pagerank(sim)
        for k, i in enumerate(range(len(kept)) if len(kept) <= 3 else picked_by_relevance(imp, sim, 3), 1):
            want[r["page_id"], k] = i, imp[i]
    rows = {(r["page_id"], r["rank"]): (r["pos"], r["importance"]) for r in got.collect()}
    assert rows.keys() == want.keys()
    assert all(rows[k][0] == want[k][0] and abs(rows[k][1] - want[k][1]) < 2e-6 for k in want)


def check_topics(spark, d, got):
    want = set()
    for r, kept in chunks_of(d):
        _, sim = cosines(kept, 1, 0.9)
        imp, left, groups = pagerank(sim), list(range(len(kept))), []
        while left:
            near = [i for i in left if i == left[0] or sim[left[0]][i] >= 0.1]
            groups.append(near)
            left = [i for i in left if i not in near]
        at = lambda i: round(imp[i], 12)
        groups.sort(key=lambda g: (-len(g), -at(g[0]), g[0]))
        chosen = [min(g, key=lambda i: (-at(i), i)) for g in groups[:3]]
        chosen += sorted(set(range(len(kept))) - set(chosen), key=lambda i: (-at(i), i))[:3 - len(chosen)]
        want |= {(r["page_id"], k, i) for k, i in enumerate(range(len(kept)) if len(kept) <= 3 else chosen, 1)}
    assert {(r["page_id"], r["rank"], r["pos"]) for r in got.collect()} == want


def check_analysed(spark, d, got):
    want = set()
    for r, kept in chunks_of(d):
        if len(r["text"].split()) < 80:
            continue
        rows, sim = cosines(kept, 2, 0.95)
        imp = [sum(x.values()) for x in rows]
        for k, i in enumerate(range(len(kept)) if len(kept) <= 5 else picked_by_relevance(imp, sim, 5), 1):
            lead = re.match(r"([\s\S]*?[.!?…][”»“\"’)]*)(?:\s|$)", kept[i])
            want.add((r["page_id"], f"c{k}", lead[1] if lead else kept[i], kept[i], round(imp[i], 6)))
    assert {(r.page_id, r.claim_id, r.text, r.quote, round(r.importance, 6)) for r in got.collect()} == want


# --- alignment

def check_evidence(spark, d, got):
    pages = {r["page_id"]: r["text"].split("\n") for r in table(d, "extracted_page") if r["text"] is not None}
    want = set()
    for c in table(d, "claim"):
        a = words(c["text"])
        scored = [(round(naive_score(a, words(x)), 6), i) for i, x in enumerate(pages.get(c["page_id"], [])) if x.strip()]
        best = sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1]))[:3]
        want |= {(c["id"], i, s, k) for k, (s, i) in enumerate(best, 1)}
    assert {(r.id, r.pos, r.score, r["rank"]) for r in got.collect()} == want


def check_verified(spark, d, got):
    claims = {c["id"]: c["text"] for c in table(d, "claim")}
    read = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    sources = candidate_sources(read("claim"), read("search_hit").filter("url is not null"), read("extracted_page")).collect()
    want = set()
    for s in sources:
        claim, best = claims[s.claimId], (0.0, None)
        for part in re.split(r"(?<=[.!?…])\s+", s.snippet or ""):
            score = round(naive_score(words(claim), words(part)), 6) if len(part) >= 10 else 0.0
            best = max(best, (score, part), key=lambda x: x[0])
        nli = overlap(claim, best[1]) if best[1] else 0.0
        want.add((s.claimId, s.hit_id, nli, verdict(nli), best[1]))
    assert {(r.id, r.hit_id, r.score + 0.0, r.verdict, r.evidence) for r in got.collect()} == want


def check_sources(spark, d, got):
    """Ranks and judgements anew, over the chunks that the library's own cutting and cleaning give."""
    from pyspark.sql import functions as F

    from claimweft.functions.text import plain_markdown
    pages = spark.read.parquet(f"{d}/extracted_page.parquet")
    rows = [(r["page_id"], i, c) for r in table(d, "extracted_page") for i, c in enumerate(split_markdown(r["markdown"])) if len(c) > 250]
    made = spark.createDataFrame(rows, "page_id long, pos int, c string").select("page_id", "pos", F.array_join(ports.complete_sentences(plain_markdown("c")), " ").alias("c"))
    chunks = defaultdict(list)
    for r in made.orderBy("page_id", "pos").collect():
        if r.c:
            chunks[r.page_id].append(r.c)
    empty = {r.page_id for r in pages.filter("length(coalesce(markdown, '')) < 10").collect()}
    want = set()
    for c in table(d, "claim"):
        scored = [(round(naive_score(words(c["text"]), words(x)), 6), x) for x in chunks[c["page_id"]]]
        best = [x for s, x in sorted(scored, key=lambda x: -x[0]) if s > 0][:3]
        said = [overlap(c["text"], x) for x in best]
        top = max(range(len(said)), key=lambda i: abs(said[i])) if said else None
        score = said[top] if said else 0.0
        note = "no text" if c["page_id"] in empty else None if said else "nothing alike"
        want.add((c["id"], c["page_id"], score + 0.0, verdict(score), best[top] if said else None, note))
    assert {(r.id, r.page_id, r.score + 0.0, r.verdict, r.evidence, r.note) for r in got.collect()} == want


def check_relevance(spark, d, got):
    parts = defaultdict(list)
    for h in table(d, "search_hit"):
        if h["snippet"] is not None:
            parts[h["claimId"]] += re.split(r"[.!?]\s+", h["snippet"].lower())
    want = {}
    for c in table(d, "claim"):
        for name in re.findall(r"(?:[A-Z]\.|[A-ZÀ-Ý][^\W\d_]+)(?: [A-ZÀ-Ý][^\W\d_]+)+", c["text"]):
            r = [partial_ratio(name.lower(), p) / 100 for p in parts[c["id"]]]
            if r:
                total, n = want.get((c["id"], name), (0.0, 0))
                want[c["id"], name] = total + sum(x for x in r if x >= 0.5), n + len(r)
    rows = {(r.id, r.entity): (r.relevance, r.parts) for r in got.collect()}
    assert rows.keys() == want.keys()
    assert all(abs(rows[k][0] - want[k][0]) < 1e-5 and rows[k][1] == want[k][1] for k in want)


# --- texts and vectors

def check_pieces(spark, d, got):
    want = set()
    for r in table(d, "extracted_page"):
        pieces = split_markdown(r["markdown"])
        assert all(250 <= len(p) <= 500 for p in pieces)
        if pieces:
            want.add((r["page_id"], len(pieces), max(map(len, pieces)), sum(map(len, pieces))))
    assert {tuple(r) for r in got.collect()} == want


def check_markdown(spark, d, got):
    want = set()
    for r in table(d, "extracted_page"):
        if r["text"] is not None:
            lines = [" ".join(x.split()) for x in r["text"].split("\n")]
            text = "\n\n".join(["# Head", *(x for x in lines if x), "- one\n- **two**"])
            want.add((r["page_id"], hashlib.md5(text.encode()).hexdigest(), len(text)))
    assert {tuple(r) for r in got.collect()} == want


def check_neighbours(spark, d, got):
    rows = embed(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").filter("text is not null")).select("doc_id", "embedding").collect()
    ids = np.array([r.doc_id for r in rows])
    m = np.array([r.embedding for r in rows], np.float64)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    want = set()
    for k in np.flatnonzero(ids % 100 == 0):
        s = np.round(m @ m[k], 9)
        order = [i for i in np.lexsort((ids, -s)) if i != k][:5]
        want |= {(int(ids[k]), int(ids[i]), n) for n, i in enumerate(order, 1)}
    assert {(r.query_id, r.id, r["rank"]) for r in got.collect()} == want


def check_kmeans(spark, d, got):
    """Each of the ten clusters is stood for by the row nearest to the centre of the rows that are nearest to it."""
    from claimweft.operators import vectors

    rows = vectors.kmeans_labels(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding"), 10).collect()
    m, label, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.cluster for r in rows]), np.array([r.vec_id for r in rows])
    centre = np.array([m[label == k].mean(0) for k in range(10)])
    far = np.linalg.norm(m[:, None] - centre[None], axis=2)
    assert (far.argmin(1) == label).mean() > 0.97  # the last round may leave a few at a boundary
    want = {}
    for k in range(10):
        own = np.flatnonzero(label == k)
        best = min(own, key=lambda i: (-round(1 - far[i, k] / far[own, k].max(), 9), ids[i]))
        want[k] = int(ids[best]), round(float(far[best, k]), 6)
    assert {r.cluster: (r.vec_id, round(r.distance, 6)) for r in got.collect()} == want


BRUTE = {
    "textrank_selection": check_textrank, "topic_selection": check_topics, "analysed_pages": check_analysed, "claim_evidence": check_evidence, "verified_claims": check_verified,
    "verified_sources": check_sources, "claim_relevance": check_relevance, "markdown_pieces": check_pieces, "page_markdown": check_markdown, "document_neighbours": check_neighbours,
    "kmeans_representatives": check_kmeans,
}
