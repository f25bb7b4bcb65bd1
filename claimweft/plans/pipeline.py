"""The whole way from pages to verdicts, as one lazy plan: select passages, find sources, align, label, locate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweft.functions.text import plain_markdown, word_count
from claimweft.models import ports
from claimweft.operators.align import best_aligned, score_column
from claimweft.operators.chunk import markdown_chunks
from claimweft.operators.search import distinct_hits, top_per_key, without_own_page
from claimweft.operators.select import select_chunks


def analyse(pages: DataFrame, n: int = 5, strategy: str = "mmr", least_words: int = 80, parameter: float = 0.5) -> DataFrame:
    """(page_id, claim_id, text, quote, importance): up to ``n`` claims of each page with enough words."""
    gated = pages.filter((F.col("text") != "") & (word_count("text") >= least_words))
    chunks = gated.select("page_id", F.filter(F.split("text", "\n"), lambda c: F.length(F.trim(c)) >= 20).alias("chunks"))
    chosen = select_chunks(chunks, "page_id", "chunks", n, strategy, parameter)
    return chosen.select("page_id", F.concat(F.lit("c"), F.col("rank").cast("string")).alias("claim_id"), ports.lead_sentence(F.col("chunk")).alias("lead"), F.col("chunk").alias("quote"), "importance").select(
        "page_id", "claim_id", F.coalesce(F.nullif("lead", F.lit("")), F.col("quote")).alias("text"), "quote", "importance")


def candidate_sources(claims: DataFrame, hits: DataFrame, pages: DataFrame, n: int = 5) -> DataFrame:
    """(claimId, rank, url, title, snippet): the first ``n`` hits of each claim, each address once, without its own page."""
    own = claims.select(F.col("id").alias("claimId"), "page_id").join(pages.select("page_id", F.col("url").alias("own_url")), "page_id").select("claimId", "own_url")
    outside = without_own_page(hits, own, "claimId")
    once = distinct_hits(outside, ["claimId"], F.col("hit_id"))
    return top_per_key(once.select("claimId", "hit_id", "url", "title", "snippet"), ["claimId"], n, F.asc("hit_id"))


def _verdict(score: Column, threshold: float) -> Column:
    return F.when(score < -threshold, "disagrees").when(score >= threshold, "agrees").otherwise("unrelated")


def verify(claims: DataFrame, sources: DataFrame, threshold: float = 0.2) -> DataFrame:
    """(id, hit_id, score, verdict, evidence): each source's best sentence for its claim, and what it says of it.

    A source that can't be compared gets a score of 0 and no evidence; it doesn't stop the others. Sentences are scored in
    place, and one of each pair is left before the only shuffle after the join."""
    pairs = claims.select("id", F.col("text").alias("claim")).join(sources.select(F.col("claimId").alias("id"), "hit_id", "snippet"), "id")
    parts = pairs.select("id", "hit_id", "claim", F.posexplode_outer(F.split("snippet", "(?<=[.!?…])\\s+")).alias("pos", "sentence"))
    usable = F.when(F.length("sentence") >= 10, F.col("sentence"))
    scored = parts.withColumn("sentence", usable).withColumn("sw", F.round(score_column(F.col("claim"), F.col("sentence")), 6))
    best = scored.groupBy("id", "hit_id").agg(F.max_by(F.struct("claim", "sentence", "sw"), F.struct("sw", -F.col("pos"))).alias("b"))
    met = best.select("id", "hit_id", "b.claim", F.when(F.col("b.sw") > 0, F.col("b.sentence")).alias("evidence"))
    score = F.coalesce(ports.port("compare", "overlap")(F.col("claim"), F.col("evidence")), F.lit(0.0))
    judged = met.withColumn("score", F.when(F.col("evidence").isNotNull(), score).otherwise(0.0))
    return judged.select("id", "hit_id", "score", _verdict(F.col("score"), threshold).alias("verdict"), "evidence")


def verify_sources(
    claims: DataFrame, links: DataFrame, sources: DataFrame, n: int = 3, least: int = 250, threshold: float = 0.2, compare: str = "overlap", source: str = "source_id",
) -> DataFrame:
    """(id, source, score, verdict, evidence, note): what the text of each linked source says of a claim.

    ``claims``: id, text; ``links``: id and source; ``sources``: source and markdown. A source is cut into chunks once,
    however many claims it is held against; chunks of more than ``least`` characters count, as plain text of complete
    sentences. Smith-Waterman ranks them for each claim, the port ``compare`` judges the first ``n``, and the strongest
    judgement for or against the claim is kept. A source without text or without such a chunk keeps its row, with a score
    of 0 and a note. Joins are by id and by source; a source that very many claims share is split by AQE."""
    texts = sources.select(source, F.col("markdown").alias("_m"))
    cut = texts.select(source, F.posexplode(markdown_chunks(F.col("_m"), least=least)).alias("pos", "c")).filter(F.length("c") > least)
    plain = cut.select(source, "pos", F.array_join(ports.complete_sentences(plain_markdown("c")), " ").alias("chunk")).filter("chunk <> ''")
    asked = links.select("id", source).distinct().join(claims.select("id", F.col("text").alias("claim")), "id")
    ranked = best_aligned(asked.join(plain, source), ["id", source], "claim", "chunk", "pos", n)
    judged = ranked.join(claims.select("id", F.col("text").alias("claim")), "id").withColumn("s", ports.port("compare", compare)(F.col("claim"), F.col("chunk")))
    best = judged.groupBy("id", source).agg(F.max_by(F.struct("s", "chunk"), F.struct(F.abs("s"), -F.col("rank"))).alias("b"))
    usable = texts.select(source, (F.length(F.coalesce("_m", F.lit(""))) >= 10).alias("_usable"))
    every = asked.select("id", source).join(usable, source, "left").join(best, ["id", source], "left")
    note = F.when(~F.coalesce("_usable", F.lit(False)), "no text").when(F.col("b").isNull(), "nothing alike")
    score = F.coalesce("b.s", F.lit(0.0))
    return every.select("id", source, score.alias("score"), _verdict(score, threshold).alias("verdict"), F.col("b.chunk").alias("evidence"), note.alias("note"))
