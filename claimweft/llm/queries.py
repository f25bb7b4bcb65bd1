"""The pN_ queries, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweft.llm.canonical import map_to_canonical
from claimweft.llm.lang import SURE, declared, detect_column, detect_lines, fit_language_code
from claimweft.llm.leak import find_leaks
from claimweft.llm.residue import find_residue, page_signs, prose_words, snippet_signs
from claimweft.llm.spam import find_stuffed, fit_prose_model
from claimweft.llm.split import oversized, split_oversized
from claimweft.llm.tokenize import decode_documents, encode_documents
from claimweft.session import cut_lineage
from claimweft.sources.tables import read_table


def _prose(spark: SparkSession, d: str) -> frozenset[str]:
    claims, sentences = read_table(spark, d, "claim").select("text"), read_table(spark, d, "lang_sample").select("text")
    passages = read_table(spark, d, "eval_item").select(F.regexp_replace("text", r"^[^\n]*\n", "").alias("text"))
    return prose_words(claims.unionByName(sentences).unionByName(passages))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    code = fit_language_code(read_table(spark, d, "lang_sample"), read_table(spark, d, "eval_item"))
    words = _prose(spark, d)
    signs = cut_lineage(page_signs(read_table(spark, d, "extracted_page"), words, code, keep=("language",)).drop("text_lines", "markdown_lines"))
    left_out = find_residue(signs.drop("page_lang", "page_sure", "foreign", "language"))
    # Read three times below, so the anti-join and what it rests on are worked out once.
    pages = cut_lineage(signs.join(left_out, ["src", "row_id"], "left_anti").filter("page_lang is not null").select("row_id", "language", "page_lang", "foreign"))
    wrong = declared("language").isNull() | (declared("language") != F.col("page_lang"))
    by_page = pages.filter(wrong).select(F.lit("page").alias("src"), F.col("row_id").cast("string").alias("row_key"), F.lit(0).alias("line_no"), F.col("page_lang").alias("lang"))
    by_line = pages.select("row_id", F.inline("foreign")).select(F.lit("page").alias("src"), F.col("row_id").cast("string").alias("row_key"), "line_no", "lang")

    checks = detect_column(read_table(spark, d, "fact_check_hit").select("fc_id", "language", "claimText"), code, "claimText", "lang", "sure")
    label = declared("language")
    off = F.col("lang").isNotNull() & (label.isNull() | (label != F.col("lang")) & (F.col("sure") >= SURE))
    by_check = checks.filter(off).select(F.lit("fact_check").alias("src"), F.col("fc_id").cast("string").alias("row_key"), F.lit(0).alias("line_no"), "lang")

    claims = read_table(spark, d, "claim").select("id", "page_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"), F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("n"))
    lines = detect_column(claims.filter(F.col("line").rlike(r"\p{L}")), code, "line", "lang", "sure").filter(F.col("sure") >= SURE)
    of_page = pages.select(F.col("row_id").alias("page_id"), "page_lang")
    by_claim = lines.select("id", "page_id", "pos", "n", "lang").join(of_page, "page_id").filter("lang <> page_lang").select(
        F.lit("claim").alias("src"), F.col("id").alias("row_key"), F.when(F.col("n") > 1, F.col("pos") + 1).otherwise(0).alias("line_no"), "lang")
    return by_page.unionByName(by_line).unionByName(by_check).unionByName(by_claim).distinct()


def p1_document_lines(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of documents were decided for each language, and how many of them are ambiguous."""
    code = fit_language_code(read_table(spark, d, "lang_sample"), read_table(spark, d, "eval_item"))
    lines = detect_lines(read_table(spark, d, "documents"), code, "doc_id")
    return lines.groupBy("lang").agg(F.count("*").alias("lines"), F.count_if("ambiguous").alias("ambiguous"), F.avg("sure").alias("sure"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    words = _prose(spark, d)
    pages = page_signs(read_table(spark, d, "extracted_page"), words).drop("text_lines", "markdown_lines")
    return find_residue(cut_lineage(pages.unionByName(snippet_signs(read_table(spark, d, "search_hit"), words), allowMissingColumns=True)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    signs = cut_lineage(page_signs(read_table(spark, d, "extracted_page"), _prose(spark, d)))
    left_out = find_residue(signs.drop("text_lines", "markdown_lines"))
    lines = signs.join(left_out, ["src", "row_id"], "left_anti")
    fields = [F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_lines").alias("lines")) for f in ("text", "markdown")]
    named = lines.select(F.col("row_id").alias("page_id"), F.inline(F.array(*fields)))
    return named.select("page_id", "field_name", F.explode("lines").alias("line_no"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Both fields in one pass: the two lists share a table, told apart by the field's name."""
    hits = read_table(spark, d, "fact_check_hit")
    ratings = map_to_canonical(
        hits.select("fc_id", F.lit("rating").alias("field_name"), F.col("rating").alias("value")), "value",
        read_table(spark, d, "rating_list"), "rating_id", ["label", "aliases"],
    )
    publishers = map_to_canonical(
        hits.select("fc_id", F.lit("publisher").alias("field_name"), F.col("publisher").alias("value")), "value",
        read_table(spark, d, "publisher_list"), "publisher_id", ["name"], ["short_name"],
    )
    return ratings.unionByName(publishers).select("fc_id", "field_name", "ref_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pages = oversized(read_table(spark, d, "extracted_page").select("page_id", "text"))
    cut = split_oversized(pages).filter(F.size("pieces") > 1)
    return cut.select("page_id", (F.col("longest_run") > 400).cast("int").alias("forced"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    pages = oversized(read_table(spark, d, "extracted_page").select("page_id", "text"))
    cut = split_oversized(pages).filter(F.size("pieces") > 1)
    return cut.select("page_id", F.inline("pieces"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_documents(read_table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Texts that decoding doesn't give back, which must be none, beside the tokens per language."""
    docs = encode_documents(read_table(spark, d, "documents").select("lang", "text"))
    back = decode_documents(docs)
    return back.groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum(F.size("ids")).alias("tokens"),
        F.count_if(F.coalesce("text", F.lit("")) != F.col("decoded")).alias("broken"),
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_item")).select("doc_id", "item_id")


def p7_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item: the documents that hold it, and the longest passage found."""
    leaks = find_leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_item"))
    return leaks.groupBy("item_id").agg(F.count("*").alias("docs"), F.max("n_words").alias("longest"), F.min("n_edits").alias("fewest_edits"))


def _stuffed(spark: SparkSession, d: str) -> DataFrame:
    model = fit_prose_model(read_table(spark, d, "lang_sample"), read_table(spark, d, "eval_item"), read_table(spark, d, "claim"))
    return find_stuffed(read_table(spark, d, "documents"), model)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _stuffed(spark, d).filter("odd_share > 0.5").select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """How far pages are from prose, and on which side: documents and words by the tenth of odd words, in bounded groups."""
    tenth = F.least(F.floor(F.col("odd_share") * 10), F.lit(9)).cast("int").alias("tenth")
    return _stuffed(spark, d).groupBy(tenth).agg(
        F.count("*").alias("docs"), F.sum("n_words").alias("words"), F.count_if(F.col("high_share") > 0.5).alias("high"), F.count_if(F.col("low_share") > 0.5).alias("low"),
        F.avg("nats").alias("nats"), F.avg("word_nats").alias("word_nats"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("p") and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
