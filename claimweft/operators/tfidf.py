"""Term weights as long tables (document, term, weight): counting, weighting and cosine stay joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweft.functions.text import occurrences
from claimweft.operators.search import top_per_key
from claimweft.session import cut_lineage


def tokens(text: Column) -> Column:
    """Lower-case words of two characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]{2,}"), F.lit(0))


def with_bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) > 1, F.concat(words, pairs)).otherwise(words)


def term_counts(docs: DataFrame, key: str, text_col: str, bigrams: bool = True) -> DataFrame:
    words = tokens(F.col(text_col))
    terms = with_bigrams(words) if bigrams else words
    return docs.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tfidf(docs: DataFrame, key: str = "doc_id", text_col: str = "text", bigrams: bool = True, min_df: int = 2, max_share: float = 0.95) -> DataFrame:
    """(key, term, weight): smooth idf ln((1+n)/(1+df))+1, rows of unit length, terms of ``min_df`` documents or more and of
    at most ``max_share`` of all. Documents that keep no term have no rows."""
    n = docs.agg(F.count("*").alias("n"))
    tf = term_counts(docs, key, text_col, bigrams)
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).filter((F.col("df") >= min_df) & (F.col("df") <= max_share * F.col("n")))
    idf = df.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("raw") / length).alias("weight"))


def importance(weights: DataFrame, key: str = "doc_id") -> DataFrame:
    return weights.groupBy(key).agg(F.sum("weight").alias("importance"), F.count("*").alias("terms"))


def cosine_top(weights: DataFrame, queries: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """(query_id, id, score, rank) for the stated ``queries`` (a table of keys) against all rows, over shared terms only.

    Rows without a shared term have score 0 and aren't listed. Skewed terms are split by AQE; sums combine before the
    shuffle of each pair."""
    q = weights.join(queries.select(key), key, "left_semi").select(F.col(key).alias("query_id"), "term", F.col("weight").alias("_q"))
    pairs = q.join(weights, "term").filter(F.col(key) != F.col("query_id")).groupBy("query_id", key).agg(F.round(F.sum(F.col("_q") * F.col("weight")), 6).alias("score"))
    return top_per_key(pairs.withColumnRenamed(key, "id"), ["query_id"], k, F.desc("score"), F.asc("id"))


def cosine_top_blocks(weights: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", block: int = 2_000, slice_rows: int = 512) -> DataFrame:
    """``cosine_top`` for weights with hot terms: (query_id, id, score, rank), by products with blocks of queries.

    A term of nearly all rows meets every query, so a join over terms would make a row for each such pair and term. Here
    the queries go to the rows in blocks of ``block``, every block in one pass; a row's terms are added up in place, and
    a batch keeps ``k`` rows a query at most. Rows without a shared term aren't listed."""
    rows = cut_lineage(weights.groupBy(key).agg(F.collect_list("term").alias("t"), F.collect_list("weight").alias("w")))
    stated = rows.join(queries.select(key).distinct(), key, "left_semi")
    kind = dict(rows.select(key).dtypes)[key]
    blocks, block_rows = [], []
    for row in stated.toLocalIterator():
        block_rows.append(tuple(row))
        if len(block_rows) == block:
            blocks.append(weights.sparkSession.sparkContext.broadcast(_query_block(block_rows)))
            block_rows = []
    if block_rows or not blocks:
        blocks.append(weights.sparkSession.sparkContext.broadcast(_query_block(block_rows)))
    found = None
    for shared in blocks:

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, slots, starts, who, weight, hot, dense = shared.value
            for big in batches:
                for begin in range(0, big.num_rows, slice_rows):
                    batch = big.slice(begin, slice_rows)
                    keys = batch.column(key).to_pylist()
                    score, often = np.zeros((len(keys), len(ids))), np.zeros((len(keys), len(dense)))
                    for r, (terms, values) in enumerate(zip(batch.column("t").to_pylist(), batch.column("w").to_pylist())):
                        for term, value in zip(terms, values):
                            h = hot.get(term)
                            if h is not None:
                                often[r, h] = value
                                continue
                            s = slots.get(term)
                            if s is not None:
                                a, b = starts[s], starts[s + 1]
                                score[r, who[a:b]] += value * weight[a:b]
                    score += often @ dense
                    at = {x: r for r, x in enumerate(keys)}
                    order = np.array([at[x] for x in sorted(keys)], np.int64)
                    out: list[tuple[int, int, float]] = []
                    for q in range(len(ids)):
                        column = score[order, q]
                        shown = np.where(column > 0, np.round(column, 6), -1.0)
                        own = at.get(ids[q])
                        best = np.argsort(-shown, kind="stable")[:k + 1]
                        best = [b for b in best.tolist() if shown[b] >= 0 and order[b] != own][:k]
                        out += [(q, int(order[b]), float(shown[b])) for b in best]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([ids[q] for q, _, _ in out], batch.schema.field(key).type), pa.array([keys[r] for _, r, _ in out], batch.schema.field(key).type),
                        pa.array([x for _, _, x in out], pa.float64()),
                    ], ["query_id", "id", "score"])

        part = rows.mapInArrow(run, f"query_id {kind}, id {kind}, score double")
        found = part if found is None else found.unionByName(part)
    return top_per_key(found, ["query_id"], k, F.desc("score"), F.asc("id"))


def _query_block(rows: list[tuple], share: float = 0.02, most: int = 1_000) -> tuple[list, dict[str, int], np.ndarray, np.ndarray, np.ndarray, dict[str, int], np.ndarray]:
    """Ids of the queries, and their weights by term: slot of the term, start of the slot, queries and weights in it. The
    terms of most queries are also rows of a matrix, so that a batch meets them in one product."""
    by: dict[str, list[tuple[int, float]]] = {}
    for q, (_, terms, values) in enumerate(rows):
        for term, value in zip(terms, values):
            by.setdefault(term, []).append((q, value))
    starts = np.cumsum([0, *(len(x) for x in by.values())])
    every = [x for held in by.values() for x in held]
    hot = {t: i for i, t in enumerate(sorted((t for t, held in by.items() if len(held) > share * len(rows)), key=lambda t: (-len(by[t]), t))[:most])}
    dense = np.zeros((len(hot), len(rows)))
    for t, i in hot.items():
        for q, value in by[t]:
            dense[i, q] = value
    return [r[0] for r in rows], {t: i for i, t in enumerate(by)}, starts, np.array([q for q, _ in every], np.int64), np.array([w for _, w in every], np.float64), hot, dense


def entity_mentions(chunks: DataFrame, keys: list[str], text_col: str = "chunk") -> DataFrame:
    """(keys, entity, label) of capitalised runs of two words or more: a stand-in for a tagger, without a model. The label
    follows from the last word's ending or a leading initial."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit("(?:[A-Z]\\.|[A-ZÀ-Ý][\\p{L}]+)(?: [A-ZÀ-Ý][\\p{L}]+)+"), F.lit(0))
    named = chunks.select(*keys, F.explode(runs).alias("entity"))
    label = F.when(F.col("entity").rlike("^[A-Z]\\. "), "PER").when(F.col("entity").rlike("(Institute|Office|Board|Company|Forum|Bureau|Institut|Instituto|Oficina|Red|Netz|Stadtwerke)"), "ORG").otherwise("LOC")
    return named.withColumn("label", label)


def entity_scores(chunks: DataFrame, doc: str = "doc_id", pos: str = "pos", text_col: str = "chunk", min_mentions: int = 2) -> DataFrame:
    """(doc, pos, score, entities): per chunk the sum of tf * idf * label weight over the document's entities.

    idf is ln(n / (df + 1)) + 1 over the document's n chunks; entities of fewer mentions than ``min_mentions`` are left
    out; people weigh 1.2, organisations 1.1. Chunks without any entity keep a score of 0. Entities meet the chunks of
    their own document only, so no product leaves it."""
    mentions = entity_mentions(chunks, [doc], text_col)
    entities = mentions.groupBy(doc, "entity").agg(
        F.count("*").alias("mentions"), F.max(F.when(F.col("label") == "PER", 1.2).when(F.col("label") == "ORG", 1.1).otherwise(1.0)).alias("w")).filter(F.col("mentions") >= min_mentions)
    n = chunks.groupBy(doc).agg(F.count("*").alias("n"))
    met = chunks.select(doc, pos, text_col).join(entities, doc).withColumn("tf", occurrences(text_col, "entity")).filter("tf > 0")
    df = met.groupBy(doc, "entity").agg(F.count("*").alias("df"))
    scored = met.join(df, [doc, "entity"]).join(n, doc).withColumn("s", F.col("tf") * (F.log(F.col("n") / (F.col("df") + 1)) + 1) * F.col("w"))
    per = scored.groupBy(doc, pos).agg(
        F.sum("s").alias("score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("s") > 0, F.struct("entity", F.round("s", 6)))))).alias("entities"))
    return chunks.select(doc, pos).join(per, [doc, pos], "left").select(doc, pos, F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), "entities")
