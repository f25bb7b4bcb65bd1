"""Dense vectors: normalising, pooling, exact top-k search, threshold graphs, centroids.

A stated query set is held against all rows in blocks of numpy products inside Arrow batches; each batch keeps its own
best ``k`` for a query, so what is shuffled is k rows a query and batch, not a row a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweft.operators.search import top_per_key

#: Queries of one block: at most so many rows of vectors are sent to the executors at once.
QUERY_BLOCK = 20_000


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Unit length; the zero vector stays zero."""
    length = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(as_double(v), lambda x: x / length)


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1; an empty mask gives zeros."""
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    kept = F.zip_with(vectors, mask, lambda v, m: F.transform(as_double(v), lambda x: x * m))
    zero = F.transform(as_double(F.get(vectors, 0)), lambda x: x * 0.0)
    total = F.aggregate(kept, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.transform(total, lambda x: x / weight)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column as doubles; a null vector is a row of zeros."""
    width = next((len(v) for v in column.to_pylist() if v), 0) if column.null_count else len(column[0]) if len(column) else 0
    if not column.null_count:
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if len(flat) == width * len(column):
            return flat.reshape(len(column), width).astype(np.float64)
    return np.array([v or [0.0] * width for v in column.to_pylist()], np.float64)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def cosine_top_k(
    queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", skip_self: bool = True,
) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` nearest rows of each query, exactly; ties go to the lower id.

    ``queries`` is read in blocks of QUERY_BLOCK vectors; a block is packed into its broadcast before the next is read, and
    takes one pass over ``rows``.
    """
    spark, found = rows.sparkSession, None
    kind = rows.schema[id_col].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    for held in _blocks(queries.select(id_col, vec_col)):
        shared = spark.sparkContext.broadcast(([q for q, _ in held], unit(np.array([v for _, v in held], np.float64)) if held else None))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches:
                if q is None or not batch.num_rows:
                    continue
                own = batch.column(id_col).to_numpy(zero_copy_only=False)
                scores = np.round(unit(matrix(batch.column(vec_col))) @ q.T, 9)
                keep = min(len(own), k + skip_self)
                order = np.lexsort((np.broadcast_to(own[:, None], scores.shape), -scores), axis=0)[:keep]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.array(ids), keep)), pa.array(own[order].T.ravel()), pa.array(np.take_along_axis(scores, order, 0).T.ravel()),
                ], ["query_id", "id", "score"])

        part = rows.select(id_col, vec_col).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if skip_self:
        found = found.filter(F.col("id") != F.col("query_id"))
    return top_per_key(found, ["query_id"], k, F.desc("score"), F.asc("id"))


def _blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    """Rows in blocks of QUERY_BLOCK; one block is held at a time, and at least one, empty or not, is made."""
    block: list[tuple] = []
    for k, row in enumerate(queries.toLocalIterator(), 1):
        block.append((row[0], row[1]))
        if k % QUERY_BLOCK == 0:
            yield block
            block = []
    yield block


def _mean_vector(vectors: Column) -> Column:
    """Aggregate: the mean of vectors of doubles; null vectors don't count."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return vector_to_array(Summarizer.mean(F.when(vectors.isNotNull(), array_to_vector(vectors))))


def mean_similarity(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", out_col: str = "importance") -> DataFrame:
    """Mean cosine of each row to all rows, itself included: the product with the mean of all unit vectors, so no pairs."""
    units = rows.select(id_col, normalised(F.col(vec_col)).alias("_unit"))
    centre = units.agg(_mean_vector(F.col("_unit")).alias("_centre"))
    return units.crossJoin(F.broadcast(centre)).select(id_col, dot(F.col("_unit"), F.col("_centre")).alias(out_col))


def centroids(rows: DataFrame, group: str, vec_col: str = "embedding") -> DataFrame:
    """(group, centre): mean vector of each group; whole vectors are summed in each partition before the shuffle."""
    return rows.select(group, as_double(F.col(vec_col)).alias("_v")).groupBy(group).agg(_mean_vector(F.col("_v")).alias("centre"))


def representatives(
    rows: DataFrame, group: str, weight: float = 0.0, id_col: str = "vec_id", vec_col: str = "embedding", importance: str | None = None,
) -> DataFrame:
    """The best row of each group: nearness to the centre, blended with the importance by ``weight``; both are scaled by
    their largest value in the group (1 where that is 0). One row a group is kept in each partition before the shuffle."""
    near = rows.join(centroids(rows, group, vec_col), group).withColumn("_d", distance(F.col(vec_col), F.col("centre")))
    imp = F.col(importance) if importance else F.lit(0.0)
    scaled = near.withColumn("_i", imp)
    top = scaled.groupBy(group).agg(F.max("_d").alias("_md"), F.max("_i").alias("_mi"))
    one = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))
    score = (1 - weight) * (1 - F.col("_d") / one("_md")) + weight * F.col("_i") / one("_mi")
    scored = scaled.join(top, group).withColumn("score", F.round(score, 9))
    best = scored.groupBy(group).agg(F.min_by(F.struct(id_col, "score", "_d"), F.struct((-F.col("score")).alias("s"), F.col(id_col))).alias("_r"))
    return best.select(group, f"_r.{id_col}", F.col("_r.score").alias("score"), F.col("_r._d").alias("distance"))


def kmeans_labels(rows: DataFrame, k: int, seed: int = 42, vec_col: str = "embedding", out_col: str = "cluster") -> DataFrame:
    """k-means from pyspark.ml over the vectors; ``k`` is cut to the number of rows by the library's distinct start points."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = rows.withColumn("_v", array_to_vector(as_double(F.col(vec_col))))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol=out_col).fit(ready)
    return model.transform(ready).drop("_v")


def similar_edges(
    rows: DataFrame, threshold: float, group: str, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 2_048,
) -> DataFrame:
    """(group, a, b, score) with a < b: pairs of a group at or above the threshold.

    A group is cut into blocks of rows; each pair of blocks is one task of bounded size, and only pairs above the
    threshold leave it. Rows are copied once for every block of their group.
    """
    kind = rows.schema[id_col].dataType
    counts = rows.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    placed = rows.select(group, id_col, vec_col).join(counts, group).withColumn("_b", F.pmod(F.xxhash64(id_col), F.col("_n")).cast("int"))
    spread = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    spread = spread.withColumn("_lo", F.least("_b", "_other")).withColumn("_hi", F.greatest("_b", "_other"))
    schema = T.StructType([rows.schema[group], T.StructField("a", kind), T.StructField("b", kind), T.StructField("score", T.DoubleType())])

    def run(key, table):
        lo, hi = key[1].as_py(), key[2].as_py()
        ids, side = table.column(id_col).to_numpy(), table.column("_b").to_numpy()
        m = unit(matrix(table.column(vec_col).combine_chunks()))
        left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        s = np.round(m[left] @ m[right].T, 9)
        i, j = np.nonzero(s >= threshold)
        a, b, score = ids[left][i], ids[right][j], s[i, j]
        keep = a < b if lo == hi else a != b
        a, b, score = np.minimum(a, b)[keep], np.maximum(a, b)[keep], score[keep]
        return pa.table([pa.array([key[0].as_py()] * len(a), table.schema.field(group).type), pa.array(a), pa.array(b), pa.array(score)], [group, "a", "b", "score"])

    return spread.groupBy(group, "_lo", "_hi").applyInArrow(run, schema)
