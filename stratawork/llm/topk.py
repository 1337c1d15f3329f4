"""Exact top-k by inner product with pivot-table elimination.

Components become integers, so scores are exact. With the distances of all vectors to a few pivots at hand, the largest
difference of a query's and a candidate's distance to a pivot is a lower bound of their own distance, which makes an
upper bound of their inner product. Candidates are evaluated in the order of that bound until the k-th best score found
lies above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratawork.llm.text import stored
from stratawork.session import new_folder

#: Vectors that serve as pivots, the first by a hash of their ids.
PIVOTS = 24
#: Queries that are broadcast at once, 8 bytes for each component; more queries are searched block by block.
BLOCK = 4096
#: Candidates of a query that are evaluated between two looks at the bound.
STEP = 64


def _clean(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and integer components of the vectors that take part."""
    real = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    usable = vectors.select(F.col("vec_id").cast("long"), "embedding").filter(F.col("embedding").isNotNull() & real)
    return usable.select("vec_id", whole.alias("ints"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows; shorter ones end in zeros."""
    length = lists.value_lengths().to_numpy()
    rows = np.zeros((len(lists), width), np.int64)
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    rows[np.repeat(np.arange(len(lists)), length), place] = lists.flatten().to_numpy()
    return rows


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    gaps = rows.astype(float)[:, None, :] - pivots.astype(float)[None]
    return np.sqrt(np.einsum("ijk,ijk->ij", gaps, gaps))


def _tabled(pivots: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                far = _distances(_matrix(batch.column("ints"), width), pivots)
                bounds = pa.array(np.arange(len(far) + 1, dtype=np.int32) * far.shape[1])
                lists = pa.ListArray.from_arrays(bounds, pa.array(far.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("ints"), lists], ["vec_id", "ints", "far"])

    return run


def _searched(shared, width: int, k: int):
    """The best k candidates of a partition for each query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, far = shared.value
        norm = (rows.astype(float) ** 2).sum(1)
        best: list[list[tuple[int, int]]] = [[] for _ in ids]
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                own = batch.column("vec_id").to_numpy(zero_copy_only=False)
                candidates = _matrix(batch.column("ints"), width)
                table = batch.column("far").flatten().to_numpy().reshape(len(own), -1)
                size = (candidates.astype(float) ** 2).sum(1)
                for q in range(len(ids)):
                    apart = np.abs(table - far[q]).max(1, initial=0)
                    bound = (norm[q] + size - apart**2) / 2
                    bound += 1e-9 * (norm[q] + size) + 1e-6
                    least = best[q][-1][0] if len(best[q]) == k else -np.inf
                    left = np.flatnonzero((bound >= -least) & (own != ids[q])) if least > -np.inf else np.flatnonzero(own != ids[q])
                    left = left[np.argsort(-bound[left], kind="stable")]
                    for a in range(0, len(left), STEP):
                        some = left[a : a + STEP]
                        if len(best[q]) == k and bound[some[0]] < -best[q][-1][0]:
                            break
                        score = candidates[some] @ rows[q]
                        found = best[q] + list(zip((-score).tolist(), own[some].tolist()))
                        best[q] = sorted(found)[:k]
        flat = [(int(q), v, -s) for q, own in zip(ids, best) for s, v in own]
        if flat:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in flat], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"]
            )

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, pivots: int = PIVOTS) -> DataFrame:
    """The k highest inner products of each query with all other rows: query_id, rank, vec_id, score.

    Components become floor(scale * x). `queries` is a condition on vec_id. Ties go to the smaller vec_id. Vectors that
    are null or hold null or non-finite components take no part; shorter ones count as zero beyond their end, an empty
    one scores 0. A row's own are all rows of the same vec_id; a query id that is repeated is asked once, with its first
    vector, while repeated candidates are ranked each. Rows without vec_id take no part. An empty table gives no rows.
    Extra columns are ignored.

    The distances to the pivots are computed once and stored with the vectors. Blocks of queries are broadcast, and each
    partition returns its best k candidates of a query; only these are shuffled.
    """
    spark = vectors.sparkSession
    clean = stored(_clean(vectors, scale).filter("vec_id is not null"), "vectors")
    width = clean.agg(F.max(F.size("ints"))).first()[0]
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chosen = clean.orderBy(F.xxhash64("vec_id"), "ints").limit(pivots).toArrow()
    pivot_rows = _matrix(chosen.column("ints").combine_chunks(), width)
    tabled = stored(clean.mapInArrow(_tabled(pivot_rows, width), "vec_id long, ints array<long>, far array<double>"), "pivot-table")
    asked = tabled.filter(queries).groupBy("vec_id").agg(F.min("ints").alias("ints"))
    blocks = max(1, -(-asked.count() // BLOCK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    asked = stored(asked.withColumn("block", block), "queries")
    folder = new_folder(spark, "nearest")
    for number in range(blocks):
        rows = asked.filter(F.col("block") == number).toArrow()  # about BLOCK rows
        if not rows.num_rows:
            continue
        ids, ints = rows.column("vec_id").to_numpy(), _matrix(rows.column("ints").combine_chunks(), width)
        far = np.concatenate([_distances(ints[a : a + 2000], pivot_rows) for a in range(0, len(ints), 2000)])
        shared = spark.sparkContext.broadcast((ids, ints, far))
        found = tabled.mapInArrow(_searched(shared, width, k), "query_id long, vec_id long, score long")
        found.write.parquet(f"{folder}/block={number}")
    schema = "query_id long, vec_id long, score long, block int"
    found = spark.read.schema(schema).parquet(folder) if asked.limit(1).count() else spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
