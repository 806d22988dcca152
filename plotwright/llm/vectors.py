"""What the vector searches share: vectors as arrays, blocks of queries against blocks of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUND = "query_id long, vec_id long, score double"
NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
#: Rows of a block of candidates, and of a block of queries: what one group holds at once.
ROWS, ASKED = 4_096, 1_024


def usable(vector: Column, zero: bool) -> Column:
    """Neither null nor empty, without null or non-finite components; ``zero``: vectors of zeros count."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    fine = vector.isNotNull() & (F.size(vector) > 0) & ~bad
    return fine if zero else fine & F.exists(vector, lambda x: x != 0)


def picked(df: DataFrame, id_col: str, vector_col: str, zero: bool, is_query: Column) -> DataFrame:
    """(id, vector, q_) of the rows that take part; q_: whether they ask."""
    fine = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("q_"))
    return fine.where(F.col("id").isNotNull() & usable(F.col("vector"), zero))


def by_length(every: DataFrame, search: Callable[[DataFrame], DataFrame], compare: Callable[..., tuple[np.ndarray, ...]]) -> DataFrame:
    """(query_id, vec_id, score): vectors meet those of their own length only, as products across lengths are undefined.

    ``search`` finds the partial results of one length. The most frequent length goes there, and each other one of more than ``ROWS`` rows; the rows of a rarer one fit a group and are compared whole by ``compare``, all such lengths in one pass. The driver holds a count for each length.
    """
    counts = sorted(((r["count"], r["n"]) for r in every.groupBy(F.size("vector").alias("n")).count().collect()), key=lambda x: (-x[0], x[1]))
    large = [n for k, (count, n) in enumerate(counts) if k == 0 or count > ROWS]
    length = F.size("vector")
    found = search(every if len(counts) < 2 else every.where(length == large[0]))
    for n in large[1:]:
        found = found.unionByName(search(every.where(length == n)))
    if len(counts) == len(large):
        return found

    def run(rows: pa.Table) -> pa.Table:
        ids, vectors, asks = rows["id"].to_numpy(), matrix(rows["vector"]), rows["q_"].to_numpy()
        least: dict[int, int] = {}
        for k in np.flatnonzero(asks).tolist():
            if ids[k] not in least or tuple(vectors[k]) < tuple(vectors[least[ids[k]]]):
                least[ids[k]] = k
        at = np.array([*least.values()], np.int64)
        return pa.Table.from_batches([found_batch(compare(ids[at], vectors[at], ids, vectors) if len(at) else NONE)])

    return found.unionByName(every.where(~length.isin(large)).withColumn("n", length).groupBy("n").applyInArrow(run, FOUND))


def found_batch(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a float64 matrix. All must have one length; without rows that is 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1 if len(column) else 0)


def exact_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row products of two matrices, summed in the same order wherever a row stands."""
    return np.add.reduce(a * b, axis=1)


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's ``k`` largest scores, ties to smaller ids."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < k]


def top(df: DataFrame, k: int, score: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of each query's partial results, of which it has at most ``k`` per block met."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast(score).alias("score"))
