"""Exact top-k by inner product: norm-bucketed retrieval.

Vectors become integers, floor(scale * x). Candidates are grouped by length into
buckets (edges from quantiles of the lengths) and these into blocks of bounded size;
queries come in blocks too. Every query first meets the bucket of the longest vectors,
whose k-th best product is its threshold. It then goes only to buckets where its own
length times the bucket's greatest reaches the threshold. There the local cosine
threshold (threshold over both lengths) chooses the pruning: by length alone where it is
low, else by coordinates: on the query's largest coordinates a candidate must lie within
the interval that the cosine allows. What is left is verified by its exact product. A row
is sent once for each ``ASKED`` of the queries that go to its bucket, not for others.

All scores are integers below 2**53 in magnitude, so products in float64 are exact.

Defined results: vectors meet those of their own length only. Vectors that are null, empty, or hold null or non-finite components
take no part; a zero vector takes part. Ties go to the smaller id. Rows that repeat an
id are candidates each, but none for a query of the same id; of several rows of a query's
id the least vector of each length asks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwright.llm.common import cut
from plotwright.llm.vectors import ASKED, FOUND, NONE, ROWS, best, by_length, found_batch, matrix, picked, top

SLACK = 1e-9
#: From this local cosine threshold on, pruning is by coordinates.
STEEP = 0.6
#: How many of a query's coordinates are looked at.
FOCUS = 4


def coordinate_mask(unit: np.ndarray, rows: np.ndarray, cosine: float) -> np.ndarray:
    """Which unit ``rows`` can have that cosine to ``unit`` at least, judged by its largest coordinates."""
    fits = np.ones(len(rows), bool)
    for f in np.argsort(-np.abs(unit))[:FOCUS]:
        span = np.sqrt(max(0.0, (1 - cosine * cosine) * (1 - unit[f] * unit[f]))) + SLACK
        x = rows[:, f]
        low = unit[f] * cosine - span if unit[f] > -cosine else -1 - SLACK
        high = unit[f] * cosine + span if unit[f] < cosine else 1 + SLACK
        fits &= (x >= low) & (x <= high)
    return fits


def search(q_ids: np.ndarray, q: np.ndarray, theta: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's ``k`` best in a block, of those that reach its threshold."""
    lengths = np.sqrt((rows * rows).sum(1))
    order = np.argsort(-lengths, kind="stable")
    ids, rows, lengths = ids[order], rows[order], lengths[order]
    units = rows / np.maximum(lengths, 1e-300)[:, None]
    q_lengths = np.sqrt((q * q).sum(1))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    reach = q_lengths * lengths[0]
    met = np.flatnonzero((reach >= theta * (1 - np.sign(theta) * SLACK) - SLACK) | (theta == -np.inf))
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(reach > 0, theta / reach, -np.inf)
    steep = met[cosine[met] >= STEEP]
    for i in steep:
        n = int(np.searchsorted(-lengths, -(theta[i] / q_lengths[i]) * (1 - SLACK), side="right"))
        at = np.flatnonzero(coordinate_mask(q[i] / q_lengths[i], units[:n], min(1.0, cosine[i]) * (1 - SLACK)))
        out.append((np.full(len(at), i), at, rows[at] @ q[i]))
    flat = met[cosine[met] < STEEP]
    with np.errstate(divide="ignore", invalid="ignore"):
        least_length = np.where((theta > 0) & (q_lengths > 0), theta / q_lengths * (1 - SLACK), 0.0)
    need = np.searchsorted(-lengths, -least_length, side="right")
    flat = flat[np.argsort(need[flat], kind="stable")]
    for a in range(0, len(flat), 128):
        part = flat[a : a + 128]
        scores = q[part] @ rows[: need[part[-1]]].T
        scores[q_ids[part][:, None] == ids[None, : scores.shape[1]]] = -np.inf
        if scores.shape[1] > 2 * k:
            least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
            least = np.maximum(least, theta[part])
        else:
            least = theta[part]
        i, at = np.nonzero(scores >= least[:, None])
        out.append((part[i], at, scores[i, at]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, at, score = (np.concatenate([x[j] for x in out]) for j in range(3))
    keep = (q_ids[i] != ids[at]) & (score >= theta[i])
    i, at, score = i[keep], at[keep], score[keep]
    chosen = best(i, ids[at], score, k)
    return q_ids[i[chosen]], ids[at[chosen]], score[chosen]


def top_k(df: DataFrame, is_query: Column, k: int, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", buckets: int = 32, rows_per_block: int = ROWS, queries_per_block: int = ASKED) -> DataFrame:
    """(query_id, rank, vec_id, score long) for the rows where ``is_query`` holds, against all rows."""
    every = picked(df, id_col, vector_col, True, is_query)
    least = lambda q: np.full(len(q), -np.inf)
    ints = lambda x: np.floor(x * scale)
    compare = lambda q_ids, q, ids, rows: search(q_ids, ints(q), least(q), ids, ints(rows), k)
    return top(by_length(every, lambda some: bucketed(some, k, scale, buckets, rows_per_block, queries_per_block), compare), k, "long")


def bucketed(whole: DataFrame, k: int, scale: int, buckets: int, rows_per_block: int, queries_per_block: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each query in each block that it meets, of vectors of one length."""
    asked = whole.where("q_").groupBy("id").agg(F.min("vector").alias("vector"))
    ints = F.transform("vector", lambda x: F.floor(x * scale).cast("double"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    rows = whole.select("id", ints.alias("vector")).withColumn("length", length)
    asked = cut(asked.withColumn("vector", ints).withColumn("length", length))
    edges = sorted({*(rows.approxQuantile("length", [j / buckets for j in range(1, buckets)], 0.001) or [])}, reverse=True)
    bucket = sum((F.when(F.col("length") < e, 1).otherwise(0) for e in edges), F.lit(0))
    rows = rows.withColumn("bucket", bucket)
    stats = sorted((r["bucket"], r["n"], r["most"]) for r in rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max("length").alias("most")).collect())
    if not stats:
        return whole.sparkSession.createDataFrame([], FOUND)
    n_asked = asked.count()

    def meet(queries: DataFrame, some: list[tuple[int, int, float, int]], wanted: Column) -> DataFrame:
        """Each block of queries with each block of rows of the buckets ``wanted`` (an array). some: (bucket, rows, longest, queries that want it)."""
        plan = [(b, -(-n // rows_per_block), -(-asking // queries_per_block)) for b, n, _, asking in some if asking]
        table = F.broadcast(whole.sparkSession.createDataFrame(plan, "bucket int, blocks int, parts int"))
        dealt = lambda n, *more: F.pmod(F.xxhash64("id", *more), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = queries.select("id", "vector", "theta", F.explode(wanted).alias("bucket")).join(table, "bucket")
        left = left.select("id", "vector", "theta", "bucket", dealt("parts", F.lit(1)).alias("part"), each("blocks").alias("block")).toDF("q_id", "q_vector", "theta", "q_bucket", "q_part", "q_block")
        right = rows.join(table, "bucket").select("id", "vector", "bucket", dealt("blocks").alias("block"), each("parts").alias("part"))

        def run(l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
            both = l.num_rows and r.num_rows
            return pa.Table.from_batches([found_batch(search(l["q_id"].to_numpy(), matrix(l["q_vector"]), l["theta"].to_numpy(), r["id"].to_numpy(), matrix(r["vector"]), k) if both else NONE)])

        return left.groupBy("q_bucket", "q_block", "q_part").cogroup(right.groupBy("bucket", "block", "part")).applyInArrow(run, FOUND)

    head, tail = stats[0], stats[1:]
    first = cut(meet(asked.withColumn("theta", F.lit(float("-inf"))), [(*head, n_asked)], F.array(F.lit(head[0]))))
    reached = top(first, k, "double").groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("theta"))
    known = asked.join(reached.withColumnRenamed("query_id", "id"), "id", "left").withColumn("theta", F.coalesce("theta", F.lit(float("-inf"))))
    goes = {b: F.col("length") * most * (1 + SLACK) + SLACK >= F.col("theta") for b, _, most in tail}
    if not tail or not n_asked:
        return first
    known = cut(known)
    asking = known.agg(*[F.count_if(goes[b]) for b, _, _ in tail]).first()
    some = [(*x, n) for x, n in zip(tail, asking, strict=True)]
    if not any(asking):
        return first
    wanted = F.array_compact(F.array(*[F.when(goes[b], F.lit(b)) for b, _, _ in tail]))
    return first.unionByName(meet(known, some, wanted))


def brute_force(ids: np.ndarray, vectors: np.ndarray, q_ids: Iterator[int], k: int, scale: int = 64) -> list[tuple[int, int, int, int]]:
    """The same by comparing all, for tests."""
    ints = np.floor(vectors.astype(np.float64) * scale).astype(np.int64)
    out = []
    for q in q_ids:
        scores = ints @ ints[np.flatnonzero(ids == q)[0]]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != q][:k]
        out += [(q, r, int(ids[j]), int(scores[j])) for r, j in enumerate(order, 1)]
    return out
