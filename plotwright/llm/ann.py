"""Approximate nearest neighbours by cosine: a hierarchical k-means tree.

The tree is fitted on a bounded sample (``sample`` rows); every row is then indexed, by
descent to the nearest centroid of each level. A query walks the tree best bin first,
through a priority queue of nodes by the cosine to their centroids, and so orders the
leaves. How many leaves to visit is calibrated: for ``calibrate`` queries the true
neighbours among all rows are found by brute force, and visits widen until they hold
``recall`` of them. Queries and rows of a leaf meet in blocks of bounded size, so a leaf
with a third of all rows is many groups, and a row is sent once for each ``ASKED`` of the
queries that visit its leaf, not for others. The driver and the broadcast hold the tree and
the leaves' sizes (``most_leaves`` at most; beyond ``most_leaves`` x ``rows_per_leaf`` rows
the leaves grow with the table), never rows.

Defined results: vectors meet those of their own length; each length is searched apart, by
a tree of its own or, if rare, by comparing all. Vectors that are null, empty, zero, or hold null or non-finite
components take no part. Ties go to the smaller id. A query visits more leaves where
those calibrated hold fewer rows than asked for, so ``k`` neighbours are returned
whenever there are so many candidates. Rows that repeat an id are candidates each, but
none for a query of the same id; of several rows of a query's id the least vector of each length asks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwright.llm.common import cut, sparing
from plotwright.llm.vectors import ASKED, FOUND, NONE, ROWS, best, by_length, exact_dots, found_batch, matrix, picked, top


@dataclass(frozen=True)
class Tree:
    """centroids: unit vectors by node; children: of inner nodes; leaf: number of a leaf, or -1."""

    centroids: np.ndarray
    children: tuple[tuple[int, ...], ...]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, units: np.ndarray) -> np.ndarray:
        at = np.zeros(len(units), np.int64)
        while True:
            inner = [n for n in np.unique(at) if self.children[n]]
            if not inner:
                return self.leaf[at]
            for n in inner:
                rows = np.flatnonzero(at == n)
                kids = np.array(self.children[n])
                at[rows] = kids[np.argmax(units[rows] @ self.centroids[kids].T, axis=1)]

    def order(self, unit: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        near = self.centroids @ unit
        queue = [(-near[0], 0)]
        while queue:
            _, n = heapq.heappop(queue)
            if not self.children[n]:
                yield int(self.leaf[n])
            for c in self.children[n]:
                heapq.heappush(queue, (-near[c], c))


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def clusters(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: (centroids that have rows, the rows' numbers of them)."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        used = np.unique(near)
        sums = np.stack([x[near == j].sum(0) for j in used])
        lengths = np.sqrt((sums * sums).sum(1))
        c = np.where(lengths[:, None] > 1e-9, sums / np.maximum(lengths, 1e-9)[:, None], c[used])
    near = np.argmax(x @ c.T, axis=1)
    used, near = np.unique(near, return_inverse=True)
    return c[used], near


def grow(units: np.ndarray, leaves: int, branch: int = 8, seed: int = 5, rounds: int = 8) -> Tree:
    """Splits the largest leaf until there are ``leaves`` of them, or none can be split."""
    rng = np.random.default_rng(seed)
    mean = units.mean(0) if len(units) else units.sum(0)
    centroids, children = [mean / max(np.sqrt(mean @ mean), 1e-12)], [()]
    queue, count = [(-len(units), 0, np.arange(len(units)))], 1
    while queue and count < leaves:
        size, n, rows = heapq.heappop(queue)
        if -size < 2 * branch:
            break
        c, near = clusters(units[rows], min(branch, leaves - count + 1), rng, rounds)
        if len(c) < 2:
            continue
        children[n] = tuple(range(len(centroids), len(centroids) + len(c)))
        for j, x in enumerate(c):
            heapq.heappush(queue, (-int((near == j).sum()), len(centroids), rows[near == j]))
            centroids.append(x)
            children.append(())
        count += len(c) - 1
    leaf, k = np.full(len(centroids), -1), 0
    for n, kids in enumerate(children):
        if not kids:
            leaf[n] = k
            k += 1
    return Tree(np.array(centroids), tuple(children), leaf)


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, cosine, position) of each query's ``k`` nearest rows but its own. Products choose, exact cosines decide."""
    q_lengths, lengths = np.sqrt(exact_dots(q, q)), np.sqrt(exact_dots(rows, rows))
    parts = []
    for a in range(0, len(q), 128):
        near = (q[a : a + 128] / q_lengths[a : a + 128, None]) @ (rows / lengths[:, None]).T
        near[q_ids[a : a + 128, None] == ids[None, :]] = -np.inf
        least = -np.partition(-near, k - 1, axis=1)[:, k - 1] if near.shape[1] > k else np.full(len(near), -2.0)
        i, at = np.nonzero((near >= (least - 1e-9)[:, None]) & (near > -np.inf))
        i = i + a
        score = exact_dots(q[i], rows[at]) / (q_lengths[i] * lengths[at])
        chosen = best(i, ids[at], score, k)
        parts.append((q_ids[i[chosen]], ids[at[chosen]], score[chosen], at[chosen]))
    return tuple(np.concatenate([p[j] for p in parts]) for j in range(4))


def neighbours(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.97, sample: int = 20_000, rows_per_leaf: int = 400, most_leaves: int = 4_096, calibrate: int = 256, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` holds, against all rows but the query's own."""
    every = picked(df, id_col, vector_col, False, is_query)
    search = lambda some: visited(some, k, recall, sample, rows_per_leaf, most_leaves, calibrate, seed)
    return top(by_length(every, search, lambda *both: nearest(*both, k)), k, "double")


def visited(every: DataFrame, k: int, recall: float, sample: int, rows_per_leaf: int, most_leaves: int, calibrate: int, seed: int) -> DataFrame:
    """(query_id, vec_id, score): the nearest of each query in each leaf that it visits, of vectors of one length."""
    spark = every.sparkSession
    n, n_asked = (x or 0 for x in every.agg(F.count("*"), F.count_if("q_")).first())
    if not n_asked:
        return spark.createDataFrame([], FOUND)
    # Drawn by id and vector, so that rows which share an id are drawn apart; a draw that meets none takes the first.
    place = F.pmod(F.xxhash64("id", "vector", F.lit(seed)), F.lit(1 << 30))

    def drawn(some: DataFrame, most: int, have: int) -> pa.Table:
        found = some.where(place < int((1 << 30) * min(1.0, most / have)) + 1).limit(2 * most).toArrow()
        return found if found.num_rows else some.orderBy(place, "id", "vector").limit(1).toArrow()

    tree = grow(unit_rows(matrix(drawn(every.select("id", "vector"), sample, n)["vector"])), int(np.clip(n // rows_per_leaf, 1, most_leaves)), seed=seed)
    shared = spark.sparkContext.broadcast(tree)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = shared.value.assign(unit_rows(matrix(b.column("vector"))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], names=["id", "vector", "q_", "leaf"])

    rows = cut(every.mapInArrow(sparing(index), "id long, vector array<double>, q_ boolean, leaf int"))
    sizes = np.zeros(tree.leaves, np.int64)
    for leaf, count in rows.groupBy("leaf").count().collect():
        sizes[leaf] = count

    # Calibration: how many leaves hold the true neighbours of some queries.
    asked = cut(rows.groupBy("id").agg(F.min(F.when(F.col("q_"), F.col("vector"))).alias("vector"), F.count("*").alias("own")).where("vector is not null"))
    trial = drawn(asked.select("id", "vector"), calibrate, asked.count())
    t_ids, t = trial["id"].to_numpy(), matrix(trial["vector"])
    asked_ = spark.sparkContext.broadcast((t_ids, t))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = nearest(*asked_.value, b.column("id").to_numpy(), matrix(b.column("vector")), k)
                yield pa.RecordBatch.from_arrays([*found_batch(found).columns, b.column("leaf").take(pa.array(found[3]))], names=["query_id", "vec_id", "score", "leaf"])

    met = rows.select("id", "vector", "leaf").mapInArrow(sparing(compare), f"{FOUND}, leaf int")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id", "leaf")
    truth = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "leaf").collect()
    position = {int(i): {leaf: r for r, leaf in enumerate(tree.order(u), 1)} for i, u in zip(t_ids, unit_rows(t), strict=True)}
    ranks = np.sort([position[q][leaf] for q, leaf in truth])
    visits = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) if len(ranks) else tree.leaves

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            chosen = []
            for u, own in zip(unit_rows(matrix(b.column("vector"))), b.column("own").to_pylist(), strict=True):
                some, held = [], 0
                for leaf in shared.value.order(u):
                    if len(some) >= visits and held >= k + own:
                        break
                    some.append(leaf)
                    held += int(sizes[leaf])
                chosen.append(some)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), pa.array(chosen, pa.list_(pa.int32()))], names=["id", "vector", "leaves"])

    walks = cut(asked.mapInArrow(sparing(walk), "id long, vector array<double>, leaves array<int>"))
    visitors = {r["leaf"]: r["count"] for r in walks.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()}
    plan = [(int(j), int(-(-sizes[j] // ROWS)), -(-visitors[j] // ASKED)) for j in sorted(visitors) if sizes[j]]
    table = F.broadcast(spark.createDataFrame(plan, "leaf int, blocks int, parts int"))
    dealt = lambda n, *more: F.pmod(F.xxhash64("id", *more), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = walks.select("id", "vector", F.explode("leaves").alias("leaf")).join(table, "leaf")
    left = left.select("id", "vector", "leaf", dealt("parts", F.lit(1)).alias("part"), each("blocks").alias("block")).toDF("q_id", "q_vector", "q_leaf", "q_part", "q_block")
    # Rows are dealt by their place in the kept table: those that repeat an id or a vector spread as all others do.
    right = rows.withColumn("seq", F.monotonically_increasing_id()).join(table, "leaf").select("id", "vector", "leaf", F.pmod("seq", F.col("blocks")).cast("int").alias("block"), each("parts").alias("part"))

    def run(l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
        some = l.num_rows and r.num_rows
        return pa.Table.from_batches([found_batch(nearest(l["q_id"].to_numpy(), matrix(l["q_vector"]), r["id"].to_numpy(), matrix(r["vector"]), k) if some else NONE)])

    return left.groupBy("q_leaf", "q_block", "q_part").cogroup(right.groupBy("leaf", "block", "part")).applyInArrow(run, FOUND)
