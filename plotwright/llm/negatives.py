"""Hard negatives by inner product: ball trees in blocks of rows, bounded from both sides.

Vectors become integers, floor(scale * x). Rows are dealt to the leaves of a k-means tree
fitted on a bounded sample, and these cells into blocks of bounded size; the driver holds a
centre and a radius for each cell. A block's rows form a ball tree: a node with centre c and
radius r holds products with a query q from q.c - |q| r to q.c + |q| r. A search asks, for
each query, for the ``k`` best rows of one or more windows of scores. It goes only to cells
whose bounds meet a window; within a block, nodes are left out whose bounds miss all
windows of a query, or whose upper bound lies strictly beneath the k-th best found in each.

Two searches: an anchor's positives are the best rows of its own label (first in the cell
that it is in, then, from the k-th best found there on, in the others); its negatives the
best rows of other labels in one window for each positive.

All scores are integers below 2**53 in magnitude, so products in float64 are exact.

Defined results: vectors meet those of their own length only. Rows with a null id or label,
a null or empty vector, or null or non-finite components take no part; zero vectors do. Ties
go to the smaller id. Rows that repeat an id are rows each, but none for an anchor of that id;
of several rows of an anchor's id the one of least label and vector asks, for each length.
A positive of negative score has no negatives, as its window is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwright.llm.ann import grow, unit_rows
from plotwright.llm.common import cut, sparing
from plotwright.llm.vectors import ROWS, exact_dots, matrix, usable

#: Rows of a ball that is not divided, and queries of a block.
LEAF, ASKED = 64, 2_048
SLACK = 1e-6
MET = "query_id long, slot int, vec_id long, score long"


@dataclass(frozen=True)
class Ball:
    """rows: positions of a tree's rows, ``begin`` to ``stop``; kids: numbers of two balls, or none."""

    centre: np.ndarray
    radius: float
    begin: int
    stop: int
    kids: tuple[int, ...]


def ball_tree(rows: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> tuple[list[Ball], np.ndarray]:
    """(balls, the first the root; order of the rows). A ball is halved at the median along the line between two far rows; a leaf's rows stand by id."""
    order, balls = np.arange(len(rows)), []
    todo = [(0, len(rows), -1)]
    kids: dict[int, list[int]] = {}
    while todo:
        a, b, parent = todo.pop()
        n, own = len(balls), rows[order[a:b]]
        kids.setdefault(parent, []).append(n)
        centre = own.mean(0)
        gaps = ((own - centre) ** 2).sum(1)
        balls.append((centre, float(np.sqrt(gaps.max())), a, b))
        if b - a <= leaf or gaps.max() == 0:
            order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
            continue
        far = own[np.argmax(gaps)]
        along = own @ (own[np.argmax(((own - far) ** 2).sum(1))] - far)
        order[a:b] = order[a:b][np.argsort(along, kind="stable")]
        middle = (a + b) // 2
        todo += [(middle, b, n), (a, middle, n)]
    return [Ball(*x, tuple(kids.get(n, ()))) for n, x in enumerate(balls)], order


def bounds(q: np.ndarray, lengths: np.ndarray, centre: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest product that a row of a ball can have with each query, widened by what rounding may take."""
    near, span = q @ centre, lengths * radius
    slack = SLACK * (1 + np.abs(near) + span)
    return near - span - slack, near + span + slack


def search(q_ids: np.ndarray, q: np.ndarray, q_labels: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, ...]:
    """(position of the query, window, id, score): the ``k`` best rows of each query (of its label or, unless ``same``, of others) with low <= score <= high, for each of its windows."""
    balls, order = ball_tree(rows, ids)
    ids, rows, labels = ids[order], rows[order], labels[order]
    lengths = np.sqrt((q * q).sum(1))
    windows = low.shape[1]
    top = np.full((len(q), windows, k), -np.inf)
    whose = np.full((len(q), windows, k), np.iinfo(np.int64).max)
    todo = [(0, np.arange(len(q)))]
    while todo:
        n, some = todo.pop()
        ball = balls[n]
        least, most = bounds(q[some], lengths[some], ball.centre, ball.radius)
        open_ = (most[:, None] >= low[some]) & (least[:, None] <= high[some]) & (most[:, None] >= top[some, :, k - 1])
        some = some[open_.any(1)]
        if not len(some):
            continue
        if ball.kids:
            # The half that is nearer to most queries comes first: it raises what the other half must reach.
            first, second = sorted(ball.kids, key=lambda c: float((q[some] @ balls[c].centre).sum()))
            todo += [(first, some), (second, some)]
            continue
        part = slice(ball.begin, ball.stop)
        scores = q[some] @ rows[part].T
        fits = (labels[part][None, :] == q_labels[some][:, None]) == same
        scores[~fits | (ids[part][None, :] == q_ids[some][:, None])] = -np.inf
        by = np.argsort(-scores, axis=1, kind="stable")  # rows stand by id, so ties do
        scores, names = np.take_along_axis(scores, by, 1), ids[part][by]
        # The best k of each window stand together, behind those above it.
        above = (scores[:, None, :] > high[some][:, :, None]).sum(2)
        at = above[:, :, None] + np.arange(k)
        inside = np.minimum(at, scores.shape[1] - 1)
        flat = np.arange(len(some))[:, None, None]
        got, got_ids = scores[flat, inside], names[flat, inside]
        wrong = (at >= scores.shape[1]) | (got < low[some][:, :, None]) | (got == -np.inf)
        got = np.where(wrong, -np.inf, got)
        got_ids = np.where(wrong, np.iinfo(np.int64).max, got_ids)
        both, both_ids = np.concatenate([top[some], got], 2), np.concatenate([whose[some], got_ids], 2)
        best = np.lexsort((both_ids, -both), axis=2)[:, :, :k]
        top[some], whose[some] = np.take_along_axis(both, best, 2), np.take_along_axis(both_ids, best, 2)
    i, j, m = np.nonzero(top > -np.inf)
    return i, j, whose[i, j, m], top[i, j, m].astype(np.int64)


def partial_batch(q_ids: np.ndarray, found: tuple[np.ndarray, ...]) -> pa.Table:
    i, j, ids, scores = found
    return pa.table([pa.array(q_ids[i], pa.int64()), pa.array(j, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["query_id", "slot", "vec_id", "score"])


def met(queries: DataFrame, rows: DataFrame, cells: dict[int, tuple[int, np.ndarray, float]], k: int, same: bool, home: bool | None, sizes: tuple[int, int]) -> DataFrame:
    """Partial results of ``queries`` (id, vector, label, cell, low, high) in each block that they go to; cells: (rows, centre, radius).

    ``home``: only the cell that a query is in (True), only others (False), or all (None).
    """
    spark = queries.sparkSession
    numbers = np.array(sorted(cells))
    centres, radii = np.stack([cells[c][1] for c in numbers]), np.array([cells[c][2] for c in numbers])
    shared = spark.sparkContext.broadcast((numbers, centres, radii))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, centres, radii = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            q, low, high = matrix(b.column("vector")), matrix(b.column("low")), matrix(b.column("high"))
            own = b.column("cell").to_numpy()
            lengths = np.sqrt((q * q).sum(1))
            goes = []
            for i in range(len(q)):
                least, most = bounds(centres, radii, q[i], lengths[i])  # as symmetric: |q| times the radius
                fits = ((most[:, None] >= low[i]) & (least[:, None] <= high[i])).any(1)
                if home is not None:
                    fits &= (numbers == own[i]) == home
                goes.append(numbers[fits])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("id", "vector", "label", "low", "high")] + [pa.array(goes, pa.list_(pa.int32()))], names=["id", "vector", "label", "low", "high", "cells"])

    routed = cut(queries.mapInArrow(sparing(route), "id long, vector array<double>, label long, low array<double>, high array<double>, cells array<int>"))
    asking = {r["cell"]: r["count"] for r in routed.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()}
    plan = [(int(c), -(-cells[c][0] // sizes[0]), -(-n // sizes[1])) for c, n in sorted(asking.items())]
    if not plan:
        return spark.createDataFrame([], MET)
    table = F.broadcast(spark.createDataFrame(plan, "cell int, blocks int, parts int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = routed.select("id", "vector", "label", "low", "high", F.explode("cells").alias("cell")).join(table, "cell")
    left = left.select("id", "vector", "label", "low", "high", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), each("blocks").alias("block"))
    left = left.select(*[F.col(c).alias(f"q_{c}") for c in left.columns])
    # Rows are dealt by their place in the kept table: those that repeat an id or a vector spread as all others do.
    right = rows.withColumn("seq", F.monotonically_increasing_id()).join(table, "cell").select("id", "vector", "label", "cell", F.pmod("seq", F.col("blocks")).cast("int").alias("block"), each("parts").alias("part"))

    def run(l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
        q_ids = l["q_id"].to_numpy()
        if not l.num_rows or not r.num_rows:
            return partial_batch(q_ids, (np.zeros(0, np.int64),) * 4)
        found = search(q_ids, matrix(l["q_vector"]), l["q_label"].to_numpy(), matrix(l["q_low"]), matrix(l["q_high"]), r["id"].to_numpy(), matrix(r["vector"]), r["label"].to_numpy(), k, same)
        return partial_batch(q_ids, found)

    return left.groupBy("q_cell", "q_block", "q_part").cogroup(right.groupBy("cell", "block", "part")).applyInArrow(run, MET)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query and window, of which it has at most ``k`` per block met."""
    w = Window.partitionBy("query_id", "slot").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def window(best: DataFrame, positives: int, low_pct: int, high_pct: int) -> DataFrame:
    """(id, low, high): a window for each positive; those that an anchor lacks, or whose score is negative, are empty."""
    held = best.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "positive_score"))).alias("p"))
    at = lambda j, e, none: F.coalesce(F.expr(f"CASE WHEN try_element_at(p, {j}) >= 0 THEN cast({e.format(f'try_element_at(p, {j})')} AS double) END"), F.lit(none))
    low = F.array(*[at(j, f"({{0}} * {low_pct} + 99) div 100", float("inf")) for j in range(positives)])
    high = F.array(*[at(j, f"({{0}} * {high_pct}) div 100", float("-inf")) for j in range(positives)])
    return held.select(F.col("query_id").alias("id"), low.alias("low"), high.alias("high"))


def one_length(every: DataFrame, width: int, positives: int, k: int, low_pct: int, high_pct: int, sample: int, rows_per_cell: int, most_cells: int, seed: int, sizes: tuple[int, int]) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors of one length."""
    spark = every.sparkSession
    n = every.count()
    place = F.pmod(F.xxhash64("id", "vector", F.lit(seed)), F.lit(1 << 30))
    drawn = matrix(every.where(place <= int((1 << 30) * min(1.0, sample / n))).limit(2 * sample).select("vector").toArrow()["vector"]).reshape(-1, width)
    drawn = drawn[(drawn != 0).any(1)]
    tree = grow(unit_rows(drawn), int(np.clip(n // rows_per_cell, 1, most_cells)), seed=seed) if len(drawn) else None
    lengths = lambda x: np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]
    assign = lambda tree, x: tree.assign(x / lengths(x)) if tree is not None else np.zeros(len(x), np.int64)
    near = assign(tree, drawn)
    centres = np.zeros((tree.leaves if tree is not None else 1, width))
    for c in np.unique(near):
        centres[c] = drawn[near == c].mean(0)
    shared = spark.sparkContext.broadcast((tree, centres))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, centres = shared.value
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("vector"))
                cell = assign(tree, x)
                apart = x - centres[cell]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(np.sqrt(exact_dots(apart, apart)))], names=["id", "vector", "label", "q_", "cell", "gap"])

    rows = cut(every.mapInArrow(sparing(index), "id long, vector array<double>, label long, q_ boolean, cell int, gap double"))
    cells = {r["cell"]: (r["n"], centres[r["cell"]], r["gap"]) for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("gap")).collect()}
    asked = rows.where("q_").groupBy("id").agg(F.min(F.struct("label", "vector", "cell")).alias("a")).select("id", "a.vector", "a.label", "a.cell")
    asked = cut(asked.withColumn("low", F.array(F.lit(float("-inf")))).withColumn("high", F.array(F.lit(float("inf")))))
    first = cut(met(asked, rows, cells, positives, True, True, sizes))
    reached = ranked(first, positives).groupBy("query_id").agg(F.when(F.count("*") == positives, F.min("score")).alias("least")).withColumnRenamed("query_id", "id")
    onward = asked.drop("low").join(reached, "id", "left").withColumn("low", F.array(F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))))).drop("least")
    both = first.unionByName(met(onward, rows, cells, positives, True, False, sizes))
    best = cut(ranked(both, positives).select("query_id", (F.col("rank") - 1).cast("int").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = asked.drop("low", "high").join(window(best, positives, low_pct, high_pct), "id")
    found = ranked(met(windows, rows, cells, k, False, None, sizes), k)
    return best.join(found, ["query_id", "slot"]).select(F.col("query_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def within(rows: pa.Table, positives: int, k: int, low_pct: int, high_pct: int) -> pa.Table:
    """The same for few rows of one length, both searches over all of them."""
    ids, vectors, labels, asks = rows["id"].to_numpy(), matrix(rows["vector"]), rows["label"].to_numpy(), rows["q_"].to_numpy()
    least: dict[int, int] = {}
    for j in np.flatnonzero(asks).tolist():
        if ids[j] not in least or (labels[j], *vectors[j]) < (labels[least[ids[j]]], *vectors[least[ids[j]]]):
            least[ids[j]] = j
    at = np.array([*least.values()], np.int64)
    out: list[tuple[int, int, int, int, int, int]] = []
    if len(at):
        free = np.full((len(at), 1), np.inf)
        i, _, p_ids, scores = search(ids[at], vectors[at], labels[at], -free, free, ids, vectors, labels, positives, True)
        low, high = np.full((len(at), positives), np.inf), np.full((len(at), positives), -np.inf)
        slot = np.arange(len(i)) - np.searchsorted(i, i)
        fine = scores >= 0
        low[i[fine], slot[fine]], high[i[fine], slot[fine]] = -(-scores[fine] * low_pct // 100), scores[fine] * high_pct // 100
        name = {(a, b): (int(p), int(s)) for a, b, p, s in zip(i.tolist(), slot.tolist(), p_ids, scores, strict=True)}
        i, j, n_ids, n_scores = search(ids[at], vectors[at], labels[at], low, high, ids, vectors, labels, k, False)
        rank = np.arange(len(i)) - np.searchsorted(i * positives + j, i * positives + j) + 1
        out = [(int(ids[at[a]]), name[a, b][0], r, int(n), name[a, b][1], int(s)) for a, b, r, n, s in zip(i.tolist(), j.tolist(), rank.tolist(), n_ids, n_scores, strict=True)]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table([pa.array([x[c] for x in out], t) for c, t in enumerate(types)], names=[c.split()[0] for c in NEGATIVES.split(", ")])


NEGATIVES = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    df: DataFrame, is_anchor: Column, label: Column, positives: int = 5, k: int = 3, low_pct: int = 50, high_pct: int = 95, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 20_000, rows_per_cell: int = ROWS, most_cells: int = 4_096, seed: int = 7, sizes: tuple[int, int] = (ROWS, ASKED)
) -> DataFrame:
    """For each anchor and each of its ``positives`` best rows of the same label, the ``k`` best rows of other labels that score between ``low_pct`` and ``high_pct`` percent of the positive.

    Lengths of more than ``sizes[0]`` rows are searched one by one; all others, each of which fits a group, in one pass.
    """
    every = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("q_"))
    every = every.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"), True)).withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale).cast("double")))
    size = F.size("vector")
    counts = every.groupBy(size.alias("width")).agg(F.count("*").alias("n"), F.count_if("q_").alias("asked")).collect()
    large = sorted(r["width"] for r in counts if r["asked"] and r["n"] > sizes[0])
    few = [r["width"] for r in counts if r["asked"] and r["n"] <= sizes[0]]
    out = every.where(size.isin(few)).withColumn("width", size).groupBy("width").applyInArrow(lambda rows: within(rows, positives, k, low_pct, high_pct), NEGATIVES) if few else every.sparkSession.createDataFrame([], NEGATIVES)
    for width in large:
        out = out.unionByName(one_length(every.where(size == width), width, positives, k, low_pct, high_pct, sample, rows_per_cell, most_cells, seed, sizes))
    return out


def brute_force(rows: list[tuple[int, list[float] | None, int | None]], anchors: set[int], positives: int = 5, k: int = 3, low_pct: int = 50, high_pct: int = 95, scale: int = 256) -> list[tuple[int, int, int, int, int, int]]:
    """The same by comparing all, for rows of different ids and one length; for tests."""
    fine = [(i, np.floor(np.array(v, np.float64) * scale).astype(np.int64), label) for i, v, label in rows if v and label is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, q, label in fine:
        if a not in anchors:
            continue
        scores = sorted((-int(v @ q), i, other) for i, v, other in fine if i != a)
        for s, p, _ in [x for x in scores if x[2] == label][:positives]:
            fits = [x for x in scores if x[2] != label and -low_pct * s <= -100 * x[0] <= -high_pct * s][:k]
            out += [(a, p, r, i, -s, -n) for r, (n, i, _) in enumerate(fits, 1)]
    return out
