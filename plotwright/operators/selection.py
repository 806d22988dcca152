"""Exact quantiles of many groups at once: values at ranks, by histograms that grow finer.

Every pass counts the values of all groups whose rank is still open, each in ``BINS`` equal parts of the interval that
holds its rank, and notes the least and the greatest value of each part. So the number of jobs does not grow with the groups,
no value moves but as counts, and the driver holds the parts of open intervals. Once few values are left, they come as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 2_048
#: So few different values are taken to the driver as they are.
FEW = 100_000
INF = float("inf")


@dataclass
class Interval:
    """``count`` values of group ``g`` from ``low`` to ``high``, both of which occur; ``before`` come earlier. ``ranks`` are still open."""

    g: int
    low: float
    high: float
    before: int
    count: int
    ranks: list[int]


def value_at(rows: DataFrame, first: list[Interval]) -> dict[tuple[int, int], float]:
    """{(group, rank): value} for the open ranks of ``first``, in rows (g int, x double, n long) of finite values."""
    spark, found = rows.sparkSession, dict[tuple[int, int], float]()
    open_ = first
    while True:
        left = []
        for i in open_:
            for r in i.ranks:
                if i.low == i.high or r == i.before:
                    found[i.g, r] = i.low
                elif r == i.before + i.count - 1:
                    found[i.g, r] = i.high
            i.ranks = [r for r in i.ranks if (i.g, r) not in found]
            if i.ranks:
                left.append(i)
        if not left:
            return found
        asked = spark.createDataFrame([(k, i.g, i.low, i.high) for k, i in enumerate(left)], "k int, g_ int, low double, high double")
        x, low, high = F.col("x"), F.col("low"), F.col("high")
        near = rows.join(F.broadcast(asked), (F.col("g") == F.col("g_")) & (x >= low) & (x <= high))
        if sum(i.count for i in left) <= FEW:
            values: dict[int, list[tuple[float, int]]] = {}
            for r in near.groupBy("k", "x").agg(F.sum("n").alias("n")).collect():
                values.setdefault(r["k"], []).append((r["x"], r["n"]))
            for k, i in enumerate(left):
                at = i.before
                for v, n in sorted(values[k]):
                    found |= {(i.g, r): v for r in i.ranks if at <= r < at + n}
                    at += n
            return found
        # The part of a value grows with the value, whatever is rounded; halves keep wide intervals finite.
        share = F.when(high - low < INF, (x - low) / (high - low)).otherwise((x / 2 - low / 2) / (high / 2 - low / 2))
        part = F.least(F.lit(BINS - 1), F.floor(share * BINS)).cast("int")
        counted = near.groupBy("k", part.alias("part")).agg(F.sum("n").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        parts: dict[int, list] = {}
        for r in counted.collect():
            parts.setdefault(r["k"], []).append(r)
        open_ = []
        for k, i in enumerate(left):
            at = i.before
            for r in sorted(parts[k], key=lambda r: r["part"]):
                inside = [x for x in i.ranks if at <= x < at + r["n"]]
                if inside:
                    open_.append(Interval(i.g, r["low"], r["high"], at, r["n"], inside))
                at += r["n"]


def quantiles_by_group(rows: DataFrame, shares: Sequence[float]) -> dict[int, list[float | None]]:
    """{group: the quantiles at ``shares``, between ranks in proportion} for rows (g int, x double, n long: how often it counts).

    Nulls do not count; NaN comes last, after infinity. Groups without a value are not in the result.
    """
    x, n = F.col("x"), F.col("n")
    finite = (x > -INF) & (x < INF)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    ends = rows.where(x.isNotNull()).groupBy("g").agg(total(x == -INF).alias("under"), total(finite).alias("n"), F.min(F.when(finite, x)).alias("low"), F.max(F.when(finite, x)).alias("high"), total(x == INF).alias("over"), total(F.isnan("x")).alias("nan")).collect()
    wanted, first = {}, []
    for e in ends:
        every = e["under"] + e["n"] + e["over"] + e["nan"]
        places = [s * (every - 1) for s in shares]
        wanted[e["g"]] = (e, places, sorted({int(p) + k for p in places for k in (0, 1) if int(p) + k < every}))
        inside = [r - e["under"] for r in wanted[e["g"]][2] if e["under"] <= r < e["under"] + e["n"]]
        if inside:
            first.append(Interval(e["g"], e["low"], e["high"], 0, e["n"], inside))
    found = value_at(rows.where(finite), first)
    out: dict[int, list[float | None]] = {}
    for g, (e, places, _) in wanted.items():

        def value(r: int, g: int = g, e=e) -> float:
            if r < e["under"]:
                return -INF
            r -= e["under"]
            return found[g, r] if r < e["n"] else INF if r < e["n"] + e["over"] else float("nan")

        out[g] = [value(int(p)) + (p - int(p)) * (value(int(p) + 1) - value(int(p))) if p > int(p) else value(int(p)) for p in places]
    return out
