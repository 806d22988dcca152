"""Mixing sources to target weights by capped water-filling.

Each source may be repeated ``most_epochs`` times at most. Shares by weight above
that are clamped and the excess goes to the other sources by weight, until none is
above. A source at e epochs gives floor(e) whole repetitions of each document and one
more of some: documents are ordered by a seeded hash within classes of like size, and
of each class those below a threshold are taken. The thresholds come from a histogram
(source, size class, hash bin) of bounded size; what a class of long documents misses of
its goal is carried to the next shorter class, so a source ends near its target.

Texts are never shuffled. Sources are rows of a frame, in any number: a round of the
water-filling is one sum over it, and all that the driver keeps of a round is the ratio of
weight to size above which sources are clamped. A task holds one source's histogram (64
classes x ``BINS``). Ranks for the cycle of weights are taken in one sorted pass over the
sources' names, which spills.

Defined results: null text has size 0; null is a source of its own, after all others;
sources of size 0 have target 0; rows repeated in the input share their draw; an empty
table gives an empty result; other columns pass through untouched, those called as the new
ones (``prefix`` and size, source_size, target or copies) give way to them.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwright.llm.common import cut, others

BINS = 256
#: What is broadcast has this many sources at most (64 rows of thresholds each); beyond it the joins shuffle.
BROADCAST_SOURCES = 2_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weighted(sources: DataFrame, weights: dict[str | None, float] | None, cycle: Sequence[float] = (1.0, 2.0, 3.0)) -> DataFrame:
    """``sources`` (source, total) with weight: as given (0 if not named), or in turn by code point, null last."""
    if weights is not None:
        given = sources.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        return sources.join(given, F.col("source").eqNullSafe(F.col("name")), "left").select("source", "total", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (rank % len(cycle) + 1).cast("int")))


def filled(sources: DataFrame, most_epochs: float) -> DataFrame:
    """``sources`` (source, total, weight) with target: the sum of totals shared by weight, none above ``most_epochs`` times its total, the excess shared again.

    Sources by falling weight / total are clamped until one is not above its cap by what is left for it and those after it; the first that is not ends it, so sums up to each source decide for all at once.
    """
    ratio = F.try_divide("weight", "total")
    has = (F.col("total") > 0) & (F.col("weight") > 0)
    every = sources.agg(F.sum("total")).first()[0] or 0
    before = Window.orderBy(ratio.desc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(ratio.desc(), F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    left = F.lit(float(every)) - most_epochs * F.coalesce(F.sum("total").over(before), F.lit(0))
    above = F.col("weight") * left > most_epochs * F.col("total") * F.sum("weight").over(after)
    judged = cut(sources.where(has).select("source", "total", "weight", (~above).alias("free")))
    so_far = Window.orderBy(ratio.desc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    clamped = cut(judged.withColumn("clamped", ~F.max("free").over(so_far)))
    gone, open_ = clamped.agg(F.sum(F.when(F.col("clamped"), F.col("total"))), F.sum(F.when(~F.col("clamped"), F.col("weight")))).first()
    rest = max(0.0, every - most_epochs * (gone or 0))
    share = F.when(F.col("clamped"), most_epochs * F.col("total")).otherwise(F.lit(rest) * F.col("weight") / F.lit(open_ or 1.0))
    shares = clamped.select("source", share.alias("target")).unionByName(sources.where(~F.coalesce(has, F.lit(False))).select("source", F.lit(0.0).alias("target")))
    named = shares.select(F.col("source").alias("name"), F.col("target").cast("double").alias("target"))
    return sources.join(named, F.col("source").eqNullSafe(F.col("name"))).drop("name")


def mix(df: DataFrame, weights: dict[str | None, float] | None = None, most_epochs: float = 3.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", prefix: str = "mix_", fractions: bool = False) -> DataFrame:
    """``df`` with size, source_size, target, copies (whole repetitions to take) and, with ``fractions``, part (words of one more), each name after ``prefix``. Without ``weights``, 1, 2, 3 in turn.

    Documents of a source and size class have one of ``BINS`` places each; those below a threshold are taken once more. Without
    ``fractions`` the threshold is the nearest one, so a source misses its target by half a bin of its smallest class
    (which of a source with few, long documents may be all of it). With them, the documents at the threshold are taken in part, each by the same share of its words.
    """
    size, source = words(F.col(f"`{text_col}`")), F.col(f"`{source_col}`").cast("string")
    kind = F.floor(F.log2(F.col("size") + 1)).cast("int")
    place = F.pmod(F.xxhash64("id", "size", F.lit(seed)), F.lit(BINS)).cast("int")
    row = F.struct(F.lit(0).alias("_"), *others(df, *[prefix + c for c in ("size", "source_size", "target", "copies", *["part"] * fractions)]))
    sized = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), source.alias("source"), size.alias("size"), row.alias("row"))
    sized = sized.select("source", "size", kind.alias("kind"), place.alias("place"), "row")
    bins = cut(sized.groupBy("source", "kind", "place").agg(F.sum("size").alias("size")))
    sources = cut(filled(cut(weighted(bins.groupBy("source").agg(F.sum("size").alias("total")), weights)), most_epochs))
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    at_hand = lambda some: F.broadcast(some) if few else some
    plan = sources.select(F.col("source").alias("m_source"), "total", "target", F.when(F.col("total") > 0, F.floor(F.try_divide("target", "total") + 1e-12)).otherwise(0).cast("int").alias("whole"))

    def thresholds(pdf: pd.DataFrame) -> pd.DataFrame:
        name, total, target, whole = (pdf[c].iloc[0] for c in ("m_source", "total", "target", "whole"))
        part = max(0.0, target / total - whole) if total else 0.0
        missed, out = 0.0, []
        for k in sorted(pdf["kind"].unique(), reverse=True):
            own = pdf[pdf["kind"] == k].groupby("place")["size"].sum().reindex(range(BINS), fill_value=0)
            goal = part * own.sum() + missed
            reached = [0, *own.cumsum()]
            if fractions:
                below = max(b for b in range(BINS + 1) if b == 0 or reached[b] <= goal)
                at = next((b for b in range(below, BINS) if own[b]), None)
                share = 0.0 if at is None else min(1.0, max(0.0, (goal - reached[below]) / own[at]))
            else:
                below, at, share = min(range(BINS + 1), key=lambda b: (abs(reached[b] - goal), b)), None, 0.0
                missed = goal - reached[below]
            out.append((None if pd.isna(name) else name, int(k), below, int(whole), int(total), float(target), -1 if at is None else at, float(share)))
        return pd.DataFrame(out, columns=["m_source", "m_kind", "m_below", "m_whole", "m_total", "m_target", "m_at", "m_share"]).astype({"m_source": object})

    table = bins.join(at_hand(plan), F.col("source").eqNullSafe(F.col("m_source"))).groupBy("m_source").applyInPandas(thresholds, "m_source string, m_kind int, m_below int, m_whole int, m_total long, m_target double, m_at int, m_share double")
    joined = sized.join(at_hand(cut(table)), F.col("source").eqNullSafe(F.col("m_source")) & (F.col("kind") == F.col("m_kind")), "left")
    copies = F.coalesce(F.col("m_whole") + (F.col("place") < F.col("m_below")).cast("int"), F.lit(0))
    new = {"size": F.col("size"), "source_size": F.col("m_total"), "target": F.col("m_target"), "copies": F.when(F.col("size") > 0, copies).otherwise(F.least(copies, F.lit(1)))}
    if fractions:
        new["part"] = F.coalesce(F.when(F.col("place") == F.col("m_at"), F.round(F.col("m_share") * F.col("size"))), F.lit(0)).cast("long")
    return joined.select(*[F.col(f"row.`{c}`") for c in sized.schema["row"].dataType.names[1:]], *[x.alias(prefix + c) for c, x in new.items()])


def repeat(df: DataFrame, copies: str) -> DataFrame:
    """Each row as often as ``copies`` says (not at all, if 0 or null); the column goes."""
    return df.where(F.col(copies) > 0).withColumn(copies, F.explode(F.array_repeat(F.lit(0), F.col(copies)))).drop(copies)
