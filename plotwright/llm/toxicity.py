"""Toxicity of texts: maximal-scoring segments of token log-odds, calibrated by extreme values.

1. Of each word, and of each beginning of ``stems`` letters of a longer one, the number of labelled
   texts of either kind that hold it, over all rows to learn from. Its log-odds have a Dirichlet prior in proportion to its share of both kinds together
   (``prior`` times all counts); a word's score is the bound of them nearest to zero, ``doubt``
   standard errors off, less ``drift``. Of a word and its beginnings the farthest from zero counts.
   Words that cannot be told from zero score -``drift``.
2. A linear scan finds every maximal-scoring segment of a text's words.
3. Of clean texts kept apart, the best segments follow an extreme-value law
   exp(-K n exp(-lambda S)) for n words; K and lambda are those of greatest likelihood. It says how
   many segments of a score are expected by chance. Those below ``expected`` are the passages; a
   text's evidence is the least probability of its one, two, ... best segments together.
4. A logistic curve over that evidence, fitted on the rows kept apart, is the score.

All counts cover all rows to learn from, whose labels are ``most_labels`` ids at most, drawn by a
hash where there are more (so that they can be broadcast and no text is shuffled); the curves are
fitted on ``curve_rows`` of them; the model holds ``most_words`` words, those of the largest scores.

Defined results: null and empty texts have no evidence and get the score of none. An id whose
labels differ is toxic if any says so; null labels and ids teach nothing; rows that repeat an id
learn and are scored each by its own text. Without labels of both kinds every text scores as
the one kind does (0 without any). Words are runs of letters and digits of the lower-cased text. Other columns
pass through, but those called score, predicted or passages give way to the new ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotwright.llm.common import cut, lean, others, sparing, text_pieces

WORD = re.compile(r"[^\W_]+")
PASSAGE = "begin int, stop int, score double, expected double"
#: Characters that are taken apart at once; a longer text goes on at the next word.
PIECE = 1_000_000


@dataclass(frozen=True)
class Params:
    prior: float = 0.1
    doubt: float = 1.5
    drift: float = 0.3
    expected: float = 0.05
    stems: tuple[int, ...] = (4, 5, 6, 7)
    apart: int = 4
    most_labels: int = 1_000_000
    curve_rows: int = 50_000
    most_words: int = 200_000
    seed: int = 29


@dataclass(frozen=True)
class Model:
    """words: log-odds of words and beginnings; rate and k: of the extreme-value law; line: intercept and slope of the curve."""

    words: dict[str, float]
    rate: float
    k: float
    line: tuple[float, float]
    params: Params


def words_of(text: str) -> Iterator[tuple[int, list[str], list[int]]]:
    """(number of the first word, words, where they begin) by pieces. Case is folded word by word, so places are those of the text."""
    at = first = 0
    while at < len(text):
        stop = min(at + PIECE, len(text))
        while stop < len(text) and text[stop].isalnum() and text[stop - 1].isalnum():
            stop += 1
        found = [(m.group().lower(), m.start()) for m in WORD.finditer(text, at, stop)]
        yield first, [f[0] for f in found], [f[1] for f in found]
        first, at = first + len(found), stop


def segments(at: list[int], gains: list[float], before: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments, (index of the first gain, of the last, score), in time linear in the gains.

    ``gains`` are the words of positive score, ``before`` the sum of all scores ahead of each. A segment keeps a
    link to the nearest earlier one with less ahead of it, so that none is passed twice on the way.
    """
    low: list[float] = []
    high: list[float] = []
    begin: list[int] = []
    stop: list[int] = []
    link: list[int] = []
    for k, (gain, ahead) in enumerate(zip(gains, before, strict=True)):
        left, right, first = ahead, ahead + gain, k
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= left:
                j = link[j]
            if j < 0 or high[j] >= right:
                break
            left, first = low[j], begin[j]
            del low[j:], high[j:], begin[j:], stop[j:], link[j:]
        low.append(left)
        high.append(right)
        begin.append(first)
        stop.append(k)
        link.append(j)
    return [(a, b, r - s) for a, b, r, s in zip(begin, stop, high, low, strict=True)]


def tokens(word: str, stems: tuple[int, ...]) -> list[str]:
    """A word and its beginnings, these marked by an asterisk."""
    return [word, *[word[:n] + "*" for n in stems if n < len(word)]]


class Scores(dict):
    """Of each word met, its log-odds less the drift, or None for one that scores as most do; looked up once."""

    MOST = 1 << 18

    def __init__(self, known: dict[str, float], params: Params):
        super().__init__()
        self.known, self.params = known, params

    def __missing__(self, word: str) -> float | None:
        found = [s for t in tokens(word, self.params.stems) if (s := self.known.get(t)) is not None]
        if len(self) >= self.MOST:
            self.clear()
        self[word] = max(found, key=abs) - self.params.drift if found else None
        return self[word]


def scanned(scores: Scores, text: str) -> tuple[int, list[tuple[int, int, float]]]:
    """(number of words, maximal segments as (begin, end, score)) of a whole text, places in code points."""
    n, total, met = 0, 0.0, 0
    gains: list[float] = []
    before: list[float] = []
    places: list[tuple[int, int]] = []
    at: list[int] = []
    for first, words, starts in words_of(text):
        for k, s in enumerate(map(scores.__getitem__, words)):
            if s is None:
                continue
            ahead = total - scores.params.drift * (first + k - met)  # all words but those met score the drift
            if s > 0:
                gains.append(s)
                before.append(ahead)
                at.append(first + k)
                places.append((starts[k], starts[k] + len(words[k])))
            total, met = total + s, met + 1
        n = first + len(words)
    return n, [(places[a][0], places[b][1], s) for a, b, s in segments(at, gains, before)]


def evidence(scores: list[float], n: int, rate: float, k: float) -> float:
    """Minus the log of the least probability that chance gives the best, the two best, ... segments of ``n`` words."""
    if not scores or not n:
        return 0.0
    normal = [rate * s - math.log(k * n) for s in sorted(scores, reverse=True)]
    chance = math.exp(-normal[0]) if normal[0] > -30 else math.inf
    most, total = (-math.log(-math.expm1(-chance)) if chance > 1e-12 else normal[0]), 0.0
    for r, x in enumerate(normal, 1):
        if x <= 0:
            break
        total += x
        if r > 1 and total > r:  # the sum's tail, paid for by the number of ways to choose how many
            most = max(most, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2))
    return most


def judged(model: Model, scores: Scores, text: str | None) -> tuple[float, list[tuple[int, int, float, float]]]:
    """(score, significant passages as (begin, end, score, expected by chance)) of a text."""
    n, found = scanned(scores, text or "")
    a, b = model.line
    score = 1 / (1 + math.exp(-min(max(a + b * math.log1p(evidence([s for *_, s in found], n, model.rate, model.k)), -500.0), 500.0)))
    sure = [(i, j, s, model.k * n * math.exp(-min(model.rate * s, 700.0))) for i, j, s in found]
    return score, [x for x in sure if x[3] <= model.params.expected]


def extreme_law(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(lambda, K) of greatest likelihood for best scores of texts of ``n`` words; a score of 0 says only that no segment was above it."""
    have = n > 0
    best, n = best[have], n[have].astype(np.float64)
    above, words, many = best[best > 0], n[best > 0], int((best > 0).sum())
    none = float(n[best <= 0].sum())
    if not many:
        return 1.0, 1 / max(1.0, none)  # less than one segment in all these words

    def k(rate: float) -> float:
        return many / float((words * np.exp(-rate * above)).sum() + none)

    def slope(rate: float) -> float:
        return many / rate - float(above.sum()) + k(rate) * float((words * above * np.exp(-rate * above)).sum())

    low, high = 1e-3, 1.0
    while slope(high) > 0 and high < 1e3:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if slope(middle) > 0 else (low, middle)
    return (low + high) / 2, k((low + high) / 2)


def curve(x: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (not negative) of a logistic curve, by Newton steps; targets are drawn in by one row of each kind, so that kinds that are told apart without fault leave both finite."""
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    if not n1 or not n0:
        return (20.0 if n1 else -500.0), 0.0
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design = np.stack([np.ones(len(x)), x], 1)
    line = np.array([math.log(n1 / n0), 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ line, -500, 500)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), design.T @ (target - p))
        line = line + step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return (float(line[0]), float(line[1])) if line[1] >= 0 else (math.log(n1 / n0), 0.0)


def word_scores(counts: DataFrame, totals: tuple[int, int], params: Params) -> dict[str, float]:
    """The ``most_words`` largest scores of ``counts`` (word, toxic, clean); ``totals`` are the counts' sums."""
    n1, n0 = float(totals[0]), float(totals[1])
    y1, y0 = F.col("toxic").cast("double"), F.col("clean").cast("double")
    a, whole = params.prior * (y1 + y0), params.prior * (n1 + n0)
    odds = F.log((y1 + a) / (n1 + whole - y1 - a)) - F.log((y0 + a) / (n0 + whole - y0 - a))
    error = F.sqrt(1 / (y1 + a) + 1 / (y0 + a)) * params.doubt
    bound = F.when(odds > error, odds - error).when(odds < -error, odds + error)
    found = counts.select("word", bound.alias("s")).where("s is not null").orderBy(F.abs("s").desc(), "word").limit(params.most_words).collect()
    return {r["word"]: r["s"] for r in found}


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from the rows of ``docs`` whose id is in ``labels`` (id, label 0 or 1)."""
    spark = docs.sparkSession
    lean(spark)
    known = labels.select(F.col(id_col).alias("id_"), F.col(label_col).cast("int").alias("toxic_")).where("id_ is not null and toxic_ is not null")
    known = cut(known.groupBy("id_").agg((F.max("toxic_") > 0).alias("toxic_")))
    ids = known.count()
    drawn = F.pmod(F.xxhash64(F.col("id_").cast("string"), F.lit(params.seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, params.most_labels / max(1, ids)))
    rows = docs.select(F.col(f"`{id_col}`").alias("id_"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(known.where(drawn)), "id_")
    # By id and text: of rows that share an id, some are kept apart as well.
    rows = rows.select("toxic_", "text", F.pmod(F.xxhash64(F.col("id_").cast("string"), "text", F.lit(params.seed + 1)), F.lit(params.apart)).alias("part"))
    sizes = {(r["toxic_"], r["part"] == 0): r["n"] for r in rows.groupBy("toxic_", (F.col("part") == 0).alias("part")).agg(F.count("*").alias("n")).select("toxic_", F.when(F.col("part"), 0).otherwise(1).alias("part"), "n").collect()}
    toxic, clean = (sum(n for (t, _), n in sizes.items() if t is kind) for kind in (True, False))
    if not toxic or not clean:
        return Model({}, 1.0, 1.0, (20.0 if toxic else -500.0, 0.0), params)
    split = all(sizes.get((t, p)) for t in (True, False) for p in (True, False))  # else both parts are all rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("toxic_").to_pylist()
            for begin, texts in text_pieces(batch, "text", 2_000_000):
                found: dict[str, list[int]] = {}
                for kind, text in zip(kinds[begin:], texts, strict=False):
                    for word in {t for w in {w for _, words, _ in words_of(text) for w in words} for t in tokens(w, params.stems)}:
                        found.setdefault(word, [0, 0])[0 if kind else 1] += 1
                yield pa.RecordBatch.from_arrays([pa.array([*found], pa.string()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())], names=["word", "toxic", "clean"])

    learns = rows.where("part != 0") if split else rows
    counts = learns.select("toxic_", "text").mapInArrow(sparing(count), "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = cut(counts.where("toxic + clean > 1"))  # a word of a single text is never sure
    totals = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    words = word_scores(counts, (totals[0] or 0, totals[1] or 0), params) if totals[0] and totals[1] else {}
    shared = spark.sparkContext.broadcast(words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Scores(shared.value, params)
        for batch in batches:
            kinds = batch.column("toxic_").to_pylist()
            for begin, texts in text_pieces(batch, "text"):
                got = [scanned(known, text) for text in texts]
                yield pa.RecordBatch.from_arrays([pa.array(kinds[begin : begin + len(texts)], pa.bool_()), pa.array([n for n, _ in got], pa.int64()), pa.array([sorted((s for *_, s in f), reverse=True)[:64] for _, f in got], pa.list_(pa.float64()))], names=["toxic_", "n", "scores"])

    tries = rows.where("part = 0") if split else rows
    share = min(1.0, params.curve_rows / max(1, sum(n for (_, p), n in sizes.items() if p or not split)))
    tries = tries.where(F.pmod(F.xxhash64("text", F.lit(params.seed + 2)), F.lit(1 << 30)) < int((1 << 30) * share)) if share < 1 else tries
    held = tries.select("toxic_", "text").mapInArrow(sparing(scan), "toxic_ boolean, n long, scores array<double>").limit(2 * params.curve_rows).toArrow()
    n, kinds, scores = held["n"].to_numpy(), held["toxic_"].to_numpy(zero_copy_only=False).astype(bool), held["scores"].to_pylist()
    best = np.array([s[0] if s else 0.0 for s in scores])
    rate, k = extreme_law(best[~kinds], n[~kinds])
    x = np.array([math.log1p(evidence(s, int(m), rate, k)) for s, m in zip(scores, n, strict=True)])
    return Model(words, rate, k, curve(x, kinds), params)


def predict(df: DataFrame, model: Model, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None), then score, predicted and passages (places in code points), for every row of ``df``."""
    lean(df.sparkSession)
    keep = keep if keep is not None else others(df, "score", "predicted", "passages")
    names = df.select(*keep).columns
    picked = df.select(*[c.alias(f"c{k}") for k, c in enumerate(keep)], F.col(f"`{text_col}`").alias("text_in"))
    shared = df.sparkSession.sparkContext.broadcast(model)
    inner = picked.drop("text_in").schema
    passage = pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(shared.value.words, shared.value.params)
        for batch in batches:
            found = [judged(shared.value, scores, t.as_py()) for t in batch.column("text_in")]
            passages = [[dict(zip(("begin", "stop", "score", "expected"), p, strict=True)) for p in ps] for _, ps in found]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(names))], pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= 0.5) for s, _ in found], pa.int32()), pa.array(passages, passage)], names=[*inner.names, "score", "predicted", "passages"])

    out = picked.mapInArrow(sparing(run), T.StructType([*inner.fields, *T._parse_datatype_string(f"score double, predicted int, passages array<struct<{PASSAGE.replace(' ', ':')}>>".replace(",:", ", ")).fields]))
    return out.toDF(*names, "score", "predicted", "passages")
