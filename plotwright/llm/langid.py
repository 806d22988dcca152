"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Three passes, none of which shuffles a text:

1. document frequencies of hashed n-grams, and rows of each language, over every labelled row, and
   the ``sample_per_language`` least hashes of different (id, text) of each language;
2. the n-gram counts of the rows with these hashes, one of each, on which the driver trains by
   follow-the-regularised-leader (elastic net, the bias as a feature that always holds).
   Of the penalties ``l1`` the largest is taken whose loss on rows held back is within one
   standard error of the least; other rows held back then give the temperature;
3. the prediction of every whole text, with the weights broadcast: features times languages,
   whatever the number of rows.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every
text if no labelled row has a letter. Equal scores go to the language first by code point.
Repeated rows are predicted alike; languages, sources and ids of a row are never inputs.
Other columns pass through; those called lang_pred or score give way to the new ones.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotwright.llm.common import codepoints, cut, lean, others, sparing, text_pieces

UNDETERMINED = "und"


@dataclass(frozen=True)
class Params:
    """``sample_per_language`` bounds the different rows of a language that the driver trains on; all else covers all rows. ``features`` is a power of two; the driver holds 20 bytes, and each task 4, for each of them and each language."""

    features: int = 1 << 15
    longest: int = 3
    sample_per_language: int = 600
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: tuple[float, ...] = (0.1, 0.3, 1.0, 3.0)
    l2: float = 1e-2
    calibration_share: int = 5
    seed: int = 17


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    params: Params


@functools.cache
def letter_table() -> np.ndarray:
    """The code point of each letter's lower case (combining marks stand for themselves), and 0 for all that is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low[0])
        elif kind[0] == "M":
            out[c] = c
    return out


@functools.cache
def letter_mask() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str, params: Params) -> tuple[np.ndarray, np.ndarray] | None:
    """(hashed n-grams in order, their counts) of a whole text; None if it has no letter. Words are padded by one blank."""
    raw = codepoints(text)
    if not letter_mask()[raw].any():
        return None
    points = letter_table()[raw]
    keep = points > 0
    keep[1:] |= points[:-1] > 0  # of the gaps between words, the first code point
    points = np.concatenate([[0], points[keep], [0]]).astype(np.uint64)
    parts, codes = [], points
    for n in range(1, params.longest + 1):
        if n > 1:
            codes = codes[:-1] * np.uint64(0x100000001B3) + points[n - 1 :]
        mixed = (codes + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        parts.append((mixed >> np.uint64(40)).astype(np.int64) % params.features)
    every = np.concatenate(parts)
    if len(every) > params.features // 8:
        counts = np.bincount(every, minlength=params.features)
        at = np.flatnonzero(counts)
        return at, counts[at]
    return np.unique(every, return_counts=True)


def weighed(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear term frequency times inverse document frequency, of length 1."""
    x = (1 + np.log(counts)) * idf[at]
    return x / max(np.sqrt(x @ x), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[int, str, np.ndarray, np.ndarray]], idf: np.ndarray, params: Params) -> Model | None:
    """``rows``: (id's hash, language, n-grams, counts). Follow the regularised leader, coordinate by coordinate, for each penalty."""
    languages = tuple(sorted({r[1] for r in rows}, key=lambda x: [ord(c) for c in x]))
    if not languages:
        return None
    index = {x: k for k, x in enumerate(languages)}
    rows = sorted(rows, key=lambda r: (r[0], r[1], len(r[2])))
    data = [(r[2], weighed(r[2], r[3], idf), index[r[1]]) for r in rows]
    part = lambda j: [d for k, d in enumerate(data) if k % params.calibration_share == j]
    chooses, calibrates = part(0), part(1)
    used = [d for k, d in enumerate(data) if k % params.calibration_share > 1] or data
    truth = lambda some: np.array([y for _, _, y in some], np.int64)
    tried = []
    for l1 in params.l1:  # one after the other, so that the languages' weights are held once
        z, n = (np.zeros((params.features + 1, len(languages))) for _ in range(2))

        def weights_at(at: np.ndarray | slice, z=z, n=n, l1=l1) -> np.ndarray:
            zs = z[at]
            return -(zs - np.sign(zs) * l1) / ((params.beta + np.sqrt(n[at])) / params.alpha + params.l2) * (np.abs(zs) > l1)

        for epoch in range(params.epochs):
            for k in np.random.default_rng([params.seed, epoch]).permutation(len(used)):
                at, x, y = used[k]
                at, x = np.append(at, params.features), np.append(x, 1.0)
                w = weights_at(at)
                slope = softmax(x @ w)
                slope[y] -= 1
                g = x[:, None] * slope
                squares = n[at]
                more = squares + g * g
                z[at] += g - (np.sqrt(more) - np.sqrt(squares)) / params.alpha * w
                n[at] = more
        weights = weights_at(slice(None)).astype(np.float32)
        p = softmax(logits_of(weights, chooses)) if chooses else np.ones((1, len(languages)))
        losses = -np.log(np.maximum(p[np.arange(len(p)), truth(chooses) if chooses else [0]], 1e-12))
        tried.append((losses.mean(), losses.std() / np.sqrt(len(losses)), l1, weights))
    least = min(tried, key=lambda t: t[0])
    *_, weights = max((t for t in tried if t[0] <= least[0] + least[1]), key=lambda t: t[2]) if chooses else tried[0]
    temperature = calibrated(logits_of(weights, calibrates), truth(calibrates)) if calibrates else 1.0
    return Model(languages, idf.astype(np.float32), weights[:-1], weights[-1].astype(np.float64), temperature, params)


def logits_of(weights: np.ndarray, some: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    return np.array([x @ weights[at] + weights[-1] for at, x, _ in some], np.float64)


def calibrated(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of greatest likelihood when, of n rows, each counts as wrong by 1 / (n + 2), spread over the other languages: so rows that are told apart without fault do not drive it to zero."""
    n, size = logits.shape
    if size < 2:
        return 1.0
    target = np.full((n, size), 1 / (n + 2) / (size - 1))
    target[np.arange(n), truth] = (n + 1) / (n + 2)

    def slope(cold: float) -> float:
        """Of the loss by one over the temperature; it grows with it."""
        return float(((softmax(logits * cold) - target) * logits).sum())

    low, high = 1e-6, 1.0
    while slope(high) < 0 and high < 1e9:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if slope(middle) < 0 else (low, middle)
    return 2 / (low + high)


def fit(labelled: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Trains on ``labelled``. Rows whose text or language is null, or whose text has no letter, teach nothing."""
    lean(labelled.sparkSession)
    # By id and text: rows that share an id, or have none, are drawn apart; rows that repeat both are drawn once.
    rows = labelled.select(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(params.seed)).alias("key"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("text is not null and lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, by, least = np.zeros(params.features, np.int64), {}, {}
        for batch in batches:
            names, keys = batch.column("lang").to_pylist(), batch.column("key").to_numpy()
            new: dict[str, list[int]] = {}
            for begin, texts in text_pieces(batch, "text"):
                for k, text in enumerate(texts, begin):
                    if (g := grams(text, params)) is not None:
                        found[g[0]] += 1
                        new.setdefault(names[k], []).append(k)
            for name, at in new.items():
                by[name] = by.get(name, 0) + len(at)
                least[name] = np.union1d(least.get(name, keys[:0]), keys[at])[: params.sample_per_language]
        at = np.flatnonzero(found)
        rows = [(None, None, int(j), int(found[j])) for j in at] + [(name, None, None, n) for name, n in by.items()] + [(name, int(key), None, 0) for name, some in least.items() for key in some]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["lang", "key", "at", "n"])

    counted = cut(rows.mapInArrow(sparing(count), "lang string, key long, at long, n long"))
    total = counted.where("key is null").groupBy("lang", "at").agg(F.sum("n").alias("n")).collect()
    frequency, by = np.zeros(params.features), {}
    for lang, at, n in total:
        if lang is None:
            frequency[at] = n
        else:
            by[lang] = n
    if not by:
        return None
    idf = np.log((1 + sum(by.values())) / (1 + frequency)) + 1

    ranked = counted.where("key is not null").select("lang", "key").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key")))
    last = ranked.where(F.col("rank") <= params.sample_per_language).groupBy("lang").agg(F.max("key").alias("last"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()  # of at most sample_per_language keys of each language
        for batch in batches:
            keys, names = batch.column("key").to_pylist(), batch.column("lang").to_pylist()
            for begin, texts in text_pieces(batch, "text"):
                got = []
                for k, name, text in zip(keys[begin:], names[begin:], texts, strict=False):
                    if (name, k) not in seen and (g := grams(text, params)) is not None:
                        seen.add((name, k))
                        got.append((k, name, *g))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2].astype("<i4").tobytes() for g in got], pa.binary()), pa.array([g[3].astype("<i4").tobytes() for g in got], pa.binary())],
                    names=["key", "lang", "at", "counts"],
                )

    drawn = rows.join(F.broadcast(cut(last)), "lang").where(F.col("key") <= F.col("last")).select("key", "lang", "text")
    sample = drawn.mapInArrow(sparing(gather), "key long, lang string, at binary, counts binary").dropDuplicates(["lang", "key"]).collect()
    return train([(k, lang, np.frombuffer(at, "<i4").astype(np.int64), np.frombuffer(c, "<i4").astype(np.int64)) for k, lang, at, c in sample], idf, params)


def predict_text(model: Model | None, text: str | None) -> tuple[str, float]:
    if model is None or not text or (g := grams(text, model.params)) is None:
        return UNDETERMINED, 0.0
    z = weighed(*g, model.idf) @ model.weights[g[0]] + model.bias
    p = softmax(np.asarray(z, np.float64) / model.temperature)
    k = int(np.argmax(p))
    return model.languages[k], float(p[k])


def predict(df: DataFrame, model: Model | None, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None), then lang_pred and score, for every row of ``df``."""
    lean(df.sparkSession)
    keep = keep if keep is not None else others(df, "lang_pred", "score")
    names = df.select(*keep).columns
    picked = df.select(*[c.alias(f"c{k}") for k, c in enumerate(keep)], F.col(f"`{text_col}`").alias("text_in"))
    shared = df.sparkSession.sparkContext.broadcast(model)
    inner = picked.drop("text_in").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text_in")
            found = [predict_text(shared.value, t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(names))], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*inner.names, "lang_pred", "score"])

    out = picked.mapInArrow(sparing(run), T.StructType([*inner.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return out.toDF(*names, "lang_pred", "score")
