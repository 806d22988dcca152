"""Removal of repeated byte strings by suffix arrays.

Every byte covered by a string of ``least`` bytes that starts anywhere else in the corpus
goes. Two equal windows of ``least`` bytes have the same smallest ``gram``-byte hash, so
windows are dealt by that key, and only windows with equal keys need meet:

1. each text is cut into runs of neighbouring windows with one key (a run of n windows is
   a string of n + least - 1 bytes); a run is its key, a digest, and its place;
2. keys met once cannot repeat anything and are dropped; equal strings are counted, so a
   passage that a third of all texts share is one string from here on;
3. the different strings of a key are sorted by suffixes (two-stage) and neighbours'
   common prefixes show the windows that repeat. The different strings of keys that have
   more than ``most_bytes`` together go through these steps as texts of their own, with a
   longer gram, so that fewer windows share a key; with the longest, a key is a window,
   and equal strings are counted as ever. So equality is decided by suffix sorting for all
   strings that differ, but by two 64-bit hashes (key and digest, of whole strings; the digest
   modulo a prime, by two bases) for strings that are equal throughout, and for single windows of the longest gram;
4. the repeated windows, joined to maximal runs, go back to all places of their strings,
   and bytes are removed.

Texts are read, not shuffled, in step 1, and its runs are written once (a tenth to a half of
the texts' size); later only texts with candidates move.

Passages counted in words (``least_words``) go the same way: each word becomes ``UNIT``
bytes, hashes of the word and of what stands between it and the next, and the strings of
so many words are those of ``UNIT`` times as many such bytes that start at a word; in step 1
grams and windows are counted in words. A word is a run without white space; at the ends of
a passage ASCII signs around it do not count.

Defined results: null texts are empty; matches never cross texts; rows repeated whole are
different places. Lengths are bytes of UTF-8. Other columns pass through; those called as
the new ones (kept, n_bytes, n_removed, n_spans, n_passages) give way to them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotwright.llm.bpe import BYTE_VALUES, KEPT_POWERS, powers
from plotwright.llm.common import cut, others, sparing, splitmix
from plotwright.llm.suffix import repeated

ROW = ["id", "th"]
NEW = ["kept", "n_bytes", "n_removed", "n_spans", "n_passages"]
#: Keys of up to so many texts are broadcast (16 bytes each) to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes that stand for a word and the gap after it, and how many of them are the word's.
UNIT, OF_WORD = 8, 5
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
SIGN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Windows of one run at most; longer ones (periodic text) are several strings.
MOST_WINDOWS = 1_024


@dataclass(frozen=True)
class Params:
    least: int = 400
    #: Strings are of so many words, and come as units; 0: they are bytes.
    words: int = 0
    #: Each level halves the windows that can share a key (least - gram + 1), so a hot key is cut into few pieces at a time.
    grams: tuple[int, ...] = (128, 264, 333, 367, 384, 393, 397, 399, 400)
    #: Bytes of a key's different strings that are sorted at once, and of several keys' together (a key is never parted).
    most_bytes: int = 4_000_000
    batch_bytes: int = 1_000_000

    @property
    def gram(self) -> int:
        return min(self.grams[0], self.least)

    def finer(self) -> Params:
        return replace(self, words=0, grams=self.grams[1:] or (self.least,))

    @staticmethod
    def of_words(n: int) -> Params:
        """For strings of ``n`` words in ``UNIT`` bytes each, without the last gap; levels as above, the first of whole words."""
        least = n * UNIT - (UNIT - OF_WORD)
        grams = [max(1, least * 8 // 25)]
        while grams[-1] < least:
            grams.append(least + 1 - max(1, (least - grams[-1] + 1) // 2))
        return Params(least=least, words=n, grams=tuple(grams))


#: Sums of powers modulo 2**64 choose keys, where a collision costs work only. What tells strings equal is taken modulo a prime, by two bases.
PRIME = np.uint64((1 << 31) - 1)
BASES = (1_270_891_931, 1_947_207_353)


def mod(x: np.ndarray) -> np.ndarray:
    """``x`` modulo PRIME, for what is less than 2**63."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


def prime_powers_anew(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:  # twice as many at a time
        out[done : 2 * done] = mod(out[: min(done, n - done)] * np.uint64(step))
        done, step = 2 * done, step * step % int(PRIME)
    return out


kept_prime_powers = functools.cache(lambda base: prime_powers_anew(base, KEPT_POWERS))


def prime_powers(base: int, n: int) -> np.ndarray:
    return kept_prime_powers(base)[:n] if n <= KEPT_POWERS else prime_powers_anew(base, n)


class Digests:
    """64-bit digests of substrings of ``values`` (each less than 2**31): two polynomials modulo a prime, of 31 bits each, and the length mixed in.

    A substring's sum is brought to the beginning by the inverse power of its place, so that equal ones have equal digests wherever they stand.
    """

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        x = values.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for b in BASES:
            sums = np.zeros(self.n + 1, np.uint64)
            terms = x * prime_powers(b, self.n)
            # One fold leaves less than 2**32, of which 2**31 add up to less than 2**63.
            high = terms >> np.uint64(31)
            terms &= PRIME
            terms += high
            np.cumsum(terms, out=sums[1:])
            self.sums.append(sums)

    def of(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        low, high = (mod(mod(s[ends] - s[begins]) * prime_powers(pow(b, -1, int(PRIME)), self.n + 1)[begins]) for s, b in zip(self.sums, BASES, strict=True))
        return splitmix((high << np.uint64(31) | low) ^ splitmix((ends - begins).astype(np.uint64)))


def word_edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of the words, without signs around them; words of signs alone are whole."""
    inner = ~SPACE[raw]
    step = np.diff(np.concatenate([[0], inner.astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    bare = np.flatnonzero(~SIGN[raw])
    first, last = np.searchsorted(bare, begins), np.searchsorted(bare, ends) - 1
    some = first <= last
    padded = np.append(bare, 0)
    return np.where(some, padded[first], begins), np.where(some, padded[last] + 1, ends)


def units_between(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The units of words of a text, as a row of bytes each; the last has no gap after it."""
    digests = Digests(raw)
    some = lambda a, b: digests.of(a, b).view(np.uint8).reshape(-1, 8)
    units = np.zeros((len(begins), UNIT), np.uint8)
    units[:, :OF_WORD] = some(begins, ends)[:, :OF_WORD]
    units[:-1, OF_WORD:] = some(ends[:-1], begins[1:])[:, : UNIT - OF_WORD]
    return units


def words_of(data: bytes, part: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(begins, ends, units as bytes) of the words of a text, by parts; a part ends with a word whole, which starts the next part for the gap after it."""
    at, size = 0, part
    while at < len(data):
        stop = at + size
        while stop < len(data) and not SPACE[data[stop]]:
            stop += 1
        raw = np.frombuffer(data, np.uint8, min(stop, len(data)) - at, at)
        begins, ends = word_edges(raw)
        last = stop >= len(data)
        if len(begins) < 2 and not last:
            size *= 2
            continue
        if len(begins):
            units = units_between(raw, begins, ends)
            n = len(begins) if last else len(begins) - 1
            yield begins[:n] + at, ends[:n] + at, units[:n]
        if last:
            return
        at, size = at + int(begins[-1]), part


def units_of(data: bytes) -> bytes:
    """The units of all words of a text."""
    return b"".join(u.tobytes() for _, _, u in words_of(data))


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours, by prefixes and suffixes of blocks."""
    n = len(h)
    rows = -(-n // w)
    x = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    x[:n] = h
    x = x.reshape(rows, w)
    before = np.minimum.accumulate(x, axis=1).ravel()
    after = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


#: Bytes of short texts that are laid end to end and cut into runs at once; and windows of a long one.
GROUP, PART = 1 << 18, 1 << 20


def groups_of(texts: list[bytes], shared: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(numbers, places, pieces): texts laid together up to ``GROUP`` bytes; longer ones than ``PART`` in pieces that share ``shared`` bytes with the next."""
    numbers: list[int] = []
    places: list[int] = []
    pieces: list[bytes] = []
    held = 0
    for k, x in enumerate(texts):
        for at in range(0, max(1, len(x) - shared), PART):
            piece = x[at : at + PART + shared] if at or len(x) > PART + shared else x
            if held and held + len(piece) > GROUP:
                yield numbers, places, pieces
                numbers, places, pieces, held = [], [], [], 0
            numbers.append(k)
            places.append(at)
            pieces.append(piece)
            held += len(piece) + 1
    if pieces:
        yield numbers, places, pieces


def cut_runs(h: np.ndarray, w: int, begins: np.ndarray, stops: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, end, which text, whether the key is met twice within) of the runs of texts with the windows ``begins`` up to ``stops``; a window's key is the least of its ``w`` gram hashes."""
    key = sliding_least(h, w)
    change = np.zeros(len(key) + 1, bool)
    change[1:-1] = key[1:] != key[:-1]
    change[begins] = change[stops] = change[-1] = True
    at = np.flatnonzero(change)
    a, b = at[:-1], at[1:]
    text = np.searchsorted(begins, a, side="right") - 1
    own = (text >= 0) & (a < stops[text])
    a, b, text = a[own], b[own], text[own]
    pieces = -(-(b - a) // most)
    split = np.repeat(pieces > 1, pieces)
    if split.any():
        nth = np.arange(len(split)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        a, b, text = np.repeat(a, pieces) + nth * most, np.repeat(b, pieces), np.repeat(text, pieces)
        b = np.minimum(b, a + most)
    keys = key[a]
    met = [int(np.count_nonzero(h[i:j] == k)) > 1 for i, j, k in zip(a.tolist(), (b + (w - 1)).tolist(), keys, strict=True)]
    return keys, a, b, text, split | np.array(met, bool)


Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def runs_of(texts: list[bytes], params: Params) -> Iterator[Runs]:
    """(number of the text, key, digest, place, windows, whether the key is met twice within) of each run of some texts."""
    for numbers, places, pieces in groups_of(texts, params.least - 1):
        sizes = np.array([len(x) for x in pieces], np.int64)
        starts = np.cumsum(sizes) - sizes
        enough = sizes >= params.least
        if not enough.any():
            continue
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        up, down = powers(len(raw))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[raw] * up)])
        h = splitmix((sums[params.gram :] - sums[: -params.gram]) * down[: len(raw) - params.gram + 1])
        begins = starts[enough]
        key, a, b, text, twice = cut_runs(h, params.least - params.gram + 1, begins, begins + sizes[enough] - params.least + 1, MOST_WINDOWS)
        digest = Digests(raw).of(a, b + params.least - 1)
        yield np.array(numbers)[enough][text], key, digest, a - begins[text] + np.array(places)[enough][text], b - a, twice


def runs_of_words(texts: list[bytes], params: Params) -> Iterator[Runs]:
    """The same of windows of words that start at words: places and windows are counted in bytes of the units of the texts."""
    short = [(k, x) for k, x in enumerate(texts) if len(x) <= PART]
    for numbers, _, pieces in groups_of([x for _, x in short], 0):
        raw = np.frombuffer(b" ".join(pieces), np.uint8)
        starts = np.cumsum([0, *[len(x) + 1 for x in pieces[:-1]]])
        first, end = word_edges(raw)
        if len(first):
            owner = np.searchsorted(starts, first, side="right") - 1
            units = units_between(raw, first, end)
            units[:-1][owner[1:] != owner[:-1], OF_WORD:] = 0
            yield from runs_of_units(units, [short[k][0] for k in numbers], np.searchsorted(owner, np.arange(len(pieces) + 1)), params)
    for k, x in enumerate(texts):
        if len(x) > PART:
            units = np.frombuffer(units_of(x), np.uint8).reshape(-1, UNIT)
            yield from runs_of_units(units, [k], np.array([0, len(units)]), params)


def runs_of_units(units: np.ndarray, numbers: list[int], edges: np.ndarray, params: Params) -> Iterator[Runs]:
    """Runs of texts whose units stand between ``edges``."""
    enough = np.diff(edges) >= params.words
    if not enough.any():
        return
    unit = units.view("<u8").ravel()
    gram, up_down = max(1, params.gram // UNIT), powers(len(unit))
    up, down = up_down
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(splitmix(unit) * up)])
    last = (unit & np.uint64((1 << 8 * OF_WORD) - 1)) * np.uint64(0xD6E8FEB86659FD93)  # of a word without the gap after it
    n = len(unit) - gram + 1
    h = splitmix(((sums[gram - 1 : gram - 1 + n] - sums[:n]) * down[:n]) ^ last[gram - 1 :])
    begins, stops = edges[:-1][enough], edges[1:][enough] - params.words + 1
    key, a, b, text, twice = cut_runs(h, params.words - gram + 1, begins, stops, MOST_WINDOWS // UNIT)
    end = b + params.words - 2  # the last word of each run
    digest = splitmix(Digests(splitmix(unit) >> np.uint64(33)).of(a, end) ^ splitmix(last[end]))
    yield np.array(numbers)[enough][text], key, digest, (a - begins[text]) * UNIT, (b - a - 1) * UNIT + 1, twice


def runs(docs: DataFrame, params: Params) -> DataFrame:
    """(key, digest, id, th, place, n, twice) for the texts of ``docs`` (id, th, data), or for the units of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, key, digest, place, n, twice in (runs_of_words if params.words else runs_of)(batch.column("data").to_pylist(), params):
                at = pa.array(number)
                arrays = [pa.array(key.view(np.int64)), pa.array(digest.view(np.int64)), batch.column("id").take(at), batch.column("th").take(at), pa.array(place.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(twice)]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "digest", "id", "th", "place", "n", "twice"])

    long_enough = docs if params.words else docs.where(F.length("data") >= params.least)
    return long_enough.mapInArrow(sparing(run), "key long, digest long, id long, th long, place long, n int, twice boolean")


def pick(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join of ``docs`` by ROW; texts move only where the rows are too many to broadcast."""
    few = rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(rows) if few else rows, ROW, how)


def strings_of(docs: DataFrame, wanted: DataFrame, params: Params) -> DataFrame:
    """(key, digest, hot, string) for ``wanted`` (key, digest, hot, id, th, place, n)."""
    lists = cut(wanted.groupBy(*ROW).agg(F.collect_list(F.struct("key", "digest", "hot", "place", "n")).alias("runs")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, some in zip(batch.column("data"), batch.column("runs"), strict=True):
                data, some = data.as_py(), some.as_py()
                data = units_of(data) if params.words else data
                for a in range(0, len(some), 4096):
                    part = some[a : a + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x["key"] for x in part], pa.int64()), pa.array([x["digest"] for x in part], pa.int64()), pa.array([x["hot"] for x in part], pa.bool_()), pa.array([data[x["place"] : x["place"] + x["n"] + params.least - 1] for x in part], pa.binary())],
                        names=["key", "digest", "hot", "string"],
                    )

    return pick(docs, lists.select(*ROW), "left_semi").dropDuplicates(ROW).join(lists, ROW).select("data", "runs").mapInArrow(sparing(run), "key long, digest long, hot boolean, string binary")


def spans_by_sorting(strings: DataFrame, parts: int, params: Params) -> DataFrame:
    """(key, digest, low, high): runs of places of each string at which repeated windows start; a key's strings are in one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int] = []
        digests: list[int] = []
        texts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            found = [(k, d, a, b) for k, d, x in zip(keys, digests, repeated(texts, params.least) if texts else [], strict=True) for a, b in x]
            keys.clear(), digests.clear(), texts.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in range(4)], names=["key", "digest", "low", "high"])

        for batch in batches:
            for k, d, s in zip(batch.column("key").to_pylist(), batch.column("digest").to_pylist(), batch.column("string"), strict=True):
                if held > params.batch_bytes and k != keys[-1]:
                    yield flush()
                    held = 0
                keys.append(k)
                digests.append(d)
                texts.append(s.as_py())
                held += len(texts[-1])
        yield flush()

    return strings.select("key", "digest", "string").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(sparing(run), "key long, digest long, low long, high long")


def merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs (begin, end) of bytes covered by ``pairs``."""
    out: list[list[int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def joined(found: DataFrame) -> DataFrame:
    """``found`` (id, th, spans) with neighbouring and overlapping spans joined, so that a string has as few as it can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans_ = [[{"low": a, "high": b - 1} for a, b in merged([(x["low"], x["high"] + 1) for x in some])] for some in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(spans_, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))], names=["id", "th", "spans"])

    return found.mapInArrow(sparing(run), "id long, th long, spans array<struct<low: long, high: long>>")


def passages(data: bytes, spans: list[dict], n: int) -> list[tuple[int, int]]:
    """(begin, end) in bytes of the strings of ``n`` words that start at units in low..high; those that start at neighbouring words are one."""
    words = [x[:2] for x in words_of(data)]
    begins, ends = (np.concatenate([x[j] for x in words]) for j in (0, 1))
    first = [(-(-x["low"] // UNIT), x["high"] // UNIT + 1) for x in spans]
    return [(int(begins[a]), int(ends[min(b - 1 + n, len(ends)) - 1])) for a, b in merged([x for x in first if x[0] < x[1]])]


def spans(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(id, th, spans array<struct<low, high>>) of the texts of ``docs`` (id, th, data) that hold repeated windows; in bytes of their words' units, if ``params`` counts in words."""
    spark = docs.sparkSession
    every = cut(runs(docs, params))
    # Sums by key are written before rows are joined with them: so Spark can split a frequent key's rows, as both sides are plain shuffles.
    met = cut(every.groupBy("key").agg(F.count("*").alias("c"), F.max("twice").alias("t")).where("c > 1 or t").select("key"))
    places = cut(every.join(met, "key"))
    distinct = places.groupBy("key", "digest").agg(F.count("*").alias("c"), F.min(F.struct("id", "th", "place")).alias("one"), F.max("n").alias("n"), F.max("twice").alias("twice"))
    distinct = cut(distinct)
    width = F.col("n").cast("long") + (params.least - 1)
    of_key = cut(distinct.groupBy("key").agg(F.count("*").alias("nd"), F.sum(width).alias("bytes")))
    known = cut(distinct.join(of_key, "key").select("key", "digest", "c", "n", "one.id", "one.th", "one.place", (F.lit(params.gram < params.least) & (F.col("bytes") > params.most_bytes)).alias("hot"), ((F.col("nd") > 1) | (F.col("twice") & (F.col("c") == 1))).alias("sort"), width.alias("width")))
    wanted = known.where("sort")
    size, hot = wanted.agg(F.sum("width"), F.max("hot")).first()
    strings = strings_of(docs, wanted.select("key", "digest", "hot", "id", "th", "place", "n"), params)
    strings = cut(strings) if hot else strings
    parts = max(spark.sparkContext.defaultParallelism, int((size or 0) // 8_000_000) + 1)
    found = spans_by_sorting(strings.where("not hot"), parts, params)
    if hot:
        texts = strings.where("hot").select(F.col("key").alias("id"), F.col("digest").alias("th"), F.col("string").alias("data"))
        again = spans(texts, params.finer()).select(F.col("id").alias("key"), F.col("th").alias("digest"), F.inline("spans"))
        found = found.unionByName(again)
    copied = known.where("c > 1").select("key", "digest", F.lit(0).cast("long").alias("low"), (F.col("n") - 1).cast("long").alias("high"))
    lone = found.join(known.where("c > 1").select("key", "digest"), ["key", "digest"], "left_anti")
    at = cut(lone.unionByName(copied).groupBy("key", "digest").agg(F.collect_list(F.struct("low", "high")).alias("found")))
    back = places.select("key", "digest", *ROW, "place").join(at, ["key", "digest"]).select(*ROW, F.transform("found", lambda x: F.struct((x.low + F.col("place")).alias("low"), (x.high + F.col("place")).alias("high"))).alias("found"))
    return joined(back.groupBy(*ROW).agg(F.flatten(F.collect_list("found")).alias("spans")))


def keyed(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("data"), *more)


def removed(df: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", as_text: bool = False, least_words: int | None = None, remove_words: bool = True) -> DataFrame:
    """``df`` with kept (the bytes left), n_bytes, n_removed, n_spans and n_passages; texts without repeats never meet Python or a shuffle after step 1.

    ``least_words``: passages of so many words that start more than once are counted (maximal ones, else 0), however short, and go too if ``remove_words``. ``as_text``: kept is a string, without what is left of characters that were cut apart.
    """
    docs = keyed(df, id_col, text_col)
    found = cut(spans(docs, params))
    none = F.array().cast(found.schema["spans"].dataType)
    both = found.select(*ROW, "spans", none.alias("passages"))
    if least_words is not None:
        of_words = cut(spans(docs, Params.of_words(least_words)))
        both = cut(both.unionByName(of_words.select(*ROW, none.alias("spans"), F.col("spans").alias("passages"))).groupBy(*ROW).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "passages")]))
    found, least = both, params.least
    whole = keyed(df, id_col, text_col, F.struct(F.lit(0).alias("_"), *others(df, *NEW)).alias("row"))
    own = [F.col(f"row.`{c}`") for c in whole.schema["row"].dataType.names[1:]]
    zero = F.lit(0).cast("long")
    clean = pick(whole, found.select(*ROW), "left_anti").select(*own, F.col("data").cast("string" if as_text else "binary").alias("kept"), F.length("data").cast("long").alias("n_bytes"), *[zero.alias(c) for c in NEW[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, numbers = [], []
            for data, some, of_words in zip(batch.column("data"), batch.column("spans"), batch.column("passages"), strict=True):
                data, parts, at = data.as_py(), [], 0
                held = passages(data, of_words.as_py(), least_words) if len(of_words) else []
                cover = merged([(x["low"], x["high"] + least) for x in some.as_py()] + (held if remove_words else []))
                for a, b in cover:
                    parts.append(data[at:a])
                    at = b
                left = b"".join([*parts, data[at:]])
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
                numbers.append((len(data), len(data) - len(left), len(cover), len(held)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string() if as_text else pa.binary()), *[pa.array([x[j] for x in numbers], pa.int64()) for j in range(4)]], names=["row", *NEW])

    touched = pick(whole, found.select(*ROW), "left_semi").join(found, ROW).select("row", "data", "spans", "passages")
    schema = T.StructType([touched.schema["row"], T.StructField("kept", T.StringType() if as_text else T.BinaryType()), *[T.StructField(c, T.LongType()) for c in NEW[1:]]])
    return clean.unionByName(touched.mapInArrow(sparing(run), schema).select(*own, *NEW))
