"""Near-duplicate documents by ProbMinHash.

Words are runs of letters, digits and marks in lower case; a text's shingles are its runs
of five words (a shorter text is one shingle), weighted by 1 + ln(count). Every shingle is
a Poisson process of that rate: its arrivals, drawn from its hash, claim random registers,
a register keeps the earliest, and a process ends once its next arrival is later than all
registers hold. Two texts agree in a register with probability equal to the probability
Jaccard similarity of their weighted shingles. The registers are banded; texts that share
a band are candidates, and a candidate is a link if the exact Jaccard similarity of the
shingle sets is ``least`` or more. Where a text repeats shingles, weights part the two
measures; such a text is banded a second time with all weights 1 (in a text without repeats
both are one). So every pair of set similarity 0.8 has 24 bands of 4 that agree with that
probability, and escapes them all with probability 3e-6.

Copies (equal sequences of words) are one node from the start. In a band's bucket all
nodes meet the bucket's least one. In buckets that then still hold nodes of different
components, those outside the largest component are compared with each other and with it,
in blocks (within the largest one nothing is left to join): a group has two blocks of nodes
and their shingle sets, counts all their intersections by products of 0/1 matrices, and
returns no more links than join its components. So no group is expanded into rows of pairs,
memory is that of two blocks, and no link between components is lost. A set is sent once for
each block of nodes outside the largest component, so that a large group of near copies
costs its rows times the blocks of its stragglers; only a bucket full of texts that are not
alike costs the square of its blocks. Classes are the components.

Defined results: null and blank texts are classes of their own; texts without words but
with other signs are compared as wholes. The class id is the least id of its rows. Rows
that share an id are one node. Null ids take part as copies only.
"""

from __future__ import annotations

import functools
import hashlib
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwright.llm.common import codepoints, cut, sparing, splitmix, text_pieces
from plotwright.llm.graph import components

STEP = np.uint64(0x9E3779B97F4A7C15)
#: Ids of up to so many rows are broadcast (8 bytes each) to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Nodes of a block, and shingles of its nodes, at most (but one node at least).
BLOCK, BLOCK_SHINGLES = 1_024, 4_000_000


@dataclass(frozen=True)
class Params:
    words: int = 5
    least: float = 0.8
    bands: int = 24
    rows: int = 4

    @property
    def registers(self) -> int:
        return self.bands * self.rows


@functools.cache
def word_table() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] in "LNM" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


class WordHashes(dict):
    """64-bit hashes of words by their bytes, those met lately remembered. A task has one of its own, which goes with it."""

    MOST = 1 << 17

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return self[word]


def word_hashes(texts: list[str], known: WordHashes | None = None, part: int = 1 << 20) -> list[np.ndarray]:
    """The 64-bit hashes of each text's words, in order. A text with signs but no word is one word."""
    known = WordHashes() if known is None else known
    low = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    whole = "".join(low)
    points = codepoints(whole)
    ends = np.cumsum(sizes)
    word = word_table()[points]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    begins = (ends - sizes)[sizes > 0]
    starts[begins] |= word[begins]
    after = np.ones(len(points) + 1, bool)
    after[:-1] = starts | ~word
    first = np.flatnonzero(starts)
    last = np.flatnonzero(word & after[1:]) + 1
    hashes = np.empty(len(first), np.uint64)
    for k in range(0, len(first), part):
        hashes[k : k + part] = [known[whole[a:b]] for a, b in zip(first[k : k + part].tolist(), last[k : k + part].tolist(), strict=True)]
    split = np.searchsorted(first, np.concatenate([ends - sizes, ends[-1:]]))
    out = [hashes[a:b] for a, b in zip(split, split[1:], strict=False)]
    for k, (x, t) in enumerate(zip(out, low, strict=True)):
        if not len(x) and (bare := t.strip()):
            out[k] = np.array([known[bare]], np.uint64)
    return out


def shingles(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes in order, their counts)."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        h = h * STEP + words[j : len(words) - n + 1 + j]
    return np.unique(splitmix(h), return_counts=True)


def registers(sets: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """The ProbMinHash registers (one row of ``m`` per set of shingles and counts, none of them empty): hash of the shingle that came first."""
    owner = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    h = np.concatenate([s[0] for s in sets])
    rate = 1 + np.log(np.concatenate([s[1] for s in sets]).astype(np.float64))
    time, kept = np.full(len(sets) * m, np.inf), np.zeros(len(sets) * m, np.uint64)
    latest = np.full(len(sets), np.inf)
    now, arrival = np.zeros(len(h)), 1
    while len(h):
        draw = splitmix(h + np.uint64(arrival * int(STEP) & 0xFFFFFFFFFFFFFFFF))
        now = now - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / rate
        going = now < latest[owner]  # early termination
        h, owner, rate, now, draw = h[going], owner[going], rate[going], now[going], draw[going]
        at = owner * m + (splitmix(draw) % np.uint64(m)).astype(np.int64)
        np.minimum.at(time, at, now)
        won = now == time[at]
        kept[at[won]] = h[won]
        open_ = np.unique(owner)
        latest[open_] = time.reshape(-1, m)[open_].max(axis=1)
        arrival += 1
    return kept.reshape(-1, m)


def band_keys(kept: np.ndarray, params: Params) -> np.ndarray:
    key = np.broadcast_to(np.arange(1, params.bands + 1, dtype=np.uint64), (len(kept), params.bands)).copy()
    parts = kept.reshape(len(kept), params.bands, params.rows)
    for j in range(params.rows):
        key = splitmix(key * STEP + parts[:, :, j])
    return key.view(np.int64)


def sketch(docs: DataFrame, params: Params) -> DataFrame:
    """(id, copy binary, n, bands array<long>): fingerprint of the words in order, number of shingles, and the different band keys; fingerprint and keys are null for blank texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for begin, texts in text_pieces(batch, "text", 400_000):
                words = word_hashes(texts, known)
                full = [k for k, w in enumerate(words) if len(w)]
                keys: list = [None] * len(words)
                sizes = [0] * len(words)
                if full:
                    sets = [shingles(words[k], params.words) for k in full]
                    for k, x, own in zip(full, band_keys(registers(sets, params.registers), params), sets, strict=True):
                        keys[k], sizes[k] = x, len(own[0])
                    repeats = [j for j, (_, counts) in enumerate(sets) if counts.max() > 1]
                    if repeats:
                        bare = [(sets[j][0], np.ones(len(sets[j][0]), np.int64)) for j in repeats]
                        for j, x in zip(repeats, band_keys(registers(bare, params.registers), params), strict=True):
                            keys[full[j]] = np.union1d(keys[full[j]], x)
                copies = [hashlib.blake2b(w.tobytes(), digest_size=16).digest() if len(w) else None for w in words]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(begin, len(texts)), pa.array(copies, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "copy", "n", "bands"])

    return docs.mapInArrow(sparing(run), "id long, copy binary, n int, bands array<long>")


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids``; texts move only where the ids are too many to broadcast."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def verified(docs: DataFrame, pairs: DataFrame, params: Params) -> DataFrame:
    """Those ``pairs`` (a, b) whose shingle sets are as similar as asked for."""
    pairs = cut(pairs)
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= params.least * max(len(x), len(y)) else 0
                keep.append(shared > 0 and shared >= params.least * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    held = shingle_sets(docs, ids, params)
    right = held.toDF("b", "y")
    left = held.toDF("a", "x")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(sparing(compare), "a long, b long").distinct()


def joining(ids: np.ndarray, components_: np.ndarray, sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, least: float, columns: int = 2_048) -> list[tuple[int, int]]:
    """Links between the nodes ``first`` and ``second`` (places), as many as join their components. All intersections are counted, exactly."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    shared = count[place] > 1
    owner, column = owner[shared], column[place[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(first), len(second)), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        low, high = np.searchsorted(column, (a, a + columns))
        dense = np.zeros((len(sets), columns), np.float32)
        dense[owner[low:high], column[low:high] - a] = 1
        both += dense[first] @ dense[second].T
    sizes = np.array([len(x) for x in sets], np.float64)
    near = both >= least * (sizes[first][:, None] + sizes[second][None, :] - both) - 1e-6
    near &= components_[first][:, None] != components_[second][None, :]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for i, j in zip(*np.nonzero(near), strict=True):
        x, y = root(int(components_[first[i]])), root(int(components_[second[j]]))
        if x != y:
            parent[x] = y
            out.append((int(ids[first[i]]), int(ids[second[j]])))
    return out


def linked_within(docs: DataFrame, rest: DataFrame, params: Params) -> DataFrame:
    """Links (a, b) that join the components met in each bucket of ``rest`` (bucket, id, c, main, m_blocks, o_blocks): main tells the nodes of the largest component, dealt into m_blocks, from the others, dealt into o_blocks."""
    held = shingle_sets(docs, cut(rest.select("id").distinct()), params)
    own = F.pmod(F.xxhash64("id"), F.when(F.col("main"), F.col("m_blocks")).otherwise(F.col("o_blocks"))).cast("int")
    each = lambda n, pair: F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda x: F.struct(*[v.cast("int").alias(k) for k, v in zip("fij", pair(x), strict=True)]))
    mine = F.col("own")
    to = F.when(F.col("main"), each("o_blocks", lambda x: (F.lit(1), x, mine))).otherwise(F.concat(each("o_blocks", lambda x: (F.lit(0), F.least(mine, x), F.greatest(mine, x))), each("m_blocks", lambda x: (F.lit(1), mine, x))))
    rows = rest.withColumn("own", own).select("bucket", "id", "c", "main", "own", F.explode(to).alias("to")).select("bucket", "to.*", "id", "c", "main", "own").join(held, "id")
    keys = ["bucket", "f", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        found: list[tuple[int, int]] = []

        def close() -> None:
            if len(held) > 1:
                ids, comps, main, own = (np.array([x[k] for x in held]) for k in (1, 2, 3, 4))
                if (comps != comps[0]).any():
                    _, facing, i, j = held[0][0]
                    first, second = (~main, main) if facing else (own == i, own == j)
                    found.extend(joining(ids, comps, [x[5] for x in held], np.flatnonzero(first), np.flatnonzero(second), params.least))
            held.clear()

        for batch in batches:
            names = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
            for name, id_, c, main, mine, x in zip(names, *[batch.column(k).to_pylist() for k in ("id", "c", "main", "own")], batch.column("set"), strict=True):
                if held and held[0][0] != name:
                    close()
                held.append((name, id_, c, main, mine, np.frombuffer(x.as_py(), np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            found.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(sparing(run), "a long, b long")


def shingle_sets(docs: DataFrame, ids: DataFrame, params: Params) -> DataFrame:
    """(id, set binary) of the documents in ``ids``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for begin, texts in text_pieces(batch, "text", 400_000):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(begin, len(texts)), pa.array([shingles(w, params.words)[0].tobytes() for w in word_hashes(texts, known)], pa.binary())], names=["id", "set"])

    return among(docs, ids).mapInArrow(sparing(sets), "id long, set binary")


def classes(df: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_copies) for every row: its class, and how many rows have the same words in the same order."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = cut(sketch(docs, params))
    # Sums by a key are written before rows are joined with them: so Spark can split a frequent key's rows, as both sides are plain shuffles.
    nodes = cut(signed.where("copy is not null").groupBy("copy").agg(F.min("id").alias("node"), F.count("*").alias("n_copies")))
    bands = signed.join(nodes.select("copy", F.col("node").alias("id")), ["copy", "id"], "left_semi").select("id", "n", F.explode("bands").alias("bucket"))
    leaders = cut(bands.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("most")).where("leader != most").drop("most"))
    members = cut(bands.join(leaders, "bucket").where("id != leader"))
    links = cut(verified(docs, members.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), params))
    roots = cut(components(links))

    placed = members.join(roots.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", "n", F.coalesce("root", "id").alias("c"))
    sums = placed.groupBy("bucket", "c").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    mixed = sums.groupBy("bucket").agg(F.max(F.struct("rows", "c", "n")).alias("top"), F.sum("rows").alias("rows"), F.sum("n").alias("n")).where("rows > top.rows")
    blocks = lambda rows, n: F.greatest(F.ceil(rows / BLOCK), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    mixed = cut(mixed).select("bucket", F.col("top.c").alias("top_c"), blocks(F.col("top.rows"), F.col("top.n")).alias("m_blocks"), blocks(F.col("rows") - F.col("top.rows"), F.col("n") - F.col("top.n")).alias("o_blocks"))
    rest = cut(placed.join(mixed, "bucket").select("bucket", "id", "c", (F.col("c") == F.col("top_c")).alias("main"), "m_blocks", "o_blocks"))
    if rest.limit(1).count():
        links = cut(links.unionByName(linked_within(docs, rest, params)))
        roots = cut(components(links))
    found = signed.select("id", "copy").join(nodes, "copy", "left").join(roots, "node", "left")
    return found.select(F.col("id").alias(id_col), F.coalesce("root", "node", "id").alias("class_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))
