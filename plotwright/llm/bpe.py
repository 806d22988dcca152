"""Byte-level BPE: text to ids and back, without regular expressions.

Texts are split as the published pattern of the vocabulary splits them, by array
operations: each code point gets a class, each class stands for a function from
states to states, and the functions are composed by a scan in blocks (composition
is associative, so a block's function needs no earlier block). The slices between
boundaries are merged by rank once per distinct slice and cached; offsets of the
slices and of the tokens are kept, so that ids decode to bytes with known places.

Defined results: null and empty texts have no tokens; any text, however long or
repetitive, is encoded whole; ties and repeated rows are encoded alike; other
columns of the input are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plotwright.llm.common import codepoints, lean, sparing, splitmix, text_pieces

# The characters with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The contractions that the pattern splits off, without their apostrophe.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

# Classes of code points, after a look at what follows.
LETTER, NUMBER, OTHER, JOIN, LAST, SPACE, SHORT, LONG = range(8)
# States: what the code point before belongs to. CUT: a token just ended. ONE, TWO: so many letters of a contraction are due.
CUT, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINED, IN_SPACES, ONE, TWO = range(8)

#: Bytes that the slices remembered in a task may take, in each of two generations; beyond it the older one goes. It bounds memory, not results.
CACHE_BYTES = 20 << 20
#: What a remembered slice takes besides its own bytes and those of its ids.
ENTRY_BYTES = 180
#: Slices over so many bytes are merged but not remembered.
CACHED_BYTES = 64


@functools.cache
def class_table() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


@functools.cache
def machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, token begins here), each by state and class; classes from 8 on are the same at the start of a text."""
    step, begins = np.zeros((8, 16), np.uint8), np.zeros((8, 16), bool)
    after = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, JOIN: JOINED, LAST: CUT, SPACE: IN_SPACES}
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SPACE: IN_SPACES}
    for state in range(8):
        for kind in range(8):
            if state in (ONE, TWO):
                new, first = (CUT if state == ONE else ONE), False
            elif kind in (SHORT, LONG):
                if state in (IN_OTHERS, JOINED):
                    new, first = IN_OTHERS, False
                else:
                    new, first = (ONE if kind == SHORT else TWO), True
            else:
                first = not (state == JOINED and kind in (LETTER, NUMBER, OTHER) or run.get(kind) == state)
                new = after[kind]
            step[state, kind], begins[state, kind] = new, first
    step[:, 8:], begins[:, 8:] = step[CUT, :8], True
    return step, begins


@functools.cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions that classes generate by composition: (id of each class, table of compositions, values by id and state)."""
    step, _ = machine()
    found: dict[bytes, int] = {bytes(range(8)): 0}
    queue = [bytes(range(8))]
    generators = [step[:, k].tobytes() for k in range(16)]
    for f in queue:
        for g in generators:
            h = bytes(g[s] for s in f)
            if h not in found:
                found[h] = len(found)
                queue.append(h)
    values = np.array([list(f) for f in queue], np.uint8)
    compose = np.array([[found[bytes(g[s] for s in f)] for g in queue] for f in queue], np.uint16)
    return np.array([found[g] for g in generators], np.uint16), compose, values


def classes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of each code point of texts laid end to end, those at ``starts`` raised by 8."""
    n = len(points)
    kind = class_table()[points]
    last = np.zeros(n + 1, bool)  # the last code point of a text
    last[starts[1:] - 1] = True
    last[n - 1] = True
    space = kind == SPACE
    follows = np.zeros(n, bool)  # something other than white space follows in the same text
    follows[:-1] = ~space[1:]
    follows &= ~last[:n]
    out = kind.copy()
    out[space & follows] = LAST
    out[space & follows & (points == 0x20)] = JOIN
    at = np.flatnonzero(points == 0x27)
    if len(at):
        pad = np.concatenate([points, np.zeros(2, points.dtype)])
        one = ~last[at]
        two = one & ~last[np.minimum(at + 1, n)]
        for word in CONTRACTIONS:
            if len(word) == 1:
                out[at[one & (pad[at + 1] == ord(word))]] = SHORT
            else:
                out[at[two & (pad[at + 1] == ord(word[0])) & (pad[at + 2] == ord(word[1]))]] = LONG
    out[starts] += 8
    return out


def boundaries(points: np.ndarray, starts: np.ndarray, block: int = 512) -> np.ndarray:
    """Where tokens of the pattern begin, as a mask; ``starts``: first code points of the texts that are not empty."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = classes(points, starts)
    ids, compose, values = monoid()
    _, begins = machine()
    rows = -(-n // block)
    functions = np.zeros(rows * block, np.uint16)
    functions[:n] = ids[kind]
    functions = np.ascontiguousarray(functions.reshape(rows, block).T)
    scan = np.empty_like(functions)  # scan[j]: composition of the first j functions of each block
    held = np.zeros(rows, np.uint16)
    width, flat = compose.shape[1], compose.ravel()
    for j in range(block):
        scan[j] = held
        held = flat[held.astype(np.intp) * width + functions[j]]
    # scan over blocks, doubling the reach
    reach = 1
    while reach < rows:
        held[reach:] = flat[held[:-reach].astype(np.intp) * width + held[reach:]]
        reach *= 2
    entry = np.zeros(rows, np.intp)
    entry[1:] = values[held[:-1], CUT]
    before = values.ravel()[scan.astype(np.intp) * 8 + entry[None, :]].T.ravel()[:n]
    return begins[before, kind]


@functools.cache
def vocabulary(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long slice: the adjacent pair of least rank joins first, the left one of equals.

    Pairs wait in a heap over a linked list, so n bytes take n log n steps.
    """
    n = len(piece)
    right, left, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := right[i]) >= n or end[j] != stop:
            continue
        end[i], alive[j] = stop, False
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        if (h := left[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = right[i]
    return out


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], laid end to end."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])]


def laid(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings laid end to end: (bytes, starts, sizes)."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes


def powers_anew(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


#: The longest table of powers that a worker keeps.
KEPT_POWERS = 1 << 19
kept_powers = functools.cache(powers_anew)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` powers of an odd number modulo 2**64, and of its inverse. One table of fixed size is kept; longer ones are made anew."""
    if n > KEPT_POWERS:
        return powers_anew(n)
    up, down = kept_powers(KEPT_POWERS)
    return up[:n], down[:n]


BYTE_VALUES = splitmix(np.arange(1, 257, dtype=np.uint64))


def safe_parts(text: str, most: int) -> list[str]:
    """A very long text cut before spaces that follow letters: the pattern always begins a token there."""
    out, begin = [], 0
    while len(text) - begin > most:
        at = begin + most
        while at > begin and not (text[at] == " " and class_table()[ord(text[at - 1])] == LETTER):
            at -= 1
        if at == begin:
            at = begin + most
            while at < len(text) and not (text[at] == " " and class_table()[ord(text[at - 1])] == LETTER):
                at += 1
        out.append(text[begin:at])
        begin = at
    return [*out, text[begin:]]


class Codec:
    """Encodes and decodes with one vocabulary; a worker keeps one."""

    def __init__(self, path: str):
        self.ranks = vocabulary(path)
        tokens = sorted(self.ranks.items(), key=lambda x: x[1])
        self.top = tokens[-1][1] + 1
        parts = [b""] * self.top
        for b, i in tokens:
            parts[i] = b
        self.bytes, self.byte_starts, self.byte_sizes = laid(parts)
        self.names, self.name_starts, self.name_sizes = laid([b"%d " % i for i in range(self.top)])
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {self.ranks[b[:k]] * self.top + self.ranks[b[k:]]: i for b, i in tokens for k in range(1, len(b)) if b[:k] in self.ranks and b[k:] in self.ranks}
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.forget()

    def forget(self) -> None:
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that two adjacent ids join to, or ``top``."""
        keys = a * self.top + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], self.top)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (as int32 bytes) of many slices: in each round every slice joins its pair of least rank, the left one of equals."""
        out: list[bytes] = [b""] * len(pieces)
        short = []
        for k, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(p) > CACHED_BYTES:
                out[k] = np.array(merge(p, self.ranks), "<i4").tobytes()
            else:
                short.append(k)
        if not short:
            return out
        data, starts, sizes = laid([pieces[k] for k in short])
        names = np.array(short)
        ids = self.single[data]
        rank = np.full(len(ids), self.top, np.int64)
        rank[:-1] = self.pair_rank(ids[:-1], ids[1:])
        rank[starts + sizes - 1] = self.top
        while True:
            least = np.minimum.reduceat(rank, starts)
            done = least == self.top
            if done.any():
                ended = np.flatnonzero(done)
                flat = ids.astype("<i4")
                for k, a, n in zip(names[ended].tolist(), starts[ended].tolist(), sizes[ended].tolist(), strict=True):
                    out[k] = flat[a : a + n].tobytes()
                keep = np.repeat(~done, sizes)
                ids, rank = ids[keep], rank[keep]
                names, sizes, least = names[~done], sizes[~done], least[~done]
                starts = np.cumsum(sizes) - sizes
                if not len(names):
                    return out
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            owner = np.repeat(np.arange(len(names)), sizes)[at]
            at = at[np.concatenate([[True], owner[1:] != owner[:-1]])]
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            rank[at] = np.where(at + 1 == starts + sizes - 1, self.top, 0)
            ids, rank = ids[keep], rank[keep]
            sizes = sizes - 1
            starts = np.cumsum(sizes) - sizes
            at = at - np.arange(len(at))
            inner = at[rank[at] == 0]
            rank[inner] = self.pair_rank(ids[inner], ids[inner + 1])
            before = at[at > starts] - 1
            rank[before] = self.pair_rank(ids[before], ids[before + 1])

    def slices(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """UTF-8 bytes of texts laid end to end, the byte offsets at which slices begin (the length last), and those at which texts begin."""
        whole = "".join(texts)
        points = codepoints(whole)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes) - sizes
        data = whole.encode("utf-8", "surrogatepass")
        first = np.flatnonzero(boundaries(points, begins[sizes > 0]))
        if len(data) == len(points):
            return data, np.append(first, len(data)), begins
        widths = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        places = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
        return data, places[np.append(first, len(points))], places[begins]

    def encode_flat(self, texts: list[str], most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts laid end to end, and where each text's ids begin, their number last."""
        if any(len(t) > most for t in texts):
            parts = [safe_parts(t, most) for t in texts]
            found = [self.encode_flat([p], len(p) + 1)[0] for x in parts for p in x]
            sizes = iter([len(x) for x in found])
            counts = [sum(next(sizes) for _ in x) for x in parts]
            return np.concatenate(found), np.concatenate([[0], np.cumsum(counts)])
        data, marks, begins = self.slices(texts)
        if len(marks) < 2:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        raw = np.frombuffer(data, np.uint8)
        up, down = powers(len(raw))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[raw] * up[: len(raw)])])
        keys = splitmix((sums[marks[1:]] - sums[marks[:-1]]) * down[marks[:-1]])
        _, at, back = np.unique(keys, return_index=True, return_inverse=True)
        pieces = [data[a:b] for a, b in zip(marks[at].tolist(), marks[at + 1].tolist(), strict=True)]
        # A key only proposes: slices whose bytes are not those of the key's first slice stand for themselves.
        lengths = np.diff(marks)
        alike = lengths[at][back] == lengths
        wrong = np.flatnonzero(ragged(raw, np.where(alike, marks[at][back], marks[:-1]), lengths) != raw)
        apart = np.union1d(np.flatnonzero(~alike), np.searchsorted(marks, wrong, side="right") - 1)
        own: dict[bytes, int] = {}
        for k in apart.tolist():
            back[k] = len(pieces) + own.setdefault(data[marks[k] : marks[k + 1]], len(own))
        pieces += own
        flat, starts, sizes = laid(self.cached(pieces))
        ids = ragged(flat.view("<i4"), (starts // 4)[back], (sizes // 4)[back])
        ends = np.concatenate([[0], np.cumsum((sizes // 4)[back])])
        return ids, np.append(ends[np.searchsorted(marks[:-1], begins)], ends[-1])

    def cached(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct slices; those met lately are remembered, in two generations."""
        recent, older = self.recent, self.older
        found = [recent.get(p) or older.get(p) for p in pieces]
        missing = [k for k, x in enumerate(found) if x is None]
        for k, ids in zip(missing, self.merge_all([pieces[k] for k in missing]), strict=True):
            found[k] = ids
        for p, x in zip(pieces, found, strict=True):
            if len(p) <= CACHED_BYTES and p not in recent:
                recent[p] = x
                self.held += len(p) + len(x) + ENTRY_BYTES
        if self.held > CACHE_BYTES:
            self.older, self.recent, self.held = recent, {}, 0
        return found

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, ends = self.encode_flat(texts)
        return [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        at = np.asarray(ids, np.int64)
        return ragged(self.bytes, self.byte_starts[at], self.byte_sizes[at]).tobytes()

    def offsets(self, ids: np.ndarray | list[int]) -> np.ndarray:
        """The byte at which each token begins, and the whole length last."""
        return np.concatenate([[0], np.cumsum(self.byte_sizes[np.asarray(ids, np.int64)])])

    def digests(self, texts: list[str]) -> tuple[list[int], list[str], list[str], list[int]]:
        """For each text: number of ids, SHA-256 of the ids in decimal, of the bytes that they decode to, and those bytes' number."""
        ids, ends = self.encode_flat(texts)
        ids = ids.astype(np.int64)
        names = memoryview(ragged(self.names, self.name_starts[ids], self.name_sizes[ids]))
        decoded = memoryview(ragged(self.bytes, self.byte_starts[ids], self.byte_sizes[ids]))
        name_ends = np.concatenate([[0], np.cumsum(self.name_sizes[ids])])[ends].tolist()
        byte_ends = np.concatenate([[0], np.cumsum(self.byte_sizes[ids])])[ends].tolist()
        hashed = [hashlib.sha256(names[a : max(a, b - 1)]).hexdigest() for a, b in zip(name_ends, name_ends[1:], strict=False)]
        back = [hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(byte_ends, byte_ends[1:], strict=False)]
        return np.diff(ends).tolist(), hashed, back, np.diff(byte_ends).tolist()


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, offsets array<long>): the tokens of each text and the byte offsets at which they begin, the whole length last."""
    picked = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            for begin, texts in text_pieces(batch, "text", 1_000_000):
                ids = tool.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(begin, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array([tool.offsets(x).tolist() for x in ids], pa.list_(pa.int64()))],
                    names=["id", "ids", "offsets"],
                )
        tool.forget()

    return picked.mapInArrow(sparing(run), "id long, ids array<int>, offsets array<long>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, data binary): the bytes that each array of ids stands for; null ids give empty bytes."""
    picked = df.select(df[id_col].cast("long").alias("id"), df[ids_col].alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([tool.decode(x or []) for x in part.column("ids").to_pylist()], pa.binary())], names=["id", "data"])

    return picked.mapInArrow(sparing(run), "id long, data binary").withColumnRenamed("id", id_col)


def digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, n_bytes): each whole text encoded, and its ids decoded again, in one pass without a shuffle."""
    lean(df.sparkSession)
    picked = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            for begin, texts in text_pieces(batch, "text", 500_000):
                counts, hashes, decoded, sizes = tool.digests(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(begin, len(texts)), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string()), pa.array(sizes, pa.int64())],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"],
                )
        tool.forget()

    return picked.mapInArrow(sparing(run), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long").withColumnRenamed("id", id_col)
