"""Two-stage suffix sorting of many strings at once, with adjacent common prefixes.

A suffix is of type S if it is smaller than the suffix after it, else of type L. Only
those of type S are sorted directly; the L suffixes are induced by scanning the buckets
(by first byte) in order: a suffix already placed places its predecessor, if that is of
type L. Each string ends in a mark smaller than all bytes, and earlier marks are smaller.

Memory is some 45 bytes for each byte of the strings, and ``DIRECT_BYTES`` of suffixes
that are compared at once (or one group with the same ``HEAD`` first bytes, if larger).
"""

from __future__ import annotations

import numpy as np

#: Bytes of the suffixes that are made strings for one comparison sort.
DIRECT_BYTES = 8_000_000
#: First symbols by which the S suffixes are dealt before they are compared whole.
HEAD = 7
SYMBOLS = 257


def kinds(t: np.ndarray) -> np.ndarray:
    """True for S: the next different symbol is larger. The last symbol is a mark (0)."""
    n = len(t)
    at = np.full(n, n - 1, np.int32)
    differs = np.flatnonzero(t[1:] != t[:-1])
    at[differs] = differs + 1
    at = np.minimum.accumulate(at[::-1])[::-1]
    return t < t[at]


def sorted_directly(direct: np.ndarray, t: np.ndarray, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffixes at ``direct`` in order: by their first symbols, then whole, so many at a time as memory allows. ``data`` has a byte for each symbol of ``t``."""
    if not len(direct):
        return direct
    head, alive = np.zeros(len(direct), np.int64), np.ones(len(direct), bool)
    for j in range(HEAD):
        symbol = np.where(alive, t[np.minimum(direct + j, len(t) - 1)], 0)
        alive &= symbol > 0
        head = head * SYMBOLS + symbol
    order = np.argsort(head, kind="stable")
    direct, head = direct[order], head[order]
    owner = np.searchsorted(starts, direct, side="right") - 1
    end = (starts + sizes)[owner]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(head)) + 1, [len(head)]])
    used = np.concatenate([[0], np.cumsum(end - direct)])[edges]
    out, a = [], 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(used, used[a] + DIRECT_BYTES, side="right")) - 1)
        part, stop = direct[edges[a] : edges[b]], end[edges[a] : edges[b]]
        if len(part) > 1:
            suffixes = [data[p:q] for p, q in zip(part.tolist(), stop.tolist(), strict=True)]
            part = part[sorted(range(len(suffixes)), key=suffixes.__getitem__)]
        out.append(part)
        a = b
    return np.concatenate(out)


def suffix_order(strings: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, text, starts, sizes): places in ``text`` of the suffixes in order, of those with ``least`` bytes or more, and as many shorter ones as the induction needs.

    ``text`` holds the strings end to end, each with a mark 0; bytes are raised by 1.
    """
    sizes = np.array([len(s) for s in strings], np.int32)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int32)
    data = b"\0".join([*strings, b""])
    t = np.frombuffer(data, np.uint8).astype(np.int16)
    t += 1
    t[starts + sizes] = 0
    small = kinds(t)
    small &= t > 0
    # Of each string, up to the first S suffix (or its mark) from where fewer than ``least`` bytes are left.
    stop = np.arange(len(t), dtype=np.int32)
    stop[~small & (t > 0)] = len(t) - 1
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    last = np.where(sizes >= least, stop[np.minimum(starts + np.maximum(sizes - least, 0) + 1, starts + sizes)], starts - 1)
    del stop
    step = np.zeros(len(t) + 1, np.int8)
    np.add.at(step, starts, 1)
    np.add.at(step, last + 1, -1)
    wanted = np.cumsum(step[:-1], dtype=np.int8) > 0

    chosen = sorted_directly(np.flatnonzero(wanted & small).astype(np.int32), t, data, starts, sizes)
    bounds = np.searchsorted(t[chosen], np.arange(SYMBOLS + 1))

    first = np.zeros(len(t), bool)
    first[starts] = True
    pending: list[list[np.ndarray]] = [[] for _ in range(SYMBOLS + 1)]
    out = []
    for c in range(SYMBOLS):
        if c == 0:
            placed = np.flatnonzero(wanted & (t == 0)).astype(np.int32)
        else:
            level = np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int32)
            levels = []
            while len(level):
                levels.append(level)
                level = level[~first[level]] - 1
                level = level[t[level] == c]
            placed = np.concatenate([*levels, chosen[bounds[c] : bounds[c + 1]]])
            pending[c] = []
        if not len(placed):
            continue
        if c:
            out.append(placed)
        before = placed[~first[placed]] - 1
        symbols = t[before]
        larger = symbols > c
        before, symbols = before[larger], symbols[larger]
        order = np.argsort(symbols, kind="stable")
        before, symbols = before[order], symbols[order]
        edge = np.flatnonzero(np.diff(symbols)) + 1
        for part in np.split(before, edge) if len(before) else []:
            pending[int(t[part[0]])].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int32), t, starts, sizes


def common_prefixes(order: np.ndarray, t: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each suffix in ``order``, the length of the prefix that it shares with the one before it (0 for the first).

    Where the predecessors of both are neighbours too, the length is one less than theirs; only the others are compared.
    """
    n = len(order)
    if n < 2:
        return np.zeros(n, np.int32)
    before = np.full(len(t) + 1, -9, np.int32)
    before[order[1:]] = order[:-1]
    p = np.sort(order)
    q = before[p]
    del before
    end = np.repeat(starts + sizes, sizes + 1)
    raw = np.concatenate([t.astype(np.uint8), np.zeros(16, np.uint8)])  # bytes raised by 1, wrapping; lengths bound the comparison
    words = np.ndarray((len(t) + 8,), "<u8", raw.data, 0, (1,))
    follows = np.zeros(n, bool)
    follows[1:] = (p[1:] == p[:-1] + 1) & (q[1:] == q[:-1] + 1) & (q[1:] > 0) & (end[p[1:]] == end[p[:-1]]) & (end[np.maximum(q[1:], 0)] == end[np.maximum(q[:-1], 0)])
    follows &= (q >= 1) & (t[np.maximum(p - 1, 0)] == t[np.maximum(q - 1, 0)])
    length = np.zeros(n, np.int32)
    own = np.flatnonzero(~follows & (q >= 0))
    a, b = p[own], q[own]
    most = np.minimum(end[a] - a, end[b] - b)
    del end
    done, live = np.zeros(len(own), np.int32), np.arange(len(own))
    while len(live):
        x = words[a[live] + done[live]] ^ words[b[live] + done[live]]
        same = x == 0
        low = x & (~x + np.uint64(1))
        done[live] += np.where(same, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int32) // 8)
        live = live[same & (done[live] < most[live])]
    length[own] = np.minimum(done, most)
    place = np.arange(n, dtype=np.int32)
    base = np.maximum.accumulate(np.where(follows, 0, place))
    length = np.where(follows, length[base] - (place - base), length)
    at = np.zeros(len(t), np.int32)
    at[p] = length
    return at[order]


def repeated(strings: list[bytes], least: int) -> list[list[tuple[int, int]]]:
    """Of each string, the runs (first, last) of places at which ``least`` bytes start that also start elsewhere in the strings."""
    order, t, starts, sizes = suffix_order(strings, least)
    shared = common_prefixes(order, t, starts, sizes) >= least
    hit = shared.copy()
    hit[:-1] |= shared[1:]
    mask = np.zeros(len(t) + 1, np.int8)
    mask[order[hit]] = 1
    step = np.diff(mask, prepend=np.int8(0))
    begin, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1
    owner = np.searchsorted(starts, begin, side="right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    for k, a, b in zip(owner.tolist(), (begin - starts[owner]).tolist(), (stop - starts[owner]).tolist(), strict=True):
        out[k].append((a, b))
    return out
