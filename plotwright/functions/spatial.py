"""Places on a quadtree: tiles, and the space-filling order of their numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The finest level: 2**24 tiles a side, some two metres at the equator.
FINEST = 24
#: Steps that set the bits of a number apart by one: how far, and which bits stay.
SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def spread(x: Column) -> Column:
    for step, mask in SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, step)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def position(value: Column, low: float, width: float, zoom: int) -> Column:
    """The tile along one side; the far edge belongs to the last one."""
    n = 2**zoom
    return F.least(F.greatest(F.floor((value - low) / width * n), F.lit(0)), F.lit(n - 1)).cast("long")


def tile(latitude: Column, longitude: Column, zoom: int = FINEST) -> Column:
    """The number of a place's tile: its parents' are this one without the last two bits each. Null without a place."""
    return F.when(latitude.isNotNull() & longitude.isNotNull(), spread(position(longitude, -180.0, 360.0, zoom)).bitwiseOR(F.shiftleft(spread(position(latitude, -90.0, 180.0, zoom)), 1)))


def place(value: float, low: float, width: float, zoom: int) -> int:
    n = 2**zoom
    return min(max(int((value - low) / width * n // 1), 0), n - 1)


def number(x: int, y: int) -> int:
    out = 0
    for k in range(FINEST):
        out |= (x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1
    return out


def cover(latitudes: tuple[float, float], longitudes: tuple[float, float], most: int = 64, zoom: int = FINEST) -> list[tuple[int, int]]:
    """At most ``most`` ranges of tile numbers, edges included, that together hold every tile which meets the box.

    Tiles on the box's edge are divided, the largest first, as long as there may be more ranges; neighbouring ranges are joined.
    """
    xs = [place(v, -180.0, 360.0, zoom) for v in longitudes]
    ys = [place(v, -90.0, 180.0, zoom) for v in latitudes]
    whole, edge, done = [], [(0, 0, zoom)], []
    while edge:
        x, y, size = edge.pop(0)
        x1, y1 = x + (1 << size) - 1, y + (1 << size) - 1
        if x > xs[1] or x1 < xs[0] or y > ys[1] or y1 < ys[0]:
            continue
        inside = xs[0] <= x and x1 <= xs[1] and ys[0] <= y and y1 <= ys[1]
        if inside or size == 0:
            whole.append((x, y, size))
        elif len(whole) + len(edge) + 4 > most:
            done.append((x, y, size))
        else:
            half = 1 << size - 1
            edge += [(x + a, y + b, size - 1) for b in (0, half) for a in (0, half)]
    ranges: list[list[int]] = []
    for low, high in sorted((number(x, y), number(x, y) + (1 << 2 * size) - 1) for x, y, size in whole + done):
        if ranges and low <= ranges[-1][1] + 1:
            ranges[-1][1] = max(ranges[-1][1], high)
        else:
            ranges.append([low, high])
    return [(a, b) for a, b in ranges]
