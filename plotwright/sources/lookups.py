"""Lookups under a rate limit as a data source: ``spark.read.format("lookups")``.

The addresses of a batch are dealt to several partitions. Time is cut into slots of ``interval`` seconds from a common
start; partition k of n may ask in slots k, k + n, k + 2n, ... only, so whatever runs at once, two requests are an interval
apart. What is left of a provider's quota is shared out too, to the call; shares that are left over when others are used
up are dealt again, until all addresses are answered or the quota is spent.
"""

from __future__ import annotations

import base64
import functools
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plotwright.schemas import GEOCODE_RESULT
from plotwright.sources.providers import Result
from plotwright.storage import settle

SCHEMA = ", ".join(["address_id long", "full_address string", *[f"{f.name} {f.dataType.simpleString()}" for f in GEOCODE_RESULT]])
#: The message of a result that was not asked for, as the provider's quota was spent.
USED_UP = "quota used up"


@dataclass(frozen=True)
class Clock:
    """Seconds since some start that all machines share, and a way to wait."""

    now: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep


@dataclass(frozen=True)
class Plan:
    """make: a chain of providers for a share of the quota; pace: what waits before each request, given the partition."""

    make: Callable[[int, Callable[[], None]], Callable[[str], Result]]
    interval: float
    clock: Clock


@dataclass
class Share(InputPartition):
    number: int
    parts: int
    quota: int
    asked: list


def slots(number: int, parts: int, interval: float, start: float, clock: Clock) -> Callable[[], None]:
    """Waits for the partition's next slot that has not begun; no slot is used twice."""
    last = -1

    def pace() -> None:
        nonlocal last
        if interval <= 0:
            return
        current = int((clock.now() - start) // interval)
        turn = max(last + 1, -(-(current + 1 - number) // parts), 0)
        last = turn
        wait = start + (number + turn * parts) * interval - clock.now()
        if wait > 0:
            clock.sleep(wait)

    return pace


class Lookups(DataSource):
    """Options: ``asked`` (JSON pairs of id and address), ``plan`` (a pickled ``Plan``), ``parts``, ``quota``, ``start``."""

    @classmethod
    def name(cls) -> str:
        return "lookups"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LookupReader(self.options)


class LookupReader(DataSourceReader):
    def __init__(self, options: dict):
        self.plan, self.start = options["plan"], float(options["start"])
        self.parts, self.quota = int(options["parts"]), int(options["quota"])
        self.asked = json.loads(options["asked"])

    def partitions(self) -> list[Share]:
        n = max(1, min(self.parts, len(self.asked)))
        return [Share(k, n, self.quota // n + (k < self.quota % n), self.asked[k::n]) for k in range(n)]

    def read(self, partition: Share) -> Iterator[tuple]:
        plan: Plan = cloudpickle.loads(base64.b64decode(self.plan))
        ask = plan.make(partition.quota, slots(partition.number, partition.parts, plan.interval, self.start, plan.clock))
        names = [f.name for f in GEOCODE_RESULT]
        for id_, address in partition.asked:
            row = ask(address).row()
            yield (id_, address, *[row[n] for n in names])


def paced(primary, fallback, share: int, pace: Callable[[], None]) -> Callable[[str], Result]:
    """Asks ``primary``, then ``fallback`` while the share lasts, each request in a slot of its own."""
    left = share

    def ask(address: str) -> Result:
        nonlocal left
        pace()
        first = primary.geocode(address)
        if first.success or fallback is None:
            return first
        if left <= 0:
            return Result(False, source=fallback.name, message=USED_UP)
        left -= 1
        pace()
        return fallback.geocode(address)

    return ask


def answers(part: DataFrame, primary, fallback, left: int, api: str = "HERE", parts: int = 8, interval: float = 1.1, clock: Clock = Clock()) -> DataFrame:
    """The answers for a batch (address_id, full_address), which is small: it goes to the tasks with the plan. At most ``left`` calls of ``fallback``.

    ``primary`` and ``fallback`` should not wait by themselves. Addresses that a share did not suffice for are asked for again while other shares have calls left.
    """
    spark = part.sparkSession
    spark.dataSource.register(Lookups)
    plan = base64.b64encode(cloudpickle.dumps(Plan(functools.partial(paced, primary, fallback), interval, clock))).decode()
    rows = [(r["address_id"], r["full_address"]) for r in part.orderBy("address_id").collect()]
    over = F.coalesce(F.col("message") == USED_UP, F.lit(False))
    kept: DataFrame | None = None
    while True:
        options = {"asked": json.dumps(rows), "plan": plan, "parts": str(parts), "quota": str(left), "start": repr(clock.now())}
        found = settle(spark.read.format("lookups").options(**options).load())
        calls, late = found.agg(F.count_if((F.col("source") == api) & ~over), F.count_if(over)).first()
        left -= calls
        again = late > 0 and left > 0
        new = found.where(~over) if again else found
        kept = new if kept is None else kept.unionByName(new)
        if not again:
            return kept
        rows = [(r["address_id"], r["full_address"]) for r in found.where(over).orderBy("address_id").collect()]
