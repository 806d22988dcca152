"""A Merkle manifest of a table, built and proved by supersteps over RDDs.

Rows are the leaves, hashed by column functions, so only digests leave the scan. They are
sorted by group and order over ranges of rows (a group may span many tasks), and each
task numbers its own rows from one summary line per task. Then, upward: every node sends
(slot, digest) to its parent; a parent that has all its children hashes them and sends on,
until one node of a group is left, the subroot. The subroots are the leaves of one more
such tree. Downward, from the root: every node sends its children's run with its own path
to its children, so that each run of leaves gets one message with the siblings of all
levels, against which its leaves are folded. A message has at most ``ARITY`` digests a
level; the driver holds a line for each task and the root.

Defined results: nulls in a field count as ``-``; a null group is a group, and the first;
rows of null order come first in their group, rows of equal order are taken by their leaf
digests; rows that repeat all fields are leaves each. An empty table gives no rows and has
no root. Other columns of the table take no part, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotwright.llm.common import checkpoint_dir, cut, partitions_for

ARITY = 16
#: Rows of digests of a task.
ROWS = 100_000
#: (group, index): groups are numbered in their order.
Key = tuple[int, int]
#: Slot in a run, and the digests of the run: one entry for each level, from the leaf up.
Path = tuple[tuple[int, bytes], ...]
#: The group of the tree over the subroots.
TOP = -1


def encoded(fields: Sequence[Column]) -> Column:
    """The fields one after the other: ``-`` if null, else the count of UTF-8 bytes, ``:`` and the value."""
    text = [f.cast("string") for f in fields]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def digest(fields: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.encode(encoded(fields), "UTF-8"), 256))


def joined(run: bytes) -> bytes:
    """The hash of a run of digests: of their hex texts, one after the other."""
    return hashlib.sha256(run.hex().encode()).digest()


def folded(leaf: bytes, path: Path) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for slot, run in path:
        leaf = joined(run[: 32 * slot] + leaf + run[32 * slot + 32 :])
    return leaf


def siblings(path: Path) -> bytes:
    return b"".join(run[: 32 * slot] + run[32 * slot + 32 :] for slot, run in path)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (sorted by ``g_`` over the tasks in order) with group_ and index_ of each leaf, and whether it is the last of its group.

    Tasks tell the driver their first and last group, how many groups and rows they have and how many rows are
    of the last group; so groups that span tasks are known, and each task then streams its rows.
    """
    line = "p int, n long, first binary, last binary, tail long, groups long"

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, tail, groups, first, last = 0, 0, 0, None, None
        for b in batches:
            for g in b.column("g_").to_pylist():
                if n == 0:
                    first = g
                if n == 0 or g != last:
                    tail, groups, last = 0, groups + 1, g
                tail, n = tail + 1, n + 1
        if n:
            yield pa.RecordBatch.from_pydict({"p": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([n]), "first": pa.array([first], pa.binary()), "last": pa.array([last], pa.binary()), "tail": pa.array([tail]), "groups": pa.array([groups])})

    lines = sorted(rows.select("g_").mapInArrow(ends, line).collect())
    start: dict[int, tuple[int, int, bool]] = {}  # of each task: its first row's group and index, and whether its last row ends a group
    group, index = -1, 0
    for k, x in enumerate(lines):
        if k == 0 or x.first != lines[k - 1].last:
            group, index = group + 1, 0
        start[x.p] = (group, index, k + 1 == len(lines) or lines[k + 1].first != x.last)
        index = x.tail if x.groups > 1 else index + x.n
        group += x.groups - 1
    shared = rows.sparkSession.sparkContext.broadcast(start)
    fields = [f for f in rows.schema if f.name != "g_"]
    schema = T.StructType([*fields, T.StructField("group_", T.LongType()), T.StructField("index_", T.LongType()), T.StructField("last_", T.BooleanType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, index, closes = shared.value.get(TaskContext.get().partitionId(), (0, 0, True))
        before, held = None, None

        def out(b: pa.RecordBatch, after: bytes | None, final: bool) -> pa.RecordBatch:
            nonlocal group, index, before
            names = b.column("g_").to_pylist()
            groups, indexes, lasts = [], [], []
            for k, g in enumerate(names):
                if before is not None and g != before:
                    group, index = group + 1, 0
                groups.append(group)
                indexes.append(index)
                lasts.append(names[k + 1] != g if k + 1 < len(names) else closes if final else after != g)
                before, index = g, index + 1
            return pa.RecordBatch.from_arrays([*[b.column(f.name) for f in fields], pa.array(groups, pa.int64()), pa.array(indexes, pa.int64()), pa.array(lasts, pa.bool_())], names=schema.names)

        for b in batches:
            if b.num_rows:
                if held is not None:
                    yield out(held, b.column("g_")[0].as_py(), False)
                held = b
        if held is not None:
            yield out(held, None, True)

    return rows.mapInArrow(number, schema)


def height(leaves: int) -> int:
    """Levels of runs above so many leaves, one node left."""
    n = 0
    while ARITY**n < leaves:
        n += 1
    return n


def climb(nodes: RDD, levels: int, tasks: int) -> tuple[list[RDD], list[RDD]]:
    """Upward supersteps from ``nodes``, (key, (digest, last)), until the largest group of ``levels`` has one node.

    Returns the runs of each level, (parent's key, (digests of the run, last)), and of each level the groups' roots, (group, digest).
    Each superstep is a shuffle of a sixteenth of the one below; what an executor loses is made again from the leaves.
    """
    roots, runs = [], []
    for level in range(levels + 1):
        roots.append(nodes.filter(lambda x: x[0][1] == 0 and x[1][1]).map(lambda x: (x[0][0], x[1][0])))
        if level == levels:
            break
        tasks = max(1, tasks // ARITY) if level else tasks

        def send(some: Iterable) -> Iterator[tuple[Key, tuple[int, bytes, bool]]]:
            for (group, index), (value, last) in some:
                if index or not last:
                    yield (group, index // ARITY), (index % ARITY, value, last)

        def complete(x: tuple) -> tuple[Key, tuple[bytes, bool]]:
            key, children = x
            children.sort()
            slots, last = [c[0] for c in children], children[-1][2]
            if slots != list(range(len(slots) if last else ARITY)):
                raise ValueError(f"parent {key} lacks children: {slots}")
            return key, (b"".join(c[1] for c in children), last)

        runs.append(nodes.mapPartitions(send).combineByKey(lambda v: [v], lambda a, v: [*a, v], lambda a, b: a + b, tasks).map(complete))
        nodes = runs[-1].mapValues(lambda v: (joined(v[0]), v[1]))
    return runs, roots


def descend(runs: list[RDD], tops: RDD) -> RDD:
    """Downward supersteps: (key of a run of leaves, (its digests, path above it)); a lone leaf's run is empty. ``tops``: (group, (level, path above the group's root))."""
    own = lambda level: tops.filter(lambda x: x[1][0] == level).map(lambda x: ((x[0], 0), x[1][1]))
    paths = own(len(runs))
    for level in range(len(runs) - 1, -1, -1):
        met = paths.join(runs[level].mapValues(lambda v: v[0]), runs[level].getNumPartitions())
        if level == 0:
            return met.mapValues(lambda v: (v[1], v[0])).union(own(0).mapValues(lambda path: (b"", path)))

        def send(x: tuple) -> Iterator[tuple[Key, Path]]:
            (group, index), (path, run) = x
            for slot in range(len(run) // 32):
                yield (group, index * ARITY + slot), ((slot, run), *path)

        paths = met.flatMap(send).union(own(level))
    return paths.mapValues(lambda path: (b"", path))


def manifest(df: DataFrame, fields: Sequence[str], order: str, group: str, seen: Sequence[Column] | None = None, proofs: bool = False, rows_per_task: int = ROWS) -> DataFrame:
    """(order, leaf, subroot, root, proof_sha256, folded_root, verified), digests as hex, for every row of ``df``.

    ``fields`` are hashed into the leaf. ``seen`` are the same fields as they are found at verification (those of ``df``, if None):
    they are hashed anew and folded with the manifest's siblings. ``proofs`` adds the siblings themselves, ``proof`` array<string>.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    g, o = F.col(f"`{group}`").cast("string"), F.col(f"`{order}`")
    whole = [F.col(f"`{f}`") for f in fields]
    rows = df.select(F.concat(F.when(g.isNull(), F.lit(b"\x00")).otherwise(F.lit(b"\x01")), F.coalesce(F.encode(g, "UTF-8"), F.lit(b""))).alias("g_"), o.alias("order_"), digest(whole).alias("leaf"), digest(list(seen) if seen is not None else whole).alias("seen"))
    kind = rows.schema["order_"].dataType
    rows = cut(rows)
    tasks = partitions_for(rows.count(), rows_per_task, spark.sparkContext.defaultParallelism)
    placed = rows.withColumn("tie_", F.monotonically_increasing_id()).repartitionByRange(tasks, "g_", "order_", "leaf", "tie_").sortWithinPartitions("g_", "order_", "leaf", "tie_").drop("tie_")
    leaves = cut(numbered(cut(placed)))
    names = ["order_", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["proof"] * proofs
    types = [kind, *[T.StringType()] * 5, T.BooleanType()] + [T.ArrayType(T.StringType())] * proofs
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)])

    most, groups = leaves.agg(F.max("index_") + 1, F.max("group_") + 1).first()
    if not groups:
        return spark.createDataFrame([], schema).withColumnRenamed("order_", order)
    nodes = leaves.select("group_", "index_", "leaf", "last_").rdd.map(lambda r: ((r[0], r[1]), (bytes(r[2]), r[3])))
    runs, roots = climb(nodes, height(most), tasks)
    depth, above_tasks = height(groups), partitions_for(groups, rows_per_task)
    subroots = spark.sparkContext.union(roots)
    tops, top = climb(subroots.map(lambda x: ((TOP, x[0]), (x[1], x[0] == groups - 1))), depth, above_tasks)
    ((_, root),) = top[-1].collect()
    above = descend(tops, spark.sparkContext.parallelize([(TOP, (depth, ()))], 1))

    def unfold(x: tuple) -> Iterator[tuple[int, Path]]:
        (_, index), (run, path) = x
        if not run:
            yield 0, path
        for slot in range(len(run) // 32):
            yield index * ARITY + slot, ((slot, run), *path)

    levels = leaves.where("last_").select("group_", "index_").rdd.map(lambda r: (r[0], height(r[1] + 1)))
    placed_tops = levels.join(above.flatMap(unfold), above_tasks)
    messages = descend(runs, placed_tops)

    def verify(x: tuple) -> Iterator[tuple]:
        _, (own, sent) = x
        (run, above_), *_more = sent
        for slot, order_, leaf, found in own:
            path = ((slot, run), *above_) if run else above_
            sub = folded(leaf, path[: len(path) - depth])
            end, sibs = folded(found, path), siblings(path)
            more = ([sibs[k : k + 32].hex() for k in range(0, len(sibs), 32)],) if proofs else ()
            yield order_, leaf.hex(), sub.hex(), root.hex(), hashlib.sha256(sibs.hex().encode()).hexdigest(), end.hex(), end == root, *more

    mine = leaves.select("group_", "index_", "order_", "leaf", "seen").rdd.map(lambda r: ((r[0], r[1] // ARITY), (r[1] % ARITY, r[2], bytes(r[3]), bytes(r[4]))))
    out = mine.cogroup(messages, tasks).flatMap(verify)
    return spark.createDataFrame(out, schema, verifySchema=False).withColumnRenamed("order_", order)


def brute_force(rows: Sequence[tuple], tampered: Sequence[tuple]) -> list[tuple]:
    """(position, leaf, subroot, root, proof_sha256, folded_root, verified) for rows of (group, order, fields) without ties, by plain recursion; for tests."""
    h = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    leaf = lambda fields: h("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields)

    def levels(nodes: list[str]) -> list[list[str]]:
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(out[-1][a : a + ARITY]) for a in range(0, len(out[-1]), ARITY)])
        return out

    names = sorted({r[0] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    order = {g: sorted((k for k, r in enumerate(rows) if r[0] == g), key=lambda k: rows[k][1]) for g in names}
    trees = {g: levels([leaf(rows[k][2]) for k in order[g]]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for j, g in enumerate(names):
        for i, k in enumerate(order[g]):
            proof, value = [], leaf(tampered[k][2])
            for tree, at in ((trees[g], i), (top, j)):
                for level in tree[:-1]:
                    run = list(level[at // ARITY * ARITY : at // ARITY * ARITY + ARITY])
                    proof += run[: at % ARITY] + run[at % ARITY + 1 :]
                    run[at % ARITY] = value
                    value, at = h(run), at // ARITY
            out.append((k, trees[g][0][i], trees[g][-1][0], top[-1][0], h(proof), value, value == top[-1][0]))
    return out
