import random
import zlib

import pytest
from pyspark.sql import functions as F

from plotwright.llm import merkle, queries

SMALL = "/root/testdata/sf0.001"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, Root string"


def lower(x):
    return x and "".join(c.lower() if "A" <= c <= "Z" else c for c in x)


def altered(row, picked):
    return (*row[:4], lower(row[4])) if picked else row


def brute(rows, picked):
    of = lambda r: (r[1], (r[0] is not None, r[0] or 0), r)
    return [(rows[x[0]][0], *x[1:]) for x in merkle.brute_force([of(r) for r in rows], [of(altered(r, picked(r[0]))) for r in rows])]


def got(spark, rows, picked, **more):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)
    seen = [F.when(picked, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text")) if c == "text" else F.col(c) for c in FIELDS]
    return merkle.manifest(df, FIELDS, "doc_id", "source", seen, **more)


@pytest.mark.parametrize("rows_per_task", [100_000, 7])
def test_manifest_matches_plain_recursion(spark, rows_per_task):
    rng = random.Random(3)
    sizes = {"big": 600, None: 17, "": 16, "a": 1, "é": 33, "z": 256, "\U0001f600": 2}
    rows = [(1000 * j + k, g, rng.choice(["en", None]), rng.choice([None, 5]), rng.choice(["Some Text Ä %d" % k, "", None, "plain"])) for j, (g, n) in enumerate(sizes.items()) for k in range(n)]
    rng.shuffle(rows)
    found = got(spark, rows, F.col("doc_id") % 3 == 0, rows_per_task=rows_per_task)
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute(rows, lambda i: i % 3 == 0))


def test_manifest_of_many_groups(spark):
    rows = [(k, f"s{k:04d}", "en", 1, f"T{k}") for k in range(300)]
    assert sorted(tuple(r) for r in got(spark, rows, F.col("doc_id") == 7, rows_per_task=50).collect()) == sorted(brute(rows, lambda i: i == 7))


def test_manifest_edges(spark):
    empty = got(spark, [(1, "a", "b", 2, "c")], F.lit(False)).schema
    df = spark.createDataFrame([], DOCS)
    assert merkle.manifest(df, FIELDS, "doc_id", "source").collect() == [] and merkle.manifest(df, FIELDS, "doc_id", "source").columns == empty.names
    lone = [(None, None, None, None, None)]
    assert [tuple(r) for r in got(spark, lone, F.lit(True)).collect()] == brute(lone, lambda i: True)
    # Null and repeated ids: ordered by null first, then by leaf; a row that repeats all fields is one more leaf.
    rows = [(None, "a", "en", 1, "B"), (4, "a", "en", 1, "Q"), (4, "a", "en", 1, "Q"), (4, "a", "en", 1, "R"), (2, "a", "en", 1, "x" * 3_000_000)]
    found = got(spark, rows, F.col("doc_id") == 4).collect()
    assert len(found) == 5 and len({r.root for r in found}) == 1
    assert sorted(r.verified for r in found) == [False, False, False, True, True]
    leaves = sorted(((r[0] is not None, r[0] or 0, merkle.brute_force([("g", 0, r)], [("g", 0, r)])[0][1]) for r in rows))
    assert found[0].subroot == merkle.joined(bytes.fromhex("".join(x[2] for x in leaves))).hex()


def test_proofs_lead_to_the_root(spark):
    rows = [(k, "ab"[k % 2], "en", 1, f"T{k}") for k in range(90)]
    for r in got(spark, rows, F.lit(False), proofs=True).collect():
        assert r.verified and len(r.proof) == 15 + 2 + 1 or len(r.proof) == 12 + 2 + 1
        assert merkle.hashlib.sha256("".join(r.proof).encode()).hexdigest() == r.proof_sha256


def test_a_parent_that_lacks_children_is_refused(spark):
    nodes = spark.sparkContext.parallelize([((0, k), (b"x" * 32, k == 17)) for k in range(18) if k != 3], 3)
    with pytest.raises(Exception, match="lacks children"):
        merkle.climb(nodes, merkle.height(18), 2)[1][-1].collect()


def test_op11_query_matches_plain_recursion(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select(*FIELDS).collect()]
    want = brute(rows, lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    found = queries.op11_merkle(spark, SMALL)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and 0 < sum(not w[6] for w in want) < len(want)
