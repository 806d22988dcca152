import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwright.llm import negatives, queries

ROWS = "vec_id long, embedding array<double>, label int, score string, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "s", "c") for i, v, y in rows], ROWS)


def found(df, every=10, **more):
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % every == 0, F.col("label"), **more).collect())


def brute(rows, every=10, **more):
    return sorted(negatives.brute_force(rows, {i for i, *_ in rows if i is not None and i % every == 0}, **more))


def random_rows(n, d, seed, labels=4, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d)) * 3
    return [(k, (centres[k % 6] + rng.normal(size=d) * spread).round(2).tolist(), int(rng.integers(labels))) for k in range(n)]


@pytest.mark.parametrize("scale", [256, 1])
def test_negatives_match_brute_force(spark, scale):
    for rows in (random_rows(900, 6, 1), random_rows(700, 3, 2, labels=2, spread=0.1)):
        want = brute(rows, scale=scale)
        assert want and found(frame(spark, rows), scale=scale, sizes=(128, 16), rows_per_cell=100) == want
        assert found(frame(spark, rows), scale=scale) == want  # in one group


def test_ties_and_repeated_vectors(spark):
    rows = [(k, [float(k % 3), 1.0], k % 2) for k in range(300)]
    want = brute(rows)
    assert found(frame(spark, rows), sizes=(64, 8), rows_per_cell=50) == want == found(frame(spark, rows))


def test_rows_that_take_no_part(spark):
    good = random_rows(200, 4, 5)
    bad = [(200, None, 1), (210, [1.0, None, 2.0, 3.0], 1), (220, [float("nan")] * 4, 1), (230, [float("inf"), 0.0, 0.0, 0.0], 1), (240, [1.0, 1.0, 1.0, 1.0], None), (None, [1.0] * 4, 1), (250, [], 1), (260, [0.0] * 4, 1)]
    df = frame(spark, good + bad)
    assert found(df, sizes=(64, 8)) == brute(good + bad[-1:]) == found(df)
    assert found(df.limit(0)) == [] and found(df.where("vec_id = 0")) == [] and found(df.where("vec_id % 10 != 0")) == []
    assert negatives.hard_negatives(df.limit(0), F.lit(True), F.col("label")).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_lengths_are_searched_apart(spark):
    rows = [(k, v[: 4 - k % 2 - k // 250], y) for k, v, y in random_rows(300, 4, 8)]
    want = sorted(x for n in (4, 3, 2) for x in brute([r for r in rows if len(r[1]) == n]))
    assert found(frame(spark, rows), sizes=(100, 8), rows_per_cell=40) == want


def test_repeated_ids(spark):
    rows = random_rows(400, 4, 6)
    many = [(0, v, y) for _, v, y in random_rows(3000, 4, 7)]
    got = found(frame(spark, rows + many), sizes=(256, 8), rows_per_cell=300)
    asker = min(((y, list(np.floor(np.array(v) * 256))), v) for _, v, y in [rows[0], *many])
    assert [x for x in got if x[0] == 0] == [x for x in brute([(0, asker[1], asker[0][0]), *rows[1:]]) if x[0] == 0]
    others = {x[0] for x in got}
    assert others == {x[0] for x in brute(rows)} | {0}


def test_balls_hold_their_rows_and_bounds_hold():
    rng = np.random.default_rng(4)
    rows = np.floor(rng.normal(size=(500, 5)) * 50)
    balls, order = negatives.ball_tree(rows, np.arange(500), leaf=20)
    q = np.floor(rng.normal(size=(30, 5)) * 50)
    lengths = np.sqrt((q * q).sum(1))
    assert sorted(order.tolist()) == list(range(500))
    for ball in balls:
        own = rows[order[ball.begin : ball.stop]]
        assert np.sqrt(((own - ball.centre) ** 2).sum(1)).max() <= ball.radius + 1e-9
        low, high = negatives.bounds(q, lengths, ball.centre, ball.radius)
        products = q @ own.T
        assert (products.min(1) >= low).all() and (products.max(1) <= high).all()
        assert not ball.kids or [balls[c].begin for c in ball.kids][0] in (ball.begin, (ball.begin + ball.stop) // 2)


def test_search_leaves_nodes_out(monkeypatch):
    """Of well separated balls only those are opened whose bounds meet the window."""
    rng = np.random.default_rng(1)
    rows = np.concatenate([np.floor(rng.normal(size=(64, 2)) * 2 + c) for c in ((500, 0), (0, 500), (-500, 0), (0, -500))])
    seen = []
    whole = negatives.bounds
    monkeypatch.setattr(negatives, "bounds", lambda *a: seen.append(1) or whole(*a))
    n = len(rows)
    negatives.search(np.array([-1]), np.array([[100.0, 0.0]]), np.array([9]), np.array([[45_000.0]]), np.array([[1e9]]), np.arange(n), rows, np.zeros(n, np.int64), 3, False)
    assert len(seen) < len(negatives.ball_tree(rows, np.arange(n))[0])


def test_op13_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select vec_id, embedding, case when vec_id % 7 = 0 then (label + 1) % 10 else label end from '{d}/embeddings.parquet'").fetchall()
    want = negatives.brute_force(rows, {r[0] for r in rows if r[0] % 50 == 0})
    assert sorted(tuple(r) for r in queries.op13_hard_negatives(spark, d).collect()) == sorted(want)
