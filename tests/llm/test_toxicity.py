import random
import re

import duckdb
import numpy as np
import pytest

from plotwright.llm import queries, toxicity

DOCS = "doc_id long, text string, lang string, score string, Passages string"
LABELS = "doc_id long, quality int, toxic int"


def brute_segments(scores):
    """Maximal scoring segments by their definition: the best of what is left of all, then the parts beside it."""

    def inside(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[0] + 1e-9 or (abs(total - best[0]) < 1e-9 and j - i < best[2] - best[1])):
                    best = (total, i, j)
        return [] if best is None else [*inside(a, best[1]), (best[1], best[2], round(best[0], 6)), *inside(best[2] + 1, b)]

    return inside(0, len(scores))


def test_segments_match_their_definition():
    rng = random.Random(5)
    for _ in range(300):
        scores = [rng.choice([-3.0, -1.25, -0.5, 0.7, 1.1, 2.3]) for _ in range(rng.randint(0, 25))]
        at = [k for k, s in enumerate(scores) if s > 0]
        found = [(at[a], at[b], round(s, 6)) for a, b, s in toxicity.segments(at, [scores[k] for k in at], [sum(scores[:k]) for k in at])]
        assert found == brute_segments(scores)


def test_segments_take_time_in_proportion():
    n = 200_000
    for step in (0.5, -0.5, -1.0):
        gains = [1.0] * n
        before = [k * (1.0 + step) for k in range(n)]
        assert sum(1 for _ in toxicity.segments(list(range(n)), gains, before)) in (1, n)


def test_words_are_the_same_by_pieces(monkeypatch):
    text = "Ärger, ab1c_d  eİf! " * 40
    whole = list(toxicity.words_of(text))[0]
    monkeypatch.setattr(toxicity, "PIECE", 13)
    parts = list(toxicity.words_of(text))
    assert [w for _, ws, _ in parts for w in ws] == whole[1] == [w.lower() for w in re.findall(r"[^\W_]+", text)]
    assert [s for _, _, ss in parts for s in ss] == whole[2] and len(parts) > 20


def test_extreme_law_is_recovered():
    rng = np.random.default_rng(2)
    n = rng.integers(20, 4000, 20_000)
    best = (np.log(0.02 * n) - np.log(-np.log(rng.uniform(size=len(n))))) / 1.7
    rate, k = toxicity.extreme_law(best, n)
    assert abs(rate - 1.7) < 0.05 and abs(np.log(k / 0.02)) < 0.1
    assert toxicity.extreme_law(np.zeros(3), np.ones(3)) == (1.0, 1 / 3)
    cut = np.where(best < 0.8, 0, best)  # what is below a bound is not seen
    assert abs(toxicity.extreme_law(cut[best >= 0], n[best >= 0])[0] - 1.7) < 0.6


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        toxic = k % 6 == 0
        if toxic:
            at = rng.randrange(len(text))
            text[at:at] = rng.choices(["vileword", "foulword", "badword"], k=rng.randint(2, 4))
        rows.append((k, " ".join(text), "en", "s", "p"))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxic_passages_are_found_and_clean_texts_left(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame([x for x in labels if x[0] % 5], LABELS)
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.predict(docs, model).collect()}
    held = [k for k in got if k % 5 == 0]
    right = sum(got[k].predicted == labels[k][2] for k in held)
    assert right >= 0.97 * len(held)
    for k in held:
        r = got[k]
        assert r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
        if labels[k][2] and r.predicted:
            assert any(re.search("vileword|foulword|badword", r.text[p.begin : p.stop]) for p in r.passages)
    # The same numbers, recomputed from the model's parts for some texts.
    for k in held[:20]:
        scores = [toxicity.Scores(model.words, model.params)[w.lower()] for w in re.findall(r"[^\W_]+", got[k].text)]
        best = sorted((s for *_, s in brute_segments([-model.params.drift if s is None else s for s in scores])), reverse=True)
        x = np.log1p(toxicity.evidence(best, len(scores), model.rate, model.k))
        assert abs(1 / (1 + np.exp(-(model.line[0] + model.line[1] * x))) - got[k].score) < 1e-4


def test_toxicity_edges(spark):
    rows, labels = corpus(120)
    odd = [(None, None, None, None, None), (1000, "", "x", "y", "z"), (1001, "...", "x", "y", "z"), (1002, "w1 " * 500_000, "x", "y", "z"), (0, rows[0][1], "en", "s", "p"), (0, "other words", "en", "s", "p")]
    docs = spark.createDataFrame(rows + odd, DOCS)
    marks = spark.createDataFrame([*labels, (0, 1, 0), (None, 1, 1), (5, 1, None), (5, 1, 0)], LABELS)
    model = toxicity.fit(docs, marks)
    got = toxicity.predict(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "score", "predicted", "passages"] and got.count() == 126
    none = {r.score for r in got.where("doc_id is null or doc_id in (1000, 1001)").collect()}
    assert len(none) == 1 and 0 < none.pop() < 0.5
    # Labels of one kind, of none, and empty tables.
    clean = toxicity.fit(docs, marks.where("toxic = 0"))
    assert {r.score < 1e-9 for r in toxicity.predict(docs, clean).collect()} == {True}
    assert all(r.predicted == 1 for r in toxicity.predict(docs, toxicity.fit(docs, marks.where("toxic = 1 and doc_id != 0"))).collect())
    for m in (toxicity.fit(docs, marks.limit(0)), toxicity.fit(docs.limit(0), marks)):
        assert {(r.score < 1e-9, r.predicted) for r in toxicity.predict(docs, m).collect()} == {(True, 0)}
    assert toxicity.predict(docs.limit(0), model).count() == 0


def test_repeated_and_null_ids_learn(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame([(int(t), text, "en", "s", "p") for (_, text, *_), (_, _, t) in zip(rows, labels, strict=True)], DOCS)
    model = toxicity.fit(docs, spark.createDataFrame([(0, 1, 0), (1, 1, 1)], LABELS))
    got = toxicity.predict(docs, model).collect()
    assert sum(r.predicted == r.doc_id for r in got) >= 0.95 * len(got)


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_op12_query_on_held_out_rows(spark, sf):
    d = f"/root/testdata/{sf}"
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{d}/labels.parquet'").fetchall())
    held = [(labels[r.doc_id], r.predicted, r.score) for r in queries.op12_toxicity(spark, d).collect() if r.held_out and r.doc_id in labels]
    toxic, clean = [x for x in held if x[0]], [x for x in held if not x[0]]
    assert sum(x[1] for x in toxic) >= 0.9 * len(toxic) and sum(x[1] for x in clean) <= 0.01 * len(clean)
    # The score is a probability: in the mean it is the share of toxic rows.
    assert abs(np.mean([x[2] for x in held]) - len(toxic) / len(held)) < 0.03
