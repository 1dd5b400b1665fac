import numpy as np
import pytest
from pyspark.sql import functions as F

from corvidex.llm import quality as Q

SCHEMA = "doc_id long, text string"
GOOD = "The garden was quiet in the morning. A bird sang, and the water moved under the bridge.\nNobody came by."
BAD = "BUY!!! NOW!!! $$$ *** CLICK!!! HERE!!! FREE!!! "


def corpus(n=120, seed=0):
    rng = np.random.default_rng(seed)
    words = GOOD.split()
    good = [(i, " ".join(rng.choice(words, rng.integers(5, 200))), 1) for i in range(n)]
    bad = [(n + i, " ".join(rng.choice(BAD.split(), rng.integers(5, 200))), 0) for i in range(n)]
    return good + bad


def density(x, m, cov):
    d = x - m
    return -0.5 * (d @ np.linalg.inv(cov) @ d + np.linalg.slogdet(cov)[1])


def test_scores_are_the_discriminant():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(400, 4)), rng.normal(size=(200, 4)) * 2 + 1
    n = np.array([400.0, 200.0])
    m = Q.solve(n, np.stack([a.sum(0), b.sum(0)]), np.stack([a.T @ a, b.T @ b]), pool=0.2, diagonal=0.1, floor=0.01)
    cov = [np.cov(x.T, bias=True) for x in (a, b)]
    pooled = (400 * cov[0] + 200 * cov[1]) / 600
    reg = []
    for c in cov:
        s = 0.8 * c + 0.2 * pooled
        reg.append(0.9 * s + 0.1 * np.diag(np.diag(s)) + 0.01 * np.eye(4))
    x = rng.normal(size=(50, 4))
    want = [1 / (1 + np.exp(-(density(v, b.mean(0), reg[1]) - density(v, a.mean(0), reg[0]) + np.log(0.5)))) for v in x]
    assert np.allclose(m.score(x), want)


def test_statistics_of_odd_texts():
    rows = [Q.statistics(t) for t in (None, "", "a", " \n\t", "!!!", "é" * 1000, "x" * 1_000_000, "w " * 200_000)]
    assert all(len(r) == len(Q.NAMES) and np.isfinite(r).all() for r in rows)
    assert rows[0] == rows[1]


def test_learns_and_keeps_good(spark):
    rows = corpus()
    stats = Q.with_statistics(spark.createDataFrame(rows, SCHEMA + ", label int"))
    model = Q.fit(stats)
    test = spark.createDataFrame([(i, t) for i, t, _ in corpus(60, 9)] + [(900, None), (901, ""), (None, GOOD)], SCHEMA + "")
    scored = Q.score(Q.with_statistics(test), model).collect()
    assert len(scored) == 123 and all(0 <= r["score"] <= 1 for r in scored)
    assert all((r["score"] >= 0.3) == (r["doc_id"] < 60) for r in scored if r["doc_id"] is not None and r["doc_id"] < 120)
    kept = Q.keep_good(test.selectExpr("*", "1 as stats", "2 as score"), model)
    assert kept.columns == ["doc_id", "text", "stats", "score"]
    assert {r["doc_id"] for r in kept.collect()} - {900, 901} == {*range(60), None}


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], SCHEMA + ", label int")
    model = Q.fit(Q.with_statistics(empty))
    assert Q.score(Q.with_statistics(empty), model).collect() == []
    assert Q.score(Q.with_statistics(spark.createDataFrame([(1, GOOD)], SCHEMA)), model).first()["score"] == 0.5
    odd = spark.createDataFrame([(1, GOOD, None), (2, GOOD, 5), (3, GOOD, 1)], SCHEMA + ", label int")
    assert Q.score(Q.with_statistics(odd), Q.fit(Q.with_statistics(odd))).count() == 3


def test_clashing_names_are_refused(spark):
    df = spark.createDataFrame([(1, GOOD, 1)], SCHEMA + ", stats int")
    with pytest.raises(ValueError):
        Q.with_statistics(df)
    with pytest.raises(ValueError):
        Q.score(Q.with_statistics(df.drop("stats")).withColumn("score", F.lit(1)), Q.solve(np.zeros(2), np.zeros((2, 18)), np.zeros((2, 18, 18))))


def test_held_out_accuracy(spark):
    from corvidex.llm.queries import op10_quality

    d = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in op10_quality(spark, d).collect() if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert len(rows) > 300 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_a_key_with_a_third_of_all_rows_makes_no_product(spark):
    """Labels are counted by key before the join: as many rows as documents, and the moments of the whole product."""
    docs = [(1 if i % 3 == 0 else i + 2, GOOD[: i % 90] + (BAD if i % 2 else "")) for i in range(300)]
    labels = [(1 if i % 3 == 0 else i + 2, i % 2) for i in range(300)] + [(1, 7), (1, None), (None, 1)]
    stats = Q.with_statistics(spark.createDataFrame(docs, SCHEMA))
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    joined = Q.labelled(stats, known)
    assert joined.count() <= 2 * len(docs)
    got = Q.fit(joined, times="times")
    want = Q.fit(stats.join(known.withColumnRenamed("quality", "label"), "doc_id"))
    assert np.allclose(got.mean, want.mean) and np.allclose(got.factor, want.factor) and np.isclose(got.odds, want.odds)
