import itertools
import re

import numpy as np
import xxhash

from corvidex.llm import simhash as S
from corvidex.llm.components import components

SCHEMA = "doc_id long, text string"


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def partition(labels):
    groups = {}
    for i, v in enumerate(labels):
        groups.setdefault(v, []).append(i)
    return sorted(map(tuple, groups.values()))


def chains(x, radius=3):
    parent = list(range(len(x)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= radius).tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(x))]


def clusters(seed=0, centres=25, around=40):
    rng = np.random.default_rng(seed)
    x = set()
    for b in rng.integers(0, 2**63, centres, dtype=np.uint64).tolist():
        x.add(b)
        for _ in range(around):
            y = b
            for k in rng.integers(0, 64, rng.integers(1, 9)):
                y ^= 1 << int(k)
            x.add(y)
    return np.array(sorted(x), np.uint64)


def test_fingerprints():
    for t in [None, "", " \t", "a", "A b", "a b c d e f É　x y", "  x\x0by z\x1c q  r", "é " * 50, "w1 w2 w3 w1 w2 w3", "Ünï A-Z " * 3000]:
        assert S.fingerprint(t) == fingerprint(t), t


def test_spark_hashes_alike(spark):
    from pyspark.sql import functions as F

    for s in ["a", "abc def ghi", "é" * 40, "x" * 100]:
        got = spark.range(1).select(F.xxhash64(F.lit(s)).alias("h")).first()["h"]
        assert got % 2**64 == xxhash.xxh64_intdigest(s.encode(), 42)


def test_masks_leave_out_any_three_positions():
    for masks in (S.masks(list(range(64))), [m | s for m in S.masks(list(range(64)))[:1] for s in S.masks([p for p in range(64) if not m >> p & 1])]):
        inside = range(64) if len(masks) == 15 and bin(masks[0]).count("1") == 32 else [p for p in range(64) if not S.masks(list(range(64)))[0] >> p & 1]
        for three in itertools.combinations(inside, 3):
            assert any(not any(m >> p & 1 for p in three) for m in masks)


def test_forest_keeps_all_links():
    for seed in range(5):
        x = clusters(seed, 6, 60)
        assert partition(S.forest(x).tolist()) == partition(chains(x))


def test_groups_of_fingerprints(spark):
    x = clusters()
    fps = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    want = partition(chains(x))
    at = {int(v): i for i, v in enumerate(x.view(np.int64))}
    for most in (S.MOST, 5):  # 5: every bucket of a cluster is covered a second time
        labels = list(range(len(x)))
        for r in components(S.links(fps, most=most)).collect():
            labels[at[r["node"]]] = at[r["root"]]
        assert partition(labels) == want


def test_groups(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(5, base), (3, base), (3, base), (9, base + " more"), (None, base), (20, None), (21, "  "), (30, "quite another text"), (40, "x " * 50000), (41, "X " * 50000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = S.groups(df).collect()
    assert len(got) == len(rows)
    fp = {k: fingerprint(t) for k, t in rows}
    for r in got:
        assert r["fp"] % 2**64 == fp[r["doc_id"]]
        near = [k for k, t in rows if k is not None and bin(fingerprint(t) ^ fp[r["doc_id"]]).count("1") <= 3]
        assert r["component_id"] == min(near)
    kept = S.keep_one(df.selectExpr("text", "doc_id", "1 as fp", "2 as component_id"))
    assert kept.columns == ["text", "doc_id", "fp", "component_id"]
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 20, 30, 40]


def test_rows_that_share_an_id_but_not_the_text(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(1, base), (2, base), (2, "a text of its own"), (2, "a text of its own"), (3, "one more text"), (3, "and one more again")]
    kept = S.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, kept)) == sorted({rows[0], *rows[2:]})


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.groups(empty).collect() == [] and S.keep_one(empty).collect() == []


def test_components(spark):
    pairs = [(i, i + 1) for i in range(100)] + [(1000, k) for k in range(500, 600)] + [(7, 7), (8, 7), (None, 3), (2000, 2001), (2001, 2000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, 1000: 500, **{k: 500 for k in range(500, 600)}, 2000: 2000, 2001: 2000}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_whole_table_against_brute_force(spark):
    from corvidex.llm.queries import op6_simhash

    d = "/root/testdata/sf0.01"
    rows = sorted(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    x = np.array([fingerprint(r["text"]) for r in rows], np.uint64)
    root = chains(x)
    got = {r["doc_id"]: r for r in op6_simhash(spark, d).collect()}
    for i, r in enumerate(rows):
        assert got[r["doc_id"]]["fingerprint"] == f"{int(x[i]):016x}"
        assert got[r["doc_id"]]["component_id"] == rows[root[i]]["doc_id"]
