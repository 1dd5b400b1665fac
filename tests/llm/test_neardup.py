import random

import numpy as np

from corvidex.llm import neardup as N
from corvidex.llm import simhash

D = "/root/testdata/sf0.01"


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def survivors(rows):
    """Brute force over all pairs of rows of (key, text)."""
    rows = sorted(set(rows), key=lambda r: r[0])
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)


def near_copies(n, words=120, seed=0):
    """Texts around one, whose similarities lie on both sides of 0.8, and unlike ones."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(words)] = f"n{r.randrange(10**6)}"
        out.append((10 * i, " ".join(w)))
        out.append((10 * i + 1, " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randrange(1, 90)))))
    return out


def test_stage_drops_what_three_bits_miss(spark):
    import corpus_pipeline

    base = [f"word{i}" for i in range(100)]
    pairs = [(1, " ".join(base))] + [(2 + i, " ".join(base[:at] + [f"new{i}"] + base[at + 1 :])) for i, at in enumerate((20, 40, 60, 80))]
    far = [k for k, t in pairs[1:] if (simhash.fingerprint(t) ^ simhash.fingerprint(pairs[0][1])).bit_count() > 3]
    assert far  # each has 91 shingles of 101 in common
    got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(pairs, "doc_id long, text string"), D)
    assert [r["doc_id"] for r in got.collect()] == [1]


def test_groups_against_brute_force(spark):
    rows = near_copies(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = survivors(rows)
    assert 60 < len(want) < 120
    for most in (N.MOST, 8):  # 8: the bucket of the copies is compared in blocks
        assert sorted(r["doc_id"] for r in N.keep_one(df, most=most).collect()) == want


def test_a_large_bucket_costs_no_square(spark):
    n, most = 2048, 64
    sets = spark.range(n).selectExpr("xxhash64(id) AS fp", "array(7L) AS bands")
    got = N.blocks(sets, most).cache()
    assert got.count() <= 4 * n
    large = got.where("large").select("block", "fp")
    one = sets.selectExpr("fp AS node", "-1L AS root")
    assert N.rest(large, one, most).count() == 0  # all are linked already
    apart = N.rest(large, one.limit(n - 20), most)  # 20 sets are held against all others, no others among themselves
    assert apart.where("mine").select("fp").distinct().count() == 20
    met = {}
    for r in apart.collect():
        met.setdefault(r["block"], [set(), set()])[0].add(r["fp"])
        if r["mine"]:
            met[r["block"]][1].add(r["fp"])
    assert len({(i, j) for every, mine in met.values() for i in mine for j in every}) == 20 * n
    assert apart.count() <= 3 * n


def test_links_of_sets():
    sets = [N.shingles(t) for _, t in near_copies(40, seed=3)]
    label = N.alike(sets)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                assert label[i] == label[j]


def test_bands_meet_at_the_least_similarity():
    r = np.random.default_rng(1)
    sets = []
    for _ in range(3000):
        x = np.unique(r.integers(0, 2**64, 180, dtype=np.uint64))
        sets += [x[:162], x[18:]]  # 144 of 180
    keys = N.bands(sets)
    shared = (keys[::2] == keys[1::2]).sum(axis=1)
    assert shared.min() > 0 and abs(shared.mean() / N.BANDS - 0.8**N.ROWS) < 0.01


def test_masks_bring_near_fingerprints_together(spark):
    texts = [" ".join([f"word{i}" for i in range(400)][:k] + [f"new{j}"]) for j, k in enumerate((400, 399, 398, 396, 380, 300, 200))] + ["", "one two", "x " * 9]
    sets = [N.shingles(t) for t in texts]
    fps = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s)) for s in sets]
    assert N.fingerprints(sets).tolist() == fps
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= simhash.RADIUS]
    assert near
    got = N.sketches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    keys = {r["doc_id"]: r["bands"][N.BANDS :] for r in got.collect()}
    assert {len(k) for k in keys.values()} == {15}
    for i, j in near:
        assert any(a == b for a, b in zip(keys[i], keys[j]))
    r = random.Random(5)
    for _ in range(200):  # every mask is there, as the operator has them
        a = r.getrandbits(64)
        one = a ^ sum(1 << b for b in r.sample(range(64), simhash.RADIUS))
        x, y = (N.covers([np.array([v], np.uint64)])[0] for v in (a, one))
        assert (x == y).any() and (x != y).any()


def test_odd_rows(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(5, base), (3, base), (3, base), (9, base + " more"), (None, base), (20, None), (21, "  "), (30, "quite another text"), (30, "unlike the other"), (40, "x " * 50000), (41, "X " * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "1 as h", "2 as fp")
    got = N.keep_one(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 3, 20, 30, 30, 40]
    assert N.keep_one(df.limit(0)).collect() == []


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    want = survivors([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in N.keep_one(docs).collect()) == want
