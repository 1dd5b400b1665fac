import numpy as np
from pyspark.sql import functions as F

from corvidex.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k):
    """Exact answers for every row whose id is divisible by 20."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, v in good:
        if i % 20 == 0:
            ranked = sorted((-float((v * w).sum()), j) for j, w in good if j != i)
            out[i] = [(j, -s) for s, j in ranked[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(got) + 1
        got.append((r["vec_id"], r["score"]))
    return out


def search(df, k, **more):
    return A.search(df, F.col("vec_id") % 20 == 0, k, **more)


def test_small_tables_are_exact_with_ties_and_copies(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(40)]
    rows += [(i, rows[0][1]) for i in range(100, 160)]  # copies, also of a query
    rows += [(200, None), (220, [0.0] * 6), (240, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (260, [float("nan")] + [1.0] * 5), (280, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (300, [1.0, 2.0])]
    got, want = answers(search(spark.createDataFrame(rows, SCHEMA), 10)), brute([r for r in rows if r[0] != 300], 10)
    assert got.keys() == want.keys()
    for q in want:
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_fewer_candidates_than_asked_for(spark):
    got = answers(search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], SCHEMA), 20))
    assert got == {0: [(1, 1.0), (2, -1.0)]}


def test_empty_and_single(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0])], SCHEMA)
    assert search(df.limit(0), 5).collect() == [] and search(df, 5).collect() == []


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.5, 0.0], 2), (1, [0.5, 0.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA + ", score int").withColumn("id", F.lit("x"))
    assert answers(search(df, 5)) == {0: [(1, 0.5)]}


def test_shards_and_blocks_keep_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.2, 3, (3000, 1))  # norms differ: not cosine
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got, want = answers(search(spark.createDataFrame(rows, SCHEMA), 20, shard=700, block=40)), brute(rows, 20)
    assert got.keys() == want.keys()
    recall = np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.95


def test_whole_table_recall(spark):
    from corvidex.llm.queries import op5_ann

    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, want = answers(op5_ann(spark, d)), brute(rows, 20)
    assert got.keys() == want.keys()
    assert np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_each_length_is_searched_by_itself(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=(3, 5, 8)[i % 3]).astype(np.float32).tolist()) for i in range(120)] + [(1000, [1.0] * 20)]
    got = answers(search(spark.createDataFrame(rows, SCHEMA), 7))
    want = {}
    for n in (3, 5, 8):
        want |= brute([r for r in rows if len(r[1]) == n], 7)
    assert {q: [j for j, _ in a] for q, a in got.items()} == {q: [j for j, _ in a] for q, a in want.items()}


def test_an_id_asks_with_each_of_its_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0])]
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in search(spark.createDataFrame(rows, SCHEMA), 1).collect())
    assert got == [(1, 1, 2.0), (1, 2, 3.0)]


def test_lists_and_back():
    x = np.array([[1, -1, 2], [-1, -1, -1], [0, 5, 4]])
    import pyarrow as pa

    assert A._rectangle(pa.chunked_array([A._lists(x)])).tolist() == [[1, 2, -1], [-1, -1, -1], [0, 5, 4]]


def test_the_number_of_shards():
    assert [A.shards_of(n, 64) for n in (0, 1, 8191, 8192, 65_536, 262_145, 6_553_600)] == [1, 1, 1, 2, 4, 5, 100]
    assert A.shards_of(65_536, 1 << 20) == 8192 and [A.beam_of(s) for s in (1, 2, 4, 1000)] == [256, 182, 128, 128]


def test_recall_over_the_largest_table(spark):
    from corvidex.llm.queries import op5_ann

    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x = np.stack(rows["embedding"]).astype(float)
    ids = rows["vec_id"].to_numpy()
    got = answers(op5_ann(spark, d))
    asks = np.flatnonzero(ids % 20 == 0)
    near = x[asks] @ x.T
    near[np.arange(len(asks)), asks] = -np.inf
    best = ids[np.argsort(-near, axis=1)[:, :20]]
    assert np.mean([len({j for j, _ in got[ids[q]]} & set(b.tolist())) / 20 for q, b in zip(asks, best)]) >= 0.95
