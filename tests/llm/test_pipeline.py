import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from corvidex.llm import bpe, decontam  # noqa: E402

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """The rows of every stage over the smallest tables, each written and read again."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    folder = corpus_pipeline.shared_dir(spark)
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], D).write.parquet(f"{folder}/{i}")
        out.append(spark.read.parquet(f"{folder}/{i}"))
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns_and_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "decontamination", "tokens"]
    for df in steps[1:-1]:
        assert sorted(df.columns) == sorted(steps[0].columns)
    counts = [df.count() for df in steps]
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2]


def test_filters_keep_clean_documents(spark, steps):
    labels = spark.read.parquet(f"{D}/labels.parquet").collect()
    good, junk = {r["doc_id"] for r in labels if r["quality"] == 1}, {r["doc_id"] for r in labels if r["quality"] == 0}
    assert ids(steps[1]) == ids(steps[0])
    kept = ids(steps[2])
    assert len(good - kept) <= 0.01 * len(good) and len(junk & kept) <= 0.03 * len(junk)


def test_one_document_of_each_group_stays(steps):
    """All pairs by brute force: sets of five-word shingles with a Jaccard similarity of 0.8 or more are linked."""
    sets = {}
    for r in steps[2].select("doc_id", "text").collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    holders = {}
    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    shared = {}
    for ks in holders.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    linked = 0
    for (a, b), n in shared.items():
        if 10 * n >= 8 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
            linked += sets[a] != sets[b]
    assert linked and ids(steps[3]) == {find(k) for k in sets}


def test_no_benchmark_item_is_left(spark, steps):
    bench = spark.read.parquet(f"{D}/benchmark.parquet")
    assert ids(steps[3]) - ids(steps[4]) == ids(decontam.overlaps(steps[3], bench))
    assert decontam.overlaps(steps[4], bench).count() == 0


def test_tokens(steps):
    texts = {r["doc_id"]: r["text"] for r in steps[4].collect()}
    for r in steps[5].collect():
        assert bpe.load().decode(r["ids"]) == texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_run_gives_the_same(spark, steps):
    got = corpus_pipeline.run(spark, D)
    assert sorted(map(str, got.collect())) == sorted(map(str, steps[-1].collect()))


def test_odd_documents_pass_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, stats string, item_id long"
    rows = [(1, None, None, None, None, 1.0, 1, "x", 1), (2, "", "en", "s", 0, None, None, None, None), (None, "some words in here", "en", None, 1, 1.0, 1, "x", 1), (3, "word " * 40000, "en", "s", 5, 1.0, 1, "x", 1), (3, "word " * 40000, "en", "s", 5, 1.0, 1, "x", 1)]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, df, D)
            assert got.count() <= df.count(), name
            if name != "tokens":
                assert got.columns == df.columns, name
