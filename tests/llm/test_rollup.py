import os

import pytest
from pyspark.sql import functions as F

from corvidex.llm import rollup as R
from corvidex.llm._common import shared_dir

CHANGE = "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long, seq int"


def totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}


def test_inserts_deletes_revisions(spark):
    rollup = R.Rollup(spark, shared_dir(spark))
    change = lambda *rows: spark.createDataFrame(list(rows), CHANGE)
    rollup.commit("1", change(("put", 1, "a", "en", "t", 10, 0), ("put", 2, "a", "en", "t", 5, 0), ("put", 3, "b", None, "t", 7, 0), ("put", None, None, None, "t", 2, 0)))
    assert totals(rollup) == {("a", "en", "t"): (2, 15), ("b", None, "t"): (1, 7), (None, None, "t"): (1, 2)}
    second = change(("delete", 1, None, None, "t", None, 0), ("put", 3, "b", "de", "t", 9, 0), ("delete", 99, "a", "en", "t", None, 0))
    rollup.commit("2", second)
    want = {("a", "en", "t"): (1, 5), ("b", "de", "t"): (1, 9), (None, None, "t"): (1, 2)}
    assert totals(rollup) == want
    rollup.commit("2", second)
    assert totals(rollup) == want
    rollup.commit("3", change(("put", 2, "a", "en", "t", 1, 0), ("put", 2, "a", "en", "t", 6, 2), ("delete", 2, "a", "en", "t", None, 1), ("put", 1, "a", "en", "t", 4, 0)))
    assert totals(rollup) == want | {("a", "en", "t"): (2, 10)}
    rollup.commit("2", second)  # later batches build on it: nothing changes
    assert totals(rollup) == want | {("a", "en", "t"): (2, 10)}
    with pytest.raises(ValueError):
        rollup.commit("1b", second)
    rollup.commit("4", spark.createDataFrame([], CHANGE))
    assert totals(rollup) == want | {("a", "en", "t"): (2, 10)}


def test_a_broken_off_commit_does_not_count(spark):
    rollup = R.Rollup(spark, shared_dir(spark))
    rows = spark.createDataFrame([("put", 1, "a", "en", "t", 10, 0)], CHANGE)
    rollup.commit("1", rows)
    os.remove(rollup.folder.removeprefix("file://") + "/committed/1")  # as if the driver had died before the marker
    assert rollup.batches() == [] and totals(rollup) == {}
    rollup.commit("1", rows)
    assert totals(rollup) == {("a", "en", "t"): (1, 10)}


def test_token_counts(spark):
    rows = [(None,), ("",), ("  ",), ("a b\tc",), ("é,x y!",), ("w " * 50000,)]
    df = spark.createDataFrame(rows, "text string")
    assert [r["n"] for r in df.select(R.tokens("text", "words-1").alias("n")).collect()] == [0, 0, 0, 3, 2, 50000]
    assert [r["n"] for r in df.select(R.tokens("text", "marks-2").alias("n")).collect()] == [0, 0, 0, 3, 5, 50000]


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "en", 7)], "doc_id long, text string, source string, lang string, n_tokens int")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert R.of_corpus(spark, docs.limit(0), labels, shared_dir(spark)).collect() == []
    got = R.of_corpus(spark, docs.withColumn("op", F.lit("x")), labels, shared_dir(spark)).collect()
    assert {(r["tokenizer"], r["docs"], r["tokens"]) for r in got} == {("bpe-50k", 1, 2), ("words-1", 1, 2)}


def test_vocabulary_counts_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(R.BPE_FILE)
    texts = [None, "", " a  b\n\nc", "don't <|endoftext|> x", "é€😀", "w " * 5000]
    df = spark.createDataFrame([(i, x, "s", "en") for i, x in enumerate(texts)], "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: r["n_tokens"] for r in R.counted(df, "bpe-50k").collect()}
    assert got == {i: len(library.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}


@pytest.mark.parametrize("broken", ["changes", "ledger", "delta", "mark"])
def test_a_commit_that_fails_anywhere_leaves_nothing(spark, monkeypatch, broken):
    rollup = R.Rollup(spark, shared_dir(spark))
    change = lambda *rows: spark.createDataFrame(list(rows), CHANGE)
    rollup.commit("1", change(("put", 1, "a", "en", "t", 10, 0)))
    second = change(("put", 1, "b", "en", "t", 3, 0), ("put", 2, "a", "en", "t", 5, 0))
    before, ledger = totals(rollup), sorted(map(str, rollup.ledger().collect()))
    with monkeypatch.context() as m:
        if broken == "mark":
            m.setattr(R.Rollup, "_mark", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        else:
            from pyspark.sql.readwriter import DataFrameWriter

            write = DataFrameWriter.parquet

            def fail(self, path, *a, **k):
                write(self, path, *a, **k)
                if path.endswith(broken):
                    raise OSError("lost")

            m.setattr(type(second.write), "parquet", fail)
        with pytest.raises(OSError):
            rollup.commit("2", second)
    assert rollup.batches() == ["1"] and totals(rollup) == before and sorted(map(str, rollup.ledger().collect())) == ledger
    rollup.commit("2", second)
    assert totals(rollup) == {("b", "en", "t"): (1, 3), ("a", "en", "t"): (1, 5)}


def test_a_committed_batch_stays_as_it_is(spark):
    rollup = R.Rollup(spark, shared_dir(spark))
    rollup.commit("1", spark.createDataFrame([("put", 1, "a", "en", "t", 10, 0)], CHANGE))
    rollup.commit("1", spark.createDataFrame([("put", 1, "a", "en", "t", 99, 0)], CHANGE))
    assert totals(rollup) == {("a", "en", "t"): (1, 10)}


def test_ties_have_one_result(spark):
    rows = [("put", 1, "a", "en", "t", 5, 0), ("put", 1, "b", None, "t", 5, 0), ("put", 1, "b", "de", "t", 5, 0), ("delete", 1, "z", "z", "t", 5, 0), ("put", 1, "z", "z", "t", 4, 0), ("put", 1, "z", "z", "t", 9, None)]
    for order in (rows, rows[::-1]):
        rollup = R.Rollup(spark, shared_dir(spark))
        rollup.commit("1", spark.createDataFrame(order, CHANGE).coalesce(1))
        assert totals(rollup) == {("b", "de", "t"): (1, 5)}


def test_snapshots_change_nothing(spark):
    plain, short = R.Rollup(spark, shared_dir(spark)), R.Rollup(spark, shared_dir(spark), most_batches=2)
    for i in range(5):
        rows = spark.createDataFrame([("put", k, f"s{k % 2}", "en", "t", 10 * i + k, 0) for k in range(i, i + 3)] + [("delete", i - 1, None, None, "t", None, 0), ("put", None, "s0", "en", "t", 1, 0)], CHANGE)
        for rollup in (plain, short):
            rollup.commit(f"{i}", rows)
            rollup.commit(f"{i}", rows)
    assert len(short._markers("snapshots")) == 2 and not plain._markers("snapshots")
    assert totals(plain) == totals(short) and plain.batches() == short.batches()
    assert sorted(map(str, plain.ledger().collect())) == sorted(map(str, short.ledger().collect()))


def test_sql_agrees_on_repeated_and_null_rows(spark, tmp_path):
    import duckdb

    from corvidex.llm.queries import OP1_SQL, OP9_SQL, op1_bpe, op9_rollup

    long = "long text with words " * 3000
    docs = [(1, "a b", "en", "s"), (1, "a b c", "de", "s"), (1, "a b d", "de", "t"), (None, "x y", "de", "s"), (None, "x y", "de", "s"), (2, None, None, None), (3, "", "de", None), (4, long, "fr", "s"), (5, "gone away", "en", "s"), (5, "gone", "en", "s"), (6, " <|endoftext|>  it's\n\n ok \t", "de", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 1), (5, 1, 1), (None, 1, 1), (1, 1, 0), (2, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for run, sql in ((op9_rollup, OP9_SQL), (op1_bpe, OP1_SQL)):
        got = run(spark, str(tmp_path))
        want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)), sql[:40]
