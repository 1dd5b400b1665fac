import itertools
import math
import random
import re

from corvidex.llm import decontam as D

SCHEMA = "doc_id long, text string"
ITEMS = "item_id long, text string"


def brute(docs, items, similar=0.8, window=20):
    """Every alignment of every item with every document."""
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            width = min(window, len(v))
            for s in range(-len(v), len(w)):
                same = [0 <= j + s < len(w) and w[j + s] == x for j, x in enumerate(v)]
                most = max((sum(same[k : k + width]) for k in range(len(v) - width + 1)), default=0)
                run = max(map(len, "".join(" ="[x] for x in same).split()), default=0)
                if v and (most >= math.ceil(width * similar - 1e-9) or run >= 13):
                    out[d, i] = max(out.get((d, i), (0, 0, 0)), (most, sum(same), len(v)))
    return {(*k, n, equal, most) for k, (most, equal, n) in out.items()}


def made(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14, 15, 20, 30, 59, 59])]
    docs = [(k, " ".join(word() for _ in range(rng.randint(0, 80)))) for k in range(40)]
    for i, item in items:
        for share in (0, 0.1, 0.2, 0.3, 0.5):
            v = item.split()
            for j in rng.sample(range(len(v)), int(share * len(v))):
                v[j] = word() + "q"
            docs.append((len(docs), f"{word()} {word()}. {' '.join(v).upper()}! {word()}"))
            docs.append((len(docs), f"{word()} {' '.join(v[len(v) // 3 : len(v) // 3 + 22])} {word()}"))  # a passage of a long item
    return docs, items


def result(df):
    return {tuple(r) for r in df.select("doc_id", "item_id", "n_words", "n_equal", "n_window").collect()}


def test_against_brute_force(spark):
    docs, items = made()
    want = brute(docs, items)
    assert len(want) > 40
    a, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)
    assert result(D.overlaps(a, b)) == want
    assert result(D.overlaps(a, b, broadcast=0)) == want


def test_short_quotations_of_long_items(spark):
    item = " ".join(f"w{i}" for i in range(40))
    quote = lambda a, n: "before " + " ".join(f"w{i}" for i in range(a, a + n)) + " after"
    docs = [(k, quote(k, 13)) for k in range(28)] + [(100 + k, quote(k, 12)) for k in range(28)]
    got = D.overlaps(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, item)], ITEMS)).collect()
    assert {(r["doc_id"], r["n_run"]) for r in got} == {(k, 13) for k in range(28)}


def test_masks_find_every_overlap_of_10_to_20_words():
    for n in range(10, 21):
        for gone in itertools.combinations(range(n), n // 5):
            assert any(not {p + o for o in m} & set(gone) for m in D.MASKS for p in range(n - m[-1]))


def test_edge_cases(spark):
    long = "word " * 30000 + "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "?!"), (4, long), (4, long), (None, long), (5, "clean words only")], SCHEMA)
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    items = spark.createDataFrame([(7, item), (7, item), (None, item), (8, None), (9, " ")], ITEMS)
    want = {(4, 7, 11, 11, 11), (4, None, 11, 11, 11), (None, 7, 11, 11, 11), (None, None, 11, 11, 11)}
    assert result(D.overlaps(docs, items)) == want
    assert sorted(r["doc_id"] or 0 for r in D.remove(docs, items).collect()) == [0, 1, 2, 3, 5]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], SCHEMA), spark.createDataFrame([(1, "a b c")], ITEMS)
    assert D.overlaps(docs, items.limit(0)).collect() == []
    assert D.overlaps(docs.limit(0), items).collect() == []
    assert D.remove(docs, items.limit(0)).count() == 1


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, 6)], "doc_id long, text string, item_id long, h long")
    kept = D.remove(docs, spark.createDataFrame([(2, "x y z", "q")], "item_id long, text string, n string"))
    assert kept.columns == docs.columns and kept.count() == 1


def test_no_python_in_the_plan(spark, capsys):
    docs, items = made()
    D.remove(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


def test_sql_agrees_on_short_items_and_odd_rows(spark):
    import duckdb
    import pandas as pd

    from corvidex.llm.queries import OP2_SQL

    docs, items = made(3)
    docs = [*docs, (1000, None), (1001, ""), *docs[-3:]]
    items = [*items, (1000, None), (1001, "?")]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    names = "doc_id, item_id, n_words, n_equal, n_window, n_run"
    got = D.overlaps(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS))
    want = con.sql(f"SELECT {names} FROM ({OP2_SQL})").fetchall()
    assert sorted(tuple(r) for r in got.select(*names.split(", ")).collect()) == sorted(want) and any(r[2] < 10 for r in want)
