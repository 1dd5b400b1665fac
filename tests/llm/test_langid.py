import math
from collections import Counter

import numpy as np
import pytest

from corvidex.llm import langid as L

SCHEMA = "doc_id long, text string, lang string"
EN = "the house and the garden with a thing that was there before the water"
DE = "das haus und der garten mit einem ding das schon immer dort gewesen ist"


def likelihood(word, pieces, prob, rare, lang):
    """The sum over all segmentations, written as a recursion."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            total += prob[pieces.index(word[:n]), lang] * likelihood(word[n:], pieces, prob, rare, lang)
        elif n == 1:
            total += rare[lang] * likelihood(word[n:], pieces, prob, rare, lang)
    return total


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "ba", "▁a", "abb", "c"]
    prob, rare = np.random.default_rng(0).random((8, 3)) * 0.1, np.full(3, 1e-4)
    words = ["▁abba", "▁", "▁abbabbac", "▁xyz", "▁aabbéab", "▁a"]
    got = L.forward(L.Pieces(pieces), words, prob, rare)
    for i, w in enumerate(words):
        for c in range(3):
            assert math.isclose(got[i, c], math.log(likelihood(w, pieces, prob, rare, c)), abs_tol=1e-9)


def test_expected_counts_are_those_of_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "ba"]
    prob, rare = np.random.default_rng(1).random((5, 1)) * 0.2, np.array([1e-9])

    def paths(w):
        return [[]] if not w else [[p, *rest] for p in pieces if w.startswith(p) for rest in paths(w[len(p) :])]

    want = np.zeros(5)
    for word, n in (("▁abab", 2.0), ("▁bba", 1.0)):
        found = [(p, math.prod(prob[pieces.index(x), 0] for x in p)) for p in paths(word)]
        for p, w in found:
            for x in p:
                want[pieces.index(x)] += n * w / sum(f[1] for f in found)
    assert np.allclose(L.expected(L.Pieces(pieces), ["▁abab", "▁bba"], np.array([2.0, 1.0]), prob, rare), want)


@pytest.fixture(scope="module")
def model():
    return L.fit_counts({"en": Counter(EN.split()), "de": Counter(DE.split())}, L.vocabulary())


def test_predictions(model):
    langs, scores = model.predict([EN, DE.upper(), None, "", "12 34 !!", "the " * 20000, "w" * 5000, "中文", EN])
    assert langs[:6] == ["en", "de", "und", "und", "und", "en"] and langs[6] in ("en", "de") and langs[7] in ("en", "de") and langs[8] == "en"
    assert all(0 <= s <= 1 for s in scores) and scores[2:5] == [0, 0, 0] and scores[0] > 0.9
    assert scores[0] == scores[8]


def test_fit_learns_only_from_good_rows(spark):
    rows = [(i, EN, "en") for i in range(6)] + [(10 + i, DE, "de") for i in range(6)] + [(50, None, "fr"), (51, EN, None), (None, EN, "xx"), (52, DE, " ")]
    model = L.fit(spark.createDataFrame(rows, SCHEMA))
    assert model.langs == ["de", "en"]
    assert model.predict([EN, DE])[0] == ["en", "de"]
    out = L.predict(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(out) == len(rows) and {r["lang_pred"] for r in out if r["text"]} == {"de", "en"}
    kept = L.keep_known(spark.createDataFrame(rows, SCHEMA), model)
    assert kept.columns == ["doc_id", "text", "lang"] and kept.count() == len(rows) - 1


def test_nothing_learned_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = L.fit(empty)
    assert L.predict(empty, model).collect() == []
    got = L.predict(spark.createDataFrame([(1, EN, "en")], SCHEMA), model).first()
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)


def test_clashing_columns(spark, model):
    df = spark.createDataFrame([(1, EN, "en", 0.5)], SCHEMA + ", score double")
    with pytest.raises(ValueError):
        L.predict(df, model)
    assert L.keep_known(df, model).columns == df.columns


def test_held_out_accuracy(spark):
    from corvidex.llm.queries import op3_langid

    d = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in op3_langid(spark, d).collect() if r["held_out"]]
    assert len(rows) > 200 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) / len(rows) > 0.95


def test_unlearned_languages_and_noise_are_rejected(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    two = L.fit(docs.where("lang in ('en', 'de')"))
    rng = np.random.default_rng(0)
    noise = [(i, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)), "en") for i in range(50)]
    assert L.keep_known(spark.createDataFrame(noise, SCHEMA), two).count() == 0
    known, other = docs.where("lang in ('en', 'de')"), docs.where("lang not in ('en', 'de')")
    assert L.keep_known(known, two).count() == known.count()
    assert L.keep_known(other, two).count() < 0.2 * other.count()
    one = L.fit(docs.where("lang = 'de'"))
    assert L.keep_known(spark.createDataFrame([(1, "Привет мир", "ru"), (2, "中文", "zh"), *noise], SCHEMA), one).count() == 0


def test_what_is_learned_is_bounded(spark, monkeypatch):
    """A key with a third of all rows is sampled like others, equal rows teach once, and rare languages and words are left out."""
    monkeypatch.setattr(L, "MOST_LANGS", 2)
    monkeypatch.setattr(L, "MOST_WORDS", 5)
    rows = [(7, f"{EN} w{i}", "en") for i in range(400)] + [(7, EN, "en")] * 400 + [(i, DE, "de") for i in range(300)] + [(i, "rare", f"x{i}") for i in range(50)]
    seen = []
    monkeypatch.setattr(L, "fit_counts", lambda counts, pieces: seen.append(counts))
    L.fit(spark.createDataFrame(rows, SCHEMA), docs_per_lang=40)
    assert set(seen[0]) == {"en", "de"} and all(len(c) <= 5 for c in seen[0].values())
    assert 0 < seen[0]["en"]["the"] <= 3 * 80  # three times a text, of about 40 texts


def test_very_long_texts_come_in_small_batches(spark):
    import pyarrow as pa

    from corvidex.llm._common import bounded_batches

    bounded_batches(spark)
    df = spark.range(60, numPartitions=1).selectExpr("id as doc_id", "repeat('word ', 1000000) as text")
    sizes = df.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in bs), "n bigint").collect()
    assert len(sizes) > 1 and max(r["n"] for r in sizes) < 100 << 20
