import re

import numpy as np
from pyspark.sql import functions as F

from corvidex.llm import urlfilter as U
from corvidex.llm.queries import RULES

SCHEMA = "page_id long, url string"
URLS = [
    "https://m.x.example.com/en/71#top", "http://example.com/en/7?q=1", "http://notexample.com/en/71", "HTTP://A.EXAMPLE.NET/de/8", "http://a.example.net/de/9.html", "http://org/es/", "http://borg/es/",
    "http://a.org/esx", "http://a.org/es/#x", "no scheme", "", None, "http://", "https://h?x=/en/", "ftp://b.com:80/en/", "http://b.com/en", "a://b://c.com/en/1", "http://ünï.com/en/\nx", "http://x.com/en/" + "a" * 100000,
]


def brute(url):
    """Host, path and rule of a URL, step by step."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else None


def test_rules_are_those_asked_for():
    assert [(r.verdict, r.text) for r in RULES] == [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def test_rules_of_the_contract(spark):
    """Each rule of op7's contract decides a URL of its own, with the contract's word; the longer of two wins."""
    want = {
        "http://a.com/en/x": ("com/en/", "block"), "http://example.com/en/7": ("example.com/en/7", "allow"), "http://a.net/de/x": ("net/de/", "allow"),
        "http://net/de/": ("net/de/", "allow"), "http://x.example.net/de/81": ("example.net/de/8", "block"), "http://example.net/de/7": ("net/de/", "allow"), "http://a.org/es/x": ("org/es/", "block"),
    }
    got = U.verdicts(spark.createDataFrame(list(enumerate(want)), SCHEMA), RULES).collect()
    assert {list(want)[r["page_id"]]: (r["rule"], r["verdict"]) for r in got} == want


def test_rules_against_brute_force(spark):
    rows = list(enumerate(URLS)) + [(0, URLS[0])]
    got = U.verdicts(spark.createDataFrame(rows, SCHEMA), RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict) and 0 <= r["score"] <= 1


def test_many_rules_are_joined(spark):
    rows = spark.createDataFrame(list(enumerate(URLS)), SCHEMA).withColumn("host", U.host("url")).withColumn("path", U.path("url"))
    a, b = (sorted(map(str, U.matched(rows, RULES, few).select("page_id", "rule", "rule_verdict").collect())) for few in (100, 0))
    assert a == b


def test_a_repeated_url_counts_as_often_as_it_occurs(spark):
    urls = [("http://a.com/x", 1)] * 50 + [(f"http://a.com/y{i}", 0) for i in range(50)]
    got = U.judge(spark.createDataFrame([("http://a.com/x",), ("http://a.com/y1",)], "url string").withColumn("host", U.host()).withColumn("path", U.path()), spark.createDataFrame(urls, "url string, label int"), sample=10_000)
    assert got.count() == 2


def test_whole_table(spark):
    from corvidex.llm.queries import op7_urls

    d = "/root/testdata/sf0.01"
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = op7_urls(spark, d).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = brute(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict)


def test_empty_and_unlabelled(spark):
    df = spark.createDataFrame([(1, "http://a.dev/x")], SCHEMA)
    assert U.verdicts(df.limit(0), RULES).collect() == []
    r = U.verdicts(df, RULES).first()
    assert (r["rule"], r["verdict"], r["score"]) == (None, "allow", 0.5)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/x", "h", 2.0)], SCHEMA + ", host string, f0 double")
    assert U.verdicts(df, RULES).first()["host"] == "a.com"


def test_trees_learn_and_the_expression_agrees(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(int)
    model = U.fit(x[:3000], y[:3000])
    assert ((model.predict(x[3000:]) > 0) == y[3000:]).mean() > 0.95
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[3000:3200]], "a double, b double, c double")
    got = [r["m"] for r in df.select(model.margin(["a", "b", "c"]).alias("m")).collect()]
    assert np.allclose(got, model.predict(x[3000:3200]))


def test_held_out_urls(spark):
    """Long URLs with many parameters on some suffixes are bad; the trees find that from labels."""
    rng = np.random.default_rng(3)
    bad = lambda i: f"http://win{i}-free-{rng.integers(1e6)}.top/a/b/c/{rng.integers(1e9)}?x={rng.integers(1e9)}&y={i}&z=9"
    good = lambda i: f"https://www.site{i}.org/news/{rng.choice(['summer', 'winter', 'garden'])}"
    rows = [(bad(i), 1) for i in range(300)] + [(good(i), 0) for i in range(600)] + [(None, 1), ("http://x", None)]
    train = spark.createDataFrame(rows, "url string, label int")
    test = spark.createDataFrame([(i, (bad if i % 2 else good)(10_000 + i)) for i in range(200)], SCHEMA)
    got = U.verdicts(test, [], train).collect()
    assert np.mean([(r["verdict"] == "block") == bool(r["page_id"] % 2) for r in got]) > 0.97


def test_entropy_is_that_of_the_characters(spark):
    import math
    from collections import Counter

    texts = ["", "a", "aaaa", "aeio", "https://example.com/en/1?a=b&c=(d)", "é€é 😀😀x", "$1.*\\d[x]"]
    got = spark.createDataFrame([(t,) for t in texts], "url string").select("url", U._entropy(F.col("url")).alias("e")).collect()
    for r in got:
        n = len(r["url"])
        assert math.isclose(r["e"], -sum(k / n * math.log2(k / n) for k in Counter(r["url"]).values()), abs_tol=1e-9), r


def test_labels_of_hosts_that_were_never_seen(spark):
    """The rules' own verdicts as labels, learned from some hosts and asked for others. The README has the figures: little
    can be learned, as the allowing rules turn on a digit of the path, which no lexical feature holds. What must not
    happen is that the suffixes' rates give labels away, which would turn the verdicts round.
    """
    from corvidex.llm.queries import table

    pages = table(spark, "/root/testdata/sf0.1", "pages").select("page_id", "url").withColumn("host", U.host()).withColumn("path", U.path())
    rows = U.matched(pages, RULES).where("rule is not null").withColumn("label", (F.col("rule_verdict") == "block").cast("int"))
    out = F.crc32(F.col("host").cast("binary")) % 5 == 0
    train, test = rows.where(~out).select("url", "label"), rows.where(out)
    got = U.judge(test, train).select("label", "score", "host").collect()
    seen = {r["host"] for r in rows.where(~out).select("host").distinct().collect()}
    assert len(got) > 100 and not seen & {r["host"] for r in got}
    right = {y: np.mean([(r["score"] > 0.5) == bool(y) for r in got if r["label"] == y]) for y in (0, 1)}
    print({y: (sum(r["label"] == y for r in got), right[y]) for y in right})
    assert sum(right.values()) / 2 > 0.5


def test_a_suffix_does_not_give_its_own_label_away(spark):
    """Every URL has a suffix of its own and labels are drawn by chance: nothing can be learned."""
    rng = np.random.default_rng(8)
    rows = [(f"http://a.s{i}x/p", int(rng.integers(2))) for i in range(800)]
    test = spark.createDataFrame([(f"http://a.t{i}x/p",) for i in range(50)], "url string").withColumn("host", U.host()).withColumn("path", U.path())
    scores = [r["score"] for r in U.judge(test, spark.createDataFrame(rows, "url string, label int")).collect()]
    seen = spark.createDataFrame([(u,) for u, _ in rows], "url string").withColumn("host", U.host()).withColumn("path", U.path())
    own = {r["url"]: r["score"] for r in U.judge(seen, spark.createDataFrame(rows, "url string, label int")).collect()}
    assert all(0.2 < s < 0.8 for s in scores) and np.std(list(own.values())) < 0.2
