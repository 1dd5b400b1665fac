import random
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corvidex.functions import text as T
from corvidex.operators.ranked import split_terms, terms_of


def scan(s: str) -> list[tuple[str, str]]:
    """A character-by-character tokenizer, written without regular expressions: (token, class)."""
    s = "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    digit = lambda c: "0" <= c <= "9"
    letter = lambda c: "a" <= c <= "z" or c == "_"
    word = lambda c: digit(c) or letter(c)
    at = lambda i: s[i] if i < len(s) else "\0"

    def run(i, test):
        while i < len(s) and test(s[i]):
            i += 1
        return i

    def dotted(i):
        while at(i) == "." and word(at(i + 1)):
            i = run(i + 1, word)
        return i

    out, i = [], 0
    while i < len(s):
        if not word(s[i]):
            i += 1
            continue
        j = run(i, digit)
        if j > i and at(j) == "." and word(at(j + 1)):
            j = dotted(j)
            out.append((s[i:j], "word"))
        elif letter(at(j)):
            j = run(j, word)
            while at(j) in "-'" and at(j) != "\0" and word(at(j + 1)) and at(j + 1) != "_":
                j = run(j + 1, word)
            j = dotted(j)
            t = s[i:j]
            if t.count("-") == 1:
                out += scan(t.replace("-", " "))
            else:
                out.append((t, "word"))
        else:
            out.append((s[i:j], "number"))
        i = j
    return out


KNOWN = {
    "foo-bar": ["foo", "bar"], "a-b-c": ["a-b-c"], "1.5": ["1.5"], "10": ["10"], "2.a.b": ["2.a.b"], "don't": ["don't"], "x_y": ["x_y"], "É": [], "": [],
    "Hello, World!": ["hello", "world"], "a1b2 3c": ["a1b2", "3c"], "w" * 256: ["w" * 256], "the end.": ["the", "end"], "-x -1": ["x", "1"],
}


def test_known_tokens(spark):
    rows = spark.createDataFrame(list(enumerate(KNOWN)), "i int, x string").select("i", T.tokens("x").alias("t")).collect()
    assert {list(KNOWN)[r["i"]]: r["t"] for r in rows} == KNOWN
    assert {k: [t for t, _ in scan(k)] for k in KNOWN} == KNOWN
    assert spark.range(1).select(T.tokens(F.lit(None).cast("string")).alias("t")).first()["t"] is None


def test_tokens_against_the_scanner(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abZ19_-.'  é") for _ in range(rng.randrange(0, 24))) for _ in range(20000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", T.tokens("x").alias("t"), F.transform(T.tokens("x"), T.token_class).alias("c")).collect()
    for r in rows:
        assert list(zip(r["t"], r["c"])) == scan(texts[r["i"]]), texts[r["i"]]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abC12_-.' é", max_size=30))
def test_query_side_tokens_are_the_same(s):
    want: dict[str, int] = {}
    for t, _ in scan(s):
        want[t] = want.get(t, 0) + 1
    assert terms_of(s) == want


def test_index_tokens_leave_gaps(spark):
    rows = [(1, "the 12 cat sat"), (2, "x" * 256 + " y")]
    df = spark.createDataFrame(rows, "i int, x string")
    got = {r["i"]: r["t"] for r in df.select("i", T.index_tokens("x", stop=("the",)).alias("t")).collect()}
    assert got == {1: [None, None, "cat", "sat"], 2: [None, "y"]}
    assert df.where("i = 1").select(T.index_tokens("x", numbers=True).alias("t")).first()["t"] == ["the", "12", "cat", "sat"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab*?.", max_size=8), st.text(alphabet="ab.", max_size=8))
def test_globs(pattern, key):
    def match(p, k):
        if not p:
            return not k
        if p[0] == "*":
            return any(match(p[1:], k[i:]) for i in range(len(k) + 1))
        return bool(k) and (p[0] == "?" or p[0] == k[0]) and match(p[1:], k[1:])

    assert bool(re.match(T.glob_regex(pattern).replace("^(?s)", "(?s)^"), key)) == match(pattern, key)


def test_globs_in_spark(spark):
    keys = ["foo", "fob", "fo", "barfoo", "f.o", "fxo"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for p, want in {"fo*": {"foo", "fob", "fo"}, "f?o": {"foo", "f.o", "fxo"}, "FOO": {"foo"}, "*o": {"foo", "fo", "barfoo", "f.o", "fxo"}, "f.?": {"f.o"}}.items():
        assert {r["k"] for r in df.where(T.glob_match("k", p)).collect()} == want, p


def test_numbers_and_dates(spark):
    df = spark.createDataFrame([("007",), ("7",), ("1" * 38,), ("-1",), ("1.5",), (None,)], "x string")
    assert [r[0] for r in df.select(T.number("x")).collect()] == [7, 7, int("1" * 38), None, None, None]
    days = ["2024-02-31", "2024-13-01", "2024-1-01", "1999-12-31", "2024-00-10", "2024-01-32"]
    got = spark.createDataFrame([(d,) for d in days], "x string").select(T.is_iso_date("x")).collect()
    assert [r[0] for r in got] == [True, False, False, True, False, False]


def test_formatting(spark):
    row = spark.range(1).select(
        T.html_entry(F.lit("a <b> & http://x.org/q?a=1")).alias("h"), T.fasta(F.lit("p1"), F.lit("t"), F.lit("A" * 145)).alias("f"), T.first_lines(F.lit("\n".join("abcdefghi"))).alias("l"), T.formatter_words(F.lit("Foo-Bar x")).alias("w")
    ).first()
    assert row["h"] == '<pre>a &lt;b&gt; &amp; <a href="http://x.org/q?a=1">http://x.org/q?a=1</a></pre>'
    assert row["f"] == f">p1 t\n{'A' * 72}\n{'A' * 72}\nA\n"
    assert row["l"] == "a\nb\nc\nd\ne\nf\ng" and row["w"] == ["foo-bar", "x"]


def test_query_words():
    assert T.query_words("Foo-Bar a-b-c 1.5") == ["foo", "bar", "a-b-c", "1.5"]
    assert split_terms(["Foo-Bar", "ab*", "x", "x"]) == ({"foo": 1, "bar": 1, "x": 2}, ["ab*"])
