"""The query language: text to a small tree, and the tree to DataFrames.

Terms, globs, 'literals', "phrases", qualifiers (ix:term), relations (ix<v, ix<=v,
ix=v, ix>=v, ix>v), AND, OR, NOT (upper case), &, |, juxtaposition for AND, and
parentheses. AND and OR have one precedence and fold from the left; NOT binds to
the next test. Names and kinds are checked before any plan is made.

A tree becomes either one predicate over documents (a single scan, no shuffle)
or set algebra over stored postings (semi joins, anti joins, unions).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..operators.collection import DATE, NUMBER, TEXT, WEIGHTED, Collection, IndexError_
from ..operators.lineage import cut


class QueryError(ValueError):
    """A query that can't be parsed."""


# ---- tree ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class All:
    pass


@dataclass(frozen=True)
class Nothing:
    pass


@dataclass(frozen=True)
class Term:
    key: str
    index: str | None = None
    glob: bool = False


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    index: str | None = None


@dataclass(frozen=True)
class Rel:
    op: str
    index: str
    value: str


@dataclass(frozen=True)
class Range:
    index: str
    low: str
    high: str


@dataclass(frozen=True)
class And:
    a: object
    b: object


@dataclass(frozen=True)
class Or:
    a: object
    b: object


@dataclass(frozen=True)
class Not:
    a: object


# ---- text to tree --------------------------------------------------------------------------------

_LEX = re.compile(r"""\s*(?:(?P<phrase>"(?:\\.|[^"\\])*")|(?P<literal>'(?:\\.|[^'\\])*')|(?P<op><=|>=|[<>=:()&|])|(?P<word>(?:\\.|[^\s"'<>=:()&|])+))""")
_ESCAPE = {"r": "\r", "n": "\n", "t": "\t"}


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPE.get(m[1], m[1]), s, flags=re.S)


def lex(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while query[at:].strip():
        m = _LEX.match(query, at)
        if not m:
            raise QueryError(f"can't read {query[at:].strip()[:20]!r}")
        kind = m.lastgroup
        out.append((kind, m[kind]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, tokens: list[tuple[str, str]], wildcard: bool):
        self.tokens, self.at, self.wildcard = tokens, 0, wildcard

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def query(self):
        left = self.test()
        while True:
            kind, text = self.peek()
            if (kind, text) in (("word", "OR"), ("op", "|")):
                self.take()
                left = Or(left, self.test())
            elif (kind, text) in (("word", "AND"), ("op", "&")):
                self.take()
                left = And(left, self.test())
            elif kind in ("word", "phrase", "literal") or (kind, text) == ("op", "("):
                left = And(left, self.test())
            else:
                return left

    def test(self):
        kind, text = self.take()
        if (kind, text) == ("word", "NOT"):
            return Not(self.test())
        if (kind, text) == ("op", "("):
            inner = self.query()
            if self.take() != ("op", ")"):
                raise QueryError("a parenthesis is not closed")
            return inner
        if kind == "word" and text in ("AND", "OR"):
            raise QueryError(f"{text} needs a test before it")
        if kind == "word" and self.peek()[0] == "op" and self.peek()[1] in ("<", "<=", "=", ">=", ">", ":"):
            op = self.take()[1]
            name = unescape(text)
            if op == ":":
                return self.term(*self.take(), name)
            if name == "*":
                raise QueryError("a relation needs one index, not *")
            k, v = self.take()
            if k not in ("word", "phrase", "literal"):
                raise QueryError(f"{name}{op} needs a value")
            if k == "word" and re.search(r"[*?]", v):
                raise QueryError("a relation's value can't have wildcards")
            return Rel(op, name, _low(unescape(v if k == "word" else v[1:-1])))
        return self.term(kind, text, None)

    def term(self, kind: str, text: str, index: str | None):
        if kind == "phrase":
            words = T.query_words(unescape(text[1:-1]))
            if not words:
                return Nothing()
            return Term(words[0], index) if len(words) == 1 else Phrase(tuple(words), index)
        if kind == "literal":
            return Term(_low(unescape(text[1:-1])), index)
        if kind != "word":
            raise QueryError("a term is missing" if kind == "end" else f"unexpected {text!r}")
        if text == "*" and index is None:
            return All()
        key = _low(unescape(text))
        if self.wildcard and not key.endswith("*"):
            key += "*"
        return Term(key, index, bool(re.search(r"[*?]", key)))


def _low(s: str) -> str:
    return s.translate(str.maketrans(T.UPPER, T.LOWER))


def parse(query: str, wildcard: bool = False):
    """The tree of a query; an empty query matches nothing. ``wildcard`` appends * to each bare word."""
    tokens = lex(query)
    if not tokens:
        return Nothing()
    p = _Parser(tokens, wildcard)
    tree = p.query()
    if p.peek()[0] != "end":
        raise QueryError(f"unexpected {p.peek()[1]!r}")
    return tree


def relation(value: str, op: str, index: str):
    """A test from parts: op is one of : = == < <= > >=."""
    if op == ":":
        return Term(_low(value), index)
    if op not in ("=", "==", "<", "<=", ">", ">="):
        raise QueryError(f"unknown operator {op!r}")
    return Rel("=" if op == "==" else op, index, _low(value))


# ---- binding -------------------------------------------------------------------------------------


def bind(tree, c: Collection) -> None:
    """Raises for unknown indices and for operators that a kind has not."""
    if isinstance(tree, (And, Or)):
        bind(tree.a, c)
        bind(tree.b, c)
    elif isinstance(tree, Not):
        bind(tree.a, c)
    elif isinstance(tree, (Term, Phrase)) and tree.index not in (None, "*"):
        c.index(tree.index)
    elif isinstance(tree, (Rel, Range)):
        spec = c.index(tree.index)
        if spec.kind in (TEXT, WEIGHTED):
            raise IndexError_(f"{getattr(tree, 'op', 'a range')} can't be used on the text index {spec.name!r}")
        for v in [tree.value] if isinstance(tree, Rel) else [tree.low, tree.high]:
            if spec.kind == NUMBER and not re.fullmatch(r"[0-9]+", v):
                raise IndexError_(f"{v!r} is no number")


def _test(key: Column, spec, op: str, value: str) -> Column:
    if spec.kind == NUMBER:
        left, right = T.number(key), F.lit(value).cast("decimal(38,0)")
    else:
        left, right = key, F.lit(value)
    return {"<": left < right, "<=": left <= right, "=": left == right, ">=": left >= right, ">": left > right}[op]


# ---- tree to predicate ---------------------------------------------------------------------------


def _holds(spec, parts) -> Column:
    """Whether the lower-cased text holds each part anywhere: true of every text with such keys, and far cheaper than splitting it."""
    if spec.kind not in (TEXT, WEIGHTED) or spec.word or spec.many:
        return F.lit(True)
    low = F.coalesce(T.ascii_lower(F.col(spec.column).cast("string")), F.lit(""))
    return reduce(lambda a, b: a & b, [F.contains(low, F.lit(p)) for p in dict.fromkeys(parts) if p], F.lit(True))


def _splits(tree, c: Collection) -> int:
    """How often a test of one row has to split a text."""
    if isinstance(tree, (And, Or)):
        return _splits(tree.a, c) + _splits(tree.b, c)
    if isinstance(tree, Not):
        return _splits(tree.a, c)
    if not isinstance(tree, (Term, Phrase)):
        return 0
    specs = c.indices if tree.index in (None, "*") else [c.index(tree.index)]
    return sum(i.kind in (TEXT, WEIGHTED) and not i.word for i in specs)


def predicate(tree, c: Collection) -> Column:
    """The tree as a test of one row of ``c.keyed``."""
    one = lambda i: F.col(f"k_{i.name}")
    if isinstance(tree, All):
        return F.lit(True)
    if isinstance(tree, Nothing):
        return F.lit(False)
    if isinstance(tree, (And, Or)):  # what is cheap is tested first, and often decides
        a, b = (predicate(t, c) for t in sorted((tree.a, tree.b), key=lambda t: _splits(t, c)))
        return a & b if isinstance(tree, And) else a | b
    if isinstance(tree, Not):
        return ~predicate(tree.a, c)
    if isinstance(tree, Rel):
        spec = c.index(tree.index)
        return F.coalesce(F.exists(one(spec), lambda k: F.coalesce(_test(k, spec, tree.op, tree.value), F.lit(False))), F.lit(False))
    if isinstance(tree, Range):
        return predicate(And(Rel(">=", tree.index, tree.low), Rel("<=", tree.index, tree.high)), c)
    specs = c.indices if tree.index in (None, "*") else [c.index(tree.index)]
    if isinstance(tree, Term):
        if tree.glob:
            tests = [_holds(i, [T.glob_prefix(tree.key)]) & F.exists(one(i), lambda k: F.coalesce(T.glob_match(k, tree.key), F.lit(False))) for i in specs]
        else:
            tests = [_holds(i, [tree.key]) & F.coalesce(F.array_contains(one(i), tree.key), F.lit(False)) for i in specs]
    else:  # keys hold no spaces, so neighbouring keys are a substring of all keys joined by spaces
        wanted = F.lit(f" {' '.join(tree.words)} ")
        tests = [_holds(i, tree.words) & F.contains(F.concat(F.lit(" "), F.array_join(one(i), " ", "\x01"), F.lit(" ")), wanted) for i in specs if i.kind == TEXT]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


# ---- tree to set algebra -------------------------------------------------------------------------


def _leaf(entries: DataFrame, tree) -> DataFrame:
    return entries if tree.index in (None, "*") else entries.where(F.col("ix") == tree.index)


def documents(tree, c: Collection) -> DataFrame:
    """(doc_nr) of the matching documents, by set algebra over the stored postings."""
    nr = lambda df: df.select("doc_nr").distinct()
    entries = c.table("entries")
    if isinstance(tree, All):
        return c.docs.select("doc_nr")
    if isinstance(tree, Nothing):
        return c.docs.select("doc_nr").where(F.lit(False))
    if isinstance(tree, And):
        if isinstance(tree.b, Not):
            return documents(tree.a, c).join(documents(tree.b.a, c), "doc_nr", "left_anti")
        return documents(tree.a, c).join(documents(tree.b, c), "doc_nr", "left_semi")
    if isinstance(tree, Or):
        return documents(tree.a, c).union(documents(tree.b, c)).distinct()
    if isinstance(tree, Not):
        return c.docs.select("doc_nr").join(documents(tree.a, c), "doc_nr", "left_anti")
    if isinstance(tree, Range):
        return documents(And(Rel(">=", tree.index, tree.low), Rel("<=", tree.index, tree.high)), c)
    if isinstance(tree, Rel):
        spec = c.index(tree.index)
        return nr(entries.where(F.col("ix") == spec.name).where(_test(F.col("key"), spec, tree.op, tree.value)))
    if tree.index not in (None, "*"):
        entries = entries.where(F.col("ix") == c.index(tree.index).name)
    if isinstance(tree, Term):
        return nr(entries.where(T.glob_match("key", tree.key) if tree.glob else F.col("key") == tree.key))
    # A phrase of n words: its words' positions, each less its place, meet n times.
    words = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(tree.words)])
    found = entries.where((F.col("kind") == TEXT) & F.col("key").isin(*tree.words)).select("ix", "doc_nr", "key", F.explode("positions").alias("pos"))
    placed = found.select("*", F.explode(words).alias("x")).where("key = x.w").select("ix", "doc_nr", (F.col("pos") - F.col("x.i")).alias("start"), F.col("x.i").alias("i"))
    return nr(placed.groupBy("ix", "doc_nr", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(tree.words)))


# ---- entry points --------------------------------------------------------------------------------


class BooleanQuery:
    """A bound query over one collection; ``&``, ``|`` and ``~`` combine queries of the same collection."""

    def __init__(self, c: Collection, tree):
        bind(tree, c)
        self.c, self.tree = c, tree

    def _with(self, other: BooleanQuery, kind) -> BooleanQuery:
        if other.c is not self.c:
            raise QueryError("the queries are over different collections")
        return BooleanQuery(self.c, kind(self.tree, other.tree))

    def __and__(self, other):
        return self._with(other, And)

    def __or__(self, other):
        return self._with(other, Or)

    def __invert__(self):
        return BooleanQuery(self.c, Not(self.tree))

    def rows(self, valid_only: bool = False, ordered: bool = False) -> DataFrame:
        """The matching documents with all their columns, in the order of their numbers if asked for: that sorts the whole result."""
        if self.c.stored:
            got = self.c.docs.join(documents(self.tree, self.c), "doc_nr", "left_semi")
        else:
            got = self.c.keyed.where(predicate(self.tree, self.c)).select(*self.c.docs.columns)
        got = got.where("is_valid") if valid_only else got
        return got.orderBy("doc_nr") if ordered else got

    def page(self, offset: int = 0, n: int = 1000, valid_only: bool = False) -> DataFrame:
        """The n matching documents after ``offset`` in the order of their numbers, found with a limit."""
        if offset < 0:
            raise ValueError("can't skip backwards")
        return self.rows(valid_only, ordered=True).offset(offset).limit(n)

    def ids(self) -> DataFrame:
        return self.rows().select("doc_nr", "doc_id")

    def prefetch(self) -> DataFrame:
        """(doc_nr, doc_id) of the matching documents, worked out now and kept, for use in several plans."""
        return cut(self.ids())

    def count(self) -> DataFrame:
        return self.rows().agg(F.count("*").alias("n"))

    def estimate(self) -> int:
        """About the count, from document frequencies alone: unions add, intersections take the least, NOT takes the rest. One job for the whole query."""
        lexicon, leaves = self.c.table("lexicon"), []

        def leaf(t) -> int:
            if isinstance(t, (Rel, Range)):
                spec = self.c.index(t.index)
                rels = [t] if isinstance(t, Rel) else [Rel(">=", t.index, t.low), Rel("<=", t.index, t.high)]
                test = reduce(lambda a, b: a & b, [_test(F.col("key"), spec, r.op, r.value) for r in rels], F.col("ix") == spec.name)
            else:
                test = T.glob_match("key", t.key) if t.glob else F.col("key") == t.key
                if t.index not in (None, "*"):
                    test = (F.col("ix") == self.c.index(t.index).name) & test
            leaves.append(F.coalesce(test, F.lit(False)))
            return len(leaves) - 1

        def places(t):
            """The tree with its leaves' places."""
            if isinstance(t, (And, Or)):
                return (type(t), places(t.a), places(t.b))
            if isinstance(t, Not):
                return (Not, places(t.a))
            if isinstance(t, (All, Nothing)):
                return (type(t),)
            if isinstance(t, Phrase):
                return reduce(lambda a, b: (And, a, b), [(Term, leaf(Term(w, t.index))) for w in t.words])
            return (Term, leaf(t))

        tree = places(self.tree)
        total = self.c.size_column()
        sums: list[int] = []
        if leaves:
            of_leaves = lexicon.where(reduce(lambda a, b: a | b, leaves)).agg(*[F.coalesce(F.sum(F.when(p, F.col("df"))), F.lit(0)) for p in leaves], total)
            *sums, n = of_leaves.first()
        else:
            n = self.c.docs.count()

        def of(t) -> int:
            kind, *rest = t
            if kind is And:
                return min(of(rest[0]), of(rest[1]))
            if kind is Or:
                return min(n, of(rest[0]) + of(rest[1]))
            if kind is Not:
                return n - of(rest[0])
            return n if kind is All else 0 if kind is Nothing else min(n, sums[rest[0]])

        return of(tree)


def find(c: Collection, query: str, wildcard: bool = False) -> BooleanQuery:
    return BooleanQuery(c, parse(query, wildcard))


def match(c: Collection, value: str, index: str | None = None) -> BooleanQuery:
    return BooleanQuery(c, Term(_low(value), index))


def match_relation(c: Collection, value: str, op: str, index: str) -> BooleanQuery:
    return BooleanQuery(c, relation(value, op, index))
