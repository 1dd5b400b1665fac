"""Ranked retrieval by TF·IDF with vector, Dice or Jaccard normalization, and what builds on it."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from .collection import TEXT, TOP_WEIGHT, WEIGHTED, Collection
from .lineage import cut

ALGORITHMS = ("vector", "dice", "jaccard")
#: Query terms up to which their table is broadcast; longer queries are joined by a shuffle.
MOST_TERMS = 50_000
#: Documents up to which their numbers are broadcast to find their words; more are joined by a shuffle.
MOST_DOCUMENTS = 1_000_000
#: Query terms up to which the keys are pushed down to the scan of the postings.
MOST_PUSHED = 500
DEFAULT_RESULTS = 1000
#: The usual shares of the best contribution for pruning.
PRUNE = (0.007, 0.12)


def query_weights(counts: dict[str, int]) -> dict[str, int]:
    """floor(31 f / the largest f); terms whose weight is 0 drop out and are not required."""
    if not counts:
        return {}
    top = max(counts.values())
    got = {k: (TOP_WEIGHT * f) // top for k, f in counts.items()}
    return {k: w for k, w in got.items() if w}


def terms_of(text: str) -> dict[str, int]:
    """Counts of the tokens of a query text, split as documents are."""
    import re

    out: Counter = Counter()
    for t in re.findall(T.TOKEN, text.translate(str.maketrans(T.UPPER, T.LOWER))):
        out.update(re.findall(T.TOKEN, t.replace("-", " ")) if t.count("-") == 1 else [t])
    return dict(out)


def split_terms(words: list[str]) -> tuple[dict[str, int], list[str]]:
    """(counts, globs): terms with wildcards go to the boolean filter, terms with one hyphen count as two."""
    counts: Counter = Counter()
    globs = []
    for w in words:
        w = w.translate(str.maketrans(T.UPPER, T.LOWER))
        if "*" in w or "?" in w:
            globs.append(w)
        elif w.count("-") == 1 and all(w.split("-")):
            counts.update(w.split("-"))
        else:
            counts[w] += 1
    return dict(counts), globs


class Ranked:
    """A ranked query: terms with counts over the union of all indices of a collection."""

    def __init__(self, c: Collection, counts: dict[str, int] | None = None, terms: DataFrame | None = None, few: bool = False):
        """``terms`` (key, freq) is a table in place of counts; ``few``: it is to be broadcast."""
        self.c, self.counts, self._terms, self.few = c, {}, terms, few or terms is None
        for k, f in (counts or {}).items():
            self.add(k, f)

    def add(self, key: str, freq: int = 1) -> Ranked:
        key = key.translate(str.maketrans(T.UPPER, T.LOWER))
        self.counts[key] = self.counts.get(key, 0) + freq
        return self

    def add_text(self, text: str) -> Ranked:
        for k, f in terms_of(text).items():
            self.add(k, f)
        return self

    def weighted(self) -> DataFrame:
        """(key, qw) of the terms that count."""
        if self._terms is not None:
            top = self._terms.agg(F.max("freq")).scalar()
            return self._terms.select("key", F.floor(F.col("freq") * TOP_WEIGHT / top).cast("int").alias("qw")).where("qw > 0")
        rows = sorted(query_weights(self.counts).items())
        return self.c.spark.createDataFrame(rows, "key string, qw int")

    def scores(self, algorithm: str = "vector", all_terms: bool = False, meta: DataFrame | None = None, valid_only: bool = True, prune: float | tuple[float, float] | None = None) -> DataFrame:
        """(doc_nr, rank) of every document with a term (or all terms), unordered; rank is 0 to 1 before scaling.

        ``meta`` (doc_nr) restricts the documents. A required term that is missing everywhere empties the
        result unless it is a stop word. ``prune`` (add, insert; as one number: both; ``PRUNE`` has the usual ones)
        makes the result approximate: postings below the first share of the best contribution are left out, and those
        below the second count only for documents that have one above it. By default the result is exact.
        """
        if algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {algorithm!r}")
        terms = self.weighted()
        small = self.few and len(self.counts) <= MOST_TERMS
        self.c.settle()
        postings = self.c.table("all_text")
        if self._terms is None and len(self.counts) <= MOST_PUSHED:  # reaches the scan, whose row groups are sorted by key
            postings = postings.where(F.col("key").isin(*query_weights(self.counts)))
        hits = postings.join(F.broadcast(terms) if small else terms, "key")
        df = hits.groupBy("key", "qw").agg(F.count("*").alias("df"), F.max("w").alias("top"))
        wq = df.select("key", (F.log(1 + self.c.size_column() / F.col("df")) * F.col("qw")).alias("wq"), F.log(1 + self.c.size_column() / F.col("df")).alias("idf"), "top")
        norm = wq.agg(F.sqrt(F.sum(F.pow("wq", F.lit(2))))).scalar()
        parts = hits.join(F.broadcast(wq) if small else wq, "key").select("doc_nr", "key", "wq", (F.col("idf") * F.col("w") * F.col("wq")).alias("sd"))
        found = parts.groupBy("doc_nr")
        if prune:
            add, insert = prune if isinstance(prune, tuple) else (prune, prune)
            best = wq.agg(F.max(F.col("idf") * F.col("wq") * F.col("top"))).scalar()
            reach = F.col("sd") * F.col("wq")
            found = parts.where(reach >= best * add).groupBy("doc_nr").agg(F.sum("sd").alias("a"), F.count("*").alias("n"), F.max(reach >= best * insert).alias("in")).where("in").drop("in")
        else:
            found = found.agg(F.sum("sd").alias("a"), F.count("*").alias("n"))
        if all_terms:
            if self._terms is None:
                needed = F.lit(sum(k not in self.c.stop for k in query_weights(self.counts)))
            else:
                needed = terms.where(~F.col("key").isin(*self.c.stop)).agg(F.count("*")).scalar() if self.c.stop else terms.agg(F.count("*")).scalar()
            found = found.where(F.col("n") == needed)
        if meta is not None:
            found = found.join(meta.select("doc_nr"), "doc_nr", "left_semi")
        if valid_only:
            found = found.join(self.c.docs.where("is_valid").select("doc_nr"), "doc_nr", "left_semi")
        a, wd = F.col("a"), F.col("wd")
        rank = {"vector": a / (wd * norm), "dice": 2 * a / (wd * wd + norm * norm), "jaccard": a / (wd * wd + norm * norm - a)}[algorithm]
        return found.join(self.c.table("doc_weights"), "doc_nr").select("doc_nr", rank.alias("rank"))

    def top(self, n: int = DEFAULT_RESULTS, offset: int = 0, with_total: bool = False, **options) -> DataFrame:
        """(doc_nr, doc_id, score): the best n after ``offset``, by score, then document number; score is 100 x rank."""
        got = self.scores(**options)
        cols = [(F.round(F.col("rank") * 100, 6)).alias("score")]
        if with_total:
            cols.append(got.agg(F.count("*")).scalar().alias("total"))
        best = got.orderBy(F.desc(F.round(F.col("rank") * 100, 6)), "doc_nr").offset(offset).limit(n)
        # The join deals the rows out anew, so the few that are left are sorted again.
        return best.join(self.c.docs.select("doc_nr", "doc_id"), "doc_nr").select("doc_nr", "doc_id", *cols).orderBy(F.desc("score"), "doc_nr")


def similar(c: Collection, doc_nr: int) -> Ranked:
    """The words of a document as a query over the collection (its text indices; the document itself is found too).

    They are taken from the document's own row; the postings are sorted by key, and finding a document there would read them all.
    """
    one = Collection(c.docs.where(F.col("doc_nr") == doc_nr), [i for i in c.indices if i.kind in (TEXT, WEIGHTED)], c.stop)
    return Ranked(c, terms=one.tokens().groupBy("key").agg(F.count("*").alias("freq")), few=True)


def similar_to_text(c: Collection, text: str) -> Ranked:
    return Ranked(c).add_text(text)


def find_all(cs: list[Collection], query: Ranked | dict[str, int], n: int = 5, ignore: tuple[str, ...] = (), **options) -> DataFrame:
    """(db, doc_id, score, place, total, best): the best n of each collection with its number of hits, by ``best``, collection and place."""
    counts = query.counts if isinstance(query, Ranked) else query
    each = []
    for c in cs:
        if c.name not in ignore:
            got = Ranked(c, counts).scores(**options).join(c.docs.select("doc_nr", "doc_id"), "doc_nr")
            each.append(got.select(F.lit(c.name).alias("db"), "doc_nr", "doc_id", F.round(F.col("rank") * 100, 6).alias("score")))
    rows = reduce(lambda a, b: a.union(b), each)
    place = F.row_number().over(Window.partitionBy("db").orderBy(F.desc("score"), "doc_nr"))
    ranked = rows.withColumn("place", place).where(F.col("place") <= n)
    sums = rows.groupBy("db").agg(F.count("*").alias("total"), F.max("score").alias("best"))
    return ranked.join(sums, "db").select("db", "doc_id", "score", "place", "total", "best").orderBy(F.desc("best"), "db", "place")


def hits_per_collection(cs: list[Collection], query: dict[str, int]) -> DataFrame:
    """(db, total): how many documents of each collection match."""
    each = [Ranked(c, query).scores().agg(F.count("*").alias("total")).select(F.lit(c.name).alias("db"), "total") for c in cs]
    return reduce(lambda a, b: a.union(b), each)


def cooccurrence(c: Collection, docs: DataFrame, n: int = 20, offset: int = 0) -> DataFrame:
    """(key, n_docs, score): words in at least two of the documents (doc_nr), by count x idf; numbers are left out."""
    chosen = cut(docs.select("doc_nr").distinct())
    few = chosen.count() <= MOST_DOCUMENTS
    own = c.table("all_text").join(F.broadcast(chosen) if few else chosen, "doc_nr", "left_semi").where(~T.is_number("key"))
    common = own.groupBy("key").agg(F.count("*").alias("n_docs")).where("n_docs > 1")
    scored = common.join(c.idf(), "key").select("key", "n_docs", F.round(F.col("n_docs") * F.col("idf"), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "key").offset(offset).limit(n)
