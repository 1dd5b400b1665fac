"""The search service: what a client asks of a set of collections, each answer a DataFrame."""

from __future__ import annotations

import inspect
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import ranked as R, spelling
from ..operators.collection import Collection
from ..sources.plugins import formatter, parser
from ..sources.store import Registry
from . import language as L

PAGE = 15


def _filter(c: Collection, globs: list[str], text: str | None) -> DataFrame | None:
    """The documents of the boolean filter and of all wildcard terms; None if there is no filter."""
    trees = [L.parse(g) for g in globs] + ([L.parse(text)] if text else [])
    if not trees:
        return None
    return L.BooleanQuery(c, reduce(L.And, trees)).ids().select("doc_nr")


class Service:
    def __init__(self, registry: Registry):
        self.registry = registry

    def databank_info(self, db: str = "all") -> DataFrame:
        """(db, n_docs, raw_bytes, n_indices)."""
        names = self.registry.names() if db == "all" else [db]
        each = [(c := self.registry.open(n)).statistics().select(F.lit(n).alias("db"), "n_docs", "raw_bytes", F.lit(len(c.indices)).alias("n_indices")) for n in names]
        return reduce(lambda a, b: a.union(b), each)

    def status(self) -> DataFrame:
        """(db, stored, built_at, searched_with_all) of every collection; built_at: when its info was written, null if it is not stored."""
        rows = []
        for n in self.registry.names():
            c, built = self.registry.open(n), None
            if c.stored:
                at = c.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{c.stored}/info")
                built = at.getFileSystem(c.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime() / 1000
            rows.append((n, c.stored, built, n not in self.registry.left_out()))
        spark = self.registry.open(rows[0][0]).spark
        return spark.createDataFrame(rows, "db string, stored string, built double, searched_with_all boolean").select("db", "stored", F.col("built").cast("timestamp").alias("built_at"), "searched_with_all")

    @staticmethod
    def parser_text(name: str) -> str:
        """What is declared of a record format, or the source of a parser of one's own."""
        p = parser(name)
        return repr(p.format) if p.format is not None else inspect.getsource(type(p))

    def indices(self, db: str) -> DataFrame:
        """(ix, kind, name, n_keys, n_postings) of every index; ``name`` is its display name."""
        c = self.registry.open(db)
        kinds = c.spark.createDataFrame([(i.name, i.kind) for i in c.indices], "ix string, kind string")
        got = kinds.join(c.index_statistics(), "ix", "left").select("ix", "kind", formatter(db).index_name(F.col("ix")).alias("name"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_keys", "n_postings")])
        return got

    def entry(self, db: str, doc_id: str, format: str = "plain") -> DataFrame:
        """(value): a document as plain, title, html or fasta."""
        c, f = self.registry.open(db), formatter(db)
        rows = c.lookup(doc_id)
        title = F.col(c.meta[0]) if c.meta else F.lit(None).cast("string")
        if format == "plain":
            return rows.select(F.col("text").alias("value"))
        if format == "title":
            return rows.select(f.describe(F.col("text"), title).alias("value"))
        if format == "html":
            return rows.select(f.pp(F.col("text")).alias("value"))
        if format == "fasta":
            if c.sequences is None:
                raise ValueError(f"{db} has no sequences")
            return rows.join(c.sequences, "doc_nr").orderBy("seq_nr").select(f.sequence(F.col("doc_id"), title, F.col("seq")).alias("value"))
        raise ValueError(f"unknown format {format!r}")

    def find(self, db: str, terms: list[str], algorithm: str = "vector", all_terms: bool = True, filter: str | None = None, offset: int = 0, n: int = PAGE, with_total: bool = False) -> DataFrame:
        """(doc_nr, doc_id, score[, total], title): terms with wildcards only filter; terms with one hyphen count as two. Wildcards alone give an unranked page."""
        c = self.registry.open(db)
        counts, globs = R.split_terms(terms)
        only = _filter(c, globs, filter)
        title = (F.col(c.meta[0]) if c.meta else F.lit(None)).cast("string").alias("title")
        docs = c.docs.select("doc_nr", title)
        if not counts:
            rows = c.docs.where("is_valid") if only is None else c.docs.where("is_valid").join(only, "doc_nr", "left_semi")
            extra = [rows.agg(F.count("*")).scalar().alias("total")] if with_total else []
            return rows.orderBy("doc_nr").offset(offset).limit(n).select("doc_nr", "doc_id", F.lit(1.0).alias("score"), *extra, title)
        got = R.Ranked(c, counts).top(n, offset, with_total, algorithm=algorithm, all_terms=all_terms, meta=only)
        return got.join(docs, "doc_nr").orderBy(F.desc("score"), "doc_nr")

    def find_similar(self, db: str, doc_id: str, algorithm: str = "vector", offset: int = 0, n: int = PAGE) -> DataFrame:
        """(doc_nr, doc_id, score): documents like one of the collection."""
        c = self.registry.open(db)
        text = c.lookup(doc_id).select("text").first()
        if text is None:
            raise KeyError(f"{db} has no document {doc_id!r}")
        return R.similar_to_text(c, text["text"] or "").top(n, offset, algorithm=algorithm)

    def find_all(self, terms: list[str], algorithm: str = "vector", all_terms: bool = True, filter: str | None = None, n: int = 5) -> DataFrame:
        """(db, doc_id, score, place, total, best) over all collections that a search over all includes."""
        counts, globs = R.split_terms(terms)
        each = [R.find_all([c], counts, n, algorithm=algorithm, all_terms=all_terms, meta=_filter(c, globs, filter)) for c in self.registry.all()]
        return reduce(lambda a, b: a.union(b), each).orderBy(F.desc("best"), "db", "place")

    def find_all_similar(self, db: str, doc_id: str, algorithm: str = "vector", n: int = 5) -> DataFrame:
        """Documents like one of a collection, in all collections."""
        text = self.registry.open(db).lookup(doc_id).select("text").first()
        if text is None:
            raise KeyError(f"{db} has no document {doc_id!r}")
        return R.find_all(self.registry.all(), R.terms_of(text["text"] or ""), n, algorithm=algorithm).orderBy(F.desc("best"), "db", "place")

    def count(self, db: str, boolean: str) -> DataFrame:
        return L.find(self.registry.open(db), boolean).count()

    def cooccurrence(self, db: str, ids: list[str], n: int = 20, offset: int = 0) -> DataFrame:
        c = self.registry.open(db)
        low = [i.lower() for i in ids]
        return R.cooccurrence(c, c.docs.where(F.lower("doc_id").isin(*low)), n, offset)

    def spell_check(self, db: str, word: str, n: int = 20) -> DataFrame:
        return spelling.suggest(self.registry.open(db), word, n)
