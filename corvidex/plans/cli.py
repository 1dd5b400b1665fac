"""The command line: ``python -m corvidex ACTION …``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import ranked as R, sequence as S, spelling
from ..operators.collection import Collection, merged
from ..sources import plugins, records
from ..sources.store import Registry
from . import language as L
from .service import Service

VERSION = "1.0"


def _print(rows: DataFrame) -> None:
    """Prints a bounded result as tab-separated lines, row by row."""
    for r in rows.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in r))


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("corvidex", description=__doc__)
    sub = p.add_subparsers(dest="action", required=True)

    def action(name: str, about: str, *names: str) -> argparse.ArgumentParser:
        a = sub.add_parser(name, help=about)
        for n in names:
            a.add_argument(n)
        return a

    a = action("create", "parse files and store a collection", "format", "source", "path")
    a.add_argument("--stop-words", help="a file with a word a line")
    a = action("merge", "merge stored collections", "path")
    a.add_argument("parts", nargs="+")
    a.add_argument("--strict", action="store_true")
    a = action("query", "boolean query, or ranked if terms are given", "path", "query")
    a.add_argument("--terms", nargs="*", default=[])
    a.add_argument("--algorithm", default="vector", choices=R.ALGORITHMS)
    a.add_argument("--any", action="store_true", help="documents need not hold all terms")
    a.add_argument("-n", type=int, default=15)
    a.add_argument("--offset", type=int, default=0)
    a.add_argument("--wildcard", action="store_true")
    a = action("entry", "show a document", "path", "id")
    a.add_argument("--format", default="plain", choices=("plain", "title", "html", "fasta"))
    a = action("blast", "protein search", "path", "sequence")
    a.add_argument("--filter")
    a.add_argument("--expect", type=float, default=10.0)
    a.add_argument("--xml", action="store_true")
    action("info", "information on a collection", "path")
    a = action("dict", "words for spelling suggestions", "path")
    a.add_argument("--shortest", type=int, default=2)
    a.add_argument("--least-df", type=int, default=1)
    action("dump_index", "keys with their document frequencies", "path", "index")
    action("spellcheck", "suggestions for a word", "path", "word")
    action("version", "print the version")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = _parser().parse_args(argv)
    if o.action == "version":
        print(VERSION)
        return
    spark = spark or SparkSession.builder.appName("corvidex").getOrCreate()
    if o.action == "create":
        stop: tuple[str, ...] = ()
        if o.stop_words:
            stop = tuple(sorted({w[0].lower() for r in spark.read.text(o.stop_words).collect() if (w := r["value"].split())}))
        records.collection(plugins.parser(o.format).read(spark, o.source), o.format, stop).save(o.path)
        return
    if o.action == "merge":
        merged([Collection.open(spark, x) for x in o.parts], o.strict).save(o.path)
        return
    c = Collection.open(spark, o.path)
    registry = Registry()
    registry.add("opened", c)  # a merged collection's own name holds a +, which would open several
    service = Service(registry)
    if o.action == "query":
        if o.terms:
            _print(service.find(c.name, o.terms, o.algorithm, not o.any, None if o.query == "*" else o.query, o.offset, o.n).orderBy(F.desc("score"), "doc_nr").select("doc_id", "score", "title"))
        else:
            _print(L.find(c, o.query, o.wildcard).ids().orderBy("doc_nr").offset(o.offset).limit(o.n).select("doc_id"))
    elif o.action == "entry":
        _print(service.entry(c.name, o.id, o.format))
    elif o.action == "blast":
        if c.sequences is None:
            sys.exit(f"{o.path} has no sequences")
        only = L.find(c, o.filter).ids().select("doc_nr") if o.filter else None
        hits = S.blast(c.sequences, o.sequence, S.Parameters(expect=o.expect), only)
        _print(S.report_xml(hits) if o.xml else hits.select("doc_nr", "score", "bits", "expect", "identity", "gaps"))
    elif o.action == "info":
        _print(c.information().union(service.databank_info().select(F.lit("documents"), F.col("n_docs").cast("string"))))
        _print(service.indices(c.name).orderBy("ix"))
    elif o.action == "dict":
        _print(spelling.dictionary(c, None, o.shortest, o.least_df).orderBy("key"))
    elif o.action == "dump_index":
        _print(c.keys(o.index).orderBy("key"))
    elif o.action == "spellcheck":
        _print(spelling.suggest(c, o.word))
