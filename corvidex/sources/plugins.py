"""What users add: record parsers and result formatters, by name."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from . import records

PARSERS: dict[str, Parser] = {}
FORMATTERS: dict[str, Formatter] = {}


class Parser:
    """A parser of raw text. A subclass overrides ``parse``; one made from a declarative format needs nothing else."""

    name, url, section, meta = "", "", "", ("title",)
    format: records.Format | None = None

    def __init__(self, fmt: records.Format | None = None):
        if fmt is not None:
            self.format, self.name, self.meta = fmt, fmt.name, fmt.meta

    def raw_files(self, path: str) -> str:
        """A regular expression of the names of the files to read."""
        return "."

    def parse(self, text: str) -> Iterator[dict]:
        """Rows of ``records.SCHEMA`` from a text that holds whole records."""
        for part in records.split(text, self.format):
            if row := records.parse_record(self.format, part):
                yield row

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        """All records below a path. Formats whose records end with a line are split by Spark's reader, others by whole files."""
        names = self.raw_files(path)
        end = self.format.end if self.format else None
        if self.format and self.format.columns:
            raw = records.read_lines(spark, path, name_regex=names).select("value")
        elif end and not end.startswith("^"):
            raw = records.read_records(spark, path, f"\n{end}\n")
        else:
            raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
        return self.rows(raw)

    def rows(self, raw: DataFrame, column: str = "value") -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame([r for x in f[column].dropna() for r in self.parse(x)], columns=["doc_id", "text", "meta", "entries", "seqs"])

        return raw.select(column).mapInPandas(run, records.SCHEMA)


def register_parser(p: Parser) -> Parser:
    PARSERS[p.name] = p
    return p


def parser(name: str) -> Parser:
    if name not in PARSERS:
        raise KeyError(f"no parser {name!r}; there are {sorted(PARSERS)}")
    return PARSERS[name]


for _f in records.FORMATS.values():
    register_parser(Parser(_f))


class Formatter:
    """How a document is shown: ``pp`` (pretty print), ``describe`` (a title), ``sequence``, and the indices' display names."""

    name = "default"
    index_names: dict[str, str] = {}

    def pp(self, text: Column) -> Column:
        return T.html_entry(text)

    def describe(self, text: Column, title: Column) -> Column:
        """The stored title, else the first seven lines."""
        return F.coalesce(title, T.first_lines(text))

    def sequence(self, doc_id: Column, title: Column, seq: Column) -> Column:
        return T.fasta(doc_id, title, seq)

    def index_name(self, code: Column) -> Column:
        if not self.index_names:
            return code
        pairs = F.create_map(*[F.lit(x) for kv in self.index_names.items() for x in kv])
        return F.coalesce(pairs[code], code)


def register_formatter(f: Formatter) -> Formatter:
    FORMATTERS[f.name] = f
    return f


register_formatter(Formatter())


def formatter(name: str = "default") -> Formatter:
    return FORMATTERS.get(name, FORMATTERS["default"])


#: What reads each file by its extension. Spark's text reader does all but the last by itself; that one is read by ``compress.read_lines``.
CODECS = {".gz": "gzip", ".bz2": "bzip2", ".deflate": "deflate", ".zst": "zstd", ".lz4": "lz4", ".snappy": "snappy", ".Z": "compress"}


def codec(path: str) -> str | None:
    """The codec of a file by its extension; None for plain text."""
    return CODECS.get(os.path.splitext(path)[1])
