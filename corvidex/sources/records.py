"""Raw text to documents: reading files, splitting records, and declarative formats of flat-file databanks.

A format says where records end, how a line gives a field code and a value, and
what each field becomes. ``parse`` gives one row a record: doc_id, text, meta,
entries (ix, kind, token, pos) and seqs; a record without an id gets none and is
later named by its number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .rules import DATE, NUMBER, NUMS, RULES, TEXT, VALUE, WORD, Row, dates

SCHEMA = "doc_id string, text string, meta map<string,string>, entries array<struct<ix:string,kind:string,token:string,pos:int>>, seqs array<string>"


def read_lines(spark: SparkSession, path: str, name_pattern: str | None = None, name_regex: str | None = None) -> DataFrame:
    """(value, file): lines of plain, gzip or bzip2 text files, of those whose names match."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if name_pattern:
        reader = reader.option("pathGlobFilter", name_pattern)
    rows = reader.text(path).withColumn("file", F.input_file_name())
    return rows.where(F.rlike(F.element_at(F.split("file", "/"), -1), F.lit(name_regex))) if name_regex else rows


def read_records(spark: SparkSession, path: str, separator: str = "\n//\n") -> DataFrame:
    """(value): records of text files, split by Spark's own reader, so that large uncompressed files are read in parallel."""
    return spark.read.option("lineSep", separator).text(path)


@dataclass(frozen=True)
class Format:
    """A record format. ``line`` has groups for a code and a value; a line that doesn't match goes on with the last field."""

    name: str
    end: str = "//"
    line: str = r"^([A-Z]{2})(?:   (.*))?$"
    fields: dict = field(default_factory=dict)
    default: tuple | None = (TEXT, None)
    id: str = "ID"
    id_pattern: str = r"^\s*([^\s;]+)"
    title: str | None = "DE"
    columns: tuple = ()
    separator: str = "\t"
    sequence: str | None = None
    meta: tuple = ("title",)
    id_record: str | None = None


def iso_date(value: str) -> str | None:
    """dd-MON-yyyy, yyyymmdd, yyyy/mm/dd or yyyy-mm-dd as yyyy-mm-dd."""
    return next(iter(dates(value)), None)


def _fields(spec: Format, record: str) -> Iterator[tuple[str, str]]:
    """(code, value) of a record, with continued lines joined."""
    if spec.columns:
        yield from ((c, v.strip()) for c, v in zip(spec.columns, record.split(spec.separator)) if c and v.strip())
        return
    code, held = None, []
    for raw in record.split("\n"):
        m = re.match(spec.line, raw)
        if m and m[1] and m[1].strip() and m[1].strip() != code:
            if code is not None:
                yield code, "\n".join(held)
            code, held = m[1].strip(), [m[2] or ""]
        elif code is not None:
            held.append((m[2] or "") if m and m[1] is not None and m.lastindex and m.lastindex > 1 else raw.strip())
    if code is not None:
        yield code, "\n".join(held)


def parse_record(spec: Format, record: str) -> dict | None:
    """One record's row; None for a blank one."""
    record = record.strip("\n")
    if not record.strip():
        return None
    row, rule = Row(), RULES.get(spec.name)
    if spec.name in ("fasta", "uniuniq", "uniseq"):
        head, *rest = record.lstrip(">").split("\n")
        name, _, row.title = head.partition(" ")
        row.doc_id = re.split(r"[|]", name)[-1] or name
        row.add(VALUE, "id", row.doc_id)
        row.add(TEXT, "title" if spec.name == "fasta" else "text", row.title)
        row.seqs.append(re.sub(r"[\s*]", "", "".join(rest)).upper())
    else:
        for code, value in _fields(spec, record):
            if rule and rule(code, value, row):
                continue
            if code == spec.sequence:
                row.seqs.append(re.sub(r"[^A-Za-z]", "", value.partition("\n")[2] if "\n" in value else value).upper())
                continue
            if code == spec.id and row.doc_id is None and (m := re.search(spec.id_pattern, value)):
                row.doc_id = m[1]
                row.add(VALUE, "id", row.doc_id)
                if spec.columns:
                    continue
            if code == spec.title and row.title is None:
                row.title = re.sub(r"\s+", " ", value).strip()
            kind, ix = spec.fields.get(code, spec.default or (None, None))
            if kind and code != spec.id:
                row.add(kind, ix or re.sub(r"\W", "", code.lower()), value)
    if row.doc_id is None and spec.id_record and (m := re.search(spec.id_record, record, re.M)):
        row.doc_id = m[1]
        row.add(VALUE, "id", row.doc_id)
    return {"doc_id": row.doc_id, "text": record, "meta": {"title": row.title} if row.title else {}, "entries": row.entries, "seqs": [s for s in row.seqs if s]}


def parse(raw: DataFrame, spec: Format, column: str = "value") -> DataFrame:
    """Rows of ``SCHEMA`` from a column that holds one or more whole records a row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for text in f[column].dropna() for part in split(text, spec) if (r := parse_record(spec, part))]
            yield pd.DataFrame(rows, columns=["doc_id", "text", "meta", "entries", "seqs"])

    return raw.select(column).mapInPandas(run, SCHEMA)


def split(text: str, spec: Format) -> list[str]:
    """The records of a text. An end like ``^>`` starts the next record; others close the record before."""
    if spec.columns:
        return [x for x in text.split("\n") if x and not x.startswith(("!", "#"))]
    if spec.end.startswith("^"):
        return [x for x in re.split(f"(?m)(?={spec.end})", text) if x.strip()]
    return [x for x in re.split(rf"(?m)^{re.escape(spec.end)}[^\n]*$", text) if x.strip()]


def entries_of(parsed: DataFrame, ix: str) -> DataFrame:
    """(doc_id, token): the values of one index."""
    return parsed.select("doc_id", F.explode("entries").alias("e")).where(F.col("e.ix") == ix).select("doc_id", "e.token")


_COLON = r"^([A-Za-z][\w .-]*?)\s*:\s*(.*)$"
_WIDE = r"^([A-Z][A-Z_]{1,11})(?:\s+(.*))?$"
_t, _n, _w, _d, _m = TEXT, NUMS, WORD, DATE, NUMBER
FORMATS: dict[str, Format] = {
    f.name: f
    for f in (
        Format("simple", line=r"^([^\t]+)\t(.*)$", title="TITLE"),
        Format("dbest", "||", _COLON, {"GenBank gi": (_n, "genbank_gi"), "GenBank Acc": (_n, "genbank_acc"), "Clone Id": (_t, "clone"), "Source": (_n, "source"), "Organism": (_t, "organism"), "Lib Name": (_n, "lib_name"), "dbEST lib id": (_n, "lib_id"), "DNA type": (_t, "dna_type"), "Map": (_n, "chr"), "GDB Id": (_n, "gdb"), "EST name": (_n, "source_est")}, (_t, "text"), "dbEST Id", title="EST name"),
        Format("dssp", "^==== ", _WIDE, {"REFERENCE": (_t, "ref")}, (_t, "text"), "HEADER", r"(\S+)\s*\.?\s*$", "COMPND"),
        Format("embl", fields={"DE": (_t, "de")}),
        Format("enzyme", fields={"DE": (_t, "de")}),
        Format("fasta", "^>"),
        Format("genbank", line=r"^ {0,2}([A-Z][A-Z_]{1,11})(?:\s+(.*))?$", id="ACCESSION", title="DEFINITION", sequence="ORIGIN"),
        Format("gene", "^Entrezgene", _COLON, {"create-date": (_d, "created"), "update-date": (_d, "updated")}, (_t, "text"), "geneid", title="desc"),
        Format("go", r"^\[Term\]", r"^(\w+):\s*(.*)$", {"is_a": (_n, "is_a"), "name": (_n, "name"), "def": (_n, "def")}, (_n, None), "id", title="name"),
        Format("goa", columns=("db", "acc", "id", "qualifier", "goid", "db_reference", "evidence", "with", "aspect", "db_object_name", "synonym", "db_object_type", "taxon_id", "date", "assigned_by"), fields={"goid": (_w, "goid"), "date": (_d, "date"), "taxon_id": (_n, "taxon_id")}, id="id", title="db_object_name"),
        Format("hssp", "^HSSP ", r"^(\w+)\s+(.*)$", {"SEQLENGTH": (_m, "seqlength"), "NCHAIN": (_m, "nchain"), "NALIGN": (_m, "nalign")}, (_t, "text"), "PDBID", title="HEADER"),
        Format("hugo", columns=("id", "symbol", "name", "map", "mim", "pmid1", "pmid2", "refseq", "aliases", "withdrawn", "locuslink", "gdb", "swissprot"), default=(_n, None), id="id", title="name"),
        Format("interpro", "^<interpro ", r"^\s*<(\w+)[^>]*>(.*?)(?:</\w+>)?$", {"type": (_t, "type"), "name": (_t, "name"), "db_xref": (_t, "xref"), "taxon_data": (_t, "taxon"), "classification": (_t, "class"), "abstract": (_t, "abstract"), "rel_ref": (_t, "rel")}, (_t, None), "interpro", title="name", id_record=r"<interpro[^>]*?\sid=\"(\w+)\""),
        Format("ligand", "///", _WIDE, {"NAME": (_t, "name")}, (_t, None), "ENTRY", title="NAME"),
        Format("locuslink", "^>>", r"^(\w+):\s*(.*)$", {}, (_t, None), "LOCUSID", title="OFFICIAL_GENE_NAME"),
        Format("mimmap", columns=("id", "month", "day", "year", "location", "symbol", "status", "title", "", "mim", "method", "comments"), separator="|", fields={"mim": (_w, "mim")}, id="id", title="title"),
        Format("omim", r"^\*RECORD\*", r"^\*FIELD\*\s+(\w\w)\s*(.*)$", {}, (_t, None), "NO", r"(\d+)", None),
        Format("oxford", columns=("id", "llhid", "hsym", "loc", "acc", "llmid", "msym", "chr", "cm", "cb", "data"), fields={"llhid": (_t, "llhid"), "loc": (_n, "loc")}, default=(_n, None), id="id", title="hsym"),
        Format("pdb", "^HEADER", r"^([A-Z]+\d?)(?:\s+(.*))?$", {}, None, "HEADER", title=None),
        Format("pdbfinder2", line=r"^\s*([\w-]+)\s*:\s*(.*)$", fields={"Date": (_d, "date"), "Resolution": (_m, "resolution"), "T-Nres-Prot": (_m, "tnresprot")}, title="Header"),
        Format("pfam", line=r"^#=GF (\w\w)\s+(.*)$", fields={"AC": (VALUE, "ac"), "SQ": (_m, "nseq"), "RT": (_t, "ref"), "RA": (_t, "ref"), "RL": (_t, "ref")}),
        Format("pmc", "^<article[ >]", r"^\s*<([\w-]+)[^>]*>(.*?)(?:</[\w-]+>)?$", {"article-title": (_t, "title"), "subject": (_t, "subject"), "abstract": (_t, "abstract"), "body": (_t, "body"), "aff": (_t, "aff")}, (_t, "text"), "article-id", r"(\S+)", "article-title"),
        Format("prints", "^gc; ", r"^(\w\w);\s*(.*)$", {}, (_t, None), "gc", title="gt"),
        Format("prosite", title="DE"),
        Format("prosite_doc", r"^\{PDOC", r"^\{(\w+?)(?:;\s*(.*))?\}$", {}, (_t, "text"), "PDOC", title=None, id_record=r"^\{(PDOC\d+)\}"),
        Format("rebase", line=r"^(\w\w)   (.*)$", fields={"OS": (_n, "os")}, title=None),
        Format("rebase_commdata", line=r"^(\w)\s+(.*)$", fields={"N": (_t, "com")}, id="N", title="N"),
        Format("taxonomy", line=r"^(\S+(?:\s\S+)*)\s+:\s+(.+)$", id_pattern=r"^\s*(.*\S)", title=None),
        Format("unigene", line=r"^(\w+)\s+(.*)$", title="TITLE"),
        Format("uniprot", default=(_n, None), sequence="SQ"),
        Format("uniseq", "^>"),
        Format("uniuniq", "^>"),
    )
}


def collection(parsed: DataFrame, name: str, stop: tuple[str, ...] = (), numbers: tuple[str, ...] = ()):
    """A collection of parsed records: an index for every name that occurs, of the kind it was given, and the sequences.

    Documents are numbered in the order of their ids; a record without an id is named ``#n`` by its number.
    """
    from ..operators.collection import Collection, IndexSpec, number_documents

    found = parsed.select(F.explode("entries").alias("e")).groupBy("e.ix").agg(F.collect_set("e.kind").alias("kinds")).collect()  # a row for each index
    if twice := sorted(r["ix"] for r in found if len(r["kinds"]) > 1):
        raise ValueError(f"indices with two kinds: {twice}")
    kinds = {r["ix"]: r["kinds"][0] for r in found}
    numbered = number_documents(parsed.withColumn("_id", F.coalesce("doc_id", F.lit(""))), ["_id", "text"]).drop("_id")
    docs = numbered.withColumn("doc_id", F.coalesce("doc_id", F.concat(F.lit("#"), F.col("doc_nr").cast("string")))).withColumn("title", F.col("meta")["title"])

    def values_of(name: str):
        return F.transform(F.filter("entries", lambda e: e["ix"] == name), lambda e: e["token"]).alias(f"ix_{name}")

    values = [values_of(n) for n in sorted(kinds)]
    made = docs.select("doc_nr", "doc_id", "text", "title", *values)
    specs = [IndexSpec(n, kinds[n], f"ix_{n}", numbers=n in numbers or not numbers, many=True) for n in sorted(kinds)]
    seqs = docs.select("doc_nr", F.posexplode("seqs").alias("seq_nr", "seq"))
    return Collection(made, specs, stop, name, ("title",), sequences=seqs)


def to_fasta(parsed: DataFrame) -> DataFrame:
    """(value): every sequence of flat-file records as a FASTA entry."""
    from ..functions import text as T

    return parsed.select("doc_id", F.col("meta")["title"].alias("title"), F.explode("seqs").alias("seq")).select(T.fasta("doc_id", "title", F.col("seq")).alias("value"))
