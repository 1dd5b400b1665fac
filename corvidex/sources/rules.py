"""What a line-by-line format spec can't say: for some formats, what a field's whole value gives.

A rule takes a field code, its value (the lines of a field joined) and the row that is being made. It adds what it finds
and returns whether that was all; if not, the format's own table goes on with the field.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

TEXT, NUMS, WORD, VALUE, DATE, NUMBER = "text", "text+n", "word", "valu", "date", "nmbr"
_MONTHS = {m: i for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1)}


@dataclass
class Row:
    """One record's row while it is made."""

    doc_id: str | None = None
    title: str | None = None
    entries: list[dict] = field(default_factory=list)
    seqs: list[str] = field(default_factory=list)
    notes: dict = field(default_factory=dict)

    def add(self, kind: str, ix: str, value: str) -> None:
        """Entries of an index; a date is any that ``dates`` knows, a number the first one, and a word index has one entry a word."""
        values = dates(value)[:1] if kind == DATE else re.findall(r"\d+", value)[:1] if kind == NUMBER else value.split() if kind == WORD else [value]
        for v in values:
            if v.strip():
                self.entries.append({"ix": ix, "kind": {NUMS: "text", WORD: "text"}.get(kind, kind), "token": v.strip(), "pos": len(self.entries) + 1})


def dates(value: str) -> list[str]:
    """All dates written dd-MON-yyyy; if there are none, the first one written with digits only, year first; as yyyy-mm-dd."""
    found = [f"{y}-{_MONTHS[m]:02d}-{int(d):02d}" for d, m, y in re.findall(r"\b(\d{1,2})-([A-Z]{3})-(\d{4})\b", value.upper()) if m in _MONTHS]
    for y, m, d in [] if found else re.findall(r"\b(\d{4})[-/]?(\d{2})[-/]?(\d{2})\b", value)[:1]:
        if 1 <= int(m) <= 12 and 1 <= int(d) <= 31:
            found.append(f"{y}-{m}-{d}")
    return found


def _without_translations(value: str) -> str:
    """The text of a feature table: keys, locations, qualifiers without a quoted value whole, and of others the values, but no translated proteins."""
    value = re.sub(r'/translation="[^"]*("|\Z)', " ", value)
    return re.sub(r'/[^=\s"]+="([^"]*)("|\Z)', r" \1 ", value)


def uniprot(code: str, value: str, row: Row) -> bool:
    if code[0] == "R":
        row.add(NUMS, "ref", value)
    elif code == "CC":
        notice = ("-----", "Copyrighted by the UniProt Consortium", "Distributed under the Creative Commons")
        row.add(NUMS, "cc", "\n".join(x for x in value.split("\n") if not x.startswith(notice)))
    elif code == "DT":
        for d in dates(value):
            row.add(DATE, "dt", d)
    elif code == "SQ":
        if m := re.search(r"SEQUENCE\s+(\d+) AA;\s+(\d+) MW;\s+([0-9A-F]{16}) CRC64;", value):
            for kind, ix, x in zip((NUMBER, NUMBER, WORD), ("length", "mw", "crc64"), m.groups()):
                row.add(kind, ix, x)
        return False
    else:
        return False
    return True


def embl(code: str, value: str, row: Row) -> bool:
    if code == "ID":
        parts = [*re.split(r";\s*", value), *[""] * 7]
        if m := re.search(r"SV (\d+)", parts[1]):
            row.add(NUMBER, "sv", m[1])
        for ix, at in (("topology", 2), ("dc", 4), ("td", 5)):
            row.add(WORD, ix, parts[at].lower())
        row.add(NUMBER, "length", parts[6])
        return False
    if code[0] == "R":
        row.add(TEXT, "ref", value)
    elif code == "DT":
        for line in value.split("\n"):
            for ix, said in (("cd_date", "created"), ("up_date", "last updated")):
                if said in line.lower():
                    row.add(DATE, ix, line)
    elif code == "PR":
        for x in re.findall(r"Project:([^\s;]+)", value):
            row.add(WORD, "pr", x)
    elif code == "FT":  # only what stands in quotes
        row.add(TEXT, "ft", " ".join(" ".join(v.split()) for name, v in re.findall(r'/([^=\s"]+)="([^"]*)', value) if name != "translation"))
    else:
        return code in ("SQ", "FH", "XX", "SV", "AH")
    return True


def genbank(code: str, value: str, row: Row) -> bool:
    if code == "LOCUS":
        if m := re.match(r"\S+(\s+\d+ (aa|bp)?.+)", value):
            row.add(TEXT, "locus", m[1])
            row.notes["protein"] = m[2] == "aa"
    elif code == "ACCESSION":
        row.add(TEXT, "accession", value)
        return False
    elif code == "VERSION" and (m := re.search(r"GI:(\d+)", value)):
        row.add(WORD, "gi", m[1])
    elif code == "PROJECT" and (m := re.search(r"GenomeProject:(\d+)", value)):
        row.add(WORD, "project", m[1])
    elif code == "FEATURES":
        row.add(TEXT, "features", _without_translations(value.partition("\n")[2]))
    elif code in ("REFERENCE", "AUTHORS", "CONSRTM", "TITLE", "JOURNAL", "MEDLINE", "PUBMED", "REMARK"):
        row.add(TEXT, "reference", value)
    elif code == "ORIGIN":
        return not row.notes.get("protein")  # only proteins are kept as sequences
    else:
        return False
    return True


def omim(code: str, value: str, row: Row) -> bool:
    code, value = code.lower(), value.strip("\n")
    if code == "no":
        return False
    if code in ("cd", "ed"):
        for m, d, y in re.findall(r"(\d{1,2})/(\d{1,2})/(\d{4})", value):
            row.add(DATE, f"{code}_date", f"{y}-{int(m):02d}-{int(d):02d}")
    if code == "ti" and row.title is None:
        row.title = re.sub(r"^\D?\d{6}\s", "", value.split("\n")[0]).split(";")[0].lower()
    row.add(TEXT, code, value)
    return True


def rebase(code: str, value: str, row: Row) -> bool:
    if code == "OS":
        row.notes["os"] = value
        return False
    if code == "RS":
        row.title = f"{row.notes.get('os', '')} target:{value}"
        for site in re.findall(r"([^,;\s]+),[^;]*;", value) or [value]:
            row.add(WORD, "target", site.lower())
            if site != "?":
                row.add(NUMBER, "targetlen", str(len(site)))
    elif code[0] == "C":
        for letter in sorted(set(re.findall("[A-Z]", value))):
            row.add(WORD, "com", letter.lower())
    elif code[0] == "R":
        row.add(NUMS, "ref", value)
    else:
        return code == "MS"
    return True


def prosite(code: str, value: str, row: Row) -> bool:
    if code == "ID" and (m := re.match(r"[A-Z0-9_]+; ([A-Z]+)", value)):
        row.add(WORD, "type", m[1].lower())
        return False
    return code in ("MA", "NR", "PA")


def taxonomy(code: str, value: str, row: Row) -> bool:
    if code == "ID":
        return False
    if code == "PARENT ID":
        row.add(NUMS, "parent", value)
        return True
    if code in ("SCIENTIFIC NAME", "COMMON NAME"):
        row.notes[code] = value
        row.title = " ".join(row.notes[k] for k in ("SCIENTIFIC NAME", "COMMON NAME") if k in row.notes)
    row.add(TEXT, "text", value)
    row.add(TEXT, code.replace(" ", "_").lower(), value)
    return True


#: One-letter codes of residues, by their three-letter names: fixed values.
RESIDUES = dict(zip("ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL GLX ASX".split(), "ARNDCQEGHILKMFPSTWYVZB"))


def pdb(code: str, value: str, row: Row) -> bool:
    lines = [re.sub(r"^\d+\s+", "", x.strip()) for x in value.split("\n")]
    if code == "HEADER":
        if m := re.match(r"(.+?)\d{2}-[A-Z]{3}-\d{2}\s+(\S{4})", value):
            row.notes["header"] = m[1]
            row.doc_id = m[2]
            row.add(TEXT, "text", m[1])
            row.add(VALUE, "id", m[2])
    elif code == "TITLE":
        row.notes["title"] = "".join(lines).lower()
        row.add(TEXT, "title", "\n".join(lines))
    elif code == "COMPND":
        made = [("EC: " if name == "EC" else "") + v.lower() + " " for x in lines for name, v in re.findall(r"(MOLECULE|EC): (.+)", x)]
        row.notes["compound"] = "".join(made)
        row.add(TEXT, "compnd", "\n".join(lines))
    elif code in ("AUTHOR", "JRNL", "REMARK"):  # initials are set apart from names, so that names are found
        apart = [re.sub(r"(\w)\.(?=\w)", r"\1. ", x) if code == "AUTHOR" or re.search(r"\bAUTH\b", x) and code == "REMARK" else x for x in lines]
        row.add(TEXT, "remark" if code == "REMARK" else "ref", "\n".join(apart))
    elif code == "SEQRES":
        chains: dict[str, list[str]] = {}
        for x in value.split("\n"):
            if m := re.match(r"\s*\d+\s+(\S)\s+\d+\s+(.*)", x):
                chains.setdefault(m[1], []).extend(RESIDUES.get(a, "X") for a in m[2].split() if len(a) == 3)
        row.seqs += ["".join(c) for c in chains.values() if len(c) > 2 or len(chains) == 1]
    else:
        row.add(TEXT, "text", "\n".join(lines))
    n = row.notes
    title = f"{n['compound']}({n.get('header', '')})" if n.get("compound") else n.get("header", "")
    row.title = re.sub(" {2,}", " ", title + (f"; {n['title']}" if n.get("title") else "")).strip() or None
    return True


RULES: dict[str, Callable[[str, str, Row], bool]] = {f.__name__: f for f in (uniprot, embl, genbank, omim, rebase, prosite, taxonomy, pdb)}
