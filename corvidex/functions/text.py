"""Text functions as column expressions: everything stays in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words and numbers of lower-cased text. Only runs of digits alone are numbers; any byte outside 0-9a-z_ separates.
TOKEN = r"[0-9]+(?:\.[0-9a-z_]+)+|[0-9]*[a-z_][0-9a-z_]*(?:[-'][0-9a-z][0-9a-z_]*)*(?:\.[0-9a-z_]+)*|[0-9]+"
LONGEST = 255


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_lower(x: str | Column) -> Column:
    """Lower case of A-Z only; other alphabets keep their case."""
    return F.translate(_col(x), UPPER, LOWER)


def tokens(x: str | Column) -> Column:
    """All tokens of a text in order; null for null. A token with exactly one hyphen is two."""
    low = ascii_lower(x)
    raw = F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))
    one = lambda t: F.length(t) - F.length(F.replace(t, F.lit("-"), F.lit(""))) == 1
    split = F.flatten(F.transform(raw, lambda t: F.when(one(t), F.regexp_extract_all(F.replace(t, F.lit("-"), F.lit(" ")), F.lit(TOKEN), F.lit(0))).otherwise(F.array(t))))
    return F.when(F.contains(low, F.lit("-")), split).otherwise(raw)


def is_number(t: str | Column) -> Column:
    return F.rlike(_col(t), F.lit("^[0-9]+$"))


def token_class(t: str | Column) -> Column:
    """number, word or punctuation."""
    return F.when(is_number(t), "number").when(F.rlike(_col(t), F.lit("^[0-9a-z_]")), "word").otherwise("punctuation")


def index_tokens(x: str | Column, numbers: bool = False, stop: tuple[str, ...] = ()) -> Column:
    """Tokens as they are indexed: null where a position stays empty (a dropped number, a stop word, an over-long token)."""
    def keep(t: Column) -> Column:
        bad = F.length(t) > LONGEST
        if not numbers:
            bad = bad | is_number(t)
        if stop:
            bad = bad | t.isin(*stop)
        return F.when(~bad, t)

    return F.transform(tokens(x), keep)


def query_words(text: str) -> list[str]:
    """Words of a phrase in a query; single hyphens split. Lower-cased first."""
    out = []
    for w in re.findall(r"[0-9a-z_]+(?:[-.][0-9a-z_]+)*", text.translate(str.maketrans(UPPER, LOWER))):
        m = re.fullmatch(r"([0-9a-z_]+)-([0-9a-z_]+)", w)
        out += m.groups() if m else [w]
    return out


def formatter_words(x: str | Column) -> Column:
    """Words as result formatters split them: case-insensitive, then lower-cased."""
    return F.regexp_extract_all(ascii_lower(x), F.lit(r"[0-9a-z_]+(?:[-.][0-9a-z_]+)*"), F.lit(0))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob: * any run, ? one character."""
    return "^(?s)" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def glob_prefix(pattern: str) -> str:
    """The literal start of a glob, for a range filter that reaches the scan."""
    return re.split(r"[*?]", pattern)[0]


def glob_match(key: str | Column, pattern: str) -> Column:
    """Whether a lower-cased key matches; a pattern like ``fo*`` becomes a prefix test, which is pushed down."""
    key, pattern = _col(key), pattern.translate(str.maketrans(UPPER, LOWER))
    prefix = glob_prefix(pattern)
    if "*" not in pattern and "?" not in pattern:
        return key == pattern
    if pattern == prefix + "*":
        return F.startswith(key, F.lit(prefix))
    rest = F.rlike(key, F.lit(glob_regex(pattern)))
    return F.startswith(key, F.lit(prefix)) & rest if prefix else rest


def number(x: str | Column) -> Column:
    """Value of a digit string for comparisons; null for others."""
    return F.when(F.rlike(_col(x), F.lit("^[0-9]{1,38}$")), _col(x).try_cast("decimal(38,0)"))


def is_iso_date(x: str | Column) -> Column:
    """YYYY-MM-DD with month 1-12 and day 1-31; impossible days pass."""
    return F.rlike(_col(x), F.lit(r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"))


def html_escape(x: str | Column) -> Column:
    out = _col(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def link_urls(x: str | Column) -> Column:
    return F.regexp_replace(_col(x), r"((?:https?|ftp)://[^\s<>\"]+)", '<a href="$1">$1</a>')


def html_entry(x: str | Column) -> Column:
    """A document as preformatted HTML with linked URLs."""
    return F.concat(F.lit("<pre>"), link_urls(html_escape(x)), F.lit("</pre>"))


def fasta(doc_id: str | Column, title: str | Column, seq: str | Column, width: int = 72) -> Column:
    """One FASTA entry, residues wrapped."""
    body = F.regexp_replace(_col(seq), f"(.{{{width}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), _col(doc_id).cast("string"), F.lit(" "), F.coalesce(_col(title), F.lit("")), F.lit("\n"), body, F.lit("\n"))


def first_lines(x: str | Column, n: int = 7) -> Column:
    return F.substring_index(_col(x), "\n", n)
