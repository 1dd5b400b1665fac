"""Main text of HTML pages by the line-block distribution.

Markup is stripped into lines, one a block-level element. Text lengths (without
link text) are summed over a sliding window of lines; the text surges where the sum
first passes a threshold that follows the page's own peak, and dives where it
falls to nothing. The lines between are kept. Elements that by their name,
class, id or role are menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles or reader comments never become lines. Links count as text where
the page marks its article (article, main, or an element so called). If the peak lies in one, or they hold half of the text,
surge and dive move out to the borders of every such element that they touch, and of the articles
beside it in the same main (what else lies there stays between surge and dive, and its links do not count), so that short first and last blocks stay; text outside of such elements goes.
Between surge and dive every line stays, also one that is nothing but a link.

Cases: a null or empty page, or one without text, gives an empty text; unclosed,
unopened and cut-off tags are tolerated; a line break counts as white space; a cut-off character
reference at the end stays as it is; repeated rows and any page length are treated alike; an empty table
gives an empty result; other columns are passed through.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from ._common import bounded_batches

WINDOW, THRESHOLD = 3, 80
#: The share of a page's text from which on a wrapper is not taken for boilerplate by its name.
MOST = 0.8
_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(script|style|noscript|template|svg|math|iframe|object|textarea|select|title|canvas|audio|video)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*(?:>|\Z)|</?[a-z][^<>]*(?:>|\Z)|<[a-z][^>]*\Z",
    re.I | re.S,
)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("nav footer aside form menu head dialog button fieldset datalist".split())
_CLOSED_BY_NEXT = frozenset("p li dt dd tr td th".split())
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DROP_NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer header masthead sidebar sidenav aside rail ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login form search share sharing social related recommended trending comment comments commentlist reply replies disqus discussion widget toolbar pagination pager contentinfo complementary copyright skip".split()
)
_READERS = frozenset("comment comments commentlist reply replies disqus discussion".split())
_KEEP_NAMES = frozenset("article main".split())
_KEEP_CLASSES = re.compile(r"(?:article|post|entry|story|main|page)[-_ ]?(?:content|body|text)|^(?:article|content|story|post|entry|main)$", re.I)


def _called(attrs: str) -> tuple[bool, bool, bool]:
    """Whether an element with these attributes is boilerplate, whether it is the article, and whether it is so for sure: hidden, or readers' comments."""
    drop = keep = sure = False
    for name, value in _ATTR.findall(attrs):
        value = value.strip("\"'")
        low = name.lower()
        if low == "hidden" or low == "aria-hidden" and value.lower() == "true":
            drop = sure = True
        elif low != "aria-hidden":
            for token in value.split():
                if _KEEP_CLASSES.search(token):
                    keep = True
                elif found := _DROP_NAMES.intersection(parts := [p.lower() for p in _NAME.findall(token)]):
                    drop = True
                    sure = sure or bool(found & _READERS) and "no" not in parts
    return drop and not keep, keep, sure


def lines(page: str) -> list[tuple[str, int, int, int]]:
    """(text, characters outside links, article it lies in or 0, main it lies in or 0) of every line that is no boilerplate, in page order.

    A wrapper that only its name makes boilerplate is none if it holds nearly all of the page's text and no article lies outside of it.
    """
    held: Counter[int] = Counter()
    out = _lines(page, held, frozenset())
    outside = sum(r[1] for r in out)
    if held and not any(r[2] for r in out):
        total = outside + held[-1]
        opened = frozenset(k for k, n in held.items() if k >= 0 and n > MOST * total)
        if opened:
            return _lines(page, Counter(), opened)
    return out


def _lines(page: str, held: Counter[int], opened: frozenset[int]) -> list[tuple[str, int, int, int]]:
    """The lines; ``held`` gets the characters outside links of the wrappers that may be opened, by their place (-1: of all), ``opened`` has those that are."""
    out: list[tuple[str, int, int, int]] = []
    stack: list[tuple[str, bool, int, tuple[int, ...] | None, int]] = []  # element, inside boilerplate, article, wrappers that may be opened (None: inside one that may not), main
    text: list[str] = []
    linked, links, articles, at = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            line = " ".join(_html.unescape("".join(text)).split())
            if line:
                article, main = (stack[-1][2], stack[-1][4]) if stack else (0, 0)
                out.append((line, max(0, len(line) - linked), article, main))
            text.clear()
        linked = 0

    for m in _TAG.finditer(page):
        if m.start() > at:
            if not (stack and stack[-1][1]):
                text.append(page[at : m.start()])
                if links:
                    linked += m.start() - at
            elif not links and stack[-1][3] and (n := len(page[at : m.start()].strip())):
                for k in (-1, *stack[-1][3]):
                    held[k] += n
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        closing = m[2] == "/"
        if name == "a":
            links = 0 if closing else 1
        if name == "br":
            text.append(" ")
        if name not in _BLOCKS:
            if not closing and name not in _VOID and not m[4].endswith("/"):
                _, inside, article, _, main = stack[-1] if stack else ("", False, 0, None, 0)
                # An inline element that is boilerplate, or one of its name in it, whose end must not be taken for its own.
                if inside and stack[-1][0] == name or not inside and m[4].strip() and _called(m[4])[0]:
                    stack.append((name, True, article, None, main))
            elif closing and stack and stack[-1][0] == name:
                stack.pop()
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        for ended in ("p", name) if name in _CLOSED_BY_NEXT else ("p",):  # an open paragraph ends, with the inline elements in it; so does an open item
            i = len(stack) - 1
            while i >= 0 and stack[i][0] not in _BLOCKS:
                i -= 1
            if i >= 0 and stack[i][0] == ended:
                del stack[i:]
        if name in _VOID:
            continue
        inside, article, wraps, main = stack[-1][1:] if stack else (False, 0, (), 0)
        drop, keep, sure = _called(m[4]) if m[4].strip() else (False, False, False)
        if name in _KEEP_NAMES:
            drop, keep = drop and name != "main", True
        if name == "main" and wraps is not None and not sure:  # a page has one
            inside, wraps = False, ()
        drop = drop and m.start() not in opened
        if keep and not drop and not inside:
            if not article or name == "article":
                articles += 1
                article = articles
                main = article if name == "main" else main
        if name in ("body", "html"):
            drop = False
        drop = drop or (name in _DROP or name == "header" and not article) and m.start() not in opened
        if drop and wraps is not None:
            wraps = None if sure or name in _DROP and name != "form" else (*wraps, m.start())
        stack.append((name, inside or drop, article, wraps, main))
    if at < len(page):
        if not (stack and stack[-1][1]):
            text.append(page[at:])
        elif not links and stack[-1][3]:
            for k in (-1, *stack[-1][3]):
                held[k] += len(page[at:].strip())
    flush()
    return out


def extract(page: str | None) -> str:
    """The main text of one whole page; its blocks joined by blank lines."""
    if not page:
        return ""
    rows = lines(page)
    if not rows:
        return ""
    split = {r[3] for r in rows if r[3] and r[2] != r[3]}  # mains that hold articles: links beside those are no text
    size = [len(r[0]) if r[2] and not (r[2] == r[3] and r[3] in split) else r[1] for r in rows]
    sums = [sum(size[i : i + WINDOW]) for i in range(len(size))]
    top = max(sums)
    if not top:
        return ""
    peak = sums.index(top)
    peak = max(range(peak, min(peak + WINDOW, len(rows))), key=lambda i: size[i])
    marked = [i for i, r in enumerate(rows) if r[2]]
    if marked and 2 * sum(size[i] for i in marked) >= sum(size):  # the elements that are called article hold most of the text
        peak = max(marked, key=lambda i: (min(sums[i], size[i]), sums[i]))
    least = min(THRESHOLD, top / 2)
    kept, inside = [], False
    for i in range(len(rows)):
        if not inside and sums[i] >= least and size[i]:
            inside = True
        elif inside and not sums[i]:
            inside = False
        if inside:
            kept.append(i)
    if rows[peak][2]:  # what is kept of marked elements stays, and where it is text enough it reaches to the element's borders
        held = Counter()
        for i in kept:
            held[rows[i][2]] += size[i]
        whole = {a for a, n in held.items() if n >= least} | {rows[peak][2]}
        mains = {r[3] for r in rows if r[2] in whole} - {0}
        own = set(kept)
        kept = [i for i, r in enumerate(rows) if r[2] and (r[2] in whole or r[2] != r[3] and r[3] in mains or i in own)]
    return "\n\n".join(rows[i][0] for i in kept)


def extract_column(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` with the main text of each whole page and its length in code points, instead of the column ``html``."""
    rest = [f for f in pages.schema.fields if f.name != html]
    if bad := {text.lower(), n_chars.lower()} & {f.name.lower() for f in rest}:
        raise ValueError(f"columns {sorted(bad)} exist already; choose other output names")
    bounded_batches(pages.sparkSession)
    schema = T.StructType([*rest, T.StructField(text, T.StringType()), T.StructField(n_chars, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extract(x) for x in b.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], [*(f.name for f in rest), text, n_chars])

    return pages.mapInArrow(run, schema)
