"""URL filtering by rules and, where none fits, by gradient-boosted trees on lexical features.

Rules name a host and a path: one fits its host and all subdomains, if the URL's path
starts with the rule's; the longest fitting rule decides. For all other URLs
boosted regression trees judge lexical features: lengths, depth, digit ratio,
entropy, parameter counts, and statistics of the host's last label over all
labelled URLs. The trees are fitted on a bounded sample of distinct labelled
URLs, each weighted by how often it occurs and both classes weighted alike, and
become one column expression, so that scoring stays in Spark's generated code.

Cases: a null URL, or one without "://", has an empty host and path and gets a verdict by the
method; so does any URL if there are no labels (score 0.5, which allows); repeated rows are each
judged; ties of rules go to the one that sorts first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ._common import cut

#: Distinct labelled URLs that the trees are fitted on, at most about; those with the smallest hashes of the URL.
SAMPLE = 20_000
TREES, DEPTH, RATE, LEAF, BINS = 40, 3, 0.2, 20, 32
#: Folds of hosts; a URL's suffix statistics for the fit come from the others.
FOLDS = 5
#: Distinct suffixes up to which their statistics are broadcast; beyond it they are joined by a shuffle.
SUFFIXES = 50_000
#: Rules up to which they are one expression; beyond it they are a table that is joined.
FEW_RULES = 100


def host(url: str = "url") -> Column:
    """After the first "://" up to the next /, ?, # or the end; A-Z lower-cased; empty if there is none."""
    h = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @classmethod
    def of(cls, verdict: str, text: str) -> Rule:
        """From text like ``com/en/``: the host up to the first slash, and the path from it on."""
        h, slash, p = text.partition("/")
        return cls(verdict, h.lower(), slash + p)

    @property
    def text(self) -> str:
        return self.host + self.path


def matched(rows: DataFrame, rules: list[Rule], few: int = FEW_RULES) -> DataFrame:
    """``rows`` (host, path) with the longest fitting rule and its verdict, or null.

    A few rules become one expression, tried longest first. Many are a table that is joined by host
    and path: each distinct host and path looks up its own suffixes and prefixes, of the lengths that rules have.
    """
    if len(rules) > few:
        return _looked_up(rows, rules)
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        which, verdict = F.when(fits, F.lit(r.text)).otherwise(which), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rows.withColumn("rule", which).withColumn("rule_verdict", verdict)


def _looked_up(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    names = ("host", "path", "rule", "rule_verdict")
    first = {(r.host, r.path): r for r in sorted(rules, key=lambda r: r.text, reverse=True)}
    table = rows.sparkSession.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in first.values()], "h string, p string, rule string, rule_verdict string")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    lengths = F.array(*[F.lit(n) for n in sorted({len(r.path) for r in rules})])
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.char_length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    tried = rows.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("h")).select("host", "path", "h", F.explode(prefixes).alias("p"))
    # Longest first; of equal lengths the rule that sorts first.
    order = F.struct(F.char_length("rule"), F.transform(F.split("rule", ""), lambda c: -F.ascii(c)))
    best = tried.join(table, ["h", "p"]).groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), order).alias("b"))
    return rows.join(best.select("host", "path", "b.rule", "b.rule_verdict"), ["host", "path"], "left").select(*[c for c in rows.columns if c not in names[2:]], "rule", "rule_verdict")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _entropy(text: Column) -> Column:
    """Bits per character, over the distinct characters; 0 for an empty text."""
    n = F.char_length(text)

    def add(total: Column, c: Column) -> Column:
        share = (n - F.char_length(F.replace(text, c))) / n
        return total - share * F.log2(share)

    return F.aggregate(F.filter(F.array_distinct(F.split(text, "")), lambda c: c != ""), F.lit(0.0), add)


FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "parameters", "query_length", "hyphens", "fragment", "secure", "suffix_length", "suffix_rate", "suffix_share")


def features(rows: DataFrame, url: str = "url") -> DataFrame:
    """``rows`` (with host and path) and the lexical features f0, f1, … but for the two of the suffix's statistics, and the suffix."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.greatest(F.char_length(u), F.lit(1)).cast("double")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    suffix = F.element_at(F.split("host", r"\."), -1)
    parts = [
        F.char_length(u), F.char_length("host"), F.char_length("path"), _count(F.col("path"), "/"), _count(F.col("host"), r"\."), _count(u, "[0-9]") / n, _entropy(u),
        F.when(query == "", 0).otherwise(_count(query, "&") + 1), F.char_length(query), _count(u, "-"), _count(u, "#"), F.startswith(u, F.lit("https:")).cast("int"), F.char_length(suffix),
    ]
    return rows.select("*", suffix.alias("suffix"), *[p.cast("double").alias(f"f{i}") for i, p in enumerate(parts)])


@dataclass
class Trees:
    """Boosted trees: a start and, for each tree, nested (feature, threshold, left, right) or a leaf's value."""

    start: float = 0.0
    trees: list = field(default_factory=list)

    def margin(self, names: list[str]) -> Column:
        def node(t) -> Column:
            if not isinstance(t, tuple):
                return F.lit(float(t))
            f, cut, left, right = t
            return F.when(F.col(names[f]) <= F.lit(cut), node(left)).otherwise(node(right))

        total = F.lit(float(self.start))
        for t in self.trees:
            total = total + node(t)
        return total

    def predict(self, x: np.ndarray) -> np.ndarray:
        def node(t, rows: np.ndarray) -> np.ndarray:
            if not isinstance(t, tuple):
                return np.full(len(rows), float(t))
            f, cut, left, right = t
            go = rows[:, f] <= cut
            out = np.empty(len(rows))
            out[go], out[~go] = node(left, rows[go]), node(right, rows[~go])
            return out

        return self.start + sum((node(t, x) for t in self.trees), np.zeros(len(x)))


def fit(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, leaf: int = LEAF, bins: int = BINS) -> Trees:
    """Trees for the log odds of y = 1 by Newton steps on histograms; a row counts ``times``, and both classes weigh the same in sum."""
    model = Trees()
    if not len(y) or y.min() == y.max():
        model.start = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return model
    weight = np.ones(len(y)) if times is None else times.astype(float)
    for c in (0, 1):
        weight[y == c] *= 0.5 * len(y) / weight[y == c].sum()
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T)], 1)
    margin = np.zeros(len(y))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left_levels: int):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = None
        if left_levels and len(rows) >= 2 * leaf:
            for f, q in enumerate(cuts):
                b, k = binned[rows, f], len(q) + 1
                gl, hl, nl = (np.cumsum(np.bincount(b, w, k))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                ok = (nl >= leaf) & (len(rows) - nl >= leaf)
                gain = np.where(ok, gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1), -1)
                if len(gain) and gain.max() > 1e-6 and (best is None or gain.max() > best[0]):
                    best = (gain.max(), f, int(gain.argmax()))
        if best is None:
            return -rate * gs / (hs + 1)
        _, f, at = best
        go = binned[rows, f] <= at
        return (f, float(cuts[f][at]), grow(rows[go], g, h, left_levels - 1), grow(rows[~go], g, h, left_levels - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(y)), weight * (p - y), weight * p * (1 - p), depth)
        model.trees.append(tree)
        margin += Trees(0.0, [tree]).predict(x)
    return model


def judge(rows: DataFrame, labelled: DataFrame, url: str = "url", label: str = "label", sample: int = SAMPLE) -> DataFrame:
    """``rows`` with ``score``: how likely label 1 is, by trees fitted on ``labelled`` (url, label 0 or 1).

    The suffixes' statistics cover all labelled URLs; what the trees learn from are statistics without the URL's own
    fold of hosts, so that a rare suffix does not give its own label away. The trees' sample is bounded by ``sample``.
    """
    once = labelled.where(F.col(label).isin(0, 1)).groupBy(F.col(url), F.col(label).cast("int").alias("y")).agg(F.count("*").alias("times"))
    known = features(once.withColumn("host", host(url)).withColumn("path", path(url)), url)
    fold = F.pmod(F.crc32(F.col("host").cast("binary")), F.lit(FOLDS)).cast("int")
    stats = cut(known.groupBy("suffix", fold.alias("fold")).agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.col("y")).alias("bad"), F.count("*").alias("urls")))
    total = stats.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("urls"), F.lit(0)).alias("urls"), F.count("*").alias("k")).first()  # k: at most FOLDS rows a suffix
    prior = (total["bad"] + 0.5) / (total["n"] + 1)
    few = total["k"] <= SUFFIXES
    count = 13

    sums = stats.groupBy("suffix").agg(F.sum("n").alias("_n"), F.sum("bad").alias("_bad"))

    def complete(f: DataFrame, kept: DataFrame, on: list[str]) -> DataFrame:
        """The two features of the suffix, from the sums in ``kept``."""
        both = f.join(F.broadcast(kept) if few else kept, on, "left")
        n, bad = F.coalesce("_n", F.lit(0)), F.coalesce("_bad", F.lit(0))
        return both.withColumn(f"f{count}", (bad + 5 * prior) / (n + 5)).withColumn(f"f{count + 1}", n / F.lit(float(max(1, total["n"])))).drop("suffix", "_n", "_bad")

    names = [f"f{i}" for i in range(count + 2)]
    part = min(1.0, sample / max(1, total["urls"]))
    taken = known.where(F.pmod(F.xxhash64(F.col(url)), F.lit(1 << 24)) < F.lit(part * (1 << 24)))
    others = stats.join(sums, "suffix").select("suffix", "fold", (F.col("_n") - F.col("n")).alias("_n"), (F.col("_bad") - F.col("bad")).alias("_bad"))
    chosen = complete(taken.withColumn("fold", fold), others, ["suffix", "fold"]).select(*names, "y", "times").toPandas()
    model = fit(chosen[names].to_numpy(float), chosen["y"].to_numpy(int), chosen["times"].to_numpy(float))
    margin = model.margin(names)
    return complete(features(rows, url), sums, ["suffix"]).withColumn("score", 1 / (1 + F.exp(-margin))).drop(*names)


def verdicts(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score): the longest fitting rule's verdict, else the trees'.

    Without other labels, the URLs that rules decide are the labelled ones (1: block).
    """
    rows = matched(pages.select(F.col(key), F.col(url)).withColumn("host", host(url)).withColumn("path", path(url)), rules)
    if labelled is None:
        labelled = rows.where("rule is not null").select(F.col(url), (F.col("rule_verdict") == "block").cast("int").alias("label"))
    judged = judge(rows, labelled, url)
    own = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return judged.select(key, "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "score")
