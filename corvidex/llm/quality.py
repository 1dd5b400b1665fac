"""Quality scores by a regularised quadratic discriminant over document statistics.

Each whole text becomes a vector of transformed statistics. Each class has a
mean and a covariance, shrunk towards the pooled covariance and its diagonal;
the score is the posterior of class 1, from the difference of the two
Mahalanobis log densities, each by a Cholesky factor that the model caches.
Class moments are sums, so every labelled row counts and only a few
hundred numbers per task reach the driver.

Cases: a null or empty text has the statistics of the empty text and gets a
score; rows with a null label or key teach nothing; labels of a key that
contradict each other all count; repeated documents count as often as they
occur. If a class has no example, all scores are the share of class 1 (0.5 if
nothing was learned). An empty table gives an empty result. Other columns are
passed through by ``score`` and never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._common import bounded_batches

#: Weights of the pooled covariance and of the diagonal in each class covariance, and a floor on standard deviations.
POOL, DIAGONAL, FLOOR = 0.1, 0.05, 1e-3
THRESHOLD = 0.3
#: So many characters and words of usual prose count with each text, so that shares in short texts aren't extreme by chance.
CHARS, WORDS = 200, 40
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_SPACE, _PLAIN = b" \t\n\r\x0b\f", b".,;:'\"?-()"
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _PLAIN)

NAMES = ("log_chars", "log_words", "word_mean", "word_sd", "upper", "digits", "plain_marks", "odd_marks", "spaces", "repeats", "distinct", "line_repeats", "marked_ends", "bare_marks", "short_words", "entropy", "upper_words", "other_bytes")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text."""
    b = (text or "").encode()
    words = b.split()
    n = max(1, len(b))
    size = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    less = lambda drop: n0 - len(b.translate(None, drop))
    n0 = len(b)
    upper, digits, plain, odd, space = map(less, (_UPPER, _DIGITS, _PLAIN, _MARKS, _SPACE))
    lines = [x for x in b.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:]))
    letters = np.bincount(np.frombuffer(b, np.uint8), minlength=256) if b else np.zeros(256)
    p = letters[letters > 0] / n
    ends = sum(w[-1] in _MARKS for w in words)
    bare = sum(len(w) == 1 and w[0] in _MARKS for w in words)
    caps = sum(map(bytes.isupper, words))
    by_char = lambda x, usual: float(np.log((x + CHARS * usual) / (n0 + CHARS)))
    by_word = lambda x, usual: float(np.log((x + WORDS * usual) / (len(words) + WORDS)))
    return [
        float(np.log1p(n0)), float(np.log1p(len(words))), by_word(float(size.sum()), 6.0), 0.5 * by_word(float(size.var()) * len(words), 9.0),
        by_char(upper, 0.02), by_char(digits, 0.005), by_char(plain, 0.03), by_char(odd, 0.005), by_char(space, 0.15), by_word(same, 0.01), by_word(len(set(words)), 0.9),
        float(np.log((len(lines) - len(set(lines)) + 0.1) / (len(lines) + 2))), by_word(ends, 0.01), by_word(bare, 0.01), by_word(float((size <= 3).sum()) if words else 0.0, 0.35),
        float(-(p * np.log2(p)).sum() * n0 + 4.2 * CHARS) / (n0 + CHARS), by_word(caps, 0.02), by_char(float(letters[128:].sum()), 0.02),
    ]


@dataclass
class Model:
    """Class means, cached Cholesky factors of the regularised covariances, their log determinants, and the log prior odds of class 1."""

    mean: np.ndarray
    factor: np.ndarray
    logdet: np.ndarray
    odds: float
    whole: bool = True

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.whole:
            return np.full(len(x), 1 / (1 + np.exp(-self.odds)))
        density = [-0.5 * (np.square(np.linalg.solve(self.factor[c], (x - self.mean[c]).T)).sum(0) + self.logdet[c]) for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.odds, -500, 500)))


def solve(n: np.ndarray, s: np.ndarray, ss: np.ndarray, pool: float = POOL, diagonal: float = DIAGONAL, floor: float = FLOOR) -> Model:
    """A model from each class's count, sums and sums of products."""
    d = s.shape[1]
    if n.min() < 2:
        return Model(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), float(np.log((n[1] + 0.5) / (n[0] + 0.5))), False)
    mean = s / n[:, None]
    cov = np.stack([ss[c] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)])
    pooled = (n[:, None, None] * cov).sum(0) / n.sum()
    factors = []
    for c in (0, 1):
        m = (1 - pool) * cov[c] + pool * pooled
        m = (1 - diagonal) * m + diagonal * np.diag(np.diag(m)) + floor * np.eye(d)
        factors.append(np.linalg.cholesky(m))
    factor = np.stack(factors)
    return Model(mean, factor, 2 * np.log(np.diagonal(factor, axis1=1, axis2=2)).sum(1), float(np.log(n[1] / n[0])))


def with_statistics(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """``docs`` with an array of statistics instead of nothing else: all columns stay."""
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {out} exists already; choose another output name")
    bounded_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([statistics(x) for x in b.column(text).to_pylist()], pa.list_(pa.float64()))], [*b.schema.names, out])

    return docs.mapInArrow(run, schema)


def labelled(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(stats, label, times): statistics of the documents with labels, and how many labels of that value their key has.

    Labels are counted by key before they are joined, so a key that many documents and labels share gives two rows a document at most.
    """
    known = labels.select(key, F.col(label).cast("int").alias("label")).where(F.col(key).isNotNull() & F.col("label").isin(0, 1))
    return stats.select(key, "stats").join(known.groupBy(key, "label").agg(F.count("*").alias("times")), key).select("stats", "label", "times")


def fit(rows: DataFrame, stats: str = "stats", label: str = "label", times: str | None = None) -> Model:
    """A model from all rows with a label of 0 or 1; a row counts once, or as often as ``times`` says."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(NAMES)
        n, s, ss = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float).reshape(-1, d)
            y, w = np.array(b.column(1).to_pylist(), int), np.array(b.column(2).to_pylist(), float)
            for c in (0, 1):
                z, v = x[y == c], w[y == c]
                n[c] += v.sum()
                s[c] += v @ z
                ss[c] += (z * v[:, None]).T @ z
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((n, s.ravel(), ss.ravel())).tolist()])], ["m"])

    weight = F.lit(1) if times is None else F.col(times)
    parts = rows.where(F.col(label).isin(0, 1) & F.col(stats).isNotNull()).select(stats, F.col(label).cast("int"), weight.cast("double")).mapInArrow(moments, "m array<double>")
    d = len(NAMES)
    total = np.zeros(2 + 2 * d + 2 * d * d)
    sums = parts.select(F.posexplode("m")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
    for r in sums:
        total[r["pos"]] = r["v"]
    return solve(total[:2], total[2 : 2 + 2 * d].reshape(2, d), total[2 + 2 * d :].reshape(2, d, d))


def score(rows: DataFrame, model: Model, stats: str = "stats", out: str = "score") -> DataFrame:
    """``rows`` with the model's score, 0 to 1, beside their columns."""
    if out.lower() in {c.lower() for c in rows.columns}:
        raise ValueError(f"column {out} exists already; choose another output name")
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(stats).to_pylist(), float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.score(x))], [*b.schema.names, out])

    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose whole text scores at least ``threshold``; same columns."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array([statistics(t) for t in b.column(text).to_pylist()], float)
                yield b.filter(pa.array(sent.value.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
