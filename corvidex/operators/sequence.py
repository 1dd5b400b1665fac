"""Protein sequences: low-complexity masks and similarity search by seeds and gapped extension."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

RESIDUES = "ABCDEFGHIKLMNPQRSTVWXYZU*"

# ---- scoring -------------------------------------------------------------------------------------

_ORDER = "ARNDCQEGHILKMFPSTWYV"
# The public BLOSUM62 matrix, its lower triangle with a row for each letter of the order above, then B and Z.
_B62 = """
A  4
R -1  5
N -2  0  6
D -2 -2  1  6
C  0 -3 -3 -3  9
Q -1  1  0  0 -3  5
E -1  0  0  2 -4  2  5
G  0 -2  0 -1 -3 -2 -2  6
H -2  0  1 -1 -3  0  0 -2  8
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
B -2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4
Z -1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4
"""
# Fixed values: (gap open, gap extend) -> published lambda, K, H, alpha and beta of BLOSUM62; (0, 0): ungapped.
STATISTICS = {
    (0, 0): (0.3176, 0.134, 0.4012, 0.7916, -3.2), (11, 2): (0.297, 0.082, 0.27, 1.1, -10.0), (10, 2): (0.291, 0.075, 0.23, 1.3, -15.0), (9, 2): (0.279, 0.058, 0.19, 1.5, -19.0),
    (8, 2): (0.264, 0.045, 0.15, 1.8, -26.0), (7, 2): (0.239, 0.027, 0.10, 2.5, -46.0), (6, 2): (0.201, 0.012, 0.061, 3.3, -58.0), (13, 1): (0.292, 0.071, 0.23, 1.2, -11.0),
    (12, 1): (0.283, 0.059, 0.19, 1.5, -19.0), (11, 1): (0.267, 0.041, 0.14, 1.9, -30.0), (10, 1): (0.243, 0.024, 0.10, 2.5, -44.0), (9, 1): (0.206, 0.010, 0.052, 4.0, -87.0),
}
# The same for the usual gap costs of the other public matrices, whose scores are read from a file (``load_matrix``).
USUAL = {
    "BLOSUM45": {(0, 0): (0.2291, 0.0924, 0.2514, 0.9113, -5.7), (15, 2): (0.203, 0.041, 0.12, 1.7, -31.0)},
    "BLOSUM50": {(0, 0): (0.2318, 0.112, 0.3362, 0.6895, -4.0), (13, 2): (0.193, 0.035, 0.12, 1.6, -32.0)},
    "BLOSUM80": {(0, 0): (0.3430, 0.177, 0.6568, 0.5222, -1.6), (10, 1): (0.299, 0.071, 0.27, 1.1, -14.0)},
    "BLOSUM90": {(0, 0): (0.3346, 0.190, 0.7547, 0.4434, -1.4), (10, 1): (0.290, 0.075, 0.28, 1.04, -15.0)},
    "PAM30": {(0, 0): (0.3400, 0.283, 1.754, 0.1938, -0.3), (9, 1): (0.294, 0.11, 0.61, 0.48, -6.0)},
    "PAM70": {(0, 0): (0.3345, 0.229, 1.029, 0.3250, -0.7), (10, 1): (0.291, 0.091, 0.41, 0.71, -9.0)},
    "PAM250": {(0, 0): (0.2252, 0.0868, 0.2223, 0.98, -5.0), (14, 2): (0.182, 0.024, 0.073, 2.5, -53.0)},
    "BLOSUM62_20": {(0, 0): (0.03391, 0.125, 0.4544, 0.07462, -3.2), (100, 12): (0.0300, 0.056, 0.21, 0.14, -15.0)},
}


def matrix_from(text: str) -> np.ndarray:
    """A matrix from text in the usual layout: a line of letters, then a row for each letter."""
    rows = [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    cols, out = rows[0], np.full((256, 256), -4, np.int32)
    for letter, *scores in rows[1:]:
        for c, s in zip(cols, scores):
            out[ord(letter), ord(c)] = int(s)
    return out


@lru_cache(maxsize=1)
def blosum62() -> np.ndarray:
    """256 x 256 scores by character code; unknown letters score -4, U scores as C."""
    out = np.full((256, 256), -4, np.int32)
    order = []
    for line in _B62.split("\n")[1:-1]:
        letter, *scores = line.split()
        order.append(ord(letter))
        out[ord(letter), order] = out[order, ord(letter)] = [int(x) for x in scores]
    x = ord("X")
    out[x, order] = out[order, x] = [0 if chr(c) in "AST" else -2 if chr(c) in "CPW" else -1 for c in order]
    out[x, x], out[ord("*"), ord("*")] = -1, 1
    known = [*order, x, ord("*")]
    out[ord("U"), known] = out[known, ord("U")] = out[ord("C"), known]
    out[ord("U"), ord("U")] = out[ord("C"), ord("C")]
    return out


#: Background frequencies of residues (per 100,000), in the order of _ORDER: the usual ones for protein searches.
_BACKGROUND = (7805, 5129, 4487, 5364, 1925, 4264, 6295, 7377, 2199, 5142, 9019, 5744, 2243, 3856, 5203, 7120, 5841, 1330, 3216, 6441)


def karlin(m: np.ndarray) -> tuple[float, float, float]:
    """Ungapped lambda, K and H of a matrix for random proteins, from the distribution of the score of one pair."""
    f = np.array(_BACKGROUND, float) / sum(_BACKGROUND)
    letters = [ord(c) for c in _ORDER]
    scores = m[np.ix_(letters, letters)]
    low, high = int(scores.min()), int(scores.max())
    p = np.bincount((scores - low).ravel(), np.outer(f, f).ravel(), high - low + 1)
    values = np.arange(low, high + 1)
    if high <= 0 or (p * values).sum() >= 0:
        raise ValueError("a matrix needs a positive score and a negative mean")
    a, b = 0.0, 10.0
    for _ in range(200):
        lam = (a + b) / 2
        a, b = (lam, b) if (p * np.exp(lam * values)).sum() < 1 else (a, lam)
    h = lam * (p * values * np.exp(lam * values)).sum()
    sigma, walk = 0.0, np.array([1.0])
    for k in range(1, 61):  # sums over the first k pairs of a random alignment
        walk = np.convolve(walk, p)
        at = np.arange(len(walk)) + k * low
        sigma += (walk * np.where(at < 0, np.exp(lam * np.minimum(at, 0)), 1.0)).sum() / k
    step = np.gcd.reduce(np.abs(values[p > 0]))
    return lam, lam * step * math.exp(-2 * sigma) / (h * (1 - math.exp(-lam * step))), h


#: Matrices by name: 256 x 256 scores and their statistics by gap costs.
MATRICES: dict[str, tuple[np.ndarray, dict]] = {}


def register_matrix(name: str, text: str, gapped: dict[tuple[int, int], tuple[float, ...]] | None = None) -> None:
    """Adds a matrix (text in the usual layout) with its lambda, K, H, alpha and beta by gap costs, (0, 0) for none.

    Public matrices have those of their usual gap costs; where the ungapped ones are not given they are computed.
    """
    m = matrix_from(text)
    known = USUAL.get(name.upper(), {}) | (gapped or {})
    if (0, 0) not in known:
        lam, k, h = karlin(m)
        known[0, 0] = (lam, k, h, lam / h, -0.5)
    MATRICES[name.upper()] = (m, known)


def load_matrix(spark: SparkSession, path: str, name: str, gapped: dict[tuple[int, int], tuple[float, ...]] | None = None) -> None:
    """The same from a file that Spark can read: some 25 lines."""
    register_matrix(name, "\n".join(r["value"] for r in spark.read.option("wholetext", "true").text(path).collect()), gapped)


MATRICES["BLOSUM62"] = (blosum62(), STATISTICS)


@dataclass(frozen=True)
class Parameters:
    program: str = "blastp"
    matrix: str = "BLOSUM62"
    word: int = 3
    expect: float = 10.0
    mask: bool = True
    gapped: bool = True
    gap_open: int = 11
    gap_extend: int = 1
    limit: int = 250
    threshold: int = 11
    window: int = 40

    def __post_init__(self):
        if self.program != "blastp":
            raise ValueError(f"unsupported program {self.program!r}")
        if self.matrix.upper() not in MATRICES or self.costs not in self.statistics:
            raise ValueError(f"unsupported combination of {self.matrix} and gap costs {self.gap_open}, {self.gap_extend}")
        if self.word not in (2, 3, 4):
            raise ValueError("words have 2 to 4 residues")

    @property
    def costs(self) -> tuple[int, int]:
        return (self.gap_open, self.gap_extend) if self.gapped else (0, 0)

    @property
    def scores(self) -> np.ndarray:
        return MATRICES[self.matrix.upper()][0]

    @property
    def statistics(self) -> dict:
        return MATRICES[self.matrix.upper()][1]


# ---- low complexity ------------------------------------------------------------------------------


def entropy(window: str) -> float:
    """Shannon bits of a window's composition."""
    n = len(window)
    return -sum(k / n * math.log2(k / n) for k in (window.count(c) for c in set(window)))


def entropies(seq: Column, window: int) -> Column:
    """Shannon bits of every window of a sequence, left to right, in the JVM; no windows if it is shorter."""
    n = F.length(seq)

    def one(i: Column) -> Column:
        w = F.substring(seq, i, F.lit(window))
        shares = F.transform(F.array_distinct(F.split(w, "")), lambda c: (F.lit(window) - F.length(F.replace(w, c, F.lit("")))) / F.lit(float(window)))
        return F.aggregate(F.filter(shares, lambda p: (p > 0) & (p < 1)), F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return F.when(n >= window, F.transform(F.sequence(F.lit(1), n - window + 1), one)).when(seq.isNotNull(), F.array().cast("array<double>"))


def _log_probabilities(counts: np.ndarray, sizes: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """ln of the chance of each row's composition, of ``sizes`` letters (``orders``: ln of their factorials): assignments of its counts to letters, times arrangements, over all strings."""
    alphabet = counts.shape[1]
    c = np.sort(counts, 1)
    run, same = np.ones(len(c)), np.zeros(len(c))
    for j in range(1, alphabet):  # ln of the factorial of how often each count occurs
        run = np.where(c[:, j] == c[:, j - 1], run + 1, 1)
        same += np.log(run)
    return math.lgamma(alphabet + 1) - same + orders - _ln_factorials(int(sizes.max()))[c].sum(1) - sizes * math.log(alphabet)


def _ln_factorials(n: int) -> np.ndarray:
    """ln k! for k from 0 to n or more."""
    return _ln_table(1 << max(10, n.bit_length()))


@lru_cache(maxsize=2)
def _ln_table(n: int) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))


@lru_cache(maxsize=256)
def _parts(length: int, trim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, sizes, ln of the sizes' factorials) of all parts of a segment that at most ``trim`` letters are trimmed from: the longest first, then from the left."""
    each = range(length, max(1, length - trim) - 1, -1)
    times = [length - size + 1 for size in each]
    return np.concatenate([np.arange(n) for n in times]), np.repeat(np.array(each), times), np.repeat([math.lgamma(size + 1) for size in each], times)


def _counts(seq: str) -> np.ndarray:
    """How often each letter of ``seq`` occurs before each place: a row more than letters, a column for each distinct one."""
    which = np.unique(np.frombuffer(seq.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)[1]
    out = np.zeros((len(seq) + 1, int(which.max()) + 1), np.int32)
    out[np.arange(1, len(seq) + 1), which] = 1
    return np.cumsum(out, 0, out=out)


def _least_probable(sums: np.ndarray, trim: int, alphabet: int) -> tuple[int, int]:
    """Start and end of the least probable part of a segment, given its counts; all of it, if none has a chance below 1."""
    starts, sizes, orders = _parts(len(sums) - 1, trim)
    counts = sums[starts + sizes] - sums[starts]
    counts = counts[:, sums[-1] > sums[0]]  # letters that lie elsewhere in the sequence are no columns
    if counts.shape[1] < alphabet:
        counts = np.pad(counts, ((0, 0), (0, alphabet - counts.shape[1])))
    p = _log_probabilities(counts, sizes, orders)
    at = int(p.argmin())
    return (int(starts[at]), int(starts[at] + sizes[at])) if p[at] < 0 else (0, len(sums) - 1)


def mask(seq: str | None, window: int, low: float, high: float, trim: int, alphabet: int) -> str | None:
    """``seq`` with its low-complexity segments replaced by X: windows at or below ``low`` grow while at or below ``high``, and are trimmed to the least probable part."""
    if not seq or len(seq) < window:
        return seq
    sums = _counts(seq)
    shares = np.arange(window + 1) / window
    bits = -shares * np.log2(np.maximum(shares, 1 / window))
    all_h = bits[sums[window:] - sums[:-window]].sum(1)
    if all_h.min() > low:
        return seq
    out = list(seq)

    def segments(start: int, stop: int) -> None:
        if stop - start < window:
            return
        h = all_h[start : stop - window + 1]
        high_at, done = np.flatnonzero(h > high), 0
        for i in np.flatnonzero(h <= low).tolist():
            if i < done:
                continue
            k = int(np.searchsorted(high_at, i))
            left = int(high_at[k - 1]) + 1 if k else 0
            right = (int(high_at[k]) if k < len(high_at) else len(h)) - 1 + window
            first, last = _least_probable(sums[start + left : start + right + 1], trim, alphabet)
            out[start + left + first : start + left + last] = "X" * (last - first)
            if first >= window:
                segments(start + left, start + left + first)
            done = max(i + 1, left + last)

    segments(0, len(seq))
    return "".join(out)


def seg_text(seq: str | None) -> str | None:
    return mask(seq, 12, 2.2, 2.5, 50, 20)


def dust_text(seq: str | None) -> str | None:
    return mask(seq, 32, 1.4, 1.6, 100, 4)


def _each(s: pd.Series, f: Callable[[str], str]) -> pd.Series:
    """``f`` of every sequence, worked out once for each different one of a batch."""
    code, different = pd.factorize(s)
    got = np.array([*map(f, different), None], object)
    return pd.Series(got[code], s.index)  # nulls have the code -1


@pandas_udf(StringType())
def _seg(s: pd.Series) -> pd.Series:
    return _each(s, seg_text)


@pandas_udf(StringType())
def _dust(s: pd.Series) -> pd.Series:
    return _each(s, dust_text)


def seg(x: Column) -> Column:
    """Protein low-complexity segments as X."""
    return _seg(x)


def dust(x: Column) -> Column:
    """Nucleotide low-complexity segments as X."""
    return _dust(x)


def statistics(seqs: DataFrame) -> DataFrame:
    return seqs.agg(F.count("*").alias("n_sequences"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("total_length"))


# ---- search --------------------------------------------------------------------------------------


def made_up(k: int, length: int = 80) -> str:
    """A fixed protein for examples and tests."""
    rng = np.random.default_rng(k)
    return "".join(rng.choice(list(_ORDER), length))


def neighbours(query: str, p: Parameters) -> dict[str, list[int]]:
    """Words that score at least the threshold against a word of the query, and where."""
    m, out = p.scores, {}
    for i in range(len(query) - p.word + 1):
        words = [("", 0)]
        best = [int(m[ord(c), [ord(x) for x in _ORDER]].max()) for c in query[i : i + p.word]]
        for k in range(p.word):
            rest = sum(best[k + 1 :])
            words = [(w + c, t) for w, s in words for c in _ORDER if (t := s + int(m[ord(query[i + k]), ord(c)])) + rest >= p.threshold]
        for w, _ in words:
            out.setdefault(w, []).append(i)
    return out


def length_adjustment(k: float, lam: float, alpha: float, beta: float, m: int, n: int, sequences: int) -> int:
    """The expected length of a chance alignment, by fixed-point iteration of at most 20 steps."""
    ell, low, high = 0.0, 0.0, max(0.0, min(m, n / max(1, sequences)) - 1)
    for _ in range(20):
        space = max(1.0, (m - ell) * (n - sequences * ell))
        new = alpha / lam * (math.log(k) + math.log(space)) + beta
        if new >= ell:
            low = ell
            if new - low <= 1:
                break
        else:
            high = min(high, ell)
        ell = new if low <= new <= high else (low + high) / 2
    return max(0, int(low))


def word_table(words: dict[str, list[int]], word: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, places): the query's positions of each word, by the word's number."""
    numbers = {int(_numbers(np.frombuffer(w.encode(), np.uint8), word)[0]): places for w, places in words.items()}
    starts = np.zeros((1 << 5 * word) + 1, np.int32)
    for k, places in numbers.items():
        starts[k + 1] = len(places)
    return np.cumsum(starts, dtype=np.int32), np.array([i for k in sorted(numbers) for i in numbers[k]], np.int32)


def _numbers(s: np.ndarray, word: int) -> np.ndarray:
    """The number of the word at each position; other signs than A to Z count as one that no word has."""
    c = np.where((s >= 65) & (s <= 90), s - 65, 31).astype(np.int64)
    n = len(s) - word + 1
    return sum(c[k : k + n] << 5 * (word - 1 - k) for k in range(word)) if n > 0 else np.zeros(0, np.int64)


def _word_hits(s: np.ndarray, p: Parameters, table: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Positions in the query, in order, of the hits of each diagonal (first its number) that may have two near ones."""
    starts, places = table
    k = _numbers(s, p.word)
    count = starts[k + 1] - starts[k]
    j = np.repeat(np.arange(len(k)), count)
    i = places[np.repeat(starts[k] - (np.cumsum(count) - count), count) + np.arange(len(j))].astype(np.int64)
    d = j - i
    order = np.lexsort((i, d))
    i, d = i[order], d[order]
    cuts = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1], [True]))) if len(d) else np.zeros(1, np.int64)
    first, last = cuts[:-1], cuts[1:] - 1
    return [np.concatenate((d[a : a + 1], i[a : b + 1])) for a, b in zip(first, last) if i[b] - i[a] >= p.word]


def _extended(row: np.ndarray, drop: float) -> tuple[int, int]:
    """(gain, cells) of the best prefix of a row of scores, which ends where the sum falls by more than ``drop`` below its best."""
    if not len(row):
        return 0, 0
    run = np.cumsum(row)
    best = np.maximum(np.maximum.accumulate(run), 0)
    low = np.flatnonzero(best - run > drop)
    stop = int(low[0]) if len(low) else len(run)
    if not stop or run[:stop].max() <= 0:
        return 0, 0
    at = int(run[:stop].argmax())
    return int(run[at]), at + 1


def _ungapped(m: np.ndarray, q: np.ndarray, s: np.ndarray, start: int, end: int, d: int, drop: float) -> tuple[int, int, int]:
    """(score, start, end in the query) of the best extension of a stretch along its diagonal."""
    right = m[q[end : len(s) - d], s[end + d : len(q) + d]] if end + d < len(s) else np.zeros(0, np.int64)
    n = min(start, start + d)
    left = m[q[start - n : start], s[start + d - n : start + d]][::-1]
    more, ahead = _extended(right, drop)
    again, back = _extended(left, drop)
    return int(m[q[start:end], s[start + d : end + d]].sum()) + more + again, start - back, end + ahead


def _gapped(m: np.ndarray, q: np.ndarray, s: np.ndarray, p: Parameters, drop: float) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Best affine alignment from the start of both, by rows within the drop: score, ends, and steps (query, target) of the trace.

    A row holds the cells from the first to the last that the row before keeps alive, and as many more as a gap can reach.
    """
    first, extend = p.gap_open + p.gap_extend, p.gap_extend
    n, none, reach = len(s), -(10**9), int(drop // max(1, extend)) + 2
    lo, hi = 0, min(n, reach)  # cells lo to hi of a row
    h = np.concatenate(([0], -first - extend * np.arange(hi)))
    h[h < -drop] = none
    f = np.full(hi + 1, none, np.int64)
    best, at, back = 0, (0, 0), [(0, np.where(np.arange(hi + 1) == 0, 0, 2).astype(np.int8))]
    for i in range(1, len(q) + 1):
        alive = np.flatnonzero(h > none // 2)
        if not len(alive):
            break
        old, lo, hi = lo, lo + int(alive[0]), min(n, lo + int(alive[-1]) + 1 + reach)
        width = hi - lo + 1
        up, down = np.full(width, none, np.int64), np.full(width, none, np.int64)
        kept = h[lo - old :][:width]
        up[: len(kept)], down[: len(kept)] = kept, f[lo - old :][:width]
        f = np.maximum(up - first, down - extend)
        diag = np.full(width, none, np.int64)
        diag[1:] = np.where(up[:-1] > none // 2, up[:-1] + m[q[i - 1], s[lo:hi]], none)
        open_ = np.maximum(diag, f)
        k = np.arange(width) * extend
        e = np.full(width, none, np.int64)
        e[1:] = (np.maximum.accumulate(open_ + k) - first + extend)[:-1] - k[1:]
        h = np.maximum(open_, e)
        back.append((lo, np.where(h == diag, 0, np.where(h == f, 1, 2)).astype(np.int8)))
        h[h < best - drop] = none
        top = int(h.max())
        if top <= none // 2:
            break
        if top > best:
            best, at = top, (i, lo + int(h.argmax()))
    i, j = at
    steps = []
    while i or j:
        w = back[i][1][j - back[i][0]] if i and j else (1 if i else 2)
        a, b = (1, 1) if w == 0 else (1, 0) if w == 1 else (0, 1)
        steps.append((a, b))
        i, j = i - a, j - b
    return best, at[0], at[1], steps[::-1]


def hsps(query: str, masked: str, target: str, p: Parameters, words: dict[str, list[int]] | tuple[np.ndarray, np.ndarray], m: np.ndarray | None = None, statistics_: dict | None = None) -> list[dict]:
    """High-scoring pairs of a query and one target, best first, without overlaps.

    Two word hits on a diagonal, at least a word and less than the window apart, are extended without gaps; what
    passes the trigger is aligned with gaps from its middle, and keeps the better of both scores. The matrix
    and its statistics are sent along, as workers know only the built-in one.
    """
    m, known = (p.scores, p.statistics) if m is None else (m, statistics_)
    table = word_table(words, p.word) if isinstance(words, dict) else words
    lam, k, *_ = known[0, 0]
    drop = math.ceil(math.log(2) * 7 / lam)
    trigger = int((math.log(2) * 22 + math.log(k)) / lam)
    q, mq, s = (np.frombuffer(x.encode("latin-1", "replace"), np.uint8) for x in (query, masked, target))
    found = []
    for d, *places in map(np.ndarray.tolist, _word_hits(s, p, table)) if len(s) >= 2 * p.word else ():
        held = None
        for i in places:
            if held is None or i - held >= p.window:
                held = i
            elif i - held >= p.word:
                score, start, end = _ungapped(m, mq, s, held, i + p.word, d, drop)
                held = end
                if score >= trigger:
                    found.append((score, start, end, d))
    out = []
    for score, start, end, d in sorted(found, reverse=True):
        mid = (start + end) // 2
        if any(h["q_from"] <= mid < h["q_to"] and h["s_from"] <= mid + d < h["s_to"] for h in out):
            continue
        qa, qb, sa, sb, steps = start, end, start + d, end + d, [(1, 1)] * (end - start)
        if p.gapped:
            x = int(25 * math.log(2) / known[p.costs][0])
            right, a, b, fwd = _gapped(m, mq[mid:], s[mid + d :], p, x)
            left, c, e, bwd = _gapped(m, mq[:mid][::-1], s[: mid + d][::-1], p, x)
            if right + left >= score:
                score, qa, sa, steps = right + left, mid - c, mid + d - e, bwd[::-1] + fwd
                qb, sb = mid + a, mid + d + b
        rows, i, j = ["", "", ""], qa, sa
        for u, v in steps:
            x, y = query[i] if u else "-", target[j] if v else "-"
            rows[0] += x
            rows[2] += y
            rows[1] += x if x == y else "+" if u and v and m[ord(x), ord(y)] > 0 else " "
            i, j = i + u, j + v
        same = sum(a == b for a, b in zip(rows[0], rows[2]))
        hsp = {"score": int(score), "q_from": qa, "q_to": qb, "s_from": sa, "s_to": sb, "identity": same, "positive": same + rows[1].count("+"), "gaps": rows[0].count("-") + rows[2].count("-"), "q_line": rows[0], "midline": rows[1], "s_line": rows[2]}
        if not any(h["q_from"] < qb and qa < h["q_to"] and h["s_from"] < sb and sa < h["s_to"] for h in out):
            out.append(hsp)
    return sorted(out, key=lambda h: -h["score"])


def blast(seqs: DataFrame, query: str, p: Parameters, restrict: DataFrame | None = None) -> DataFrame:
    """Hits of a protein in sequences (doc_nr, seq), one row an HSP: score, bits, expect, positions and alignment lines.

    The table of neighbouring words goes to every task; sequences are only scanned. ``restrict`` (doc_nr) limits the search.
    A sequence is a hit if its best HSP is expected often enough; the ``limit`` best hits are returned with all
    their HSPs, by the best one's score, then document number.
    """
    query = query.upper()
    if restrict is not None:
        seqs = seqs.join(restrict.select("doc_nr"), "doc_nr", "left_semi")
    masked = seg_text(query) if p.mask else query
    table = word_table(neighbours(masked, p), p.word)
    sizes = seqs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("t")).first()
    lam, k, _, alpha, beta = p.statistics[p.costs]
    m, known = p.scores, p.statistics
    ell = length_adjustment(k, lam, alpha, beta, len(query), max(1, sizes["t"]), sizes["n"])
    space = float(max(1, len(query) - ell) * max(1, sizes["t"] - sizes["n"] * ell))
    names = ["score", "q_from", "q_to", "s_from", "s_to", "identity", "positive", "gaps", "q_line", "midline", "s_line"]

    def bits(score: int) -> int:
        return math.floor((score * lam - math.log(k)) / math.log(2))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for nr, s in zip(f["doc_nr"], f["seq"]):
                found = hsps(query, masked, s.upper(), p, table, m, known) if s else []
                if found and space / 2.0 ** bits(found[0]["score"]) <= p.expect:
                    # The HSPs of a hit travel together, so that the best hits are found with a limit.
                    rows.append((nr, found[0]["score"], [{"bits": bits(h["score"]), "expect": space / 2.0 ** bits(h["score"]), **h} for h in found]))
            yield pd.DataFrame(rows, columns=["doc_nr", "top", "hsps"])

    types = "score int, q_from int, q_to int, s_from int, s_to int, identity int, positive int, gaps int, q_line string, midline string, s_line string, bits int, expect double"
    hits = seqs.select("doc_nr", "seq").mapInPandas(run, f"doc_nr bigint, top int, hsps array<struct<{types}>>")
    best = hits.orderBy(F.desc("top"), "doc_nr").limit(p.limit)
    each = best.select("doc_nr", "top", F.explode("hsps").alias("h")).select("doc_nr", "top", *[F.col(f"h.{c}").alias(c) for c in (*names, "bits", "expect")])
    return each.orderBy(F.desc("top"), "doc_nr", F.desc("score"), "q_from", "s_from").drop("top")


def report_xml(hits: DataFrame) -> DataFrame:
    """(value): one XML element for each HSP."""
    parts = [F.concat(F.lit(f"<Hsp_{c}>"), F.col(c).cast("string"), F.lit(f"</Hsp_{c}>")) for c in ("score", "bits", "expect", "q_from", "q_to", "s_from", "s_to", "identity", "positive", "gaps", "q_line", "midline", "s_line")]
    return hits.select(F.concat(F.lit("<Hit><Hit_id>"), F.col("doc_nr").cast("string"), F.lit("</Hit_id><Hsp>"), *parts, F.lit("</Hsp></Hit>")).alias("value"))
