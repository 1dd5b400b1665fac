"""SimHash fingerprints and near-duplicate groups by covering locality-sensitive hashing.

A fingerprint has 64 bits, each the majority over the XXH64 values (seed 42) of
the text's word shingles. Two fingerprints are linked if at most three bits
differ. Each bit position carries a vector of radius + 1 = 4 binary coordinates; for
every non-zero vector v, table v keys on the positions whose vector is orthogonal
to v. For any three differing positions some v is orthogonal to all, so every pair
within the radius meets in some of the 15 tables: no link is lost.

Only distinct fingerprints are hashed, so exact copies cost one row. Inside a
bucket no pairs are emitted: a worker returns a spanning forest of the links.
Buckets above ``MOST`` fingerprints are covered once more on the 32 positions
that their table leaves out; what is left then differs in 16 positions only.

Cases: a null or blank text has fingerprint 0 and is linked like any other;
fewer words than a shingle count as one shingle; rows with a null doc_id get a
fingerprint and the component of the others with near fingerprints (null if
there are none); repeated rows and ids stay; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._common import bounded_batches, cut
from .components import components

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Distinct fingerprints of a bucket that one worker compares before the bucket is covered again.
MOST = 4096
#: Buckets up to this size are compared row against row, all buckets of a batch at once.
FEW = 16

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one whole text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the white space 09-0D and 20
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 17):
        h = np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[at : at + (1 << 17)], stops[at : at + (1 << 17)])), np.uint64)
        octets = h.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
        ones += (np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(key, fp) for every row; fp is the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x, shingle, seed) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp bigint")


def masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Bit masks such that any ``radius`` positions lie outside at least one of them."""
    n = radius + 1
    out = []
    for v in range(1, 1 << n):
        out.append(sum(1 << p for k, p in enumerate(positions) if bin((k % (1 << n)) & v).count("1") % 2 == 1))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(fp: Column, several: list[int]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(signed(m))).alias("k")) for t, m in enumerate(several)]))


def _near(x: np.ndarray, y: np.ndarray | np.uint64, radius: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= radius


def spanning(n: int, near: Callable[[int], np.ndarray]) -> np.ndarray:
    """For each of n things, the index of its component's first one; near(i) tells which ones are linked to thing i.

    Each pivot is compared with all; what it reaches needs no pivot of its own.
    Links between two reached fingerprints matter only across components: the
    reached ones of all components but the largest are compared with all others.
    """
    cover, parent, pivot = np.full(n, -1), list(range(n)), np.zeros(n, bool)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> None:
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)

    for p in range(n):
        if cover[p] >= 0:
            continue
        reached = np.flatnonzero(near(p))
        pivot[p] = True
        for c in np.unique(cover[reached]).tolist():
            if c >= 0:
                join(c, p)
        reached = reached[cover[reached] < 0]
        cover[reached] = p
    label = np.array([root(int(c)) for c in cover])
    if len(found := np.unique(label)) > 1 and not pivot.all():
        rest = np.flatnonzero((label != found[np.argmax(np.bincount(label)[found])]) & ~pivot)
        for i in rest.tolist():
            for c in np.unique(label[near(i)]).tolist():
                join(c, int(label[i]))
        label = np.array([root(int(c)) for c in label])
    return label


def forest(x: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The same for distinct fingerprints."""
    return spanning(len(x), lambda i: _near(x, x[i], radius))


def _links(t: np.ndarray, k: np.ndarray, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of whole buckets that lie one after the other."""
    cuts = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (k[1:] != k[:-1]), [True])))
    sizes = np.diff(cuts)
    label = np.arange(len(x))
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    small = (sizes <= FEW)[bucket]
    pairs = []
    for lag in range(1, min(FEW, int(sizes.max(initial=1)))):
        i = np.flatnonzero((bucket[lag:] == bucket[:-lag]) & small[lag:])
        i = i[_near(x[i], x[i + lag], radius)]
        pairs.append((i, i + lag))
    if pairs:
        i, j = (np.concatenate(p) for p in zip(*pairs))
        while True:
            least = np.minimum(label[i], label[j])
            if (label[i] == least).all() and (label[j] == least).all():
                break
            np.minimum.at(label, i, least)
            np.minimum.at(label, j, least)
    for b in np.flatnonzero(sizes > FEW):
        at, to = cuts[b], cuts[b + 1]
        label[at:to] = at + forest(x[at:to], radius)
    moved = np.flatnonzero(label != np.arange(len(x)))
    return x[moved], x[label[moved]]


def _bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b) links that span all links inside each bucket (t, k); a bucket has few enough rows for a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            held = cols if held is None else [np.concatenate(p) for p in zip(held, cols)]
            t, k, _ = held
            if not len(t):
                continue
            last = np.flatnonzero((t != t[-1]) | (k != k[-1]))  # the last bucket may go on in the next batch
            stop = last[-1] + 1 if len(last) else 0
            if stop:
                yield out(*(c[:stop] for c in held))
                held = [c[stop:] for c in held]
        if held is not None and len(held[0]):
            yield out(*held)

    def out(t: np.ndarray, k: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        a, b = _links(t, k, x.view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return rows.select("t", "k", "fp").repartition("t", "k").sortWithinPartitions("t", "k").mapInArrow(run, "a bigint, b bigint")


def links(fps: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Links between distinct fingerprints (column fp) that connect whatever a chain of near fingerprints connects."""
    bounded_batches(fps.sparkSession, 1 << 16)
    first = masks(list(range(64)), radius)
    rows = fps.select("fp", _keys(F.col("fp"), first).alias("e")).select("e.t", "e.k", "fp")
    large = cut(rows.groupBy("t", "k").count().where(F.col("count") > most).select("t", "k"))
    if large.isEmpty():
        return _bucket_links(rows, radius)
    hot, rest = rows.join(large, ["t", "k"], "left_semi"), rows.join(large, ["t", "k"], "left_anti")
    again = []
    for t, m in enumerate(first):
        outside = [p for p in range(64) if not m >> p & 1]
        several = [m | s for s in masks(outside, radius)]
        mine = hot.where(F.col("t") == t)
        again.append(F.when(F.col("t") == t, F.array(*[F.struct(F.lit(100 + t * len(several) + i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(s))).alias("k")) for i, s in enumerate(several)])))
    second = hot.select("fp", F.explode(F.coalesce(*again)).alias("e")).select("e.t", "e.k", "fp")
    return _bucket_links(rest.union(second), radius)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(key, fp, component_id) for every row of ``docs``; component_id is the smallest key that can be reached."""
    rows = cut(fingerprints(docs, key, text))
    first = cut(rows.groupBy("fp").agg(F.min(key).alias("least")))
    roots = cut(components(links(first.select("fp"), radius, most)))
    joined = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(joined.join(least, "root").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def hexadecimal(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one with the smallest key of each group; rows with a null key stay.

    Rows that share key and text count as one document: of those, one stays. Rows that share
    only the key are documents of their own groups.
    """
    some = docs.where(F.col(key).isNotNull())
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x) for x in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["key", "h", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    rows = cut(some.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), text).mapInArrow(run, f"key {kind}, h bigint, fp bigint"))
    # Null keys link others, as in groups.
    null = fingerprints(docs.where(F.col(key).isNull()), key, text).select("fp")
    roots = cut(components(links(cut(rows.select("fp").union(null).distinct()))))
    first = rows.groupBy("fp").agg(F.min(F.struct("key", "h")).alias("least"))
    joined = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = joined.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.key").alias(key), F.col("least.h").alias("_text_hash"))
    found = docs.withColumn("_text_hash", F.xxhash64(text)).join(kept, [key, "_text_hash"], "left_semi").dropDuplicates([key, "_text_hash"])
    return found.select(*docs.columns).unionByName(docs.where(F.col(key).isNull()))
