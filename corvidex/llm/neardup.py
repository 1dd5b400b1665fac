"""Near-duplicate documents by the Jaccard similarity of their five-word shingles.

Two texts are linked if their sets of shingles have a similarity of 0.8 or more;
one document of each linked group stays. Candidates come from operator 6's
fingerprints and covering masks, here over the sets: every pair that differs in three bits at most
shares the key of some mask. Most similar pairs differ in more bits (at 0.8 in about ten), so
min-hashes give the rest: 40 bands
of five, so a pair of similarity 0.8 shares a band but for 1.3e-7, and a more
similar pair still more surely. Every candidate is then held against the sets
themselves, so nothing below 0.8 is linked.

Only distinct sets are compared, so exact copies cost one row; buckets with the same
members are one. Inside a bucket no pairs are emitted: a worker returns a spanning
forest of the links. A bucket above ``MOST`` sets is first compared in parts, each with the
same few others, which joins what is linked closely in work that grows with the bucket. Only the sets that
are then not in the largest component of their group (of such buckets with common
sets) are held against all of the group, in blocks that a worker can hold, so
every pair that could join two components is compared.

Cases: a null or blank text has the empty shingle only; fewer words than a shingle count as
one shingle; rows with a null key stay and link nothing; rows that share a key but not the
text are documents of their own; rows that share both count as one; an empty table
gives an empty result; other columns are passed through. Shingles and sets are told apart by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import bounded_batches, cut
from .components import components
from .simhash import SEED, masks, spanning

SHINGLE = 5
#: Least similarity of a link, as a fraction.
ALIKE = (4, 5)
BANDS, ROWS = 40, 5
#: Sets that one worker compares at a time, and of a larger bucket those that each of its parts holds.
MOST, PIVOTS = 4096, 16
#: Bytes of the bits by which the sets of a block are compared; more are compared by their codes.
BITS = 64 << 20
#: Texts with candidates up to this number are found by a broadcast of their ids.
FEW_IDS = 100_000

_RANDOM = np.random.default_rng(SEED)
_MASKS = np.array(masks(list(range(64))), np.uint64)
_FLIP = _RANDOM.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one whole text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes, as for fingerprints
    line = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return np.array([xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.unique(np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n))


def digest(one: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(one.tobytes())


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, a key for each band; two sets share it if all min-hashes of the band agree."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    keys = np.empty((len(sets), BANDS), np.uint64)
    for t in range(BANDS):
        key = np.full(len(sets), t, np.uint64)
        for i in range(t * ROWS, (t + 1) * ROWS):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.minimum.reduceat((flat ^ _FLIP[i]) * _TIMES[i], starts)
        keys[:, t] = key ^ (key >> np.uint64(32))
    return keys


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, the bits that over half of its hashes have."""
    size = np.array([len(s) for s in sets])
    bits = np.unpackbits(np.concatenate(sets).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, np.cumsum(size) - size, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def covers(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, a key for each mask; two sets whose fingerprints differ in three bits at most share one."""
    key = (fingerprints(sets)[:, None] & _MASKS) ^ (np.arange(1, len(_MASKS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for _ in range(2):  # bits of the fingerprint alone would be dealt out unevenly, and could be a band's key
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return key ^ (key >> np.uint64(32))


def candidates(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, the keys of its bands and masks; sets that share any are compared."""
    return np.concatenate((bands(sets), covers(sets)), axis=1)


def nearness(sets: list[np.ndarray]) -> Callable[[int], np.ndarray]:
    """A function that tells which of the sets are linked to the set of an index, itself included."""
    n, (up, down) = len(sets), ALIKE
    _, codes, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    size = np.array([len(s) for s in sets])
    stops = np.cumsum(size)
    starts = stops - size
    met = times > 1
    # What is in one set only is in no intersection, and a link takes four fifths of both sets.
    alone = down * np.add.reduceat(met[codes].astype(np.int64), starts) < up * size
    words = -(-int(met.sum()) // 64)
    if 2 * words <= size.mean() and 8 * words * n <= BITS:
        place = np.cumsum(met) - 1
        bits = np.zeros((n, words), np.uint64)
        for at in range(0, n, 256):
            to = min(n, at + 256)
            here = codes[starts[at] : stops[to - 1]]
            row = np.repeat(np.arange(to - at), size[at:to])[met[here]]
            held = np.zeros((to - at, 64 * words), np.uint8)
            held[row, place[here[met[here]]]] = 1
            bits[at:to] = np.packbits(held, axis=1).view(np.uint64)

        def common(i: int) -> np.ndarray:
            return np.bitwise_count(bits & bits[i]).sum(1, dtype=np.int64)

    else:
        mark = np.zeros(len(times), np.int64)

        def common(i: int) -> np.ndarray:
            mine = codes[starts[i] : stops[i]]
            mark[mine] = 1
            both = np.add.reduceat(mark[codes], starts)
            mark[mine] = 0
            return both

    def near(i: int) -> np.ndarray:
        linked = np.zeros(n, bool) if alone[i] else common(i) * (up + down) >= up * (size + size[i])
        linked[i] = True
        return linked

    return near


def alike(sets: list[np.ndarray]) -> np.ndarray:
    """For each of the sets, the index of its component's first one; every link counts."""
    return spanning(len(sets), nearness(sets))


def across(sets: list[np.ndarray], root: np.ndarray, mine: np.ndarray) -> tuple[list[int], list[int]]:
    """Links of the sets marked in ``mine`` to any of the sets that join components; ``root`` names those known."""
    near = nearness(sets)
    _, codes = np.unique(root, return_inverse=True)
    parent = list(range(len(sets)))

    def find(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    a, b = [], []
    for i in np.flatnonzero(mine).tolist():
        reached = np.flatnonzero(near(i))
        found, first = np.unique(codes[reached], return_index=True)
        for c, j in zip(found.tolist(), reached[first].tolist()):
            if (x := find(c)) != (y := find(int(codes[i]))):
                parent[x] = y
                a.append(i)
                b.append(j)
    return a, b


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, h, fp, bands) for every row: a hash of its text, one of its set, and the set's keys, of bands and then of masks."""
    bounded_batches(docs.sparkSession)
    each = BANDS + len(_MASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, keys, held, n = [], [np.empty((0, each), np.uint64)], [], 0
            for x in b.column(2).to_pylist():
                held.append(shingles(x))
                fps.append(digest(held[-1]))
                n += len(held[-1])
                if n > 1 << 17:
                    keys.append(candidates(held))
                    held, n = [], 0
            if held:
                keys.append(candidates(held))
            flat = np.concatenate(keys).view(np.int64).ravel()
            several = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, each, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), several], [key, "h", "fp", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.xxhash64(text).alias("h"), text).mapInArrow(run, f"`{key}` {kind}, h bigint, fp bigint, bands array<bigint>")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows and group borders; rows are sorted by the first column, and its groups are never torn."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        k = b.column(0).to_numpy(zero_copy_only=False)
        last = np.flatnonzero(k != k[-1]) if len(k) else k
        if len(last) or held and len(k) and held[-1].column(0)[-1].as_py() != k[0]:
            stop = int(last[-1]) + 1 if len(last) else 0
            yield _bordered([*held, b.slice(0, stop)])
            held, b = [], b.slice(stop)
        if b.num_rows:
            held.append(b)
    if held:
        yield _bordered(held)


def _bordered(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    rows = pa.Table.from_batches(held)
    k = rows.column(0).to_numpy()
    return rows, np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))


def blocks(sets: DataFrame, most: int = MOST) -> DataFrame:
    """(block, fp, large): the sets that share a key, in a block of ``most`` sets at most.

    Of a larger bucket the blocks are its parts, and all of its sets are given once more under its key, as ``large``.
    """
    bounded_batches(sets.sparkSession, 1 << 16)
    names = ["block", "fp", "large"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        def out(these: list[np.ndarray]) -> pa.RecordBatch:
            ids = np.array([xxh64_intdigest(x.tobytes(), SEED) for x in these], np.uint64).view(np.int64)
            flat = np.concatenate(these)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(x) for x in these])), pa.array(flat), pa.array(np.zeros(len(flat), bool))], names)

        for rows, cuts in _whole(batches):
            k, fp, these, n = rows.column(0).to_numpy(), rows.column(1).to_numpy(), [], 0
            for b in np.flatnonzero(np.diff(cuts) > 1):
                x = np.unique(fp[cuts[b] : cuts[b + 1]])
                parts = [x]
                if len(x) > most:
                    pivots = x[:: -(-len(x) // min(PIVOTS, most // 4))]  # as good as any others, being sorted by a hash
                    parts = [np.union1d(p, pivots) for p in np.array_split(x, -(-len(x) // (most - len(pivots))))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k[cuts[b]])), pa.array(x), pa.array(np.ones(len(x), bool))], names)
                for y in parts:
                    these.append(y)
                    n += len(y)
                    if n > 1 << 16:
                        yield out(these)
                        these, n = [], 0
            if these:
                yield out(these)

    rows = sets.select(F.explode("bands").alias("k"), "fp").repartition("k").sortWithinPartitions("k")
    return rows.mapInArrow(run, "block bigint, fp bigint, large boolean").distinct()


def rest(large: DataFrame, roots: DataFrame, most: int = MOST) -> DataFrame:
    """(block, fp, root, mine): blocks in which the sets of large buckets outside of the largest component, marked as mine, meet all.

    Buckets with common sets are one group, so that no pair is compared for each of its bands. Columns block, fp of ``large``, node, root of ``roots``.
    """
    first = large.groupBy("fp").agg(F.min("block").alias("b"))
    joined = components(large.join(first, "fp").select(F.col("block").alias("a"), "b").distinct()).select(F.col("node").alias("block"), F.col("root").alias("g"))
    sets = large.join(joined, "block", "left").select(F.coalesce("g", "block").alias("g"), "fp").distinct()
    known = cut(sets.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("g", "fp", F.coalesce("root", "fp").alias("root")))
    sizes = known.groupBy("g", "root").agg(F.count("*").alias("n"))
    half = F.lit(max(1, most // 2))
    # Parts are dealt by a hash: of so many sets that they are a little smaller than half a block on average.
    plan = sizes.groupBy("g").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"))
    plan = plan.select("g", F.col("top.root").alias("top"), F.ceil(1.1 * (F.col("n") - F.col("top.n")) / half).alias("p"), F.ceil(1.1 * F.col("n") / half).alias("q")).where("p > 0")
    rows = known.join(F.broadcast(plan), "g")  # a row for each group of more than ``most`` sets
    i, j = F.pmod(F.xxhash64("fp"), "p"), F.pmod(F.xxhash64("fp"), "q")
    mine = rows.where("root <> top").select("g", "fp", "root", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("j"), F.lit(True).alias("mine"))
    every = rows.select("g", "fp", "root", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i"), j.alias("j"), F.lit(False).alias("mine"))
    both = mine.union(every).select(F.xxhash64("g", "i", "j").alias("block"), "fp", "root", "mine")
    return both.groupBy("block", "fp", "root").agg(F.max("mine").alias("mine"))


def _contents(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(fp, content) for the texts with the ids and hashes in ``wanted``: the hashes of the set, in bytes."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x) for x in b.column(0).to_pylist()]
            fps = np.array([digest(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "content"])

    few = wanted.count() <= FEW_IDS
    rows = docs.select(key, F.xxhash64(text).alias("h"), text).join(F.broadcast(wanted) if few else wanted, [key, "h"], "left_semi")
    return rows.select(text).mapInArrow(run, "fp bigint, content binary").dropDuplicates(["fp"])


def _links(held: DataFrame) -> DataFrame:
    """(a, b) links that span all links inside each block; columns block, fp, content. With root and mine, links that join what is mine to another component."""
    bounded_batches(held.sparkSession)
    more = [c for c in ("root", "mine") if c in held.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _whole(batches):
            fp, content = rows.column(1).to_numpy(), rows.column(2)
            a, b = [fp[:0]], [fp[:0]]
            for at, to in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if to - at > 1:
                    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in content.slice(at, to - at)]
                    if more:
                        moved, label = (np.array(x, np.int64) for x in across(sets, *(rows.column(c).to_numpy()[at:to] for c in more)))
                    else:
                        label = alike(sets)
                        moved = np.flatnonzero(label != np.arange(to - at))
                        label = label[moved]
                    a.append(fp[at + moved])
                    b.append(fp[at + label])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return held.select("block", "fp", "content", *more).repartition("block").sortWithinPartitions("block").mapInArrow(run, "a bigint, b bigint")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """The rows of ``docs`` less all but the one with the smallest key of each group; rows with a null key stay."""
    some = docs.where(F.col(key).isNotNull())
    rows = cut(sketches(some, key, text))
    first = cut(rows.groupBy("fp").agg(F.min(F.struct(key, "h")).alias("least"), F.first("bands").alias("bands")))
    met = cut(blocks(first.select("fp", "bands"), most))
    wanted = cut(first.join(met.select("fp").distinct(), "fp", "left_semi").select("least.*"))
    contents = _contents(some, wanted, key, text)
    large = met.where("large").select("block", "fp")
    several = not large.isEmpty()
    contents = cut(contents) if several else contents
    links = _links(met.where("not large").select("block", "fp").join(contents, "fp"))
    if several:
        links = cut(links)
        links = links.union(_links(rest(large, cut(components(links)), most).join(contents, "fp")))
    roots = components(links).withColumnRenamed("node", "fp")
    joined = first.select("fp", "least").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = joined.groupBy("root").agg(F.min("least").alias("least")).select(F.col(f"least.{key}").alias(key), F.col("least.h").alias("_text_hash"))
    found = docs.withColumn("_text_hash", F.xxhash64(text)).join(kept, [key, "_text_hash"], "left_semi").dropDuplicates([key, "_text_hash"])
    return found.select(*docs.columns).unionByName(docs.where(F.col(key).isNull()))
