"""Approximate nearest neighbours by largest inner product, on robust-pruned directed graphs.

Distinct vectors are dealt over shards of bounded size. Each shard builds a
graph: a greedy beam search from fixed entry nodes proposes neighbours for each
node, and robust pruning keeps a neighbour only if no kept one is nearer to it
by a factor, which leaves diverse edges. Inner products become distances on a
sphere by one more coordinate. Queries come in blocks; a beam search runs over
every shard's graph for every block, and the shards' bests are merged by exact
scores in double precision. So the searches are as many as the queries times the shards,
and shards are as large as a worker's memory allows; the more there are, the narrower the beam.

Equal vectors form one class, with the smallest ids that any query can need
(one more than asked for), found with a limit before the shuffle, so a vector
that a third of all rows share costs no more than others. Every row is indexed.

Cases: rows with a null id, a null or zero vector, or one with null or
non-finite components take no part; vectors of different lengths have no inner product,
so each length has shards of its own; with fewer candidates than asked for, all are
returned; ties go to the smaller id; a repeated id is one candidate
for each of its different vectors and asks with each; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._common import bounded_batches, cut

#: Vectors of a shard and queries of a block, and values (vectors times their length) of a shard: what one task holds in memory.
SHARD, BLOCK, VALUES = 65_536, 65_536, 1 << 23
#: Shards below these bounds, and vectors that each of them has at least.
AT_LEAST, SMALL = 4, 4096
DEGREE, BUILD_BEAM, BEAM, ALPHA, ENTRIES, AT_ONCE = 32, 64, 256, 1.2, 16, 4


def _beam(x: np.ndarray, edges: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` best nodes that a greedy search finds for each row of q, unordered, and their inner products; -1 fills up."""
    m, n = len(q), len(x)
    width = max(beam, len(entries))
    ids, sims = np.full((m, width), -1, np.int64), np.full((m, width), -np.inf, np.float32)
    ids[:, : len(entries)], sims[:, : len(entries)] = entries, q @ x[entries].T
    done = ids < 0
    seen = np.zeros((m, n), bool)
    seen[:, entries] = True
    rows = np.arange(m)
    while len(rows):
        open_ = np.where(done[rows], -np.inf, sims[rows])
        best = np.argpartition(-open_, AT_ONCE - 1, axis=1)[:, :AT_ONCE] if width > AT_ONCE else np.tile(np.arange(width), (len(rows), 1))
        live = np.take_along_axis(open_, best, 1) > -np.inf
        more = live.any(1)
        rows, best, live = rows[more], best[more], live[more]
        if not len(rows):
            break
        node = np.where(live, ids[rows[:, None], best], -1)
        done[rows[:, None], best] = True
        near = np.where(node[:, :, None] >= 0, edges[node], -1)
        for w in range(near.shape[1]):  # a node that two of them lead to counts once
            part = near[:, w]
            part[seen[rows[:, None], part]] = -1
            r, c = np.nonzero(part >= 0)
            seen[rows[r], part[r, c]] = True
        near = near.reshape(len(rows), -1)
        got = np.matmul(x[near], q[rows][:, :, None])[:, :, 0]
        got[near < 0] = -np.inf
        all_s, all_i = np.concatenate((sims[rows], got), 1), np.concatenate((ids[rows], near), 1)
        all_d = np.concatenate((done[rows], near < 0), 1)
        top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
        sims[rows], ids[rows], done[rows] = (np.take_along_axis(a, top, 1) for a in (all_s, all_i, all_d))
        ids[rows] = np.where(np.isneginf(sims[rows]), -1, ids[rows])
        done[rows] |= ids[rows] < 0
    return ids, sims


def _prune(x: np.ndarray, nodes: np.ndarray, options: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node the pruned list of its options (rows of node numbers, -1 for none).

    Places that pruning leaves free go to the options with the largest inner products with
    the node itself: where norms differ, those are what a query near the node asks for, and
    few of them are near neighbours.
    """
    out = np.full((len(nodes), degree), -1, np.int64)
    radius = 2 * float(np.einsum("d,d->", x[nodes[0]], x[nodes[0]]))  # all have the same norm
    for at in range(0, len(nodes), 256):
        mine_x = x[nodes[at : at + 256]]
        o = np.sort(options[at : at + 256], 1)
        bad = (o < 0) | (o == nodes[at : at + 256, None])
        bad[:, 1:] |= o[:, 1:] == o[:, :-1]
        v = x[o]
        inner = np.matmul(v[:, :, :-1], mine_x[:, :-1, None])[:, :, 0]
        mine = radius - 2 * (inner + v[:, :, -1] * mine_x[:, -1:])
        between = radius - 2 * np.matmul(v, v.transpose(0, 2, 1))
        mine[bad] = np.inf
        r = np.arange(len(o))
        left, taken = mine.copy(), bad.copy()
        for k in range(degree):
            pick = left.argmin(1)
            ok = np.isfinite(left[r, pick])
            if not ok.any():
                break
            out[at : at + len(o)][ok, k] = o[r, pick][ok]
            taken[r[ok], pick[ok]] = True
            left[alpha * between[r, pick] <= mine] = np.inf
            left[r, pick] = np.inf
        inner[taken] = -np.inf
        order = np.argsort(-inner, axis=1)[:, :degree]
        rest = np.where(np.isneginf(np.take_along_axis(inner, order, 1)), -1, np.take_along_axis(o, order, 1))
        free = out[at : at + len(o)] < 0
        place = np.minimum(np.cumsum(free, 1) - 1, rest.shape[1] - 1)
        out[at : at + len(o)] = np.where(free, np.take_along_axis(rest, np.maximum(place, 0), 1), out[at : at + len(o)])
        if rest.shape[1] < degree:  # fewer options than places: none is listed twice
            out[at : at + len(o)][free & (np.cumsum(free, 1) > rest.shape[1])] = -1
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entries) of the graph over the rows of ``vectors``."""
    x = lifted(vectors)
    n, rng = len(x), np.random.default_rng(7)
    slack = degree + degree // 2
    edges = np.full((n, slack), -1, np.int64)
    longest = np.argsort(x[:, -1], kind="stable")[: ENTRIES // 2]  # the last coordinate is the less, the longer a vector is
    entries = np.unique(np.concatenate(([int((x @ x.mean(0)).argmax())], longest, rng.choice(n, min(n, ENTRIES - 1), replace=False))))
    if n <= degree + 1:
        edges[:, :n] = np.where(np.eye(n, dtype=bool), -1, np.arange(n))
        return edges[:, :degree], entries
    edges[:, : degree // 4] = rng.integers(0, n, (n, degree // 4))
    flat = np.concatenate((x[:, :-1], np.zeros((n, 1), np.float32)), 1)
    differ = bool(x[:, -1].max() > 0.05)
    order, at, size = rng.permutation(n), 0, 64
    while at < n:
        nodes = order[at : at + size]
        at, size = at + size, min(512, size * 2)
        found = [_beam(x, edges, entries, x[nodes], beam)[0], edges[nodes]]
        if differ:  # what has the largest inner product is sought too
            found.append(_beam(x, edges, entries, flat[nodes], beam)[0])
        edges[nodes] = -1
        edges[nodes, :degree] = kept = _prune(x, nodes, np.concatenate(found, 1), degree, alpha)
        src, dst = np.repeat(nodes, degree), kept.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order_ = np.argsort(dst, kind="stable")
        src, dst = src[order_], dst[order_]
        to, first, count = np.unique(dst, return_index=True, return_counts=True)
        fresh = np.full((len(to), int(count.max())), -1, np.int64)
        fresh[np.repeat(np.arange(len(to)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
        both = np.concatenate((edges[to], fresh), 1)
        s = np.sort(both, 1)[:, ::-1].copy()
        s[:, 1:][s[:, 1:] == s[:, :-1]] = -1
        full = (s >= 0).sum(1) > slack
        s = np.sort(s, 1)[:, ::-1]
        edges[to[~full]] = s[~full, :slack]
        if full.any():
            wide = int((s[full] >= 0).sum(1).max())
            edges[to[full]] = -1
            edges[to[full], :degree] = _prune(x, to[full], s[full][:, :wide], degree, alpha)
    return edges, entries


def lifted(vectors: np.ndarray) -> np.ndarray:
    """The vectors with one more coordinate that gives all the same norm: the largest inner product is then the least distance."""
    v = vectors / np.sqrt(np.square(vectors).sum(1).max())
    return np.concatenate((v, np.sqrt(np.maximum(0, 1 - np.square(v).sum(1)))[:, None]), 1).astype(np.float32)


def query(vectors: np.ndarray, edges: np.ndarray, entries: np.ndarray, q: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """For each query the numbers (-1: none) and exact inner products of the k best nodes found."""
    x = np.concatenate((vectors / np.sqrt(np.square(vectors).sum(1).max()), np.zeros((len(vectors), 1))), 1).astype(np.float32)
    scale = np.abs(q).max(1, keepdims=True)
    y = np.concatenate((q / scale, np.zeros((len(q), 1))), 1).astype(np.float32)
    best, score = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -np.inf)
    for at in range(0, len(q), 256):
        ids, _ = _beam(x, edges, entries, y[at : at + 256], beam)
        exact = np.einsum("qd,qnd->qn", q[at : at + 256], vectors[ids])
        exact[ids < 0] = -np.inf
        order = np.lexsort((ids, -exact), axis=1)[:, :k]
        best[at : at + 256, : order.shape[1]] = np.take_along_axis(ids, order, 1)
        score[at : at + 256, : order.shape[1]] = np.take_along_axis(exact, order, 1)
    best[np.isneginf(score)] = -1
    return best, score


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _nullable(column: pa.ChunkedArray) -> pa.ChunkedArray:
    """The lists with elements that may be null, as the declared result has them."""
    return column.cast(pa.list_(column.type.value_type))


def _whole(table: pa.Table) -> pa.RecordBatch:
    return table.combine_chunks().to_batches(max_chunksize=None)[0]


def _lists(rows: np.ndarray) -> pa.ListArray:
    """Rows of node numbers, -1 for none, as lists without the -1."""
    there = rows >= 0
    ends = np.concatenate(([0], np.cumsum(there.sum(1)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows[there].astype(np.int32)))


def _rectangle(lists: pa.ChunkedArray) -> np.ndarray:
    """The inverse of ``_lists``."""
    flat = lists.combine_chunks()
    n = np.diff(flat.offsets.to_numpy())
    out = np.full((len(n), max(1, int(n.max(initial=1)))), -1, np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = flat.flatten().to_numpy()
    return out


def shards_of(n: int, d: int, shard: int = SHARD) -> int:
    """How many shards n vectors of length d get: of ``shard`` vectors or ``VALUES`` values at most; a few smaller ones, too, so that several tasks share the work."""
    most = max(1, min(shard, VALUES // d))
    return max(1, -(-n // most), min(AT_LEAST, n // SMALL))


def beam_of(shards: int, beam: int = BEAM) -> int:
    """The more shards there are, the fewer of the nearest rows each one holds, and the narrower its beam may be, down to half."""
    return max(beam // 2, math.ceil(beam / math.sqrt(shards)))


def search(rows: DataFrame, asks: Column, k: int = 20, key: str = "vec_id", vec: str = "embedding", shard: int = SHARD, block: int = BLOCK, degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for each usable row with ``asks`` true, the k nearest other rows found."""
    spark = rows.sparkSession
    bounded_batches(spark, 4096)
    good = rows.select(F.col(key).alias("id"), F.col(vec).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & _usable(F.col("v"))).distinct()
    w = Window.partitionBy("v").orderBy("id")
    classes = cut(good.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("d", F.size("v")))
    # Numbered, as an id may ask with several vectors.
    asked = cut(good.where("asks").select("v").distinct().withColumn("q", F.monotonically_increasing_id()).withColumn("d", F.size("v")))
    counts = lambda df: {r["d"]: r["n"] for r in df.groupBy("d").agg(F.count("*").alias("n")).collect()}  # noqa: E731  # a row for each length of vectors
    n, m = counts(classes), counts(asked)
    plan = [(d, shards_of(n[d], d, shard), max(1, -(-m.get(d, 0) // block))) for d in sorted(n)]
    kind = rows.schema[key].dataType.simpleString()
    vtype = rows.schema[vec].dataType.simpleString()
    dealt = F.broadcast(spark.createDataFrame(plan, "d int, shards int, blocks int"))

    def graph(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending")])
        edges, entries = build(_matrix(_whole(t).column("v")), degree)
        return pa.table({"d": t["d"], "shard": t["shard"], "blocks": t["blocks"], "node": pa.array(range(len(t)), pa.int32()), "v": _nullable(t["v"]), "ids": _nullable(t["ids"]), "near": _lists(edges), "entry": pa.array(np.isin(np.arange(len(t)), entries))})

    each_class = classes.join(dealt, "d").select("d", "v", "ids", F.col("ids")[0].alias("id"), "blocks", F.expr("cast(pmod(xxhash64(ids[0], v), shards) as int)").alias("shard"))
    index = cut(each_class.groupBy("d", "shard").applyInArrow(graph, f"d int, shard int, blocks int, node int, v {vtype}, ids array<{kind}>, near array<int>, entry boolean"))

    def look(_key, g: pa.Table, q: pa.Table) -> pa.Table:
        out = {"q": [], "id": [], "score": []}
        if len(g) and len(q):
            g = g.sort_by([("node", "ascending")])
            wide = max(beam_of(q["shards"][0].as_py(), beam), k + 1)
            best, score = query(_matrix(_whole(g).column("v")), _rectangle(g["near"]), np.flatnonzero(g["entry"].to_numpy()), _matrix(_whole(q).column("v")), k + 1, wide)
            ids, names = g["ids"].to_pylist(), q["q"].to_pylist()
            for i, name in enumerate(names):
                ranked = sorted((-float(s), one) for j, s in zip(best[i], score[i]) if j >= 0 for one in ids[j])[: k + 1]
                out["q"] += [name] * len(ranked)
                out["id"] += [r[1] for r in ranked]
                out["score"] += [-r[0] for r in ranked]
        types = {"q": pa.int64(), "id": g.schema.field("ids").type.value_type, "score": pa.float64()}
        return pa.table({c: pa.array(v, types[c]) for c, v in out.items()})

    graphs = index.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
    queries = asked.join(dealt, "d").withColumn("block", F.expr("cast(pmod(xxhash64(q), blocks) as int)")).withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)"))).drop("blocks")
    found = graphs.groupBy("d", "shard", "block").cogroup(queries.groupBy("d", "shard", "block")).applyInArrow(look, f"q bigint, id {kind}, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("best"))
    answers = best.join(asked, "q").select("v", "best")
    each = good.where("asks").select("id", "v").distinct().join(answers, "v")
    own = F.col("id")
    listed = each.select(own.alias("query_id"), F.posexplode(F.slice(F.filter("best", lambda b: b["id"] != own), 1, k)).alias("pos", "b"))
    return listed.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.s")).alias("score"))
