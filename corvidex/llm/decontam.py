"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Texts become words (runs of letters and digits, lower-cased). A mask picks four
words of a window and ignores those between; the hash of the picked words is a
seed. Test and training seeds are joined; around each hit the whole test item is
laid over the document, and the words that agree are counted. An item overlaps a
document if, at some hit, at least ``SIMILAR`` of some ``WINDOW`` neighbouring words
of it agree (of all its words, if it has fewer): up to a fifth may be substituted,
and a passage taken from a long item is found too; so is one of ``RUN`` words or more that is quoted without a change. The three masks find every such overlap: in 10 to 20 words no
placement of the substitutions breaks all masks everywhere. Items under 10 words are sought by runs: the whole item
below five words, else its two halves, one of which is free of substitutions.

Most windows have no test seed. They are dropped right where they are made, by a
bitmap over the test seeds, before any row is built or moved. It has 16 bits a
seed, and between 512 KB and 8 MB. The join after it is exact, so the bitmap only saves work. The test seeds, and the
items' words after them, are each broadcast if their measured size allows, else both sides are shuffled
and the test side is replicated over salts, so a passage that
many documents hold is spread.

Cases: null or wordless texts and items match nothing; rows with a null doc_id
or item_id are compared and reported under a null id; repeated rows and ids
count once, with their best overlap; an empty table on either side gives no overlaps;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MASKS = ((0, 1, 2, 4), (0, 1, 4, 6), (0, 2, 5, 6))
SHORT, SIMILAR, WINDOW, RUN = 10, 0.8, 20, 13
#: Words of 64 bits in the bitmap, at least and at most.
BITMAPS = 1 << 16, 1 << 20
#: Bytes of test seeds, or of items, up to which they are broadcast; and salts beyond it.
BROADCAST, SALTS = 16 << 20, 16
WORD_BREAK = r"[^\p{L}\p{N}]+"


def words(text: str | Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")


def hashes(text: str | Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _seed(h: Column, at: Column, offsets: tuple[int, ...], kind: int) -> Column:
    """The hash of the picked words from position ``at`` on; null where the window leaves the text."""
    return F.when(F.get(h, at + offsets[-1]).isNotNull(), F.xxhash64(F.lit(kind), *[F.get(h, at + o) for o in offsets]))


def _kinds(runs: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """(kind, offsets) of all masks and of the runs that short items need."""
    return [*enumerate(MASKS), *[(100 + r, tuple(range(r))) for r in runs]]


def _run(n: Column) -> Column:
    """Words in a run of an item of n words; null for items that the masks serve."""
    return F.when(n < 5, n).when(n < SHORT, F.floor(n / 2).cast("int"))


def _test_seeds(items: DataFrame, runs: list[int]) -> DataFrame:
    """(seed, item, at, n): each seed of each item and its position, without the item's words."""
    at, h, n = F.col("at"), F.col("words"), F.col("n")
    each = items.select("item", "words", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    options = [F.when(n >= SHORT, _seed(h, at, m, k)) for k, m in enumerate(MASKS)]
    options += [F.when((_run(n) == r) & ((at == 0) | (at == n - r)), _seed(h, at, tuple(range(r)), 100 + r)) for r in runs]
    return each.select("item", "at", "n", F.explode(F.array(*options)).alias("seed")).where("seed is not null").distinct()


def _bitmap(seeds: DataFrame, size: int) -> Column:
    """A scalar: the bitmap over the seeds, two bits a seed, as an array of ``size`` longs."""
    marks = seeds.select(F.explode(F.array(*_probes(F.col("seed"), size))).alias("p")).select("p.*")
    filled = marks.groupBy("i").agg(F.bit_or(F.expr("shiftleft(1L, cast(b as int))")).alias("w"))
    every = filled.sparkSession.range(size).select(F.col("id").cast("int").alias("i")).join(filled, "i", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("w", F.lit(0).cast("bigint")).alias("w")))), lambda x: x["w"]).alias("bits")).scalar()


def _probes(seed: Column, size: int) -> list[Column]:
    def probe(shift: int) -> Column:
        x = F.shiftrightunsigned(seed, shift)
        return F.struct(F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(size - 1)).cast("int").alias("i"), x.bitwiseAND(F.lit(63)).cast("int").alias("b"))

    return [probe(0), probe(30)]


def _marked(seed: Column, bits: Column, size: int) -> Column:
    tests = [F.getbit(F.get(bits, p["i"]), p["b"]) == 1 for p in _probes(seed, size)]
    return F.coalesce(tests[0] & tests[1], F.lit(False))


def overlaps(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", broadcast: int = BROADCAST, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(doc_id, item_id, n_words, n_equal, n_window, n_run): the best overlap of each document and test item that has enough equal words.

    Under the best alignment ``n_equal`` of the item's ``n_words`` words agree, at most ``n_window`` of min(n_words, window) neighbouring ones, and ``n_run`` in a row.
    """
    items = benchmark.select(F.col(item).alias("item_id"), hashes(F.col(item_text)).alias("words")).where(F.size("words") > 0).distinct()
    items = items.withColumn("n", F.size("words")).withColumn("item", F.xxhash64("item_id", "words"))
    runs = sorted(r["r"] for r in items.select(_run(F.col("n")).alias("r")).where("r is not null").distinct().collect())  # fewer than 10 rows
    seeds = _test_seeds(items, runs)
    known = seeds.agg(F.count("*").alias("n")).first()["n"]
    item_bytes = items.agg(F.coalesce(F.sum(8 * F.col("n") + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    least, most = BITMAPS
    if not known:
        n = F.col("n")
        return items.select(F.lit(None).cast(docs.schema[key].dataType).alias("doc_id"), "item_id", n.alias("n_words"), n.alias("n_equal"), n.alias("n_window"), n.alias("n_run")).where(F.lit(False))
    slots = max(least, min(most, 1 << (known * 16 // 64).bit_length()))
    bits = _bitmap(seeds, slots)
    h, at = F.col("h"), F.col("pos")
    rows = docs.select(F.col(key).alias("doc_id"), hashes(F.col(text)).alias("h"))
    every = rows.select("doc_id", "h", F.explode(F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") - 1))).alias("pos"))
    # The windows of a text and their seeds are loops of one generated method, and the words' hashes stay where they are:
    # only what passes the bitmap becomes a row. (Seeds written into the filter itself make that method too long to compile.)
    tried = every.select("doc_id", "h", "pos", F.explode(F.array(*[_seed(h, at, m, k) for k, m in _kinds(runs)])).alias("seed"))
    found = tried.where(_marked(F.col("seed"), bits, slots))
    longest = items.agg(F.max("n")).scalar()
    near = F.greatest(at - longest, F.lit(0))
    hits = found.select("doc_id", F.slice("h", near + 1, F.lit(2) * longest + 8).alias("h"), (at - near).alias("pos"), "seed")
    spread = F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int")

    def meet(left: DataFrame, right: DataFrame, on: str, size: int) -> DataFrame:
        """An equi-join with the smaller test side: broadcast if its measured bytes allow, else shuffled over salts."""
        if size <= broadcast:
            return left.join(F.broadcast(right), on)
        salted = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return left.withColumn("salt", spread).join(salted, [on, "salt"]).drop("salt")

    placed = meet(hits, seeds, "seed", 48 * known)
    # From here on a hit carries the words under the item only: from where the item begins, or the document does.
    begin = F.col("pos") - F.col("at")
    first = F.greatest(begin, F.lit(0))
    narrow = placed.select("doc_id", "pos", "item", F.slice("h", first + 1, F.col("n") - first + begin).alias("h"), (begin - first).alias("shift"))
    joined = meet(narrow, items, "item", item_bytes)
    equal = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.coalesce(F.when(j + F.col("shift") >= 0, F.get("h", j + F.col("shift")) == F.get("words", j)), F.lit(False)))
    width = F.least(F.col("n"), F.lit(window))
    count = lambda some: F.size(F.filter(some, lambda e: e))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("n") - width + 1), lambda i: count(F.slice("equal", i, width))))
    signs = F.array_join(F.transform("equal", lambda e: F.when(e, "=").otherwise(" ")), "")
    in_a_row = F.array_max(F.transform(F.split(signs, " +"), F.length))
    laid = joined.select("doc_id", "item_id", "n", equal.alias("equal")).select("doc_id", "item_id", "n", count(F.col("equal")).alias("n_equal"), best.alias("n_window"), in_a_row.alias("n_run"))
    return (
        laid.where((F.col("n_window") >= F.ceil(width * F.lit(similar) - 1e-9)) | (F.col("n_run") >= run))
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct(F.col("n_window") / width, F.col("n_equal") / F.col("n"), "n_equal", "n", "n_window", "n_run")).alias("best"))
        .select("doc_id", "item_id", F.col("best.n").alias("n_words"), *[F.col(f"best.{c}").alias(c) for c in ("n_equal", "n_window", "n_run")])
    )


def remove(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that overlap no test item; same columns. Rows with a null key stay."""
    bad = overlaps(docs, benchmark, key=key, text=text, **options).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(bad, key, "left_anti").select(*docs.columns)
