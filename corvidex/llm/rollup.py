"""Token counts as rollups that are maintained by deltas.

A rollup lives in a shared folder. Each batch of changes is turned into signed
rows: an insert adds a document's count, a delete takes away what the ledger has
of it, a revision does both. The signed rows are summed by source, language and
tokenizer version; totals are sums over all batches. Every attempt to commit a
batch writes into a folder of its own, and the batch counts once a marker
that names the folder has been moved into place. So an attempt that broke off
anywhere left nothing that counts, and committing a batch that counts does nothing.

What a batch changes is looked up in the ledger by the batch's own keys, before
anything is aggregated. After ``MOST_BATCHES`` batches the live rows and the totals are
written as one snapshot, which is read from then on instead of the batches before it.

Cases: null sources and languages are groups of their own; a null text has no
tokens; changes with a null key are counted if inserted and can't be deleted or
revised; of several changes of one key in a batch, the one with the highest
``seq`` counts (ties: the most tokens, then an insert before a delete, then the source and
the language that sort last, nulls first); deleting or revising an unknown key is a delete
of nothing or an insert; an empty batch commits an empty delta; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import bpe
from ._common import BPE_FILE

#: Tokenizer versions: of a public vocabulary, by its file; and by patterns, counted with Spark's own functions.
VOCABULARIES = {"bpe-50k": BPE_FILE}
PATTERNS = {"words-1": r"[^\x20\x09-\x0D]+", "marks-2": r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"}
GROUP = ("source", "lang", "tokenizer")
#: Batches after which a snapshot takes their place.
MOST_BATCHES = 32


def tokens(text: str, tokenizer: str) -> Column:
    """The number of tokens of a whole text by a pattern."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(PATTERNS[tokenizer])), F.lit(0)).cast("bigint")


def counted(docs: DataFrame, tokenizer: str, op: str = "put") -> DataFrame:
    """Changes from documents: op is ``put`` (insert or revise) or ``delete``."""
    rows = docs.select("doc_id", "source", "lang", "text")
    if tokenizer in VOCABULARIES:
        rows = bpe.count_column(rows, path=VOCABULARIES[tokenizer])
    else:
        rows = rows.withColumn("n_tokens", tokens("text", tokenizer))
    return rows.select(F.lit(op).alias("op"), "doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), "n_tokens", F.lit(0).alias("seq"))


class Rollup:
    """Totals by source, language and tokenizer version in a folder that driver and executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, most_batches: int = MOST_BATCHES):
        self.spark, self.folder, self.most_batches = spark, folder.rstrip("/"), most_batches

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _markers(self, kind: str) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path(f"{self.folder}/{kind}")):
            return []
        return sorted(n for s in fs.listStatus(path(f"{self.folder}/{kind}")) if not (n := s.getPath().getName()).startswith("."))

    def _mark(self, kind: str, name: str, attempt: str) -> None:
        """From the move on, ``attempt`` counts as ``name``."""
        fs, path = self._fs()
        fs.mkdirs(path(f"{self.folder}/{kind}"))
        half = path(f"{self.folder}/{kind}/.{attempt}")
        out = fs.create(half, True)
        out.write(bytearray(attempt.encode()))
        out.close()
        if not fs.rename(half, path(f"{self.folder}/{kind}/{name}")):
            raise OSError(f"can't mark {name} in {self.folder}/{kind}")

    def _attempt(self, kind: str, name: str) -> str:
        """The folder that a marker names."""
        fs, path = self._fs()
        at = path(f"{self.folder}/{kind}/{name}")
        stream = fs.open(at)
        try:
            return bytes(stream.readNBytes(int(fs.getFileStatus(at).getLen()))).decode()
        finally:
            stream.close()

    def batches(self) -> list[str]:
        """Names of committed batches, in the order of their names."""
        return self._markers("committed")

    def _read(self, what: str, schema: str) -> DataFrame:
        """The rows of the newest snapshot and of the batches after it."""
        last = (self._markers("snapshots") or [None])[-1]
        found = [self._attempt("snapshots", last)] if last is not None else []
        found += [self._attempt("committed", b) for b in self.batches() if last is None or b > last]
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/data/{a}/{what}" for a in found])

    LEDGER = "op string, doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint, batch string"
    DELTA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"

    def ledger(self, keys: DataFrame | None = None) -> DataFrame:
        """The live count of every document (of those with the ``keys``) and tokenizer version: its latest change, unless that is a delete."""
        rows = self._read("ledger", self.LEDGER).where("doc_id is not null")
        if keys is not None:
            rows = rows.join(keys, ["doc_id", "tokenizer"], "left_semi")
        last = F.max_by(F.struct("op", "source", "lang", "n_tokens", "batch"), "batch")
        known = rows.groupBy("doc_id", "tokenizer").agg(last.alias("x")).where("x.op = 'put'")
        return known.select("doc_id", "tokenizer", "x.source", "x.lang", "x.n_tokens", "x.batch")

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Adds a batch (op, doc_id, source, lang, tokenizer, n_tokens, seq). A batch that is committed stays as it is.

        Batches are applied in the order of their names; one that comes before a committed one can't be put in later, as the deltas after it would be wrong.
        """
        done = self.batches()
        if batch in done:
            return
        if done and batch < done[-1]:
            raise ValueError(f"{batch} comes before the committed {done[-1]}")
        attempt = uuid.uuid4().hex
        home = f"{self.folder}/data/{attempt}"
        # Written first, as rows with and without a key are read apart and counting is dear.
        changes.select("op", "doc_id", "source", "lang", "tokenizer", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), "seq").write.parquet(f"{home}/changes")
        rows = self.spark.read.parquet(f"{home}/changes")
        last = rows.where("doc_id is not null").groupBy("doc_id", "tokenizer").agg(F.max(F.struct("seq", "n_tokens", "op", "source", "lang")).alias("x")).select("x.op", "doc_id", "x.source", "x.lang", "tokenizer", "x.n_tokens")
        new = last.unionByName(rows.where("doc_id is null and op = 'put'").drop("seq"))
        new.withColumn("batch", F.lit(batch)).write.parquet(f"{home}/ledger")
        stored = self.spark.read.parquet(f"{home}/ledger")
        signed = stored.where("op = 'put'").select(*GROUP, F.lit(1).alias("docs"), F.col("n_tokens").alias("tokens"))
        if done:
            old = self.ledger(stored.select("doc_id", "tokenizer"))
            signed = signed.union(old.select(*GROUP, F.lit(-1).alias("docs"), (-F.col("n_tokens")).alias("tokens")))
        sums = signed.groupBy(*GROUP).agg(F.sum("docs").cast("bigint").alias("docs"), F.sum("tokens").cast("bigint").alias("tokens"))
        sums.write.parquet(f"{home}/delta")
        self._mark("committed", batch, attempt)
        fs, path = self._fs()
        fs.delete(path(f"{home}/changes"), True)
        last_snapshot = (self._markers("snapshots") or [""])[-1]
        if sum(b > last_snapshot for b in [*done, batch]) >= self.most_batches:
            self.compact()

    def compact(self) -> None:
        """Writes the live rows and the totals as a snapshot that takes the place of all batches so far."""
        done = self.batches()
        if not done or done[-1] in self._markers("snapshots"):
            return
        attempt = uuid.uuid4().hex
        home = f"{self.folder}/data/{attempt}"
        live = self.ledger().select(F.lit("put").alias("op"), "doc_id", "source", "lang", "tokenizer", "n_tokens", "batch")
        live.write.parquet(f"{home}/ledger")
        self.totals().write.parquet(f"{home}/delta")
        self._mark("snapshots", done[-1], attempt)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all committed batches; groups whose documents are all gone are left out."""
        sums = self._read("delta", self.DELTA).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")


def of_corpus(spark: SparkSession, docs: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """Totals after four batches: all documents are counted in tokens of a public vocabulary; toxic ones are deleted; the
    language code "de" of the rest is revised to "de-DE"; and all that stay are counted by a second tokenizer version.

    The second batch is committed twice, as after a failure; the totals don't show it.
    """
    rollup = Rollup(spark, folder)
    rollup.commit("b1-insert", counted(docs, "bpe-50k"))
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    gone = docs.select("doc_id", "source", "lang").join(toxic, "doc_id", "left_semi")
    deleted = gone.select(F.lit("delete").alias("op"), "doc_id", "source", "lang", F.lit("bpe-50k").alias("tokenizer"), F.lit(0).alias("n_tokens"), F.lit(0).alias("seq"))
    rollup.commit("b2-delete", deleted)
    rollup.commit("b2-delete", deleted)
    german = rollup.ledger().where("lang = 'de'")
    rollup.commit("b3-revise", german.select(F.lit("put").alias("op"), "doc_id", "source", F.lit("de-DE").alias("lang"), "tokenizer", "n_tokens", F.lit(0).alias("seq")))
    rollup.commit("b4-version", counted(docs, "words-1").join(toxic, "doc_id", "left_anti"))
    return rollup.totals()
