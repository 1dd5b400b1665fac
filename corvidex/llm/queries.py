"""The registered queries of this subpackage, each over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, bpe_sql, decontam, htmltext, langid, quality, rollup, simhash, urlfilter, warc
from ._common import cut, remainder, shared_dir, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents encoded and decoded: digests of its ids and of the decoded text."""
    return bpe.digests(table(spark, sf_dir, "documents"))


#: The same result by merging pairs step by step.
OP1_SQL = f"""
WITH RECURSIVE {bpe_sql.encoded()}
SELECT doc_id, n_tokens, sha256(ids) AS ids_sha256, sha256(from_hex(bytes)) AS decoded_sha256 FROM texts_ids
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that overlaps a benchmark item, with the item and the words that agree."""
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same result by brute force over spaced seeds and alignments in SQL.
OP2_SQL = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM benchmark
), masks(k, a, b, c) AS (VALUES (0, 1, 2, 4), (1, 1, 4, 6), (2, 2, 5, 6)),
sized AS (SELECT item_id, w, len(w) AS n FROM items WHERE len(w) > 0),
item_seeds AS (
  SELECT item_id, w, n, pos, k, w[pos + 1] || ' ' || w[pos + 1 + a] || ' ' || w[pos + 1 + b] || ' ' || w[pos + 1 + c] AS seed
  FROM (SELECT *, unnest(range(n)) AS pos FROM sized WHERE n >= 10), masks WHERE pos + c < n
  UNION ALL SELECT item_id, w, n, pos, 9, w[pos + 1] FROM (SELECT *, unnest(range(n)) AS pos FROM sized WHERE n < 10) -- of short items every word
), doc_seeds AS (
  SELECT doc_id, w, pos, k, w[pos + 1] || ' ' || w[pos + 1 + a] || ' ' || w[pos + 1 + b] || ' ' || w[pos + 1 + c] AS seed
  FROM (SELECT *, unnest(range(len(w))) AS pos FROM words), masks WHERE pos + c < len(w)
  UNION ALL SELECT doc_id, w, pos, 9, w[pos + 1] FROM (SELECT *, unnest(range(len(w))) AS pos FROM words) WHERE EXISTS (FROM sized WHERE n < 10)
), laid AS (
  SELECT DISTINCT d.doc_id, i.item_id, i.n, d.pos - i.pos AS shift, d.w AS dw, i.w AS iw
  FROM doc_seeds d JOIN item_seeds i ON d.k = i.k AND d.seed = i.seed
), compared AS (
  SELECT doc_id, item_id, n, least(n, 20) AS width, list_transform(range(n), lambda j: CASE WHEN j + shift >= 0 AND dw[j + shift + 1] = iw[j + 1] THEN 1 ELSE 0 END) AS same FROM laid
), counted AS (
  SELECT doc_id, item_id, n, width, list_sum(same) AS n_equal, list_max(list_transform(range(n - width + 1), lambda i: list_sum(same[i + 1 : i + width]))) AS n_window,
    list_max(list_transform(string_split(array_to_string(same, ''), '0'), lambda r: len(r))) AS n_run FROM compared
), best AS (
  SELECT * FROM counted WHERE n_window >= ceil(0.8 * width - 1e-9) OR n_run >= 13
  QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_window / width DESC, n_equal / n DESC, n_equal DESC, n DESC, n_run DESC) = 1
)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_words, CAST(n_equal AS INTEGER) AS n_equal, CAST(n_window AS INTEGER) AS n_window, CAST(n_run AS INTEGER) AS n_run FROM best
"""


def op3_language_model(docs: DataFrame) -> langid.Model:
    """Learned only from documents that are not held out (crc32 of the key as text, modulo 3, is not 1)."""
    return langid.fit(docs.where(remainder("doc_id", 3) != 1))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"))
    return langid.predict(rows, op3_language_model(docs)).drop("text")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every whole page."""
    return htmltext.extract_column(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of embeddings for every row whose vec_id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    got = simhash.groups(table(spark, sf_dir, "documents"))
    return got.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


RULES = [urlfilter.Rule.of(v, t) for v, t in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))]


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's URL, by the longest fitting rule or else by the trees."""
    return urlfilter.verdicts(table(spark, sf_dir, "pages"), RULES)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written into WARC archives and read back."""
    return warc.archive(spark, table(spark, sf_dir, "pages"), shared_dir(spark))


#: sha1 in bare base32: each five hexadecimal digits are four base32 digits.
OP8_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, upper(sha1(coalesce(html, ''))) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY n, h) AS first FROM p
), v AS (
  SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(i * 5 + 1 AS BIGINT), 5) AS INTEGER)) AS five FROM f
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(five, lambda x:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 10) % 32 + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM v
"""


def op9_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of documents by source, language and tokenizer version after inserts, deletes and revisions."""
    return rollup.of_corpus(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), shared_dir(spark))


#: Repeated ids count once, by their latest change (here the largest); null ids can't be deleted or revised.
OP9_SQL = f"""
WITH RECURSIVE {bpe_sql.encoded()}, counts AS (
  SELECT doc_id, source, lang, 'bpe-50k' AS tokenizer, n_tokens FROM texts_ids
  UNION ALL
  SELECT doc_id, source, lang, 'words-1', len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) FROM documents
), latest AS (
  SELECT * FROM counts c WHERE NOT EXISTS (FROM labels l WHERE l.toxic = 1 AND l.doc_id = c.doc_id)
  QUALIFY doc_id IS NULL OR row_number() OVER (PARTITION BY doc_id, tokenizer ORDER BY n_tokens DESC, source DESC NULLS LAST, lang DESC NULLS LAST) = 1
)
SELECT source, CASE WHEN lang = 'de' AND tokenizer = 'bpe-50k' AND doc_id IS NOT NULL THEN 'de-DE' ELSE lang END AS lang, tokenizer, count(*) AS docs, CAST(sum(n_tokens) AS BIGINT) AS tokens
FROM latest GROUP BY ALL
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every whole text of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = cut(quality.with_statistics(docs).drop("text"))  # each text is read once, for the fit and for the scores
    known = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)  # learned from; the others are held out
    model = quality.fit(quality.labelled(stats, known), times="times")
    rows = stats.withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)))
    return quality.score(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_decontamination": op2_decontamination,
    "op3_langid": op3_langid,
    "op4_html": op4_html,
    "op5_ann": op5_ann,
    "op6_simhash": op6_simhash,
    "op7_urls": op7_urls,
    "op8_warc": op8_warc,
    "op9_rollup": op9_rollup,
    "op10_quality": op10_quality,
}
ORACLES: dict[str, str] = {"op1_bpe": OP1_SQL, "op2_decontamination": OP2_SQL, "op8_warc": OP8_SQL, "op9_rollup": OP9_SQL}
