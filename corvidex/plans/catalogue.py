"""The registered queries over the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import collection as C, ranked as R, sequence as S, spelling
from ..operators.lineage import shared_folder
from ..sources import plugins, records, xml
from ..sources.store import Registry
from ..streaming import updates
from . import language as L
from .service import Service

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_SAVED: dict[tuple[str, str, str], C.Collection] = {}

SPECS = [
    C.IndexSpec("text", C.TEXT, "text"),
    C.IndexSpec("lang", C.TEXT, "lang", word=True),
    C.IndexSpec("source", C.TEXT, "source", word=True),
    C.IndexSpec("id", C.VALUE, "doc_id"),
    C.IndexSpec("n_chars", C.NUMBER, "n_chars"),
]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` in as many partitions as a shuffle has, for costly work on short rows: a file of short rows is one task, whatever it takes."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism), key)


def documents(spark: SparkSession, d: str) -> C.Collection:
    return C.Collection.of(_table(spark, d, "documents"), "doc_id", SPECS, name="documents", meta=("source", "lang"))


def conversations(spark: SparkSession, d: str) -> C.Collection:
    rows = _table(spark, d, "conversations")
    keyed = rows.withColumn("doc_nr", F.col("conv_id") * 1_000_000 + F.col("turn")).withColumn("doc_id", F.concat_ws("#", "conv_id", "turn"))
    return C.Collection(keyed, [C.IndexSpec("text", C.TEXT, "text"), C.IndexSpec("role", C.TEXT, "role", word=True)], name="conversations")


def benchmark(spark: SparkSession, d: str) -> C.Collection:
    return C.Collection.of(_table(spark, d, "benchmark"), "item_id", [C.IndexSpec("text", C.TEXT, "text")], name="benchmark")


def orders(spark: SparkSession, d: str) -> C.Collection:
    specs = [C.IndexSpec("date", C.DATE, "o_orderdate"), C.IndexSpec("priority", C.TEXT, "o_orderpriority"), C.IndexSpec("cust", C.NUMBER, "o_custkey"), C.IndexSpec("id", C.VALUE, "o_orderkey")]
    return C.Collection.of(_table(spark, d, "orders"), "o_orderkey", specs, name="orders")


def saved(make: Callable[[SparkSession, str], C.Collection], spark: SparkSession, d: str) -> C.Collection:
    """The collection with its tables stored, built once for each session and folder of tables."""
    key = (spark.sparkContext.applicationId, d, make.__name__)
    if key not in _SAVED:
        _SAVED[key] = make(spark, d).save(shared_folder(spark))
    return _SAVED[key]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- SQL pieces ----------------------------------------------------------------------------------

_RE = T.TOKEN.replace("'", "''")


def _toks(x: str) -> str:
    low = f"translate({x}, '{T.UPPER}', '{T.LOWER}')"
    return f"flatten(list_transform(regexp_extract_all({low}, '{_RE}'), lambda t: CASE WHEN len(t) - len(replace(t, '-', '')) = 1 THEN regexp_extract_all(replace(t, '-', ' '), '{_RE}') ELSE [t] END))"


def _tok(table: str = "documents", key: str = "doc_id", name: str = "tok") -> str:
    return f"""{name}_all AS (SELECT {key} AS doc_id, unnest(t) AS key, generate_subscripts(t, 1) AS pos FROM (SELECT {key}, {_toks('text')} AS t FROM {table})),
{name} AS (SELECT doc_id, key, pos FROM {name}_all WHERE NOT regexp_full_match(key, '[0-9]+') AND len(key) <= 255)"""


_ENTRIES = f"""WITH {_tok()}, entries AS (
  SELECT 'text' AS ix, key, doc_id, count(*) AS freq FROM tok GROUP BY key, doc_id
  UNION ALL SELECT 'lang', lower(lang), doc_id, 1 FROM documents WHERE lang IS NOT NULL
  UNION ALL SELECT 'source', lower(source), doc_id, 1 FROM documents WHERE source IS NOT NULL
  UNION ALL SELECT 'id', CAST(doc_id AS VARCHAR), doc_id, 1 FROM documents
  UNION ALL SELECT 'n_chars', CAST(n_chars AS VARCHAR), doc_id, 1 FROM documents WHERE n_chars >= 0
)"""
_WEIGHTS = f"""{_ENTRIES}, weights AS (
  SELECT doc_id, ix, key, greatest(1, freq * 31 // max(freq) OVER (PARTITION BY doc_id)) AS w FROM entries
), all_text AS (SELECT doc_id, key, least(31, sum(w)) AS w FROM weights GROUP BY doc_id, key),
n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT key, count(*) AS df, ln(1 + (SELECT n FROM n) / count(*)) AS idf FROM all_text GROUP BY key),
doc_weights AS (SELECT doc_id, sqrt(sum((w * idf) ** 2)) AS wd FROM all_text JOIN idf USING (key) GROUP BY doc_id)"""


def _has(key: str, ix: str | None = None) -> str:
    return f"SELECT DISTINCT doc_id FROM entries WHERE key = '{key}'" + (f" AND ix = '{ix}'" if ix else "")


def _boolean(name: str, text: str, sql: str, wildcard: bool = False) -> None:
    """A boolean query over documents, by one scan."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return L.find(documents(spark, d), text, wildcard).rows().select(F.col("doc_nr").alias("doc_id"))

    QUERIES[name], ORACLES[name] = run, f"{_ENTRIES} {sql}"


# ---- tokens and boolean leaves -------------------------------------------------------------------

query("tokenize_documents", f"WITH {_tok()} SELECT doc_id, key, CAST(pos AS INTEGER) AS pos FROM tok")(
    lambda s, d: documents(s, d).tokens().where("ix = 'text'").select(F.col("doc_nr").alias("doc_id"), "key", "pos")
)
query("token_classes", f"WITH t AS (SELECT unnest({_toks('text')}) AS key FROM documents) SELECT CASE WHEN regexp_full_match(key, '[0-9]+') THEN 'number' ELSE 'word' END AS class, count(*) AS n FROM t GROUP BY ALL")(
    lambda s, d: _table(s, d, "documents").select(F.explode(T.tokens("text")).alias("key")).groupBy(T.token_class("key").alias("class")).agg(F.count("*").alias("n"))
)
query("page_in_order", f"{_ENTRIES} SELECT doc_id FROM entries WHERE ix = 'text' AND key = 'the' ORDER BY doc_id LIMIT 40 OFFSET 5")(
    lambda s, d: L.find(documents(s, d), "text:the").page(5, 40).select(F.col("doc_nr").alias("doc_id"))
)
query("estimated_not", f"{_ENTRIES} SELECT least((SELECT count(*) FROM entries WHERE ix = 'text' AND key = 'with'), (SELECT count(*) FROM documents) - (SELECT count(*) FROM entries WHERE ix = 'lang' AND key = 'en')) AS n")(
    lambda s, d: s.createDataFrame([(L.find(saved(documents, s, d), "text:with AND NOT lang:en").estimate(),)], "n bigint")
)
_boolean("match_all", "*", "SELECT doc_id FROM documents")
_boolean("term_any", "The", _has("the"))
_boolean("term_qualified", "lang:EN", _has("en", "lang"))
_boolean("term_literal", "'src1'", _has("src1"))
_boolean("glob_prefix", "text:then*", "SELECT DISTINCT doc_id FROM entries WHERE ix = 'text' AND starts_with(key, 'then')")
_boolean("glob_question", "text:th?n*d", "SELECT DISTINCT doc_id FROM entries WHERE ix = 'text' AND regexp_full_match(key, 'th.n.*d')")
_boolean("glob_any_index", "sr*1?", "SELECT DISTINCT doc_id FROM entries WHERE regexp_full_match(key, 'sr.*1.')")
_boolean("autowildcard", "source:src1", "SELECT DISTINCT doc_id FROM entries WHERE ix = 'source' AND starts_with(key, 'src1')", True)
_boolean("phrase_two", '"of the"', f"SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.key = 'of' AND b.key = 'the'")
_boolean("phrase_three", 'text:"in of the"', "SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN tok c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 WHERE a.key = 'in' AND b.key = 'of' AND c.key = 'the'")
for _n, _op in (("lt", "<"), ("le", "<="), ("eq", "="), ("ge", ">="), ("gt", ">")):
    _boolean(f"rel_{_n}_number", f"n_chars{_op}1489", f"SELECT doc_id FROM documents WHERE n_chars {_op} 1489")
_boolean("rel_on_key_unique", "id=77", "SELECT doc_id FROM documents WHERE doc_id = 77")
_boolean("empty_result", "lang:nosuchlanguage", "SELECT doc_id FROM documents WHERE false")
_boolean("bool_and", "lang:en AND text:with", f"{_has('en', 'lang')} INTERSECT {_has('with', 'text')}")
_boolean("bool_juxtaposed", "lang:en text:with", f"{_has('en', 'lang')} INTERSECT {_has('with', 'text')}")
_boolean("bool_or", "lang:fr | source:src3", f"{_has('fr', 'lang')} UNION {_has('src3', 'source')}")
_boolean("bool_not", "NOT lang:en", f"SELECT doc_id FROM documents EXCEPT ({_has('en', 'lang')})")
_boolean("bool_and_not", "lang:en AND NOT source:src0", f"({_has('en', 'lang')}) EXCEPT ({_has('src0', 'source')})")
_boolean("bool_left_assoc", "lang:fr OR lang:de source:src0", f"(({_has('fr', 'lang')}) UNION ({_has('de', 'lang')})) INTERSECT ({_has('src0', 'source')})")
_boolean("bool_nested", "NOT (lang:fr OR (lang:de AND n_chars>2000)) AND text:t*", "SELECT DISTINCT doc_id FROM entries WHERE ix = 'text' AND starts_with(key, 't') AND doc_id IN (SELECT doc_id FROM documents WHERE NOT (lang = 'fr' OR (lang = 'de' AND n_chars > 2000)))")


@query("rel_date_range", "SELECT o_orderkey AS doc_id FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def rel_date_range(spark: SparkSession, d: str) -> DataFrame:
    c = orders(spark, d)
    return L.BooleanQuery(c, L.Range("date", "1996-01-01", "1996-12-31")).rows().select(F.col("doc_nr").alias("doc_id"))


@query("rel_date_events", "SELECT event_id AS doc_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-10' OR event_type = 'view'")
def rel_date_events(spark: SparkSession, d: str) -> DataFrame:
    c = C.Collection.of(_table(spark, d, "events"), "event_id", [C.IndexSpec("day", C.DATE, "ts"), C.IndexSpec("type", C.TEXT, "event_type", word=True)], name="events")
    return L.find(c, "day>=2024-01-10 OR type:view").rows().select(F.col("doc_nr").alias("doc_id"))


@query("match_relation", "SELECT o_orderkey AS doc_id FROM orders WHERE o_custkey >= 100 AND CAST(o_orderdate AS DATE) < DATE '1997-05-01'")
def match_relation(spark: SparkSession, d: str) -> DataFrame:
    c = orders(spark, d)
    both = L.match_relation(c, "100", ">=", "cust") & L.match_relation(c, "1997-05-01", "<", "date")
    return both.rows().select(F.col("doc_nr").alias("doc_id"))


@query("query_objects", f"{_ENTRIES} (SELECT doc_id FROM documents EXCEPT ({_has('en', 'lang')})) UNION ({_has('src2', 'source')})")
def query_objects(spark: SparkSession, d: str) -> DataFrame:
    c = documents(spark, d)
    return (~L.match(c, "en", "lang") | L.match(c, "src2", "source")).rows().select(F.col("doc_nr").alias("doc_id"))


@query("index_boolean", f"{_ENTRIES} (({_has('en', 'lang')}) INTERSECT ({_has('with', 'text')})) EXCEPT ({_has('src0', 'source')})")
def index_boolean(spark: SparkSession, d: str) -> DataFrame:
    """Set algebra over stored postings."""
    return L.documents(L.parse("lang:en with AND NOT source:src0"), saved(documents, spark, d)).select(F.col("doc_nr").alias("doc_id"))


@query("prefetched", f"{_ENTRIES} SELECT DISTINCT doc_id FROM entries WHERE key = 'with' AND doc_id IN ({_has('de', 'lang')}) UNION SELECT DISTINCT doc_id FROM entries WHERE key = 'src3' AND doc_id IN ({_has('de', 'lang')})")
def prefetched(spark: SparkSession, d: str) -> DataFrame:
    """One boolean result, kept, that restricts two others."""
    c = documents(spark, d)
    german = L.find(c, "lang:de").prefetch().select("doc_nr")
    both = [L.find(c, q).ids().join(german, "doc_nr", "left_semi") for q in ("with", "src3")]
    return both[0].union(both[1]).select(_doc()).distinct()


@query("index_phrase", f"WITH {_tok()} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.key = 'of' AND b.key = 'the'")
def index_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Adjacent positions in stored postings."""
    return L.documents(L.parse('text:"of the"'), saved(documents, spark, d)).select(F.col("doc_nr").alias("doc_id"))


@query("index_glob", f"{_ENTRIES} SELECT DISTINCT doc_id FROM entries WHERE ix = 'text' AND regexp_full_match(key, 'the.*s')")
def index_glob(spark: SparkSession, d: str) -> DataFrame:
    return L.documents(L.parse("text:the*s"), saved(documents, spark, d)).select(F.col("doc_nr").alias("doc_id"))


query("count_boolean", f"{_ENTRIES} SELECT count(DISTINCT doc_id) AS n FROM entries WHERE ix = 'lang' AND key = 'de'")(lambda s, d: L.find(documents(s, d), "lang:de").count())


# ---- frequencies and weights ---------------------------------------------------------------------

def _doc():
    return F.col("doc_nr").alias("doc_id")


query("term_freq", f"{_ENTRIES} SELECT ix, key, doc_id, freq FROM entries")(lambda s, d: documents(s, d).frequencies().select("ix", "key", _doc(), "freq"))
query("max_freq", f"{_ENTRIES} SELECT doc_id, max(freq) AS max_freq FROM entries GROUP BY doc_id")(lambda s, d: documents(s, d).frequencies().groupBy(_doc()).agg(F.max("freq").alias("max_freq")))
query("weights", f"{_WEIGHTS} SELECT doc_id, ix, key, CAST(w AS INTEGER) AS w FROM weights")(lambda s, d: documents(s, d).weights().select(_doc(), "ix", "key", "w"))
query("alltext_weights", f"{_WEIGHTS} SELECT doc_id, key, CAST(w AS INTEGER) AS w FROM all_text")(lambda s, d: saved(documents, s, d).table("all_text").select(_doc(), "key", "w"))
query("df", f"{_ENTRIES} SELECT ix, key, count(*) AS df FROM entries GROUP BY ix, key")(lambda s, d: documents(s, d).table("lexicon"))
query("idf", f"{_WEIGHTS} SELECT key, df, round(idf, 6) AS idf FROM idf")(lambda s, d: documents(s, d).idf().select("key", "df", F.round("idf", 6).alias("idf")))
query("doc_norms", f"{_WEIGHTS} SELECT doc_id, round(wd, 6) AS wd FROM doc_weights")(lambda s, d: saved(documents, s, d).table("doc_weights").select(_doc(), F.round("wd", 6).alias("wd")))


# ---- ranked --------------------------------------------------------------------------------------


def _ranked_sql(terms: dict[str, int], algorithm: str, tail: str = "ORDER BY score DESC, doc_id LIMIT 20", where: str = "", need: int = 0, total: bool = False) -> str:
    values = ", ".join(f"('{k}', {w})" for k, w in sorted(R.query_weights(terms).items()))
    rank = {"vector": "a / (wd * wq)", "dice": "2 * a / (wd * wd + wq * wq)", "jaccard": "a / (wd * wd + wq * wq - a)"}[algorithm]
    having = f"HAVING count(*) = {need}" if need else ""
    return f"""{_WEIGHTS}, q(key, qw) AS (VALUES {values}),
found AS (SELECT doc_id, sum(idf * w * idf * qw) AS a FROM all_text JOIN idf USING (key) JOIN q USING (key) GROUP BY doc_id {having}),
norm AS (SELECT sqrt(sum((idf * qw) ** 2)) AS wq FROM q JOIN idf USING (key))
SELECT doc_id, round({rank} * 100, 6) AS score {', count(*) OVER () AS total' if total else ''} FROM found JOIN doc_weights USING (doc_id), norm {where} {tail}"""


def _ranked(name: str, terms: dict[str, int], algorithm: str = "vector", sql: dict | None = None, meta: str | None = None, **options) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = saved(documents, spark, d)
        only = {"meta": L.documents(L.parse(meta), c)} if meta else {}
        got = R.Ranked(c, terms).top(**{"n": 20, "algorithm": algorithm} | only | options)
        return got.select(_doc(), *[x for x in got.columns if x not in ("doc_nr", "doc_id")])

    QUERIES[name], ORACLES[name] = run, _ranked_sql(terms, algorithm, **(sql or {}))


_ranked("rank_vector", {"with": 2, "thing": 1, "src3": 1})
_ranked("rank_dice", {"with": 2, "thing": 1, "src3": 1}, "dice")
_ranked("rank_jaccard", {"with": 2, "thing": 1, "src3": 1}, "jaccard")
_ranked("rank_all_terms", {"with": 1, "that": 1, "from": 1}, all_terms=True, sql={"need": 3})
_ranked("rank_meta_filter", {"with": 1, "that": 1}, meta="lang:en", sql={"where": "WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"})
_ranked("rank_low_weight_drops", {"with": 40, "that": 1})
_ranked("rank_from_text", R.terms_of("The thing that was with the others, and with-out the thing"))
_ranked("paging", {"with": 1, "from": 2}, n=15, offset=30, sql={"tail": "ORDER BY score DESC, doc_id LIMIT 15 OFFSET 30"})
_ranked("topk_total_hits", {"with": 1, "src7": 1}, with_total=True, n=10, sql={"tail": "ORDER BY score DESC, doc_id LIMIT 10", "total": True})


@query("rank_stopwords", _ranked_sql({"with": 1, "from": 1}, "vector", need=2))
def rank_stopwords(spark: SparkSession, d: str) -> DataFrame:
    """A stop word that is required but not indexed is left out of the count of required terms."""
    c = saved(documents, spark, d)
    c = C.Collection(c.docs, c.indices, ("zzstop",), c.name, c.meta, c.stored)
    return R.Ranked(c, {"with": 1, "from": 1, "zzstop": 1}).top(20, all_terms=True).select(_doc(), "score")


@query("rank_required_missing", "SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE false")
def rank_required_missing(spark: SparkSession, d: str) -> DataFrame:
    return R.Ranked(saved(documents, spark, d), {"with": 1, "nosuchword_": 1}).top(20, all_terms=True).select(_doc(), "score")


_SIMILAR = f"""{_WEIGHTS}, own AS (SELECT key, sum(freq) AS freq FROM entries WHERE doc_id = 7 AND ix IN ('text', 'lang', 'source') GROUP BY key),
q AS (SELECT key, freq * 31 // (SELECT max(freq) FROM own) AS qw FROM own WHERE freq * 31 // (SELECT max(freq) FROM own) > 0),
found AS (SELECT doc_id, sum(idf * w * idf * qw) AS a FROM all_text JOIN idf USING (key) JOIN q USING (key) GROUP BY doc_id),
norm AS (SELECT sqrt(sum((idf * qw) ** 2)) AS wq FROM q JOIN idf USING (key))
SELECT doc_id, round(a / (wd * wq) * 100, 6) AS score FROM found JOIN doc_weights USING (doc_id), norm ORDER BY score DESC, doc_id LIMIT 20"""
query("find_similar", _SIMILAR)(lambda s, d: R.similar(saved(documents, s, d), 7).top(20).select(_doc(), "score"))


def _weights_of(table: str, key: str, p: str, extra: str = "") -> str:
    return f"""{_tok(table, key, p)}, {p}_e AS (SELECT key, doc_id, count(*) AS freq FROM {p} GROUP BY key, doc_id {extra}),
{p}_a AS (SELECT doc_id, key, least(31, sum(w)) AS w FROM (SELECT doc_id, key, greatest(1, freq * 31 // max(freq) OVER (PARTITION BY doc_id)) AS w FROM {p}_e) GROUP BY doc_id, key),
{p}_i AS (SELECT key, ln(1 + (SELECT count(*) FROM {table}) / count(*)) AS idf FROM {p}_a GROUP BY key),
{p}_d AS (SELECT doc_id, sqrt(sum((w * idf) ** 2)) AS wd FROM {p}_a JOIN {p}_i USING (key) GROUP BY doc_id),
{p}_n AS (SELECT sqrt(sum((idf * qw) ** 2)) AS wq FROM {p}_i JOIN q USING (key)),
{p}_s AS (SELECT doc_id, sum(idf * w * idf * qw) AS a FROM {p}_a JOIN {p}_i USING (key) JOIN q USING (key) GROUP BY doc_id),
{p}_r AS (SELECT doc_id, round(a / (wd * wq) * 100, 6) AS score FROM {p}_s JOIN {p}_d USING (doc_id), {p}_n)"""


def _federated(spark: SparkSession, d: str) -> list[C.Collection]:
    return [saved(benchmark, spark, d), saved(documents, spark, d)]


def _all_sql(terms: dict[str, int]) -> str:
    values = ", ".join(f"('{k}', {w})" for k, w in sorted(R.query_weights(terms).items()))
    return f"""{_WEIGHTS}, q(key, qw) AS (VALUES {values}), {_weights_of('benchmark', 'item_id', 'b')},
found AS (SELECT doc_id, sum(idf * w * idf * qw) AS a FROM all_text JOIN idf USING (key) JOIN q USING (key) GROUP BY doc_id),
norm AS (SELECT sqrt(sum((idf * qw) ** 2)) AS wq FROM q JOIN idf USING (key)),
hits AS (SELECT 'documents' AS db, doc_id, round(a / (wd * wq) * 100, 6) AS score FROM found JOIN doc_weights USING (doc_id), norm
  UNION ALL SELECT 'benchmark', doc_id, score FROM b_r)"""


_BEST_FIVE = "SELECT db, CAST(doc_id AS VARCHAR) AS doc_id, score, CAST(place AS INTEGER) AS place, total, best FROM (SELECT *, row_number() OVER (PARTITION BY db ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY db) AS total, max(score) OVER (PARTITION BY db) AS best FROM hits) WHERE place <= 5"
_WITH_THAT = {"with": 1, "that": 1}
_LIKE = R.terms_of("with the thing that was said in the end of the day")
query("find_all", f"{_all_sql(_WITH_THAT)} {_BEST_FIVE}")(lambda s, d: R.find_all(_federated(s, d), _WITH_THAT))
query("hits_per_collection", f"{_all_sql(_WITH_THAT)} SELECT db, count(*) AS total FROM hits GROUP BY db")(lambda s, d: R.hits_per_collection(_federated(s, d), _WITH_THAT))
query("find_all_similar", f"{_all_sql(_LIKE)} {_BEST_FIVE}")(lambda s, d: R.find_all(_federated(s, d), _LIKE))


def _service(spark: SparkSession, d: str) -> Service:
    registry = Registry()
    for c in (saved(documents, spark, d), saved(benchmark, spark, d)):
        registry.add(c.name, c)
    registry.add("conversations", saved(conversations, spark, d), ignore_in_all=True)
    return Service(registry)


@query("service_find", _ranked_sql({"with": 1, "that": 1}, "vector", "ORDER BY score DESC, doc_id LIMIT 15", "WHERE doc_id IN (SELECT doc_id FROM entries WHERE starts_with(key, 'the')) AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')", 2))
def service_find(spark: SparkSession, d: str) -> DataFrame:
    """Terms as a client gives them: one with a wildcard only filters, one with a hyphen is two."""
    return _service(spark, d).find("documents", ["With-that", "the*"], filter="lang:en").select(_doc(), "score")


query("service_indices", f"{_ENTRIES} SELECT ix, kind, ix AS name, count(*) AS n_keys, CAST(sum(df) AS BIGINT) AS n_postings FROM (SELECT ix, key, count(*) AS df FROM entries GROUP BY ix, key) JOIN (VALUES ('text', 'text'), ('lang', 'text'), ('source', 'text'), ('id', 'valu'), ('n_chars', 'nmbr')) k(ix, kind) USING (ix) GROUP BY ix, kind")(
    lambda s, d: _service(s, d).indices("documents")
)
query("service_info", "SELECT 'documents' AS db, count(*) AS n_docs, CAST(sum(octet_length(encode(text))) AS BIGINT) AS raw_bytes, 5 AS n_indices FROM documents UNION ALL SELECT 'benchmark', count(*), CAST(sum(octet_length(encode(text))) AS BIGINT), 1 FROM benchmark UNION ALL SELECT 'conversations', count(*), CAST(sum(octet_length(encode(text))) AS BIGINT), 2 FROM conversations")(
    lambda s, d: _service(s, d).databank_info()
)
query("estimated_count", f"{_ENTRIES} SELECT least((SELECT count(*) FROM documents), (SELECT count(*) FROM entries WHERE ix = 'lang' AND key = 'en'), (SELECT count(*) FROM entries WHERE ix = 'text' AND key = 'with') + (SELECT count(*) FROM entries WHERE ix = 'lang' AND key = 'de')) AS n")(
    lambda s, d: s.createDataFrame([(L.find(saved(documents, s, d), "text:with OR lang:de AND lang:en").estimate(),)], "n bigint")
)

query(
    "cooccurrence",
    f"{_WEIGHTS} SELECT key, count(*) AS n_docs, round(count(*) * max(idf), 6) AS score FROM all_text JOIN idf USING (key) WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'src4') AND NOT regexp_full_match(key, '[0-9]+') GROUP BY key HAVING count(*) > 1 ORDER BY score DESC, key LIMIT 20",
)(lambda s, d: R.cooccurrence(c := saved(documents, s, d), L.documents(L.parse("source:src4"), c)))


# ---- keys and statistics -------------------------------------------------------------------------

query("keys", f"{_ENTRIES} SELECT key, count(*) AS df FROM entries WHERE ix = 'source' GROUP BY key")(lambda s, d: documents(s, d).keys("source"))
query("key_union", f"{_ENTRIES} SELECT key, count(DISTINCT doc_id) AS df FROM entries GROUP BY key")(lambda s, d: saved(documents, s, d).keys())
query("key_seek", f"{_ENTRIES} SELECT key, count(*) AS df FROM entries WHERE ix = 'text' AND key >= 'that' GROUP BY key ORDER BY key LIMIT 25")(lambda s, d: saved(documents, s, d).seek("text", "that", 25))
query("key_page", f"{_ENTRIES} SELECT key, count(*) AS df FROM entries WHERE ix = 'text' GROUP BY key ORDER BY key LIMIT 20 OFFSET 100")(lambda s, d: saved(documents, s, d).page("text", 100, 20))
query("key_before", f"{_ENTRIES} SELECT key, df FROM (SELECT key, count(*) AS df FROM entries WHERE ix = 'text' AND key < 'that' GROUP BY key ORDER BY key DESC LIMIT 25)")(lambda s, d: saved(documents, s, d).before("text", "that", 25))
query("key_dump_df", f"{_ENTRIES} SELECT ix, key, count(*) AS df FROM entries GROUP BY ix, key")(lambda s, d: saved(documents, s, d).table("lexicon").select("ix", "key", "df"))
query("glob_expand", f"{_ENTRIES} SELECT DISTINCT key FROM entries WHERE ix = 'text' AND regexp_full_match(key, 'an.*th')")(lambda s, d: saved(documents, s, d).expand("text", "an*th"))
query("index_stats", f"{_ENTRIES} SELECT ix, count(*) AS n_keys, CAST(sum(df) AS BIGINT) AS n_postings FROM (SELECT ix, key, count(*) AS df FROM entries GROUP BY ix, key) GROUP BY ix")(lambda s, d: documents(s, d).index_statistics())
query("databank_stats", "SELECT count(*) AS n_docs, CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS raw_bytes FROM documents")(lambda s, d: documents(s, d).statistics())


def _spell_sql(word: str, n: int = 20) -> str:
    """Every walk through every key of the dictionary, step by step; the columns are (key, score)."""
    letter = f"CASE swap WHEN 1 THEN substr('{word}', i + 2, 1) ELSE substr('{word}', i + 1, 1) END"
    i, swap = "CASE swap WHEN 1 THEN i WHEN 2 THEN i + 2 ELSE i + 1 END", "CASE swap WHEN 1 THEN 2 ELSE 0 END"
    edit = "total >= 0 AND edits < 2 AND j < len(key)"
    return f"""{_ENTRIES.replace("WITH ", "WITH RECURSIVE ", 1)}, dictionary AS (SELECT DISTINCT key FROM entries WHERE len(key) >= 2 AND NOT regexp_full_match(key, '[0-9.]+') AND key <> '{word}'),
walk(key, i, j, edits, swap, total, ends) AS (
  SELECT key, 0, 0, 0, 0, 0, false FROM dictionary
  UNION SELECT key, x.i, x.j, x.edits, x.swap, x.total, x.ends FROM (SELECT key, unnest([
    CASE WHEN j < len(key) AND {letter} = substr(key, j + 1, 1) THEN {{'i': {i}, 'j': j + 1, 'edits': edits, 'swap': {swap}, 'total': total + 1, 'ends': edits <= 1}} END,
    CASE WHEN {edit} THEN {{'i': i, 'j': j + 1, 'edits': edits + 1, 'swap': swap, 'total': total - 1, 'ends': true}} END,
    CASE WHEN {edit} AND {letter} <> '' THEN {{'i': {i}, 'j': j, 'edits': edits + 1, 'swap': {swap}, 'total': total - 4, 'ends': false}} END,
    CASE WHEN {edit} AND {letter} <> '' THEN {{'i': {i}, 'j': j + 1, 'edits': edits + 1, 'swap': {swap}, 'total': total - 2, 'ends': true}} END,
    CASE WHEN {edit} AND swap = 0 AND i + 1 < {len(word)} THEN {{'i': i, 'j': j, 'edits': edits + 1, 'swap': 1, 'total': total - 2, 'ends': false}} END
  ]) AS x FROM walk) WHERE x IS NOT NULL
), suggested AS (SELECT key, CAST(max(total) AS BIGINT) AS score FROM walk WHERE ends AND j = len(key) GROUP BY key ORDER BY score DESC, key LIMIT {n})"""


query("spell_suggest", f"{_spell_sql('thign')} SELECT key, score FROM suggested")(lambda s, d: spelling.suggest(saved(documents, s, d), "thign"))
query("spell_with_hits", f"{_spell_sql('wiht')} SELECT key, score, count(DISTINCT doc_id) AS hits FROM suggested JOIN entries USING (key) GROUP BY key, score")(
    lambda s, d: spelling.suggest_with_hits(saved(documents, s, d), "wiht")
)
query("spell_dictionary", f"{_ENTRIES} SELECT DISTINCT key FROM (SELECT ix, key, count(*) AS df FROM entries GROUP BY ix, key) WHERE ix = 'text' AND df >= 3 AND len(key) >= 4 AND NOT regexp_full_match(key, '[0-9.]+')")(
    lambda s, d: spelling.dictionary(saved(documents, s, d), ["text"], 4, 3)
)


# ---- lookups and entries -------------------------------------------------------------------------

query("point_lookup", "SELECT doc_id, n_chars FROM documents WHERE doc_id = 42")(lambda s, d: documents(s, d).docs.where("doc_nr = 42").select(_doc(), "n_chars"))
query("id_lookup", "SELECT doc_id, n_chars FROM documents WHERE doc_id = 55")(lambda s, d: documents(s, d).lookup("55").select(_doc(), "n_chars"))
query("id_fallback", "SELECT doc_id, n_chars FROM documents WHERE doc_id = 56")(lambda s, d: documents(s, d).lookup("#56").select(_doc(), "n_chars"))
query("metadata", "SELECT doc_id, lang AS value FROM documents")(lambda s, d: documents(s, d).metadata("lang").select(_doc(), "value"))
query("description", "SELECT doc_id, source AS value FROM documents")(lambda s, d: documents(s, d).description().select(_doc(), "value"))
query("entry_plain", "SELECT doc_id, text FROM documents")(lambda s, d: documents(s, d).docs.select(_doc(), "text"))
query("entry_title", "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 7), chr(10)) AS title FROM documents")(lambda s, d: documents(s, d).docs.select(_doc(), T.first_lines("text").alias("title")))
query("entry_html", "SELECT doc_id, '<pre>' || regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '((?:https?|ftp)://[^\\s<>\"]+)', '<a href=\"\\1\">\\1</a>', 'g') || '</pre>' AS html FROM documents")(
    lambda s, d: documents(s, d).docs.select(_doc(), T.html_entry("text").alias("html"))
)
query("entry_fasta", "SELECT p_partkey, '>' || p_partkey || ' ' || p_name || chr(10) || regexp_replace(repeat('ACDEFGHIKLMNPQRSTVWY', 1 + p_size), '(.{72})', '\\1' || chr(10), 'g') || CASE WHEN (20 * (1 + p_size)) % 72 = 0 THEN '' ELSE chr(10) END AS fasta FROM part")(
    lambda s, d: _table(s, d, "part").select("p_partkey", T.fasta("p_partkey", "p_name", F.expr("repeat('ACDEFGHIKLMNPQRSTVWY', 1 + p_size)")).alias("fasta"))
)
query("cross_links", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")(lambda s, d: _table(s, d, "orders").join(_table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name"))


# ---- several collections -------------------------------------------------------------------------

_TWO = f"WITH {_tok()}, {_tok('benchmark', 'item_id', 'b')}"
query("joined_term", f"{_TWO} SELECT 'documents' AS part, CAST(doc_id AS VARCHAR) AS doc_id FROM tok WHERE key = 'with' GROUP BY doc_id UNION ALL SELECT 'benchmark', CAST(doc_id AS VARCHAR) FROM b WHERE key = 'with' GROUP BY doc_id")(
    lambda s, d: L.find(C.joined([_text_only(documents(s, d)), _text_only(benchmark(s, d))]), "text:with").rows().select("part", "doc_id")
)
query("joined_idf", f"{_TWO}, e AS (SELECT DISTINCT 'd' AS p, doc_id, key FROM tok UNION ALL SELECT DISTINCT 'b', doc_id, key FROM b) SELECT key, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM documents) + (SELECT count(*) FROM benchmark)) / count(*)), 6) AS idf FROM e GROUP BY key")(
    lambda s, d: C.joined([_text_only(documents(s, d)), _text_only(benchmark(s, d))]).idf().select("key", "df", F.round("idf", 6).alias("idf"))
)


def _text_only(c: C.Collection) -> C.Collection:
    return C.Collection(c.docs.select("doc_nr", "doc_id", "text"), [C.IndexSpec("text", C.TEXT, "text")], name=c.name)


def _versions(spark: SparkSession, d: str) -> list[C.Collection]:
    """Events as two collections of one document a user each: of two parts, the second hides ids of the first."""
    rows = _table(spark, d, "events").groupBy("user_id", (F.col("event_id") % 2).alias("half")).agg(F.max("event_id").alias("last"))
    specs = [C.IndexSpec("id", C.VALUE, "doc_id")]
    halves = [rows.where(F.col("half") == h).select(F.col("user_id").cast("bigint").alias("doc_nr"), F.col("user_id").cast("string").alias("doc_id"), F.col("last").cast("string").alias("text")) for h in (0, 1)]
    return [C.Collection(x, specs, name=f"half{h}") for h, x in enumerate(halves)]


_HALVES = "WITH v AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, event_id % 2 AS half, CAST(max(event_id) AS VARCHAR) AS text FROM events GROUP BY ALL)"
query("merge_latest_wins", f"{_HALVES} SELECT doc_id, text FROM v QUALIFY half = max(half) OVER (PARTITION BY doc_id)")(lambda s, d: C.merged(_versions(s, d)).docs.where("is_valid").select("doc_id", "text"))
query("update_omit", f"{_HALVES} SELECT doc_id, text, half = max(half) OVER (PARTITION BY doc_id) AS is_valid FROM v")(lambda s, d: C.updated(_versions(s, d)[0], _versions(s, d)[1].docs).docs.select("doc_id", "text", "is_valid"))
query("duplicate_keys", f"{_HALVES} SELECT doc_id, count(*) AS n FROM v GROUP BY doc_id HAVING count(*) > 1")(lambda s, d: C.joined(_versions(s, d)).docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"))
query("document_numbers", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS doc_nr FROM customer")(lambda s, d: C.number_documents(_table(s, d, "customer").select("c_custkey"), ["c_custkey"]).select("c_custkey", "doc_nr"))


# ---- sources and sequences -----------------------------------------------------------------------


@query("records_simple", "SELECT CAST(p_partkey AS VARCHAR) AS doc_id, lower(p_brand) AS brand FROM part")
def records_simple(spark: SparkSession, d: str) -> DataFrame:
    """Parts written as tab-separated records, split and parsed again."""
    raw = _table(spark, d, "part").select(F.concat(F.lit("ID\t"), "p_partkey", F.lit("\nBRAND\t"), "p_brand", F.lit("\nNAME\t"), "p_name", F.lit("\n//")).alias("value"))
    got = records.parse(raw, records.FORMATS["simple"])
    return got.select("doc_id", F.expr("lower(filter(entries, e -> e.ix = 'brand')[0].token)").alias("brand"))


@query("records_fasta", "SELECT '>' || p_partkey || ' ' || p_name || chr(10) || repeat('ACDEFGHIK', 3) || chr(10) AS value FROM part")
def records_fasta(spark: SparkSession, d: str) -> DataFrame:
    """Parts as protein flat-file records, parsed, and written as FASTA entries."""
    raw = _table(spark, d, "part").select(F.concat(F.lit("ID   "), "p_partkey", F.lit("; x.\nDE   "), "p_name", F.lit("\nSQ   SEQUENCE\n     "), F.expr("repeat('ACDEFGHIK ', 3)"), F.lit("\n//")).alias("value"))
    return records.to_fasta(plugins.parser("uniprot").rows(raw))


def _records(name: str, parts: str, want: dict[str, str], where: str = "") -> None:
    """Parts written as records of a format (``parts``: a SQL expression of both dialects), parsed: every entry, against ``want`` by index."""
    each = " UNION ALL ".join(f"SELECT CAST(p_partkey AS VARCHAR) AS doc_id, '{ix}' AS ix, {token} AS token FROM part" for ix, token in want.items())

    def run(spark: SparkSession, d: str) -> DataFrame:
        got = plugins.parser(name).rows(_table(spark, d, "part").select(F.expr(parts).alias("value")))
        return got.select("doc_id", F.explode("entries").alias("e")).select("doc_id", "e.ix", "e.token")

    QUERIES[f"records_{name}"], ORACLES[f"records_{name}"] = run, each


_KEY = "CAST(p_partkey AS VARCHAR)"
_records(
    "uniprot",
    "concat('ID   ', p_partkey, ' Reviewed; 5 AA.\nAC   P', p_partkey, ';\nDT   21-JUL-1986, integrated.\nDT   0', 1 + p_size % 9, '-FEB-2001, version 2.\nDE   ', p_name, '\nRN   [', p_size, ']\nRA   ', p_brand, '\nCC   -!- ', p_type, '\nCC   -----------\nSQ   SEQUENCE   ', p_size, ' AA;  ', p_size * 110, ' MW;  0123456789ABCDEF CRC64;\n     MKVLA\n//')".replace("\n", "\\n"),
    {"id": _KEY, "ac": f"'P' || {_KEY} || ';'", "dt": "unnest(['1986-07-21', '2001-02-0' || CAST(1 + p_size % 9 AS VARCHAR)])", "de": "p_name", "ref": "unnest(['[' || CAST(p_size AS VARCHAR) || ']', p_brand])", "cc": "'-!- ' || p_type", "length": "CAST(p_size AS VARCHAR)", "mw": "CAST(p_size * 110 AS VARCHAR)", "crc64": "'0123456789ABCDEF'"},
)
_records(
    "embl",
    "concat('ID   ', p_partkey, '; SV ', p_size, '; linear; mRNA; STD; PLN; ', p_size * 3, ' BP.\nDT   12-SEP-1991 (Rel. 29, Created)\nDT   25-NOV-2005 (Rel. 85, Last updated)\nDE   ', p_name, '\nKW   ', p_type, '\nRL   ', p_brand, '\nFT   CDS  1..9\nFT        /gene=\"', p_brand, '\"\nFT        /translation=\"MKV\nFT        LAA\"\nXX\nSQ   Sequence\n     aaa\n//')".replace("\n", "\\n"),
    {"id": _KEY, "sv": "CAST(p_size AS VARCHAR)", "topology": "'linear'", "dc": "'std'", "td": "'pln'", "length": "CAST(p_size * 3 AS VARCHAR)", "cd_date": "'1991-09-12'", "up_date": "'2005-11-25'", "de": "p_name", "kw": "p_type", "ref": "p_brand", "ft": "p_brand"},
)
_records(
    "genbank",
    "concat('LOCUS       L1  4 aa  linear\nDEFINITION  ', p_name, '\nACCESSION   ', p_partkey, ' X9\nVERSION     v  GI:', p_size, '\nPROJECT     GenomeProject:', p_size, '\nREFERENCE   1  (bases)\n  AUTHORS   ', p_brand, '\nFEATURES             Location\n     /product=\"', p_type, '\"\n     /translation=\"MKV\"\nORIGIN\n   1 mkvl\n//')".replace("\n", "\\n"),
    {"id": _KEY, "locus": "'4 aa  linear'", "definition": "p_name", "accession": f"{_KEY} || ' X9'", "gi": "CAST(p_size AS VARCHAR)", "project": "CAST(p_size AS VARCHAR)", "reference": "unnest(['1  (bases)', p_brand])", "features": "p_type"},
)
_records(
    "omim",
    "concat('*RECORD*\n*FIELD* NO\n', p_partkey, '\n*FIELD* TI\n*', 100000 + p_partkey, ' ', p_name, '; X\n*FIELD* TX\n', p_type, '\n*FIELD* CD\nA: ', 1 + p_size % 12, '/4/1986')".replace("\n", "\\n"),
    {"id": _KEY, "ti": "'*' || CAST(100000 + p_partkey AS VARCHAR) || ' ' || p_name || '; X'", "tx": "p_type", "cd": "'A: ' || CAST(1 + p_size % 12 AS VARCHAR) || '/4/1986'", "cd_date": "'1986-' || lpad(CAST(1 + p_size % 12 AS VARCHAR), 2, '0') || '-04'"},
)
_records(
    "taxonomy",
    "concat('ID : ', p_partkey, '\nPARENT ID : ', p_size, '\nSCIENTIFIC NAME : ', p_name, '\nRANK : ', p_type, '\n//')".replace("\n", "\\n"),
    {"id": _KEY, "parent": "CAST(p_size AS VARCHAR)", "scientific_name": "p_name", "rank": "p_type", "text": "unnest([p_name, p_type])"},
)


@query("records_collection", "SELECT p_partkey AS id, lower(p_brand) AS brand FROM part WHERE lower(p_brand) LIKE '%2%' AND p_size >= 10")
def records_collection(spark: SparkSession, d: str) -> DataFrame:
    """Parsed records as a collection that is queried by the indices their format declares."""
    raw = _table(spark, d, "part").select(F.concat(F.lit("ID           : "), "p_partkey", F.lit("\nResolution   : "), "p_size", F.lit("\nBrand        : "), "p_brand", F.lit("\n//")).alias("value"))
    c = records.collection(plugins.parser("pdbfinder2").rows(raw), "parts")
    brand = F.lower(F.element_at("ix_brand", 1))
    return L.find(c, "resolution>=10 brand:*2*").rows().select(F.col("doc_id").cast("bigint").alias("id"), brand.alias("brand"))


@query("stream_latest", "SELECT CAST(user_id AS VARCHAR) AS doc_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of versions of one document a user; the newest of each stays valid."""
    schema = _table(spark, d, "events").schema
    folder = shared_folder(spark, "stream")
    rows = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")  # a stream takes a pattern, but no path of one file
    made = rows.select(F.col("user_id").cast("string").alias("doc_id"), "event_id")
    updates.keep(made, f"{folder}/docs", f"{folder}/checkpoint").awaitTermination()
    return updates.current(spark, f"{folder}/docs", within="event_id").where("is_valid").select("doc_id", "event_id")


@query("xpath_import", "SELECT o_orderkey AS doc_id, o_orderpriority AS priority, o_orderstatus || ' ' || o_orderpriority AS all_text FROM orders")
def xpath_import(spark: SparkSession, d: str) -> DataFrame:
    """Orders as XML documents, indexed by XPath."""
    made = _table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("<order><status>"), "o_orderstatus", F.lit("</status><priority>"), "o_orderpriority", F.lit("</priority></order>")).alias("xml"))
    return xml.by_xpath(made, "xml", {"priority": "/order/priority/text()"}).select(F.col("o_orderkey").alias("doc_id"), "priority", xml.all_text("xml").alias("all_text"))


query("sequence_stats", "SELECT count(*) AS n_sequences, CAST(sum(60 + p_partkey % 50) AS BIGINT) AS total_length FROM part")(lambda s, d: S.statistics(_proteins(s, d)))
query("entropy_windows", """WITH s AS (SELECT p_partkey, upper(replace(p_name, ' ', '')) AS seq FROM part), w AS (SELECT p_partkey, i, substr(seq, CAST(i + 1 AS BIGINT), 12) AS w FROM (SELECT *, unnest(range(len(seq) - 11)) AS i FROM s WHERE len(seq) >= 12)),
c AS (SELECT p_partkey, i, count(*) / 12 AS p FROM (SELECT p_partkey, i, unnest(string_split(w, '')) AS c FROM w) GROUP BY p_partkey, i, c),
e AS (SELECT p_partkey, i, -sum(p * log2(p)) AS h FROM c GROUP BY p_partkey, i) SELECT p_partkey, count(*) AS n, round(min(h), 6) AS least, round(sum(h), 6) AS total FROM e GROUP BY p_partkey""")(
    lambda s, d: _table(s, d, "part").select("p_partkey", S.entropies(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), 12).alias("h")).where(F.size("h") > 0)
    .select("p_partkey", F.size("h").cast("bigint").alias("n"), F.round(F.array_min("h"), 6).alias("least"), F.round(F.aggregate("h", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
)
query("sequence_fetch", "SELECT p_partkey AS doc_nr, 60 + p_partkey % 50 AS n FROM part")(lambda s, d: _proteins(s, d).select("doc_nr", F.length("seq").cast("bigint").alias("n")))
query("seg_mask")(lambda s, d: _proteins(s, d).select("doc_nr", S.seg(F.col("seq")).alias("masked")))
query("dust_mask")(lambda s, d: _spread(_table(s, d, "part").select("p_partkey", "p_name"), "p_partkey").select("p_partkey", S.dust(F.concat(F.expr("translate(upper(p_name), 'BDEFHIJKLMNOPQRSUVWXYZ ', 'ACGTACGTACGTACGTACGTACG')"), F.lit("A" * 50))).alias("masked")))
query("blast_top")(lambda s, d: S.blast(_proteins(s, d), _proteins(s, d).where("doc_nr = 7").first()["seq"], S.Parameters()))
query("blast_xml")(lambda s, d: S.report_xml(S.blast(_proteins(s, d), _proteins(s, d).where("doc_nr = 7").first()["seq"], S.Parameters())))
query("blast_restricted")(lambda s, d: S.blast(_proteins(s, d), _proteins(s, d).where("doc_nr = 7").first()["seq"], S.Parameters(), _proteins(s, d).where("doc_nr % 2 = 1")))


def _proteins(spark: SparkSession, d: str) -> DataFrame:
    """A made-up protein for every part, from its key alone."""
    letters = "ACDEFGHIKLMNPQRSTVWY"
    n = F.lit(60) + F.col("p_partkey") % 50
    one = lambda i: F.substring(F.lit(letters), F.pmod(F.xxhash64(F.col("p_partkey") % 400, i), F.lit(20)).cast("int") + 1, F.lit(1))
    return _spread(_table(spark, d, "part").select("p_partkey"), "p_partkey").select(F.col("p_partkey").cast("bigint").alias("doc_nr"), F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), one), "").alias("seq"))
