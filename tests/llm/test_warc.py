import base64
import hashlib

from corvidex.llm import warc as W
from corvidex.llm._common import shared_dir

SCHEMA = "page_id long, url string, html string"


def brute(rows, least=0):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [k for k, _, h in rows if (h or "") == (html or "") and k is not None]
        first = min(same, default=None)
        again = len(data) >= least and first is not None and i != first
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


ROWS = [
    (5, "http://a/x y\r\nInjected: 1", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "u", None), (8, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (1, "u", "x" * 3_000_000), (2, "v", "x" * 3_000_000), (4, "w", "one"), (6, "z", "two"),
]


def test_round_trip(spark):
    folder = shared_dir(spark)
    index = W.write(spark.createDataFrame(ROWS, SCHEMA), folder)
    assert result(W.read(index, folder)) == brute(ROWS)
    payloads = {r["page_id"]: r["payload"] for r in W.read(index, folder).collect()}
    assert bytes(payloads[3]).decode() == "<p>é</p>" and payloads[5] is None and bytes(payloads[7]).startswith(b"\r\n\r\nWARC")
    assert {r["url"] for r in index.collect()} == {u for _, u, _ in ROWS}


def test_offsets_name_single_records(spark):
    folder = shared_dir(spark)
    index = W.write(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), folder)
    for most in (1, 1 << 20):  # one record a read, then joined reads
        assert result(W.read(index.where("page_id in (3, 6, 8)"), folder, most=most)) == [r for r in brute(ROWS) if r[0] in (3, 6, 8)]


def test_least(spark):
    folder = shared_dir(spark)
    assert result(W.read(W.write(spark.createDataFrame(ROWS, SCHEMA), folder, least=10), folder)) == brute(ROWS, 10)


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "u", "a"), (4, "u", "a"), (4, "u", "a"), (6, "u", "a"), (6, "v", "a"), (None, "u", "only here"), (6, "u", "b")]
    folder = shared_dir(spark)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as digest", "2 as first")
    assert result(W.archive(spark, df, folder)) == brute(rows)


def test_empty_table(spark):
    assert W.archive(spark, spark.createDataFrame([], SCHEMA), shared_dir(spark)).collect() == []


def test_a_changed_byte_is_found(spark):
    data = W.record(1, "u", b"payload", W.digest_of(b"payload"), None, False, "1970-01-01T00:00:00Z")
    assert W.parse(data)["payload"] == b"payload"
    try:
        W.parse(data.replace(b"payload\r\n\r\n", b"pazload\r\n\r\n"))
    except ValueError:
        return
    raise AssertionError("a broken payload was accepted")


def test_every_record_has_an_id_of_its_own(spark):
    import re
    import zlib

    rows = [(4, "u", "a"), (4, "u", "a"), (4, "v", "b"), (None, "u", "a"), (None, None, "c"), (None, None, "c")]
    folder = shared_dir(spark)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as file", "2 as offset", "3 as length", "4 as d", "5 as n", "6 as p", "7 as b")
    index = W.write(df, folder).collect()
    ids = set()
    for r in index:
        with open(f"{folder.removeprefix('file://')}/{r['file']}", "rb") as f:
            f.seek(r["offset"])
            ids.add(re.search(rb"WARC-Record-ID: (<urn:uuid:[0-9a-f-]{36}>)", zlib.decompress(f.read(r["length"]), 31))[1])
    assert len(ids) == len(rows)
