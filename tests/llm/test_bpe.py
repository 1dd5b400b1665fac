import hashlib
import random

import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from corvidex.llm import bpe
from corvidex.llm._common import BPE_FILE

PARTS = ["the ", "ing", "é", "ß", "!!", "\n\n", "  ", "\t", "1", "23", "<|endoftext|>", "'s", "'ll", "中", "😀", "\x1c", "\x85", "a", "Th", "tion", "||", "***", "꟎", "x" * 50]
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BPE_FILE)
    t.no_truncation()
    t.no_padding()
    return t


def test_every_token_of_the_vocabulary(library):
    m = bpe.load()
    texts = []
    for b in m.token_bytes[:50256]:
        try:
            texts.append(b.decode())
        except UnicodeDecodeError:
            pass
    assert [x.ids for x in library.encode_batch(texts, add_special_tokens=False)] == [m.encode(t) for t in texts]


def test_random_texts(library):
    m, rng = bpe.load(), random.Random(1)
    for _ in range(3000):
        s = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30)))
        ids = library.encode(s, add_special_tokens=False).ids
        assert m.encode(s) == ids, s
        assert m.decode(ids) == library.decode(ids, skip_special_tokens=False) == s


def test_long_word_without_spaces(library):
    s = "ab" * 3000 + "zq" * 3000
    assert bpe.load().encode(s) == library.encode(s, add_special_tokens=False).ids


def test_broken_bytes_decode_to_the_replacement_character(library):
    ids = bpe.load().encode("é")[:1] + bpe.load().encode("中文")[:-1]
    assert bpe.load().decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_digests(spark, library):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x " * 20000), (4, "<|endoftext|>")]
    got = bpe.digests(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    want = set()
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.add((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert {tuple(r) for r in got} == want


def test_columns_pass_through_and_clashes_are_refused(spark):
    df = spark.createDataFrame([(1, "hello world", "x")], "doc_id long, text string, extra string")
    both = bpe.decode_column(bpe.encode_column(df)).first()
    assert both["decoded"] == "hello world" and both["extra"] == "x" and both["n_tokens"] == len(both["ids"]) == 2
    with pytest.raises(ValueError):
        bpe.encode_column(df.withColumnRenamed("extra", "IDS"))
    clash = df.withColumn("n_tokens", df.doc_id).withColumn("ids_sha256", df.text)
    assert bpe.digests(clash).first()["n_tokens"] == 2


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], DOCS), with_ids=True).collect() == []
    assert bpe.encode_column(spark.createDataFrame([], DOCS)).collect() == []
