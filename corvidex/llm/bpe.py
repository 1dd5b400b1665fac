"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one token can end its encoding. An automaton
over the vocabulary reports all tokens that end at each position; of those, the
one is stored that is compatible with the stored last token of the prefix before
it. Two neighbouring tokens are compatible if no merge of lower rank would have
joined text across their border. The back-pointers then give the exact ids that
merging pairs by rank gives, in time linear in the text.

Cases: a null text counts as empty and gives no ids; a text of any length and
without any white space is encoded whole; repeated rows are each encoded; an
empty table gives an empty result; other columns are passed through by
``encode_column`` and never read (a clash with an output name raises ValueError).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from ._common import BPE_FILE, bounded_batches

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points on whose class versions of Unicode differ; texts with any are split by the library itself.
NEW_LETTERS = "[՘֋֌࢏౜೜₏₝-₟Ɤ-꭭\U000107bb-\U0010ffff]"
#: Words and pair tests that a worker remembers; beyond that the older half is forgotten. Results don't depend on it.
WORDS_KEPT, PAIRS_KEPT = 500_000, 1_000_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in out.values():
            out[chr(extra)] = b
            extra += 1
    return out


class Bpe:
    """An encoder and decoder for one vocabulary file of the tokenizers library."""

    def __init__(self, path: str = BPE_FILE):
        import ahocorasick
        import regex
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        letters = _byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.token_bytes: list[bytes] = [b""] * (1 + max(chain(vocab.values(), added.values())))
        for text, i in vocab.items():
            if text not in added:
                self.token_bytes[i] = bytes(letters[c] for c in text)
        for text, i in added.items():
            self.token_bytes[i] = text.encode()
        self.id_text = [str(i) for i in range(len(self.token_bytes))]
        self.added = added
        self._added = regex.compile("|".join(f"({regex.escape(a)})" for a in sorted(added, key=len, reverse=True))) if added else None
        self.pairs: dict[tuple[int, int], int] = {}
        self.parts = [(i, i) for i in range(len(self.token_bytes))]
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            i = vocab[a + b]
            if i != 256 + rank:
                raise ValueError(f"{path}: ids do not follow the ranks of the merges")
            self.pairs[vocab[a], vocab[b]] = i
            self.parts[i] = (vocab[a], vocab[b])
        self._suffixes = ahocorasick.Automaton()
        for text, i in vocab.items():
            if text not in added and self._stands(i):
                s = self.token_bytes[i].decode("latin-1")
                self._suffixes.add_word(s, (i, len(s)))
        self._suffixes.make_automaton()
        self._split = regex.compile(SPLIT).findall
        self._odd = regex.compile(NEW_LETTERS).search
        self._library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self._fits: dict[int, bool] = {}
        self._new: dict[str, tuple[int, ...]] = {}
        self._old: dict[str, tuple[int, ...]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand side by side in an encoding."""
        key = left << 20 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= PAIRS_KEPT:
                self._fits.clear()
            known = self._fits[key] = self._test(left, right)
        return known

    def _test(self, left: int, right: int) -> bool:
        pairs, parts, limit = self.pairs, self.parts, len(self.parts)
        while True:
            joined = pairs.get((left, right))
            if joined is not None and joined < limit:
                return False
            # Undo the later of the two merges; only what was there before it can have met.
            if left > right:
                limit, left = left, parts[left][1]
                if left == limit:
                    limit, right = right + 1, parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, parts[right][0]
                if right + 1 == limit:
                    limit, left = left, parts[left][1]
                    if left == limit:
                        return True

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of one word, that is a piece of text that merges never cross."""
        s = word.encode().decode("latin-1")
        last, back, done = [0] * (len(s) + 1), [0] * (len(s) + 1), -1
        fits, compatible = self._fits, self.compatible
        for at, (token, n) in self._suffixes.iter(s):
            if at == done:
                continue
            start = at + 1 - n
            if start:
                ok = fits.get(last[start] << 20 | token)
                if not (compatible(last[start], token) if ok is None else ok):
                    continue
            last[at + 1], back[at + 1], done = token, start, at
        out, end = [], len(s)
        while end:
            out.append(last[end])
            end = back[end]
        return tuple(reversed(out))

    def _stands(self, token: int) -> bool:
        """Whether the token's own text is encoded as the token; one that isn't never comes up."""
        left, right = self.parts[token]
        if left == token:
            return True
        joined = self.pairs.pop((left, right))
        try:
            return self._test(left, right)
        finally:
            self.pairs[left, right] = joined

    def _known(self, word: str) -> tuple[int, ...]:
        ids = self._old.get(word)
        if ids is None:
            ids = self.word(word)
        if len(self._new) >= WORDS_KEPT // 2:
            self._old, self._new = self._new, {}
        if len(word) < 64:
            self._new[word] = ids
        return ids

    def _words(self, text: str) -> list[str]:
        if self._odd(text):
            return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        return self._split(text)

    def encode(self, text: str | None) -> list[int]:
        """Exact ids of the whole text."""
        if not text:
            return []
        out: list[int] = []
        pieces = [text]
        if self._added is not None and self._added.search(text):
            pieces = [p for p in self._added.split(text) if p]
        known = self._known
        for piece in pieces:
            if piece in self.added:
                out.append(self.added[piece])
                continue
            for w in self._words(piece):
                ids = self._new.get(w)
                out += known(w) if ids is None else ids
        return out

    def decode(self, ids: list[int] | None) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids or ())).decode("utf-8", "replace")

    def joined(self, ids: list[int]) -> str:
        return ",".join(map(self.id_text.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str = BPE_FILE) -> Bpe:
    """One model per worker process and file."""
    return Bpe(path)


def _clash(df: DataFrame, *names: str) -> None:
    if bad := {n.lower() for n in names} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(bad)} exist already; choose other output names")


def encode_column(df: DataFrame, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", path: str = BPE_FILE) -> DataFrame:
    """``df`` with the ids of each whole text and their number."""
    _clash(df, ids, n_tokens)
    bounded_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(n_tokens, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches:
            got = [model.encode(x) for x in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.int32())), pa.array([len(x) for x in got], pa.int64())], [*b.schema.names, ids, n_tokens])

    return df.mapInArrow(run, schema)


def decode_column(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str = BPE_FILE) -> DataFrame:
    """``df`` with the text of each array of ids (null counts as empty)."""
    _clash(df, text)
    bounded_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches:
            got = [model.decode(x) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], [*b.schema.names, text])

    return df.mapInArrow(run, schema)


def count_column(df: DataFrame, text: str = "text", n_tokens: str = "n_tokens", path: str = BPE_FILE) -> DataFrame:
    """``df`` with the number of tokens of each whole text instead of the text."""
    rest = [f for f in df.schema.fields if f.name != text]
    _clash(df.drop(text), n_tokens)
    bounded_batches(df.sparkSession)
    schema = T.StructType([*rest, T.StructField(n_tokens, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches:
            n = [len(model.encode(x)) for x in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), pa.array(n, pa.int64())], [*(f.name for f in rest), n_tokens])

    return df.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str = BPE_FILE, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, and the SHA-256 of its ids and of the text decoded from them; the ids too if asked for.

    Without the ids, a result of a few bytes per document leaves the worker
    instead of four bytes per token.
    """
    bounded_batches(docs.sparkSession)
    fields = [docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sha = load(path), hashlib.sha256
        for b in batches:
            n, a, d, kept = [], [], [], []
            for x in b.column(1).to_pylist():
                ids = model.encode(x)
                n.append(len(ids))
                a.append(sha(model.joined(ids).encode()).hexdigest())
                d.append(sha(model.decode(ids).encode()).hexdigest())
                if with_ids:
                    kept.append(pa.array(ids, pa.int32()))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(kept) if kept else pa.array([], pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))
