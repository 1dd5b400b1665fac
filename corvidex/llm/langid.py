"""Language identification by unigram piece models summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.
A word's likelihood is the sum, over all ways to cut it into pieces, of the
product of their probabilities, which the forward algorithm gives in one pass;
training re-estimates the probabilities from the expected counts that the
forward-backward algorithm gives. A text's likelihood is the product over its
words, so words are scored once per worker and looked up after that.

Words are runs of letters (Unicode category L), lower-cased, with the piece
vocabulary's word mark before them; longer ones than ``CHUNK`` letters are cut
after every ``CHUNK`` letters. Nothing of a text is left out.

Cases: a null text, or one without a letter, gives ``und`` and score 0; so does
every text if nothing could be learned. Rows with a null or blank language, text or key
teach nothing. Ties go to the language that sorts first. Repeated rows teach once and are each predicted. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ._common import PIECE_FILE, bounded_batches

MARK, CHUNK, UNKNOWN = "▁", 32, "und"
#: Training documents per language, chosen by a hash of key and text, and the languages and distinct words of each that are learned; the fit alone is bounded, never a prediction.
TRAIN_DOCS, MOST_LANGS, MOST_WORDS = 600, 512, 200_000
ROUNDS, SMOOTH = 3, 0.1
#: The score is the posterior that this many average words of the text give, so that it tells mixed texts from pure ones of any length.
EVIDENCE = 8
#: A factor for each letter that keeps products of probabilities in range; the same for every language.
SCALE = 24.0
WORDS_KEPT = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary as hashes of all its prefixes, so that a batch of words is matched by array operations."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        by: dict[int, dict[int, int]] = {}
        for i, p in enumerate(pieces):
            h = 0
            for n, c in enumerate(p, 1):
                h = ((h + ord(c) + 1) * int(_BASE)) & 0xFFFFFFFFFFFFFFFF
                level = by.setdefault(n, {})
                level.setdefault(h, -1)
                if n == len(p):
                    level[h] = i
        self.levels = []
        for n in range(1, max(by, default=0) + 1):
            keys = np.array(sorted(by[n]), np.uint64)
            self.levels.append((keys, np.array([by[n][int(k)] for k in keys], np.int64)))

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Start offset, in-word end, piece (-1: an unknown single letter) and length of every match; and the words' offsets."""
        text = "".join(words)
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        stop = np.repeat(starts + sizes, sizes)
        at, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        found = []
        for n, (keys, ids) in enumerate(self.levels, 1):
            live = at + n <= stop[at]
            at, h = at[live], h[live]
            if not len(at):
                break
            h = (h + chars[at + n - 1] + np.uint64(1)) * _BASE
            i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            known = keys[i] == h
            piece = np.where(known, ids[i], -1)
            if n == 1:
                found.append((at, piece, np.full(len(at), 1)))
            else:
                whole = piece >= 0
                found.append((at[whole], piece[whole], np.full(int(whole.sum()), n)))
            at, h = at[known], h[known]
        a, p, n = (np.concatenate(x) for x in zip(*found))
        return a, p, n, starts, sizes


def forward(pieces: Pieces, words: list[str], prob: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Log likelihood of each word in each language, summed over all segmentations. prob: pieces x languages."""
    a, p, n, starts, sizes = pieces.edges(words)
    alpha, order, bounds, weight = _alpha(a, p, n, starts, sizes, prob, rare)
    last = np.maximum(alpha[starts + np.arange(len(words)) + sizes], 1e-300)
    return np.log(last) - (sizes * np.log(SCALE))[:, None]


def _alpha(a, p, n, starts, sizes, prob, rare):
    """Forward sums at every border (a word of k letters has k + 1), filled by border from left to right."""
    word = np.repeat(np.arange(len(sizes)), sizes)[a]
    src = a + word  # borders are numbered through, one more a word
    end = a - starts[word] + n
    order = np.argsort(end, kind="stable")
    bounds = np.searchsorted(end[order], np.arange(1, int(sizes.max(initial=0)) + 2))
    weight = np.where(p[:, None] >= 0, prob[p], rare) * (SCALE ** n)[:, None]
    alpha = np.zeros((int(sizes.sum()) + len(sizes), prob.shape[1]))
    alpha[starts + np.arange(len(sizes))] = 1.0
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        e = order[lo:hi]
        dst, part = src[e] + n[e], alpha[src[e]] * weight[e]
        for c in range(part.shape[1]):
            alpha[:, c] += np.bincount(dst, part[:, c], len(alpha)) if len(alpha) < 4 * len(dst) else 0
        if len(alpha) >= 4 * len(dst):
            np.add.at(alpha, dst, part)
    return alpha, order, bounds, weight


def expected(pieces: Pieces, words: list[str], counts: np.ndarray, prob: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Expected piece counts of the words under one language's model (a single column), by forward-backward."""
    a, p, n, starts, sizes = pieces.edges(words)
    alpha, order, bounds, weight = _alpha(a, p, n, starts, sizes, prob, rare)
    word = np.repeat(np.arange(len(sizes)), sizes)[a]
    src, final = a + word, starts + np.arange(len(sizes)) + sizes
    beta = np.zeros(len(alpha))
    beta[final] = 1.0
    flow = np.zeros(len(a))
    for lo, hi in zip(bounds[-2::-1], bounds[:0:-1]):
        e = order[lo:hi]
        flow[e] = weight[e, 0] * beta[src[e] + n[e]]
        np.add.at(beta, src[e], flow[e])
    post = alpha[src, 0] * flow * (counts / np.maximum(alpha[final, 0], 1e-300))[word]
    return np.bincount(p[p >= 0], post[p >= 0], len(pieces.pieces))


def vocabulary(path: str = PIECE_FILE) -> list[str]:
    """The pieces of a public sentencepiece file that lower-cased words can hold."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return [p for p in pieces if p == p.lower() and len(p) <= CHUNK + 1 and p.removeprefix(MARK).isalpha() or p == MARK]


def words_of(text: str | None) -> list[str]:
    """The text's words as they are scored."""
    return [] if not text else _split()(text.lower())


_FIND = None


def _split():
    global _FIND
    if _FIND is None:
        import regex

        _FIND = regex.compile(r"\p{L}+").findall
    return _FIND


def chunks(word: str) -> list[str]:
    return [MARK + word[i : i + CHUNK] for i in range(0, len(word), CHUNK)]


@dataclass
class Model:
    """Languages, the vocabulary, and a probability for each piece and language; small enough to broadcast (pieces x languages x 8 bytes)."""

    langs: list[str]
    pieces: list[str]
    prob: np.ndarray
    rare: np.ndarray
    _matcher: Pieces | None = field(default=None, repr=False)
    _at: dict[str, int] = field(default_factory=dict, repr=False)
    _rows: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_matcher": None, "_at": {}, "_rows": None}

    def with_background(self) -> Model:
        """The model and, as a further language ``und``, one in which every piece and every unknown letter is as likely as any other."""
        if not self.langs:
            return self
        even = 1.0 / len(self.pieces)
        prob = np.column_stack((self.prob, np.full(len(self.pieces), even)))
        return Model([*self.langs, UNKNOWN], self.pieces, prob, np.append(self.rare, even))

    def words(self, words: list[str]) -> np.ndarray:
        """Log likelihoods (words x languages), each distinct word computed once."""
        if self._matcher is None:
            self._matcher = Pieces(self.pieces)
        parts = [(i, c) for i, w in enumerate(words) for c in chunks(w)]
        owner = np.array([i for i, _ in parts], np.int64)
        out = np.zeros((len(words), len(self.langs)))
        for at in range(0, len(parts), 20_000):
            got = forward(self._matcher, [c for _, c in parts[at : at + 20_000]], self.prob, self.rare)
            np.add.at(out, owner[at : at + 20_000], got)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        lists = [words_of(t) for t in texts]
        if self._rows is None or len(self._at) > WORDS_KEPT:
            self._at, self._rows = {}, np.zeros((0, len(self.langs)), np.float32)
        at = self._at
        new = [w for w in dict.fromkeys(w for ws in lists for w in ws) if w not in at]
        if new:
            base = len(at)
            at.update(zip(new, range(base, base + len(new))))
            if base + len(new) > len(self._rows):
                self._rows = np.concatenate((self._rows, np.zeros((max(len(new), len(self._rows) // 2), len(self.langs)), np.float32)))
            self._rows[base : base + len(new)] = self.words(new)
        langs, scores = [], []
        for ws in lists:
            if not ws:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            s = self._rows[np.fromiter(map(at.__getitem__, ws), np.int64, len(ws))].sum(0, dtype=np.float64)
            best = int(s.argmax())
            s /= max(1.0, len(ws) / EVIDENCE)
            langs.append(self.langs[best])
            scores.append(float(1.0 / np.exp(s - s[best]).sum()))
        return langs, scores


def fit_counts(counts: dict[str, Counter], pieces: list[str], rounds: int = ROUNDS, smooth: float = SMOOTH) -> Model:
    """A model from each language's word counts."""
    langs = sorted(counts)
    matcher = Pieces(pieces)
    prob, rare = np.zeros((len(pieces), len(langs))), np.zeros(len(langs))
    for c, lang in enumerate(langs):
        words, n = [], []
        for w, k in sorted(counts[lang].items()):
            for part in chunks(w):
                words.append(part)
                n.append(k)
        n = np.array(n, float)
        p = np.full((len(pieces), 1), 1.0 / max(1, len(pieces)))
        for _ in range(rounds):
            got = np.zeros(len(pieces))
            for at in range(0, len(words), 20_000):
                got += expected(matcher, words[at : at + 20_000], n[at : at + 20_000], p, np.array([1e-9]))
            p = ((got + smooth) / (got.sum() + smooth * len(pieces)))[:, None]
        prob[:, c] = p[:, 0]
    if len(langs):
        rare[:] = prob.min() / 10
    return Model(langs, pieces, prob, rare, matcher)


def fit(train: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", path: str = PIECE_FILE, docs_per_lang: int = TRAIN_DOCS) -> Model:
    """A model learned from labelled rows, from about ``docs_per_lang`` whole documents a language.

    The documents are those with the smallest hashes of key and text, by a rate
    for each language, so that no language is sorted in one task; equal rows among them teach once. The driver
    gets the word counts of this bounded sample only, of the commonest ``MOST_LANGS`` languages and their
    ``MOST_WORDS`` commonest words.
    """
    spark = train.sparkSession
    bounded_batches(spark)
    rows = train.select(F.col(key).alias("k"), F.col(text).alias("x"), F.col(lang).alias("l")).where("k is not null and x is not null and l is not null and trim(l) <> ''")
    sizes = rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(MOST_LANGS).collect()
    if not sizes:
        return Model([], [], np.zeros((0, 0)), np.zeros(0))
    rates = spark.createDataFrame([(r["l"], min(1.0, docs_per_lang / r["n"])) for r in sizes], "l string, rate double")
    hashed = rows.withColumn("h", F.xxhash64("k", "x")).join(F.broadcast(rates), "l")
    chosen = hashed.where(F.pmod("h", F.lit(1 << 24)) < F.col("rate") * (1 << 24)).groupBy("l", "h").agg(F.first("x").alias("x")).select("l", "x")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: dict[str, Counter] = {}
            for name, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got.setdefault(name, Counter()).update(words_of(x))
            flat = [(name, w, n) for name, c in got.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.string()), pa.array([r[1] for r in flat], pa.string()), pa.array([r[2] for r in flat], pa.int64())], ["l", "w", "n"])

    words = chosen.mapInArrow(count, "l string, w string, n bigint").groupBy("l", "w").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "w"))
    table = words.withColumn("place", place).where(F.col("place") <= MOST_WORDS).drop("place").toArrow()
    counts: dict[str, Counter] = {}
    for name, w, n in zip(*(c.to_pylist() for c in table.columns)):
        counts.setdefault(name, Counter())[w] = n
    return fit_counts(counts, vocabulary(path))


def predict(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language of each whole text and its posterior probability."""
    if bad := {lang.lower(), score.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(bad)} exist already; choose other output names")
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            names, scores = own.predict(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, lang, score])

    return docs.mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: Model, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text has a language of the model with at least this posterior; same columns.

    The background takes part, so a text that no language explains better than it is rejected, however few were learned.
    """
    names = [f"_lang_{i}" for i in range(2)]
    return predict(docs, model.with_background(), text, *names).where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least)).drop(*names)
