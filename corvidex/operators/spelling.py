"""Spelling suggestions over the keys of a collection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .collection import Collection

MATCH, DELETE, SUBSTITUTE, TRANSPOSE, INSERT = 1, -1, -2, -2, -4


def dictionary(c: Collection, indices: list[str] | None = None, shortest: int = 2, least_df: int = 1) -> DataFrame:
    """(key): keys to suggest: long enough, not all digits and dots, and frequent enough in some chosen index."""
    rows = c.table("lexicon")
    if indices:
        rows = rows.where(F.col("ix").isin(*[c.index(i).name for i in indices]))
    return rows.where((F.length("key") >= shortest) & ~F.rlike("key", F.lit(r"^[0-9.]+$")) & (F.col("df") >= least_df)).select("key").distinct()


def score(word: str, key: str) -> int | None:
    """The best score of walking through ``key`` by ``word``; None if no walk ends there.

    Each step takes the key's next letter, the word's, both or swaps the word's next two; what is left of the
    word does not count. An edit starts only where the score so far is not negative. The walk may end with a match after one edit at most, or with a
    letter deleted from or substituted in the key as its second one at most.
    """
    best, now = None, {(0, 0, 0, 0): 0}  # place in the word, place in the key, edits, swapped: 1 before, 2 between the two letters

    def letter(i: int, swap: int) -> str:
        return word[i + 1] if swap == 1 else word[i : i + 1]

    def after(i: int, swap: int) -> tuple[int, int]:
        return (i, 2) if swap == 1 else (i + 2, 0) if swap == 2 else (i + 1, 0)

    while now:
        then: dict[tuple[int, int, int, int], int] = {}

        def go(i: int, swap: int, j: int, edits: int, total: int, ends: bool) -> None:
            nonlocal best
            if j == len(key) and ends and (best is None or total > best):
                best = total
            if j < len(key) and then.get((i, j, edits, swap), total - 1) < total:
                then[i, j, edits, swap] = total

        for (i, j, edits, swap), total in now.items():
            has = letter(i, swap)
            if has == key[j]:
                go(*after(i, swap), j + 1, edits, total + MATCH, edits <= 1)
            if total >= 0 and edits < 2:
                go(i, swap, j + 1, edits + 1, total + DELETE, True)
                if has:
                    go(*after(i, swap), j, edits + 1, total + INSERT, False)
                    go(*after(i, swap), j + 1, edits + 1, total + SUBSTITUTE, True)
                if not swap and i + 1 < len(word):
                    go(i, 1, j, edits + 1, total + TRANSPOSE, False)
        now = then
    return best


def suggest(c: Collection, word: str, n: int = 20, **options) -> DataFrame:
    """(key, score): the n best suggestions, without the word itself; ties by key."""
    word = word.lower()
    near = dictionary(c, **options).where(F.col("key") != word)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s = [score(word, k) for k in f["key"]]
            yield pd.DataFrame({"key": f["key"], "score": pd.array(s, "Int64")}).dropna()

    return near.mapInPandas(run, "key string, score bigint").orderBy(F.desc("score"), "key").limit(n)


def suggest_with_hits(c: Collection, word: str, n: int = 20) -> DataFrame:
    """(key, score, hits): suggestions that some document holds, with the number of documents; best first, ties by key."""
    found = suggest(c, word, n).join(c.all_text_df().withColumnRenamed("df", "hits"), "key")
    return found.select("key", "score", "hits").orderBy(F.desc("score"), "key")
