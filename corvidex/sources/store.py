"""Where collections are kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators.collection import Collection, joined


class Registry:
    """Names of collections, aliases for joined ones, and those that a search over all leaves out."""

    def __init__(self):
        self._own: dict[str, Collection] = {}
        self._aliases: dict[str, list[str]] = {}
        self._ignored: set[str] = set()

    def add(self, name: str, c: Collection, ignore_in_all: bool = False) -> None:
        c.name = name
        self._own[name] = c
        if ignore_in_all:
            self._ignored.add(name)

    def alias(self, name: str, parts: list[str]) -> None:
        self._aliases[name] = parts

    def open(self, name: str) -> Collection:
        """One collection, an alias, or several joined by +."""
        parts = [p for n in name.split("+") for p in self._aliases.get(n, [n])]
        if missing := [p for p in parts if p not in self._own]:
            raise KeyError(f"unknown collections: {missing}")
        return self._own[parts[0]] if len(parts) == 1 else joined([self._own[p] for p in parts])

    def all(self) -> list[Collection]:
        return [c for n, c in self._own.items() if n not in self._ignored]

    def left_out(self) -> set[str]:
        """Names that a search over all leaves out."""
        return set(self._ignored)

    def names(self) -> list[str]:
        return list(self._own)

    def info(self) -> DataFrame:
        """(db, n_docs, raw_bytes) of every collection."""
        return reduce(lambda a, b: a.union(b), [c.statistics().select(F.lit(n).alias("db"), "n_docs", "raw_bytes") for n, c in self._own.items()])
