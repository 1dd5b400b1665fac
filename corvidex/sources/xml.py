"""XML documents as columns, by Spark's own XPath functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def all_text(x: str | Column) -> Column:
    """All text of a document, depth first, joined by single spaces."""
    col = F.col(x) if isinstance(x, str) else x
    return F.concat_ws(" ", F.filter(F.transform(F.xpath(col, F.lit("//text()")), lambda t: F.trim(t)), lambda t: t != ""))


def by_xpath(df: DataFrame, column: str, paths: dict[str, str]) -> DataFrame:
    """``df`` with a column for each index: the texts that its path finds, joined by spaces."""
    return df.select("*", *[F.concat_ws(" ", F.xpath(F.col(column), F.lit(p))).alias(n) for n, p in paths.items()])
