"""What tells rows apart: a doc_id together with the text, since nothing keeps a table from repeating a doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.session import cut


def text_hash() -> Column:
    """64 bits of ``text``; with doc_id it names a row, or rows that repeat both."""
    return F.xxhash64("text")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of ``df``, letter case aside."""
    taken = {c.lower() for c in df.columns}
    return [next(x for k in range(len(taken) + 2) if (x := "_" * k + n).lower() not in taken) for n in names]


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with one of the rows that repeat doc_id and text: the first by its other columns as text, nulls first. Rows of
    null doc_id or text stay. Keys and counts are moved; rows only where there are repeats."""
    d, h, k = unused(docs, "d", "h", "k")
    some = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    often = cut(docs.filter(some).groupBy(F.col("doc_id").alias(d), text_hash().alias(h)).agg(F.count(F.lit(1)).alias(k)).filter(F.col(k) > 1).select(d, h))
    if often.isEmpty():
        return docs
    match = (F.col("doc_id") == F.col(d)) & (text_hash() == F.col(h)) & some
    others = [F.col(f"`{c}`").cast("string") for c, t in docs.dtypes if c not in ("doc_id", "text")]
    first = Window.partitionBy("doc_id", text_hash()).orderBy(*others or [F.lit(0)])
    twins = docs.join(often, match, "left_semi").withColumn(k, F.row_number().over(first)).filter(F.col(k) == 1).drop(k)
    return docs.join(often, match, "left_anti").unionByName(twins)


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id and text hash are in ``gone`` (doc_id, h)."""
    d, h = unused(docs, "d", "h")
    gone = gone.select(F.col("doc_id").alias(d), F.col("h").alias(h)).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col(d)) & (text_hash() == F.col(h)), "left_anti")
