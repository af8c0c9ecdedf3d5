"""Joins against keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one row in so many; there can be no more hot keys than this.
HOT_SHARE = 1000


def counted_keys(df: DataFrame, key: str) -> DataFrame:
    """Each non-null key with its number of rows ``n`` (combined before the shuffle)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def semi_join_counted(df: DataFrame, wanted: DataFrame, key: str, total: int) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``wanted`` (unique ``key``, its row count ``n``).

    The rows of hot keys never meet in one task: keys with more than
    ``total / HOT_SHARE`` rows, of which there are at most ``HOT_SHARE``, are
    broadcast and matched where the rows are; the others are shuffled.
    """
    least = max(1, total // HOT_SHARE)
    hot = wanted.where(F.col("n") > least).select(key, F.lit(True).alias("_hot"))
    cold = wanted.where(F.col("n") <= least).select(key)
    marked = df.join(F.broadcast(hot), key, "left")
    here = marked.where(F.col("_hot")).drop("_hot")
    rest = marked.where(F.col("_hot").isNull() & F.col(key).isNotNull()).drop("_hot")
    return here.unionByName(rest.join(cold.hint("merge"), key, "left_semi"))


def left_join_counted(df: DataFrame, answers: DataFrame, key: str, total: int) -> DataFrame:
    """``df`` left-joined with ``answers`` (one row for every ``key`` of ``df``, with its row count ``n``).

    As in ``semi_join_counted``, hot keys are answered where their rows are; rows
    with a null key need no partner. ``n`` is dropped.
    """
    least = max(1, total // HOT_SHARE)
    values = [c for c in answers.columns if c not in (key, "n")]
    hot = answers.where(F.col("n") > least).drop("n").withColumn("_hot", F.lit(True))
    marked = df.join(F.broadcast(hot), key, "left")
    here = marked.where(F.col("_hot") | F.col(key).isNull()).drop("_hot")
    rest = marked.where(F.col("_hot").isNull() & F.col(key).isNotNull()).drop("_hot", *values)
    return here.unionByName(rest.join(answers.where(F.col("n") <= least).drop("n"), key, "left"))
