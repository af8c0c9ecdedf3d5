"""Periods split until each part is small enough, and calendar gaps."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_period(counts: dict[date, int], start: date, end: date, most: int) -> list[tuple[date, date, int]]:
    """Halve [start, end] until each part has at most ``most`` or is one day: (from, to, number)."""
    n = sum(v for d, v in counts.items() if start <= d <= end)
    if n <= most or start >= end:
        return [(start, end, n)]
    middle = start + (end - start) // 2
    return split_period(counts, start, middle, most) + split_period(counts, middle + timedelta(days=1), end, most)


def parts_of(df: DataFrame, day: str, most: int) -> DataFrame:
    """``start, end, n``: the whole range of a date column in parts of at most ``most`` rows.

    Only the counts per day, as many as there are days, reach the driver.
    """
    spark = df.sparkSession
    counts = {r["d"]: r["n"] for r in df.where(F.col(day).isNotNull()).groupBy(F.col(day).alias("d")).agg(F.count("*").alias("n")).collect()}
    found = split_period(counts, min(counts), max(counts), most) if counts else []
    return spark.createDataFrame(found, "start date, end date, n long")
