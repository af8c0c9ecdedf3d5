"""Measures of ranked answers against graded relevance."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_query(ranked: DataFrame, query: str, rank: str, grade: str, k: int) -> DataFrame:
    """``query, hit, recall, rr, ndcg`` at ``k`` of each query that has a relevant answer.

    ``ranked`` has all judged answers of each query; grade 0 is irrelevant, the gain of
    a grade g is 2^g - 1, discounted by the logarithm of the position, and the ideal is
    cut at ``k``.
    """
    by = Window.partitionBy(query)
    rows = ranked.select(F.col(query).alias("query"), F.col(rank).alias("r"), F.col(grade).alias("g"))
    by = Window.partitionBy("query")
    placed = rows.withColumn("k", F.row_number().over(by.orderBy("r"))).withColumn("best", F.row_number().over(by.orderBy(F.col("g").desc(), "r")))
    gain = F.pow(F.lit(2.0), F.col("g")) - 1
    top = F.col("k") <= k
    found = placed.groupBy("query").agg(
        F.sum((F.col("g") > 0).cast("int")).alias("n"), F.max(F.when(top, (F.col("g") > 0).cast("int")).otherwise(0)).alias("hit"),
        F.sum(F.when(top, (F.col("g") > 0).cast("int")).otherwise(0)).alias("got"), F.min(F.when(F.col("g") > 0, F.col("k"))).alias("first"),
        F.sum(F.when(top, gain / F.log2(F.col("k") + 1)).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("best") <= k, gain / F.log2(F.col("best") + 1)).otherwise(0.0)).alias("ideal"),
    ).where("n > 0")
    return found.select("query", "hit", (F.col("got") / F.col("n")).alias("recall"), (1 / F.col("first")).alias("rr"), (F.col("dcg") / F.col("ideal")).alias("ndcg"))


def averaged(measures: DataFrame, *by: str) -> DataFrame:
    """Means of the measures, over all queries or by group."""
    return measures.groupBy(*by).agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(n) for c, n in (("hit", "hit"), ("recall", "recall"), ("rr", "mrr"), ("ndcg", "ndcg"))])


def bootstrap(values: Sequence[float], resamples: int = 2000, seed: int = 42) -> tuple[float, float]:
    """The 95 % interval of a mean, by seeded resampling of the few values of an evaluation."""
    draw = random.Random(seed)
    means = sorted(sum(draw.choices(values, k=len(values))) / len(values) for _ in range(resamples))
    return means[int(0.025 * resamples)], means[int(0.975 * resamples) - 1]


def hash_cover(pairs: DataFrame, document: str, key: str, seed: str) -> DataFrame:
    """``document, draw``: a greedy cover, each document in the order of a hash that has a key no chosen one before it has.

    Such a document is the first of some key, and the first of any key is chosen, so
    the cover is the first document of each key. Null documents and keys have no part.
    """
    drawn = pairs.select(F.col(document).alias("document"), F.col(key).alias("key"), F.sha2(F.concat(F.lit(f"{seed}:"), F.col(document)), 256).alias("draw")).where("document is not null and key is not null")
    return drawn.groupBy("key").agg(F.min(F.struct("draw", "document")).alias("x")).select("x.document", "x.draw").distinct()
