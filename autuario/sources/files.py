"""CSV with logical lines, number lists, and folders of originals with receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from autuario.functions.legal import court_of_number
from autuario.functions.text import digits


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header and cells of several lines, a byte order mark tolerated; ``line`` is the record's number.

    A file of such records can't be split, so each file is one task; the number
    follows the order within the file.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    clean = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    order = F.monotonically_increasing_id()
    return clean.withColumn("line", (order - F.shiftleft(F.shiftright(order, 33), 33) + 2).cast("int")).withColumn("source", F.input_file_name())


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """``number, court, origin``: a list of process numbers, one a line; blank lines and comments (#) don't count."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "^\\ufeff", "")).alias("origin")).where("origin <> '' and not startswith(origin, '#')")
    n = digits(F.col("origin"))
    return lines.select(n.alias("number"), court_of_number(n).alias("court"), "origin").where("number <> ''")


def merged(numbers: DataFrame) -> DataFrame:
    """Each number once, with all its origins in order."""
    return numbers.groupBy("number", "court").agg(F.array_sort(F.collect_set("origin")).alias("origins"))


def read_originals(spark: SparkSession, path: str, receipts: DataFrame) -> DataFrame:
    """Originals against their receipts (``url, sha256, obtained``): the latest receipt of each content, and whether the bytes are those.

    ``state``: ``verified``, ``unreceipted`` (no receipt has the content) or ``lost``
    (no file has it). A URL with two contents of one instant is ``ambiguous``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")
    latest = receipts.groupBy("sha256").agg(F.max_by(F.struct("url", "obtained"), F.struct("obtained", "url")).alias("r"))
    unclear = receipts.groupBy("url", "obtained").agg(F.count_distinct("sha256").alias("k")).where("k > 1").select("url").distinct().withColumn("ambiguous", F.lit(True))
    state = F.when(F.col("r").isNull(), "unreceipted").when(F.col("path").isNull(), "lost").otherwise("verified")
    joined = files.join(latest, "sha256", "full_outer").select("sha256", "path", "length", "r.url", "r.obtained", state.alias("state"))
    return joined.join(unclear, "url", "left").select("sha256", "path", "length", "url", "obtained", "state", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))
