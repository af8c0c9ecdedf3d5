"""Structured Streaming forms: windowed counts, orphan state and latest content by rank.

Each stream has a folder in the shared storage with its checkpoint and what it has
put out. Started again with the same folder it goes on where it stopped; a batch that
is replayed replaces what it wrote before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import LongType, StructField, StructType

from autuario.operators.ingest import winners
from autuario.operators.orphans import OrphanLedger
from autuario.runtime import checkpoint_root, kept


def table_stream(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """A Parquet table as a stream of its files; a table of one file is picked out of its folder."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def _place(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared storage, for a stream that needn't go on later."""
    place = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    kept(spark, place)
    return place


def run_to_end(writer: DataStreamWriter, folder: str) -> None:
    """Run a stream over what there is and wait for it; its checkpoint is in the folder."""
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _updates(rows: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Run an aggregation in update mode, each batch's changed rows into a folder of its number; the last row of each key."""
    spark = rows.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    run_to_end(rows.writeStream.outputMode("update").foreachBatch(keep), folder)
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/updates")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):  # nothing has come yet
        return spark.createDataFrame([], rows.schema)
    held = spark.read.schema(StructType([*rows.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/updates")
    values = [c for c in rows.columns if c not in keys]
    last = held.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*keys, *[F.col("last")[c].alias(c) for c in values]).select(*rows.columns)


def daily_counts(events: DataFrame, instant: str, *by: str, late: str = "31 days") -> DataFrame:
    """Events per day and group; a day is final, and leaves the state, when the watermark has passed it."""
    when = F.col(instant).cast("timestamp")
    return events.withColumn("_at", when).withWatermark("_at", late).groupBy(F.window("_at", "1 day").alias("w"), *by).agg(F.count("*").alias("n")).select(
        F.col("w.start").cast("date").alias("day"), *by, "n"
    )


def write_daily_counts(spark: SparkSession, events: DataFrame, instant: str, *by: str, folder: str | None = None) -> DataFrame:
    """The table of ``daily_counts`` of what has come so far; the state holds the days that may still change."""
    return _updates(daily_counts(events, instant, *by), folder or _place(spark, "daily"), ["day", *by])


def orphan_stream(spark: SparkSession, references: DataFrame, ledger: OrphanLedger, folder: str | None = None) -> OrphanLedger:
    """Feed a stream of references, batch by batch, to a ledger.

    Each batch is one version, which carries the batch's number: a batch replayed
    after a failure is known by it and not applied twice.
    """
    folder = folder or _place(spark, "orphans")
    state = {"ledger": ledger.at() or ledger}

    def step(batch: DataFrame, number: int) -> None:
        tag = f"{folder}:{number}"
        if state["ledger"].tag != tag:
            state["ledger"] = state["ledger"].step(refs=batch.select(*ledger.schema.names), tag=tag)

    run_to_end(references.writeStream.foreachBatch(step), folder)
    return state["ledger"]


def latest_stream(spark: SparkSession, observations: DataFrame, folder: str | None = None) -> DataFrame:
    """Latest content per document from a stream of ``document_id, resource_id, hash, rank_key``.

    The state is one row per document, in the state store; a batch touches only the
    documents it brings. Late rows of an older rank never displace a newer one.
    """
    best = F.max_by(F.struct("resource_id", "hash", "rank_key"), F.struct("rank_key", "resource_id", "hash")).alias("w")
    rows = observations.groupBy("document_id").agg(best).select("document_id", "w.resource_id", "w.hash", "w.rank_key")
    return winners(_updates(rows, folder or _place(spark, "latest"), ["document_id"]))
