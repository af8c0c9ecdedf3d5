"""Queries that run over streams of the tables, to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from autuario.operators.orphans import KEY, OrphanLedger, corpus_parents, corpus_references
from autuario.plans import core, relations
from autuario.sources.tables import table
from autuario.streaming import streams as S


def stream_daily_counts(spark, d):
    """Events per day and type."""
    return S.write_daily_counts(spark, S.table_stream(spark, f"{d}/events.parquet"), "ts", "event_type")


def stream_orphans(spark, d):
    """The orphans of document_citations and citation_links, by steps of the ledger.

    All documents ever logged arrive, then two streams of references, then the documents held and the
    precedents, for which references wait; last, the documents no longer held are deleted.
    """
    citations, links = table(spark, d, "document_citations"), table(spark, d, "citation_links")
    none = corpus_references(citations.limit(0), links.limit(0))
    held = corpus_parents(table(spark, d, "documents"), table(spark, d, "precedents"))
    logged = table(spark, d, "versions").where("document_id is not null").select(F.explode(F.array(F.concat(F.lit("d|"), "document_id"), F.concat(F.lit("e|"), "document_id"))).alias(KEY)).distinct()
    ledger = OrphanLedger.empty(spark, none).step(arrived=logged)
    ledger = S.orphan_stream(spark, corpus_references(S.table_stream(spark, f"{d}/document_citations.parquet"), links.limit(0).transform(_empty_stream_like(spark, d, "citation_links"))), ledger)
    refs = corpus_references(_empty_stream_like(spark, d, "document_citations")(citations), S.table_stream(spark, f"{d}/citation_links.parquet"))
    ledger = S.orphan_stream(spark, refs, ledger).step(arrived=held)
    return ledger.step(deleted=logged.join(held, KEY, "left_anti")).pending.select(*core.P2_COLUMNS)


def _empty_stream_like(spark, d, name):
    """A stream of the table without rows, to complete a union of streams."""
    return lambda _: S.table_stream(spark, f"{d}/{name}.parquet").where(F.lit(False))


def stream_latest(spark, d):
    """Each document's latest content from a stream of observations of good deliveries."""
    ok = table(spark, d, "resources").where("status = 'ok'").select(F.col("id").alias("resource_id"), "rank_key")
    observed = S.table_stream(spark, f"{d}/observations.parquet").select("resource_id", "document_id", "hash").join(ok, "resource_id")
    return S.latest_stream(spark, observed).withColumnRenamed("id", "document_id")


QUERIES = {f.__name__: f for f in (stream_daily_counts, stream_orphans, stream_latest)}
SQL = {
    "stream_daily_counts": "select ts::date as day, event_type, count(*) as n from events group by all",
    "stream_orphans": core.SQL["p2_found"],
    "stream_latest": relations.SQL["winner_per_document"],
}
