"""The corpus tables, one Parquet table per name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "documents", "search", "document_details", "document_citations", "citation_links",
    "versions", "observations", "resources", "precedents", "precedent_versions", "containers",
)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan of one table; column pruning and filters reach the Parquet reader."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
