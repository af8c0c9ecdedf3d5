"""Catalogs, exports and backups: full outer comparisons against what was there before."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_catalog(old: DataFrame, listed: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """The catalog after a listing: new and changed entries pending, unlisted ones marked absent and kept.

    Result: ``key``, the fingerprint expected, that applied (null: never), ``present`` and ``pending``.
    """
    was = old.select(F.col(key).alias("_k"), F.col("applied").alias("_applied"), F.col(fingerprint).alias("_old"))
    now = listed.select(F.col(key), F.col(fingerprint).alias("_new")).distinct()
    joined = now.join(was, F.col(key).eqNullSafe(F.col("_k")), "full_outer")
    expected = F.coalesce("_new", "_old")
    return joined.select(
        F.coalesce(key, "_k").alias(key), expected.alias(fingerprint), F.col("_applied").alias("applied"), F.col(key).isNotNull().alias("present"),
        (F.col(key).isNotNull() & ~expected.eqNullSafe(F.col("_applied"))).alias("pending"),
    )


def markdown(title: Column, fields: dict[str, Column], body: Column) -> Column:
    """A document as Markdown: title, a list of fields that have a value, and the body."""
    lines = F.array_compact(F.array(*[F.concat(F.lit(f"- {n}: "), c.cast("string")) for n, c in fields.items()]))
    return F.concat_ws("\n", F.concat(F.lit("# "), title), F.lit(""), F.array_join(lines, "\n"), F.lit(""), F.coalesce(body, F.lit("")), F.lit(""))


def export_plan(documents: DataFrame, previous: DataFrame) -> DataFrame:
    """``id, file, sha256, content, action``: what to write and what to retire.

    ``documents``: id, content. ``previous``: id, sha256 of the last export. The file
    name is the digest of the id; unchanged files are kept, vanished ids retired.
    """
    now = documents.select("id", "content", F.sha2("content", 256).alias("sha256"))
    was = previous.select(F.col("id").alias("_id"), F.col("sha256").alias("_sha"))
    action = F.when(F.col("id").isNull(), "retire").when(F.col("_id").isNull(), "add").when(F.col("sha256") == F.col("_sha"), "keep").otherwise("replace")
    joined = now.join(was, F.col("id") == F.col("_id"), "full_outer")
    key = F.coalesce("id", "_id")
    return joined.select(key.alias("id"), F.concat(F.sha2(key, 256), F.lit(".md")).alias("file"), F.coalesce("sha256", "_sha").alias("sha256"), "content", action.alias("action"))


def depot_orphans(depot: DataFrame, kept: DataFrame) -> DataFrame:
    """Stored contents (``sha256``) that no kept backup refers to."""
    return depot.join(kept.select("sha256").where("sha256 is not null"), "sha256", "left_anti")


def differences(df: DataFrame, id_col: str, a_col: str, b_col: str) -> DataFrame:
    """``id, ord, change, before, after``: the character runs in which two texts differ (Arrow batches, ``difflib``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, a, b in zip(*(batch.column(c).to_pylist() for c in ("id", "a", "b"))):
                codes = [c for c in SequenceMatcher(None, a or "", b or "", autojunk=False).get_opcodes() if c[0] != "equal"]
                rows += [(i, k, what, (a or "")[a1:a2], (b or "")[b1:b2]) for k, (what, a1, a2, b1, b2) in enumerate(codes)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))], names=["id", "ord", "change", "before", "after"]
            )

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(a_col).alias("a"), F.col(b_col).alias("b"))
    return rows.where(~F.col("a").eqNullSafe(F.col("b"))).mapInArrow(run, "id string, ord int, change string, before string, after string")


def official(url: Column, domains: list[str]) -> Column:
    """Whether a URL is HTTPS on one of the domains or below it."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    fits = F.lit(False)
    for d in domains:
        fits = fits | (host == d) | host.endswith(f".{d}")
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & fits, F.lit(False))
