"""Idempotent ingestion of deliveries into versioned tables.

State is a set of immutable tables. A delivery replaces what it said before, adds
contents that are new, and each document it touches is decided again by the rank of
all deliveries that hold it; an older delivery never displaces a newer text.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from autuario.errors import EngineError
from autuario.functions.legal import single_publication, source_date
from autuario.runtime import cut

RECORD = "id string, numeroProcesso string, siglaClasse string, nomeOrgaoJulgador string, ementa string, dataDecisao string, dataPublicacao string"
_OBSERVED = "resource_id string, document_id string, hash string, rank_key string"
_VERSION = "document_id string, hash string, first_seen timestamp, raw string"


def canonical(*columns: str) -> F.Column:
    """Canonical JSON of columns: names in order, nulls kept out."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def validated(records: DataFrame, court: str = "STJ") -> DataFrame:
    """Source records with ``reason``: null for a valid one, else the first thing wrong with it.

    ``records`` has the columns of ``RECORD``; ``position`` is kept if there. A
    repeated id makes its later positions invalid where positions are given.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    date = source_date(F.col("dataDecisao"))
    reason = (
        F.when(blank("id"), "no_id").when(blank("ementa"), "no_text").when(blank("nomeOrgaoJulgador"), "no_organ")
        .when(F.col("dataDecisao").isNotNull() & date.isNull(), "illegible_date")
    )
    raw = canonical(*[f.split()[0] for f in RECORD.split(", ")])
    return records.withColumns({
        "reason": reason, "document_id": F.concat(F.lit(f"{court}:"), F.trim("id")), "raw": raw, "hash": F.sha2(raw, 256), "judgment": date, "publication": single_publication(F.col("dataPublicacao")),
    })


@dataclass(frozen=True)
class Corpus:
    """Tables of a corpus: contents seen, what each delivery holds, and the current documents."""

    versions: DataFrame
    observations: DataFrame
    documents: DataFrame
    revision: int = 0

    @staticmethod
    def empty(spark: SparkSession) -> "Corpus":
        make = lambda schema: spark.createDataFrame([], schema)
        return Corpus(make(_VERSION), make(_OBSERVED), make("id string, resource_id string, hash string"))

    def ingest(self, resource_id: str, rank_key: str, records: DataFrame, seen_at: str) -> tuple["Corpus", dict[str, int]]:
        """Apply a delivery: ``document_id, hash, raw``. Gives the corpus and what happened to documents.

        Applying the same delivery again changes nothing. A document listed twice with
        different contents is refused.
        """
        rows = cut(records.select("document_id", "hash", "raw").distinct(), "ingest-rows")
        if not rows.groupBy("document_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise EngineError("parametro_invalido", "A document stands twice in one delivery.")
        known = self.versions.select("document_id", "hash")
        fresh = rows.join(known, ["document_id", "hash"], "left_anti").select("document_id", "hash", F.lit(seen_at).cast("timestamp").alias("first_seen"), "raw")
        before = self.observations.where(F.col("resource_id") == resource_id)
        now = rows.select(F.lit(resource_id).alias("resource_id"), "document_id", "hash", F.lit(rank_key).alias("rank_key"))
        affected = before.select("document_id").union(rows.select("document_id")).distinct()
        observed = cut(self.observations.where(F.col("resource_id") != resource_id).unionByName(now), "ingest-observations")
        won = winners(observed.join(affected, "document_id", "left_semi"))
        merged = self.documents.join(affected.withColumnRenamed("document_id", "id"), "id", "left_anti").unionByName(won)
        old = self.documents.join(affected.withColumnRenamed("document_id", "id"), "id", "left_semi").select("id", F.col("hash").alias("old"))
        state = F.when(F.col("old").isNull(), "new").when(F.col("hash").isNull(), "removed").when(F.col("old") == F.col("hash"), "unchanged").otherwise("changed")
        counts = {r["state"]: r["n"] for r in old.join(won.select("id", "hash"), "id", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n")).collect()}
        corpus = replace(
            self, versions=cut(self.versions.unionByName(fresh), "ingest-versions"), observations=observed, documents=cut(merged, "ingest-documents"), revision=self.revision + 1,
        )
        return corpus, {s: counts.get(s, 0) for s in ("new", "changed", "unchanged", "removed")}


def winners(observed: DataFrame) -> DataFrame:
    """``id, resource_id, hash``: each document as its delivery of greatest rank has it, then greatest resource id."""
    best = observed.groupBy(F.col("document_id").alias("id")).agg(F.max_by(F.struct("resource_id", "hash"), F.struct("rank_key", "resource_id", "hash")).alias("w"))
    return best.select("id", "w.resource_id", "w.hash")
