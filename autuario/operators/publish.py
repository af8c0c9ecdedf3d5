"""Immutable generations of tables, chosen by a manifest that is replaced last."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from autuario.errors import EngineError
from autuario.runtime import read_small, write_small

MANIFEST = "manifest.json"
#: Generations kept.
KEEP = 3


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def manifest(spark: SparkSession, root: str) -> list[dict]:
    """The generations, newest first; none where there is no manifest."""
    held = read_small(spark, f"{root}/{MANIFEST}")
    return json.loads(held) if held else []


def _digest_of(df: DataFrame) -> list:
    h = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])))
    return [F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("digest")]


def table_digest(df: DataFrame) -> dict:
    """Rows and an order-free digest of a table, to compare what was written with what was meant."""
    row = df.agg(*_digest_of(df)).first()
    return {"rows": row["rows"], "digest": row["digest"] or 0}


def prune(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables as readers need them: contents of the documents held, admitted precedents and their contents; others as they are."""
    out = dict(tables)
    if {"documents", "versions"} <= tables.keys():
        held = tables["documents"].select(F.col("id").alias("document_id"), "hash")
        out["versions"] = tables["versions"].join(held, ["document_id", "hash"], "left_semi")
    if "precedents" in tables:
        out["precedents"] = tables["precedents"].where("admission = 'admitido'")
        if "precedent_versions" in tables:
            out["precedent_versions"] = tables["precedent_versions"].join(out["precedents"].select("id", "hash"), ["id", "hash"], "left_semi")
    return out


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], schema: int = 1) -> str:
    """Write the tables as a new generation, verify it, then point the manifest at it.

    A reader sees the generation before or the new one, never a part. The newest
    ``KEEP`` generations stay.
    """
    held = manifest(spark, root)
    revision = 1 + max((g["revision"] for g in held), default=0)
    where = f"{root}/.new-{revision}"
    fs, path = _fs(spark, root)
    fs.delete(path(where), True)
    digests = {}
    for name, df in sorted(tables.items()):
        meant = Observation(f"digest-{name}")
        df.observe(meant, *_digest_of(df)).write.parquet(f"{where}/{name}")  # digested as it is written
        digests[name] = table_digest(spark.read.parquet(f"{where}/{name}"))
        if digests[name] != {"rows": meant.get["rows"], "digest": meant.get["digest"] or 0}:
            raise EngineError("publicacao_invalida", f"{name} was not written as meant.")
    mark = abs(sum(v["digest"] for v in digests.values())) % 16**10
    name = f"r{revision}-s{schema}-{mark:010x}"
    if not fs.rename(path(where), path(f"{root}/{name}")):
        raise EngineError("publicacao_invalida", "The generation could not be put in place.")
    kept = [{"id": name, "revision": revision, "schema": schema, "tables": digests}, *held][:KEEP]
    write_small(spark, f"{root}/{MANIFEST}", json.dumps(kept, sort_keys=True))
    for old in held[KEEP - 1 :]:
        fs.delete(path(f"{root}/{old['id']}"), True)
    return name


def open_generation(spark: SparkSession, root: str, name: str | None = None, withdrawn: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of a generation (default: the newest); withdrawn ids are left out of tables with an ``id``."""
    held = manifest(spark, root)
    chosen = next((g for g in held if name in (None, g["id"])), None)
    if chosen is None:
        raise EngineError("publicacao_expirada" if held else "base_nao_inicializada", "There is no such generation.")
    tables = {t: spark.read.parquet(f"{root}/{chosen['id']}/{t}") for t in chosen["tables"]}
    if withdrawn:
        gone = spark.createDataFrame([(x,) for x in withdrawn], "id string")  # the optimizer chooses how, by size
        tables = {n: t.join(gone, "id", "left_anti") if "id" in t.columns else t for n, t in tables.items()}
    return tables


def verify(spark: SparkSession, root: str, name: str) -> list[str]:
    """The tables of a generation that are not as published."""
    chosen = next(g for g in manifest(spark, root) if g["id"] == name)
    return [t for t, d in chosen["tables"].items() if table_digest(spark.read.parquet(f"{root}/{name}/{t}")) != d]
