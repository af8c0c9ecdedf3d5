"""Keeping what was collected: originals by content, run logs, receipts, packages, backups and releases."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from autuario.errors import EngineError
from autuario.operators.publish import MANIFEST, manifest, verify
from autuario.runtime import read_small, write_small

#: States of a run.
RUNNING, OK, PARTIAL, ERROR, INTERRUPTED = "running", "ok", "partial", "error", "interrupted"
PACKAGE = "id string, tribunal string, species string, numero string, organ string, publication string, hash string, body string"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def save_original(spark: SparkSession, root: str, content: bytes) -> str:
    """Keep bytes under their digest and give their path. Content that is there is compared; a damaged file is written again, under another name first."""
    name = hashlib.sha256(content).hexdigest()
    path = f"{root.rstrip('/')}/{name[:2]}/{name}"
    fs, java = _fs(spark, path)
    if fs.exists(java(path)):
        stream = fs.open(java(path))
        try:
            if bytes(stream.readAllBytes()) == content:
                return path
        finally:
            stream.close()
        fs.delete(java(path), False)
    out = fs.create(java(f"{path}.new"), True)
    out.write(bytearray(content))
    out.close()
    fs.rename(java(f"{path}.new"), java(path))
    return path


def write_receipt(spark: SparkSession, path: str, receipt: dict) -> None:
    """A receipt as JSON, whole or not at all."""
    write_small(spark, path, json.dumps(receipt, ensure_ascii=False, sort_keys=True, indent=1))


class RunLog:
    """Runs by source, each a small file: running, then ok, partial, error, or interrupted if it never said how it ended."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _write(self, run: dict) -> dict:
        write_receipt(self.spark, f"{self.root}/{run['run']}.json", run)
        return run

    def start(self, source: str, at: str | None = None) -> dict:
        """A new run; an earlier one of the source that still runs was interrupted."""
        at = at or datetime.now(timezone.utc).isoformat()
        for r in self.runs().where((F.col("source") == source) & (F.col("state") == RUNNING)).collect():  # at most one
            self._write(r.asDict() | {"state": INTERRUPTED, "finished": at})
        return self._write({"run": hashlib.sha256(f"{source} {at}".encode()).hexdigest()[:16], "source": source, "state": RUNNING, "started": at, "finished": None, "done": 0, "failed": 0, "problem": None})

    def finish(self, run: dict, done: int, failed: int = 0, problem: str | None = None, at: str | None = None) -> dict:
        """End a run: ok, partial where some resources failed, error where none was done."""
        state = ERROR if problem or (failed and not done) else PARTIAL if failed else OK
        return self._write(run | {"state": state, "finished": at or datetime.now(timezone.utc).isoformat(), "done": done, "failed": failed, "problem": problem})

    def each(self, source: str, resources: list[str], work, fatal: tuple[type[Exception], ...] = ()) -> dict:
        """Work on each resource: one that fails marks itself and the run goes on, except after a ``fatal`` error."""
        run, done, failed, problem = self.start(source), 0, 0, None
        for r in resources:
            try:
                work(r)
                done += 1
            except fatal as x:
                problem = f"{r}: {x}"
                break
            except Exception as x:  # the resource's own failure
                failed += 1
                write_receipt(self.spark, f"{self.root}/failures/{run['run']}-{hashlib.sha256(r.encode()).hexdigest()[:12]}.json", {"run": run["run"], "resource": r, "problem": str(x)})
        return self.finish(run, done, failed, problem)

    def runs(self) -> DataFrame:
        """All runs."""
        fs, java = _fs(self.spark, self.root)
        schema = "run string, source string, state string, started string, finished string, done long, failed long, problem string"
        if not fs.exists(java(self.root)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(self.root)


def read_package(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, problems) of JSON packages of precedents: a record lacks nothing that identifies it, its content has its hash, and its id is in the package once."""
    rows = spark.read.schema(PACKAGE + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("source", F.input_file_name()).cache()
    needed = [c for c in ("id", "tribunal", "species", "numero", "hash", "body")]
    reason = F.when(F.col("_bad").isNotNull(), "illegible")
    for c in needed:
        reason = reason.when(F.coalesce(F.trim(c), F.lit("")) == "", f"no_{c}")
    reason = reason.when(F.sha2("body", 256) != F.col("hash"), "hash_differs").when(F.col("publication").isNotNull() & F.try_to_date("publication", "yyyy-MM-dd").isNull(), "illegible_date")
    told = rows.withColumn("reason", reason)
    twice = told.where("reason is null").groupBy("source", "id").agg(F.count("*").alias("n")).where("n > 1").select("source", "id", F.lit("repeated_id").alias("again"))
    told = told.join(twice, ["source", "id"], "left").withColumn("reason", F.coalesce("reason", "again"))
    return told.where("reason is null").select("id", "tribunal", "species", "numero", "organ", F.to_date("publication").alias("publication"), "hash", "body"), told.where("reason is not null").select("source", "id", "reason")


def _copy(spark: SparkSession, a: str, b: str) -> None:
    fs_a, java = _fs(spark, a)
    fs_b, _ = _fs(spark, b)
    fs_b.delete(java(b), True)
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs_a, java(a), fs_b, java(b), False, spark._jsc.hadoopConfiguration()):
        raise EngineError("publicacao_invalida", f"{a} could not be copied.")


def backup(spark: SparkSession, root: str, depot: str, name: str) -> dict:
    """Copy the newest generation to a depot shared by all backups: a table of a known digest is there already. The backup's list is written last."""
    held = manifest(spark, root)
    if not held:
        raise EngineError("base_nao_inicializada", "There is nothing to back up.")
    fs, java = _fs(spark, depot)
    newest, tables = held[0], {}
    for t, d in newest["tables"].items():
        place = f"{t}-{d['rows']}-{d['digest'] % 2**64:016x}"
        if not fs.exists(java(f"{depot}/tables/{place}")):
            _copy(spark, f"{root}/{newest['id']}/{t}", f"{depot}/tables/.{place}")
            fs.rename(java(f"{depot}/tables/.{place}"), java(f"{depot}/tables/{place}"))
        tables[t] = place
    listed = {"name": name, "generation": newest, "tables": tables}
    write_receipt(spark, f"{depot}/backups/{name}.json", listed)
    return listed


def restore(spark: SparkSession, depot: str, name: str, root: str) -> str:
    """Put a backup's generation in place as the only one of ``root``, verified."""
    held = read_small(spark, f"{depot}/backups/{name}.json")
    if held is None:
        raise EngineError("publicacao_expirada", "There is no such backup.")
    listed = json.loads(held)
    generation = listed["generation"]
    for t, place in listed["tables"].items():
        _copy(spark, f"{depot}/tables/{place}", f"{root}/{generation['id']}/{t}")
    return _point(spark, root, generation)


def install(spark: SparkSession, release: str, root: str, name: str | None = None) -> str:
    """Copy a generation of a release folder into a reader's folder, verify it, and point the reader to it; the one before stays until then."""
    chosen = next((g for g in manifest(spark, release) if name in (None, g["id"])), None)
    if chosen is None:
        raise EngineError("publicacao_expirada", "The release has no such generation.")
    if any(g["id"] == chosen["id"] for g in manifest(spark, root)):
        return chosen["id"]
    _copy(spark, f"{release}/{chosen['id']}", f"{root}/{chosen['id']}")
    return _point(spark, root, chosen)


def _point(spark: SparkSession, root: str, generation: dict) -> str:
    before = read_small(spark, f"{root}/{MANIFEST}")
    write_small(spark, f"{root}/{MANIFEST}", json.dumps([generation, *[g for g in json.loads(before or "[]") if g["id"] != generation["id"]]], sort_keys=True))
    if wrong := verify(spark, root, generation["id"]):
        if before:
            write_small(spark, f"{root}/{MANIFEST}", before)
        raise EngineError("publicacao_invalida", f"{', '.join(wrong)}: not as published.")
    return generation["id"]


def prune_depot(spark: SparkSession, depot: str, keep: list[str]) -> list[str]:
    """Delete the backups not kept and the tables that no kept one lists; the places deleted."""
    fs, java = _fs(spark, depot)
    names = lambda folder: [s.getPath().getName() for s in fs.listStatus(java(f"{depot}/{folder}"))] if fs.exists(java(f"{depot}/{folder}")) else []
    used = {p for n in keep if (held := read_small(spark, f"{depot}/backups/{n}.json")) for p in json.loads(held)["tables"].values()}
    gone = [f"backups/{n}" for n in names("backups") if n.endswith(".json") and n[:-5] not in keep] + [f"tables/{t}" for t in names("tables") if t not in used]
    for g in gone:
        fs.delete(java(f"{depot}/{g}"), True)
    return sorted(gone)
