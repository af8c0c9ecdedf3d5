"""References to records that do not exist, kept as incremental state."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from autuario.operators.skew import semi_join_counted
from autuario.runtime import checkpoint_root, kept, partitions_for, read_small, write_small

KEY = "ref_key"
INDEX_SCHEMA = f"{KEY} string"
_STATE = f"bucket int, {KEY} string, n long, held boolean, moved string"


@dataclass(frozen=True)
class OrphanLedger:
    """Keyed state of references whose target is missing, in versions in a shared folder.

    The state has one row for each key that is a parent's or that something refers to:
    how many references it has (``n``) and whether its parent is there (``held``). It
    lies in buckets by hash of the key. A step reads and rewrites the buckets of the
    keys it brings and leaves all others as they are: new references probe the keys
    there, arriving parents resolve the references that wait, deleted parents reopen
    what they settled; ``moved`` says of each such key what happened in the last step that
    touched it. The references themselves are written once, as they come, and are told
    apart by their keys when they are read. Each version's manifest is written last,
    so a step that was lost leaves no trace, and a stream goes on from it.

    References need a string column ``ref_key``; all other columns are carried along.
    A null key refers to nothing and is neither pending nor settled. Equal rows are
    one reference. Empty inputs are allowed everywhere.
    """

    spark: SparkSession
    folder: str
    schema: StructType
    buckets: int
    version: int = 0
    places: dict[int, str] = field(default_factory=dict)
    parts: tuple[str, ...] = ()
    tag: str | None = None

    @staticmethod
    def empty(spark: SparkSession, refs_like: DataFrame, folder: str | None = None, buckets: int | None = None) -> "OrphanLedger":
        """A ledger without keys, in a folder of its own unless one is given; a folder's last version if it has any."""
        if folder is None:
            folder = f"{checkpoint_root(spark).rstrip('/')}/orphans-{uuid.uuid4().hex}"
            kept(spark, folder)
        new = OrphanLedger(spark, folder, refs_like.schema, buckets or partitions_for(refs_like))
        return new.at() or new

    def _manifest(self, version: int) -> str:
        return f"{self.folder}/manifests/{version:09d}.json"

    def at(self, version: int | None = None) -> "OrphanLedger | None":
        """The ledger as of a version (default: the last one written), None where there is none."""
        if version is None:
            last = read_small(self.spark, f"{self.folder}/last.json")
            if last is None:
                return None
            version = json.loads(last)
            while read_small(self.spark, self._manifest(version + 1)) is not None:  # the manifest was written, the pointer not
                version += 1
        held = read_small(self.spark, self._manifest(version))
        if held is None:
            return None
        m = json.loads(held)
        return replace(self, buckets=m["buckets"], version=version, places={int(b): p for b, p in m["places"].items()}, parts=tuple(m["parts"]), tag=m["tag"])

    @staticmethod
    def first(refs: DataFrame, parents: DataFrame) -> "OrphanLedger":
        """The ledger after a first load: all parents and all references in one step."""
        return OrphanLedger.empty(refs.sparkSession, refs).step(refs, parents)

    def step(self, refs: DataFrame | None = None, arrived: DataFrame | None = None, deleted: DataFrame | None = None, tag: str | None = None) -> "OrphanLedger":
        """The next version: deletions first, then arrivals, then new references. ``tag`` names the step, for a stream to know it by."""
        version = self.version + 1
        parts = self.parts
        changes = []
        change = lambda df, n, came, went: df.where(f"{KEY} is not null").select(KEY, F.lit(n).cast("long").alias("n"), F.lit(came).alias("came"), F.lit(went).alias("went"))
        if refs is not None:
            part = f"{self.folder}/references/{version:09d}"
            refs.select(*self.schema.names).write.mode("overwrite").parquet(part)
            parts = (*parts, part)
            changes.append(change(self.spark.read.schema(self.schema).parquet(part), 1, False, False))
        changes += [change(df, 0, came, not came) for df, came in ((arrived, True), (deleted, False)) if df is not None]
        if not changes:
            return self
        brought = changes[0]
        for more in changes[1:]:
            brought = brought.unionByName(more)
        bucket = F.pmod(F.xxhash64(KEY), F.lit(self.buckets)).cast("int").alias("bucket")
        summed = brought.groupBy(KEY).agg(F.sum("n").alias("n"), F.max("came").alias("came"), F.max("went").alias("went")).select(bucket, KEY, "n", "came", "went")
        place = f"{self.folder}/state/{version:09d}"
        summed.write.mode("overwrite").parquet(f"{place}-keys")
        summed = self.spark.read.schema(f"bucket int, {KEY} string, n long, came boolean, went boolean").parquet(f"{place}-keys")
        touched = sorted(r[0] for r in summed.select("bucket").distinct().collect())  # at most one row for each bucket
        before = self._state([b for b in touched if b in self.places])
        none, no = F.lit(None).cast("boolean"), F.lit(False)
        both = before.select("bucket", KEY, "n", "held", F.lit(0).alias("more"), no.alias("came"), no.alias("went")).unionByName(
            summed.select("bucket", KEY, F.lit(0).alias("n"), none.alias("held"), F.col("n").alias("more"), "came", "went")
        )
        merged = both.repartition(max(1, len(touched)), "bucket").groupBy("bucket", KEY).agg(
            F.sum("n").alias("n"), F.coalesce(F.max("held"), no).alias("held"), F.sum("more").alias("more"), F.max("came").alias("came"), F.max("went").alias("went"))
        now = F.col("came") | (F.col("held") & ~F.col("went"))
        moved = F.when((F.col("n") > 0) & ~F.col("held") & now, "resolved").when((F.col("n") > 0) & F.col("held") & ~now, "reopened").when((F.col("more") > 0) & ~now, "waits")
        after = merged.select("bucket", KEY, (F.col("n") + F.col("more")).alias("n"), now.alias("held"), moved.alias("moved")).where("n > 0 or held")
        after.write.mode("overwrite").partitionBy("bucket").parquet(place)
        places = {b: p for b, p in self.places.items() if b not in set(touched)} | {b: f"{place}/bucket={b}" for b in touched}
        write_small(self.spark, self._manifest(version), json.dumps({"buckets": self.buckets, "places": places, "parts": parts, "tag": tag}))
        write_small(self.spark, f"{self.folder}/last.json", json.dumps(version))
        return replace(self, version=version, places=places, parts=parts, tag=tag)

    def _state(self, buckets: list[int]) -> DataFrame:
        """The rows of some buckets."""
        frames = []
        by_folder: dict[str, list[int]] = {}
        for b in buckets:
            by_folder.setdefault(self.places[b].rpartition("/")[0], []).append(b)
        for place, own in by_folder.items():  # a folder of a version is read once, by partition
            frames.append(self.spark.read.schema(f"{KEY} string, n long, held boolean, moved string, bucket int").parquet(place).where(F.col("bucket").isin(own)))
        out = self.spark.createDataFrame([], _STATE)
        for f in frames:
            out = out.unionByName(f)
        return out

    @property
    def keys(self) -> DataFrame:
        """``bucket, ref_key, n, held, moved``: the whole state."""
        return self._state(sorted(self.places))

    @property
    def index(self) -> DataFrame:
        """The keys that have a parent."""
        return self.keys.where("held").select(KEY)

    def _references(self, held: bool) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], self.schema)
        refs = self.spark.read.schema(self.schema).parquet(*self.parts)
        wanted = self.keys.where((F.col("held") == held) & (F.col("n") > 0)).select(KEY, "n")
        total = self.keys.agg(F.sum("n")).first()[0] or 0
        return semi_join_counted(refs, wanted, KEY, total).select(*self.schema.names).distinct()

    @property
    def pending(self) -> DataFrame:
        """The references that wait for their parent; those of a hot key are matched where they are."""
        return self._references(False)

    @property
    def settled(self) -> DataFrame:
        """The references whose parent is there."""
        return self._references(True)

    def counts(self, *by: str) -> DataFrame:
        """The number of pending references, by the given columns."""
        return self.pending.groupBy(*by).agg(F.count("*").alias("orphans"))

    def snapshot(self, *by: str) -> "OrphanLedger":
        """Keep the counts of this version for ``snapshots``."""
        self.counts(*by).withColumn("version", F.lit(self.version)).write.mode("overwrite").parquet(f"{self.folder}/counts/{self.version:09d}")
        return self

    def snapshots(self, *versions: int) -> DataFrame:
        """The counts kept of the given versions, one below the other."""
        return self.spark.read.parquet(*[f"{self.folder}/counts/{v:09d}" for v in versions])


def court_key(chave: str) -> F.Column:
    """A citation key of court STJ or TJSC in comparable form, else null.

    Letters compare without case, the number by its digits only.
    """
    part = F.split(F.upper(F.col(chave)), ":")
    court, number = F.trim(part[0]), F.regexp_replace(F.element_at(part, -1), r"[^0-9]", "")
    middle = F.trim(F.array_join(F.slice(part, 2, F.greatest(F.size(part) - 2, F.lit(0))), ":"))
    return (
        F.when((court == "STJ") & (F.size(part) >= 2), F.concat(F.lit("STJ:"), middle, F.lit(":"), number))
        .when((court == "TJSC") & (F.size(part) >= 2), F.concat(F.lit("TJSC:"), number))
    )


def document_key(tribunal: str, classe: str, process: str) -> F.Column:
    """The citation key of a document, null where it has none."""
    digits = F.regexp_replace(F.col(process), r"[^0-9]", "")
    return (
        F.when(F.col(tribunal) == "STJ", F.concat(F.lit("STJ:"), F.trim(F.upper(F.col(classe))), F.lit(":"), digits))
        .when(F.col(tribunal) == "TJSC", F.concat(F.lit("TJSC:"), digits))
    )


def corpus_references(citations: DataFrame, links: DataFrame) -> DataFrame:
    """All references of the corpus: ``source_table, source_field, document_id, ord, missing_ref, ref_key``.

    The key's first part names what it must meet: ``e`` any entity, ``p`` a
    precedent's id, ``k`` a document's citation key, ``d`` a document's id.
    References that are no cases (keys of other courts, empty keys, provisions)
    have no row.
    """
    norm = court_key("chave")
    chave_key = (
        F.when((F.col("tipo") == "precedente") & (F.col("chave") != ""), F.concat(F.lit("p|"), F.col("chave")))
        .when(F.col("tipo").isin("acordao", "similar") & (F.col("chave") != "") & norm.isNotNull(), F.concat(F.lit("k|"), norm))
    )
    made = citations.select(
        "document_id",
        F.col("ord").cast("int").alias("ord"),
        F.explode(
            F.array(
                F.struct(F.lit("resolvido").alias("f"), F.col("resolvido").alias("r"), F.concat(F.lit("e|"), F.col("resolvido")).alias("k")),
                F.struct(F.lit("chave").alias("f"), F.col("chave").alias("r"), chave_key.alias("k")),
            )
        ).alias("x"),
    ).where("x.k is not null")
    from_citations = made.select(
        F.lit("document_citations").alias("source_table"), F.col("x.f").alias("source_field"), "document_id", "ord",
        F.col("x.r").alias("missing_ref"), F.col("x.k").alias(KEY),
    )
    from_links = links.where("cited_id is not null").select(
        F.lit("citation_links").alias("source_table"), F.lit("cited_id").alias("source_field"), "document_id",
        F.lit(-1).alias("ord"), F.col("cited_id").alias("missing_ref"), F.concat(F.lit("d|"), F.col("cited_id")).alias(KEY),
    )
    return from_citations.unionByName(from_links)


def corpus_parents(documents: DataFrame, precedents: DataFrame) -> DataFrame:
    """The keys under which documents and precedents can be referred to."""
    key = document_key("tribunal", "classe", "process")
    of_documents = documents.select(
        F.explode(F.array(F.concat(F.lit("d|"), F.col("id")), F.concat(F.lit("e|"), F.col("id")), F.concat(F.lit("k|"), key))).alias(KEY)
    )
    of_precedents = precedents.select(F.explode(F.array(F.concat(F.lit("p|"), F.col("id")), F.concat(F.lit("e|"), F.col("id")))).alias(KEY))
    return of_documents.unionByName(of_precedents).where(f"{KEY} is not null")
