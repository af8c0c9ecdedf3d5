"""What changed between consecutive full snapshots, by invertible Bloom lookup tables.

A snapshot is a set of (key, hash) entries. Each hash bucket of a snapshot is
added to a small table of cells; the table of the later snapshot minus that of
the earlier one holds only the entries in which they differ, and these are peeled
out of it. Unchanged records, nearly all of a snapshot, cost three cell updates each
and are never matched with their earlier selves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autuario.runtime import cut, partitions

#: Cells an entry is added to.
HASHES = 3
#: Differing entries expected per entry of the larger snapshot, at first; a bucket where there are more fails and is enlarged.
FIRST_SHARE = 0.35
#: Cells per differing entry: peeling with three hashes succeeds with high probability above 1.23.
SPARE = 1.4
#: Least cells of a bucket.
LEAST_CELLS = 15

_PEELED = "pair long, bucket int, cells int, kh long, vh long, sign int, failed boolean"


# The constants of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _xxhash(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of 64-bit integers, as Spark's ``xxhash64`` has it."""
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = seed + _P5 + np.uint64(8)
    h = h ^ (turn(value * _P2, 31) * _P1)
    h = turn(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _check(kh: np.ndarray, vh: np.ndarray) -> np.ndarray:
    return _xxhash(vh, _xxhash(kh, np.full(len(kh), 42, np.uint64)))


def _slot(check: np.ndarray, third: int, size: np.ndarray) -> np.ndarray:
    """The cell of an entry in each third, from its check."""
    return np.mod(_xxhash(np.full(len(check), third, np.uint64), check).view(np.int64), size)


def _peel(cell: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Peel the tables of whole buckets at once.

    ``cell`` has the non-empty cells, sorted by group (0, 1, ...): group, position
    in the group's third, third, number of cells in a third, count, and the
    exclusive or of key hashes, value hashes and checks. Gives the recovered entries (group, kh, vh,
    sign) and the groups that could not be emptied.
    """
    group, width = cell["group"], cell["width"]
    n_groups = int(group[-1]) + 1
    first = np.searchsorted(group, np.arange(n_groups))
    size = width[first].astype(np.int64)
    start = np.concatenate([[0], np.cumsum(size * HASHES)])
    at = start[group] + cell["third"].astype(np.int64) * size[group] + cell["slot"].astype(np.int64)
    total = int(start[-1])
    count = np.zeros(total, np.int64)
    sums = np.zeros((3, total), np.uint64)
    count[at] = cell["count"]
    for i, name in enumerate(("kh", "vh", "check")):
        sums[i, at] = cell[name]
    owner = np.repeat(np.arange(n_groups), size * HASHES)
    out: list[tuple[np.ndarray, ...]] = []
    look = at
    for _ in range(200):
        look = look[np.abs(count[look]) == 1]
        s = count[look]
        kh, vh, ck = sums[:, look]
        pure = _check(kh, vh) == ck
        look, s, kh, vh, ck = look[pure], s[pure], kh[pure], vh[pure], ck[pure]
        if not len(look):
            break
        g = owner[look]
        _, once = np.unique(np.stack([g.astype(np.uint64), kh, vh, (s > 0).astype(np.uint64)]), axis=1, return_index=True)
        g, s, kh, vh, ck = g[once], s[once], kh[once], vh[once], ck[once]
        out.append((g, kh, vh, s))
        places = []
        for third in range(HASHES):
            p = start[g] + third * size[g] + _slot(ck, third, size[g])
            np.subtract.at(count, p, s)
            for i, v in enumerate((kh, vh, ck)):
                np.bitwise_xor.at(sums[i], p, v)
            places.append(p)
        look = np.unique(np.concatenate(places))
    left = (count != 0) | (sums != 0).any(axis=0)
    failed = np.unique(owner[left])
    if not out:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), none, none, np.zeros(0, np.int64), failed
    return (*(np.concatenate(x) for x in zip(*out)), failed)


def _peel_batches(batches: Iterator[pa.RecordBatch], rows: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Peel sorted cells, in pieces that end where a bucket ends."""

    def done(t: pa.Table) -> pa.RecordBatch:
        c = {n: t.column(n).to_numpy() for n in t.column_names}
        change = np.ones(len(t), bool)
        change[1:] = (c["pair"][1:] != c["pair"][:-1]) | (c["bucket"][1:] != c["bucket"][:-1])
        group = np.cumsum(change) - 1
        heads = np.flatnonzero(change)
        g, kh, vh, s, failed = _peel(
            {"group": group, "width": c["width"], "third": c["third"], "slot": c["slot"], "count": c["n"]}
            | {k: c[k].astype(np.int64).view(np.uint64) for k in ("kh", "vh", "check")}
        )
        good = ~np.isin(g, failed)
        g, kh, vh, s = g[good], kh[good], vh[good], s[good]
        of = np.concatenate([g, failed]).astype(np.int64)
        pad = np.zeros(len(failed), np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(c["pair"][heads][of]), pa.array(c["bucket"][heads][of].astype(np.int32)),
                pa.array(c["width"][heads][of].astype(np.int32)),
                pa.array(np.concatenate([kh.view(np.int64), pad])), pa.array(np.concatenate([vh.view(np.int64), pad])),
                pa.array(np.concatenate([s, pad]).astype(np.int32)), pa.array(np.concatenate([np.zeros(len(g), bool), np.ones(len(failed), bool)])),
            ],
            names=["pair", "bucket", "cells", "kh", "vh", "sign", "failed"],
        )

    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            p, k = t.column("pair").to_numpy(), t.column("bucket").to_numpy()
            last = np.flatnonzero((p != p[-1]) | (k != k[-1]))
            if len(last):
                yield done(t.slice(0, last[-1] + 1))
                t = t.slice(last[-1] + 1)
            held, n = t.to_batches(), len(t)
    if n:
        yield done(pa.Table.from_batches(held).combine_chunks())


def snapshot_changes(entries: DataFrame, steps: DataFrame, max_rounds: int = 24) -> DataFrame:
    """Added, removed and changed keys from each snapshot to the next.

    ``entries``: ``snapshot string, key string, hash string``, the records of all
    snapshots. ``steps``: ``pair long, prev string, next string``, the snapshots to
    compare, where a snapshot is at most once ``prev`` and at most once ``next``.
    Result: ``pair, next, key, change``.

    Rows with a null snapshot or key don't count; a null hash is a value of its own;
    repeated rows count once, and of several hashes of one key in one snapshot the
    one of least digest stands. Snapshots without entries are empty. One shuffle, by hash
    bucket of the key, serves the removal of repeats, the tables and the peeling;
    buckets are even however large one snapshot is. A bucket whose table is too
    small for its differences is built again with twice the cells. Recovered
    entries are looked up among the records by hash, and the digest of the records found must equal
    that of the recovered entries; otherwise the
    operator stops instead of giving a wrong result.
    """
    spark = entries.sparkSession
    clean = entries.select("snapshot", "key", "hash").where("snapshot is not null and key is not null")
    sizes = cut(clean.groupBy("snapshot").agg(F.count("*").alias("n")), "snapshot-sizes")
    pairs = cut(
        steps.join(sizes.select(F.col("snapshot").alias("prev"), F.col("n").alias("np")), "prev", "left")
        .join(sizes.select(F.col("snapshot").alias("next"), F.col("n").alias("nn")), "next", "left")
        .select("pair", "prev", "next", F.greatest(F.coalesce("np", F.lit(0)), F.coalesce("nn", F.lit(0))).alias("n")),
        "snapshot-pairs",
    )
    stat = sizes.agg(F.sum("n"), F.count("*"), F.max("n")).first()
    if not stat[0]:
        return spark.createDataFrame([], "pair long, next string, key string, change string")
    buckets = max(4 * partitions(spark), -(-int(stat[0]) // int(stat[1]) // 512))
    width = (F.ceil((F.col("n") / buckets * FIRST_SHARE * SPARE + LEAST_CELLS + F.sqrt(F.col("n") / buckets)) / HASHES)).cast("int")
    sides = pairs.select("pair", width.alias("width"), F.explode(F.array(F.struct(F.col("prev").alias("s"), F.lit(-1).alias("sign")), F.struct(F.col("next").alias("s"), F.lit(1).alias("sign")))).alias("x")).select(F.col("x.s").alias("snapshot"), "pair", "width", F.col("x.sign").alias("sign"))
    hashed = clean.select(
        "snapshot", "key", "hash",
        F.xxhash64("key", F.lit(11)).alias("kh"),
    ).withColumn("bucket", F.pmod("kh", F.lit(buckets)).cast("int"))
    value = F.xxhash64(F.col("hash").isNull(), "hash", "key", F.lit(12))
    single = (
        hashed.select("bucket", "snapshot", "kh", value.alias("vh"))
        .repartition("bucket")
        .groupBy("bucket", "snapshot", "kh").agg(F.min("vh").alias("vh"))
    )
    single = cut(single, "snapshot-entries")
    entry = single.join(F.broadcast(sides) if _small(sides) else sides, "snapshot").select("pair", "bucket", "width", "sign", "kh", "vh")

    def attempt(e: DataFrame, name: str) -> DataFrame:
        thirds = F.explode(F.array(*[F.lit(k).cast("long") for k in range(HASHES)]))
        here = e.repartition("bucket").withColumn("check", F.xxhash64("kh", "vh")).withColumn("third", thirds)
        cells = here.withColumn("slot", F.pmod(F.xxhash64("kh", "vh", "third"), F.col("width")).cast("int"))
        xors = [F.bit_xor(c).alias(c) for c in ("kh", "vh", "check")]
        summed = (
            cells.groupBy("pair", "bucket", "width", "third", "slot")
            .agg(F.sum("sign").alias("n"), *xors)
            .where("n <> 0 or kh <> 0 or vh <> 0 or check <> 0")
            .sortWithinPartitions("pair", "bucket")
        )
        return cut(summed.mapInArrow(_peel_batches, _PEELED), name)

    peeled, found = attempt(entry, "snapshot-peeled"), []
    for _ in range(max_rounds):
        found.append(peeled.where("not failed"))
        again = peeled.where("failed").select("pair", "bucket", F.col("cells").alias("_cells"))
        if again.isEmpty():
            break
        wider = entry.join(again, ["pair", "bucket"]).withColumn("width", (F.col("_cells") * 2).cast("int")).drop("_cells")
        peeled = attempt(wider.select("pair", "bucket", "width", "sign", "kh", "vh"), "snapshot-peeled")
    else:
        raise RuntimeError("buckets could not be peeled; the hash function does not separate their entries")
    recovered = found[0]
    for more in found[1:]:
        recovered = recovered.unionByName(more)
    by_key = recovered.groupBy("pair", "kh").agg(F.max("sign").alias("hi"), F.min("sign").alias("lo"), F.max_by("vh", "sign").alias("vh"))
    kinds = F.when((F.col("hi") == 1) & (F.col("lo") == -1), "changed").when(F.col("hi") == 1, "added").otherwise("removed")
    named = by_key.withColumn("change", kinds).join(_hinted(pairs.select("pair", "prev", "next")), "pair")
    lookup = named.withColumn("snapshot", F.when(F.col("change") == "removed", F.col("prev")).otherwise(F.col("next")))
    keys = hashed.select("snapshot", "kh", "key", value.alias("said"))
    result = lookup.join(keys, ["snapshot", "kh"]).groupBy("pair", "kh", "next", "key", "change").agg(F.min("said").alias("vh"))
    return _verified(cut(result, "snapshot-changes"), by_key).select("pair", "next", "key", "change")


def _verified(result: DataFrame, by_key: DataFrame) -> DataFrame:
    """Stop if the digests of the keys and values found among the records differ from those recovered."""
    digest = [F.count("*"), F.bit_xor(F.xxhash64("pair", "kh", "vh"))]
    have, want = result.agg(*digest).first(), by_key.agg(*digest).first()
    if tuple(have) != tuple(want):
        raise RuntimeError(f"recovered entries and records differ: {tuple(want)} and {tuple(have)}")
    return result


def _small(df: DataFrame, rows: int = 50_000) -> bool:
    """Whether a table of a few short columns is surely under a few MB."""
    return len(df.limit(rows + 1).select(F.lit(1)).collect()) <= rows


def _hinted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if _small(df) else df


def deliveries(resources: DataFrame) -> DataFrame:
    """Consecutive successful deliveries of each dataset: ``pair, prev, next``.

    Only status ``ok`` delivers; rank_key, then id, orders a dataset's deliveries.
    """
    from pyspark.sql import Window

    ok = resources.where((F.col("status") == "ok") & F.col("id").isNotNull()).select("dataset", "rank_key", "id").distinct()
    w = Window.partitionBy("dataset").orderBy("rank_key", "id")  # deliveries of one dataset: few
    return (
        ok.withColumn("prev", F.lag("id").over(w)).where("prev is not null")
        .select(F.xxhash64("prev", "id").alias("pair"), "prev", F.col("id").alias("next"))
    )
