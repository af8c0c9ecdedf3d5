"""Duplicates hidden by formatting differences."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autuario.runtime import cut, partitions_for, spread

#: The labels of the two closing passages, as they stand in a key.
PROVISIONS = "dispositivosrelevantescitados"
PRECEDENTS = "jurisprudênciarelevantecitada"

_SCAN = "blk int, kind int, kept string, id string, first_key binary, last_key binary, last_kept string"


def copy_key(text: str | None) -> str | None:
    """What copies of a text have in common: its letters and digits in order, in lower case.

    Of the two closing passages, each from its label to the other or to the end, the
    one on provisions comes first. Null or without letter or digit: None.
    """
    bare = "".join(filter(str.isalnum, text.lower())) if text else ""
    end = bare.rfind(PROVISIONS)
    start = bare.rfind(PRECEDENTS, 0, end) if end >= 0 else -1
    if start >= 0:
        middle = bare.index(PROVISIONS, start)
        bare = bare[:start] + bare[middle:] + bare[start:middle]
    return bare or None


def copy_digest(text: str | None) -> bytes | None:
    """SHA-256 of the copy key."""
    key = copy_key(text)
    return None if key is None else sha256(key.encode("utf-8", "surrogatepass")).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = pa.array((copy_digest(t.as_py()) for t in b.column("text")), pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("id"), keys], names=["id", "key"]).filter(keys.is_valid())


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over a sorted block: each row against the one before.

    ``kind`` 0: a copy with the first id of its run; 1: a row of the block's first
    run, which may continue the block before; 2: the block's ends.
    """
    names = [f.split()[0] for f in _SCAN.split(", ")]
    blk = key = kept = head_key = head_kept = previous = None
    in_head = True
    for b in batches:
        if not b.num_rows:
            continue
        keys, ids = b.column("key"), b.column("id")
        blk = b.column("blk")[0].as_py()
        n = len(keys)
        same = pc.equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False).tolist()
        same.insert(0, keys[0].as_py() == key)
        out_kind, out_kept, out_id = [], [], []
        listed = ids.to_pylist()
        for i in range(n):
            if same[i]:
                if listed[i] != previous:
                    out_kind.append(1 if in_head else 0)
                    out_kept.append(kept)
                    out_id.append(listed[i])
            else:
                if key is not None:
                    in_head = False
                key, kept = keys[i].as_py(), listed[i]
                if in_head:
                    head_key, head_kept = key, kept
                    out_kind.append(1)
                    out_kept.append(kept)
                    out_id.append(kept)
            previous = listed[i]
        m = len(out_id)
        yield pa.RecordBatch.from_arrays(
            [pa.array([blk] * m, pa.int32()), pa.array(out_kind, pa.int32()), pa.array(out_kept, pa.string()), pa.array(out_id, pa.string()),
             pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.string())], names=names,
        )
    if key is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([blk], pa.int32()), pa.array([2], pa.int32()), pa.array([head_kept]), pa.nulls(1, pa.string()),
             pa.array([head_key], pa.binary()), pa.array([key], pa.binary()), pa.array([kept])], names=names,
        )


def copies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``kept_id, copy_id``: for each group of copies its smallest id, and each other id.

    The records' canonical forms are range-partitioned and externally sorted,
    together with the id, and one scan compares neighbours. A group of a third of
    all rows spans many blocks: a run that crosses from block to block is joined
    afterwards by the blocks' ends, one row per block. The sort key is the SHA-256
    of the whole canonical form, which stands for it in comparisons, so that a sort
    moves 50 bytes a record however long the texts are.

    Cases: rows with a null id, or whose text is null or has no letter or digit, are
    no copies; a row delivered twice counts once; an id with two texts may be a copy
    in two groups; an empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    texts = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null and text is not null")
    keyed = cut(spread(texts, "id").mapInArrow(_digests, "id string, key binary"), "copies-keys")
    blocks = keyed.repartitionByRange(partitions_for(keyed), "key", "id").sortWithinPartitions("key", "id")
    scanned = cut(blocks.select("key", "id", F.spark_partition_id().alias("blk")).mapInArrow(_scan, _SCAN), "copies-scan")
    carried, key, kept = [], None, None
    for r in sorted(scanned.where("kind = 2").collect(), key=lambda r: r.blk):  # one row per block
        if r.first_key == key:
            carried.append((r.blk, kept))
        if r.first_key != r.last_key or r.first_key != key:
            key, kept = (r.last_key, r.last_kept) if r.first_key != r.last_key else (r.first_key, r.kept)
    joined = spark.createDataFrame(carried, "blk int, _earlier string")
    rows = scanned.where("kind < 2").join(F.broadcast(joined), "blk", "left")
    return (
        rows.select(F.when(F.col("kind") == 1, F.coalesce("_earlier", "kept")).otherwise(F.col("kept")).alias("kept_id"), F.col("id").alias("copy_id"))
        .where("kept_id <> copy_id").distinct()
    )


def copy_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``kept_id, copies``: every record that remains, with the number of ids in its group."""
    pairs = copies(df, id_col, text_col)
    n = pairs.groupBy(F.col("kept_id").alias("id")).agg(F.count_distinct("copy_id").alias("n"))
    ids = df.select(F.col(f"`{id_col}`").cast("string").alias("id")).where("id is not null").distinct()
    gone = pairs.select(F.col("copy_id").alias("id")).distinct()
    return ids.join(gone, "id", "left_anti").join(n, "id", "left").select(F.col("id").alias("kept_id"), (F.coalesce("n", F.lit(0)) + 1).alias("copies"))
