"""Global order without a global task.

``ordered`` range-partitions and sorts externally; every row gets its position in
the whole order. A key that holds a third of all rows is spread over many
partitions, since the range bounds are taken from all sort columns together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autuario.runtime import cut, partitions_for

BLOCK, POSITION = "_blk", "_pos"


def ordered(df: DataFrame, keys: list[str], name: str = "ordered") -> DataFrame:
    """Add ``_blk`` (partition of the order) and ``_pos`` (0-based global position).

    Rows with equal keys get positions in an unspecified order among themselves.
    Nulls sort first. An empty table stays empty. The number of blocks follows
    the bytes read, and is ``spark.sql.shuffle.partitions`` at least; only one row count per block reaches the driver.
    """
    spark = df.sparkSession
    sort = df.repartitionByRange(partitions_for(df), *keys).sortWithinPartitions(*keys)
    held = cut(
        sort.withColumn(BLOCK, F.spark_partition_id()).withColumn(
            "_off", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
        ),
        name,
    )
    counts = sorted((r[BLOCK], r["n"]) for r in held.groupBy(BLOCK).agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for block, n in counts:
        starts.append((block, at))
        at += n
    offsets = spark.createDataFrame(starts, f"{BLOCK} int, _start long")
    return (
        held.join(F.broadcast(offsets), BLOCK)  # one row per block
        .withColumn(POSITION, F.col("_start") + F.col("_off"))
        .drop("_start", "_off")
    )


def lead_within(df: DataFrame, entity: str, value: str, out: str) -> DataFrame:
    """``out``: the next row's ``value`` in ``_pos`` order if it is of the same ``entity``.

    The window runs inside the blocks of ``ordered``, so no entity is gathered in
    one task; the last row of a block looks up the first row of the next block that
    has any (one row per block, collected).
    """
    spark = df.sparkSession
    first = (
        df.groupBy(BLOCK).agg(F.min_by(F.struct(F.col(entity).alias("e"), F.col(value).alias("v")), POSITION).alias("f"))
    )
    heads = sorted(((r[BLOCK], r["f"]["e"], r["f"]["v"]) for r in first.collect()), key=lambda x: x[0])
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    after = spark.createDataFrame(
        [(heads[i][0], heads[i + 1][1], heads[i + 1][2]) for i in range(len(heads) - 1)],
        f"{BLOCK} int, _ne {kinds[entity]}, _nv {kinds[value]}",
    )
    w = Window.partitionBy(BLOCK).orderBy(POSITION)
    inside: Column = F.lead(F.struct(F.col(entity).alias("e"), F.col(value).alias("v"))).over(w)
    return (
        df.withColumn("_next", inside)
        .join(F.broadcast(after), BLOCK, "left")
        .withColumn("_next", F.coalesce("_next", F.when(F.col("_ne").isNotNull(), F.struct(F.col("_ne").alias("e"), F.col("_nv").alias("v")))))
        .withColumn(out, F.when(F.col("_next.e").eqNullSafe(F.col(entity)), F.col("_next.v")))
        .drop("_next", "_ne", "_nv")
    )
