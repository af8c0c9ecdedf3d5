"""Where tables are read from and where intermediate tables are cut.

Intermediate tables are written to the folder all executors share
(``spark.checkpoint.dir``), so that a lost executor never costs more than the
stage that was running. No operator keeps data on one machine only.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_TABLES: list[tuple[SparkSession, str]] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and the
    master is local a temporary folder is made and set, because then there is one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="autuario-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Unlike ``checkpoint()`` the table is compressed and columnar, so later reads
    prune columns. The table lives until ``drop_tables``, at the latest until the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, path: str) -> None:
    """Let ``drop_tables`` delete a folder, too."""
    _TABLES.append((spark, path))


def is_kept(path: str) -> bool:
    """Whether a folder given to ``kept`` is still there."""
    return any(p == path for _, p in _TABLES)


@atexit.register
def drop_tables(*but: str) -> None:
    """Delete every table ``cut`` has written and that no result reads any more, but for the folders named."""
    gone = [(s, p) for s, p in _TABLES if p not in but]
    _TABLES[:] = [(s, p) for s, p in _TABLES if p in but]
    for spark, path in gone:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session is gone: the folder's owner clears it
            pass


def read_small(spark: SparkSession, path: str) -> str | None:
    """The text of a small file in the shared folder, None where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole: under another name first, then in place of the one before."""
    java = spark._jvm.org.apache.hadoop.fs
    at, temporary = java.Path(path), java.Path(f"{path}.new")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = java.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    modes = spark.sparkContext._gateway.new_array(java.Options.Rename, 1)
    modes[0] = java.Options.Rename.OVERWRITE
    context.rename(temporary, at, modes)


#: A table up to this size that is read in a few splits is dealt to all cores before costly work on its texts.
SMALL_TABLE = 32 * 1024 * 1024


def spread(df: DataFrame, key: str) -> DataFrame:
    """A small table of few splits, dealt by ``key`` to all cores; any other as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if size_of(df) > SMALL_TABLE or df.rdd.getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores, key)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of the tables read that one task sorts.
TASK_BYTES = 64 * 1024 * 1024
#: Sizes from here on stand for an unknown one.
UNKNOWN_SIZE = 1 << 60


def size_of(df: DataFrame) -> int:
    """The optimizer's estimate of a table's bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame) -> int:
    """How many tasks should sort a table: the session's number, or more if the tables it is
    made from hold over ``TASK_BYTES`` for each. Tables of unknown size don't count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(partitions(df.sparkSession), -(-sum(x for x in sizes if x < UNKNOWN_SIZE) // TASK_BYTES))
