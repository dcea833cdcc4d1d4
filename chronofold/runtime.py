"""Session helpers: the shared folder, lineage cuts and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Rows of a side that may be broadcast.  The sides it is used on hold a few
# short columns, so this is some tens of megabytes at the very most.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="chronofold-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/chronofold-{app}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends here
    and a lost executor costs one re-read, not a re-run of the loop."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when df has at most `rows` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast df when a count proves it small, else leave the join to
    shuffle (with adaptive skew splitting)."""
    return F.broadcast(df) if small_enough(df, rows) else df


def broadcast_or_merge(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast df when a count proves it small, else have the join sort and merge.  For narrow tables of many rows: their few
    bytes in files would otherwise have Spark broadcast them, and every row pass through the driver."""
    return F.broadcast(df) if small_enough(df, rows) else df.hint("merge")


def keep_if(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on costly columns without computing them again.

    A plain filter is pushed below the projections that make the columns, which
    repeats their expressions (over a chain of columns, many times over).  A
    generator is not pushed down, so each column is made once.
    """
    return df.select("*", F.explode(F.when(condition, F.array(F.lit(True)))).alias("__keep")).drop("__keep")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when the input has fewer splits than there are cores, as a
    single small file does; large inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Work:
    """Intermediate tables of one operator in the shared folder.

    `cut` writes a table and reads it back; `drop` deletes tables that no later
    step reads.  What the returned plan still reads stays.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.label = spark, label
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, f"{self.label}-{name}")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self._paths.pop(id(t), (None, None))
            if path:
                remove_path(self.spark, path)
