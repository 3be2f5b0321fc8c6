"""Intermediate tables in a folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Intermediate tables of this process, by session; `clean` deletes them.
_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where that is unset, a session whose executors are threads of this process (local master, as in tests) gets a
    temporary folder that goes with the process; on a cluster it is an error, for no folder of one machine is shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lexmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/lexmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Deletes the intermediate tables that `written` has made so far, and says how many; results that read them must be stored before."""
    jvm, n = spark.sparkContext._jvm, 0
    while _made:
        p = jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return n


def input_bytes(df: DataFrame) -> int:
    """The size of the tables that df reads, as the planner estimates it; nothing is run."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if its tables are read in fewer than half of that: one small file isn't one task.

    A large table has more partitions already and isn't moved.
    """
    spark = df.sparkSession
    n, size = spark.sparkContext.defaultParallelism, input_bytes(df)
    most = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    least = int(spark._jsparkSession.sessionState().conf().filesOpenCostInBytes())
    return df.repartition(n) if size / min(most, max(least, size / n)) < n / 2 else df


def ranges(df: DataFrame, each: int = 64 << 20) -> int:
    """How many ranges to cut df into: as many as shuffle partitions, more where a range would exceed `each` bytes.

    Of the planner's estimates the smaller counts: that of the tables read or that of df itself. Rows from the driver's
    memory have none, and are few.
    """
    fixed = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = min(input_bytes(df), int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    return max(1, fixed, 0 if size > 1 << 60 else min(100_000, -(-size // each)))
