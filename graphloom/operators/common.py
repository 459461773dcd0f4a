"""What the graph operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; where ``spark.checkpoint.dir`` is unset, a folder of this process on one machine, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def cut(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back, so that later plans start from the written table.

    A checkpoint would do, but it hands the optimizer's constraints on, which
    grow with every round of a loop.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def numbered(frame: DataFrame, *order, name: str = "n") -> DataFrame:
    """``frame`` with a dense number from 0 in the order of ``order``, without gathering all rows in one task.

    Rows are range-partitioned, numbered inside their partition, and shifted by
    the sizes of the partitions before; only those sizes (one row for each
    partition) meet.  ``order`` must be total for the numbers to be repeatable.
    """
    dealt = cut(frame.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_part", "_within", "_before")


#: Rows that a task holds in its hash tables and sorts, on average; small tables are dealt to all cores, but not in lots under ``LEAST``.
LOT, LEAST = 500_000, 100_000


def lots(spark: SparkSession, rows: int) -> int:
    """Into how many tasks ``rows`` are dealt; their number grows with the rows, whatever the number of shuffle partitions."""
    return max(1, -(-rows // LOT), min(spark.sparkContext.defaultParallelism, -(-rows // LEAST)))


def dealt(frame: DataFrame, n: int, *keys: str) -> DataFrame:
    """``frame`` in ``n`` tasks by a hash of ``keys``, with the task as ``_lot``.

    Joins and groups that have ``_lot`` among their keys stay in their task, and
    nothing makes larger tasks of these.
    """
    return frame.withColumn("_lot", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")).repartitionById(n, F.col("_lot"))


def counted(pairs: DataFrame, n: int) -> DataFrame:
    """``src, dst, w``: how often each pair is in ``pairs(_lot, src, dst)``, summed inside the lots first and then in ``n`` tasks."""
    inside = pairs.groupBy("_lot", "src", "dst").agg(F.count("*").alias("w"))
    return inside.repartition(n, "src", "dst").groupBy("src", "dst").agg(F.sum("w").cast("long").alias("w"))


#: Up to so many rows, the first rows of an order meet in one task.
FEW = 10_000


def first_n(frame: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` rows in the order of ``order``; many rows are found by a range partitioning, not in one task."""
    if n <= FEW:
        return frame.orderBy(*order).limit(max(0, n))
    return numbered(frame, *order, name="_n").where(F.col("_n") < n).drop("_n")
