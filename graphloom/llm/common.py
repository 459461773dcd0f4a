"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Runs of characters that are in no word, once A-Z are lower case: everything
#: below U+0080 but digits and a-z.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Where that is unset (tests on one machine) a folder of this process is set
    as the checkpoint folder once and reused.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    context = spark.sparkContext
    if not (folder := context.getCheckpointDir()):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back, so that later plans start from the written table.

    Unlike a checkpoint, the table doesn't hand on the optimizer's constraints,
    which grow with every round of a loop.
    """
    path = scratch(frame.sparkSession, "cut")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often it's used."""
    return F.transform(F.array(value), body)[0]


def constants(values: Iterable) -> Column:
    """An array of numbers, texts or named tuples, given to Spark as one piece of SQL: a call for each value would take seconds for a few hundred."""

    def sql(x) -> str:
        if isinstance(x, tuple):
            return "named_struct(" + ", ".join(f"'{k}', {sql(v)}" for k, v in x._asdict().items()) + ")"
        if isinstance(x, str):
            return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{float(x)!r}D" if isinstance(x, float) else str(x)

    return F.expr(f"array({', '.join(map(sql, values))})")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def spaced_words(text: Column) -> Column:
    """The words of ``text`` joined by one space; null and wordless texts give ''."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS, " "))


def small_batches(spark: SparkSession) -> None:
    """Keep what a Python worker holds at once to a few MB, also for very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
