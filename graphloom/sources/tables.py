"""Graphs derived from the relational tables, and a planted one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.randomness import uniform
from graphloom.operators.common import counted, dealt, lots
from graphloom.operators.graph import consecutive

CUSTOMERS = 1_000_000_000
#: Parts of an order up to which all its pairs are made at once; about ``LOT`` pairs.
SIDE = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to customer, one edge for each line of an order; customers' ids are shifted."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("order"), "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("order"), "o_custkey")
    n = lots(spark, max(lines.count(), orders.count()))
    joined = dealt(lines, n, "order").join(dealt(orders, n, "order"), ["_lot", "order"])
    return counted(joined.select("_lot", F.col("l_suppkey").alias("src"), (F.col("o_custkey") + CUSTOMERS).alias("dst")), n)


def trade_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v, b``: the nation of each supplier and customer."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    return s.select(F.col("s_suppkey").alias("v"), F.col("s_nationkey").cast("long").alias("b")).unionByName(c.select((F.col("c_custkey") + CUSTOMERS).alias("v"), F.col("c_nationkey").cast("long").alias("b")))


def trade_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v, t``: the region of each supplier and customer."""
    region = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("b"), F.col("n_regionkey").cast("long").alias("t"))
    return trade_nations(spark, sf_dir).join(region, "b").select("v", "t")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier's nation to customer's nation, one edge for each line of an order."""
    from graphloom.operators.blockmodel import block_matrix

    return block_matrix(trade(spark, sf_dir), trade_nations(spark, sf_dir)).toDF("src", "dst", "w")


def nation_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v, b``: the region of each nation."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("v"), F.col("n_regionkey").cast("long").alias("b"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user to the next user of the same type of event, in the order of time and id."""
    events = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "user_id")
    return consecutive(events, "event_type", ["ts", "event_id"], "user_id").groupBy("src", "dst").agg(F.count("*").alias("w"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share an order, the smaller first, by the number of orders.

    Orders are dealt to tasks by the number of their pairs.  Where one has more
    pairs than a task should hold, the parts of each order are in sides of
    ``SIDE`` on average, and a task gets whole pairs of sides.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").where("l_orderkey is not null and l_partkey is not null")
    rows = lots(spark, lines.count())
    sizes = dealt(lines, rows, "l_orderkey").groupBy("_lot", "l_orderkey").agg(F.count("*").alias("n"))
    found = sizes.agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"), F.max("n").alias("most")).first()
    n = max(rows, lots(spark, found.pairs or 0))
    each = dealt(lines, n, "l_orderkey").distinct()
    one, two, keys, distinct = each, each, ["_lot", "l_orderkey"], F.col("l_partkey") < F.col("other")
    if (found.most or 0) > SIDE:
        sides = F.ceil(F.count("*").over(Window.partitionBy("_lot", "l_orderkey")) / SIDE).cast("int")
        own = each.withColumn("sides", sides).select("l_orderkey", "l_partkey", "sides", F.pmod(F.xxhash64("l_partkey"), F.col("sides")).cast("int").alias("own"))
        keys = ["l_orderkey", "a", "b"]
        one = dealt(own.select("l_orderkey", "l_partkey", F.col("own").alias("a"), F.explode(F.sequence("own", F.col("sides") - 1)).alias("b")), n, *keys)
        two = dealt(own.select("l_orderkey", "l_partkey", F.explode(F.sequence(F.lit(0), "own")).alias("a"), F.col("own").alias("b")), n, *keys)
        keys, distinct = ["_lot", *keys], distinct | (F.col("a") < F.col("b"))
    pairs = one.join(two.withColumnRenamed("l_partkey", "other"), keys).where(distinct)
    return counted(pairs.select("_lot", F.least("l_partkey", "other").alias("src"), F.greatest("l_partkey", "other").alias("dst")), n)


def planted(spark: SparkSession, vertices: int, blocks: int, degree: int, inside: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """``edges`` of a planted partition and its ``truth(v, t)``.

    Vertex v is in block v mod ``blocks``; each of its ``degree`` edges ends
    inside its block with probability ``inside``, anywhere else otherwise.
    """
    v = spark.range(vertices).toDF("src")
    each = v.select("src", F.explode(F.sequence(F.lit(0), F.lit(degree - 1))).alias("k"))
    own = F.floor(uniform(seed, F.col("src"), F.col("k")) * ((vertices - F.col("src") % blocks - 1) / blocks).cast("long").cast("double")).cast("long") * blocks + F.col("src") % blocks
    anywhere = F.floor(uniform(seed + 1, F.col("src"), F.col("k")) * vertices).cast("long")
    dst = F.when(uniform(seed + 2, F.col("src"), F.col("k")) < inside, own).otherwise(anywhere)
    edges = each.select("src", dst.alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("w"))
    return edges, spark.range(vertices).select(F.col("id").alias("v"), (F.col("id") % blocks).alias("t"))
