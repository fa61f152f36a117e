"""Edge lists that the driver's tables hold: customers and suppliers, users in turn, and trade with cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.sources.edges import edges_from


def customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer points to the suppliers of their order lines, which have negative ids."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return edges_from(joined, F.col("o_custkey"), -1 - F.col("l_suppkey"))


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user points to the user of the next event; hours are put in order on their own and then chained."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "user_id", F.date_trunc("hour", "ts").alias("hour"))
    within = F.lead("user_id").over(Window.partitionBy("hour").orderBy("ts", "event_id"))
    firsts = events.groupBy("hour").agg(F.min(F.struct("ts", "event_id", "user_id")).alias("first"))
    # One row an hour, so a single window over all of them stays small.
    following = firsts.select("hour", F.lead("first.user_id").over(Window.orderBy("hour")).alias("opening"))
    chained = events.withColumn("next", within).join(following, "hour").withColumn("next", F.coalesce("next", "opening"))
    return edges_from(chained, F.col("user_id"), F.col("next"), skip_null=True)


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_supplier with the edges of every third supplier in both directions."""
    forward = customer_supplier(spark, sf_dir)
    back = forward.where((-1 - F.col("dst")) % 3 == 0).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return forward.unionByName(back)


GRAPHS = {"cs": customer_supplier, "ev": user_turns, "trade": trade}

# The same edges in SQL.
SQL = {
    "cs": "SELECT CAST(o_custkey AS INT) AS src, CAST(-1 - l_suppkey AS INT) AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "ev": "SELECT src, dst FROM (SELECT CAST(user_id AS INT) AS src, CAST(lead(user_id) OVER (ORDER BY ts, event_id) AS INT) AS dst FROM events) WHERE dst IS NOT NULL",
}
SQL["trade"] = f"SELECT src, dst FROM ({SQL['cs']}) UNION ALL SELECT dst AS src, src AS dst FROM ({SQL['cs']}) WHERE (-1 - dst) % 3 = 0"
