"""Destination shards: contiguous ranges of dense ids with about equally many edges."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators.graph import running
from larkspur.sources.staging import Staging

#: Up to so many shards a nested condition finds the shard; more are joined by destination.
INLINE = 1024
#: Up to so many destinations (16 bytes each) are walked on the driver.
LOCAL = 2_000_000


@dataclass(frozen=True)
class Shard:
    vertex_begin: int
    vertex_end: int  # exclusive
    edge_count: int


def edges_before(edges: DataFrame) -> DataFrame:
    """dst, its number of edges and the number of edges with a smaller dst; no window spans all rows."""
    degree = edges.groupBy("dst").agg(F.count("*").alias("edges"))
    dealt, bounds = running(degree, "dst", degree.count())
    own = F.sum("edges").over(Window.partitionBy("bucket").orderBy("dst")) - F.col("edges")
    before = F.lit(0)
    if bounds:
        sums = {r["bucket"]: r["n"] for r in dealt.groupBy("bucket").agg(F.sum("edges").alias("n")).collect()}
        total, starts = 0, []
        for b in range(len(bounds) + 1):
            starts.append(total)
            total += sums.get(b, 0)
        before = F.element_at(F.lit(starts), F.col("bucket") + 1)
    return dealt.select("dst", "edges", (before + own).cast("long").alias("before"))


def plan_shards(edges: DataFrame, vertex_count: int, input_edge_count: int, shards: int) -> list[Shard]:
    """At most `shards` shards; one ends at the first destination before which its share of edges is complete.

    The share is that of the edges as given, duplicates included. Up to LOCAL destinations the driver walks
    their prefix sums; of more, it looks up one pair of numbers for each shard in a staged, sorted table.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    share = max(1, -(-input_edge_count // shards))
    with Staging(edges.sparkSession) as staging:
        table, seen = staging.cut(edges_before(edges).orderBy("dst"), n=F.count("*"), total=F.sum("edges"))
        if seen["n"] <= LOCAL:
            found = table.select("dst", "before").toArrow()
            dst, before = (found[c].to_numpy() for c in ("dst", "before"))
            order = np.argsort(dst)
            dst, before = dst[order], before[order]

            def after(least: int) -> tuple[int, int] | None:
                at = int(np.searchsorted(before, least))
                return (int(dst[at]), int(before[at])) if at < len(dst) else None
        else:

            def after(least: int) -> tuple[int, int] | None:
                at = table.where(F.col("before") >= least).agg(F.min(F.struct("dst", "before")).alias("at")).first()["at"]
                return at and (at["dst"], at["before"])

        starts, done = [0], [0]
        while len(starts) < shards and (cut := after(done[-1] + share)):
            starts.append(cut[0])
            done.append(cut[1])
    ends = [*starts[1:], vertex_count]
    return [Shard(a, b, d - c) for a, b, c, d in zip(starts, ends, done, [*done[1:], seen["total"]])]


def shard_table(spark: SparkSession, shards: list[Shard]) -> DataFrame:
    return spark.createDataFrame([(k, *asdict(s).values()) for k, s in enumerate(shards)], "shard int, vertex_begin long, vertex_end long, edge_count long")


def assign_shards(edges: DataFrame, shards: list[Shard]) -> DataFrame:
    """edges with the number of the shard of their destination."""
    if len(shards) > INLINE:
        of = shard_table(edges.sparkSession, shards).select("shard", F.explode(F.sequence("vertex_begin", F.col("vertex_end") - 1)).alias("dst"))
        return edges.join(of, "dst")

    def place(low: int, high: int):
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("dst") < shards[mid].vertex_end, place(low, mid)).otherwise(place(mid + 1, high))

    return edges.withColumn("shard", place(0, len(shards) - 1))


def check_shards(shards: list[Shard], vertex_count: int, edge_count: int) -> None:
    """Raise unless the ranges cover all vertices one after another and hold all edges."""
    at = 0
    for s in shards:
        if s.vertex_begin != at or s.vertex_end < s.vertex_begin:
            raise ValueError("shards are not contiguous")
        at = s.vertex_end
    if at != vertex_count or sum(s.edge_count for s in shards) != edge_count:
        raise ValueError("shards do not cover the graph")
