"""Prepared graphs: distinct edges, dense vertex numbers, degrees and counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.sources.staging import Staging

#: Rows that one window partition numbers; more vertices than that are split at quantiles of their ids.
BUCKET_ROWS, MOST_BUCKETS = 1_000_000, 256


@dataclass(frozen=True)
class Graph:
    """vertices(dense, vertex, outdeg), edges(dst, src) in dense numbers, and the counts of its summary."""

    vertices: DataFrame
    edges: DataFrame
    summary: dict[str, int]


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst"])


def endpoints(edges: DataFrame) -> DataFrame:
    """The vertex at either end of every edge, one row each, in one pass."""
    return edges.select(F.explode(F.array("src", "dst")).alias("vertex"))


def vertex_ids(edges: DataFrame) -> DataFrame:
    return endpoints(edges).distinct()


def id_range(edges: DataFrame) -> DataFrame:
    return edges.agg(F.min(F.least("src", "dst")).alias("min_vertex"), F.max(F.greatest("src", "dst")).alias("max_vertex"))


def running(rows: DataFrame, key: str, n_rows: int) -> tuple[DataFrame, list[int]]:
    """rows with a `bucket` that grows with key, of about BUCKET_ROWS rows each, and the buckets' upper bounds.

    The bounds are literals in the plan, so every evaluation deals rows out alike.
    """
    buckets = min(MOST_BUCKETS, -(-n_rows // BUCKET_ROWS))
    if buckets <= 1:
        return rows.withColumn("bucket", F.lit(0)), []
    parts = [k / buckets for k in range(1, buckets)]
    bounds = sorted(set(rows.agg(F.percentile_approx(key, parts, 10_000).alias("b")).first()["b"]))

    def place(low: int, high: int):
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(key) <= bounds[mid], place(low, mid)).otherwise(place(mid + 1, high))

    return rows.withColumn("bucket", place(0, len(bounds))), bounds


def dense_vertices(ids: DataFrame, n: int | None = None) -> DataFrame:
    """dense and vertex: numbers from 0 in ascending order of the n ids, without sorting all ids in one task."""
    dealt, bounds = running(ids, "vertex", ids.count() if n is None else n)
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("vertex")) - 1
    before = F.lit(0)
    if bounds:
        sizes = {r["bucket"]: r["count"] for r in dealt.groupBy("bucket").count().collect()}
        start, starts = 0, []
        for b in range(len(bounds) + 1):
            starts.append(start)
            start += sizes.get(b, 0)
        before = F.element_at(F.lit(starts), F.col("bucket") + 1)
    return dealt.select((before + rank).cast("long").alias("dense"), "vertex")


def outdegrees(unique: DataFrame, vertices: DataFrame) -> DataFrame:
    """vertices with outdeg: distinct edges from each, loops included, 0 where there are none."""
    degree = unique.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("outdeg"))
    return vertices.join(degree, "vertex", "left").withColumn("outdeg", F.coalesce("outdeg", F.lit(0)).cast("long"))


def indegrees(unique: DataFrame, vertices: DataFrame) -> DataFrame:
    degree = unique.groupBy(F.col("dst").alias("vertex")).agg(F.count("*").alias("indeg"))
    return vertices.join(degree, "vertex", "left").withColumn("indeg", F.coalesce("indeg", F.lit(0)).cast("long"))


def dangling(degrees: DataFrame) -> DataFrame:
    return degrees.where("outdeg = 0")


def pull_edges(unique: DataFrame, vertices: DataFrame) -> DataFrame:
    """dst and src in dense numbers."""
    of = lambda name: vertices.select(F.col("vertex").alias(f"{name}_id"), F.col("dense").alias(name))
    named = unique.select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id"))
    return named.join(of("dst"), "dst_id").join(of("src"), "src_id").select("dst", "src")


def summary(edges: DataFrame) -> DataFrame:
    """One row of counts, from one grouping of the edges."""
    groups = edges.groupBy("src", "dst").agg(F.count("*").alias("copies"))
    counted = groups.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("input_edge_count"), F.count("*").alias("edge_count"), F.count_if(F.col("src") == F.col("dst")).alias("self_loop_count"))
    seen = vertex_ids(edges).agg(F.count("*").alias("vertex_count"))
    both = counted.crossJoin(seen)  # one row each
    return both.select("vertex_count", "input_edge_count", "edge_count", (F.col("input_edge_count") - F.col("edge_count")).alias("duplicate_edge_count"), "self_loop_count")


def build_graph(edges: DataFrame, staging: Staging | None = None) -> Graph:
    """Staged tables of a prepared graph. Edges are grouped once and vertices numbered once; all else reads the results."""
    staging = staging or Staging(edges.sparkSession)
    groups = edges.groupBy("src", "dst").agg(F.count("*").alias("copies"))
    unique, seen = staging.cut(groups, given=F.coalesce(F.sum("copies"), F.lit(0)), n=F.count("*"), loops=F.count_if(F.col("src") == F.col("dst")))
    if not seen["n"]:
        raise ValueError("the input graph has no edges")
    ids, met = staging.cut(vertex_ids(unique), n=F.count("*"))
    numbered, _ = staging.cut(dense_vertices(ids, met["n"]))
    vertices, _ = staging.cut(outdegrees(unique, numbered).select("dense", "vertex", "outdeg"), keep=True)
    pulled, _ = staging.cut(pull_edges(unique, numbered), keep=True)
    counts = {"vertex_count": met["n"], "input_edge_count": seen["given"], "edge_count": seen["n"], "duplicate_edge_count": seen["given"] - seen["n"], "self_loop_count": seen["loops"]}
    return Graph(vertices, pulled, counts)


def integrity(graph: Graph) -> DataFrame:
    """One row of counts of broken promises; all are 0 in a sound graph."""
    v, e = graph.vertices, graph.edges
    n = graph.summary["vertex_count"]
    inside = lambda c: (F.col(c) >= 0) & (F.col(c) < n)
    edges = e.agg(F.count_if(~inside("dst") | ~inside("src")).alias("ids_out_of_range"), (F.count("*") - F.count_distinct("dst", "src")).alias("repeated_edges"))
    lost = e.join(v.where("outdeg > 0").select(F.col("dense").alias("src")), "src", "left_anti").agg(F.count("*").alias("sources_without_degree"))
    order = v.agg((F.count("*") - F.count_distinct("dense")).alias("repeated_vertices"), (F.sum("outdeg") - F.lit(graph.summary["edge_count"])).alias("degree_excess"))
    return edges.crossJoin(lost).crossJoin(order)  # one row each
