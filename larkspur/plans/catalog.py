"""Registered graph queries and the DuckDB SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import graph as G
from larkspur.operators import pagerank as P
from larkspur.operators import shards as S
from larkspur.operators import validate as V
from larkspur.plans import oracles as O
from larkspur.plans.graphs import GRAPHS
from larkspur.sources import edges as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS, TOLERANCE, MOST = 4, 1e-4, 12


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


@query("endpoint_union", f"{O.prepared('ev')}\nSELECT vertex, count(*) AS ends FROM (SELECT src AS vertex FROM input UNION ALL SELECT dst FROM input) GROUP BY vertex")
def endpoint_union(spark, d):
    return G.endpoints(GRAPHS["ev"](spark, d)).groupBy("vertex").agg(F.count("*").alias("ends"))


@query("edges_distinct", f"{O.prepared('cs')}\nSELECT src, dst FROM e")
def edges_distinct(spark, d):
    return G.distinct_edges(GRAPHS["cs"](spark, d))


@query("id_range", f"{O.prepared('trade')}\nSELECT min(least(src, dst)) AS min_vertex, max(greatest(src, dst)) AS max_vertex FROM input")
def id_range(spark, d):
    return G.id_range(GRAPHS["trade"](spark, d))


@query("vertices_dense", f"{O.prepared('trade')}\nSELECT CAST(dense AS BIGINT) AS dense, vertex FROM v")
def vertices_dense(spark, d):
    return G.dense_vertices(G.vertex_ids(GRAPHS["trade"](spark, d)))


@query("edges_dense_pull", f"{O.prepared('trade')}\nSELECT CAST(b.dense AS BIGINT) AS dst, CAST(a.dense AS BIGINT) AS src FROM e JOIN v a ON a.vertex = e.src JOIN v b ON b.vertex = e.dst")
def edges_dense_pull(spark, d):
    edges = GRAPHS["trade"](spark, d)
    return G.pull_edges(G.distinct_edges(edges), G.dense_vertices(G.vertex_ids(edges)))


def _degrees(spark, d, name, of=G.outdegrees):
    unique = G.distinct_edges(GRAPHS[name](spark, d))
    return of(unique, G.vertex_ids(unique))


@query("outdegrees", f"{O.prepared('trade')}\nSELECT vertex, CAST(outdeg AS BIGINT) AS outdeg FROM g")
def outdegrees(spark, d):
    return _degrees(spark, d, "trade")


@query("indegrees", f"{O.prepared('ev')}\nSELECT vertex, CAST(indeg AS BIGINT) AS indeg FROM g")
def indegrees(spark, d):
    return _degrees(spark, d, "ev", G.indegrees)


@query("dangling_vertices", f"{O.prepared('trade')}\nSELECT vertex FROM g WHERE outdeg = 0")
def dangling_vertices(spark, d):
    return G.dangling(_degrees(spark, d, "trade")).select("vertex")


@query("dangling_mass", f"{O.iterated('trade', 2)}\nSELECT round(sum(rank) FILTER (outdeg = 0), 10) AS dangling_mass FROM r2")
def dangling_mass(spark, d):
    ranks = P.run(GRAPHS["trade"](spark, d), P.Options(iterations=2)).ranks
    held = ranks.join(G.dangling(_degrees(spark, d, "trade")), "vertex")
    return held.agg(F.round(P.exact_sum(F.col("rank")), 10).alias("dangling_mass"))


def _summary_sql(name):
    return f"""{O.prepared(name)}
SELECT (SELECT count(*) FROM v) AS vertex_count, (SELECT count(*) FROM input) AS input_edge_count, (SELECT count(*) FROM e) AS edge_count,
(SELECT count(*) FROM input) - (SELECT count(*) FROM e) AS duplicate_edge_count, (SELECT count(*) FROM e WHERE src = dst) AS self_loop_count"""


for _name in GRAPHS:
    query(f"graph_summary_{_name}", _summary_sql(_name))(lambda spark, d, name=_name: G.summary(GRAPHS[name](spark, d)))


@query("self_loops", f"{O.prepared('ev')}\nSELECT src AS vertex FROM e WHERE src = dst")
def self_loops(spark, d):
    return G.distinct_edges(GRAPHS["ev"](spark, d)).where("src = dst").select(F.col("src").alias("vertex"))


_FAULTS = f"""{O.prepared('trade')},
de AS MATERIALIZED (SELECT b.dense AS dst, a.dense AS src FROM e JOIN v a ON a.vertex = e.src JOIN v b ON b.vertex = e.dst),
n AS (SELECT count(*) AS n FROM v),
be AS MATERIALIZED (SELECT * FROM de UNION ALL SELECT * FROM de WHERE dst % 5 = 0 UNION ALL SELECT dst + n, src FROM de, n WHERE dst % 7 = 0),
bv AS MATERIALIZED (SELECT dense, CASE WHEN dense % 3 = 1 THEN 0 ELSE outdeg END AS outdeg FROM g UNION ALL SELECT dense, 0 FROM g WHERE dense % 11 = 0)
SELECT (SELECT count(*) FROM be, n WHERE dst >= n OR src >= n) AS ids_out_of_range, (SELECT count(*) FROM be) - (SELECT count(*) FROM (SELECT DISTINCT * FROM be)) AS repeated_edges,
(SELECT count(*) FROM be WHERE src NOT IN (SELECT dense FROM bv WHERE outdeg > 0)) AS sources_without_degree,
(SELECT count(*) - count(DISTINCT dense) FROM bv) AS repeated_vertices, CAST((SELECT sum(outdeg) FROM bv) - (SELECT count(*) FROM e) AS BIGINT) AS degree_excess"""


@query("graph_integrity", _FAULTS)
def graph_integrity(spark, d):
    """A graph with planted faults of every kind."""
    g = G.build_graph(GRAPHS["trade"](spark, d))
    edges = g.edges.union(g.edges.where("dst % 5 = 0")).union(g.edges.where("dst % 7 = 0").selectExpr(f"dst + {g.summary['vertex_count']}", "src"))
    vertices = g.vertices.withColumn("outdeg", F.expr("CASE WHEN dense % 3 = 1 THEN 0 ELSE outdeg END")).union(g.vertices.where("dense % 11 = 0").selectExpr("dense", "vertex", "0L"))
    return G.integrity(G.Graph(vertices, edges, g.summary))


def _plan(spark, d):
    graph = G.build_graph(GRAPHS["trade"](spark, d))
    return graph, S.plan_shards(graph.edges, graph.summary["vertex_count"], graph.summary["input_edge_count"], SHARDS)


@query("shard_plan", f"{O.shard_plan('trade', SHARDS)}\n{O.PLAN}")
def shard_plan(spark, d):
    return S.shard_table(spark, _plan(spark, d)[1])


@query(
    "shard_assignment",
    f"{O.shard_plan('trade', SHARDS)}\nSELECT CAST(b.dense AS BIGINT) AS dst, CAST(a.dense AS BIGINT) AS src, CAST(i AS INT) AS shard FROM e JOIN v a ON a.vertex = e.src JOIN v b ON b.vertex = e.dst JOIN p ON b.dense >= vb AND b.dense < ve",
)
def shard_assignment(spark, d):
    graph, plan = _plan(spark, d)
    return S.assign_shards(graph.edges, plan)


@query(
    "edges_before",
    f"{O.prepared('trade')}, c AS (SELECT v.dense AS dst, count(*) AS edges FROM e JOIN v ON v.vertex = e.dst GROUP BY 1)\nSELECT dst, edges, CAST(sum(edges) OVER (ORDER BY dst) - edges AS BIGINT) AS \"before\" FROM c",
)
def edges_before(spark, d):
    return S.edges_before(G.build_graph(GRAPHS["trade"](spark, d)).edges)


def _lines(spark, d):
    return E.classified(spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.expr(O.LINES).alias("value")))


@query("edge_text_parse", f"{O.parsed_lines()}\nSELECT l_orderkey, l_linenumber, src, dst, kind FROM k")
def edge_text_parse(spark, d):
    return _lines(spark, d).select("l_orderkey", "l_linenumber", "src", "dst", "kind")


@query(
    "edge_text_stats",
    f"{O.parsed_lines()}\nSELECT count(*) AS lines, count(*) FILTER (kind = 'edge') AS edges, count(*) FILTER (kind = 'comment') AS comments, count(*) FILTER (kind = 'header') AS headers FROM k",
)
def edge_text_stats(spark, d):
    return E.line_counts(_lines(spark, d))


_SAME = "NOT EXISTS (SELECT src, dst FROM input EXCEPT ALL SELECT src, dst FROM {0}) AND NOT EXISTS (SELECT src, dst FROM {0} EXCEPT ALL SELECT src, dst FROM input)"


@query(
    "edge_fingerprint",
    f"""{O.prepared('cs')},
moved AS MATERIALIZED (SELECT src, dst FROM input ORDER BY dst DESC, src), turned AS (SELECT CASE WHEN src = 7 THEN dst ELSE src END AS src, CASE WHEN src = 7 THEN src ELSE dst END AS dst FROM input),
fewer AS (SELECT DISTINCT src, dst FROM input)
SELECT count(*) AS edges, {_SAME.format('moved')} AS order_free, {_SAME.format('turned')} AS turned_alike, {_SAME.format('fewer')} AS fewer_alike FROM input""",
)
def edge_fingerprint(spark, d):
    """Equal for the same edges in another order; not for edges that were turned round or lost."""
    edges = GRAPHS["cs"](spark, d)
    turned = edges.selectExpr("CASE WHEN src = 7 THEN dst ELSE src END AS src", "CASE WHEN src = 7 THEN src ELSE dst END AS dst")
    others = {"order_free": edges.repartition(3, "dst").sortWithinPartitions(F.desc("src")), "turned_alike": turned, "fewer_alike": edges.distinct()}
    out = E.fingerprint(edges)
    for name, other in others.items():
        out = out.join(E.fingerprint(other).select(F.col("fingerprint").alias(name)), F.lit(True))  # one row each
    return out.select("edges", *[(F.col("fingerprint") == F.col(name)).alias(name) for name in others])


@query("pagerank_init", f"{O.iterated('ev', 0)}\nSELECT vertex, outdeg, round(rank, 10) AS rank FROM r0")
def pagerank_init(spark, d):
    degrees = _degrees(spark, d, "ev")
    return P.initial(degrees, degrees.count()).select("vertex", "outdeg", F.round("rank", 10).alias("rank"))


def _ranks(spark, d, name, steps, **options):
    return P.run(GRAPHS[name](spark, d), P.Options(iterations=steps, **options)).ranks.select("vertex", F.round("rank", 10).alias("rank"))


for _name, _steps in (("cs", 1), ("ev", 1), ("trade", 1), ("cs", 10), ("ev", 10), ("trade", 10)):
    query(f"pagerank_{_name}_{_steps}", O.ranks(_name, _steps))(lambda spark, d, name=_name, steps=_steps: _ranks(spark, d, name, steps))
query("pagerank_double_5", O.ranks("trade", 5))(lambda spark, d: _ranks(spark, d, "trade", 5, accumulator="double"))
query("pagerank_by_source_5", O.ranks("trade", 5))(lambda spark, d: _ranks(spark, d, "trade", 5, edge_layout="src"))


@query("incoming_sum", f"{O.iterated('trade', 1)}\nSELECT e.dst AS vertex, round(sum(rank / outdeg), 10) AS incoming FROM e JOIN r1 ON r1.vertex = e.src GROUP BY e.dst")
def incoming_sum(spark, d):
    edges = G.distinct_edges(GRAPHS["trade"](spark, d))
    state = P.run(edges, P.Options(iterations=1)).ranks.join(_degrees(spark, d, "trade"), "vertex")
    share = state.where("outdeg > 0").select(F.col("vertex").alias("src"), (F.col("rank") / F.col("outdeg")).alias("share"))
    return edges.join(share, "src").groupBy(F.col("dst").alias("vertex")).agg(F.round(P.exact_sum(F.col("share")), 10).alias("incoming"))


@query("pagerank_trace", O.trace("trade", 5))
def pagerank_trace(spark, d):
    trace = P.run(GRAPHS["trade"](spark, d), P.Options(iterations=5)).trace_frame()
    return trace.select("iteration", F.round("residual_l1", 10).alias("residual_l1"), F.round("rank_sum", 10).alias("rank_sum"))


@query("pagerank_converged", O.converged("ev", TOLERANCE, MOST))
def pagerank_converged(spark, d):
    found = P.run(GRAPHS["ev"](spark, d), P.Options(tolerance=TOLERANCE, max_iterations=MOST))
    return found.ranks.select(F.lit(found.iterations).alias("iteration"), "vertex", F.round("rank", 10).alias("rank"))


@query("ranks_sorted", f"{O.iterated('ev', 3)}\nSELECT CAST(row_number() OVER (ORDER BY vertex) - 1 AS BIGINT) AS dense, vertex, round(rank, 10) AS rank FROM r3")
def ranks_sorted(spark, d):
    """Ids attached to dense numbers again, in ascending order."""
    edges = GRAPHS["ev"](spark, d)
    return G.dense_vertices(G.vertex_ids(edges)).join(_ranks(spark, d, "ev", 3), "vertex").select("dense", "vertex", "rank").orderBy("vertex")


@query(
    "rank_validation",
    f"{O.iterated('trade', 3)}\nSELECT count(*) AS vertices, round(sum(rank), 10) AS rank_sum, round(min(rank), 10) AS minimum_rank, round(max(rank), 10) AS maximum_rank, 0::BIGINT AS bad_ranks, count(*) - count(DISTINCT vertex) AS repeated_vertices FROM r3",
)
def rank_validation(spark, d):
    row = V.rank_checks(P.run(GRAPHS["trade"](spark, d), P.Options(iterations=3)).ranks)
    return row.select("vertices", *[F.round(c, 10).alias(c) for c in ("rank_sum", "minimum_rank", "maximum_rank")], "bad_ranks", "repeated_vertices")


@query(
    "rank_faults",
    f"""{O.iterated('trade', 1)},
b AS (SELECT vertex, CASE WHEN vertex % 7 = 0 THEN -rank WHEN vertex % 11 = 0 THEN 'nan'::DOUBLE WHEN vertex % 13 = 0 THEN NULL WHEN vertex % 17 = 0 THEN 'inf'::DOUBLE ELSE rank END AS rank FROM r1
  UNION ALL SELECT vertex, rank FROM r1 WHERE vertex % 5 = 0)
SELECT count(*) AS vertices, count(*) FILTER (rank IS NULL OR isnan(rank) OR isinf(rank) OR rank < 0) AS bad_ranks, count(*) - count(DISTINCT vertex) AS repeated_vertices FROM b""",
)
def rank_faults(spark, d):
    """Ranks with planted faults of every kind."""
    ranks = P.run(GRAPHS["trade"](spark, d), P.Options(iterations=1)).ranks
    bad = ranks.selectExpr(
        "vertex", "CASE WHEN vertex % 7 = 0 THEN -rank WHEN vertex % 11 = 0 THEN double('nan') WHEN vertex % 13 = 0 THEN NULL WHEN vertex % 17 = 0 THEN double('inf') ELSE rank END AS rank"
    )
    return V.rank_checks(bad.union(ranks.where("vertex % 5 = 0"))).select("vertices", "bad_ranks", "repeated_vertices")


@query(
    "rank_compare",
    f"""{O.iterated('ev', 4)}
SELECT count(*) FILTER (b.rank IS NULL) AS unexpected_vertices, count(*) FILTER (a.rank IS NULL) AS missing_vertices,
round(max(abs(a.rank - b.rank)), 10) AS maximum_absolute_error, round(max(abs(a.rank - b.rank) / b.rank), 8) AS maximum_relative_error FROM r3 a FULL OUTER JOIN r4 b USING (vertex)""",
)
def rank_compare(spark, d):
    edges = GRAPHS["ev"](spark, d)
    three, four = (P.run(edges, P.Options(iterations=k)).ranks for k in (3, 4))
    row = V.compare(three, four)
    return row.select("unexpected_vertices", "missing_vertices", F.round("maximum_absolute_error", 10).alias("maximum_absolute_error"), F.round("maximum_relative_error", 8).alias("maximum_relative_error"))


@query("rank_residual", f"{O.iterated('cs', 3)}\nSELECT round(sum(abs(b.rank - a.rank)), 10) AS residual_l1 FROM r2 a JOIN r3 b USING (vertex)")
def rank_residual(spark, d):
    edges = GRAPHS["cs"](spark, d)
    two, three = (P.run(edges, P.Options(iterations=k)).ranks for k in (2, 3))
    joined = two.withColumnRenamed("rank", "before").join(three, "vertex")
    return joined.agg(F.round(P.exact_sum(F.abs(F.col("rank") - F.col("before"))), 10).alias("residual_l1"))
