"""DuckDB SQL for the graph queries. Power iteration is unrolled into one table an iteration."""

from __future__ import annotations

from larkspur.plans.graphs import SQL


def prepared(graph: str) -> str:
    """Common tables: input, e (distinct), v (dense numbers), g (degrees)."""
    return f"""WITH RECURSIVE input AS MATERIALIZED ({SQL[graph]}),
e AS MATERIALIZED (SELECT DISTINCT src, dst FROM input),
v AS MATERIALIZED (SELECT id AS vertex, row_number() OVER (ORDER BY id) - 1 AS dense FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)),
g AS MATERIALIZED (SELECT v.vertex, v.dense, coalesce(o.k, 0) AS outdeg, coalesce(i.k, 0) AS indeg FROM v
  LEFT JOIN (SELECT src, count(*) AS k FROM e GROUP BY src) o ON o.src = v.vertex LEFT JOIN (SELECT dst, count(*) AS k FROM e GROUP BY dst) i ON i.dst = v.vertex)"""


def iterated(graph: str, steps: int, damping: float = 0.85) -> str:
    """prepared, and r0 .. r<steps> with vertex, outdeg and rank."""
    out = [prepared(graph), "n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM v)", "r0 AS MATERIALIZED (SELECT vertex, outdeg, 1 / n AS rank FROM g, n)"]
    for k in range(1, steps + 1):
        p = f"r{k - 1}"
        out.append(
            f"r{k} AS MATERIALIZED (SELECT s.vertex, s.outdeg, (1 - {damping}) / n + {damping} * (SELECT coalesce(sum(rank), 0) FROM {p} WHERE outdeg = 0) / n + {damping} * coalesce(i.incoming, 0) AS rank FROM {p} s CROSS JOIN n "
            f"LEFT JOIN (SELECT e.dst, sum(rank / outdeg) AS incoming FROM e JOIN {p} ON {p}.vertex = e.src GROUP BY e.dst) i ON i.dst = s.vertex)"
        )
    return ",\n".join(out)


def traced(steps: int) -> str:
    rows = [f"SELECT {k} AS iteration, sum(abs(b.rank - a.rank)) AS residual_l1, sum(b.rank) AS rank_sum FROM r{k} b JOIN r{k - 1} a USING (vertex)" for k in range(1, steps + 1)]
    return " UNION ALL ".join(rows)


def ranks(graph: str, steps: int) -> str:
    return f"{iterated(graph, steps)}\nSELECT vertex, round(rank, 10) AS rank FROM r{steps}"


def trace(graph: str, steps: int) -> str:
    return f"{iterated(graph, steps)}\nSELECT CAST(iteration AS INT) AS iteration, round(residual_l1, 10) AS residual_l1, round(rank_sum, 10) AS rank_sum FROM ({traced(steps)})"


def converged(graph: str, tolerance: float, most: int) -> str:
    every = " UNION ALL ".join(f"SELECT {k} AS iteration, vertex, rank FROM r{k}" for k in range(1, most + 1))
    return f"""{iterated(graph, most)},
t AS MATERIALIZED ({traced(most)})
SELECT CAST(iteration AS INT) AS iteration, vertex, round(rank, 10) AS rank FROM ({every})
WHERE iteration = (SELECT min(iteration) FROM t WHERE residual_l1 <= {tolerance!r})"""


def shard_plan(graph: str, shards: int) -> str:
    return f"""{prepared(graph)},
c AS MATERIALIZED (SELECT v.dense AS d, count(*) AS k FROM e JOIN v ON v.vertex = e.dst GROUP BY 1),
cb AS MATERIALIZED (SELECT d, k, sum(k) OVER (ORDER BY d) - k AS b FROM c),
t AS MATERIALIZED (SELECT greatest(1, ceil(count(*) / {shards}::DOUBLE))::BIGINT AS share FROM input),
nx AS MATERIALIZED (SELECT a.d, (SELECT min(x.d) FROM cb x, t WHERE x.b >= a.b + t.share) AS nd FROM cb a),
s(i, d) AS (SELECT 0, (SELECT min(d) FROM cb) UNION ALL SELECT i + 1, nx.nd FROM s JOIN nx USING (d) WHERE nx.nd IS NOT NULL AND i + 1 < {shards}),
p AS MATERIALIZED (SELECT i, CASE WHEN i = 0 THEN 0 ELSE d END AS vb, coalesce(lead(d) OVER (ORDER BY i), (SELECT count(*) FROM v)) AS ve FROM s)"""


PLAN = "SELECT CAST(i AS INT) AS shard, CAST(vb AS BIGINT) AS vertex_begin, CAST(ve AS BIGINT) AS vertex_end, (SELECT sum(k) FROM cb WHERE d >= vb AND d < ve)::BIGINT AS edge_count FROM p"

# Lines of every kind, made from order lines; the same text in Spark and DuckDB SQL.
LINES = """CASE CAST(l_linenumber + l_orderkey AS BIGINT) % 12
WHEN 0 THEN concat(CAST(l_orderkey AS STRING), ',', CAST(l_suppkey AS STRING)) WHEN 1 THEN concat(CAST(l_orderkey AS STRING), ' ', CAST(l_suppkey AS STRING))
WHEN 2 THEN concat('  ', CAST(l_orderkey AS STRING), chr(9), CAST(l_suppkey AS STRING), '  ') WHEN 3 THEN concat(CAST(l_orderkey AS STRING), '-', CAST(l_suppkey AS STRING))
WHEN 4 THEN concat('# ', CAST(l_orderkey AS STRING)) WHEN 5 THEN '   ' WHEN 6 THEN concat(CAST(l_orderkey AS STRING), ' ,  -', CAST(l_suppkey AS STRING), chr(13))
WHEN 7 THEN CAST(l_orderkey AS STRING) WHEN 8 THEN concat(CAST(l_orderkey AS STRING), ',,', CAST(l_suppkey AS STRING)) WHEN 9 THEN concat('99999999999 ', CAST(l_suppkey AS STRING))
WHEN 10 THEN 'FromNodeId, ToNodeId' ELSE concat('00', CAST(l_orderkey AS STRING), ' 007') END"""

WS = r"[ \t\n\x0B\f\r]"
PAIR = rf"^{WS}*(-?\d+)(?:{WS}*,{WS}*(-?\d+)|{WS}+(-?\d+)|(-\d+)){WS}*$"


def parsed_lines() -> str:
    """Tables l (lines) and k (with src, dst and kind)."""
    text = LINES.replace("STRING", "VARCHAR")
    part = lambda k: f"nullif(regexp_extract(value, '{PAIR}', {k}), '')"
    return rf"""WITH l AS MATERIALIZED (SELECT l_orderkey, l_linenumber, {text} AS value FROM lineitem),
c AS (SELECT *, TRY_CAST({part(1)} AS INT) AS a, TRY_CAST(coalesce({part(2)}, {part(3)}, {part(4)}) AS INT) AS b FROM l),
k AS MATERIALIZED (SELECT l_orderkey, l_linenumber, value, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a END AS src, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b END AS dst,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'edge' WHEN regexp_matches(value, '^{WS}*$') THEN 'blank' WHEN regexp_matches(value, '^{WS}*#') THEN 'comment'
  WHEN regexp_matches(lower(value), 'from|source') AND regexp_matches(lower(value), 'to|target|destination') THEN 'header' ELSE 'bad' END AS kind FROM c)"""
