"""PageRank by power iteration, with the mass of dangling vertices spread over all.

The edges are dealt out once and cached, and no iteration shuffles them:

* while the shares of all vertices are below the session's broadcast threshold, edges lie by destination, the
  shares are broadcast, and the sums by destination need no exchange;
* otherwise edges lie by source, next to the ranks, which are cached in the same partitions, and the only
  exchange is that of partial sums by destination. Edges of a source with over HUB of them are dealt out over
  several tasks, and its rank is repeated for each; a destination's sum is made of one partial sum a task,
  so no vertex's edges meet in one task.

An iteration is one job: it caches the new ranks and sums residual, rank sum and dangling mass on the way, so the
driver sees three numbers. Every CUT iterations ranks are written to the shared folder, so lineage stays
short and a lost executor costs a few iterations at most.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.exact import exact_sum
from larkspur.operators.graph import Graph, distinct_edges, outdegrees, vertex_ids
from larkspur.sources.staging import Staging

#: Ranks must sum to 1 to within this.
MASS_TOLERANCE = 1e-10
#: Edges of one source that a task gets; iterations between tables in the shared folder; bytes that a broadcast share takes.
HUB, CUT, SHARE_BYTES = 2_000_000, 4, 24
LAYOUTS = ("auto", "dst", "src")


class NotConverged(RuntimeError):
    """The residual is above the tolerance after the last allowed iteration."""


@dataclass(frozen=True)
class Options:
    damping: float = 0.85
    tolerance: float = 1e-8
    max_iterations: int = 100
    iterations: int | None = None  # so many exactly; tolerance and max_iterations then mean nothing
    accumulator: str = "fixed"
    edge_layout: str = "auto"  # or "dst" or "src", whatever the sizes

    def check(self) -> None:
        if not 0 < self.damping < 1:
            raise ValueError("damping must be between 0 and 1")
        if self.iterations is not None:
            if self.iterations < 1:
                raise ValueError("iterations must be positive")
        elif not (math.isfinite(self.tolerance) and self.tolerance > 0):
            raise ValueError("tolerance must be finite and positive")
        elif self.max_iterations < 1:
            raise ValueError("max-iterations must be positive")
        if self.edge_layout not in LAYOUTS:
            raise ValueError(f"edge_layout must be one of {', '.join(LAYOUTS)}")


@dataclass
class Result:
    ranks: DataFrame  # vertex, rank
    iterations: int
    residual_l1: float
    rank_sum: float
    trace: list[dict] = field(default_factory=list)

    def trace_frame(self) -> DataFrame:
        rows = [(t["iteration"], t["residual_l1"], t["rank_sum"], t["seconds"], t["edges_per_second"]) for t in self.trace]
        return self.ranks.sparkSession.createDataFrame(rows, "iteration int, residual_l1 double, rank_sum double, seconds double, edges_per_second double")


def initial(degrees: DataFrame, n: int) -> DataFrame:
    return degrees.select("vertex", "outdeg", F.lit(1.0 / n).alias("rank"))


def base_term(damping: float, n: int, dangling_mass: float) -> float:
    return (1.0 - damping) / n + damping * dangling_mass / n


def step(edges: DataFrame, state: DataFrame, damping: float, base: float, accumulator: str = "fixed", send: bool = False) -> DataFrame:
    """vertex, outdeg, rank and the rank before; edges are distinct, state has vertex, outdeg and rank.

    Edges may have a `part` (from 0) of their source. `send`: broadcast the shares.
    """
    share = state.where("outdeg > 0").select(F.col("vertex").alias("src"), "outdeg", (F.col("rank") / F.col("outdeg")).alias("share"))
    on = ["src"]
    if "part" in edges.columns:
        share, on = share.withColumn("part", F.explode(F.sequence(F.lit(0), _parts(F.col("outdeg")) - 1))), ["src", "part"]
    share = share.drop("outdeg")
    incoming = edges.join(F.broadcast(share) if send else share.hint("merge"), on).groupBy(F.col("dst").alias("vertex")).agg(exact_sum(F.col("share"), accumulator).alias("incoming"))
    moved = F.lit(base) + F.lit(damping) * F.coalesce("incoming", F.lit(0.0))
    return state.join(incoming.hint("shuffle_hash"), "vertex", "left").select("vertex", "outdeg", moved.alias("rank"), F.col("rank").alias("before"))


def _parts(degree):
    return F.ceil(degree / F.lit(HUB)).cast("int")


def _dealt(edges: DataFrame, degrees: DataFrame, layout: str) -> DataFrame:
    """Cached edges in the partitions that every iteration uses; with `part` if a source has over HUB edges."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = edges.select("src", "dst")
    if layout == "dst":
        return edges.repartition(n, "dst").sortWithinPartitions("dst", "src").persist(StorageLevel.MEMORY_AND_DISK)
    hubs = degrees.where(F.col("outdeg") > HUB).select(F.col("vertex").alias("src"), _parts(F.col("outdeg")).alias("parts"))
    if hubs.isEmpty():
        return edges.repartition(n, "src").sortWithinPartitions("src").persist(StorageLevel.MEMORY_AND_DISK)
    # At most one hub for HUB edges.
    of = edges.join(F.broadcast(hubs), "src", "left").select("src", "dst", F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    return of.repartition(n, "src", "part").sortWithinPartitions("src", "part").persist(StorageLevel.MEMORY_AND_DISK)


def _totals(accumulator: str) -> list:
    """What one pass over new ranks tells."""
    of = {"residual": F.abs(F.col("rank") - F.col("before")), "rank_sum": F.col("rank"), "dangling": F.when(F.col("outdeg") == 0, F.col("rank")).otherwise(0.0)}
    return [exact_sum(c, accumulator).alias(name) for name, c in of.items()]


def iterate(edges: DataFrame, degrees: DataFrame, n: int, n_edges: int, n_dangling: int, options: Options, staging: Staging, tell: Callable[[dict], None] | None = None) -> Result:
    """PageRank over distinct edges (src, dst) and the out-degrees (vertex, outdeg) of all n vertices."""
    spark = edges.sparkSession
    small = n * SHARE_BYTES <= _bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    layout = ("dst" if small and _largest(edges, "dst") <= HUB else "src") if options.edge_layout == "auto" else options.edge_layout
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = lambda rows: rows.repartition(parts, "vertex").sortWithinPartitions("vertex")
    dealt, mass, trace = _dealt(edges, degrees, layout), n_dangling * (1.0 / n), []
    state = placed(initial(degrees, n)).persist(StorageLevel.MEMORY_AND_DISK)
    fixed, held, table = options.iterations is not None, [state], None
    try:
        for number in range(1, (options.iterations if fixed else options.max_iterations) + 1):
            began = time.monotonic()
            base = base_term(options.damping, n, mass)
            state = step(dealt, state, options.damping, base, options.accumulator, send=small).persist(StorageLevel.MEMORY_AND_DISK)
            got = state.agg(*_totals(options.accumulator)).first()
            held.append(state)
            # The next step reads this one's ranks only; what is before them stays until they are in a table.
            if number % CUT == 0:
                before = table
                state, table = staging.cut(state)[0], staging.count
                state = placed(state).persist(StorageLevel.MEMORY_AND_DISK)
                for old in held:
                    old.unpersist()
                held = [state]
                if before is not None:
                    staging.drop(before)
            elif len(held) > 2:
                held.pop(0).unpersist()
            mass, seconds = got["dangling"], time.monotonic() - began
            trace.append({"iteration": number, "residual_l1": got["residual"], "rank_sum": got["rank_sum"], "seconds": seconds, "edges_per_second": n_edges / seconds})
            if tell:
                tell(trace[-1])
            if not fixed and trace[-1]["residual_l1"] <= options.tolerance:
                break
        last = trace[-1]
        if not fixed and last["residual_l1"] > options.tolerance:
            raise NotConverged(f"not converged after {last['iteration']} iterations: residual {last['residual_l1']:.6g} is above {options.tolerance:.6g}")
        if not math.isfinite(last["rank_sum"]) or abs(last["rank_sum"] - 1.0) > MASS_TOLERANCE:
            raise ArithmeticError(f"ranks sum to {last['rank_sum']!r}")
        ranks, seen = staging.cut(state.select("vertex", "rank"), keep=True, odd=F.count_if(F.isnan("rank") | (F.abs("rank") == float("inf"))))
        if seen["odd"]:
            raise ArithmeticError("a rank is not finite")
    finally:
        for old in (dealt, *held):
            old.unpersist()
    return Result(ranks, last["iteration"], last["residual_l1"], last["rank_sum"], trace)


def _bytes(size: str) -> int:
    """A size as Spark's settings spell it; -1 for none."""
    size = size.strip().lower().removesuffix("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}.get(size[-1:], 1)
    return int(size.rstrip("kmgt")) * unit


def _largest(edges: DataFrame, key: str) -> int:
    return edges.groupBy(key).count().agg(F.max("count").alias("most")).first()["most"] or 0


def run(edges: DataFrame, options: Options = Options(), tell: Callable[[dict], None] | None = None) -> Result:
    """PageRank of edges (src, dst; duplicates count once). `tell` gets each row of the trace as it comes."""
    options.check()
    with Staging(edges.sparkSession) as staging:
        unique, counted = staging.cut(distinct_edges(edges), n=F.count("*"))
        if not counted["n"]:
            raise ValueError("the input graph has no edges")
        degrees, seen = staging.cut(outdegrees(unique, vertex_ids(unique)), n=F.count("*"), dangling=F.count_if(F.col("outdeg") == 0))
        return iterate(unique, degrees, seen["n"], counted["n"], seen["dangling"], options, staging, tell)


def run_prepared(graph: Graph, options: Options = Options(), tell: Callable[[dict], None] | None = None) -> Result:
    """PageRank of a prepared graph, on its dense numbers, distinct edges and degrees as they are."""
    options.check()
    with Staging(graph.edges.sparkSession) as staging:
        degrees = graph.vertices.select(F.col("dense").alias("vertex"), "outdeg")
        n_dangling = degrees.where("outdeg = 0").count()
        found = iterate(graph.edges, degrees, graph.summary["vertex_count"], graph.summary["edge_count"], n_dangling, options, staging, tell)
        named = found.ranks.withColumnRenamed("vertex", "dense").join(graph.vertices.select("dense", "vertex"), "dense").select("vertex", "rank")
        found.ranks = staging.cut(named, keep=True)[0]
        return found
