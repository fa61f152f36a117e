"""Command line: preprocess, pagerank and validate. Exit 0 on success and for help, 1 without a command, 2 on errors."""

from __future__ import annotations

import json
import math
import os
import re
import sys
from pathlib import Path

HELP = """usage: python -m larkspur.cli COMMAND [--name value ...]

preprocess  --input FILE --graph-dir DIR [--work-dir DIR] [--memory-mib N] [--threads N] [--shards N]
            edge list to prepared graph. Threads are those of a local session; the memory is shared out over
            them as the size of the pieces of input and of shuffles that a task works on
pagerank    --graph-dir DIR --output FILE [--damping X] [--tolerance X] [--max-iterations N] [--iterations N]
            [--threads N] [--memory-mib N] prepared graph to vertex,rank CSV
validate    --input FILE [--expected FILE] [--sum-tolerance X] [--relative-tolerance X] ranks CSV to a JSON report
"""

# Names, kinds and defaults; ... marks what must be given.
COMMANDS: dict[str, dict] = {
    "preprocess": {"input": (str, ...), "graph-dir": (str, ...), "work-dir": (str, None), "memory-mib": (int, 128), "threads": (int, None), "shards": (int, None)},
    "pagerank": {"graph-dir": (str, ...), "output": (str, ...), "damping": (float, 0.85), "tolerance": (float, 1e-8), "max-iterations": (int, 100), "iterations": (int, None), "threads": (int, None), "memory-mib": (int, 128)},
    "validate": {"input": (str, ...), "expected": (str, None), "sum-tolerance": (float, 1e-10), "relative-tolerance": (float, 1e-4)},
}
LEAST_MEMORY_MIB, MOST_SHARDS = 32, 1_000_000
#: How numbers are spelled; further ranges are checked where they are used.
PLAIN = {int: r"-?[0-9]+", float: r"-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|-?(?:nan|inf|infinity)"}


class UsageError(ValueError):
    """A command line that can't be run."""


def options(command: str, args: list[str]) -> dict:
    known, given = COMMANDS[command], {}
    if len(args) % 2:
        raise UsageError("options come as --name value pairs")
    for name, value in zip(args[::2], args[1::2]):
        if not name.startswith("--") or name[2:] not in known:
            raise UsageError(f"unknown option for {command}: {name}")
        if name[2:] in given:
            raise UsageError(f"{name} is given twice")
        kind = known[name[2:]][0]
        try:
            if kind is not str and not re.fullmatch(PLAIN[kind], value):
                raise ValueError
            given[name[2:]] = kind(value)
        except ValueError:
            raise UsageError(f"{name} needs a number, not {value!r}") from None
    for name, (_, default) in known.items():
        if name not in given:
            if default is ...:
                raise UsageError(f"{command} needs --{name}")
            given[name] = default
    return given


def check_preprocess(o: dict) -> None:
    if o["memory-mib"] < LEAST_MEMORY_MIB:
        raise UsageError(f"memory-mib must be at least {LEAST_MEMORY_MIB}")
    for name in ("threads", "shards"):
        if o[name] is not None and o[name] < 1:
            raise UsageError(f"{name} must be positive")
    if (o["shards"] or 1) > MOST_SHARDS:
        raise UsageError(f"shards must be at most {MOST_SHARDS}")
    graph, work = (Path(os.path.normpath(os.path.abspath(p))) for p in (o["graph-dir"], o["work-dir"] or o["graph-dir"] + ".work"))
    if work == graph or graph in work.parents:
        raise UsageError("work-dir must be outside graph-dir")
    if not os.path.isfile(o["input"]):
        raise UsageError(f"{o['input']} is no regular file")
    if os.path.exists(o["graph-dir"]):
        raise UsageError(f"{o['graph-dir']} exists already")


def session(o: dict):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        builder = SparkSession.builder.appName("larkspur").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        if "spark.master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
            builder = builder.master(f"local[{o.get('threads') or '*'}]")
        spark = builder.getOrCreate()
    if o.get("memory-mib"):
        # Half of a thread's memory for a piece; the other half for what is made of it.
        piece = max(1, o["memory-mib"] // (2 * (o.get("threads") or spark.sparkContext.defaultParallelism)))
        for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
            spark.conf.set(name, f"{piece}m")
    return spark


def preprocess(o: dict) -> None:
    from larkspur.operators.graph import build_graph
    from larkspur.sources.edges import ingest
    from larkspur.sources.staging import Staging
    from larkspur.sources.storage import write_graph

    check_preprocess(o)
    spark = session(o)
    with Staging(spark) as staging:
        graph = build_graph(ingest(spark, o["input"], staging)[0], staging)
        staging.kept.clear()  # what is written below is all that stays
        manifest = write_graph(graph, o["graph-dir"], o["shards"] or 4 * (o["threads"] or os.cpu_count() or 1), o["input"])
    print(f"vertices={manifest.vertex_count} edges={manifest.edge_count} duplicates={manifest.duplicate_edge_count} self_loops={manifest.self_loop_count} shards={len(manifest.shards)}")


def pagerank(o: dict) -> None:
    from larkspur.operators.pagerank import Options, run_prepared
    from larkspur.sources.storage import check_output, read_graph, validate_graph, write_ranks

    chosen = Options(damping=o["damping"], tolerance=o["tolerance"], max_iterations=o["max-iterations"], iterations=o["iterations"])
    chosen.check()
    spark = session(o)
    check_output(spark, o["output"])
    validate_graph(spark, o["graph-dir"])
    graph, _ = read_graph(spark, o["graph-dir"])
    say = lambda t: print("iteration={iteration} residual_l1={residual_l1:.17g} rank_sum={rank_sum:.17g} seconds={seconds:.3f} edges_per_second={edges_per_second:.0f}".format(**t), file=sys.stderr)
    result = run_prepared(graph, chosen, say)
    write_ranks(result.ranks, o["output"])
    print(f"iterations={result.iterations} residual_l1={result.residual_l1:.17g} rank_sum={result.rank_sum:.17g}")


def validate(o: dict) -> None:
    from larkspur.operators.validate import check_order, read_expected, read_ranks, report

    for name in ("sum-tolerance", "relative-tolerance"):
        if not o[name] >= 0:
            raise UsageError(f"{name} must not be negative")
    spark = session(o)
    ranks = read_ranks(spark, o["input"])
    check_order(spark, o["input"])
    found = report(ranks, read_expected(spark, o["expected"]) if o["expected"] else None, o["relative-tolerance"], o["sum-tolerance"])
    print(json.dumps({k: None if isinstance(v, float) and not math.isfinite(v) else v for k, v in found.items()}))


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    if not args:
        print(HELP, end="")
        return 1
    if args[0] in ("--help", "-h"):
        print(HELP, end="")
        return 0
    try:
        if args[0] not in COMMANDS:
            raise UsageError(f"unknown command: {args[0]}")
        {"preprocess": preprocess, "pagerank": pagerank, "validate": validate}[args[0]](options(args[0], args[1:]))
    except Exception as error:  # noqa: BLE001
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
