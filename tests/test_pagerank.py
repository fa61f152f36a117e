import math
import os
from pathlib import Path

import pytest

from larkspur.operators import graph as G
from larkspur.operators import pagerank as P
from larkspur.operators import validate as V


def ranks(result):
    return {r["vertex"]: r["rank"] for r in result.ranks.collect()}


def test_dangling_mass_is_spread(edges):
    got = P.run(edges((1, 2)), P.Options(tolerance=1e-13, max_iterations=200))
    found = ranks(got)
    assert math.isclose(found[1], 0.3508771929824561, abs_tol=1e-12) and math.isclose(found[2], 0.6491228070175439, abs_tol=1e-12)
    assert got.iterations == 35 and got.residual_l1 <= 1e-13 and abs(got.rank_sum - 1) <= 1e-14


def test_known_values(edges):
    found = ranks(P.run(edges((10, -2), (10, 5), (10, 5), (-2, 5), (5, 5), (100, 10)), P.Options(iterations=20)))
    want = {-2: 0.066984375, 5: 0.826140625, 10: 0.069375, 100: 0.0375}
    assert found.keys() == want.keys() and all(math.isclose(found[k], want[k], abs_tol=1e-12) for k in want)
    found = ranks(P.run(edges((1, 2), (2, 1), (3, 1), (3, 2)), P.Options(iterations=10)))
    assert all(math.isclose(found[k], v, abs_tol=1e-12) for k, v in {1: 0.475, 2: 0.475, 3: 0.05}.items())


def test_same_bits_for_any_partitioning(spark, edges):
    rows = [(a, b) for a in range(1, 30) for b in range(1, 30) if (a * 7 + b * 11) % 5 < 2]
    seen = []
    for parts in (1, 3, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        for layout in ("dst", "src"):
            got = P.run(edges(*rows).repartition(parts), P.Options(iterations=4, edge_layout=layout))
            seen.append((sorted(ranks(got).items()), [(t["residual_l1"], t["rank_sum"]) for t in got.trace]))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(s == seen[0] for s in seen)


def test_hub(spark):
    n = 50_000
    both = spark.range(1, n + 1).selectExpr("explode(array(struct(0 AS src, int(id) AS dst), struct(int(id) AS src, 0 AS dst))) AS e").select("e.*")
    got = P.run(both, P.Options(iterations=3))
    found = ranks(got)
    assert len(found) == n + 1 and abs(got.rank_sum - 1) <= 1e-12
    assert math.isclose(found[0], 0.7416153351932961, rel_tol=1e-12) and math.isclose(found[7], 5.167693296134078e-06, rel_tol=1e-10)


@pytest.mark.parametrize("bad", [{"damping": 0.0}, {"damping": 1.0}, {"damping": math.nan}, {"iterations": 0}, {"tolerance": 0.0}, {"tolerance": math.nan}, {"tolerance": math.inf}, {"max_iterations": 0}, {"accumulator": "float"}])
def test_options_are_checked(edges, bad):
    with pytest.raises(ValueError):
        P.run(edges((1, 2)), P.Options(**bad))


def test_tolerance_means_nothing_with_fixed_iterations(edges):
    assert P.run(edges((1, 2)), P.Options(iterations=2, tolerance=math.nan, max_iterations=0)).iterations == 2


def test_not_converged(edges):
    with pytest.raises(P.NotConverged):
        P.run(edges((1, 2)), P.Options(max_iterations=3))


def test_comparison_and_report(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "vertex int, rank double")
    good = frame((1, 0.25), (2, 0.75))
    assert V.report(good, frame((1, 0.25), (2, 0.75)))["maximum_absolute_error"] == 0.0
    for bad in (frame((1, 0.25), (2, 0.7)), frame((1, -0.25), (2, 1.25)), frame((1, 0.5), (1, 0.5)), frame((1, math.nan), (2, 1.0)), good.limit(0)):
        with pytest.raises(V.ValidationError):
            V.report(bad)
    for other in (frame((1, 0.25)), frame((1, 0.25), (3, 0.75)), frame((1, 0.26), (2, 0.74))):
        with pytest.raises(V.ValidationError):
            V.report(good, other)
    assert V.compare(frame((1, 0.0), (2, 1.0)), frame((1, 0.0), (2, 1.0))).first()["maximum_relative_error"] == 0.0
    assert V.compare(frame((1, 0.1)), frame((1, 0.0))).first()["maximum_relative_error"] == math.inf


def plain(pairs, steps, damping=0.85):
    """Power iteration in dictionaries."""
    unique = set(pairs)
    ids = {v for e in unique for v in e}
    degree = {v: sum(a == v for a, _ in unique) for v in ids}
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(steps):
        lost = math.fsum(rank[v] for v in ids if not degree[v])
        come = {v: [] for v in ids}
        for a, b in unique:
            come[b].append(rank[a] / degree[a])
        rank = {v: (1 - damping) / len(ids) + damping * lost / len(ids) + damping * math.fsum(come[v]) for v in ids}
    return rank


PAIRS = [(a, b) for a in range(1, 25) for b in range(1, 25) if (a * 7 + b * 11) % 5 < 2] + [(0, k) for k in range(1, 60)] + [(k, 0) for k in range(1, 40)] + [(3, 3), (0, 1)]


@pytest.mark.parametrize("layout, threshold", [("auto", "10m"), ("auto", "-1"), ("dst", "-1"), ("src", "1k")])
def test_hubs_are_dealt_out(spark, edges, monkeypatch, layout, threshold):
    monkeypatch.setattr(P, "HUB", 7)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = ranks(P.run(edges(*PAIRS), P.Options(iterations=6, edge_layout=layout)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = plain(PAIRS, 6)
    assert found.keys() == want.keys() and all(math.isclose(found[v], want[v], rel_tol=1e-12) for v in want)


def test_prepared_graphs_are_ranked_as_they_are(edges):
    found = ranks(P.run_prepared(G.build_graph(edges(*PAIRS)), P.Options(iterations=9)))
    want = plain(PAIRS, 9)
    assert found.keys() == want.keys() and all(math.isclose(found[v], want[v], rel_tol=1e-12) for v in want)


def exchanges(plan):
    """Exchanges of a plan above its cached tables."""
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        return exchanges(plan.executedPlan())
    if "TableCache" in plan.nodeName() or plan.nodeName().startswith("InMemoryTableScan"):
        return 0
    below = plan.children()
    return plan.nodeName().startswith("Exchange") + sum(exchanges(below.apply(k)) for k in range(below.size()))


@pytest.mark.parametrize("hub, expected", [(P.HUB, 1), (7, 2)])
def test_edges_are_not_shuffled_in_a_step(spark, edges, monkeypatch, hub, expected):
    """Without broadcasts the only exchange is that of partial sums (and, for hubs, of the repeated ranks)."""
    monkeypatch.setattr(P, "HUB", hub)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        unique = edges(*PAIRS).distinct()
        degrees = G.outdegrees(unique, G.vertex_ids(unique)).repartition(4, "vertex").cache()
        dealt = P._dealt(unique, degrees, "src")
        state = P.initial(degrees, 60).repartition(4, "vertex").sortWithinPartitions("vertex").cache()
        dealt.count(), state.count()
        assert exchanges(P.step(dealt, state, 0.85, 0.1)._jdf.queryExecution().executedPlan()) == expected
        for table in (dealt, state, degrees):
            table.unpersist()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.skipif("LDBC_PR_DIR" not in os.environ, reason="LDBC_PR_DIR names the folder of the public Graphalytics PageRank example")
def test_graphalytics_example(spark, tmp_path):
    from larkspur.sources.edges import read_edges

    where = Path(os.environ["LDBC_PR_DIR"])
    want = {int(v): float(r) for v, r in (x.split() for x in (where / "test-pr-directed-PR").read_text().splitlines() if x.strip())}
    found = ranks(P.run_prepared(G.build_graph(read_edges(spark, str(where / "test-pr-directed.e"))), P.Options(iterations=14)))
    assert len(want) == 50 and found.keys() == want.keys()
    assert max(abs(found[v] - r) / abs(r) for v, r in want.items()) <= 1e-4


def test_readers_name_the_line(spark, tmp_path):
    def written(text):
        (tmp_path / "f").write_text(text)
        return str(tmp_path / "f")

    assert [tuple(r) for r in V.read_ranks(spark, written("vertex,rank\n1,0.5\n2,0.5\n")).collect()] == [(1, 0.5), (2, 0.5)]
    assert V.read_ranks(spark, written("vertex,rank\n")).count() == 0
    for text, line in (("vertex,rank\n1,0.5\nvertex,rank\n", 3), ("vertex,rank\n1,0.5,7\n", 2), ("vertex,rank\n1,0.5\n2,x\n", 3), ("vertex,rank\n1\n", 2)):
        with pytest.raises(V.ValidationError, match=f":{line}:"):
            V.read_ranks(spark, written(text))
    for text in ("", "rank,vertex\n1,2\n", "1,0.5\n"):
        with pytest.raises(V.ValidationError, match="header"):
            V.read_ranks(spark, written(text))
    assert [tuple(r) for r in V.read_expected(spark, written("# c\nVertex rank\n 1 0.5\n\n2 , 0.5\n3\t1e-3\n")).collect()] == [(1, 0.5), (2, 0.5), (3, 0.001)]
    for text, line in (("1 0.5\nvertex rank\n", 2), ("# c\n1 0.5 6\n", 2), ("1 0.5\n2\n", 2)):
        with pytest.raises(V.ValidationError, match=f":{line}:"):
            V.read_expected(spark, written(text))
