import json
import shutil

import pytest
from pyspark.sql import functions as F

from larkspur import cli
from larkspur.operators import graph as G
from larkspur.operators import shards
from larkspur.operators.shards import Shard, plan_shards
from larkspur.sources import storage as S

TEXT = "from,to\n10,-2\n10,5\n10,5\n-2,5\n5,5\n100,10\n"


def test_manifest_round_trip():
    m = S.Manifest("x", 5, 7, 6, 1, 2, (Shard(0, 3, 4), Shard(3, 5, 2)))
    assert S.Manifest.from_json(m.to_json()) == m
    for change in ({"version": 9}, {"format": "other"}):
        with pytest.raises(S.StorageError):
            S.Manifest.from_json(json.dumps(json.loads(m.to_json()) | change))
    with pytest.raises(S.StorageError):
        S.Manifest.from_json("{}")


def test_graph_is_published_whole_and_once(spark, edges, tmp_path):
    g = G.build_graph(edges((1, 2), (2, 3), (3, 1)))
    where = str(tmp_path / "g")
    manifest = S.write_graph(g, where, 2)
    assert S.validate_graph(spark, where) == manifest
    assert sorted(map(tuple, S.original_edges(S.read_graph(spark, where)[0]).collect())) == [(1, 2), (2, 3), (3, 1)]
    with pytest.raises(S.StorageError):
        S.write_graph(g, where, 2)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["g"]


def test_tampered_graph_is_noticed(spark, edges, tmp_path):
    where = tmp_path / "g"
    S.write_graph(G.build_graph(edges((1, 2), (2, 3), (3, 1))), str(where), 1)
    found = json.loads((where / "manifest.json").read_text())
    (where / "manifest.json").write_text(json.dumps(found | {"vertex_count": 4, "shards": [found["shards"][0] | {"vertex_end": 4}]}))
    for crc in where.glob(".manifest.json.crc"):
        crc.unlink()
    with pytest.raises(S.StorageError):
        S.validate_graph(spark, str(where))


def test_edges_that_break_a_promise_are_noticed(spark, edges, tmp_path):
    for k, bad in enumerate(([(1, 0, 0), (2, 1, 0), (0, 2, 0)], [(1, 0, 0), (1, 0, 0), (0, 2, 0)], [(1, 0, 0), (2, 9, 0), (0, 2, 0)], [(1, 0, 0), (2, 0, 0), (0, 2, 0)])):
        where = tmp_path / f"g{k}"
        S.write_graph(G.build_graph(edges((1, 2), (2, 3), (3, 1))), str(where), 1)
        shutil.rmtree(where / "edges")
        spark.createDataFrame(bad, "dst long, src long, shard int").write.partitionBy("shard").parquet(str(where / "edges"))
        if k:
            with pytest.raises(S.StorageError):
                S.validate_graph(spark, str(where))
        else:
            S.validate_graph(spark, str(where))


def test_hub_is_prepared_alike_for_any_partitioning(spark):
    both = spark.range(1, 40_001).selectExpr("explode(array(struct(0 AS src, int(id) AS dst), struct(int(id) AS src, 0 AS dst))) AS e").select("e.*")
    seen = []
    for parts in (1, 5):
        graph = G.build_graph(both.repartition(parts))
        plan = plan_shards(graph.edges, graph.summary["vertex_count"], graph.summary["input_edge_count"], 8)
        seen.append((graph.summary, plan, graph.edges.agg(F.sum(F.xxhash64("dst", "src").cast("decimal(38,0)"))).first()[0], graph.vertices.where("vertex = 0").first()))
    assert seen[0] == seen[1] and seen[0][0]["edge_count"] == 80_000 and seen[0][3]["outdeg"] == 40_000


def test_shards_are_the_same_looked_up_or_walked(spark, edges, monkeypatch):
    graph = G.build_graph(edges(*[(a, b % 17) for a in range(40) for b in range(a)]))
    walked = [plan_shards(graph.edges, graph.summary["vertex_count"], graph.summary["input_edge_count"], k) for k in (1, 3, 9)]
    monkeypatch.setattr(shards, "LOCAL", 0)
    assert walked == [plan_shards(graph.edges, graph.summary["vertex_count"], graph.summary["input_edge_count"], k) for k in (1, 3, 9)]


def test_ranks_csv(spark, tmp_path):
    ranks = spark.createDataFrame([(3, 0.1), (-1, 1e-7), (2, 0.35)], "vertex int, rank double")
    path = tmp_path / "r.csv"
    S.write_ranks(ranks, str(path))
    rows = path.read_text().splitlines()
    assert rows[0] == "vertex,rank"
    assert [(int(a), float(b)) for a, b in (r.split(",") for r in rows[1:])] == [(-1, 1e-7), (2, 0.35), (3, 0.1)]
    with pytest.raises(S.StorageError):
        S.write_ranks(ranks, str(path))
    (tmp_path / "s.csv.tmp").mkdir()
    for bad in (tmp_path / "s.csv", tmp_path / "none" / "r.csv"):
        with pytest.raises(S.StorageError):
            S.write_ranks(ranks, str(bad))


def run(*args):
    return cli.main([str(a) for a in args])


def test_commands_end_to_end(spark, tmp_path, capsys):
    (tmp_path / "e.csv").write_text(TEXT)
    assert run("preprocess", "--input", tmp_path / "e.csv", "--graph-dir", tmp_path / "g", "--shards", 3) == 0
    assert run("pagerank", "--graph-dir", tmp_path / "g", "--output", tmp_path / "r.csv", "--iterations", 20) == 0
    out = capsys.readouterr()
    assert "iterations=20 residual_l1=" in out.out and "edges_per_second" in out.err
    (tmp_path / "want").write_text("# expected\nvertex rank\n-2 0.066984375\n5,0.826140625\n10 0.069375\n100\t0.0375\n")
    assert run("validate", "--input", tmp_path / "r.csv", "--expected", tmp_path / "want") == 0
    assert json.loads(capsys.readouterr().out)["vertices"] == 4
    (tmp_path / "bad.csv").write_text("vertex,rank\n2,0.5\n1,0.5\n")
    assert run("validate", "--input", tmp_path / "bad.csv") == 2
    (tmp_path / "want").write_text("-2 0.07\n5,0.826140625\n10 0.069375\n100\t0.0375\n")
    assert run("validate", "--input", tmp_path / "r.csv", "--expected", tmp_path / "want") == 2
    assert run("validate", "--input", tmp_path / "r.csv", "--expected", tmp_path / "want", "--relative-tolerance", 0.5) == 0
    assert run("validate", "--input", tmp_path / "r.csv", "--sum-tolerance", -1) == 2


def test_failed_runs_leave_nothing(spark, tmp_path, capsys):
    (tmp_path / "e.csv").write_text("1,2\n")
    graph, out = tmp_path / "g", tmp_path / "r.csv"
    assert run("preprocess", "--input", tmp_path / "e.csv", "--graph-dir", graph) == 0
    for extra in (("--damping", 0), ("--damping", 1), ("--damping", "nan"), ("--iterations", 0), ("--tolerance", 0), ("--max-iterations", 2)):
        assert run("pagerank", "--graph-dir", graph, "--output", out, *extra) == 2
        assert not out.exists()
    assert run("preprocess", "--input", tmp_path / "e.csv", "--graph-dir", graph) == 2


def test_usage(tmp_path, capsys):
    assert run() == 1 and run("--help") == 0 and run("-h") == 0
    (tmp_path / "e.csv").write_text("1,2\n")
    base = ("preprocess", "--input", tmp_path / "e.csv", "--graph-dir", tmp_path / "g")
    for bad in (("nope",), ("preprocess",), (*base, "--shards"), (*base, "--shards", "x"), (*base, "--shards", 0), (*base, "--shards", 1, "--shards", 1), (*base, "--odd", 1), (*base, "--memory-mib", 31), (*base, "--shards", "1_000"), (*base, "--shards", "+3"), ("pagerank", "--graph-dir", tmp_path / "g", "--output", tmp_path / "r", "--damping", "0_1"), (*base, "--threads", 0), (*base, "--shards", 1_000_001), (*base, "--work-dir", tmp_path / "g" / "w"), (*base, "--work-dir", tmp_path / "g")):
        assert run(*bad) == 2
    assert run("preprocess", "--input", tmp_path, "--graph-dir", tmp_path / "g") == 2
    assert not (tmp_path / "g").exists()
