import random

import pytest

from larkspur.operators import graph as G
from larkspur.operators import shards as S

SMALL = [(10, -2), (10, 5), (10, 5), (-2, 5), (5, 5), (100, 10)]


def test_small_graph(edges):
    g = G.build_graph(edges(*SMALL))
    assert g.summary == {"vertex_count": 4, "input_edge_count": 6, "edge_count": 5, "duplicate_edge_count": 1, "self_loop_count": 1}
    assert sorted(map(tuple, g.vertices.select("dense", "vertex", "outdeg").collect())) == [(0, -2, 1), (1, 5, 1), (2, 10, 2), (3, 100, 1)]
    assert sorted(map(tuple, g.edges.collect())) == [(0, 2), (1, 0), (1, 1), (1, 2), (2, 3)]
    plan = S.plan_shards(g.edges, 4, 6, 3)
    assert plan == [S.Shard(0, 2, 4), S.Shard(2, 4, 1)]
    S.check_shards(plan, 4, 5)
    assert not any(G.integrity(g).first())


def test_no_edges(edges):
    with pytest.raises(ValueError, match="no edges"):
        G.build_graph(edges().limit(0))


def greedy(pull, n_vertices, n_input, shards):
    """The sequential rule: a shard ends at the next destination once it has its share."""
    share, out, begin, count, last = max(1, -(-n_input // shards)), [], 0, 0, None
    for dst, _ in sorted(pull):
        if dst != last and count >= share and len(out) + 1 < shards:
            out.append(S.Shard(begin, dst, count))
            begin, count = dst, 0
        count, last = count + 1, dst
    return [*out, S.Shard(begin, n_vertices, count)]


@pytest.mark.parametrize("seed", range(4))
def test_shards_equal_the_sequential_rule(edges, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(-9, 9), rng.randint(-9, 9)) for _ in range(rng.randint(1, 60))]
    g = G.build_graph(edges(*rows))
    pull = [tuple(r) for r in g.edges.collect()]
    n = rng.choice([1, 2, 5, 100])
    plan = S.plan_shards(g.edges, g.summary["vertex_count"], len(rows), n)
    assert plan == greedy(pull, g.summary["vertex_count"], len(rows), n)
    place = {r["dst"]: r["shard"] for r in S.assign_shards(g.edges, plan).collect()}
    assert all(plan[s].vertex_begin <= d < plan[s].vertex_end for d, s in place.items())


def test_many_buckets_number_like_one(edges, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.randint(-500, 500), rng.randint(-500, 500)) for _ in range(400)]
    one = sorted(map(tuple, G.dense_vertices(G.vertex_ids(edges(*rows))).collect()))
    monkeypatch.setattr(G, "BUCKET_ROWS", 50)
    many = sorted(map(tuple, G.dense_vertices(G.vertex_ids(edges(*rows))).collect()))
    assert one == many == [(k, v) for k, v in enumerate(sorted({x for e in rows for x in e}))]
    g = G.build_graph(edges(*rows))
    table = sorted(map(tuple, S.edges_before(g.edges).collect()))
    total = 0
    for dst, n, before in table:
        assert before == total
        total += n


def test_more_shards_than_a_condition_holds(edges, monkeypatch):
    monkeypatch.setattr(S, "INLINE", 1)
    g = G.build_graph(edges(*SMALL))
    plan = S.plan_shards(g.edges, 4, 6, 3)
    assert sorted((r["dst"], r["shard"]) for r in S.assign_shards(g.edges, plan).collect()) == [(0, 0), (1, 0), (1, 0), (1, 0), (2, 1)]
