import re

import numpy as np
import pytest

from larkspur.llm import near
from larkspur.llm.common import Stage

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain(rows, size, similarity):
    """doc_id, set size and component by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            both = len(sets[i] & sets[j])
            if rows[i][0] is None or rows[j][0] is None:
                continue
            if (same and sets[i] == sets[j] and sets[i]) or (both and 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both)):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i), d) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("small, block", [(near.SMALL, near.BLOCK), (2, 3)])
def test_equal_brute_force(docs, prose, monkeypatch, small, block):
    monkeypatch.setattr(near, "SMALL", small)  # 2: nodes branch to the last depth
    monkeypatch.setattr(near, "BLOCK", block)  # 3: groups are compared in many blocks
    rows = [r for r in prose(7, n=30) if r[0] is not None]
    base = rows[0][1].split()
    for k in range(25):  # a chain of edits
        base = base[:]
        base[(5 * k) % len(base)] = f"edit{k}"
        rows.append((200 + k, " ".join(base)))
    rows = list({d: (d, t) for d, t in rows}.values())
    got = near.near_duplicates(docs(rows), 4, 80).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows, 4, 80))


def test_rows_without_id_and_repeated_ids(docs):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(5, text), (5, text), (3, text.upper()), (None, text), (8, None), (9, ""), (9, "two words"), (10, "Two  words")]
    got = near.near_duplicates(docs(rows), 4, 80).collect()
    assert len(got) == len(rows)
    found = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), str(r["kept"])) for r in got)
    assert found == sorted([("5", 27, "3", "False")] * 2 + [("3", 27, "3", "True"), ("None", 27, "3", "None"), ("8", 0, "8", "True"), ("9", 0, "9", "True"), ("9", 1, "9", "True"), ("10", 1, "9", "False")])
    kept = near.keep_one(docs(rows), 4, 80)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "8", "9", "9", "None"] and kept.columns == docs(rows).columns


def test_one_id_with_several_texts(docs):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(3, a), (5, a), (5, b), (7, b)]
    got = near.near_duplicates(docs(rows), 4, 80).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(3, 3), (5, 3), (5, 5), (7, 5)]
    assert sorted((r["doc_id"], r["text"][0]) for r in near.keep_one(docs(rows), 4, 80).collect()) == [(3, "a"), (5, "b")]
    rows = [(3, a + " more"), (5, a), (5, b), (7, b + " more")]
    got = near.near_duplicates(docs(rows), 4, 80).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(3, 3), (5, 3), (5, 5), (7, 5)]


def test_one_of_identical_rows_stays(docs):
    rows = [(5, "one and the same text " * 9)] * 3 + [(6, "another text of its own " * 9), (7, ""), (7, "")]
    assert sorted(r["doc_id"] for r in near.keep_one(docs(rows), 4, 80).collect()) == [5, 6, 7, 7]
    clash = docs(rows).withColumnsRenamed({"tag": "key_1", "place": "mark_id", "known": "stays"})
    kept = near.keep_one(clash, 4, 80)
    assert kept.columns == clash.columns and kept.count() == 4


def edited_copies(n, seed):
    """A text and copies of it with 1 to 12 words replaced, some of them by words that several copies share."""
    rng = np.random.default_rng(seed)
    base, rows = [f"w{k}" for k in range(150)], []
    for d in range(n):
        words = base[:]
        for at in rng.integers(0, 150, rng.integers(1, 13)):
            words[at] = f"shared{rng.integers(4)}" if rng.random() < 0.3 else f"own{d}x{at}"
        rows.append((d, " ".join(words)))
    return rows


def test_large_group_of_edited_copies_loses_no_link(docs):
    rows = edited_copies(700, 3)
    got = near.near_duplicates(docs(rows), 4, 80).select("doc_id", "n_shingles", "component_id").collect()
    want = plain(rows, 4, 80)
    assert len({c for _, _, c in want}) > 50 and sorted(map(tuple, got)) == sorted(want)


def test_screens_keep_linked_sets():
    assert near.needed(80)[20] == 4 and near.needed(80)[0] == 0
    assert all(a <= b <= a + 1 for a, b in zip(near.needed(80), near.needed(80)[1:]))


def test_empty(docs):
    assert near.near_duplicates(docs([(1, "x")]).limit(0)).count() == 0


def test_trees_meet_the_recall_they_promise():
    rng = np.random.default_rng(1)
    met = [0, 0, 0]
    for _ in range(60):
        core = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        a = np.unique(np.concatenate((core, rng.integers(0, 1 << 63, 11, dtype=np.uint64))))
        b = np.unique(np.concatenate((core, rng.integers(0, 1 << 63, 11, dtype=np.uint64))))
        for d, ((_, x), (_, y)) in enumerate(zip(near.paths(a, 80, 20, 3), near.paths(b, 80, 20, 3))):
            met[d] += bool(np.isin(x, y).any())
    assert met == [60, 60, 60]


def test_components(spark):
    stage = Stage(spark)
    pairs = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in near.components(spark.createDataFrame(pairs, "a long, b long"), stage).collect()}
    assert all(got[k] == 0 for k in range(1, 41)) and got[101] == got[102] == 100
