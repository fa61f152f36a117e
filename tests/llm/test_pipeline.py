import hashlib
import re
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from larkspur.llm import bpe
from tests.llm.test_near import plain as plain_components

corpus_pipeline = pytest.importorskip("corpus_pipeline")

ITEM = "Which of the seven green bottles on the old wall would be the first one to fall down when the wind turns north again?"


def plain_lines(rows, depth=2, least=5, short=20, wide=10, cover=0.5):
    """Rows without the lines of recurring templates, by counting in dictionaries."""
    lines, leaves, holders = defaultdict(dict), defaultdict(set), defaultdict(set)
    for text in {t for _, t in rows if t is not None}:
        for i, raw in enumerate(text.split("\n")):
            shown = tuple(re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", "<*>", raw)))
            if shown:
                lines[text][i] = shown
                leaves[len(shown), shown[:depth]].add(text)
                holders[shown].add(text)
    inside = defaultdict(list)
    for shown in holders:
        if len(leaves[len(shown), shown[:depth]]) >= least:
            inside[len(shown), shown[:depth]].append(shown)
    names = defaultdict(list)  # of a line: its templates, and how many texts each needs
    for (n, lead), kinds in inside.items():
        seen = Counter()
        for shown in kinds:
            for i in range(depth, n):
                seen[i, shown[i]] += len(holders[shown])
        for shown in kinds:
            enough = least if n > depth else short
            if len(holders[shown]) >= enough:
                names[shown].append((shown, enough))
            constants = tuple((i, shown[i]) for i in range(depth, n) if shown[i] != "<*>" and seen[i, shown[i]] >= least)
            general = n > depth and len(kinds) > 1 and sum(len(holders[k]) for k in kinds) >= wide
            if general and constants and 2 * (len(constants) + sum(x != "<*>" for x in lead)) > n:
                names[shown].append(((n, lead, constants), wide))

    def often(texts):
        held = defaultdict(set)
        for t in texts:
            for shown in lines[t].values():
                for name in names[shown]:
                    held[name].add(t)
        return {name for name, found in held.items() if len(found) >= name[1]}

    recurring = often(lines)
    hit = lambda t, among: {i for i, shown in lines[t].items() if any(x in among for x in names[shown])}
    size = lambda t, places: sum(len(lines[t][i]) for i in places)
    hosts = [t for t in lines if hit(t, recurring) and size(t, hit(t, recurring)) <= cover * size(t, lines[t])]
    gone = recurring & often(hosts)
    cut = lambda t: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in hit(t, gone))
    return [(d, None if t is None else cut(t)) for d, t in rows]


def test_equals_a_plain_version(spark, docs, prose, tmp_path):
    rows = {d: t for d, t in prose(21, n=25) if d is not None}
    for k in range(12):
        name = chr(97 + k)
        rows[300 + k] = f"Start {name}{name} of the text number{name}\nPage {k} of 40, all rights reserved\nThen {name} comes the rest {name * 3} of it"
    rows[400] = "Here we ask. " + ITEM + " And so on."
    rows = list(rows.items())
    docs(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = {}
    real = dict(corpus_pipeline.STAGES)
    for name, apply in corpus_pipeline.STAGES:
        assert real[name] is apply
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = [(d, t) for d, t in rows if t and re.search(r"[^\W\d_]", t)]
    left = plain_lines(left)
    assert sum("reserved" in t for _, t in left) == 0
    kept = {d for d, _, c in plain_components(left, 5, 80) if d == c}
    left = [(d, t) for d, t in left if d in kept and ITEM not in t]
    library = Tokenizer.from_file(bpe.VOCABULARY)
    assert got.keys() == {d for d, _ in left} and 400 not in got
    for d, t in left:
        ids = library.encode(t, add_special_tokens=False).ids
        seen[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == seen[d]


def test_stages_keep_the_columns(spark, docs, prose, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = docs(prose(22, n=8)).select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (table, table.limit(0)):
        for name, apply in corpus_pipeline.STAGES[:-1]:
            assert apply(spark, rows, str(tmp_path)).columns == table.columns, name
