import math
import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import language, quality, toxicity
from larkspur.llm.common import Stage


def corpus(n=240):
    rng = random.Random(2)
    sounds = {"en": ["the", "ing", "th", "er", "and"], "de": ["sch", "ein", "ung", "ü", "keit"], "fr": ["é", "eau", "que", "oi", "è"]}
    out = []
    for d in range(n):
        lang = rng.choice(sorted(sounds))
        text = " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 60)))
        out.append((d, text, lang))
    return out


def test_languages_are_told_apart(docs):
    rows = corpus()
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !?", "de"), (1003, "the", None), (1004, rows[0][1] * 50, None), (None, rows[0][1], "en"), (1, rows[1][1], rows[1][2])]
    table = docs(rows + odd)
    model = language.train(table)
    out = language.identify(table, model).collect()
    assert len(out) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in out}
    assert np.mean([by[d]["lang_pred"] == lang for d, _, lang in rows]) > 0.97
    for d in (1000, 1001, 1002):
        assert (by[d]["lang_pred"], by[d]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in out) and by[1004]["lang_pred"] == by[0]["lang_pred"] == by[None]["lang_pred"]
    assert language.identify(table.limit(0), model).count() == 0
    unknown = language.train(table.where("doc_id IS NULL AND lang = 'xx'"))
    assert {r["lang_pred"] for r in language.identify(table.limit(5), unknown).collect()} == {"und"}


def test_codewords_differ_in_most_bits():
    for n in (1, 2, 3, 4, 5, 20):
        code = language.codewords(n)
        assert len(code) == n
        for i in range(n):
            for j in range(i):
                assert (code[i] != code[j]).sum() >= max(1, code.shape[1] // 4)


def plain_segments(scores):
    """Repeatedly the best part of what is left, by looking at all of them."""
    if not len(scores) or max(scores) <= 0:
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    best = max(((total[j] - total[i], -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    i, j = best[3], best[4]
    left, right = plain_segments(scores[:i]), plain_segments(scores[j:])
    return left + [(i, j)] + [(a + j, b + j) for a, b in right]


def test_segments_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        scores = np.round(rng.normal(-0.2, 1, rng.integers(0, 25)), 3)
        assert [(a, b) for a, b, _ in toxicity.segments(scores)] == plain_segments(scores)


def test_toxic_words_are_learned(spark, docs):
    rng = random.Random(4)
    plain = [f"w{k}" for k in range(400)]
    names = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in plain]
    rows, labels = [], []
    for d in range(600):
        words = [rng.choice(names) for _ in range(rng.randint(30, 120))]
        bad = d % 5 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vileword", "nastyword", "badword"]))
        rows.append((d, " ".join(words)))
        labels.append((d, int(bad)))
    odd = [(2000, None), (2001, ""), (2002, "vileword " * 3000), (None, "badword nastyword vileword"), (3, rows[3][1])]
    table, marks = docs(rows + odd), spark.createDataFrame(labels + [(4, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(table, marks)
    out = toxicity.score(table, model).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert np.mean([by[d]["predicted"] == y for d, y in labels]) > 0.97
    assert by[2000]["predicted"] == by[2001]["predicted"] == 0 and by[2002]["predicted"] == 1
    found = toxicity.passages(table, model).where("doc_id = 0").collect()
    assert found and all("word" in r["passage"] for r in found)
    assert toxicity.score(table.limit(0), model).count() == 0
    none = toxicity.train(table, marks.limit(0))
    assert {r["score"] for r in toxicity.score(table.limit(3), none).collect()} == {0.0}


def test_sparse_sites_shrink(spark, docs, monkeypatch):
    rng = random.Random(6)
    rows = []
    for d in range(600):
        good = rng.random() < (0.9 if d % 3 else 0.2)
        rows.append((d, "a calm line of text here\n" * 1 + " ".join(f"w{rng.randrange(99)}" for _ in range(30)) if good else "%%% $$$ BUY!! " * 20))
    table = docs(rows + [(None, "x"), (900, None), (901, "")]).selectExpr("doc_id", "text", "CASE WHEN doc_id = 7 THEN 'rare' WHEN doc_id IS NOT NULL THEN source END AS host", "lang AS path", "kept")
    labels = spark.createDataFrame([(d, int("calm" in t)) for d, t in rows[:300]] + [(5, 0), (5, 1)], "doc_id long, quality int")
    out = quality.assess(table, labels).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 603 and all(0 <= r["score"] <= 1 for r in out)
    assert np.mean([by[d]["kept"] == ("calm" in t) for d, t in rows]) > 0.97
    assert by[3]["path_posterior"] < by[4]["path_posterior"] and by[3]["host_posterior"] < by["rare" and 7]["host_posterior"] < 0.95
    monkeypatch.setattr(quality, "SMALL", 0)  # the salted join
    again = {r["doc_id"]: round(r["score"], 9) for r in quality.assess(table, labels).collect()}
    assert again == {d: round(r["score"], 9) for d, r in by.items()}
    assert quality.assess(table.limit(0), labels).count() == 0
    assert quality.assess(table, labels.limit(0)).count() == 603


def tables(spark, where, docs, **others):
    """A folder of tables, as queries read them."""
    for name, table in {"documents": docs, **others}.items():
        table.write.parquet(f"{where}/{name}.parquet")
    return str(where)


def test_language_query_equals_a_plain_version(spark, docs, tmp_path):
    rows = corpus(400) + [(1000, None, "en"), (1001, "12 34", "de"), (1002, "Zug um Zug", None), (None, "the thing", "en")]
    rows += [(2000 + k, "kwyjibo qwop " * 9, "xx") for k in range(8)]  # a rare language
    where = tables(spark, tmp_path, docs(rows))
    model = language.train(spark.read.parquet(f"{where}/documents.parquet"))
    assert model.langs == ["de", "en", "fr", "xx"]
    got = {r["doc_id"]: r for r in language.op6_language_id(spark, where).collect()}
    for d, text, lang in rows:
        assert got[d]["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2)
        if text is None or not any(c.isalpha() for c in text):
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
            continue
        low = [c | 32 if 65 <= c <= 90 or 97 <= c <= 122 else 32 if c < 128 else c for c in b" " + text.encode() + b"  "]
        seen = [((((a << 16) | (b << 8) | c) * 2654435761) % (1 << 32)) >> 17 for a, b, c in zip(low, low[1:], low[2:])]
        margins = [math.fsum(float(model.weights[g][k]) for g in seen) / len(seen) * model.scale[k] for k in range(model.code.shape[1])]
        losses = [math.fsum(w * math.log1p(math.exp(-bit * m)) for w, bit, m in zip(model.loss_weight, code, margins)) for code in model.code]
        assert got[d]["lang_pred"] == model.langs[losses.index(min(losses))]
        assert abs(got[d]["score"] - 1 / math.fsum(math.exp(min(losses) - x) for x in losses)) < 1e-6
    judged = [(got[d]["lang_pred"], lang) for d, text, lang in rows if lang and got[d]["held_out"] and got[d]["lang_pred"] != "und"]
    assert len(judged) > 50 and np.mean([a == b for a, b in judged]) > 0.97


def test_toxicity_query_equals_a_plain_version(spark, docs, tmp_path):
    rng = random.Random(7)
    names = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    rows, labels = [], []
    for d in range(900):
        words = [rng.choice(names) for _ in range(rng.randint(20, 90))]
        bad = d % 4 == 0
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty", "foul"]))
        rows.append((d, " ".join(words)))
        labels.append((d, int(bad)))
    rows += [(3000, None), (3001, ""), (3002, " ".join(w for k in range(200) for w in ("vile", *names[:250]))), (None, "nasty foul")]
    where = tables(spark, tmp_path, docs(rows), labels=spark.createDataFrame(labels, "doc_id long, toxic int"))
    model = toxicity.train(spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet"))
    got = {r["doc_id"]: r for r in toxicity.op7_toxicity(spark, where).collect()}
    assert len(got) == len(rows)
    for d, text in rows[::9] + rows[-4:]:
        found = [w.lower() for w in (text or "").split()]
        values = np.array([model.scores.get(w, -toxicity.DRIFT) for w in found])
        total = np.concatenate(([0.0], np.cumsum(values)))
        parts = plain_segments(values) if len(found) < 200 else [(a, b) for a, b, _ in toxicity.segments(values)]
        assert d != 3002 or len(parts) > 50  # all segments of a long text count
        surprise = [model.rate * (total[b] - total[a]) - model.log_k - math.log(len(found)) for a, b in parts]
        x = (min(max(max(surprise), -20), 60), math.log1p(sum(min(max(s, 0), 60) for s in surprise))) if parts else (0.0, 0.0)
        want = 1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * x[0] + model.curve[2] * x[1])))
        assert abs(got[d]["score"] - want) < 1e-6 and got[d]["predicted"] == int(want >= 0.5), d
        assert got[d]["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 5 == 0)
    judged = [(got[d]["predicted"], y) for d, y in labels if got[d]["held_out"]]
    assert len(judged) > 100 and np.mean([a == b for a, b in judged]) > 0.95


def test_quality_equals_a_plain_version(spark, docs):
    rng = random.Random(9)
    rows, truth, sites = [], {}, {}
    for d in range(500):
        host = rng.choice(["a.org", "b.org", "c.org"]) if d % 50 else f"rare{d}.org"
        good = rng.random() < {"a.org": 0.9, "b.org": 0.5}.get(host, 0.2)
        text = " ".join(f"w{rng.randrange(99)}" for _ in range(30)) if good != (rng.random() < 0.15) else "%% $$ BUY!! " * 12
        rows.append((d, text))
        truth[d], sites[d] = int(good), (host, f"{host}/{d % 2}")
    of = spark.createDataFrame([(d, h, p) for d, (h, p) in sites.items()], "id long, host string, path string")
    table = docs(rows).select("doc_id", "text").join(of, F.col("doc_id") == F.col("id")).select("doc_id", "text", "host", "path")
    labels = spark.createDataFrame([(d, y) for d, y in truth.items() if d % 3], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.assess(table, labels).collect()}
    with Stage(spark) as stage:
        told = [r.asDict() for r in quality.classify(table, labels, stage)[0].collect()]
    fit = [r for r in told if r["fit"]]
    trust = np.corrcoef([r["evidence"] for r in fit], [r["quality"] for r in fit])[0, 1] ** 2
    said = {r["doc_id"]: (trust, trust * r["evidence"]) if r["quality"] is None else (1.0, r["quality"]) for r in told}

    def sums(level):
        out = defaultdict(lambda: [0.0, 0.0])
        for r in told:
            for k in (0, 1):
                out[r["host"], r["path"] if level else None][k] += said[r["doc_id"]][k]
        return out

    paths, hosts = sums(1), sums(0)
    mean = sum(g for _, g in hosts.values()) / sum(n for n, _ in hosts.values())

    def strength(groups):
        use = [(n, g / n, m) for n, g, m in groups if n >= 5]
        total = sum(n for n, _, _ in use)
        within = max(sum(n * p * (1 - p) for n, p, _ in use) / total, 1e-4)
        between = max((sum(n * (p - m) ** 2 for n, p, m in use) - sum(p * (1 - p) for _, p, _ in use)) / total, 1e-6)
        return min(max(within / between, 1.0), 1000.0)

    above = strength([(n, g, mean) for n, g in hosts.values()])
    posterior = {h: (g + above * mean) / (n + above) for (h, _), (n, g) in hosts.items()}
    within = strength([(n, g, posterior[h]) for (h, _), (n, g) in paths.items()])
    odds = lambda p: math.log(p / (1 - p))
    rest = {}
    for r in told:
        w, y = said[r["doc_id"]]
        (hn, hg), (pn, pg) = hosts[r["host"], None], paths[r["host"], r["path"]]
        host = (hg - y + above * mean) / (hn - w + above)
        rest[r["doc_id"]] = host, (pg - y + within * host) / (pn - w + within)
        assert np.allclose((got[r["doc_id"]]["host_posterior"], got[r["doc_id"]]["path_posterior"]), rest[r["doc_id"]], rtol=1e-6)
    x = np.array([[odds(min(max(r["evidence"], 1e-6), 1 - 1e-6)), odds(rest[r["doc_id"]][1]) - odds(mean)] for r in fit])
    b = toxicity._logistic(x, np.array([r["quality"] for r in fit], dtype=float), np.ones(len(fit)))
    for r in told:
        z = b[0] + b[1] * odds(min(max(r["evidence"], 1e-6), 1 - 1e-6)) + b[2] * (odds(rest[r["doc_id"]][1]) - odds(mean))
        assert abs(got[r["doc_id"]]["score"] - 1 / (1 + math.exp(-z))) < 1e-5
    judged = [(got[d]["kept"], bool(y)) for d, y in truth.items() if d % 3 == 0]
    assert np.mean([a == y for a, y in judged]) > 0.75


def test_columns_named_like_inner_ones_pass(docs):
    table = docs(corpus(60)).withColumnsRenamed({"tag": "_bytes", "place": "bytes", "known": "bytes_"})
    out = language.identify(table, language.train(table))
    assert set(table.columns) - {"score"} <= set(out.columns) and out.where("bytes = 'x' AND bytes_ = 'x' AND _bytes = 'x'").count() == 60
