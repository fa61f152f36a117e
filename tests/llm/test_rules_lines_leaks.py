import re
from collections import Counter

import duckdb
import pytest

from larkspur.llm import leaks, lines, rules, sql
from tests.llm.test_pipeline import plain_lines


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_rule_counts_equal_a_plain_version(docs, prose):
    rows = [(k, t) for k, (_, t) in enumerate(prose(11))] + [(900, "# $5 & <b>\n\nx\nx\n x\n" * 20), (901, "A B C A B C A"), (902, "a b c")]
    got = {r["doc_id"]: r for r in rules.judge(docs(rows)).collect()}
    for d, t in rows:
        w, r = words(t), got[d]
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        full = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in rules.SYMBOLS), len(full) - len(set(full)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, (d, t)
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert rules.judge(docs(rows).limit(0)).count() == 0


def test_templates_go_and_copies_stay(docs):
    clean = [f"Line number {k} of this text, with words of its own w{k}x and more." for k in range(200)]
    fill = lambda k: [f"alpha{chr(97 + k % 26)}{chr(97 + k // 26)} one two three", f"beta{chr(97 + k % 26)}{chr(97 + k // 26)} four five six"]
    boiler = lambda k: f"Page {k} of 99, all rights reserved."
    rows = [(k, "\n".join([fill(k)[0], boiler(k), fill(k)[1]])) for k in range(20)]
    rows += [(100 + k, "same first line here\nsame second line here\nsame third line here") for k in range(20)]
    rows += [(200, None), (201, ""), (202, boiler(3)), (203, "x\n" * 3000 + boiler(7)), (None, boiler(5) + "\nrest of it all"), (5, rows[5][1]), (5, "other text\n" + boiler(1))]
    out = lines.drop_templates(docs(rows))
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() == len(rows)
    got = sorted(out.collect(), key=str)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 100:
            assert r["n_removed"] == 1 and "reserved" not in r["text"]
        if r["doc_id"] is not None and 100 <= r["doc_id"] < 200:
            assert r["n_removed"] == 0 and r["text"].count("\n") == 2
    by = {r["doc_id"]: r for r in got}
    assert by[200]["text"] is None and by[200]["n_lines"] == 0 and by[201]["text"] == "" and by[202]["text"] == "" and by[203]["n_removed"] == 1
    assert by[None]["text"] == "rest of it all"
    assert lines.drop_templates(docs(rows).limit(0)).count() == 0
    assert clean


def own(k, n=12):
    """Words that only text k has."""
    return " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}own" for j in range(n))


def test_fields_of_letters_and_whole_notices_go(docs):
    name = lambda k: chr(97 + k % 26) + chr(97 + k // 26)
    rows = [(k, f"{own(k)}\nPosted by {name(k)} on our site\n{own(k, 9)}") for k in range(60)]
    notice = ["We use cookies on this site.", "They remember what you chose before.", "Read more in our policy."]
    rows += [(100 + k, "\n".join([own(60 + k), *notice, own(60 + k, 9)])) for k in range(60)]
    rows += [(200 + k, f"{own(130 + k)}\nAdvertisement\n{own(130 + k, 3)}") for k in range(25)]
    rows += [(300 + k, f"{own(160 + k)}\nRare\nseen by four of them\n{own(160 + k, 3)}") for k in range(4)]
    edited = [f"Line {x} of a text that was copied and edited." for x in ("one", "two", "three", "four", "five")]
    rows += [(400 + k, "\n".join([*edited, own(170 + k, 2)])) for k in range(30)]
    rows += [(500, notice[1]), (501, "\n".join(notice))]
    got = {r["doc_id"]: r for r in lines.drop_templates(docs(rows)).collect()}
    for d, t in rows:
        want = 1 if d < 100 or 200 <= d < 300 else 3 if d < 200 or d == 501 else 1 if d == 500 else 0
        assert got[d]["n_removed"] == want, (d, got[d])
        assert want or got[d]["text"] == t
    assert got[0]["text"] == f"{own(0)}\n{own(0, 9)}" and got[100]["text"] == f"{own(60)}\n{own(60, 9)}" and got[500]["text"] == got[501]["text"] == ""
    assert [(d, got[d]["text"]) for d, _ in rows] == plain_lines(rows)


def test_long_texts_and_inner_names(docs, monkeypatch):
    rows = [(k, f"{own(k)}\nall rights reserved here\n{own(k, 9)}") for k in range(8)]
    rows += [(50, "\n".join(f"{own(30 + k % 80)} {k}" + ("\nall rights reserved here" if k % 2 else "") for k in range(20_000)))]
    for few in (10**6, 10):  # 10: gone lines are shuffled and not broadcast
        monkeypatch.setattr(lines, "BROADCAST_ROWS", few)
        table = docs(rows).withColumnsRenamed({"tag": "_gone", "place": "_id", "known": "_key", "score": "_all", "kept": "_k"})
        out = lines.drop_templates(table)
        assert [c for c in out.columns if c not in ("n_lines", "n_removed")] == [c for c in table.columns if c != "n_removed"]
        got = {r["doc_id"]: r for r in out.collect()}
        assert all(got[d]["n_removed"] == (10_000 if d == 50 else 1) and "reserved" not in got[d]["text"] and got[d]["_gone"] == "x" for d, _ in rows)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


ITEM = "A train covers 120 km in 3 hours while Anna drives 120 km in 2 hours, so how much faster is Anna than the train on average?"


def test_reparameterised_items_are_found(spark, docs):
    same = ITEM
    changed = ITEM.replace("120", "450").replace("Anna", "Boris").replace("3 hours", "9 hours")
    mixed = ITEM.replace("120", "450", 1)  # one value of the item for two of the text: windows without the change count
    apart = changed.replace("450", "460", 1).replace("Boris", "Carl", 1)  # changed everywhere, and not alike
    rows = [(1, "Before it all. " + same + " And after."), (2, "Intro words, " + changed), (3, "Intro words, " + mixed), (4, "A train is late and nobody knows why it happened on that day."), (5, None), (6, ""), (7, "w " * 5000 + same), (None, same), (1, "again " + same), (8, "Intro words, " + apart)]
    found = {(r["doc_id"], r["item_id"]): r for r in leaks.leaks(docs(rows), bench(spark, [(1, ITEM), (2, None), (3, ""), (4, "Four short words only"), (5, ITEM)])).collect()}
    assert {k for k in found if k[0] in (1, 2, 3, 7)} == {(d, i) for d in (1, 2, 3, 7) for i in (1, 5)}
    assert not any(k[0] in (4, 5, 6) for k in found)
    assert found[(2, 1)]["reparameterised"] and not found[(7, 1)]["reparameterised"]
    # Behind a small letter the first word reads as a name, which costs the first window.
    assert found[(1, 1)]["n_held"] - 1 <= found[(7, 1)]["n_held"] <= found[(1, 1)]["n_held"]
    assert found[(3, 1)]["n_held"] < found[(7, 1)]["n_held"] and not found[(3, 1)]["reparameterised"] and (8, 1) not in found
    kept = leaks.clean(docs(rows), bench(spark, [(1, ITEM)]))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "5", "6", "8", "None"]
    assert leaks.leaks(docs(rows).limit(0), bench(spark, [(1, ITEM)])).count() == 0
    assert leaks.leaks(docs(rows), bench(spark, [(1, ITEM)]).limit(0)).count() == 0


def test_every_word_of_a_name_counts(spark, docs):
    item = "In the morning the teacher told Maria Lopez Garcia and her friend Jon Ash Reed that nobody may leave the room before noon."
    changed = item.replace("Maria Lopez Garcia", "Anna Perez Soto").replace("Jon Ash Reed", "Tom Elm Poe")
    found = leaks.leaks(docs([(1, changed), (2, item)]), bench(spark, [(1, item)])).collect()
    # Of 16 windows two hold five names and too few words besides.
    assert {(r["doc_id"], r["n_windows"], r["n_held"], r["reparameterised"]) for r in found} == {(1, 16, 14, True), (2, 16, 14, False)}
    clash = docs([(1, changed), (3, "clean text")]).withColumnRenamed("tag", "leaked_id")
    kept = leaks.clean(clash, bench(spark, [(1, item)]))
    assert kept.columns == clash.columns and [r["doc_id"] for r in kept.collect()] == [3]


def test_short_items_match_whole(spark, docs):
    found = leaks.leaks(docs([(1, "He said that seven green bottles fell down."), (2, "seven green bottles")]), bench(spark, [(9, "Seven green bottles fell!")])).collect()
    assert [(r["doc_id"], r["item_id"], r["n_windows"]) for r in found] == [(1, 9, 1)]


DENSE = "17 4 1989 23 5 1991 8 12 2004 30 1 2011"


@pytest.mark.parametrize("small", [leaks.SMALL, 0])
def test_items_dense_in_values_match_verbatim(spark, docs, monkeypatch, small):
    monkeypatch.setattr(leaks, "SMALL", small)
    rows = [(1, "The dates are " + DENSE + " and so on"), (2, DENSE.replace("1", "6")), (3, "It is said that Ann Bob Cy Dee Eve Flo went. 2 + 2 = 4!"), (4, "Nobody knows 2 and 4"), (None, DENSE)]
    items = [(1, DENSE), (2, "Ann Bob Cy Dee Eve Flo"), (3, "2+2"), (4, "2 + 2 = 4"), (5, "Nobody knows")]
    found = {(r["doc_id"], r["item_id"]): r for r in leaks.leaks(docs(rows), bench(spark, items)).collect()}
    assert found.keys() == {(1, 1), (3, 2), (3, 4), (4, 5)}
    assert (found[(1, 1)]["n_windows"], found[(1, 1)]["n_held"]) == (5, 5) and not any(r["reparameterised"] for r in found.values())


def test_large_benchmarks_are_shuffled(spark, docs, monkeypatch):
    monkeypatch.setattr(leaks, "SMALL", 0)
    assert [r["doc_id"] for r in leaks.leaks(docs([(1, ITEM), (2, "x")]), bench(spark, [(1, ITEM)])).collect()] == [1]


def test_sql_agrees(spark, docs, prose):
    rows = [(k, t) for k, (_, t) in enumerate(prose(13))] + [(700, ITEM.replace("while Anna", "while Anna Maria Lopez Garcia")), (701, ITEM.replace("Anna", "Boris Elm")), (702, ITEM.replace("120", "450", 1)), (703, ITEM.replace("hours", "days", 1))] + [(500 + k, f"Intro {k}.\nPage {k} of 9 all rights reserved\nOutro w{k}." ) for k in range(8)] + [(600, ITEM)]
    table = docs(rows)
    con = duckdb.connect()
    con.register("documents", table.select("doc_id", "text").toPandas())
    con.register("benchmark", bench(spark, [(1, ITEM), (2, rows[3][1])]).toPandas())

    def compare(df, query):
        con_rows = con.sql(query)
        order = [con_rows.columns.index(c) for c in df.columns]
        assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in con_rows.fetchall()), key=str)

    compare(rules.judge(table).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), sql.op8())
    compare(lines.drop_templates(table).selectExpr("doc_id", "n_lines", "n_removed", "sha2(coalesce(text, ''), 256) AS kept_sha256"), sql.op4())
    compare(leaks.leaks(table, bench(spark, [(1, ITEM), (2, rows[3][1])])), sql.op10())
