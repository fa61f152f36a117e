import pytest

from larkspur.sources import edges as E


def write(tmp_path, text, name="edges.txt"):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def pairs(spark, path):
    return sorted(map(tuple, E.read_edges(spark, path).collect()))


def test_csv_with_header_and_signed_ids(spark, tmp_path):
    path = write(tmp_path, "from,to\n-12,42\n42,-7\n")
    assert pairs(spark, path) == [(-12, 42), (42, -7)]
    stats = E.input_stats(spark, path)
    assert (stats.lines, stats.edges, stats.headers, stats.comments) == (3, 2, 1, 0)


def test_comments_and_white_space(spark, tmp_path):
    path = write(tmp_path, "# metadata\n# FromNodeId ToNodeId\n1\t2\n  3  4  \n\n")
    assert pairs(spark, path) == [(1, 2), (3, 4)]
    assert E.input_stats(spark, path).comments == 2


def test_malformed_line_is_named(spark, tmp_path):
    path = write(tmp_path, "from,to\n1,2\nnot-an-edge\nalso bad\n")
    with pytest.raises(E.EdgeListError, match=r":3: not-an-edge"):
        E.read_edges(spark, path)


@pytest.mark.parametrize("text", ["1,2\nfrom,to\n", "from,to\nfrom,to\n1,2\n", "src,dst\n1,2\n"])
def test_headers_that_do_not_count(spark, tmp_path, text):
    with pytest.raises(E.EdgeListError):
        E.read_edges(spark, write(tmp_path, text))


def test_line_numbers_hold_over_many_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = [f"{k} {k + 1}" for k in range(5000)]
        lines[4321] = "oops"
        lines[4700] = "worse"
        with pytest.raises(E.EdgeListError, match=r":4322: oops"):
            E.read_edges(spark, write(tmp_path, "\n".join(lines) + "\n"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


GOOD = {"1-2": (1, -2), "007 8": (7, 8), "-0,1": (0, 1), "1\r2": (1, 2), "2147483647 -2147483648": (2147483647, -2147483648), " 1 , 2 ": (1, 2), "00000000000000000001,2": (1, 2)}
BAD = ["12", "1,,2", "1,2,3", "+1,2", "1.5,2", "--1 2", "1,", "1 2 # c", "2147483648 1", "1 2147483648", "a b"]


def test_grammar(spark):
    rows = spark.createDataFrame([(t,) for t in [*GOOD, *BAD, "", "  ", " # x"]], "value string")
    found = {r["value"]: (r["src"], r["dst"], r["kind"]) for r in E.classified(rows).collect()}
    for text, pair in GOOD.items():
        assert found[text] == (*pair, "edge"), text
    for text in BAD:
        assert found[text] == (None, None, "bad"), text
    assert [found[t][2] for t in ("", "  ", " # x")] == ["blank", "blank", "comment"]


def test_fingerprint_tells_edges_apart_but_not_formats(spark, tmp_path):
    one = E.input_stats(spark, write(tmp_path, "1,2\n2,3\n", "a"))
    two = E.input_stats(spark, write(tmp_path, "# c\n2\t3\n1\t2\n", "b"))
    other = write(tmp_path, "1,2\n3,2\n", "c")
    assert one.fingerprint == two.fingerprint != E.input_stats(spark, other).fingerprint
    with pytest.raises(E.EdgeListError):
        E.verify_unchanged(spark, other, one)
    E.verify_unchanged(spark, write(tmp_path, "2,3\n1,2\n", "d"), one)


def test_edges_from_tables_are_checked(spark):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(1, 2), (None, 3)], "a long, b long")
    assert [tuple(r) for r in E.edges_from(table, F.col("a"), F.col("b"), skip_null=True).collect()] == [(1, 2)]
    with pytest.raises(Exception, match="no 32-bit integer"):
        E.edges_from(table, F.col("a"), F.col("b")).collect()
    with pytest.raises(Exception, match="no 32-bit integer"):
        E.edges_from(spark.createDataFrame([(1 << 40, 2)], "a long, b long"), F.col("a"), F.col("b")).collect()
