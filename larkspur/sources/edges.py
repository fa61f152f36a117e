"""Edge lists: text scans with exact line numbers for errors, statistics, fingerprints, and edges from tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.staging import Staging

#: Two integers with at most one comma between them. Possessive parts: no digit is given back to make two numbers of one.
EDGE = r"^\s*+(-?+\d++)\s*+,?+\s*+(-?+\d++)\s*+$"
BLANK, COMMENT = r"^\s*+$", r"^\s*+#"
#: Stands in no edge.
MARK = "\u0001"
# Words that a header must contain, one of each group.
FROM_WORDS, TO_WORDS = ("from", "source"), ("to", "target", "destination")


class EdgeListError(ValueError):
    """Input that is no edge list."""


@dataclass(frozen=True)
class InputStats:
    lines: int
    edges: int
    comments: int
    headers: int
    fingerprint: str


def _pair(value: Column) -> Column:
    """Both numbers of a line behind MARK, with a blank between them; the line itself where it is no edge. One search."""
    return F.regexp_replace(value, EDGE, f"{MARK}$1 $2")


def header_like(value: Column) -> Column:
    low = F.lower(value)
    has = lambda words: F.greatest(*[F.contains(low, F.lit(w)) for w in words])
    return has(FROM_WORDS) & has(TO_WORDS)


def classified(lines: DataFrame) -> DataFrame:
    """lines (`value` and others) with src, dst and kind: edge, comment, blank, header (by its words alone) or bad."""
    names = lines.columns
    pair, whole = F.col("pair"), F.col("value")
    # Steps of their own, so that each line is searched once and each number cast once.
    found = lines.withColumn("pair", _pair(whole))
    found = found.withColumn("pair", F.when(pair.startswith(MARK) & ~whole.startswith(MARK), F.split(F.substring(pair, 2, 1 << 30), " ")))
    found = found.withColumn("pair", F.struct(pair[0].try_cast("int").alias("src"), pair[1].try_cast("int").alias("dst")))
    fine = F.col("pair.src").isNotNull() & F.col("pair.dst").isNotNull()
    kind = F.when(fine, "edge").when(whole.rlike(BLANK), "blank").when(whole.rlike(COMMENT), "comment").when(header_like(whole), "header").otherwise("bad")
    return found.select(*names, F.when(fine, F.col("pair.src")).alias("src"), F.when(fine, F.col("pair.dst")).alias("dst"), kind.alias("kind"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    # Only \n ends a line; a lone \r inside one is white space.
    return spark.read.option("lineSep", "\n").text(path)


def _ordered(spark: SparkSession, path: str) -> DataFrame:
    """Classified lines with a key that grows along the file: the block they start in, then their order in it."""
    at = _lines(spark, path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("at"))
    return classified(at)


def _place(at) -> Column:
    return F.struct(F.lit(at["file_path"]).alias("file_path"), F.lit(at["file_block_start"]).cast("long").alias("file_block_start"), F.lit(at["row"]).cast("long").alias("row"))


def _odd_lines(rows: DataFrame, path: str, seen: dict) -> int:
    """Number of headers of placed lines; raises at the first line that is neither edge, comment, blank nor a first header."""
    legal = seen["header"] if seen["header"] and (not seen["edge"] or tuple(seen["header"]) < tuple(seen["edge"])) else None
    odd = rows.where("kind IN ('header', 'bad')")
    if legal:
        odd = odd.where(F.col("at") != _place(legal))
    bad = odd.agg(F.min(F.struct("at", "value")).alias("bad")).first()["bad"]
    if bad is None:
        return 1
    number = rows.where(F.col("at") <= _place(bad["at"])).count()
    raise EdgeListError(f"invalid edge at {path}:{number}: {bad['value']}")


def ingest(spark: SparkSession, path: str, staging: Staging) -> tuple[DataFrame, InputStats]:
    """src and dst of every edge of a text file, duplicates included, in a staged table, and what the file holds.

    The text is read once: lines are counted, and odd ones noticed, while the edges are written. Whatever
    follows reads the table, so it cannot see another state of the file.
    """
    rows = _ordered(spark, path)
    of = lambda k: F.count_if(F.col("kind") == k)
    first = lambda k: F.min(F.when(F.col("kind") == k, F.col("at")))
    seen = Observation()
    watched = rows.observe(seen, F.count(F.lit(1)).alias("lines"), *[of(k).alias(f"n_{k}") for k in ("edge", "comment", "header", "bad")], first("edge").alias("edge"), first("header").alias("header"))
    hashed = F.coalesce(F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")
    edges, told = staging.cut(watched.where("kind = 'edge'").select("src", "dst"), fingerprint=hashed)
    got = seen.get
    # Rare path: place the odd lines among the edges. Aggregates only; nothing is sorted or gathered.
    headers = _odd_lines(rows, path, got) if got["n_header"] or got["n_bad"] else 0
    return edges, InputStats(got["lines"], got["n_edge"], got["n_comment"], headers, told["fingerprint"])


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """src and dst of every edge of a text file, duplicates included."""
    return ingest(spark, path, Staging(spark))[0]


def fingerprint(edges: DataFrame) -> DataFrame:
    """One row: number of edges and a sum of hashes that does not depend on their order."""
    return edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def line_counts(lines: DataFrame) -> DataFrame:
    """One row of counts over lines that were classified."""
    of = lambda k: F.count_if(F.col("kind") == k)
    return lines.agg(F.count("*").alias("lines"), of("edge").alias("edges"), of("comment").alias("comments"), of("header").alias("headers"))


def input_stats(spark: SparkSession, path: str) -> InputStats:
    with Staging(spark) as staging:
        return ingest(spark, path, staging)[1]


def verify_unchanged(spark: SparkSession, path: str, before: InputStats) -> None:
    """Raise if the edges of the file are not those that were counted before."""
    now = input_stats(spark, path)
    if (now.edges, now.fingerprint) != (before.edges, before.fingerprint):
        raise EdgeListError(f"the input changed while it was read: {path}")


def edges_from(table: DataFrame, src: Column, dst: Column, skip_null: bool = False) -> DataFrame:
    """Edges from two columns of a table; fails on values that are no 32-bit integers.

    Nulls fail too, unless rows with one are to be skipped. The optimiser may evaluate the check before any
    filter, so skipping is part of it and not a filter of the caller's.
    """

    def narrow(c: Column, name: str) -> Column:
        small = c.try_cast("int")
        fine = small.isNotNull() | c.isNull() if skip_null else small.isNotNull()
        return F.when(fine, small).otherwise(F.raise_error(F.lit(f"{name} is null or no 32-bit integer")).cast("int")).alias(name)

    edges = table.select(narrow(src, "src"), narrow(dst, "dst"))
    return edges.where("src IS NOT NULL AND dst IS NOT NULL") if skip_null else edges
