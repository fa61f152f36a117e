"""Checks of ranks, and comparison with expected ranks, as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.exact import exact_sum

MASS_TOLERANCE, RELATIVE_TOLERANCE = 1e-10, 1e-4


class ValidationError(ValueError):
    """Ranks that break a promise of the output."""


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file with a key that grows along it."""
    place = F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("at")
    return spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), place)


def _checked(rows: DataFrame, lines: DataFrame, path: str) -> DataFrame:
    """vertex and rank of rows (at, fields, vertex, rank); raises at the first line that has not both, with its number."""
    bad = rows.where((F.size("fields") != 2) | F.col("vertex").isNull() | F.col("rank").isNull()).agg(F.min("at").alias("at")).first()["at"]
    if bad is not None:
        here = F.struct(F.lit(bad["file_block_start"]).cast("long").alias("file_block_start"), F.lit(bad["row"]).cast("long").alias("row"))
        raise ValidationError(f"{path}:{lines.where(F.col('at') <= here).count()}: a vertex and a rank are expected")
    return rows.select("vertex", "rank")


def _numbers(rows: DataFrame) -> DataFrame:
    field = lambda k: F.trim(F.get("fields", F.lit(k)))
    return rows.select("at", "fields", field(0).try_cast("int").alias("vertex"), field(1).try_cast("double").alias("rank"))


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """vertex and rank of a ranks CSV; its first line must be `vertex,rank`, each other one a row (blank lines are passed over)."""
    lines = _numbered(spark, path)
    first = lines.agg(F.min_by("value", "at").alias("value"), F.min("at").alias("at")).first()
    if first["value"] != "vertex,rank":
        raise ValidationError(f"{path} has no vertex,rank header")
    header = (F.col("at.file_block_start") == first["at"]["file_block_start"]) & (F.col("at.row") == first["at"]["row"])
    rows = lines.where(~header & (F.col("value") != "")).select("at", F.split("value", ",").alias("fields"))
    return _checked(_numbers(rows), lines, path)


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    """vertex and rank of a reference file: separated by a comma or white space, with comments; its first line of data may be a header."""
    lines = _numbered(spark, path)
    trimmed = F.regexp_replace(F.regexp_replace("value", r"^\s+", ""), r"\s+$", "")
    rows = lines.select("at", trimmed.alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    rows = rows.select("at", F.when(F.contains("value", F.lit(",")), F.split("value", ",")).otherwise(F.split("value", r"\s+")).alias("fields"))
    first = rows.agg(F.min_by("fields", "at").alias("fields"), F.min("at").alias("at")).first()
    if first["fields"] and first["fields"][0].strip().lower() == "vertex":
        rows = rows.where((F.col("at.file_block_start") != first["at"]["file_block_start"]) | (F.col("at.row") != first["at"]["row"]))
    return _checked(_numbers(rows), lines, path)


def rank_checks(ranks: DataFrame, accumulator: str = "decimal") -> DataFrame:
    """One row: number of vertices, sum, least and greatest rank, and counts of rows that break a promise."""
    finite = F.col("rank").isNotNull() & ~F.isnan("rank") & (F.abs("rank") < float("inf"))
    safe = F.when(finite, F.col("rank")).otherwise(0.0)
    return ranks.agg(
        F.count("*").alias("vertices"),
        exact_sum(safe, accumulator).alias("rank_sum"),
        F.min("rank").alias("minimum_rank"),
        F.max("rank").alias("maximum_rank"),
        F.count_if(~finite | (F.col("rank") < 0)).alias("bad_ranks"),
        (F.count("*") - F.count_distinct("vertex")).alias("repeated_vertices"),
    )


def compare(ranks: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: vertices that only one side has, and the largest absolute and relative errors.

    Where 0 is expected, the relative error is 0 for 0 and infinite for anything else.
    """
    left, right = ranks.select("vertex", F.col("rank").alias("got")), expected.select("vertex", F.col("rank").alias("want"))
    error = F.abs(F.col("got") - F.col("want"))
    relative = F.when(F.col("want") != 0, error / F.abs("want")).when(F.col("got") == 0, 0.0).otherwise(float("inf"))
    both = left.join(right, "vertex", "full_outer")
    return both.agg(
        F.count_if(F.col("want").isNull()).alias("unexpected_vertices"),
        F.count_if(F.col("got").isNull()).alias("missing_vertices"),
        F.max(error).alias("maximum_absolute_error"),
        F.max(F.when(F.col("got").isNotNull() & F.col("want").isNotNull(), relative)).alias("maximum_relative_error"),
    )


def report(ranks: DataFrame, expected: DataFrame | None = None, relative_tolerance: float = RELATIVE_TOLERANCE, sum_tolerance: float = MASS_TOLERANCE) -> dict:
    """Raise ValidationError at the first broken promise; else the figures of the report."""
    row = rank_checks(ranks).first()
    if not row["vertices"]:
        raise ValidationError("there are no ranks")
    if row["repeated_vertices"]:
        raise ValidationError(f"{row['repeated_vertices']} vertices are repeated or missing an id")
    if row["bad_ranks"]:
        raise ValidationError(f"{row['bad_ranks']} ranks are negative or not finite")
    if abs(row["rank_sum"] - 1.0) > sum_tolerance:
        raise ValidationError(f"ranks sum to {row['rank_sum']!r}")
    out = {k: row[k] for k in ("vertices", "rank_sum", "minimum_rank", "maximum_rank")} | {"maximum_absolute_error": None, "maximum_relative_error": None}
    if expected is not None:
        errors = compare(ranks, expected).first()
        if errors["unexpected_vertices"] or errors["missing_vertices"]:
            raise ValidationError("the vertices are not those expected")
        if errors["maximum_relative_error"] > relative_tolerance:
            raise ValidationError(f"relative error {errors['maximum_relative_error']:.6g} is above {relative_tolerance:.6g}")
        out |= {k: errors[k] for k in ("maximum_absolute_error", "maximum_relative_error")}
    return out


def check_order(spark: SparkSession, path: str) -> None:
    """Raise unless the file's ids ascend strictly, by comparing each row with the one before it in its block."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    ids = lines.select("block", "row", F.get(F.split("value", ","), F.lit(0)).try_cast("int").alias("vertex")).where("vertex IS NOT NULL")
    from pyspark.sql import Window

    stepped = ids.withColumn("last", F.lag("vertex").over(Window.partitionBy("block").orderBy("row")))
    if stepped.where("last >= vertex").limit(1).count():
        raise ValidationError("vertices do not ascend")
    ends = ids.groupBy("block").agg(F.min("vertex").alias("lo"), F.max("vertex").alias("hi")).orderBy("block").collect()  # one row a block of the file
    if any(a["hi"] >= b["lo"] for a, b in zip(ends, ends[1:])):
        raise ValidationError("vertices do not ascend")
