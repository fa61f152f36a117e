"""Quality classifier (9): hierarchical empirical Bayes over documents, paths and hosts.

A logistic classifier over surface ratios gives each document its evidence. Sums of that evidence and of
the labels by path and by host become posteriors: a host is shrunk toward the global rate, a path toward
its host, with the strengths estimated from the spread between hosts and between paths (method of
moments), so sparse sites stay near what stands above them. Both posteriors of a document leave out its own label
and evidence. Its score is logistic in its own log-odds and in how far its path's posterior lies from the global rate.

Nothing in this is set by hand: a document without a label counts for as much of a labelled one as the squared
correlation of evidence and labels says, and the two weights of the score are fitted on labelled rows that
did not make the classifier.

Classifier and weights are fitted on SAMPLE labelled rows of each class at most (in expectation, picked by a hash
of doc_id; only their ratios reach the driver), half of them each. Everything else covers all rows: two grouped
aggregations with partial sums, whatever the share of the largest host. Site tables are broadcast only
if they have at most SMALL rows; beyond that the join is salted, so a host with a third of all rows is
dealt out over SALT tasks.

Null or missing hosts and paths form a site of their own; null and empty texts have evidence from zero
ratios; without labels of both classes the evidence is one half; duplicate labels of a doc_id are
averaged; copies have equal evidence; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import Stage, documents
from larkspur.llm.toxicity import _logistic

SAMPLE, SMALL, SALT = 4000, 50_000, 32
RATIOS = ("symbols", "upper", "dup_lines", "digits", "log_chars", "shouts", "distinct_words")


def ratios(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    without = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))) / n
    lines, words = F.split(t, "\n"), F.split(t, r"\s+")
    return [
        without("#*$%&|<>").alias("symbols"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("upper"),
        ((F.size(lines) - F.size(F.array_distinct(lines))) / F.size(lines)).alias("dup_lines"),
        without("0123456789").alias("digits"),
        F.log1p(n).alias("log_chars"),
        without("!").alias("shouts"),
        (F.size(F.array_distinct(words)) / F.size(words)).alias("distinct_words"),
    ]


def _fit(rows: list, sizes: dict[int, int], sample: int) -> tuple[list[float], list[float], list[float]]:
    """Coefficients (constant first), means and spreads."""
    x = np.array([[r[c] for c in RATIOS] for r in rows], dtype=float)
    y = np.array([r["quality"] for r in rows], dtype=float)
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    weight = np.array([max(1.0, sizes[int(k)] / sample) for k in y])
    return _logistic((x - mean) / spread, y, weight).tolist(), mean.tolist(), spread.tolist()


def _odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _half() -> Column:
    """Which of two halves a labelled row belongs to: the classifier's (0) or that of what builds on it (1)."""
    return F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))


def classify(docs: DataFrame, labels: DataFrame, stage: Stage, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, host, path, evidence, quality (null without a label) and whether the row may be fitted on; sizes of the classes."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    part = {k: min(1.0, sample / n) for k, n in sizes.items()}
    chance = F.when(F.col("quality") == 1, part.get(1, 0.0)).otherwise(part.get(0, 0.0)) * 1_000_000
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < chance
    # One scan of the texts; what follows reads a few numbers a row.
    measured = stage.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), *ratios(F.col("text"))))
    evidence = F.lit(0.5)
    if set(sizes) == {0, 1}:
        picked = known.where(drawn & (_half() == 0)).limit(4 * sample)
        rows = measured.join(F.broadcast(picked), "doc_id").select("quality", *RATIOS).limit(8 * sample).collect()
        if len({r["quality"] for r in rows}) == 2:
            b, mean, spread = _fit(rows, sizes, sample)
            logit = F.lit(b[0])
            for c, k, m, s in zip(RATIOS, b[1:], mean, spread):
                logit = logit + F.lit(k) * (F.col(c) - m) / s
            evidence = 1 / (1 + F.exp(-F.greatest(F.lit(-12.0), F.least(F.lit(12.0), logit))))
    label = known.groupBy("doc_id").agg(F.avg("quality").alias("quality"), F.max(drawn).alias("drawn"))
    told = measured.select("doc_id", "host", "path", evidence.alias("evidence")).join(label, "doc_id", "left")
    told = stage.cut(told.select("doc_id", "host", "path", "evidence", "quality", (F.col("drawn") & (_half() == 1)).alias("fit")))
    stage.drop(measured)
    return told, sizes


def _strength(groups: DataFrame, mean: Column) -> float:
    """How many rows the level above counts for: within-group over between-group variance."""
    p = F.col("good") / F.col("n")
    got = groups.where(F.col("n") >= 5).agg(
        F.sum(F.col("n") * p * (1 - p)).alias("within"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(p - mean, 2)).alias("between"), F.sum(p * (1 - p)).alias("noise")
    ).first()
    if not got["n"]:
        return 10.0
    within = max(got["within"] / got["n"], 1e-4)
    between = max((got["between"] - got["noise"]) / got["n"], 1e-6)
    return float(min(max(within / between, 1.0), 1000.0))


def _looked_up(rows: DataFrame, sites: DataFrame, n_sites: int) -> DataFrame:
    if n_sites <= SMALL:
        return rows.join(F.broadcast(sites), ["host", "path"])
    salted = sites.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(salted, ["host", "path", "salt"]).drop("salt")


def assess(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs has doc_id, host, path and text; the result has doc_id, host, path, evidence, both posteriors, score and kept."""
    with Stage(docs.sparkSession) as stage:
        return stage.cut(_assessed(docs, labels, stage, sample), keep=True)


def _assessed(docs: DataFrame, labels: DataFrame, stage: Stage, sample: int) -> DataFrame:
    rows, sizes = classify(docs, labels, stage, sample)
    alike = rows.where("fit").agg(F.corr("evidence", "quality").alias("r")).first()["r"]
    trust = 0.0 if alike is None or math.isnan(alike) else alike * alike
    # What a row says of its site, and with how much weight.
    weight = F.when(F.col("quality").isNull(), trust).otherwise(1.0)
    said = F.coalesce("quality", "evidence")
    paths = stage.cut(rows.groupBy("host", "path").agg(F.sum(weight).alias("n"), F.sum(weight * said).alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).first()
    mean = min(max((total["good"] or 0.5) / (total["n"] or 1.0), 1e-4), 1 - 1e-4)
    above = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_good").alias("good")), F.lit(mean))
    joined = stage.cut(paths.join(hosts, "host"))
    within = _strength(joined, (F.col("host_good") + above * mean) / (F.col("host_n") + above))
    out = _looked_up(rows, joined, joined.count())
    # Without the row itself; sums of floats may leave a trace below zero.
    rest = lambda c, own: F.greatest(F.col(c) - own, F.lit(0.0))
    host = (rest("host_good", weight * said) + above * mean) / (rest("host_n", weight) + above)
    path = (rest("good", weight * said) + within * F.col("host_posterior")) / (rest("n", weight) + within)
    out = stage.cut(out.withColumn("host_posterior", host).withColumn("path_posterior", path).select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "quality", "fit"))
    far = _odds(F.col("path_posterior")) - math.log(mean / (1 - mean))
    b = [0.0, 1.0, 0.0]
    seen = out.where("fit").select("quality", _odds(F.col("evidence")).alias("own"), far.alias("far")).limit(8 * sample).collect()
    if {round(r["quality"]) for r in seen} == {0, 1}:
        y = np.array([float(round(r["quality"])) for r in seen])
        b = _logistic(np.array([[r["own"], r["far"]] for r in seen]), y, np.array([max(1.0, sizes[int(k)] / sample) for k in y])).tolist()
    logit = F.lit(b[0]) + F.lit(b[1]) * _odds(F.col("evidence")) + F.lit(b[2]) * far
    scored = out.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit)))))
    return scored.select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= 0.5).alias("kept"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources of documents, paths the languages within a source."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.col("source").alias("host"), F.concat_ws("/", "source", "lang").alias("path"))
    return assess(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
