"""Toxicity (7): maximum-scoring segments of token log-odds, with extreme-value calibration.

A token's score is its log-odds between toxic and clean documents under a Dirichlet prior (a floor plus a
part that follows the overall counts), less a small drift that keeps segments local. One linear scan of a text finds all
its maximal scoring segments; by the statistics of such segments in clean text (Karlin and Altschul:
sum of p exp(lambda s) = 1, and K from clean documents) each has an expected number of chance
occurrences, which tells significant passages from noise. A logistic curve over that evidence gives the
probability. Curve and constants are cross-fitted: FOLDS models leave out a part of the sample each and measure that part
alone, so no text is evidence about scores that it made; the scores that are used come from the whole sample.

The model learns from a bounded sample: SAMPLE labelled rows of each class at most (in expectation),
picked by a hash of doc_id among rows that are not held out. Counts are aggregated in Spark, over one text of each group of near copies in the sample (copies would lend their
rare words the weight of evidence); the driver sees the tokens that tell the classes apart (LEAST_Z, LEAST_SEEN) and three
numbers for each sampled text. All segments of a text count, in training as in scoring, which is one
Arrow pass over whole texts without a shuffle.

Rows without a doc_id are not held out. Null and empty texts score as texts without evidence; without labels of both classes all score 0. Rows
labelled twice count twice; tied segments keep the leftmost; copies score alike; columns of docs named
like our results are replaced.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import Stage, documents, pieces

SAMPLE, FOLDS, FLOOR, PRIOR, LEAST_Z, LEAST_SEEN, DRIFT = 3000, 4, 0.5, 500.0, 3.0, 5, 0.05
SKETCHES = 4
TOKEN = regex.compile(r"\p{L}+").findall
SIGNIFICANT = 0.01
LEVEL = -math.log(-math.log1p(-SIGNIFICANT))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def tokens(text: bytes | None) -> list[str]:
    return TOKEN((text or b"").decode("utf-8", "replace").lower())


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum) in one pass; each has no better part and no better whole around it."""
    total = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[tuple[float, float, int, int]] = []  # sum before it, sum after it, start, end
    for at in np.flatnonzero(scores > 0):
        left, right, start, end = total[at], total[at + 1], int(at), int(at) + 1
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][0] >= left:
                k -= 1
            if k < 0 or found[k][1] >= right:
                found.append((left, right, start, end))
                break
            left, start = found[k][0], found[k][2]
            del found[k:]
    return [(start, end, right - left) for left, right, start, end in found]


class Scorer:
    """Token scores, the constants of chance segments and the logistic curve over both."""

    def __init__(self, scores: dict[str, float], rate: float):
        self.scores, self.rate, self.log_k, self.curve = scores, rate, 0.0, np.zeros(3)

    def passages(self, text: bytes | None) -> tuple[list[str], list[tuple[int, int, float]]]:
        found = tokens(text)
        values = np.fromiter(map(self.scores.get, found, repeat(-DRIFT)), np.float64, len(found))
        return found, segments(values)

    def evidence(self, n_tokens: int, sums: list[float]) -> tuple[float, float]:
        """Of the best segment, minus the log of its expected number by chance; of the rest, how much is significant."""
        if not sums:
            return 0.0, 0.0
        surprise = self.rate * np.array(sums) - self.log_k - np.log(max(n_tokens, 1))
        return float(np.clip(surprise.max(), -20, 60)), float(np.log1p(np.clip(surprise, 0, 60).sum()))

    def significant(self, n_tokens: int, total: float) -> bool:
        """Whether chance gives a text of that length so good a segment in fewer than SIGNIFICANT of cases."""
        return self.rate * total - self.log_k - math.log(max(n_tokens, 1)) > LEVEL

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ self.curve[1:], -30, 30)))

    def score(self, text: bytes | None) -> tuple[float, int, int]:
        if not self.scores:
            return 0.0, 0, 0
        found, parts = self.passages(text)
        x = self.evidence(len(found), [p[2] for p in parts])
        n = sum(self.significant(len(found), p[2]) for p in parts)
        score = float(self.probability(np.array([x]))[0])
        return score, int(score >= 0.5), int(n)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    b, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge @ b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return b


def _rate(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share exp(rate scores)) = 1; shares sum to 1 and the mean score is negative."""
    low, high = 1e-6, 1.0
    at = lambda r: float((share * np.exp(np.clip(r * scores, -700, 700))).sum())
    if (share * scores).sum() >= 0 or scores.max() <= 0:
        return 1.0
    while at(high) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if at(mid) < 1 else (low, mid)
    return (low + high) / 2


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, float]]:
    """text and toxic of the training rows, and how many rows each stands for by class."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    part = {k: min(1.0, sample / n) for k, n in sizes.items()}
    chance = F.when(F.col("toxic") == 1, part.get(1, 0.0)).otherwise(part.get(0, 0.0)) * 1_000_000
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) < chance)
    # A proven bound: at most 4 * sample pairs of integers are broadcast.
    picked = F.broadcast(picked.limit(4 * sample))
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.join(picked, "doc_id").select("text", "toxic"), {k: 1 / p for k, p in part.items()}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    import pyarrow as pa

    rows, weight = _sampled(docs, labels, sample)
    if set(weight) != {0, 1}:
        return Scorer({}, 1.0)

    def sketch(batches):
        """The least of the hashes of a text's runs of three tokens, by several hashes: near copies share most of them."""
        for batch in batches:
            least = []
            for text in batch.column("text").to_pylist():
                found = tokens(text)
                threes = {" ".join(t).encode() for t in zip(found, found[1:], found[2:])} or {bytes(text or b"")}
                least.append([min(xxhash.xxh3_64_intdigest(t, seed=k) for t in threes) >> 1 for k in range(SKETCHES)])
            cols = [pa.array([x[k] for x in least], pa.int64()) for k in range(SKETCHES)]
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("toxic"), *cols], names=["text", "toxic", *[f"s{k}" for k in range(SKETCHES)]])

    single = rows.mapInArrow(sketch, "text binary, toxic int, " + ", ".join(f"s{k} long" for k in range(SKETCHES)))
    for k in range(SKETCHES):
        single = single.dropDuplicates(["toxic", f"s{k}"])
    fold = F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(FOLDS)).cast("int")
    single = single.select("text", "toxic", fold.alias("fold"))

    def count(batches):
        for batch in batches:
            tally: dict[tuple[int, str], list[int]] = {}
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold"))):
                found = tokens(text)
                for t in set(found):
                    tally.setdefault((fold, t), [0, 0, 0])[toxic] += 1
                if not toxic:
                    for t in found:
                        tally[fold, t][2] += 1
            cols = list(zip(*tally.values())) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in tally], pa.int32()), pa.array([t for _, t in tally], pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names=["fold", "token", "y0", "y1", "seen"]
            )

    with Stage(docs.sparkSession) as stage:
        single = stage.cut(single)  # which of near copies stays is settled here
        counts = single.mapInArrow(count, "fold int, token string, y0 long, y1 long, seen long")
        counts = stage.cut(counts.groupBy("fold", "token").agg(*[F.sum(c).alias(c) for c in ("y0", "y1", "seen")]))
        model = _scorer(counts)
        if not model.scores:
            return model
        apart = [_scorer(counts.where(F.col("fold") != k)) for k in range(FOLDS)]
        # Each text by the model that did not see it.
        best = _measured(single, apart, lambda m, n, sums: (float(max(sums, default=0.0)), 0.0))
        for k, part in enumerate(apart):
            clean = [part.rate * r["a"] - math.log(max(r["n"], 1)) for r in best if r["fold"] == k and not r["toxic"] and r["a"] > 0]
            part.log_k = float(np.mean(clean) - np.euler_gamma) if clean else 0.0
        model.log_k = float(np.mean([part.log_k for part in apart]))
        rows = _measured(single, apart, Scorer.evidence)
    y = np.array([r["toxic"] for r in rows], dtype=float)
    model.curve = _logistic(np.array([[r["a"], r["b"]] for r in rows]), y, np.where(y == 1, weight[1], weight[0]))
    return model


def _scorer(counts: DataFrame) -> Scorer:
    """Token scores and the rate of chance segments from counts (token, y0, y1, seen)."""
    counts = counts.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("y0", "y1", "seen")])
    n0, n1, seen, n_tokens = counts.agg(F.sum("y0"), F.sum("y1"), F.sum("seen"), F.count("*")).first()
    if not n0 or not n1:
        return Scorer({}, 1.0)
    prior = FLOOR + PRIOR * (F.col("y0") + F.col("y1")) / (n0 + n1)
    whole = PRIOR + FLOOR * n_tokens
    odds = lambda y, n: F.log((F.col(y) + prior) / (n + whole - F.col(y) - prior))
    spread = F.sqrt(1 / (F.col("y0") + prior) + 1 / (F.col("y1") + prior))
    told = counts.select("token", "seen", "y0", "y1", (odds("y1", n1) - odds("y0", n0)).alias("delta"), spread.alias("spread"))
    # The sample bounds them: each stands in LEAST_SEEN of its texts.
    chosen = told.where((F.abs(F.col("delta") / F.col("spread")) >= LEAST_Z) & (F.col("y0") + F.col("y1") >= LEAST_SEEN)).orderBy("token").collect()
    model = Scorer({r["token"]: r["delta"] - DRIFT for r in chosen}, 1.0)
    share = np.array([(r["seen"] + 0.5) / max(seen, 1) for r in chosen] + [0.0])
    share[-1] = max(0.0, 1 - share.sum())
    model.rate = _rate(np.array([*model.scores.values(), -DRIFT]), share / share.sum())
    return model


def _measured(rows: DataFrame, models: list[Scorer], of) -> list:
    """toxic, fold, number of tokens and the two numbers that `of` makes of the model of the fold and all segments."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold"))):
                found, parts = models[fold].passages(text)
                out.append((toxic, fold, len(found), *of(models[fold], len(found), [p[2] for p in parts])))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["toxic", "fold", "n", "a", "b"])

    return rows.mapInArrow(run, "toxic int, fold int, n long, a double, b double").collect()


def score(docs: DataFrame, model: Scorer) -> DataFrame:
    """docs with score, predicted and n_passages; one pass, no shuffle."""
    import pyarrow as pa

    results = ("score", "predicted", "n_passages")
    plain = docs.drop(*results)
    schema = T.StructType(plain.schema.fields + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_passages", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = shared.value
        for batch in batches:
            for piece, texts in pieces(batch):
                out = list(zip(*map(scorer.score, texts)))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(out[0], pa.float64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], names=[*piece.schema.names, *results])

    return plain.mapInArrow(run, schema)


def passages(docs: DataFrame, model: Scorer) -> DataFrame:
    """A row for each significant passage: doc_id, first token, number of tokens, its sum and its tokens."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = shared.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found, parts = scorer.passages(text)
                for start, end, total in parts:
                    if scorer.significant(len(found), total):
                        rows.append((doc, start, end - start, float(total), " ".join(found[start:end])))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "first_token", "n_tokens", "total", "passage"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, first_token long, n_tokens long, total double, passage string")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs.withColumn("held_out", held_out(F.col("doc_id"))), model)
    return out.select("doc_id", "held_out", "score", "predicted", "n_passages")
