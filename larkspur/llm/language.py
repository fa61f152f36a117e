"""Language ID (6): error-correcting output codes over binary character n-gram classifiers.

Each learned language gets a codeword of +1 and -1. For every bit a binary classifier over hashed byte
trigrams learns whether a text belongs to the languages with +1 there; a text's margins are decoded to
the codeword of least weighted logistic loss. `ambiguous` marks texts whose winner is not clear.

Training takes a bounded sample, SAMPLE texts of each language at most (in expectation), picked by a hash
among the rows with a language that are not held out. Three of four of them are counted, the fourth measures how far the
classifiers can be trusted (scale of margins, weight of losses); both happen on the executors, and the
driver sees BUCKETS numbers a language at most. Every language is learned, however rare. The model is a
table of BUCKETS x bits floats. Prediction is one Arrow pass without a shuffle.

Texts that are null or have no letters get `und` and 0; so does everything when no row has a language.
Copies get equal answers, ties go to the first language in alphabetical order, very long texts are read
whole, rows without a doc_id are not held out, and columns of docs named like our results are replaced.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import documents, pieces

BUCKETS, SAMPLE, CLEAR = 1 << 15, 300, 0.6
LETTER = regex.compile(r"\p{L}")
RESULTS = ("lang_pred", "score", "ambiguous")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _fold() -> np.ndarray:
    """Bytes as classifiers see them: ASCII letters in lower case, other ASCII as blanks, the rest as is."""
    t = np.arange(256, dtype=np.uint32)
    ascii_letter = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
    t[ascii_letter] |= 32
    t[(t < 128) & ~ascii_letter] = 32
    return t


FOLD = _fold()


def grams(text: bytes) -> np.ndarray:
    b = FOLD[np.frombuffer(b" " + text + b"  ", np.uint8)]
    return (((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(17)


def codewords(n: int) -> np.ndarray:
    """n codewords: every split of the languages in two while there are few of them, else rows of a fixed random code."""
    if n <= 5:
        splits = [(1, *rest) for rest in product((1, -1), repeat=n - 1)]
        splits = [s for s in splits if -1 in s] or [(1,) * n]
        return np.array(splits, dtype=np.float64).T
    bits = int(np.ceil(10 * np.log2(n)))
    return np.random.default_rng(7).choice([-1.0, 1.0], size=(n, bits))


class Coder:
    """Codewords, classifier weights and their loss weights, of a size that only the number of languages changes."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: how often each language's sample has the grams of each bucket."""
        self.langs = langs
        if not langs:
            return
        share = counts + 0.05
        share = share / share.sum(axis=1, keepdims=True)
        self.code = codewords(len(langs))
        plus = (self.code > 0).astype(float)
        side = lambda member: (member.T @ share) / np.maximum(member.sum(axis=0), 1)[:, None] + 1e-12
        self.weights = (np.log(side(plus)) - np.log(side(1 - plus))).T.astype(np.float32)
        self.scale, self.loss_weight = np.ones(self.code.shape[1]), np.ones(self.code.shape[1])

    def margin(self, text: bytes) -> np.ndarray:
        return self.weights[grams(text)].mean(axis=0, dtype=np.float64)

    def trust(self, n: int, sizes: np.ndarray, right: np.ndarray) -> None:
        """From n texts: sums of the margins' sizes, and how often each classifier was right."""
        if n:
            self.scale = 3.0 / np.maximum(sizes / n, 1e-6)
            self.loss_weight = np.maximum(right / n - 0.5, 0.01) * 2

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        if text is None or not self.langs or not LETTER.search(text.decode("utf-8", "replace")):
            return "und", 0.0, True
        margin = self.margin(text) * self.scale
        loss = (np.logaddexp(0, -self.code * margin) * self.loss_weight).sum(axis=1)
        odds = np.exp(loss.min() - loss)
        best = int(np.argmin(loss))
        score = float(1 / odds.sum())
        return self.langs[best], score, score < CLEAR


def train(docs: DataFrame, sample: int = SAMPLE) -> Coder:
    """Fit on rows that have a language and are not held out, `sample` of each language at most (in expectation)."""
    import pyarrow as pa

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.xxhash64("doc_id", "text", F.lit("language")).alias("draw"), F.col("text").cast("binary").alias("text"), "lang")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(sizes)
    if not langs:
        return Coder([], np.zeros((0, BUCKETS)))
    place = {lang: k for k, lang in enumerate(langs)}
    parts = docs.sparkSession.createDataFrame([(lang, place[lang], min(1.0, sample / n) * 1_000_000) for lang, n in sizes.items()], "lang string, k int, part double")
    picked = known.join(F.broadcast(parts), "lang").where(F.pmod("draw", F.lit(1_000_000)) < F.col("part"))
    picked = picked.select("k", "text", (F.pmod(F.xxhash64("draw"), F.lit(4)) == 0).alias("judge"))

    def count(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, text in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist()):
                total[k] = total.get(k, 0) + np.bincount(grams(text), minlength=BUCKETS)
        for k, found in total.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], names=["k", "bucket", "n"])

    counted = picked.where("NOT judge").mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), BUCKETS))
    counts[counted["k"].to_numpy(), counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    coder = Coder(langs, counts)

    def measure(batches):
        n, bits = 0, coder.code.shape[1]
        sizes, right = np.zeros(bits), np.zeros(bits)
        for batch in batches:
            for k, text in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist()):
                margin = coder.margin(text)
                n, sizes, right = n + 1, sizes + np.abs(margin), right + (margin * coder.code[k] > 0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sizes.tolist()]), pa.array([right.tolist()])], names=["n", "sizes", "right"])

    rows = picked.where("judge").mapInArrow(measure, "n long, sizes array<double>, right array<double>").collect()  # one row a task
    coder.trust(sum(r["n"] for r in rows), sum((np.array(r["sizes"]) for r in rows), np.zeros(1)), sum((np.array(r["right"]) for r in rows), np.zeros(1)))
    return coder


def identify(docs: DataFrame, coder: Coder) -> DataFrame:
    """docs with lang_pred, score and ambiguous; one pass, no shuffle."""
    import pyarrow as pa

    plain = docs.drop(*RESULTS)
    schema = T.StructType(plain.schema.fields + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(coder)

    def run(batches):
        model = shared.value
        for batch in batches:
            for piece, texts in pieces(batch):
                out = list(zip(*map(model.predict, texts)))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.bool_())], names=[*piece.schema.names, *RESULTS])

    return plain.mapInArrow(run, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    slim = docs.select("doc_id", "text")
    out = identify(slim.withColumn("held_out", held_out(F.col("doc_id"))), train(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
