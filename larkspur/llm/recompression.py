"""Substring dedup (5): runs of 35 words that stand in more than one place, by recompression.

Names are content hashes, so equal runs of words get equal names on every executor without a dictionary.

1. Inside a text, rounds of recompression replace runs of one name by a name for the run, and pairs whose left
   name has bit 0 and right name bit 1 by a name for the pair; only symbols short enough for the round
   take part (ROUNDS). Whether two words end up in one symbol then depends on REACH words on either side, so
   equal windows have the same symbol borders inside, wherever they stand. The border with the least
   fingerprint of the words around it anchors a window, and the windows of a text fall into runs that
   share an anchor: the symbols of the next level.
2. Spark names and counts these symbols over all texts (see repeats): first by their anchor, then by all of their
   words. Shared ones are repeats as a whole.
3. Further rounds in Spark (MERGES) merge neighbouring shared symbols of a text, runs and pairs as above, name the
   result and count the names over all texts; a larger symbol stands if it is shared, else its parts do. A
   repeat of thousands of words ends up as few symbols, so texts are read again with a few ranges for
   each long repeat and not with one for every ten words.
4. Shared symbols are what equal runs of windows have in common; what is left at the ends of repeats, symbols
   that share their anchor and not their words, is compared window by window, word by word.

Windows inside one long run have no border and anchor themselves. Names are xxh3 of the words and of
their sequence. Null and empty texts have no words; texts of under 35 words keep all;
repeats within a text count, also where they overlap; a text that stands twice is removed wholly (from 35
words on); very long texts are cut into blocks like any other; rows with the same or a null doc_id are
told apart by their text; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import blocks as B
from larkspur.llm.common import Stage, WordNames, documents
from larkspur.llm.repeats import remove_repeats

WINDOW, REACH = 35, 5
#: Longest symbols that each round may pair. REACH follows from these: 2 words for runs and the first
#: round, and as many more as the longest symbol of each further round.
ROUNDS = (1, 1, 2)
#: Rounds in Spark that merge shared symbols.
MERGES = 3
WORD = re.compile(rb"[^\x20\x09-\x0D]+").findall
U = np.uint64


def symbols(names: np.ndarray, text: np.ndarray) -> np.ndarray:
    """First words of the symbols that recompression leaves; text: the text of each word."""
    if not len(names):
        return np.zeros(0, np.int64)
    change = np.ones(len(names), bool)
    change[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(change)
    size = np.diff(np.concatenate((at, [len(names)])))
    name = np.where(size > 1, B.mix(names[at] + size.astype(np.uint64)), names[at])
    for number, most in enumerate(ROUNDS):
        right = (B.mix(name + U(number + 1)) >> U(63)).astype(bool)
        short = size <= most
        own = text[at]
        join = short[:-1] & short[1:] & ~right[:-1] & right[1:] & (own[:-1] == own[1:])
        left = np.flatnonzero(join)
        name[left] = B.mix(B.mix(name[left]) * U(3) + name[left + 1])
        size[left] += size[left + 1]
        keep = np.ones(len(at), bool)
        keep[left + 1] = False
        at, size, name = at[keep], size[keep], name[keep]
    return at


def word_blocks(names: np.ndarray, text: np.ndarray, window: int) -> B.Blocks:
    """Blocks of windows of words; row is the text, start counts words from the text's first."""
    empty = np.zeros(0, np.int64)
    n = len(names) - window + 1
    if n < 1:
        return B.Blocks(*[empty] * 6)
    if n > B.PIECE:
        # As in byte_blocks; a border depends on words of its window alone, so pieces have the same ones.
        parts = []
        for lo in range(0, n, B.PIECE):
            own = text[lo : lo + B.PIECE + window - 1]
            part = word_blocks(names[lo : lo + B.PIECE + window - 1], own, window)
            part.start = part.start + np.where(part.row == own[0], lo - np.searchsorted(text, own[0]), 0)
            parts.append(part)
        return B.joined(parts)
    around = B.Prefix(names, 0)
    borders = symbols(names, text)
    borders = borders[(borders >= REACH) & (borders + REACH <= len(names))]
    near = around.of(borders - REACH, borders + REACH)
    keys = np.full(len(names), np.iinfo(np.uint64).max, np.uint64)
    keys[borders] = ((near >> U(24)) << U(24)) | borders.astype(np.uint64)
    low = B.least(keys[REACH : len(names) - REACH + 1], window - 2 * REACH + 1)[:n]
    at = np.where(low == np.iinfo(np.uint64).max, -1 - np.arange(n), (low & U(0xFFFFFF)).astype(np.int64))
    inside = text[:n] == text[window - 1 :]
    tagged = np.where(inside, at, np.int64(-1) << 40)
    first = B.runs(tagged)
    last = np.concatenate((first[1:], [n]))
    real = inside[first]
    first, last = first[real], last[real]
    anchored = tagged[first] >= 0
    border = np.where(anchored, tagged[first], first + REACH)
    anchor = around.of(np.where(anchored, border - REACH, first), np.where(anchored, border + REACH, first + window))
    body = B.hashed(names, first, last - 1 + window) ^ B.mix((border - first + 1).astype(np.uint64))
    heads = np.concatenate(([0], np.flatnonzero(text[1:] != text[:-1]) + 1))
    head = heads[np.searchsorted(heads, first, "right") - 1]
    return B.Blocks(text[first], first - head, last - first, B.signed(anchor), B.signed(body), border - first)


def _neighbours(rows: DataFrame):
    """The symbols of a text in order, and those that follow each other without a gap."""
    order = Window.partitionBy("doc_id", "tag").orderBy("start")
    rows = rows.withColumn("left", F.when(F.lag(F.col("start") + F.col("count")).over(order) == F.col("start"), F.lag("name").over(order)))
    return rows.withColumn("right", F.when(F.lead("start").over(order) == F.col("start") + F.col("count"), F.lead("name").over(order))), order


def _runs(rows: DataFrame) -> DataFrame:
    """Symbols with the name and the start of the run of one and the same symbol that they are part of; null if it is no run."""
    rows, order = _neighbours(rows)
    rows = rows.withColumn("run", F.sum(F.when(F.col("left") == F.col("name"), 0).otherwise(1)).over(order))
    run = Window.partitionBy("doc_id", "tag", "run")
    rows = rows.withColumn("times", F.count("*").over(run)).withColumn("first", F.min("start").over(run))
    larger = F.when(F.col("times") > 1, F.xxhash64("name", "times", F.lit("run")))
    return rows.select("doc_id", "tag", "start", "count", "name", larger.alias("larger"), "first")


def _pairs(rows: DataFrame, number: int) -> DataFrame:
    """Symbols with the name and the start of the pair that they are part of: a left symbol by its name's bit, and a right one behind it."""
    rows, order = _neighbours(rows)
    bit = lambda c: F.xxhash64(c, F.lit(number)).bitwiseAND(F.lit(1))
    opens = (bit("name") == 0) & (bit("right") == 1)
    closes = (bit("name") == 1) & (bit("left") == 0)
    rows = rows.withColumn("before", F.lag("start").over(order))
    larger = F.when(F.col("right").isNotNull() & opens, F.xxhash64("name", "right")).when(F.col("left").isNotNull() & closes, F.xxhash64("left", "name"))
    first = F.when(F.col("right").isNotNull() & opens, F.col("start")).when(F.col("left").isNotNull() & closes, F.col("before"))
    return rows.select("doc_id", "tag", "start", "count", "name", larger.alias("larger"), first.alias("first"))


class Words:
    """Windows of words, for repeats."""

    rounds = MERGES

    def merged(self, symbols: DataFrame, stage: Stage) -> DataFrame:
        """Symbols (doc_id, tag, start, count, name) that neither run nor pair merges any more, or MERGES rounds have merged."""
        for number in range(self.rounds):
            for named in (_runs, lambda rows, k=number: _pairs(rows, k)):
                found = stage.cut(named(symbols))
                # Named alike wherever they stand; only names that stand twice are kept, else their parts.
                twice = stage.cut(found.where("larger IS NOT NULL").groupBy("larger").agg(F.countDistinct("doc_id", "tag", "first").alias("n")).where("n > 1").select("larger", F.lit(True).alias("kept")))
                if twice.isEmpty():
                    continue
                told = found.join(twice.hint("merge"), "larger", "left")
                whole = told.where("kept").groupBy("doc_id", "tag", F.col("first").alias("start"), F.col("larger").alias("name")).agg(F.sum("count").alias("count"))
                before, symbols = symbols, stage.cut(told.where("kept IS NULL").select("doc_id", "tag", "start", "count", "name").unionByName(whole))
                stage.drop(before, found, twice)
        return symbols.select("doc_id", "tag", "start", "count")

    def __init__(self, window: int = WINDOW):
        self.window, self.names = window, WordNames()
        self.fields = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType())]
        self.kinds = [pa.int64(), pa.int64(), pa.string()]

    def named(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Names of all words, and the text of each."""
        found = [self.names.of(t) for t in texts]
        return np.concatenate([np.zeros(0, np.uint64), *found]), np.repeat(np.arange(len(found)), [len(f) for f in found])

    def blocks(self, data, starts, ends):
        raw = data.tobytes()
        return word_blocks(*self.named([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]), self.window)

    def contents(self, text: bytes, places):
        words = WORD(text)
        return [b" ".join(words[start : start + count - 1 + self.window]) for start, count in places]

    def rel(self, content: bytes) -> int:
        return int(word_blocks(*self.named([content]), self.window).rel[0])

    def units(self, content: bytes) -> list[bytes]:
        return content.split(b" ")

    def joined(self, units: list[bytes]) -> bytes:
        return b" ".join(units)

    def repeated(self, contents: list[bytes]) -> list[np.ndarray]:
        """For each content, which of its windows stand elsewhere in the contents, by comparing words."""
        # Numbers for words that are equal only for equal words.
        numbers: dict[bytes, int] = {}
        split = [c.split(b" ") for c in contents]
        codes = np.array([numbers.setdefault(w, len(numbers)) for c in split for w in c], np.int64)
        text = np.repeat(np.arange(len(split)), [len(c) for c in split])
        n = len(codes) - self.window + 1
        valid = np.flatnonzero(text[:n] == text[self.window - 1 :])
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(codes, self.window)[valid])
        _, same, often = np.unique(rows.view(np.dtype((np.void, rows.itemsize * self.window))).ravel(), return_inverse=True, return_counts=True)
        flags = often[same] > 1
        bounds = np.searchsorted(text[valid], np.arange(len(contents) + 1))
        return [flags[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def kept(self, text: bytes, covered) -> tuple[list[bytes], int]:
        words, parts, at = WORD(text), [], 0
        for lo, hi in sorted(covered):
            if lo > at:
                parts += words[at:lo]
            at = max(at, hi - 1 + self.window)
        return parts + words[at:], len(words)

    def digest(self, text: bytes, covered):
        rest, n = self.kept(text, covered)
        return n, n - len(rest), hashlib.sha256(b" ".join(rest)).hexdigest()


def remove_repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, sizes and digest of each text without its repeated runs of `window` words."""
    if window < 3 * REACH:
        raise ValueError(f"windows of at least {3 * REACH} words are needed to hold a border in common")
    return remove_repeats(docs, Words(window))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(documents(spark, sf_dir).select("doc_id", "text"))
