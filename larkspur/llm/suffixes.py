"""Suffix-array dedup (2): byte strings of 200 that stand in more than one place, by two-stage suffix sorting.

Windows are first cut into blocks around the least 64-byte string inside them (see repeats): what must be
compared is then a group of short contents with a common anchor. Their suffixes are put in order in two
stages: those smaller than their successors are sorted directly, all others follow from them in one scan
over the buckets of first bytes; neighbours in that order with 200 common bytes are repeats.

Whole texts count, as UTF-8 bytes, and matches never cross documents. Null and empty texts and texts of
under 200 bytes have nothing to remove; a text that stands twice, in whatever rows, is removed wholly
(from 200 bytes on); overlapping repeats within a text count; very long texts are cut into many blocks
like any other; rows with the same or a null doc_id are told apart by their text; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from larkspur.llm import blocks as B
from larkspur.llm.common import documents
from larkspur.llm.repeats import remove_repeats

WINDOW, GRAM = 200, 64


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; bytes past the end are 0."""
    padded = np.zeros(len(text) + 8, np.uint64)
    padded[: len(text)] = text
    out = padded[: len(text)] << np.uint64(56)
    for k in range(1, 8):
        out |= padded[k : len(text) + k] << np.uint64(56 - 8 * k)
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the empty suffix is the smallest of all."""
    n = len(text)
    step = np.ones(n, np.int8)
    step[:-1] = np.sign(text[:-1].astype(np.int16) - text[1:]).astype(np.int8)
    place = np.where(step != 0, np.arange(n), n - 1)
    return step[np.minimum.accumulate(place[::-1])[::-1]] < 0


def sort_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """places in the order of their first `depth` bytes, eight at a time; only ties go on."""
    n = len(words)
    order = places[np.argsort(words[places], kind="stable")]
    if len(order) < 2:
        return order
    # Slots of `order` that are still tied with a neighbour, and the number of the tie they belong to.
    new = np.concatenate(([True], words[order[1:]] != words[order[:-1]]))
    for at in range(8, depth, 8):
        tie = np.cumsum(new)
        tied = np.concatenate((~new[1:], [False])) | ~new
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        own, group = order[slots], tie[slots]
        ahead = own + at
        key = np.where(ahead < n, words[np.minimum(ahead, n - 1)], np.uint64(0))
        sort = np.lexsort((key, group))
        own, key, group = own[sort], key[sort], group[sort]
        order[slots] = own
        fresh = np.ones(len(slots), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        new[slots] = fresh
    return order


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """All places of text in the order of their suffixes' first `depth` bytes."""
    n = len(text)
    direct = smaller_than_next(text)
    order = sort_directly(np.flatnonzero(direct), words_at(text), depth)
    ends = np.searchsorted(text[order], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []

    def before(places: np.ndarray) -> np.ndarray:
        """The places before these whose suffixes follow from them."""
        back = places[places > 0] - 1
        return back[~direct[back]]

    for byte in range(256):
        scanned = []
        found = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        while len(found):
            scanned.append(found)
            back = before(found)
            found = back[text[back] == byte]
        scanned.append(order[ends[byte] : ends[byte + 1]])
        bucket = np.concatenate(scanned)
        out.append(bucket)
        back = before(bucket)
        back = back[text[back] > byte]
        if len(back):
            firsts = text[back]
            sort = np.argsort(firsts, kind="stable")
            back, firsts = back[sort], firsts[sort]
            for start in B.runs(firsts):
                waiting[firsts[start]].append(back[start : np.searchsorted(firsts, firsts[start], "right")])
    return np.concatenate(out)


def equal_neighbours(text: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """For each pair of neighbours in order, whether their first `size` bytes (all inside text) agree."""
    words = words_at(text)
    left, right = order[:-1], order[1:]
    alike = np.arange(len(left))
    for at in [*range(0, size - 8, 8), size - 8]:
        alike = alike[words[left[alike] + at] == words[right[alike] + at]]
    out = np.zeros(len(left), bool)
    out[alike] = True
    return out


class Bytes:
    """Windows of bytes, for repeats."""

    rounds = 0

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.fields = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType())]
        self.kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def blocks(self, data, starts, ends):
        return B.byte_blocks(data, starts, ends, self.window, self.gram)

    def contents(self, text: bytes, places):
        return [text[start : start + count - 1 + self.window] for start, count in places]

    def repeated(self, contents: list[bytes]) -> list[np.ndarray]:
        """For each content, which of its windows stand elsewhere in the contents."""
        text = np.frombuffer(b"\xff".join(contents) + b"\xff", np.uint8)
        sizes = np.array([len(c) for c in contents])
        starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        window = np.zeros(len(text) + 1, np.int32)
        window[starts] += 1
        np.subtract.at(window, starts + sizes - self.window + 1, 1)
        valid = np.cumsum(window[:-1]) > 0
        order = suffix_order(text, self.window)
        order = order[valid[order]]
        same = equal_neighbours(text, order, self.window)
        flags = np.zeros(len(text), bool)
        flags[order[:-1][same]] = True
        flags[order[1:][same]] = True
        return [flags[s : s + n - self.window + 1] for s, n in zip(starts, sizes)]

    def rel(self, content: bytes) -> int:
        data = np.frombuffer(content, np.uint8)
        return int(self.blocks(data, np.array([0]), np.array([len(data)])).rel[0])

    def units(self, content: bytes) -> bytes:
        return content

    def joined(self, units: bytes) -> bytes:
        return units

    def spans(self, covered, size: int | None = None) -> list[tuple[int, int]]:
        """Ranges of window starts as maximal ranges of covered places."""
        out: list[list[int]] = []
        for lo, hi in sorted(covered):
            if out and lo <= out[-1][1]:
                out[-1][1] = max(out[-1][1], hi - 1 + self.window)
            else:
                out.append([lo, hi - 1 + self.window])
        return [(a, b) for a, b in out]

    def kept(self, text: bytes, covered) -> tuple[bytes, list[tuple[int, int]]]:
        spans, parts, at = self.spans(covered), [], 0
        for a, b in spans:
            parts.append(text[at:a])
            at = b
        parts.append(text[at:])
        return b"".join(parts), spans

    def digest(self, text: bytes, covered):
        rest, spans = self.kept(text, covered)
        return len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, sizes and digest of each text without its repeated strings of `window` bytes."""
    return remove_repeats(docs, Bytes(window, min(GRAM, window)))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(documents(spark, sf_dir).select("doc_id", "text"))
