import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import blocks as B
from larkspur.llm import recompression as R
from larkspur.llm import repeats
from larkspur.llm import suffixes as S

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_bytes(rows, window):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for (d, _), b in zip(rows, raw):
        cover = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                cover[i : i + window] = b"\1" * window
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out.append((d, len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest()))
    return out


def plain_words(rows, window):
    split = [WORD.findall((t or "").encode()) for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, split):
        cover = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                cover[i : i + window] = b"\1" * window
        out.append((d, len(w), sum(cover), hashlib.sha256(b" ".join(x for x, c in zip(w, cover) if not c)).hexdigest()))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("limit", [repeats.LIMIT, 1])
def test_bytes_equal_brute_force(docs, prose, monkeypatch, limit):
    monkeypatch.setattr(repeats, "LIMIT", limit)  # 1: every group takes the way of the large ones
    rows = prose(1)
    assert rows_of(repeats.remove_repeats(docs(rows), S.Bytes(60, 20))) == sorted(plain_bytes(rows, 60), key=str)


@pytest.mark.parametrize("limit", [repeats.LIMIT, 1])
def test_words_equal_brute_force(docs, prose, monkeypatch, limit):
    monkeypatch.setattr(repeats, "LIMIT", limit)
    rows = prose(2)
    assert rows_of(R.remove_repeated_words(docs(rows), 18)) == sorted(plain_words(rows, 18), key=str)


def test_empty_tables(docs, prose):
    nothing = docs(prose(1)).limit(0)
    assert S.remove_repeated_bytes(nothing).count() == 0 and R.remove_repeated_words(nothing).count() == 0


def test_small_word_windows_are_refused(docs):
    with pytest.raises(ValueError):
        R.remove_repeated_words(docs([(1, "a")]), 10)


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(200):
        alphabet = rng.choice([b"ab", b"abc", b"a", bytes(range(256))])
        t = np.array([rng.choice(alphabet) for _ in range(rng.randint(1, 60))], np.uint8)
        assert S.suffix_order(t, 64).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tobytes())


def test_equal_windows_share_their_anchor():
    """Whatever stands around it, and wherever it stands, a window has one anchor."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        vocabulary = B.mix(np.arange(1, rng.integers(2, 40), dtype=np.uint64))
        core = rng.choice(vocabulary, 60)
        if rng.random() < 0.3:
            core[10:45] = core[10]
        seen = []
        for _ in range(3):
            left, right = rng.choice(vocabulary, rng.integers(0, 30)), rng.choice(vocabulary, rng.integers(0, 30))
            names = np.concatenate((left, core, right))
            found = R.word_blocks(names, np.zeros(len(names), np.int64), 35)
            assert found.count.sum() == len(names) - 34
            anchors = np.repeat(found.anchor, found.count)
            seen.append(anchors[len(left) : len(left) + 26].tolist())
        assert seen[0] == seen[1] == seen[2]


def test_blocks_cover_every_window_once():
    texts = [b"", b"x" * 500, b"abc" * 90, bytes(range(97, 123)) * 20, b"", b"short"]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    starts = np.concatenate(([0], ends[:-1]))
    found = B.byte_blocks(data, starts, ends, 200, 64)
    for row, text in enumerate(texts):
        mine = sorted(zip(found.start[found.row == row], found.count[found.row == row]))
        at = 0
        for start, count in mine:
            assert start == at and 0 < count <= 137
            at += count
        assert at == max(0, len(text) - 199)


def windows_of(found):
    """Text, place and anchor of each window; blocks that a cut parted count as one."""
    row, count = np.repeat(found.row, found.count), np.asarray(found.count)
    at = np.repeat(found.start - (np.cumsum(count) - count), count) + np.arange(count.sum())
    order = np.lexsort((at, row))
    return row[order], at[order], np.repeat(found.anchor, count)[order]


@pytest.mark.parametrize("piece", [50, 333, 1000])
def test_pieces_of_long_texts_have_the_same_anchors(monkeypatch, piece):
    rng = np.random.default_rng(5)
    sizes = np.array([3, 900, 0, 1500, 40, 700])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data, text = rng.integers(97, 100, ends[-1]).astype(np.uint8), np.repeat(np.arange(len(sizes)), sizes)
    data[1000:1200] = 97  # a run
    names = B.mix(data.astype(np.uint64) + np.uint64(1))
    whole = windows_of(B.byte_blocks(data, starts, ends, 40, 16)), windows_of(R.word_blocks(names, text, 35))
    monkeypatch.setattr(B, "PIECE", piece)
    parts = windows_of(B.byte_blocks(data, starts, ends, 40, 16)), windows_of(R.word_blocks(names, text, 35))
    for a, b in zip(whole, parts):
        assert all((x == y).all() for x, y in zip(a, b))


def test_places_beyond_24_bits(monkeypatch):
    far, size = (1 << 24) + 3000, (1 << 24) + 5000
    data = np.random.default_rng(6).integers(97, 123, size).astype(np.uint8)
    data[far : far + 400] = data[1000:1400]
    found = B.byte_blocks(data, np.array([0]), np.array([size]), 200, 64)
    names = B.mix(data.astype(np.uint64) + np.arange(size, dtype=np.uint64) * np.uint64(256))
    names[far : far + 400] = names[1000:1400]
    for found, last in ((found, 201), (R.word_blocks(names, np.zeros(size, np.int64), 35), 366)):
        _, at, anchor = windows_of(found)
        assert len(at) == at[-1] + 1 and (anchor[far : far + last] == anchor[1000 : 1000 + last]).all()


def test_windows_longer_than_a_byte_counts(docs):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(1200)
    rows = [(1, text(700) + shared + text(300)), (2, text(50) + shared + text(900)), (3, text(2000)), (4, shared[:399]), (5, shared[:400])]
    assert rows_of(S.remove_repeated_bytes(docs(rows), 400)) == sorted(plain_bytes(rows, 400), key=str)
    assert [r[2] for r in plain_bytes(rows, 400)] == [1200, 1200, 0, 0, 400]
    with pytest.raises(ValueError):
        S.remove_repeated_bytes(docs(rows), 1 << 16)


def test_texts_of_over_16_mib(docs):
    rng = np.random.default_rng(9)
    long = rng.integers(97, 123, (1 << 24) + 100_000).astype(np.uint8).tobytes().decode()
    shared = long[-60_000:-58_800]
    words = [str(k) for k in rng.integers(0, 2000, (1 << 24) + 50_000).tolist()]
    got = {r["doc_id"]: r["n_removed"] for r in S.remove_repeated_bytes(docs([(1, long), (2, "short " + shared + " text")])).collect()}
    assert got == {1: 1200, 2: 1200}
    found = R.remove_repeated_words(docs([(1, " ".join(words)), (2, " ".join(["other", *words[-9100:-9000], "text"]))])).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in found} == {1: ((1 << 24) + 50_000, 100), 2: (102, 100)}


def test_words_that_polynomials_take_for_one(docs):
    """A Thue-Morse word and its complement have one polynomial fingerprint modulo 2**64."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rest = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(rest[:20] + [one] + rest[20:])), (2, " ".join(rest[:20] + [two] + rest[20:])), (3, " ".join(rest[5:] + [one]))]
    assert rows_of(R.remove_repeated_words(docs(rows))) == sorted(plain_words(rows, 35), key=str)


@pytest.mark.parametrize("limit, steps", [(3, (16, 1)), (1, (5, 1))])
def test_large_groups_of_different_contents(docs, monkeypatch, limit, steps):
    monkeypatch.setattr(repeats, "LIMIT", limit)
    monkeypatch.setattr(repeats, "STEPS", steps)
    rng = random.Random(11)
    base = [rng.choice("abcdefghij") * 2 + str(rng.randint(0, 99)) for _ in range(80)]
    rows = []
    for d in range(40):
        words = base[rng.randint(0, 20) :]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"edit{rng.randint(0, 9)}"
        rows.append((d, " ".join(words)))
    assert rows_of(S.remove_repeated_bytes(docs(rows), 60)) == sorted(plain_bytes(rows, 60), key=str)
    assert rows_of(R.remove_repeated_words(docs(rows), 18)) == sorted(plain_words(rows, 18), key=str)


def test_nothing_is_left_but_the_result(spark, docs, prose):
    from larkspur.llm.common import release, results, shared_dir

    release(results())
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = len(fs.listStatus(root)) if fs.exists(root) else 0
    out = S.remove_repeated_bytes(docs(prose(4)))
    (folder,) = results()
    assert len(fs.listStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))) == 1 and out.count() > 0
    release({folder})
    assert len(fs.listStatus(root)) == before
    with pytest.raises(Exception):
        S.remove_repeated_bytes(docs(prose(4)).selectExpr("doc_id", "raise_error('no') AS text"))
    assert len(fs.listStatus(root)) == before and not results()


def test_shared_symbols_merge(spark):
    """Two texts with 200 shared symbols in a row, one of them ten times over, and a third with every second one."""
    from larkspur.llm.common import Stage

    names = [k if not 50 <= k < 60 else 50 for k in range(200)]
    rows = [(d, 7, 10 * k + 5 * d, 10, name) for d in (1, 2) for k, name in enumerate(names)] + [(3, 7, 20 * k, 10, k) for k in range(100)]
    with Stage(spark) as stage:
        got = [tuple(r) for r in R.Words().merged(stage.cut(spark.createDataFrame(rows, "doc_id long, tag long, start long, count long, name long")), stage).collect()]
    for d in (1, 2, 3):
        mine = sorted((s, n) for i, _, s, n in got if i == d)
        if d < 3:
            assert len(mine) < 120 and mine[0][0] == 5 * d and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:])) and sum(n for _, n in mine) == 2000
        else:
            assert mine == [(20 * k, 10) for k in range(100)]
    lengths = [sorted((s - 5 * d, n) for i, _, s, n in got if i == d) for d in (1, 2)]
    assert lengths[0] == lengths[1] and (500, 100) in lengths[0] or any(a <= 500 and a + n >= 600 for a, n in lengths[0])
