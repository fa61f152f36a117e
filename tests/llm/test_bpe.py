import hashlib
import random

import pytest
from tokenizers import Tokenizer

from larkspur.llm import bpe


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.no_truncation(), t.no_padding()
    return t


@pytest.fixture(scope="module")
def coder():
    with open(bpe.VOCABULARY, encoding="utf-8") as f:
        return bpe.Encoder(f.read())


def texts():
    rng = random.Random(3)
    letters = "ab e\n\t'sdé ñßthinger 0123,.!?中\U0001f600<|endoftext|>"
    yield from ("", " ", "  a", "a" * 5000, "ab" * 5000, " " * 500, "\r\n\r\n", "it's we'll I'D", "x<|endoftext|>y <|endoftext|><|endoftext|>", "\x00\x01", "é", "  ")
    for size in (5, 30, 200):
        for _ in range(150):
            yield "".join(rng.choice(letters) for _ in range(size))
    for _ in range(200):
        yield "".join(rng.choice("thingers") for _ in range(40))


def test_ids_and_text_equal_the_library(coder, library):
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        got = coder.encode(text)
        assert got == want and coder.decode(got) == library.decode(want, skip_special_tokens=False), text


def test_random_tokens_side_by_side(coder, library):
    rng = random.Random(4)
    every = list(coder.bytes_of.values())
    for _ in range(300):
        text = b"".join(rng.choice(every) for _ in range(6)).decode("utf-8", "replace")
        assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_automaton_knows_all_substrings():
    words = [b"abcb", b"bcb", b"cba", b"b"]
    a = bpe.SuffixAutomaton(words)

    def state(s):
        at = 0
        for c in s:
            if c not in a.step[at]:
                return None
            at = a.step[at][c]
        return at

    inside = {w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    for x in inside:
        assert state(x) is not None
    assert state(b"ca") is None and state(b"abb") is None
    for number, w in enumerate(words):
        assert a.token[state(w)] == number and a.size[state(w)] == len(w)


def test_memo_that_overflows_changes_nothing(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    coder.memo.clear()
    text = "one two three four five six seven one two"
    assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_operator(docs, library):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "Hello world"), (4, "x<|endoftext|>"), (None, "é" * 3000)]
    out = bpe.digests(docs(rows).withColumnRenamed("n_words", "n_tokens")).collect()
    assert len(out) == len(rows)
    for (d, text), r in zip(sorted(rows, key=str), sorted(out, key=lambda r: str((r["doc_id"], r["text"])))):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (r["doc_id"], r["n_tokens"]) == (d, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    both = bpe.decode(bpe.encode(docs(rows))).collect()
    assert all(r["decoded_text"] == (r["text"] or "") for r in both)
    assert bpe.digests(docs(rows).limit(0)).count() == 0
