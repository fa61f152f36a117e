import random

import pytest

pytest.importorskip("larkspur.llm")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, score string, n_removed string, tag string, place string, known string"


@pytest.fixture
def docs(spark):
    """A documents table with further columns whose names clash with those of results and inner steps."""

    def make(rows):
        full = [(d, t, (more[0] if more else "en"), f"src{(d or 0) % 3}", None if t is None else len(t), *["x"] * 7) for d, t, *more in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def prose():
    """Random prose over a few syllables, with shared passages, copies and edges of all kinds."""

    def make(seed, n=40, words=80):
        rng = random.Random(seed)
        syllables = ["the", "an", "ou", "er", "ing", "st", "re", "ti", "on", "é", "中"]
        word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
        text = lambda k: " ".join(word() for _ in range(k))
        shared = [text(50) for _ in range(3)]
        out = []
        for d in range(n):
            parts = [text(rng.randint(1, words))]
            if rng.random() < 0.5:
                parts.insert(rng.randint(0, 1), rng.choice(shared)[rng.randint(0, 60) :])
            if rng.random() < 0.2:
                parts *= 2
            out.append((d, rng.choice(["\n", " ", "\t "]).join(parts)))
        copies = [(n + k, out[rng.randrange(n)][1]) for k in range(6)]
        near = [(n + 10 + k, out[k][1].replace(" ", " x ", 1)) for k in range(6)]
        odd = [(n + 20, None), (n + 21, ""), (n + 22, " \n\t "), (n + 23, "one"), (n + 24, "a b c"), (n + 25, "ha " * 400), (n + 26, "ha " * 300), (n + 27, out[0][1] + " " + text(4000)), out[3], out[3], (out[4][0], out[5][1]), (None, out[6][1]), (None, None)]
        return out + copies + near + odd

    return make
