"""BPE encoding and decoding (1): per-prefix dynamic programming with back-pointers.

A byte-level BPE encoding has one last token for every prefix of a pre-token. A suffix automaton of
the vocabulary finds, while it reads the bytes, every token that ends at the present place; the one
whose start is reachable by a token it is compatible with (the pair encodes to itself) is stored for
the prefix. Following the stored tokens back from the end gives the ids, which are exactly those of
repeated lowest-rank merging, in time linear in the text.

The vocabulary is read on the driver (`path` is a parameter) and broadcast: a fixed few MB. Encoding is
one Arrow pass without a shuffle; each worker builds the automaton once and remembers pre-tokens it has
met, up to MEMO of them, and pairs of tokens, up to PAIRS. Whole texts are encoded: null and empty texts give no ids; special tokens in a
text get their own ids; copies get equal results; a pre-token of any length takes linear time and is
not remembered; columns of docs named like our results are replaced. Bytes that are no UTF-8 are read
as U+FFFD.
"""

from __future__ import annotations

import hashlib
import json

import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import documents, pieces

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
MEMO, LONG, PAIRS = 400_000, 48, 2_000_000


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class SuffixAutomaton:
    """All substrings of the tokens; a state whose longest string is a token carries it."""

    def __init__(self, tokens: list[bytes]):
        self.step, self.link, self.size, self.token = [{}], [-1], [0], [-1]
        for number, token in enumerate(tokens):
            state = 0
            for byte in token:
                state = self._extend(state, byte)
            self.token[state] = number
        # The nearest state with a token on the way up: itself, or what its suffix link leads to.
        self.above = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.size.__getitem__):
            self.above[state] = state if self.token[state] >= 0 else self.above[self.link[state]]

    def _new(self, step: dict, size: int, link: int) -> int:
        self.step.append(step), self.size.append(size), self.link.append(link), self.token.append(-1)
        return len(self.link) - 1

    def _split(self, state: int, byte: int, to: int) -> int:
        """Give `to` a twin for the strings no longer than those of `state` and one byte."""
        twin = self._new(dict(self.step[to]), self.size[state] + 1, self.link[to])
        self.link[to] = twin
        while state >= 0 and self.step[state].get(byte) == to:
            self.step[state][byte] = twin
            state = self.link[state]
        return twin

    def _extend(self, last: int, byte: int) -> int:
        to = self.step[last].get(byte)
        if to is not None:
            return to if self.size[to] == self.size[last] + 1 else self._split(last, byte, to)
        state = self._new({}, self.size[last] + 1, 0)
        while last >= 0 and byte not in self.step[last]:
            self.step[last][byte] = state
            last = self.link[last]
        if last >= 0:
            to = self.step[last][byte]
            self.link[state] = to if self.size[to] == self.size[last] + 1 else self._split(last, byte, to)
        return state


class Encoder:
    def __init__(self, spec: str):
        """spec: the JSON of a byte-level tokenizer without normaliser."""
        about = json.loads(spec)
        model, names = about["model"], byte_names()
        raw = lambda name: bytes(names[c] for c in name)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # Ranks: single bytes first, then merges in order. A token's rank tells when it comes into being.
        self.tokens = [bytes([b]) for b in range(256)]
        rank = {t: k for k, t in enumerate(self.tokens)}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in pairs:
            pair = rank[raw(left)], rank[raw(right)]
            joined = raw(left + right)
            if joined not in rank:
                rank[joined] = len(self.tokens)
                self.tokens.append(joined)
                self.parts.append(pair)
            self.merged.setdefault(pair, rank[joined])
        self.id = [0] * len(self.tokens)
        self.bytes_of: dict[int, bytes] = {}
        for name, number in model["vocab"].items():
            token = raw(name)
            self.bytes_of[number] = token
            if token in rank:
                self.id[rank[token]] = number
        self.special = {t["content"]: t["id"] for t in about["added_tokens"]}
        self.bytes_of |= {number: text.encode() for text, number in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.automaton = SuffixAutomaton(self.tokens)
        self.fits: dict[int, bool] = {}
        self.memo: dict[str, tuple[int, str, bytes]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether left and right, side by side, stay two tokens.

        No merge may take place across the border. The tokens at the border are followed back through
        their makings, latest first; a pair of them that would have merged before the younger of the two
        was itself merged on breaks the border.
        """
        key = left << 20 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        # The border tokens over time: `a` is the suffix chain of left, `b` the prefix chain of right.
        a, b, until_a, until_b = left, right, 1 << 60, 1 << 60
        while True:
            joined = self.merged.get((a, b))
            if joined is not None:
                # The pair stands from the making of its younger member to the first merge of either side.
                # Of merges of one rank the leftmost goes first.
                if joined < until_a and joined <= until_b:
                    return False
            # Step back the one that was made last.
            if a >= b and self.parts[a] is not None:
                until_a, a = a, self.parts[a][1]
            elif self.parts[b] is not None:
                until_b, b = b, self.parts[b][0]
            elif self.parts[a] is not None:
                until_a, a = a, self.parts[a][1]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ranks of the tokens of one pre-token."""
        automaton = self.automaton
        step, link, size, token, above = automaton.step, automaton.link, automaton.size, automaton.token, automaton.above
        last, compatible, tokens = [0] * len(piece), self.compatible, self.tokens
        state = length = 0
        for end, byte in enumerate(piece):
            while byte not in step[state]:
                state = link[state]
                length = size[state]
            state, length = step[state][byte], length + 1
            at = above[state]
            if at == state and length < size[state]:
                at = above[link[state]]
            while True:  # longest first; exactly one token fits
                number, start = token[at], end + 1 - size[at]
                if start == 0 or compatible(last[start - 1], number):
                    last[end] = number
                    break
                at = above[link[at]]
        out, end = [], len(piece)
        while end:
            out.append(last[end - 1])
            end -= len(tokens[out[-1]])
        return out[::-1]

    def _piece(self, piece: str) -> tuple[int, str, bytes]:
        """Number of ids, ids as `,1,2` and decoded bytes of a pre-token."""
        raw = piece.encode()
        ids = [self.id[r] for r in self.encode_piece(raw)]
        decoded = b"".join(map(self.bytes_of.__getitem__, ids))
        found = len(ids), "".join(f",{i}" for i in ids), decoded
        if len(piece) <= LONG:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = found
        return found

    def _found(self, text: str) -> list[tuple[int, str, bytes]]:
        parts = self.special_split.split(text) if self.special_split is not None and any(s in text for s in self.special) else [text]
        memo, found = self.memo, []
        for part in parts:
            if part in self.special:
                found.append((1, f",{self.special[part]}", part.encode()))
            else:
                for piece in self.pieces(part):
                    found.append(memo.get(piece) or self._piece(piece))
        return found

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self._found(text) for i in ids[1:].split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        found = self._found(text)
        ids = "".join([f[1] for f in found])[1:]
        decoded = b"".join([f[2] for f in found]).decode("utf-8", "replace")
        return sum([f[0] for f in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


_ENCODERS: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def _appended(docs: DataFrame, path: str, fields: list[tuple[str, T.DataType]], of) -> DataFrame:
    """docs with the fields that `of(encoder, text)` gives, in one Arrow pass."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    plain = docs.drop(*[name for name, _ in fields])
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        coder = encoder(spec.value)
        for batch in batches:
            for piece, texts in pieces(batch):
                made = list(zip(*[of(coder, (t or b"").decode("utf-8", "replace")) for t in texts]))
                cols = piece.columns + [pa.array(values, to_arrow_type(kind)) for values, (_, kind) in zip(made, fields)]
                yield pa.RecordBatch.from_arrays(cols, names=piece.schema.names + [name for name, _ in fields])

    schema = T.StructType(plain.schema.fields + [T.StructField(name, kind) for name, kind in fields])
    return plain.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """docs with `token_ids`."""
    return _appended(docs, path, [("token_ids", T.ArrayType(T.IntegerType()))], lambda coder, text: (coder.encode(text),))


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """encoded, with `decoded_text` of its token_ids."""
    with open(path, encoding="utf-8") as f:
        spec = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf(T.StringType())
    def decoded(ids):
        coder = encoder(spec.value)
        return ids.map(lambda x: None if x is None else coder.decode(list(x)))

    return encoded.withColumn("decoded_text", decoded("token_ids"))


def digests(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """docs with n_tokens and the digests of its ids and of their decoding."""
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return _appended(docs, path, fields, lambda coder, text: coder.digest(text))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
