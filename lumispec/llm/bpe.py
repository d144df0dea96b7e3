"""Operator 7, byte-level BPE encoding and decoding, by a lazily determinised transducer and a UTF-8 state machine.

A sequence of tokens is the encoding of its bytes if and only if each token and each pair of neighbours is (a
property of merges that depend on ranks alone). So the merges compile into an automaton over bytes: a hypothesis is
the tokens since the last output and the begun token; a token that is complete and compatible with the one before it
ends there. A state is the set of hypotheses that are alive together; it is built when the first text needs it, and
what all of its hypotheses agree on is its output, so tokens come out after the lookahead that the longest token
bounds, and states do not grow with the text. The end of a piece puts out the hypothesis that ends there.

Decoding is streamed over ids: the machine's state is the unfinished UTF-8 sequence, at most three bytes; each feed
of ids gives the whole characters and leaves the next state.

Defined results: a null or empty text has no tokens and decodes to no bytes; null ids, repeated rows and extra
columns pass through; an empty table gives an empty table; ids that are not UTF-8 decode to the same bytes.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table
from .tokens import Memory, slices, spread

#: States, and pairs of tokens, that are kept before they are built anew; ids that are decoded at a time.
STATES, PAIRS, FEED = 200_000, 500_000, 1 << 16
#: The pattern whose cuts the memory of words knows; with any other one, each text goes through the pattern.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}  # node << 8 | byte -> node of the tokens' trie
        self.inner, self.token = [True], [-1]  # by node: whether tokens go on from it, and the token that ends at it
        for t, i in ranks.items():
            node = 0
            for byte in t:
                key = node << 8 | byte
                self.inner[node] = True
                node = self.child.get(key)
                if node is None:
                    node = self.child[key] = len(self.token)
                    self.inner.append(False)
                    self.token.append(-1)
            self.token[node] = i
        self.pairs: dict[int, bool] = {}
        self.made_of: dict[int, tuple | None] = {}
        self.proper: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.next: dict[int, tuple[int, tuple[int, ...]]] = {}  # state << 8 | byte
        self.last: list[tuple[int, ...]] = []
        self.start = self.state((None, (((), 0),)))

    def merged(self, raw: bytes) -> list[int]:
        """The merges themselves, lowest rank first; for pairs of tokens only."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, i: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token i; None for a single byte."""
        if i not in self.made_of:
            raw = self.tokens[i]
            found = None
            if len(raw) > 1:
                parts = [raw[k : k + 1] for k in range(len(raw))]
                while len(parts) > 2:
                    rank, at = min((self.ranks.get(x + y, 1 << 60), k) for k, (x, y) in enumerate(zip(parts, parts[1:])))
                    if rank >= i:
                        break
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                found = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else ()
            self.made_of[i] = found
        return self.made_of[i]

    def is_proper(self, i: int) -> bool:
        """Whether the merges of the token's bytes give the token."""
        found = self.proper.get(i)
        if found is None:
            found = self.proper[i] = self.halves(i) != ()
        return found

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs = {}
            found = self.pairs[key] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        """Whether no merge reaches over the border of a and b: undo the later merge of the two sides, step by step, and see whether what then meets would have merged before it."""
        limit, get, tokens = 1 << 60, self.ranks.get, self.tokens
        while True:
            over = get(tokens[a] + tokens[b])
            if over is not None and over < limit:
                return False
            left, right = self.halves(a), self.halves(b)
            if left is None and right is None:
                return True
            # The border's tokens came about in the order of their ranks; where ranks are equal the left one did.
            if right is None or left is not None and a > b:
                limit, a = a, left[1]
            else:
                limit, b = b + 1, right[0]

    def state(self, key: tuple) -> int:
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.last.append(next((t for t, node in key[1] if not node), ()))
        return number

    def step(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The transition (next state, output) of a state; computed once."""
        before, alive = self.states[number]
        found, ended, child, inner, token = [], None, self.child, self.inner, self.token
        for tokens, node in alive:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if inner[node]:
                found.append((tokens, node))
            i = token[node]
            if i >= 0 and ended is None and self.is_proper(i):  # a prefix has one encoding, so one hypothesis ends here
                left = tokens[-1] if tokens else before
                if left is None or self.compatible(left, i):
                    ended = (*tokens, i)
        found.append((ended, 0))
        # What all hypotheses agree on goes out.
        out = found[0][0]
        for t, _ in found[1:]:
            n = 0
            for a, b in zip(out, t):
                if a != b:
                    break
                n += 1
            out = out[:n]
        n = len(out)
        rest = tuple((t[n:], p) for t, p in found)
        # The token before matters only to a hypothesis that begins right after it.
        left = (out[-1] if out else before) if any(not t for t, _ in rest) else None
        self.next[number << 8 | byte] = made = (self.state((left, rest)), out)
        return made

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > STATES:
            self.forget()
        at, out, moves = self.start, [], self.next
        for byte in piece:
            move = moves.get(at << 8 | byte) or self.step(at, byte)
            at = move[0]
            if move[1]:
                out += move[1]
        out += self.last[at]
        return out


class Decoder:
    """A state machine over ids: its state is the unfinished UTF-8 sequence; feed() gives the bytes of whole characters.

    The bytes of the tokens between two feeds' ends are put together by array operations; only the last of them decide
    the next state. Bytes that no character can hold are finished at once, as they are.
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.bytes = np.frombuffer(b"".join(tokens.values()), np.uint8)
        self.sizes, self.starts = np.zeros(max(tokens) + 1, np.int64), np.zeros(max(tokens) + 1, np.int64)
        sizes = np.fromiter(map(len, tokens.values()), np.int64, len(tokens))
        self.sizes[list(tokens)], self.starts[list(tokens)] = sizes, np.cumsum(sizes) - sizes
        self.pending = b""

    @staticmethod
    def unfinished(raw: bytes) -> int:
        """How many bytes at the end of raw begin a character that is not complete."""
        for k in range(1, min(3, len(raw)) + 1):
            b = raw[-k]
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                return k if 0xC2 <= b < 0xF5 and k < need else 0
            if b < 0x80:
                return 0
        return 0

    def feed(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        raw = self.pending + self.bytes[spread(self.starts[ids], self.sizes[ids])].tobytes()
        done = len(raw) - self.unfinished(raw[-3:])
        self.pending = raw[done:]
        return raw[:done]

    def finish(self) -> bytes:
        """What is left when the ids end; the machine is then as new."""
        rest, self.pending = self.pending, b""
        return rest


class Merges:
    """The transducer as the engine of a memory of words."""

    spaced, mark = True, " "

    def __init__(self, transducer: Transducer, pattern: str):
        import regex

        self.encode, self.pieces = transducer.encode, regex.compile(pattern).findall

    def together(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        gc.disable()  # states are tuples without cycles, and many; to search them for cycles takes as long as to make them
        try:
            got = [self.encode(p.encode()) for p in parts]
        finally:
            gc.enable()
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), "<u4", int(n.sum())), n

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """By the pattern; what a batch repeats is encoded once."""
        cut = [self.pieces(t) for t in texts]
        ids = {p: self.encode(p.encode()) for p in set().union(*cut)}
        return [np.fromiter(chain.from_iterable(map(ids.__getitem__, c)), "<u4") for c in cut]


class Codec:
    """Whole texts to ids and back; words are remembered where the pattern is the one whose cuts the memory knows."""

    def __init__(self, path: str, pattern: str):
        ranks = load(path)
        self.transducer, self.decoder = Transducer(ranks), Decoder({i: t for t, i in ranks.items()})
        self.engine = Merges(self.transducer, pattern)
        self.memory = Memory(self.engine) if pattern == WORDS else None
        # The decimal numbers of ids, with a space after each, as rows of bytes that are zero after the space.
        n = max(ranks.values()) + 1
        self.decimals = np.array([f"{i} " for i in range(n)], f"S{len(str(n)) + 1}").view(np.uint8).reshape(n, -1)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their offsets)."""
        if self.memory is not None:
            return self.memory.encode(texts)
        got = self.engine.whole(texts.to_pylist())
        return np.concatenate([np.zeros(0, "<u4"), *got]), np.append(0, np.cumsum([len(x) for x in got], dtype=np.int64))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, offsets = self.encode_all(pa.array(texts, pa.large_string()))
        return [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]

    def decimal(self, ids: np.ndarray) -> bytes:
        """The decimal ids, joined by one space."""
        rows = self.decimals[ids]
        return rows[rows > 0].tobytes()[:-1]

    def decode(self, ids) -> bytes:
        done = [self.decoder.feed(ids[a : a + FEED]) for a in range(0, len(ids), FEED)]
        return b"".join([*done, self.decoder.finish()])


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    """One for all tasks of a worker process."""
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256 (of the decimal ids, joined by spaces), decoded_sha256 (of the bytes decoded from the ids), and ids if asked for; columns of df with these names are replaced."""
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    kept = [c for c in df.columns if c not in added]
    df = df.select(*[f"`{c}`" for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for part, texts in slices(batch, text_col):
                ids, offsets = c.encode_all(texts)
                each = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
                first = [hashlib.sha256(c.decimal(ids[a:b])).hexdigest() for a, b in each]
                second = [hashlib.sha256(c.decode(ids[a:b])).hexdigest() for a, b in each]
                columns = [pa.array(np.diff(offsets)), pa.array(first, pa.string()), pa.array(second, pa.string())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=kept + added)

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>"] * keep_ids
    return df.mapInArrow(run, ", ".join(types))


def op7_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")
