"""Token ids of whole texts, through a bounded memory of the words between spaces.

A text is cut before its spaces (a vocabulary that drops white space: at all of ASCII's). Where no other white space
stands beside a space, no merge and no rule of the vocabularies reaches over such a cut, so the ids of the words, put
together, are those of the text. Cutting, looking up and putting together are array operations on a batch; Python
sees only words that the memory does not hold.

A new word of letters, digits and common symbols is cut on, where its kind of character changes, for there a piece of
the vocabulary's own rule ends; these parts are encoded many at a time by an engine's together(). Any other new word
(apostrophes, other scripts, rare white space) goes through the engine's whole(), and so does a text that may not be
cut. The memory is bounded in bytes; words of over LONG bytes are not remembered.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of words, their ids and places that are remembered; beyond, all but the last texts' words are forgotten.
REMEMBER = 240 << 20
#: What an entry takes besides its word and ids, in the table and in the look-up of parts.
ENTRY = 120
#: Bytes of text that are encoded at a time, parts that go through the library at a time, bytes of a remembered word.
CHUNK, TOGETHER, LONG = 6 << 20, 20_000, 120

LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
SYMBOLS = r"!-&(-/:-@\[-`{-~"
#: A word that may be cut where the kind of character changes: lines have no empty one among them.
PLAIN = f"^[{LETTERS}0-9{SYMBOLS}]+(?:\\n[{LETTERS}0-9{SYMBOLS}]+)*$"
SPACED_PART = re.compile(f"[{LETTERS}]+|[0-9]+|[{SYMBOLS}]+|\\n").findall
BARE_PART = re.compile(f"[{LETTERS}]+|[0-9]|[{SYMBOLS}]+").findall


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each of the stretches, one stretch after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - ends + lengths, lengths) + np.arange(total)


class Library:
    """The tokenizers library on one vocabulary file.

    together() leaves out the library's rules of white space, case and cutting, which its parts have behind them.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.inner, self.spaced = Tokenizer.from_file(path), Tokenizer.from_file(path), spaced
        self.tokenizer.encode_special_tokens = True
        self.inner.encode_special_tokens = True
        self.inner.normalizer = normalizers.Sequence([])
        self.inner.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = np.arange(256, dtype="<u4")
        self.letters[[b for b in range(256) if b not in shown]] = 256 + np.arange(256 - len(shown))
        self.mark, self.letters[0] = "\0", self.letters[32]  # a part's own space; parts hold no zero byte
        self.letters[32] = 32
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for t, i in vocabulary.items():
            self.sizes[i] = len(t.removesuffix("</w>")) if not spaced else len(t)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each part); a part that begins with the mark has a space before it."""
        ids, numbers = [], []
        for a in range(0, len(parts), TOGETHER):
            raw = " ".join(parts[a : a + TOGETHER]).encode()
            text = self.letters[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-32-le")
            got = np.asarray(self.inner.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            gaps = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 32), len(raw))
            part_ends = gaps - np.arange(len(gaps))
            ends = np.searchsorted(np.cumsum(self.sizes[got]), part_ends) + 1
            ids.append(got)
            numbers.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(numbers)


class Memory:
    """encode(texts) -> (ids of all, offsets of each text) by an engine with whole(), together(), spaced and mark.

    spaced: a word's ids depend on the space before it (byte-level vocabularies); else white space leaves no ids and
    letters have no case.
    """

    def __init__(self, engine, remember: int = REMEMBER):
        self.engine, self.spaced, self.remember = engine, engine.spaced, remember
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.starts, self.lengths = np.zeros(1, np.int64), np.zeros(1, np.int64)  # entry 0 has no ids
        self.entry = np.zeros(0, np.int64)  # of each known word; -1: a text with the word may not be cut
        self.store, self.used = np.zeros(1 << 16, "<u4"), 0
        self.parts: dict[str, int] = {}
        self.held = 0

    def put(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Appends stretches of ids to the store; their entries."""
        if self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store[: self.used], np.zeros(max(len(self.store), len(ids)), "<u4")])
        self.store[self.used : self.used + len(ids)] = ids
        first = len(self.starts)
        self.starts = np.append(self.starts, self.used + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.used += len(ids)
        return np.arange(first, len(self.starts))

    def ids_of(self, entries: np.ndarray) -> np.ndarray:
        return self.store[spread(self.starts[entries], self.lengths[entries])]

    def learn(self, words: list[str], plain: np.ndarray) -> np.ndarray:
        """Entries of new words; plain: which of them may be cut into parts."""
        out = np.empty(len(words), np.int64)
        at, cut = np.flatnonzero(plain), []
        if self.spaced:
            mark = self.engine.mark
            cut = [SPACED_PART(words[k]) for k in at]
            for c in cut:
                c[0] = mark + c[0]
        else:
            cut = [BARE_PART(words[k].lower()) for k in at]
        new = [p for p in dict.fromkeys(p for c in cut for p in c) if p not in self.parts]
        if new:
            self.parts.update(zip(new, self.put(*self.engine.together(new)).tolist()))
            self.held += sum(map(len, new)) + ENTRY * len(new)
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        entries = np.fromiter((self.parts[p] for c in cut for p in c), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        single = sizes == 1
        out[at[single]] = entries[ends[single] - 1]
        many = ~single
        if many.any():
            inner = entries[np.repeat(many, sizes)]
            counts = np.append(0, np.cumsum(self.lengths[inner]))
            borders = np.append(0, np.cumsum(sizes[many]))
            out[at[many]] = self.put(self.ids_of(inner), np.diff(counts[borders]))
        odd = np.flatnonzero(~plain)
        if self.spaced:
            safe = np.fromiter((bool(w) and not w[0].isspace() and not w[-1].isspace() for w in map(words.__getitem__, odd)), bool, len(odd))
            out[odd[~safe]] = -1
            odd = odd[safe]
        if len(odd):
            got = self.engine.whole([" " * self.spaced + words[k] for k in odd])
            out[odd] = self.put(np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got)))
        return out

    def look_up(self, words: pa.Array) -> np.ndarray:
        """The entry of each of the distinct words."""
        found = pc.index_in(words, value_set=self.known) if len(self.known) else pa.nulls(len(words), pa.int32())
        new = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        out = np.empty(len(words), np.int64)
        old = np.delete(np.arange(len(words)), new)
        out[old] = self.entry[pc.drop_null(found).to_numpy(zero_copy_only=False)]
        if len(new):
            fresh = words.take(pa.array(new))
            plain = pc.match_substring_regex(fresh, PLAIN).to_numpy(zero_copy_only=False)
            out[new] = got = self.learn(fresh.to_pylist(), plain)
            short = pc.binary_length(fresh).to_numpy(zero_copy_only=False) <= LONG
            kept = fresh.filter(pa.array(short))
            self.known = pa.concat_arrays([self.known, kept])
            self.entry = np.append(self.entry, got[short])
            self.held += int(pc.sum(pc.binary_length(kept)).as_py() or 0)
        return out

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """texts without nulls; end: an id after each text's own."""
        if self.held + 4 * self.used + 16 * len(self.starts) > self.remember:
            self.forget()
        texts = texts.cast(pa.large_string())
        n = len(texts)
        lists = pc.split_pattern(texts, " ") if self.spaced else pc.ascii_split_whitespace(texts)
        borders = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten()
        borders -= borders[0]
        coded = flat.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        words = coded.dictionary
        firsts, late = borders[:-1], None
        if self.spaced:
            late = np.ones(len(flat), bool)
            late[firsts] = False
            # Words that only begin texts have no entry with a space.
            inside = np.zeros(len(words), bool)
            inside[index[late]] = True
            entries = np.zeros(len(words), np.int64)
            entries[inside] = self.look_up(words.filter(pa.array(inside)))
        else:
            entries = self.look_up(words)
        each = entries[index]
        used, known = self.used, len(self.starts)
        if self.spaced:
            heads = flat.take(pa.array(firsts)).to_pylist()
            unsafe = np.fromiter((w != "" and w[-1].isspace() or w == "" for w in heads), bool, n)
            unsafe &= np.diff(borders) > 1
            unsafe[np.repeat(np.arange(n), np.diff(borders))[late][each[late] < 0]] = True
            lost = np.flatnonzero(unsafe)
            for k, t in zip(lost.tolist(), texts.take(pa.array(lost)).to_pylist()):
                heads[k] = t
            each[np.repeat(unsafe, np.diff(borders))] = 0
            got = self.engine.whole(heads)
            each[firsts] = self.put(np.concatenate(got) if n else np.zeros(0, "<u4"), np.fromiter(map(len, got), np.int64, n))
        if end is not None:
            last = self.put(np.array([end], "<u4"), np.array([1]))[0]
            each = np.insert(each, borders[1:], last)
            borders = borders + np.arange(n + 1)
        ids = self.ids_of(each)
        counts = np.append(0, np.cumsum(self.lengths[each]))
        self.used, self.starts, self.lengths = used, self.starts[:known], self.lengths[:known]  # heads are not kept
        return ids, counts[borders]


class Pieces:
    """encode(texts) -> the ids of each as little-endian unsigned 32-bit integers, by the tokenizers library."""

    def __init__(self, path: str, spaced: bool, remember: int = REMEMBER):
        self.memory = Memory(Library(path, spaced), remember)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, offsets = self.memory.encode(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]


@functools.cache
def memory_of(path: str, spaced: bool, remember: int) -> Memory:
    """One memory for all tasks of a worker process."""
    return Memory(Library(path, spaced), remember)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batch with their texts, or binary values (null: empty): about CHUNK bytes each, or one text."""
    texts = batch.column(column)
    if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type):
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    else:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        to = max(start + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
        yield batch.slice(start, to - start), texts.slice(start, to - start)
        start = to


def encoded(batches: Iterator[pa.RecordBatch], column: str, path: str, spaced: bool, end: int | None = None, remember: int = REMEMBER) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches, each with the ids of its texts (little-endian unsigned 32-bit) and their offsets."""
    memory = memory_of(path, spaced, remember)
    for batch in batches:
        for part, texts in slices(batch, column):
            yield part, *memory.encode(texts, end)
