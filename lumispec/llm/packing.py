"""Operator 2, best-fit packing, by bin completion branch-and-bound.

Only the number of pieces of each length decides a packing, and there are at most CAPACITY lengths. So the driver
gets a histogram, never the pieces, and its search has the same size for any corpus. The search fills the sequence of
the largest remaining piece: it enumerates fillings of what room is left, leaves out dominated ones (where a larger
unused piece could take the place of one in the filling), tries the best fit first and takes it as often as the
histogram allows; a branch is cut where its waste so far is more than the incumbent's would allow. It ends when the
incumbent meets the bound ceil(total / CAPACITY), or with the descent that brings it to NODES fillings and DESCENTS
descents. A descent is never cut short by the count: it can need more fillings than there are lengths. The first
incumbent is the better of best fit and first fit, decreasing.

The pieces learn their places by their rank among those of their length. Ranks are counted in two steps, within the
task that cut a piece and over tasks, so that a length with a third of all pieces is no single task's work.

Defined results: a null or empty text has its end id alone; null ids, repeated rows and ties are documents like any
other; other columns are left out; an empty table has no pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table
from .tokens import REMEMBER, encoded, spread

CAPACITY = 2048
#: Fillings that are looked at for one sequence, at most; fillings and descents after which the search starts no further descent, once both are reached.
FILLINGS, NODES, DESCENTS = 400, 50_000, 16


def bits(lengths) -> int:
    """A set of lengths as the bits of a number."""
    return sum(1 << l for l in set(lengths))


def fillings(room: int, counts: dict[int, int], present: int, most_waste: int) -> list[tuple[int, tuple[int, ...]]]:
    """(waste, lengths) of undominated fillings of the room, best fit first, none with more waste than most_waste where one has less. present: the lengths in counts, as bits."""
    found: list[tuple[int, tuple[int, ...]]] = []
    looked = 0
    fit = present & ((2 << room) - 1)
    smallest = (fit & -fit).bit_length() - 1 if fit else room + 1
    used: Counter = Counter()
    free = present  # lengths of which a piece is unused

    def undominated(left: int) -> bool:
        """No piece of the filling can be exchanged for a larger unused one within the room left."""
        return not left or not any(free >> (u + 1) & ((1 << left) - 1) for u in used)

    def go(top: int, left: int, chosen: tuple[int, ...]) -> bool:
        """Adds pieces of at most top."""
        nonlocal looked, free
        looked += 1
        if left < smallest:
            if undominated(left):
                found.append((left, chosen))
            return left == 0 or looked > FILLINGS
        l = (free & ((2 << min(top, left)) - 1)).bit_length() - 1
        if l < 1 and undominated(left):
            found.append((left, chosen))
        while l > 0:
            used[l] += 1
            if used[l] == counts[l]:
                free ^= 1 << l
            done = go(l, left - l, (*chosen, l))
            if used[l] == counts[l]:
                free ^= 1 << l
            used[l] -= 1
            if not used[l]:
                del used[l]
            if done:
                return True
            l = (free & ((1 << l) - 1)).bit_length() - 1
        return looked > FILLINGS

    go(room, room, ())
    found.sort(key=lambda f: (f[0], len(f[1])))
    return [f for f in found if f[0] <= most_waste] or found[:1]


def first_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """First fit decreasing, by filling one sequence after the other with the largest pieces that fit, as counts allow."""
    left, plan = dict(counts), []
    while left:
        order = sorted(left, reverse=True)
        room, chosen = capacity, []
        for l in order:
            k = min(left[l], room // l)
            chosen += [l] * k
            room -= k * l
        plan.append(taken(left, chosen))
    return plan


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit decreasing: each piece, largest first, goes where it leaves least room. Sequences of equal content are one step, so a length adds two steps at most."""
    rooms: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # (times, lengths) by the room left
    present = 0

    def put(room: int, times: int, chosen: tuple[int, ...]) -> None:
        nonlocal present
        if times:
            rooms.setdefault(room, []).append((times, chosen))
            present |= 1 << room

    for l in sorted(counts, reverse=True):
        n = counts[l]
        while n:
            fit = present >> l
            if fit:
                room = l + (fit & -fit).bit_length() - 1
                times, chosen = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    present ^= 1 << room
            else:
                room, times, chosen = capacity, -(-n // (capacity // l)), ()
            # The room a piece leaves is tighter than any other that fits, so a sequence takes pieces while they fit.
            k = room // l
            full = min(times, n // k)
            put(room - k * l, full, (*chosen, *[l] * k))
            n -= full * k
            rest = times - full
            if rest and n:
                put(room - n * l, 1, (*chosen, *[l] * n))
                n, rest = 0, rest - 1
            if chosen:
                put(room, rest, chosen)
    return [step for steps in rooms.values() for step in steps]


def taken(left: dict[int, int], chosen: list[int] | tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """Takes the filling out of left as often as it goes: (times, lengths)."""
    need = Counter(chosen)
    times = min(left[l] // k for l, k in need.items())
    for l, k in need.items():
        left[l] -= times * k
        if not left[l]:
            del left[l]
    return times, tuple(chosen)


def plan(counts: dict[int, int], capacity: int = CAPACITY, seen: dict | None = None) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) of fillings that together take all pieces; counts: pieces by length. seen: gets figures of the search."""
    counts = {l: n for l, n in counts.items() if n}
    total = sum(l * n for l, n in counts.items())
    bound = -(-total // capacity)
    best = min(best_fit(counts, capacity), first_fit(counts, capacity), key=lambda p: sum(t for t, _ in p))
    size = sum(t for t, _ in best)
    nodes = descents = whole = 0
    # Depth first with few deviations from the best fit: at a node, the branch to try and the state before it.
    stack = [(dict(counts), [], 0, 0, 0)]
    while stack and size > bound and (nodes < NODES or descents < DESCENTS):
        left, done, waste, bins, skipped = stack.pop()
        done, present = list(done), bits(left)
        descents += 1
        # A descent ends with the pieces or by its waste, never by the count of nodes.
        while left:
            spare = (size - 1) * capacity - total - waste
            if spare < 0:
                break
            nodes += 1
            first = present.bit_length() - 1
            left[first] -= 1
            options = fillings(capacity - first, left, present if left[first] else present ^ 1 << first, spare)
            left[first] += 1
            if skipped < 2 and len(options) > 1 and len(stack) < 64 and options[1][0] <= spare:
                other, chosen = dict(left), (first, *options[1][1])
                t = taken(other, chosen)
                stack.append((other, [*done, t], waste + options[1][0] * t[0], bins + t[0], skipped + 1))
            t = taken(left, (first, *options[0][1]))
            present ^= bits(l for l in t[1] if l not in left)
            done.append(t)
            waste, bins = waste + options[0][0] * t[0], bins + t[0]
        whole += not left
        if not left and bins < size:
            best, size = done, bins
    if seen is not None:
        seen.update(bound=bound, size=size, nodes=nodes, descents=descents, whole=whole)
    return best


PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, end_id: int, spaced: bool = True, capacity: int = CAPACITY, remember: int = REMEMBER) -> DataFrame:
    """The pieces of docs (doc_id, text), each with the task that cut it and its rank among that task's pieces of its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch, ids, offsets in encoded(batches, "text", tokenizer, spaced, end_id, remember):
            n = np.diff(offsets)
            first = (n - 1) % capacity + 1  # the first piece takes what is over
            number = 1 + (n - first) // capacity
            row = np.repeat(np.arange(len(n)), number)
            piece = spread(np.zeros(len(n), np.int64), number)
            start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[row])
            raw, at = memoryview(ids).cast("B"), 4 * (offsets[row] + start)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
            # The rank among this task's pieces of its length.
            order = np.argsort(length, kind="stable")
            of_length = np.bincount(length, minlength=capacity + 1)
            nth = np.empty(len(length), np.int64)
            nth[order] = spread(seen, of_length)
            seen += of_length
            columns = [batch.column("doc_id").take(pa.array(row)), piece.astype("i4"), start, length, crc, np.full(len(row), task, "i4"), nth]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, PIECE)], schema=PIECE)

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces, and drops task and nth."""
    cut = stored(cut, "pieces")
    by_task = stored(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length up to the capacity
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_task.withColumn("before", F.coalesce(before, F.lit(0))).select("task", "length", "before")
    ranked = cut.join(offsets, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    # For each length: from which rank on which step of the plan takes its pieces; as many entries as the plan has, however large the corpus.
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    first, used = 0, Counter()
    for times, chosen in plan(counts, capacity):
        at = 0
        for l, k in sorted(Counter(chosen).items(), reverse=True):
            places.setdefault(l, []).append((used[l], first, k, at))
            used[l] += times * k
            at += l * k
        first += times
    tables = {l: np.array(x, np.int64).T for l, x in places.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty_like(length), np.empty_like(length)
            for l in np.unique(length):
                here = np.flatnonzero(length == l)
                since, first, k, at = tables[int(l)]
                step = np.searchsorted(since, rank[here], "right") - 1
                nth = rank[here] - since[step]
                sequence[here], offset[here] = first[step] + nth // k[step], at[step] + nth % k[step] * l
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0))


def stage(spark, docs, sf_dir):
    """Pipeline: the sequences of all documents. Its workers also serve the other stages, so they remember fewer pieces."""
    import public_tokenizers

    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, remember=60 << 20))
