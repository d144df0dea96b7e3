"""Operator 4, n-gram Jaccard join, by a MinHash LSH forest and exact verification.

A document is the set of its five-word shingles (a shorter one: all its words as one). Documents with equal sets are
one class of copies, and go on as one. The forest has TREES trees; in each, a document is the string of its lowest
hashes, a byte a level, LEVELS bytes deep. Sorted, the strings lay out the tree's prefix trie: documents below one
node stand side by side. The sorted tries are made once, dealt by ranges, so that a node with very many documents
spans several tasks; what stands on both sides of a border is joined by the node's prefix.

Documents with a common prefix are candidates of each other. The prefixes start at full depth. What is found is
verified exactly, and each link of similarity J stands for 1 / p(J) links, where p(J) = 1 - (1 - J**depth)**TREES is
the probability that such a pair meets; so the recall at this depth, and what it would be at any other, is measured on
the links of the very corpus. The prefixes are shortened to the first depth where it reaches RECALL, and measured
anew, until it does or depth() is reached, where even two documents right at the threshold meet with that recall. A
corpus of close copies so keeps long prefixes and few candidates; without any link the search goes on to depth().

A trie node is never expanded into pairs: each member links to the node's first, and the connected components of
these links are what is verified. A component's members are dealt to blocks of bounded size; for every two blocks one
task counts the shingles that any two members share, exactly, by a matrix product over the shared shingles, and gives
a count of links for each member and a spanning forest of them, not the links. So a group of thousands of near copies
is spread over many tasks and emits rows in proportion to its members times its blocks.

Shingles are compared by 64-bit hashes, sets by 128-bit digests.

Defined results: documents without words are copies of each other; null texts are empty; a row with a null id has the
ids of its copies, and no links and null ids if no copy has an id; repeated rows of an id are rows of the result, each
by its own text; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, stored, table

N, THRESHOLD = 5, 0.8
TREES, LEVELS, RECALL = 48, 12, 0.9998
#: A block of a component: at most about so many members and shingles.
MEMBERS, SHINGLES = 512, 1 << 20
#: Broadcast at most so many rows of (id, key); more go through a shuffle.
BROADCAST_ROWS = 200_000
WORDS = 200_000


def depth(threshold: float = THRESHOLD, trees: int = TREES, levels: int = LEVELS, recall: float = RECALL) -> int:
    """The longest prefix with which two documents right at the threshold meet in some tree with the recall asked for."""
    for d in range(levels, 1, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    return 1


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes; words' hashes are remembered."""

    def __init__(self, n: int = N):
        self.n, self.known = n, {}
        rng = np.random.default_rng(1)
        self.factors = rng.integers(0, 1 << 63, n + 1, np.uint64) | np.uint64(1)

    def hashes(self, words: list[str]) -> np.ndarray:
        import xxhash

        if len(self.known) > WORDS:
            self.known = {}
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def shingles(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.uint64)
        w = self.hashes(words)
        n = min(self.n, len(w))
        x = np.full(len(w) - n + 1, n, np.uint64)
        for k in range(n):
            x = (x ^ w[k : len(w) - n + 1 + k]) * self.factors[k]
            x ^= x >> np.uint64(29)
        x *= self.factors[n]
        x ^= x >> np.uint64(32)
        return np.unique(x)


class Forest:
    """Shingle sets to a string of each tree."""

    def __init__(self, trees: int, levels: int):
        rng = np.random.default_rng(2)
        self.trees, self.levels = trees, levels
        self.xor = rng.integers(0, 1 << 32, trees * levels, np.uint32)[:, None]
        self.factor = (rng.integers(0, 1 << 32, trees * levels, np.uint32) | np.uint32(1))[:, None]

    def strings(self, x: np.ndarray) -> np.ndarray:
        """(trees, levels) bytes."""
        x = (x >> np.uint64(32)).astype(np.uint32)
        low = None
        for a in range(0, len(x), 2048):
            part = ((x[None, a : a + 2048] ^ self.xor) * self.factor).min(axis=1)
            low = part if low is None else np.minimum(low, part)
        return ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).reshape(self.trees, self.levels)


def digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, key (of the shingle set), size, strings (each tree's number and the document's string in it; null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, f = Shingler(n), Forest(TREES, LEVELS)
        number = np.arange(TREES, dtype=np.uint8)[:, None]
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                keys, sizes, strings = [], [], []
                for text in part.column("text"):
                    x = s.shingles(text.as_py())
                    keys.append(digest(x))
                    sizes.append(len(x))
                    strings.append([row.tobytes() for row in np.hstack([number, f.strings(x)])] if len(x) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(strings, pa.list_(pa.binary()))], names=["doc_id", "key", "size", "strings"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, key binary, size long, strings array<binary>")


def tries(signed: DataFrame) -> DataFrame:
    """(at, key, part): the sorted tries of all trees, a row for each key and tree; part: the sorted stretch that a row is in."""
    nodes = stored(signed.where("strings is not null").dropDuplicates(["key"]).select("key", F.explode("strings").alias("at")), "strings")
    dealt = nodes.repartitionByRange(partitions(signed.sparkSession), "at", "key").sortWithinPartitions("at", "key")
    made = stored(dealt.select("at", "key", F.spark_partition_id().alias("part")), "tries")
    discard(nodes)
    return made


MET = pa.schema([("key", pa.binary()), ("first", pa.binary()), ("node", pa.binary())])


def matrix(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    column = column.cast(pa.large_binary())
    data, n = np.frombuffer(column.buffers()[2], np.uint8), len(column)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    return data[ends[0] : ends[-1]].reshape(n, -1)


def met(trie: DataFrame, depth: int) -> DataFrame:
    """(key, first): each key with the first one below its node at the depth, from one scan of the sorted tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (part, prefix, first key) of the last row's node

        def rows(keys: list, firsts: list, nodes: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (keys, firsts, nodes)], schema=MET)

        for batch in batches:
            if not batch.num_rows:
                continue
            prefix, key, part = matrix(batch.column(0))[:, : depth + 1], matrix(batch.column(1)), batch.column(2).to_numpy()
            new = np.ones(len(part), bool)
            apart = part[1:] != part[:-1]
            new[1:] = apart | (prefix[1:] != prefix[:-1]).any(axis=1)
            new[0] = before is None or before[:2] != (part[0], prefix[0].tobytes())
            head = np.maximum.accumulate(np.where(new, np.arange(len(part)), -1))
            first_of = lambda k: key[head[k]].tobytes() if head[k] >= 0 else before[2]
            inner = np.flatnonzero(~new).tolist()
            out = ([key[k].tobytes() for k in inner], [first_of(k) for k in inner], [None] * len(inner))
            # The nodes at a stretch's ends may go on elsewhere.
            ends = [(prefix[k], first_of(k)) for j in np.flatnonzero(apart).tolist() for k in (j, j + 1)]
            if before is None:
                ends.append((prefix[0], first_of(0)))
            elif before[0] != part[0]:
                ends += [(np.frombuffer(before[1], np.uint8), before[2]), (prefix[0], first_of(0))]
            for node, first in ends:
                for column, value in zip(out, (first, None, node.tobytes())):
                    column.append(value)
            before = part[-1], prefix[-1].tobytes(), first_of(len(part) - 1)
            yield rows(*out)
        if before is not None:
            yield rows([before[2]], [None], [before[1]])

    found = stored(trie.mapInArrow(run, "key binary, first binary, node binary"), "met")
    ends = found.where("node is not null").select("node", "key").distinct()  # two for each sorted stretch at most
    over = ends.groupBy("node").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    return found.where("node is null").select("key", "first").unionByName(ends.join(over, "node").where("key <> first").select("key", "first"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label): the smallest node of each node's connected component; edges: (a, b). Labels and the pointers they make spread until nothing changes."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), f"{name}-labels")
    sum_of = lambda df: df.agg(F.sum(F.xxhash64("node", "label").cast("decimal(20,0)"))).first()[0]
    before, now = None, sum_of(labels)
    while before != now:
        ways = both.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        heard = ways.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label")
        old, labels = labels, stored(heard.unionByName(labels).groupBy("node").agg(F.min("label").alias("label")), f"{name}-labels")
        discard(old)
        before, now = now, sum_of(labels)
    discard(both)
    return labels


def shared(arrays: list[np.ndarray]) -> np.ndarray:
    """How many shingles any two of the sets have in common."""
    m = len(arrays)
    if m == 2:
        n = len(np.intersect1d(arrays[0], arrays[1], assume_unique=True))
        return np.array([[len(arrays[0]), n], [n, len(arrays[1])]])
    every, owner = np.concatenate(arrays), np.repeat(np.arange(m), [len(a) for a in arrays])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    column = np.cumsum(np.append(0, every[1:] != every[:-1])) if len(every) else np.zeros(0, int)
    often = np.bincount(column, minlength=1) > 1
    keep = often[column]
    column, owner = (np.cumsum(often) - 1)[column[keep]], owner[keep]
    out = np.zeros((m, m), np.float64)
    wide = int(often.sum())
    step = 4096
    for a in range(0, wide, step):
        lo, hi = np.searchsorted(column, [a, a + step])
        x = np.zeros((m, min(step, wide - a)), np.float32)
        x[owner[lo:hi], column[lo:hi] - a] = 1
        out += x @ x.T
    return out.astype(np.int64)


def meets(j: np.ndarray, depth: int) -> np.ndarray:
    """The probability that documents of similarity j have a common prefix of this depth in some tree."""
    return 1 - (1 - j**depth) ** TREES


def linked(arrays: list[np.ndarray], blocks: np.ndarray, threshold: float, depths: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links, root, expected) of each member: links between members of different blocks where there are two; the first member of each connected part; and for each of the depths how many links would be found there, if those here were found at the last."""
    n = np.array([len(a) for a in arrays])
    common = shared(arrays)
    near = common * (1 + threshold) >= threshold * (n[:, None] + n[None]) - 1e-9
    np.fill_diagonal(near, False)
    if len(set(blocks.tolist())) > 1:
        near &= blocks[:, None] != blocks[None]
    a, b = np.nonzero(near)
    alike = common[a, b] / (n[a] + n[b] - common[a, b])
    weight = 1 / meets(alike, depths[-1])
    expected = np.stack([np.bincount(a, weight * meets(alike, d), len(arrays)) for d in depths], axis=1)
    root = np.full(len(arrays), -1)
    for k in range(len(arrays)):
        if root[k] < 0:
            part = np.zeros(len(arrays), bool)
            part[k] = True
            while True:
                wider = part | near[part].any(axis=0)
                if (wider == part).all():
                    break
                part = wider
            root[part] = k
    return near.sum(axis=1), root, np.hstack([expected, np.bincount(a, weight, len(arrays))[:, None]])


SETS = pa.schema([("label", pa.binary()), ("key", pa.binary()), ("blocks", pa.int32()), ("shingles", pa.binary())])
PAIRED = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("root", pa.binary()), ("expected", pa.list_(pa.float64()))])


def verified(docs: DataFrame, reps: DataFrame, labels: DataFrame, n: int, threshold: float, depths: range) -> DataFrame:
    """(key, links, root, expected) from every two blocks of each component, see linked(); expected ends with the links that these stand for. reps: (doc_id, key, size), a document for each key."""
    members = labels.join(reps.withColumnRenamed("key", "node"), "node").select(F.col("node").alias("key"), "label", "doc_id", "size")
    members = stored(members, "members")
    blocks = members.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("size") / SHINGLES)).cast("int").alias("blocks"))
    wanted = members.join(stored(blocks, "blocks"), "label")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = stored(wanted, "wanted")
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = texts.join(F.broadcast(wanted) if few else wanted, "doc_id")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(n)
        for batch in batches:
            rows = []
            for text, key, label, blocks in zip(*(batch.column(c).to_pylist() for c in ("text", "key", "label", "blocks"))):
                x = s.shingles(text)
                if digest(x) == key:  # an id may stand for several texts
                    rows.append((label, key, blocks, x.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SETS)], schema=SETS)

    sets = found.select("text", "key", "label", "blocks").mapInArrow(shingle, "label binary, key binary, blocks int, shingles binary")
    sets = sets.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "shingles")
    pairs = sets.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, out = None, {}, []

        def close() -> None:
            if len(held) > 1:
                keys = list(held)
                links, root, expected = linked([held[k][1] for k in keys], np.array([held[k][0] for k in keys]), threshold, depths)
                out.extend((k, int(c), keys[r], e) for k, c, r, e in zip(keys, links, root, expected.tolist()) if c)

        for batch in batches:
            for label, i, j, own, key, raw in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if (label, i, j) != group:
                    close()
                    group, held = (label, i, j), {}
                held[key] = own, np.frombuffer(raw, np.uint64)
                if len(out) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PAIRED)], schema=PAIRED)
                    out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PAIRED)], schema=PAIRED)

    return pairs.mapInArrow(verify, "key binary, links long, root binary, expected array<double>")


def searched(docs: DataFrame, reps: DataFrame, trie: DataFrame, n: int, threshold: float) -> DataFrame:
    """verified() at the longest prefix whose measured recall is RECALL, at depth() at the latest."""
    least = min(depth(threshold, levels=LEVELS), LEVELS)
    now = LEVELS
    while True:
        # At most TREES firsts for a key, and those at borders: it links to the smallest, and so do the others, of which there are few.
        firsts = stored(met(trie, now).groupBy("key").agg(F.collect_set("first").alias("all")).select("key", F.array_min("all").alias("least"), "all"), "firsts")
        edges = firsts.select(F.col("key").alias("a"), F.col("least").alias("b")).unionByName(firsts.select(F.explode("all").alias("a"), F.col("least").alias("b")).distinct()).where("a <> b")
        depths = range(least, now + 1)
        found = stored(verified(docs, reps, components(edges, "met"), n, threshold, depths), "verified")
        discard(firsts)
        if now == least:
            return found
        sums = found.agg(F.sum("links").alias("links"), *[F.sum(F.get("expected", F.lit(k))).alias(f"e{k}") for k in range(len(depths) + 1)]).first()
        links, (*expected, all_links) = sums["links"], sums[1:]
        if links and links >= RECALL * all_links:
            return found
        shorter = [d for d, e in zip(depths, expected) if d < now and links and e >= RECALL * all_links]
        now = max(shorter, default=least)


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the smallest id that copies and links lead to), copy_id (the smallest id of its copies), n_links (other classes of copies at least as similar as the threshold)."""
    signed = stored(signatures(docs, n), "signed")
    reps = signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.count("*").alias("copies"))
    reps = stored(reps, "reps")
    trie = tries(signed)
    found = searched(docs, reps.select("doc_id", "key", "size"), trie, n, threshold)
    discard(trie)
    labels = components(found.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")), "near")
    links = found.groupBy("key").agg(F.sum("links").alias("n_links"))
    info = stored(links.join(labels.withColumnRenamed("node", "key"), "key", "left"), "info")
    keyed = stored(reps.select("key", F.col("doc_id").alias("copy_id")).join(info, "key", "left").withColumn("class", F.coalesce("label", "key")), "keyed")
    # Only what more than one document is in needs a look-up.
    classes = stored(keyed.where("label is not null").groupBy(F.col("class").alias("label")).agg(F.min("copy_id").alias("class_id")), "classes")
    keyed = keyed.drop("class").join(classes, "label", "left").select("key", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    keyed = stored(keyed, "keyed")
    return signed.select("doc_id", "key").join(keyed, "key").select("doc_id", "class_id", "copy_id", "n_links")


def op4_ngram_jaccard(spark, sf_dir):
    return join(table(spark, sf_dir, "documents"))


def stage(spark, docs, sf_dir):
    """Pipeline: of each class the document with the smallest id stays; of rows that repeat its id, one; rows without an id stay unless their text has another row with one."""
    first = join(docs).select("doc_id", "class_id").distinct()
    stay = first.where("doc_id = class_id").select("doc_id")
    one = docs.where("doc_id is not null").join(stay, "doc_id", "left_semi")
    one = one.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("d")).select("doc_id", "d.*")
    return one.unionByName(docs.where("doc_id is null").dropDuplicates(["text"]).join(docs.where("doc_id is not null").select("text"), "text", "left_anti").select("doc_id", "text", "lang", "source", "n_chars"))
