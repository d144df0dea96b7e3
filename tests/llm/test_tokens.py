"""Operators 2, 7 and 10 against the tokenizers themselves, and packings against what they must keep."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from lumispec.llm import bpe, packing, shards, tokens

SF = "/root/testdata/sf0.01"
ODD = ["", " ", "  ", "a", "a ", " a", "a  b", " \n a", "a\n b", "a\tb c", "x\n", " b ", "é é ́x", "<|endoftext|> hi <|endoftext|>", "I'm it's 's don't 12 3", "a\xa0 b", "a b\n\nc  ", "\n", "İ K Σ ΑΣ ς", "a  b", "a b", "q .", "\U0001f600\U0001f468‍\U0001f469 日本語", "\x00\x7f", "x" * 5000, "--" * 900, "ab" * 3000 + " " * 50]


def docs(spark, extra=()):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, "tie", "x"), (3, "a", "x"), (None, "no id", "x"), (90, None, "x"), *extra]
    return spark.createDataFrame(rows, "doc_id long, text string, length string")


def reference(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(path))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("path,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces(path, spaced):
    p = tokens.Pieces(P.path(path), spaced)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(["a", "the", "é", " ", " ", "\n", "  ", ".", "'s", "12", " ", "Ώ"]) for _ in range(60)) for _ in range(300)]
    want = [np.asarray(x, "<u4").tobytes() for x in reference(path, texts)]
    assert p.encode(texts) == want
    assert [p.encode([t])[0] for t in texts] == want


def test_output_round_trip(spark):
    for df in (docs(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        ids = [x + [2] for x in reference("word_bpe_49k.json", [t for _, t in rows])]
        starts = np.append(0, np.cumsum([len(x) for x in ids])).tolist()
        written = shards.write_shards(df, shards.shared_dir(spark) + f"/t{random.random()}", P.path("word_bpe_49k.json"), 2)
        got = shards.read_shards(spark, written).collect()
        assert Counter(map(tuple, got)) == Counter((d, s, len(x), crc(x)) for (d, _), s, x in zip(rows, starts, ids))
        # One document alone, and any decoder of the format on the whole file.
        fs, name = shards.file_system(written[-1][1])
        r = shards.Reader(fs.open_input_file(name))
        last = rows[-1][0]
        assert [x.tolist() for x in r.find(last)] == [x for (d, _), x in zip(rows, ids) if d == last]
        import zstandard

        raw = open(name, "rb").read()
        assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"".join(np.asarray(x, "<u4").tobytes() for x in ids[len(ids) - len(r.index) :])
    assert shards.read_shards(spark, shards.write_shards(df.limit(0), "/tmp/none", P.path("word_bpe_49k.json"), 2)).count() == 0


def test_output_has_a_bound_of_its_own(tmp_path, monkeypatch):
    """Two workers stand beside an executor's heap: what they remember is bounded, and ids stay right when it is forgotten."""
    path, bound, frames = P.path("word_bpe_49k.json"), 100_000, []
    assert shards.REMEMBER <= 64 << 20
    monkeypatch.setattr(shards, "REMEMBER", bound)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("etaoinshrdlu", k=9)) for _ in range(400)) for _ in range(30)]

    class Frame:
        """What write_shards uses of a DataFrame, in this process."""

        sparkSession = None
        select = repartitionByRange = sortWithinPartitions = lambda self, *_: self

        def mapInArrow(self, run, schema):
            frames.extend(r for b in run(pa.RecordBatch.from_pydict({"doc_id": [k], "text": [t]}) for k, t in enumerate(texts)) for r in b.to_pylist())
            return self

        def collect(self):
            return [dict(r) for r in frames]

    monkeypatch.setattr(shards, "partitions", lambda spark: 1)
    monkeypatch.setattr(shards, "F", SimpleNamespace(substring=lambda *_: None))
    monkeypatch.setattr(shards, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    ((_, name, documents, _),) = shards.write_shards(Frame(), str(tmp_path), path, 2)
    r = shards.Reader(shards.file_system(name)[0].open_input_file(name))
    assert documents == 30 and [r.document(i).tolist() for i in range(30)] == [x + [2] for x in reference("word_bpe_49k.json", texts)]
    memory = tokens.memory_of(path, False, bound)
    assert len(memory.known) < 30 * 400 / 4


def test_damage(tmp_path, spark):
    with open(tmp_path / "f", "wb") as f:
        w = shards.Writer(f)
        w.add(1, np.arange(1000, dtype="<u4"))
        w.close()
    raw = bytearray((tmp_path / "f").read_bytes())
    raw[20] ^= 1
    (tmp_path / "f").write_bytes(raw)
    fs, name = shards.file_system(str(tmp_path / "f"))
    with pytest.raises(Exception):
        shards.Reader(fs.open_input_file(name)).document(0)


def held_packing(rows, source, capacity=2048):
    """rows: of pack(); source: (doc_id, ids)."""
    want, sequences = Counter(), defaultdict(list)
    for d, ids in source:
        n, at, k = len(ids), 0, 0
        while at < n:
            to = at + ((n - at) % capacity or capacity)
            want[d, k, at, to - at, crc(ids[at:to])] += 1
            at, k = to, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark):
    for df in (docs(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        rows = [(r.doc_id, r.text or "") for r in df.collect()]
        ids = [x + [0] for x in reference("byte_bpe_50k.json", [t for _, t in rows])]
        cut = packing.pieces(df, P.path("byte_bpe_50k.json"), 0)
        n = held_packing(packing.pack(cut).collect(), [(d, x) for (d, _), x in zip(rows, ids)])
        bound = -(-sum(map(len, ids)) // 2048)
        assert n <= bound + max(1, bound // 100)
    assert packing.pack(cut.limit(0)).count() == 0


def best(lengths, capacity):
    """The fewest bins, by trying everything."""
    least = [len(lengths)]

    def go(i, bins):
        if len(bins) >= least[0]:
            return
        if i == len(lengths):
            least[0] = len(bins)
            return
        for k in sorted({b: k for k, b in enumerate(bins)}.values()):
            if bins[k] + lengths[i] <= capacity:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return least[0]


def test_plan_is_near_the_best():
    rng = random.Random(3)
    over = 0
    for _ in range(60):
        lengths = sorted((rng.randint(1, 60) for _ in range(rng.randint(1, 9))), reverse=True)
        steps = packing.plan(dict(Counter(lengths)), 60)
        used = Counter()
        for times, chosen in steps:
            assert sum(chosen) <= 60
            for l in chosen:
                used[l] += times
        assert used == Counter(lengths)
        over += sum(t for t, _ in steps) - best(lengths, 60)
    assert over <= 1


def test_transducer():
    import tiktoken

    ranks = bpe.load(P.path("byte_bpe_50k.tiktoken"))
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(7)
    pieces = ["".join(rng.choice("aeiothnrsldé\U0001f600 .-_=日") for _ in range(rng.randint(1, 25))) for _ in range(3000)] + [t[:2000] for t in ODD]
    for p in pieces:
        assert c.transducer.encode(p.encode()) == want._encode_single_piece(p) if p else True
    for t in ODD:
        (ids,) = c.encode([t])
        assert ids.tolist() == want.encode_ordinary(t) and c.decode(ids.tolist()) == t.encode()


def test_decoder_any_ids():
    """Every feed gives whole characters, and nothing is lost, also where the ids are no text."""
    ranks = bpe.load(P.path("byte_bpe_50k.tiktoken"))
    by_id = {i: t for t, i in ranks.items()}
    d, rng = bpe.Decoder(by_id), random.Random(2)
    for _ in range(200):
        ids = [rng.choice([rng.randrange(256), rng.randrange(50256)]) for _ in range(30)]
        assert b"".join([*(d.feed([i]) for i in ids), d.finish()]) == b"".join(by_id[i] for i in ids)
    text = "日本 é\U0001f600"
    got = [d.feed([ranks[bytes([b])]]) for b in text.encode()]
    assert [g.decode() for g in got if g] == list(text) and d.finish() == b""


def test_bpe_query(spark):
    import tiktoken

    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for df in (docs(spark), spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")):
        got = bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
        rows = []
        for r in df.collect():
            ids = want.encode_ordinary(r.text or "")
            rows.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == Counter(rows)
    assert bpe.encode(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
