"""Operator 10, token ids in binary files: independent zstandard frames, a trailing seek table, a checksum a frame.

A file is a run of zstandard frames, one for each document (a document of over FRAME ids has several), then two
skippable frames: the index of documents, and a seek table in the layout of the public seekable zstandard format
(sizes of each frame, compressed and not, and the low 32 bits of the XXH64 of its content). Any zstandard decoder
reads such a file; a reader of some documents reads the file's end, and then only these documents' frames.

Documents are dealt to files by ranges of doc_id, sorted within them; a file is written under a name of its own and
then renamed, so a task that is run again, or twice, leaves one whole file. What comes to the driver is a row a file.

Defined results: a null or empty text has the end id alone; null ids come first; repeated ids stand side by side in
the order of their texts, each a document; other columns are left out; an empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, shared_dir, table
from .tokens import encoded

#: Ids to a frame at most.
FRAME = 1 << 20
LEVEL = 3
#: Bytes that a worker remembers at most: two workers stand beside an executor's heap.
REMEMBER = 64 << 20
# Fixed values of the public formats.
SEEK_FRAME, INDEX_FRAME, SEEK_END = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("frames", "<u4"), ("ids", "<u8")])


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Writer:
    """Documents to one file."""

    def __init__(self, out, width: int = 4):
        import zstandard

        self.out, self.width, self.frames, self.index = out, width, [], []
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.documents = self.ids = self.bytes = 0

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.bytes += len(raw)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        import xxhash

        first = len(self.frames)
        for at in range(0, max(len(ids), 1), FRAME):
            raw = ids[at : at + FRAME].astype(f"<u{self.width}").tobytes()
            packed = self.zstd.compress(raw)
            self._put(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.index.append((doc_id or 0, doc_id is None, first, len(self.frames) - first, len(ids)))
        self.documents, self.ids = self.documents + 1, self.ids + len(ids)

    def close(self) -> None:
        index = struct.pack("<B", self.width) + np.array(self.index, INDEX).tobytes()
        self._put(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        seek = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames), 0x80, SEEK_END)
        self._put(struct.pack("<II", SEEK_FRAME, len(seek)) + seek)
        self.out.close()


class Reader:
    """Random access to one file's documents."""

    def __init__(self, file):
        import zstandard

        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        size = file.size()
        n, flags, end = struct.unpack("<IBI", self._at(size - 9, 9))
        if end != SEEK_END or not flags & 0x80:
            raise ValueError("the file has no seek table with checksums")
        table_at = size - 9 - 12 * n - 8
        self.frames = np.frombuffer(self._at(table_at + 8, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.append(0, np.cumsum(self.frames[:, 0]))
        index_at = int(self.starts[-1])
        raw = self._at(index_at + 8, table_at - index_at - 8)
        self.width, self.index = raw[0], np.frombuffer(raw, INDEX, offset=1)

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        import xxhash

        raw = self.zstd.decompress(self._at(int(self.starts[k]), int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k} does not have its checksum")
        return raw

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the file."""
        first, n = int(self.index["frame"][i]), int(self.index["frames"][i])
        return np.frombuffer(b"".join(self.frame(k) for k in range(first, first + n)), f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        return [self.document(i) for i in np.flatnonzero((self.index["doc_id"] == doc_id) & (self.index["null"] == 0))]


def write_shards(docs: DataFrame, directory: str, tokenizer: str, end_id: int, spaced: bool = False) -> list[tuple[int, str, int, int]]:
    """Writes docs (doc_id, text) to files in directory; (part, path, documents, ids) of each, in the order of doc_id."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), None
        fs, path = file_system(directory)
        name, mine = f"{path}/part-{part:06d}.ids.zst", f"{path}/_part-{part:06d}-{uuid.uuid4().hex}"
        for batch, ids, offsets in encoded(batches, "text", tokenizer, spaced, end_id, REMEMBER):
            if out is None:
                fs.create_dir(path, recursive=True)
                out = Writer(fs.open_output_stream(mine, compression=None), 4)
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                out.add(doc_id, ids[a:b])
        if out is not None:
            out.close()
            fs.move(mine, name)
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name.rpartition("/")[2]], "documents": [out.documents], "ids": [out.ids]}, schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    n = partitions(docs.sparkSession)
    # Rows of one id are dealt by how their texts begin, too, which is in line with the order of whole texts.
    dealt = docs.select("doc_id", "text").repartitionByRange(n, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    rows = dealt.mapInArrow(write, "part int, name string, documents long, ids long").collect()  # a row a file
    return sorted((r["part"], f"{directory}/{r['name']}", r["documents"], r["ids"]) for r in rows)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_shards(spark, shards: list[tuple[int, str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                fs, name = file_system(path)
                with fs.open_input_file(name) as file:
                    r = Reader(file)
                    starts = base + np.append(0, np.cumsum(r.index["ids"].astype(np.int64)))
                    for a in range(0, len(r.index), 10_000):
                        some = range(a, min(a + 10_000, len(r.index)))
                        crc = [zlib.crc32(r.document(i).tobytes()) for i in some]
                        ids = pa.array(r.index["doc_id"][a : a + 10_000], mask=r.index["null"][a : a + 10_000].astype(bool))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(starts[some.start : some.stop]), pa.array(r.index["ids"][a : a + 10_000].astype(np.int64)), pa.array(crc, pa.int64())], schema=SCHEMA)

    base, rows = 0, []
    for _, path, _, ids in shards:
        rows.append((path, base))
        base += ids
    files = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_output(spark, sf_dir):
    import public_tokenizers

    directory = f"{shared_dir(spark)}/lumispec/ids-{uuid.uuid4().hex}"
    return read_shards(spark, write_shards(table(spark, sf_dir, "documents"), directory, public_tokenizers.path("word_bpe_49k.json"), 2))
