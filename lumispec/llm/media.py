"""Operator 9, media columns in lossless WebP.

Payloads become images of WIDTH by as many rows as it takes, three samples to a pixel, in strips of ROWS rows; the
strips' files stand one after the other in a binary column. Each file has prefix codes of its own, back-references, a
colour cache and the transforms of the format, where they make it smaller: subtract-green, predictor and cross-colour by
blocks, palette. Files are encoded and decoded many at a time (batch.py), in batches of bounded size; the decoder writes
the pixel arrays back. Nothing is shuffled.

Defined results: a null or empty text is 576 bytes of 255; null ids, repeated rows and extra columns pass through;
an empty table gives an empty table; texts of any length are stored whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batch as many
from .common import table
from .tokens import slices

WIDTH, UNIT = 192, 576
#: Rows of a strip: low ones let more files be decoded in step. Strips that are encoded or decoded at a time.
ROWS, STRIPS = 8, 1536


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(padded payload, bytes of the text)."""
    raw = (text or "").encode()
    size = max(1, -(-len(raw) // UNIT)) * UNIT
    return raw.ljust(size, b"\xff"), len(raw)


def all_to_webp(payloads: list[bytes]) -> list[bytes]:
    """The files of each payload, one after the other."""
    cut = [p[a : a + ROWS * UNIT] for p in payloads for a in range(0, len(p), ROWS * UNIT)]
    files: list[bytes] = []
    for a in range(0, len(cut), STRIPS):
        files += many.encode([np.frombuffer(p, np.uint8).reshape(-1, WIDTH, 3) for p in cut[a : a + STRIPS]])
    out, at = [], 0
    for p in payloads:
        n = -(-len(p) // (ROWS * UNIT))
        out.append(b"".join(files[at : at + n]))
        at += n
    return out


def strips(media: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(media):
        n = 8 + struct.unpack_from("<I", media, at + 4)[0]
        yield media[at : at + n]
        at += n


def all_from_webp(media: list[bytes]) -> list[np.ndarray]:
    """(rows, WIDTH, 3) samples of each."""
    files = [[*strips(m)] for m in media]
    flat, pixels = [f for each in files for f in each], []
    for a in range(0, len(flat), STRIPS):
        pixels += [p[..., 1:] for p in many.decode(flat[a : a + STRIPS])]
    out, at = [], 0
    for each in files:
        out.append(np.concatenate(pixels[at : at + len(each)]))
        at += len(each)
    return out


def to_webp(payload: bytes) -> bytes:
    return all_to_webp([payload])[0]


def from_webp(media: bytes) -> np.ndarray:
    return all_from_webp([media])[0]


def feature(pixels: np.ndarray) -> str:
    """Rows and columns, the mean and deviation of each colour in thousandths, and how many samples the largest bin of 16 holds."""
    flat = pixels.reshape(-1, 3).astype(np.int64)
    n, sums, squares = len(flat), flat.sum(0), (flat**2).sum(0)
    means = [int(s) * 1000 // n for s in sums]
    variance = [(int(q) * n - int(s) ** 2) * 1000 // (n * n) for q, s in zip(squares, sums)]
    bins = np.bincount(pixels.ravel() >> 4, minlength=16)
    return f"{pixels.shape[0]}x{pixels.shape[1]};mean={means};var={variance};peak={int(bins.argmax())}:{int(bins.max())}"


def mapped(df: DataFrame, column: str, out: list[tuple[str, str, pa.DataType]], f) -> DataFrame:
    """Adds columns: rows of f(values), for batches of values that are bounded in bytes, or one value."""
    kept = [c for c in df.columns if c not in [n for n, _, _ in out]]
    df = df.select(*[f"`{c}`" for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in slices(batch, column):
                made = list(zip(*f(values.to_pylist())))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, t) for x, (_, _, t) in zip(made, out))], names=kept + [n for n, _, _ in out])

    types = [f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema] + [f"{n} {t}" for n, t, _ in out]
    return df.mapInArrow(run, ", ".join(types))


def store(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds media (the WebP files) and n_bytes (of the text)."""

    def rows(texts: list[str]) -> list[tuple]:
        payloads = [payload_of(t) for t in texts]
        return list(zip(all_to_webp([p for p, _ in payloads]), [n for _, n in payloads]))

    return mapped(df, text_col, [("media", "binary", pa.binary()), ("n_bytes", "long", pa.int64())], rows)


def load(df: DataFrame, media_col: str = "media", keep_samples: bool = False) -> DataFrame:
    """Adds payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and samples (the pixel array) if asked for."""
    out = [("payload_bytes", "long", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "long", pa.int64()), ("media_bytes", "long", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string())]
    if keep_samples:
        out.append(("samples", "binary", pa.binary()))

    def one(media: bytes, pixels: np.ndarray) -> tuple:
        raw = pixels.tobytes()
        row = (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels))
        return (*row, raw) if keep_samples else row

    return mapped(df, media_col, out, lambda media: [one(m, p) for m, p in zip(media, all_from_webp(media))])


def op9_media_columns(spark, sf_dir):
    stored = store(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "media")
    return load(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.col("feature"))
