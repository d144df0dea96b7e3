"""Operator 9: exact round trips through every part of the format."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from lumispec.llm import media, webp

SF = "/root/testdata/sf0.01"


def image(kind, height, width):
    rng = np.random.default_rng(height * 1000 + width)
    if kind == "noise":
        return rng.integers(0, 256, (height, width, 4), np.uint8)
    if kind == "one":
        return np.full((height, width, 4), 7, np.uint8)
    if kind == "smooth":
        y, x = np.mgrid[:height, :width]
        return np.stack([np.full_like(x, 255), x * 3 + y, x + 2 * y, x - y], -1).astype(np.uint8)
    colours = rng.integers(0, 256, ({"two": 2, "four": 4, "few": 13, "many": 200}[kind], 4), np.uint8)
    return colours[np.repeat(rng.integers(0, len(colours), (height, -(-width // 3))), 3, 1)[:, :width]]


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (5, 1), (13, 17), (24, 40)])
@pytest.mark.parametrize("kind", ["noise", "one", "smooth", "two", "four", "few", "many"])
@pytest.mark.parametrize("how", [{}, {"references": False}, {"cache_bits": 4}, {"cache_bits": 11, "subtract": True}, {"palette": True}, {"predictor": -1}, {"predictor": -1, "cross_factors": (-7, 40, 100), "cache_bits": 2, "region_bits": 2}, {"predictor": 11, "block_bits": 2, "subtract": True}])
def test_round_trip(kind, shape, how):
    pixels = image(kind, *shape)
    if how.get("palette") and len(np.unique(webp.numbers(pixels))) > 256:
        return
    raw = webp.encode(pixels, **how)
    assert (webp.decode(raw) == pixels).all()
    if "references" not in how and kind == "one" and shape == (24, 40):
        assert len(raw) < 400


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    """The inverse by arrays and by single pixels is what the definition says, pixel by pixel."""
    pixels = image("noise", 6, 11)
    left = webp.predict(pixels, np.full((2, 2), mode), 3, True)
    assert (webp.predict(left, np.full((2, 2), mode), 3, False) == pixels).all()


def test_near_pixels():
    assert len(webp.NEAR) == 120 and webp.NEAR[:9] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1)] and webp.NEAR[-3:] == [(-7, 7), (8, 6), (8, 7)]


def test_prefixes():
    for n in [*range(1, 300), 4096, 1 << 20]:
        s, k, v = webp.prefix_of(n)
        out = webp.BitWriter()
        out.write(v, k)
        assert webp.amount(webp.BitReader(out.bytes()), s) == n


def test_fast_is_a_plain_file():
    for top in (1, 100, 127, 128, 255):
        p = np.random.default_rng(top).integers(0, top + 1, (5, 192, 3), np.uint8)
        got = webp.decode(webp.encode_fast(p))
        assert (got[..., 1:] == p).all() and (got[..., 0] == 255).all()


def test_long_payload():
    payload, n = media.payload_of("é" * 5_000_000)
    stored = media.to_webp(payload)
    assert n == 10_000_000 and len([*media.strips(stored)]) == -(-len(payload) // (576 * media.ROWS)) and media.from_webp(stored).tobytes() == payload


def expected(text):
    raw = (text or "").encode()
    p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    return len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])


def test_query(spark):
    odd = [(1, ""), (2, None), (None, "x" * 576), (3, "é" * 288 + "a"), (3, "é" * 288 + "a"), (4, "\U0001f600\x00\n")]
    df = spark.createDataFrame([(*r, "clash") for r in odd], "doc_id long, text string, media string")
    got = media.load(media.store(df), keep_samples=True).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == Counter((i, *expected(t)) for i, t in odd)
    assert all(hashlib.sha256(r.samples).hexdigest() == r.payload_sha256 and hashlib.sha256(r.media).hexdigest() == r.media_sha256 for r in got)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = media.op9_media_columns(spark, SF).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == Counter((r.doc_id, *expected(r.text)) for r in docs.collect())
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert media.load(media.store(df.limit(0))).count() == 0
