"""The batched WebP coder against the plain decoder, files written bit by bit, and features counted by hand."""

import random

import numpy as np
import pytest

from lumispec.llm import batch, media, webp

from .test_media import image


def texts():
    rng = random.Random(4)
    words = ["the", "of", "and", "é", "日本", "\n", "42", "a" * 30, "line of text that comes again and again"]
    return ["", "x", "a" * 5000, "\xff" * 3000, *(" ".join(rng.choices(words, k=n)) for n in (3, 80, 400, 2500)), "".join(chr(rng.randrange(32, 1000)) for _ in range(3000)), "ab" * 576]


def test_plain_decoder_reads_batches():
    payloads = [media.payload_of(t)[0] for t in texts()]
    for p, stored in zip(payloads, media.all_to_webp(payloads)):
        slow = np.concatenate([webp.decode(f)[..., 1:] for f in media.strips(stored)])
        assert slow.tobytes() == p == media.from_webp(stored).tobytes()
        assert stored == media.to_webp(p)  # a file does not depend on those beside it
    assert sum(map(len, media.all_to_webp(payloads))) < sum(map(len, payloads)) / 2


@pytest.mark.parametrize("kind", ["noise", "one", "smooth", "two", "few", "many"])
def test_colours_and_sizes(kind):
    strips = [np.ascontiguousarray(image(kind, h, 40)[..., 1:]) for h in (1, 3, 24, 8)]
    files = batch.encode(strips)
    for s, f, got in zip(strips, files, batch.decode(files)):
        assert (got[..., 1:] == s).all() and (got[..., 0] == 255).all() and (webp.decode(f) == got).all()


def test_other_files_in_step():
    """Files of the general encoder, some of which only the plain decoder reads, in one batch."""
    hows = [{}, {"cache_bits": 4}, {"cache_bits": 11, "subtract": True}, {"palette": True}, {"predictor": 5}, {"cross_factors": (3, -9, 40)}, {"region_bits": 2}, {"references": False}]
    images = [image("few", 13 + k, 29) for k in range(len(hows))]
    files = [webp.encode(p, **how) for p, how in zip(images, hows)]
    for p, got in zip(images, batch.decode(files)):
        assert (got == p).all()


def test_references_and_cache_are_used():
    """A repeated block is a copy, scattered colours are looked up, grey is taken off."""
    rng = np.random.default_rng(8)
    block = rng.integers(0, 256, (8, 192, 3), np.uint8)
    once, twice = batch.encode([block])[0], batch.encode([np.vstack([block, block])])[0]
    assert len(twice) < len(once) * 1.05
    colours = rng.integers(0, 256, (40, 3), np.uint8)
    scattered = colours[rng.integers(0, 40, (16, 192))]
    file = batch.encode([scattered])[0]
    assert webp.BitReader(file[25:]).read(2) >> 1 == 1 and len(file) < 16 * 192  # no transform, then a cache
    grey = np.repeat(rng.integers(0, 256, (16, 192, 1), np.uint8), 3, axis=2)
    assert webp.BitReader(batch.encode([grey])[0][25:]).read(3) == 0b101  # subtract green


def written(width, height, *fields):
    """A file from (value, bits) fields, written by hand."""
    value = n = 0
    for v, k in ((width - 1, 14), (height - 1, 14), (0, 4), *fields):
        value |= v << n
        n += k
    body = b"\x2f" + value.to_bytes(-(-n // 8), "little")
    body += b"\0" * (len(body) % 2)
    return b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def test_file_by_hand():
    """Two symbols of green in one bit each, other colours without bits: red 7, blue 1, alpha 255."""
    simple = lambda s: ((0b101, 3), (s, 8))
    two = ((0b111, 3), (10, 8), (200, 8))
    file = written(5, 1, (0, 1), (0, 1), (0, 1), *two, *simple(7), (0b001, 3), (1, 1), *simple(255), (0b001, 3), (0, 1), (0b01101, 5))
    want = [[255, 7, g, 1] for g in (200, 10, 200, 200, 10)]
    for got in (webp.decode(file), batch.decode([file])[0]):
        assert got.tolist() == [want]


def test_damaged_files():
    good = batch.encode([image("noise", 8, 192)[..., 1:]])[0]
    with pytest.raises(ValueError):
        batch.decode([b"RIFF" + good[4:8] + b"XXXX" + good[12:]])
    short = good[: len(good) // 2]
    short = short[:16] + (len(short) - 20).to_bytes(4, "little") + short[20:]
    with pytest.raises(ValueError):
        batch.decode([short])


def test_feature_by_hand():
    pixels = np.array([[[0, 10, 255], [4, 10, 255]], [[8, 20, 0], [0, 20, 2]]], np.uint8)
    columns = [[0, 4, 8, 0], [10, 10, 20, 20], [255, 255, 0, 2]]
    means = [sum(c) * 1000 // 4 for c in columns]
    variances = [(4 * sum(v * v for v in c) - sum(c) ** 2) * 1000 // 16 for c in columns]
    bins = [v >> 4 for c in columns for v in c]
    top = max(range(16), key=bins.count)
    assert media.feature(pixels) == f"2x2;mean={means};var={variances};peak={top}:{bins.count(top)}"


def test_code_lengths_are_complete():
    rng = np.random.default_rng(5)
    counts = rng.geometric(0.01, (200, 300)) * (rng.random((200, 300)) < rng.random((200, 1)))
    counts[0] = 0
    counts[1] = 0
    counts[1, 7] = 5
    counts[2] = 2 ** np.minimum(np.arange(300), 60)
    lengths = batch.code_lengths(counts)
    for c, l in zip(counts, lengths):
        if (c > 0).sum() > 1:
            assert ((l > 0) == (c > 0)).all() and sum(2.0 ** -k for k in l[l > 0].tolist()) == 1 and l.max() <= batch.LIMIT
        else:
            assert not l.any()


def kinds(file):
    """The transforms of a file, in order, by the plain decoder."""
    found, real = [], webp.undone
    webp.undone = lambda pixels, kind, *rest: found.insert(0, kind) or real(pixels, kind, *rest)
    try:
        webp.decode(file)
    finally:
        webp.undone = real
    return found


def test_transforms_are_chosen():
    """Slopes are predicted, what green tells of red is taken off, few colours are a palette; each file is smaller than without."""
    rng = np.random.default_rng(11)
    y, x = np.mgrid[:8, :192]
    noise = rng.integers(-20, 21, (8, 192))
    smooth = np.stack([x * 3 + y, x + 2 * y, x - y], -1).astype(np.uint8)
    told = np.stack([2 * x + noise // 2 + rng.integers(0, 2, noise.shape), 100 + x // 2 + noise, 3 * x - noise], -1).astype(np.uint8)
    few = rng.integers(0, 256, (2, 3), np.uint8)[(rng.random((8, 192)) < 0.1).astype(int)]
    strips = [smooth, told, few, rng.integers(0, 256, (8, 192, 3), np.uint8)]
    files = batch.encode(strips)
    found = [kinds(f) for f in files]
    assert webp.PREDICTOR in found[0] and webp.CROSS in found[1] and found[2] == [webp.PALETTE] and found[3] in ([], [webp.SUBTRACT])
    for s, f, got in zip(strips, files, batch.decode(files)):
        plain = batch.coded(batch.looked_at(np.ascontiguousarray(s.transpose(2, 0, 1))[:, None])[0])[0]
        assert len(f) < len(plain) or f == plain
        assert (got[..., 1:] == s).all() and (webp.decode(f) == got).all()


def test_transforms_in_step():
    """Files with any transforms come from the batch's own decoder, whatever their modes and sizes."""
    hows = [{"predictor": -1, "block_bits": 2}, {"predictor": -1, "cross_factors": (-7, 40, 100), "cache_bits": 2}, {"palette": True}, {"predictor": 11, "subtract": True}, {"palette": True, "predictor": 1}, {}]
    images = [image(("few", "smooth", "four", "noise", "few", "one")[k], 3 + 5 * k % 17, 40) for k in range(len(hows))]
    got = batch.in_step([webp.encode(p, **how) for p, how in zip(images, hows)])
    for p, g in zip(images[:3] + images[4:], got[:3] + got[4:]):
        assert (g == p).all()
    assert got[3] is None or (got[3] == images[3]).all()  # codes of over LIMIT bits are left to webp.decode()


def test_predictions_agree():
    """The modes of the batch are those of the plain coder."""
    rng = np.random.default_rng(2)
    l, t, tr, tl = rng.integers(0, 256, (4, 3, 50, 4, 5), np.uint8)
    for mode, p in enumerate(batch.guesses(l, t, tr, tl)):
        want = webp.predicted(mode, *(np.moveaxis(np.concatenate([np.full_like(c[:1], 255), c]), 0, -1).astype(int) for c in (l, t, tr, tl)))
        assert (p == np.moveaxis(np.broadcast_to(want, (50, 4, 5, 4))[..., 1:], -1, 0)).all()


def test_codes_are_huffmans():
    """As short as a heap makes them, wherever LIMIT bits hold the tree."""
    counts = np.random.default_rng(9).geometric(0.02, (100, 60)) * (np.arange(60) < np.arange(100)[:, None])
    for c, l in zip(counts, batch.code_lengths(counts)):
        want = webp.code_lengths(c.tolist(), 60) if (c > 0).sum() > 1 else None
        if want and max(want) <= batch.LIMIT:
            assert (c * l).sum() == (c * np.array(want)).sum()


def test_regions_are_chosen():
    """Halves of different colours have codes of their own, and come from the batch's own decoder."""
    rng = np.random.default_rng(3)
    strip = np.concatenate([rng.integers(0, 16, (24, 192, 3)) + start for start in ((0, 100, 200), (200, 0, 100))]).astype(np.uint8)
    one, two = batch.encode([strip[:24], strip])
    assert webp.BitReader(two[25:]).read(3) == 0b100  # no transform, no cache, regions
    for s, f, got in zip([strip, strip[:24], strip], [two, one, two], batch.in_step([two, one, two])):
        assert (got[..., 1:] == s).all() and (webp.decode(f) == got).all()
    plain = batch.coded(batch.looked_at(np.ascontiguousarray(strip.transpose(2, 0, 1))[:, None])[0])[0]
    assert len(two) < len(plain)
    files = [webp.encode(image("few", 9 + k, 21), region_bits=2, cache_bits=3) for k in range(4)]
    for k, got in enumerate(batch.in_step(files)):
        assert (got == image("few", 9 + k, 21)).all()
