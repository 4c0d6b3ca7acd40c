"""Every column of the media query against a plain computation; tiles in exact arithmetic; NPY files."""

import hashlib
import io
import zlib
from fractions import Fraction

import numpy as np
import pytest

from serialspark.llm import media

DOCS = "doc_id long, text string, tile string, found string"
TEXTS = [None, "", "a", "x" * 576, "x" * 577, "é日🙂" * 400, "word " * 30000, "a"]


def area_means(image, width, height):
    rows, columns, channels = image.shape
    cover = lambda i, cell, size, cells: max(Fraction(0), min(Fraction(i + 1), Fraction((cell + 1) * size, cells)) - max(Fraction(i), Fraction(cell * size, cells)))
    out = np.zeros((height, width), np.uint8)
    for y in range(height):
        for x in range(width):
            total = sum((cover(i, y, rows, height) * cover(j, x, columns, width) * int(image[i, j].sum()) for i in range(rows) for j in range(columns) if cover(i, y, rows, height) and cover(j, x, columns, width)), Fraction(0))
            out[y, x] = int(total * width * height / (rows * columns * channels) + Fraction(1, 2))
    return out


@pytest.mark.parametrize("shape", [(1, 24, 1), (24, 24, 1), (7, 24, 3), (5, 8, 3)])
def test_tiles_are_exact(shape):
    rng = np.random.default_rng(3)
    for _ in range(3):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        assert (media.resize(image, 9, 8) == area_means(image, 9, 8)).all()
    if shape[0] == 1:
        assert (np.diff(media.resize(image, 9, 8).astype(int), axis=0) == 0).all()


def test_difference_hash():
    tile = np.zeros((8, 9), np.uint8)
    tile[0, 0], tile[7, 7] = 9, 9
    assert media.difference_hash(tile) == "8000000000000001"


@pytest.mark.parametrize("kind", media.KINDS)
def test_all_columns(spark, kind):
    df = spark.createDataFrame([(i or None, t, "kept", "kept") for i, t in enumerate(TEXTS)], DOCS)
    got = {r.doc_id or 0: r for r in media.tiles(media.store(df, kind=kind)).collect()}
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        if kind == "bmp":
            rows = [payload[k : k + 72] for k in range(0, len(payload), 72)]
            body = b"".join(bytes(x for p in range(0, 72, 3) for x in r[p : p + 3][::-1]) for r in reversed(rows))
            stored = b"BM" + (54 + len(body)).to_bytes(4, "little") + media.encode(payload, "bmp")[6:54] + body
        else:
            width, channels = (24, 1) if kind == "pgm" else (8, 3)
            stored = f"P{5 if kind == 'pgm' else 6}\n{width} {len(payload) // width // channels}\n255\n".encode() + payload
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256, r.media_kind) == (len(stored), hashlib.sha256(stored).hexdigest(), kind)
        tile = np.load(io.BytesIO(bytes(r.tile)))
        assert (tile == media.resize(media.decode(stored), 9, 8)).all() and r.feature == media.difference_hash(tile)
    assert got[2].feature == got[7].feature and media.tiles(media.store(df.limit(0))).count() == 0


def test_npy_files(spark, tmp_path):
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(TEXTS)], DOCS).repartition(2)
    found = media.tiles(media.store(df))
    by_id = {r.doc_id: np.load(io.BytesIO(bytes(r.tile))) for r in found.collect()}
    out = media.write_tiles(found, f"file:{tmp_path}/npy").collect()
    assert len(out) == len(TEXTS) and all((np.load(r.file)[r.row] == by_id[r.doc_id]).all() for r in out)
    assert sorted(p.name for p in (tmp_path / "npy").iterdir()) == sorted({r.file.split("/")[-1] for r in out})
    with pytest.raises(ValueError):
        media.write_tiles(found, "s3://bucket/npy")
