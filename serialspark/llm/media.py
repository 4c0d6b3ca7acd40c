"""Texts or pixels as small images: Netpbm and BMP bytes, area-resized NPY tiles, difference hashes.

A payload of 8-bit samples is kept as a binary grey map (P5), a binary colour map (P6) or a 24-bit BMP; the
kind is a parameter.
Images decode to numpy arrays; tiles are area means taken from an integral image, so every sample counts in
proportion to how much of it a tile's cell covers; a difference hash has one bit for each two cells side by
side, set where the left one is brighter.

Null texts count as empty, null ids stay null. Equal payloads give equal files, tiles and hashes. A file that can't be decoded
raises ValueError. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

from .common import chunks, free_name, written

UNIT, PAD, TILE = 576, b"\xff", (9, 8)
KINDS, KIND, BATCH_BYTES = ("pgm", "ppm", "bmp"), "ppm", 8_000_000
WIDTH = {"pgm": 24, "ppm": 8, "bmp": 24}  # samples in a row divide UNIT: 24, 3 * 8 and 3 * 24 - the last fills whole BMP rows


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """data with bytes 255 up to a positive multiple of unit."""
    return data + PAD * (-len(data) % unit or (unit if not data else 0))


def encode(payload: bytes, kind: str) -> bytes:
    """The payload as an image file. BMP rows run from the bottom up and blue comes first, as the format has it."""
    width, channels = WIDTH[kind], 1 if kind == "pgm" else 3
    height = len(payload) // (width * channels)
    if not height or len(payload) % (width * channels):
        raise ValueError(f"{len(payload)} samples don't fill rows of {width} pixels")
    if kind != "bmp":
        return b"P%d\n%d %d\n255\n" % (5 if kind == "pgm" else 6, width, height) + payload
    pixels = np.frombuffer(payload, np.uint8).reshape(height, width, 3)[::-1, :, ::-1]
    size = 54 + len(payload)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", size, 0, 0, 54, 40, width, height, 1, 24, 0, len(payload), 2835, 2835, 0, 0) + pixels.tobytes()


def decode(data: bytes) -> np.ndarray:
    """(height, width, channels) of unsigned bytes, from P5, P6 or an uncompressed 24-bit BMP."""
    if data[:2] == b"BM":
        start, header, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
        if header < 40 or bits != 24 or packed or width <= 0 or not height:
            raise ValueError("not an uncompressed 24-bit BMP")
        stride = (width * 3 + 3) // 4 * 4
        if len(data) < start + stride * abs(height):
            raise ValueError("cut off")
        rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * 3].reshape(abs(height), width, 3)
        return np.ascontiguousarray((rows[::-1] if height > 0 else rows)[:, :, ::-1])
    head = re.match(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", data)
    if not head or int(head[4]) > 255:
        raise ValueError("not a binary Netpbm file of 8-bit samples")
    channels, width, height = 1 if head[1] == b"5" else 3, int(head[2]), int(head[3])
    if len(data) - head.end() < width * height * channels:
        raise ValueError("cut off")
    return np.frombuffer(data, np.uint8, width * height * channels, head.end()).reshape(height, width, channels)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area means (height, width) of the image's grey values, rounded half up, from its integral image; in integers, so ties are exact."""
    rows, columns, channels = image.shape
    total = np.zeros((rows + 1, columns + 1), np.int64)
    np.cumsum(np.cumsum(image.sum(axis=2, dtype=np.int64), axis=0), axis=1, out=total[1:, 1:])
    for axis, size, cells in ((0, rows, height), (1, columns, width)):
        # the integral at the cells' edges, linear between samples, times the number of cells
        at, part = np.divmod(np.arange(cells + 1) * size, cells)
        part = part.reshape((-1, 1) if axis == 0 else (1, -1))
        total = np.take(total, at, axis) * (cells - part) + np.take(total, np.minimum(at + 1, size), axis) * part
    sums = total[1:, 1:] - total[:-1, 1:] - total[1:, :-1] + total[:-1, :-1]
    area = rows * columns * channels
    return ((2 * sums + area) // (2 * area)).astype(np.uint8)


def difference_hash(tile: np.ndarray) -> str:
    return np.packbits(tile[:, :-1] > tile[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0))
    return out.getvalue()


MEDIA = StructType().add("n_bytes", LongType()).add("media_kind", StringType()).add("media", BinaryType())
FEATURES = StructType().add("payload_bytes", LongType()).add("payload_sha256", StringType()).add("tail_crc32", LongType()).add("media_bytes", LongType()).add("media_sha256", StringType()).add("feature", StringType()).add("tile", BinaryType())


def media_column(kind: str = KIND):
    """A function of a text column: the text's bytes as an image file of that kind."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {KINDS}")

    @F.pandas_udf(MEDIA)
    def media(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch)
            for lo, hi in chunks(texts, BATCH_BYTES):  # the files of a whole batch aren't held at once
                data = [(t or "").encode("utf-8", "surrogatepass") for t in texts[lo:hi]]
                yield pd.DataFrame([(len(d), kind, encode(padded(d), kind)) for d in data], columns=MEDIA.names)
            if not texts:
                yield pd.DataFrame([], columns=MEDIA.names)

    return media


@F.pandas_udf(FEATURES)
def features_column(media: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """What a stored image file holds: its payload's digests, its tile as NPY bytes, the tile's difference hash."""
    for batch in media:
        files, rows = list(batch), []
        for m in files:
            image = decode(m)
            payload = image.tobytes()
            tile = resize(image, *TILE)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), difference_hash(tile), npy(tile)))
        yield pd.DataFrame(rows, columns=FEATURES.names)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = KIND) -> DataFrame:
    """Writes (doc_id, n_bytes, media_kind, media) as a table in the shared folder and returns it as read back."""
    media = docs.select(F.col(id_col).alias("doc_id"), media_column(kind)(F.col(f"`{text_col}`").cast("string")).alias("m"))
    return written(media.select("doc_id", "m.*"), "media")


def tiles(media: DataFrame, media_col: str = "media") -> DataFrame:
    """The rows of a media table without the files, with features, and tiles as NPY bytes; columns of those names are replaced."""
    found = free_name(media, "_features")
    kept = [F.col(f"`{c}`") for c in media.columns if c != media_col and c.lower() not in FEATURES.names]
    return media.withColumn(found, features_column(F.col(f"`{media_col}`"))).select(*kept, f"{found}.*")


def write_tiles(found: DataFrame, folder: str, id_col: str = "doc_id", tile_col: str = "tile") -> DataFrame:
    """Stacks tiles as NPY files of (tiles, height, width) in a folder that all executors share; returns (doc_id, file, row) of each.

    A file holds one Arrow batch of a partition and is named by both, so a task that runs again replaces its own
    files; each appears under its name only when it is whole.
    """
    place = folder.removeprefix("file:")
    if "://" in place:
        raise ValueError("NPY files need a folder that tasks can open")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(place, exist_ok=True)
        task = TaskContext.get()
        for no, pdf in enumerate(b for b in batches if len(b)):
            name = f"{place}/tiles-{task.partitionId():06d}-{no:05d}.npy"
            part = f"{name}.{task.taskAttemptId()}"
            with open(part, "wb") as f:
                np.lib.format.write_array(f, np.stack([np.load(io.BytesIO(t)) for t in pdf["tile"]]))
            os.replace(part, name)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "file": name, "row": range(len(pdf))})

    rows = found.select(F.col(id_col).cast("long").alias("doc_id"), F.col(tile_col).alias("tile"))
    return written(rows.mapInPandas(write, "doc_id long, file string, row long"), "tile_files")
