"""Terrain tiles from a folder of PNG files named ``zoom_x_y.png``."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dem import TILE

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by PNG colour type: grey, colour, palette, grey with alpha, colour with alpha.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunks(data: bytes) -> dict[bytes, bytes]:
    """The chunks' contents by name; those of one name follow each other."""
    found, at = {}, len(_SIGNATURE)
    while at + 8 <= len(data):
        (size,), name = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        found[name] = found.get(name, b"") + data[at + 8 : at + 8 + size]
        at += size + 12
    return found


def _plain(raw: np.ndarray, samples: int) -> np.ndarray:
    """Rows of bytes without their filters; raw: (rows, 1 + width * samples)."""
    out = np.zeros((len(raw), raw.shape[1] - 1), dtype=np.uint8)
    above = np.zeros(out.shape[1], dtype=np.uint8)
    for i, (kind, row) in enumerate(zip(raw[:, 0].tolist(), raw[:, 1:], strict=True)):
        if kind == 0:
            out[i] = row
        elif kind == 1:
            out[i] = np.cumsum(row.reshape(-1, samples), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[i] = row + above
        elif kind in (3, 4):
            pixels, up = row.reshape(-1, samples).astype(int).tolist(), above.reshape(-1, samples).astype(int).tolist()
            left, corner = [0] * samples, [0] * samples
            for p, b in zip(pixels, up, strict=True):
                for k in range(samples):
                    if kind == 3:
                        guess = (left[k] + b[k]) // 2
                    else:
                        near = left[k] + b[k] - corner[k]
                        guess = min((abs(near - left[k]), 0, left[k]), (abs(near - b[k]), 1, b[k]), (abs(near - corner[k]), 2, corner[k]))[2]
                    p[k] = (p[k] + guess) & 255
                left, corner = p, b
            out[i] = np.array(pixels, dtype=np.uint8).ravel()
        else:
            raise ValueError(f"unknown filter {kind}")
        above = out[i]
    return out


def decoded(data: bytes) -> np.ndarray | None:
    """The pixels of a PNG tile as opaque or transparent ARGB numbers, row by row; None unless it can be decoded and has
    the size of a tile.  Eight bits a sample and no interlacing, as terrain tiles have."""
    try:
        if not data.startswith(_SIGNATURE):
            return None
        chunks = _chunks(data)
        width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
        if (width, height) != (TILE, TILE) or depth != 8 or interlaced:
            return None
        samples = _SAMPLES[color]
        raw = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), dtype=np.uint8).reshape(height, 1 + width * samples)
        p = _plain(raw, samples).reshape(-1, samples).astype(np.uint32)
        if color == 3:
            p = np.frombuffer(chunks[b"PLTE"], dtype=np.uint8).reshape(-1, 3)[p[:, 0]].astype(np.uint32)
        alpha = p[:, -1] if color in (4, 6) else np.full(len(p), 255, dtype=np.uint32)
        red, green, blue = (p[:, 0],) * 3 if color in (0, 4) else p[:, :3].T
        return (alpha << 24 | red << 16 | green << 8 | blue).view(np.int32)
    except (KeyError, IndexError, ValueError, struct.error, zlib.error):
        return None


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _pixels(content: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else decoded(bytes(x)) for x in content])


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """dem_tiles (zoom, x, y, pixels) of a folder.  Files of other names, of another size or that cannot be decoded are
    left out, as if they were missing.  Nothing is fetched from elsewhere."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    name = r"(?:^|/)(\d{1,2})_(\d{1,9})_(\d{1,9})\.png$"
    part = lambda k: F.regexp_extract("path", name, k).cast("int")
    named = files.filter(F.col("path").rlike(name)).select(part(1).alias("zoom"), part(2).alias("x"), part(3).alias("y"), _pixels("content").alias("pixels"))
    return named.filter("pixels is not null")
