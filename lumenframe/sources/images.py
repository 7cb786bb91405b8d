"""Image files to tables of pixels and back, and curves, points and matches as text or Parquet.

Reading uses Spark's image source (JPEG, PNG and other formats decoded by the JVM, bytes in BGR order, rows first).
Writing encodes PNG in the tasks and stores the bytes as rows; any Spark sink takes them from there.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIXEL_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("image_id", T.LongType()), ("x", T.IntegerType()), ("y", T.IntegerType()), ("r", T.IntegerType()), ("g", T.IntegerType()), ("b", T.IntegerType()))])
CURVE_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("curve_id", T.LongType()), ("pos", T.IntegerType()), ("x", T.DoubleType()), ("y", T.DoubleType()))])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """origin, image_id (hash of the origin), width, height, n_channels, data; files that can't be decoded are left out."""
    df = spark.read.format("image").option("dropInvalid", True).load(path)
    return df.select("image.origin", F.xxhash64("image.origin").alias("image_id"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("data"))


def to_pixels(images: DataFrame) -> DataFrame:
    """image_id, x, y, r, g, b of images of 1, 3 or 4 channels, a few rows of pixels at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["n_channels"])
                b, g, r = (a[:, :, k if row["n_channels"] > 1 else 0] for k in range(3))
                step = max(1, (1 << 20) // max(1, row["width"]))
                for y0 in range(0, row["height"], step):
                    y, x = np.mgrid[y0 : min(row["height"], y0 + step), 0 : row["width"]]
                    part = slice(y0, y0 + step)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(x.size, row["image_id"])), *[pa.array(c.reshape(-1).astype(np.int32)) for c in (x, y, r[part], g[part], b[part])]], names=["image_id", "x", "y", "r", "g", "b"])

    return images.select("image_id", "width", "height", "n_channels", "data").mapInArrow(run, PIXEL_SCHEMA)


def grey_value(mode: str = "mean"):
    """Grey value of r, g, b: 'mean' (truncated), 'luma' (rounded), 'r', 'g', 'b', or 'binary' (0 where all channels are 0)."""
    forms = {"mean": "CAST(floor((r + g + b) / 3) AS INT)", "luma": "CAST(floor(0.2126D * r + 0.7152D * g + 0.0722D * b + 0.5D) AS INT)", "r": "r", "g": "g", "b": "b", "binary": "CASE WHEN r + g + b = 0 THEN 0 ELSE 1 END"}
    return F.expr(forms[mode])


def grey(pixels: DataFrame, mode: str = "mean") -> DataFrame:
    """Images in grey, see grey_value()."""
    return pixels.select("image_id", "x", "y", grey_value(mode).alias("v"))


def png(a: np.ndarray) -> bytes:
    """A PNG file of an (h, w) or (h, w, 3) array of bytes."""
    h, w = a.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(a, np.uint8).reshape(h, -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def stretched(grey: DataFrame) -> DataFrame:
    """Grey values (image_id, x, y, v) stretched over 0..255 image by image, truncated; 0 where an image has one value only."""
    bounds = grey.groupBy("image_id").agg(F.min("v").alias("_low"), F.max("v").alias("_high"))
    new = F.when(F.col("_high") == F.col("_low"), 0).otherwise(F.floor((F.col("v") - F.col("_low")) * 255.0 / (F.col("_high") - F.col("_low"))).cast("int"))
    return grey.join(bounds, "image_id").select("image_id", "x", "y", new.alias("v"))


def decoded(data: bytes) -> np.ndarray:
    """(h, w, channels) bytes of a PNG file of 8-bit grey or colour, with or without transparency, not interlaced."""
    w, h, depth, kind, _, _, interlaced = struct.unpack_from(">IIBBBBB", data, 16)
    if depth != 8 or kind not in (0, 2, 4, 6) or interlaced:
        raise ValueError("not a PNG file of 8-bit grey or colour")
    body, at = b"", 8
    while at < len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body += data[at + 8 : at + 8 + size] if name == b"IDAT" else b""
        at += size + 12
    n = {0: 1, 2: 3, 4: 2, 6: 4}[kind]
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w * n + 1)
    out = np.zeros((h + 1, w + 1, n), np.uint8)  # a row above and a column before, of zeros
    for y in range(h):
        filtered, line, above = lines[y, 0], lines[y, 1:].reshape(w, n), out[y]
        if filtered == 0:
            out[y + 1, 1:] = line
        elif filtered == 1:
            out[y + 1, 1:] = np.cumsum(line, axis=0, dtype=np.uint8)
        elif filtered == 2:
            out[y + 1, 1:] = line + above[1:]
        else:
            for x in range(w):
                a, b, c = out[y + 1, x].astype(int), above[x + 1].astype(int), above[x].astype(int)
                if filtered == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
                out[y + 1, x + 1] = (line[x] + guess) & 255
    return out[1:, 1:]


def from_png(files: DataFrame, data: str = "png") -> DataFrame:
    """image_id, x, y, r, g, b of PNG files (image_id and the bytes), for rows of files as any source gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = decoded(raw)
                y, x = np.mgrid[0 : a.shape[0], 0 : a.shape[1]]
                colours = [a[:, :, k if a.shape[2] > 2 else 0] for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(x.size, image_id)), *[pa.array(c.reshape(-1).astype(np.int32)) for c in (x, y, *colours)]], names=["image_id", "x", "y", "r", "g", "b"])

    return files.select("image_id", data).mapInArrow(run, PIXEL_SCHEMA)


def to_png(pixels: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """image_id, width, height, png of each raster; one channel gives a grey image. Values are clipped to 0..255."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        a = np.zeros((h, w, len(channels)))
        a[pdf["y"], pdf["x"]] = pdf[list(channels)]
        a = np.clip(a, 0, 255).astype(np.uint8)
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "width": [w], "height": [h], "png": [png(a if len(channels) > 1 else a[:, :, 0])]})

    return pixels.select("image_id", "x", "y", *channels).groupBy("image_id").applyInPandas(run, "image_id long, width int, height int, png binary")


def overlay(pixels: DataFrame, marks: DataFrame, half: int = 0) -> DataFrame:
    """Pixels with marks (image_id, x, y, r, g, b) drawn over them as squares of half-width `half`; the largest colour wins a tie."""
    step = F.sequence(F.lit(-half), F.lit(half))
    drawn = marks.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step)).select("image_id", (F.col("x") + F.col("_dx")).alias("x"), (F.col("y") + F.col("_dy")).alias("y"), F.struct("r", "g", "b").alias("c"))
    top = drawn.groupBy("image_id", "x", "y").agg(F.max("c").alias("c"))
    return pixels.join(top, ["image_id", "x", "y"], "left").select("image_id", "x", "y", *[F.coalesce(F.col(f"c.{k}"), F.col(k)).alias(k) for k in "rgb"])


def palette(group: str) -> list:
    """Colours by group number: six alternating hues."""
    hues = [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (0, 255, 255), (255, 0, 255)]
    return [F.array(*[F.lit(h[k]) for h in hues])[F.pmod(F.col(group), F.lit(len(hues))).cast("int")].alias(c) for k, c in enumerate("rgb")]


def lines(segments: DataFrame, dash: int = 0) -> DataFrame:
    """Pixels of straight segments (image_id, line_id, x0, y0, x1, y1): one per step of the longer axis, rounded half up;
    with dash, runs of so many steps by turns drawn and left out."""
    n = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    s = segments.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), n)))
    at = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * F.col("_k") / F.greatest(F.col("_n"), F.lit(1)) + 0.5).cast("int")
    drawn = s.where(F.floor(F.col("_k") / dash) % 2 == 0) if dash else s
    return drawn.select("image_id", "line_id", at("x0", "x1").alias("x"), at("y0", "y1").alias("y")).distinct()


def curves_of(texts: DataFrame, sep: str = ",") -> DataFrame:
    """origin, pos, x, y from whole files (origin, value) of `x sep y` lines; pos counts the lines that have numbers."""
    number = r"\s*([-+0-9.eE]+)\s*"
    found = F.regexp_extract_all("value", F.lit(f"(?m)^{number}[{sep}]{number}$"), F.lit(0))
    each = texts.select("origin", F.posexplode(found).alias("pos", "line"))
    part = lambda k: F.trim(F.split("line", f"[{sep}]")[k]).cast("double")
    return each.select("origin", "pos", part(0).alias("x"), part(1).alias("y"))


def read_curves(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Curves from text files, one curve a file: origin, pos, x, y."""
    return curves_of(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("origin"), "value"), sep)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Run-length segmentations: lines of four integers after the header (segment, row, first and last column)."""
    text = spark.read.text(path).select(F.input_file_name().alias("origin"), F.regexp_extract_all("value", F.lit(r"^(\d+) (\d+) (\d+) (\d+)$"), F.lit(0)).alias("m"), F.split("value", " ").alias("p"))
    return text.where(F.size("m") == 1).select("origin", *[F.col("p")[k].cast("int").alias(n) for k, n in enumerate(("segment", "row", "col_start", "col_end"))])
