"""Image files out and in; records without a readable image stay."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vernissage.sources.files import committed_folders, write_files

IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
# Fixed values of the file format: signature, and colour type per number of channels.
PNG_START = b"\x89PNG\r\n\x1a\n"
PNG_COLOUR = {1: 0, 3: 2, 4: 6}
# Content of a file for a row that is no image; Spark's scan leaves out files without any byte.
BROKEN = b"\0"


def png(height: int, width: int, channels: int, data: bytes) -> bytes:
    """An image row's levels as a PNG file; BROKEN for a row that is no image."""
    if channels not in PNG_COLOUR or height <= 0 or width <= 0 or len(data) != height * width * channels:
        return BROKEN
    levels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels > 1:
        levels = levels[:, :, [2, 1, 0, 3][:channels]]
    lines = np.zeros((height, 1 + width * channels), dtype=np.uint8)
    lines[:, 1:] = levels.reshape(height, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, PNG_COLOUR[channels], 0, 0, 0)
    return PNG_START + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def write_images(images: DataFrame, path: str, key: str = "id", mode: str = "overwrite") -> None:
    """One file `<key>.png` per image row; an unreadable image gives an unreadable file, a missing one none."""
    rows = images.filter("image is not null").select(
        F.concat(F.col(key).cast("string"), F.lit(".png")).alias("name"),
        *[F.col(f"image.{c}").alias(c) for c in ("height", "width", "nChannels", "data")],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True)
            content = [png(h or 0, w or 0, c or 0, data or b"") for h, w, c, data in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], names=["name", "content"])

    write_files(rows.mapInArrow(run, "name string, content binary"), path, mode)


def read_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, image): id is the file name without its extension; unreadable files have height -1."""
    raw = spark.read.format("image").option("dropInvalid", False).load(path)
    name = F.element_at(F.split("image.origin", "/"), -1)
    return raw.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("id"), "image")


def read_written_images(spark: SparkSession, path: str) -> DataFrame:
    """The committed files of `write_images`."""
    folders = committed_folders(path)
    return read_images(spark, folders) if folders else spark.createDataFrame([], f"id string, image {IMAGE}")


def with_image_features(ids: DataFrame, features: DataFrame, key: str = "id") -> DataFrame:
    """Every id; a missing or unreadable image gives a row of nulls."""
    return ids.select(key).join(features, key, "left")
