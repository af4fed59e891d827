"""Image files as tables: PNG and TIFF by own decoders, the rest by Spark's image source.

Spark's reader cuts 16-bit PNG to their low byte, so label images go through
``binaryFile`` and the decoders here.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that count as images.
EXTENSIONS = ("png", "tif", "tiff", "jpg", "jpeg")


def stem(path: Column) -> Column:
    """A file's name in lower case without its folders and image extension."""
    return F.regexp_replace(F.lower(F.regexp_extract(path, r"([^/]*)$", 1)), r"\.(" + "|".join(EXTENSIONS) + ")$", "")


def luminance(red: Column, green: Column, blue: Column) -> Column:
    return 0.299 * red + 0.587 * green + 0.114 * blue


def decode_png(data: bytes) -> np.ndarray:
    """Pixels as (h, w) or (h, w, channels), 8 or 16 bit; palettes are resolved, interlaced files aren't read."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, palette = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        at += size + 12
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    if interlace or (depth < 8 and channels > 1):
        raise ValueError("this kind of PNG isn't read")
    width = (w * channels * depth + 7) // 8
    step = max(1, channels * depth // 8)
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, width + 1)
    out = np.zeros((h, width), dtype=np.uint8)
    above = np.zeros(width, dtype=np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].copy()
        if kind == 2:
            line = line + above
        elif kind == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step], dtype=np.uint64).astype(np.uint8)
        elif kind in (3, 4):
            cur, up = line.tolist(), above.tolist()
            for x in range(width):
                a = cur[x - step] if x >= step else 0
                if kind == 3:
                    cur[x] = (cur[x] + (a + up[x]) // 2) & 255
                else:
                    c = up[x - step] if x >= step else 0
                    pa, pb, pc = abs(up[x] - c), abs(a - c), abs(a + up[x] - 2 * c)
                    cur[x] = (cur[x] + (a if pa <= pb and pa <= pc else up[x] if pb <= pc else c)) & 255
            line = np.array(cur, dtype=np.uint8)
        out[y] = above = line
    if depth == 16:
        px = out.view(">u2").astype(np.uint16)
    elif depth == 8:
        px = out
    else:
        px = np.unpackbits(out, axis=1).reshape(h, -1, depth)
        px = (px * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)[:, :w]
        if color == 0:
            px = (px * (255 // ((1 << depth) - 1))).astype(np.uint8)
    px = px.reshape(h, w, channels) if channels > 1 else px.reshape(h, w)
    return palette[px] if color == 3 and palette is not None else px


def encode_png(px: np.ndarray) -> bytes:
    """An 8- or 16-bit gray PNG."""
    px = np.asarray(px)
    deep = px.dtype != np.uint8
    body = px.astype(">u2").view(np.uint8).reshape(px.shape[0], -1) if deep else px
    lines = np.hstack([np.zeros((px.shape[0], 1), np.uint8), body]).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", px.shape[1], px.shape[0], 16 if deep else 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def decode_tiff(data: bytes) -> np.ndarray:
    """The first image of a strip-organised TIFF, plain, deflated or PackBits, of whole bytes a sample."""
    e = {b"II": "<", b"MM": ">"}.get(data[:2])
    if e is None:
        raise ValueError("not a TIFF")
    at = struct.unpack(e + "I", data[4:8])[0]
    tags: dict[int, list[int]] = {}
    for i in range(struct.unpack(e + "H", data[at : at + 2])[0]):
        entry = at + 2 + 12 * i
        tag, kind, n = struct.unpack(e + "HHI", data[entry : entry + 8])
        code, size = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, ("B", 0))
        if not size:
            continue
        where = entry + 8 if n * size <= 4 else struct.unpack(e + "I", data[entry + 8 : entry + 12])[0]
        tags[tag] = list(struct.unpack(f"{e}{n}{code}", data[where : where + n * size]))
    w, h = tags[256][0], tags[257][0]
    depth, samples, packing = tags.get(258, [1])[0], tags.get(277, [1])[0], tags.get(259, [1])[0]
    strips = [data[o : o + n] for o, n in zip(tags[273], tags[279], strict=True)]
    if packing in (8, 32946):
        strips = [zlib.decompress(s) for s in strips]
    elif packing == 32773:
        strips = [_packbits(s) for s in strips]
    elif packing != 1:
        raise ValueError(f"TIFF compression {packing} isn't read")
    if depth not in (8, 16, 32):
        raise ValueError(f"TIFF of {depth} bits isn't read")
    kind = {8: "u1", 16: "u2", 32: "f4" if tags.get(339, [1])[0] == 3 else "u4"}[depth]
    px = np.frombuffer(b"".join(strips), e + kind)[: h * w * samples].astype(kind)
    px = px.reshape(h, w, samples) if samples > 1 else px.reshape(h, w)
    return px.max() - px if tags.get(262, [1])[0] == 0 and px.size else px


def _packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + n + 2]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def to_gray(px: np.ndarray) -> np.ndarray:
    """Luminance as doubles; alpha is ignored."""
    if px.ndim == 2:
        return px.astype(np.float64)
    if px.shape[2] < 3:
        return px[:, :, 0].astype(np.float64)
    return px[:, :, :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def decode(data: bytes) -> np.ndarray:
    return decode_png(data) if data[:4] == b"\x89PNG" else decode_tiff(data)


def scan(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, source_id, modificationTime, length, content) of a folder's image files, whatever the case of their extensions."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return r.filter(F.lower("path").rlike(r"\.(" + "|".join(EXTENSIONS) + ")$")).withColumn("source_id", stem(F.col("path")))


def read_pixels(files: DataFrame, kind: str = "gray") -> DataFrame:
    """(source_id, r, c, v) of files from :func:`scan`: luminance, or with ``labels`` the stored numbers. Files that don't decode are left out of neither: they raise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for source, content in zip(b["source_id"], b["content"], strict=True):
                px = decode(bytes(content))
                px = to_gray(px) if kind == "gray" else (px if px.ndim == 2 else px[:, :, 0]).astype(np.float64)
                r, c = np.indices(px.shape)
                yield pd.DataFrame({"source_id": source, "r": r.ravel(), "c": c.ravel(), "v": px.ravel()})

    return files.select("source_id", "content").mapInPandas(run, "source_id string, r int, c int, v double")


def read_with_spark(spark: SparkSession, folder: str) -> DataFrame:
    """(source_id, r, c, v): luminance of 8-bit images of any format that Spark's image source knows, JPEG included."""
    i = spark.read.format("image").option("dropInvalid", "true").load(folder).select(stem(F.col("image.origin")).alias("source_id"), "image.width", "image.nChannels", "image.data")
    n = F.col("nChannels")
    byte = lambda k: F.conv(F.hex(F.substring("data", k + 1, 1)), 16, 10).cast("double")
    px = i.select("*", F.explode(F.sequence(F.lit(0), (F.length("data") / n - 1).cast("int"))).alias("i"))
    # Channels are stored blue, green, red.
    v = F.when(n == 1, byte(F.col("i"))).otherwise(luminance(byte(F.col("i") * n + 2), byte(F.col("i") * n + 1), byte(F.col("i") * n)))
    return px.select("source_id", F.floor(F.col("i") / F.col("width")).cast("int").alias("r"), (F.col("i") % F.col("width")).cast("int").alias("c"), v.alias("v"))


def write_png(px: DataFrame, folder: str) -> DataFrame:
    """Write each image as an 8-bit gray PNG into ``folder``, one task an image; returns (source_id, path).

    The folder has to be one that all executors share. Values are cut to
    0..255 and to whole numbers.
    """
    kind = px.schema["source_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import os

        a = pdf.pivot(index="r", columns="c", values="v").to_numpy()
        path = os.path.join(folder, f"{pdf['source_id'].iloc[0]}.png")
        os.makedirs(folder, exist_ok=True)
        part = f"{path}.{os.getpid()}.part"
        with open(part, "wb") as f:
            f.write(encode_png(np.clip(a, 0, 255).astype(np.uint8)))
        os.replace(part, path)  # a task that is run again leaves the same file
        return pd.DataFrame({"source_id": [pdf["source_id"].iloc[0]], "path": [path]})

    return px.groupBy("source_id").applyInPandas(run, f"source_id {kind}, path string")


def sample_files(files: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n files without replacement, by the order of a seeded hash."""
    from ..functions import expr

    return files.orderBy(expr.uniform(seed, F.col("source_id")), "source_id").limit(n)
