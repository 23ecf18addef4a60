"""Frames of image files as packed rows: ``frame``, ``shape``, ``dtype``, ``data``."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, frame bigint, shape array<int>, dtype string, data binary"


def decode(content: bytes) -> list[np.ndarray]:
    """The images of a file: NumPy, binary PGM of 8 or 16 bits, PNG, or TIFF with its pages.

    Images with colours become grey by their luminance; transparency is left out.
    """
    if content[:6] == b"\x93NUMPY":
        return [np.load(io.BytesIO(content), allow_pickle=False)]
    if content[:2] == b"P5":
        return [_pgm(content)]
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return [_png(content)]
    if content[:4] in (b"II*\0", b"MM\0*"):
        return list(_tiff(content))
    raise ValueError("neither NumPy nor a PGM, PNG or TIFF image")


def grey(img: np.ndarray) -> np.ndarray:
    """An image (y, x, channels) of one to four channels as (y, x), in its own type."""
    channels = img.shape[2]
    if channels < 3:
        return np.ascontiguousarray(img[..., 0])
    # fixed values: luminance of red, green and blue
    v = img[..., :3] @ np.array([0.2125, 0.7154, 0.0721])
    return v.astype(img.dtype) if np.issubdtype(img.dtype, np.floating) else np.rint(v).astype(img.dtype)


def _pgm(content: bytes) -> np.ndarray:
    words, at = [], 2
    while len(words) < 3:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
            continue
        end = at
        while not content[end : end + 1].isspace():
            end += 1
        words.append(int(content[at:end]))
        at = end
    w, h, top = words
    kind = np.dtype(np.uint8) if top < 256 else np.dtype(">u2")
    img = np.frombuffer(content, kind, w * h, at + 1).reshape(h, w)
    return img.astype(np.uint8 if top < 256 else np.uint16)


def _png(content: bytes) -> np.ndarray:
    """8 or 16 bits, grey, colour or palette, not interlaced."""
    at, body, palette, head = 8, b"", None, None
    while at < len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        data = content[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += data
    w, h, bits, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if interlaced or bits not in (8, 16):
        raise ValueError("PNG images must have 8 or 16 bits and no interlacing")
    step = channels * bits // 8
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h + 1, w + 1, step), dtype=np.uint8)  # a line above and a pixel to the left of zeros
    for y in range(h):
        rule, line, up = lines[y, 0], lines[y, 1:].reshape(w, step), out[y, 1:]
        if rule == 0:
            out[y + 1, 1:] = line
        elif rule == 1:
            out[y + 1, 1:] = np.cumsum(line, axis=0, dtype=np.uint8)
        elif rule == 2:
            out[y + 1, 1:] = line + up
        else:
            _unfilter(int(rule), line.tolist(), out[y].tolist(), out[y + 1])
    img = out[1:, 1:]
    img = np.ascontiguousarray(img).view(">u2").astype(np.uint16) if bits == 16 else img
    img = img.reshape(h, w, channels)
    return grey(palette[img[..., 0]]) if colour == 3 else grey(img)


def _unfilter(rule: int, line: list, above: list, out: np.ndarray) -> None:
    """A line filtered by the mean of left and upper neighbour (3) or by the nearest of three to their gradient (4)."""
    step = len(above[0])
    done = [[0] * step]
    for x, values in enumerate(line):
        pixel = []
        for c in range(step):
            left, up, corner = done[-1][c], above[x + 1][c], above[x][c]
            if rule == 3:
                guess = (left + up) // 2
            else:
                # of equals left comes before up, up before the corner
                guess = min((left, up, corner), key=lambda v, p=left + up - corner: abs(p - v))
            pixel.append((values[c] + guess) & 255)
        done.append(pixel)
    out[:] = done


def _tiff(content: bytes) -> Iterator[np.ndarray]:
    """Pages in strips, uncompressed or deflated, of whole, signed or floating numbers."""
    order = "<" if content[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", content, 4)[0]
    kinds = {1: "B", 3: "H", 4: "I", 16: "Q"}
    while at:
        count = struct.unpack_from(order + "H", content, at)[0]
        tags: dict[int, tuple] = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", content, at + 2 + 12 * k)
            if kind in kinds:
                form = f"{order}{n}{kinds[kind]}"
                place = at + 10 + 12 * k
                if struct.calcsize(form) > 4:
                    place = struct.unpack_from(order + "I", content, place)[0]
                tags[tag] = struct.unpack_from(form, content, place)
        at = struct.unpack_from(order + "I", content, at + 2 + 12 * count)[0]
        get = lambda tag, default=None, tags=tags: tags.get(tag, (default,))[0]
        # fixed values: the format's tags for size, bits, compression, samples, strips and number kind
        w, h, bits, packed, samples = get(256), get(257), get(258, 1), get(259, 1), get(277, 1)
        if bits not in (8, 16, 32, 64) or packed not in (1, 8, 32946) or 273 not in tags or get(284, 1) != 1 or get(317, 1) != 1:
            raise ValueError("TIFF pages must be in strips of 8 to 64 bits, uncompressed or deflated")
        number = {1: "u", 2: "i", 3: "f"}[get(339, 1)]
        strips = [content[o : o + n] for o, n in zip(tags[273], tags[279])]
        data = b"".join(strips if packed == 1 else map(zlib.decompress, strips))
        img = np.frombuffer(data, np.dtype(f"{order}{number}{bits // 8}"), w * h * samples).reshape(h, w, samples)
        yield grey(img.astype(img.dtype.newbyteorder("=")))


def read_frames(spark: SparkSession, path: str, pattern: str = "*", number: str = r"(\d+)(?!.*\d)") -> DataFrame:
    """Image files of a folder as packed frames; the frame number is the last number in the file's name.

    The pages of a TIFF file are consecutive frames from that number on. Files that can't be decoded raise an error.
    A NumPy file with one dimension more than an image (three, and a first axis unlike a volume's) isn't split: each
    file is one frame of two or three dimensions. Splits follow the file sizes, so many small frames share a task.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    files = files.withColumn("frame", F.regexp_extract(F.element_at(F.split("path", "/"), -1), number, 1))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for r in pdf.itertuples(index=False):
                for k, img in enumerate(decode(r.content)):
                    rows.append((r.path, (int(r.frame) if r.frame else 0) + k, list(img.shape), str(img.dtype), np.ascontiguousarray(img).tobytes()))
            yield pd.DataFrame(rows, columns=["path", "frame", "shape", "dtype", "data"])

    return files.select("path", "frame", "content").mapInPandas(run, SCHEMA)


def pixel_table(frames: DataFrame, keys=("frame",)) -> DataFrame:
    """Packed two-dimensional frames as rows (keys, y, x, v)."""
    keys = list(keys)
    kinds = dict(frames.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "y bigint, x bigint, v double"])

    def run(parts):
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                img = np.frombuffer(r.data, dtype=r.dtype).reshape(tuple(r.shape))
                y, x = np.indices(img.shape)
                yield pd.DataFrame({k: getattr(r, k) for k in keys} | {"y": y.ravel(), "x": x.ravel(), "v": img.ravel().astype(float)})

    return frames.select(*keys, "shape", "dtype", "data").mapInPandas(run, schema)
