"""Properties of image files from their bytes, without decoding pixels, and a hash of grey values."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROPERTIES = "format string, width int, height int, mode string, channels int, error string"
#: Colour types of PNG with their modes and channels, and the markers of JPEG frames and of markers without a length.
PNG_MODES = {0: ("L", 1), 2: ("RGB", 3), 3: ("P", 1), 4: ("LA", 2), 6: ("RGBA", 4)}
JPEG_FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
JPEG_MODES = {1: ("L", 1), 3: ("RGB", 3), 4: ("CMYK", 4)}
BARE_MARKERS = {0x01, *range(0xD0, 0xD8)}
PNG_START = b"\x89PNG\r\n\x1a\n"


def _failed(kind: str, error: str) -> dict:
    return {"format": kind, "width": None, "height": None, "mode": None, "channels": None, "error": error}


def png_properties(data: bytes) -> dict:
    """Every chunk is walked: its length must fit and its checksum be right, the first be the header, the last the end."""
    at, found = len(PNG_START), None
    while True:
        if at + 12 > len(data):
            return _failed("PNG", "truncated")
        size, name = struct.unpack(">I4s", data[at : at + 8])
        if at + 12 + size > len(data):
            return _failed("PNG", "truncated")
        if zlib.crc32(data[at + 4 : at + 8 + size]) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            return _failed("PNG", "checksum")
        if found is None:
            if name != b"IHDR" or size != 13:
                return _failed("PNG", "no header")
            width, height, depth, colour = struct.unpack(">IIBB", data[at + 8 : at + 18])
            if not width or not height or colour not in PNG_MODES:
                return _failed("PNG", "bad header")
            mode, channels = PNG_MODES[colour]
            mode = {(0, 1): "1", (0, 16): "I;16"}.get((colour, depth), mode)
            found = {"format": "PNG", "width": width, "height": height, "mode": mode, "channels": channels, "error": None}
        if name == b"IEND":
            return found
        at += 12 + size


def jpeg_properties(data: bytes) -> dict:
    """Segments are walked up to the frame header; the file must go on to an end marker."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return _failed("JPEG", "no marker")
        marker = data[at + 1]
        if marker == 0xFF:  # fill bytes
            at += 1
            continue
        if marker in BARE_MARKERS:
            at += 2
            continue
        if marker in (0xD9, 0xDA):
            return _failed("JPEG", "no header")
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if marker in JPEG_FRAMES:
            if size < 8 or at + 10 > len(data):
                return _failed("JPEG", "truncated")
            height, width, parts = struct.unpack(">HHB", data[at + 5 : at + 10])
            if not width or not height or parts not in JPEG_MODES:
                return _failed("JPEG", "bad header")
            if data.rfind(b"\xff\xd9", at + size) < 0:
                return _failed("JPEG", "truncated")
            mode, channels = JPEG_MODES[parts]
            return {"format": "JPEG", "width": width, "height": height, "mode": mode, "channels": channels, "error": None}
        at += 2 + size
    return _failed("JPEG", "truncated")


def properties(data: bytes | None) -> dict:
    """Format, size, mode and channels of a file, or the kind of error; never raises."""
    if not data:
        return _failed(None, "empty")
    if data.startswith(PNG_START):
        return png_properties(data)
    if data.startswith(b"\xff\xd8"):
        return jpeg_properties(data)
    return _failed(None, "unknown format")


def inspected(files: DataFrame, content: str = "content") -> DataFrame:
    """files plus PROPERTIES of each content. Columns of these names are replaced, others passed on; none may be named
    _found. A null or empty content is an error of its own; repeated rows are judged alike."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("mode", pa.string()), ("channels", pa.int32()), ("error", pa.string())])
        for batch in batches:
            yield pa.array([properties(x.as_py()) for x in batch], kind)

    names = [p.split()[0] for p in PROPERTIES.split(", ")]
    own = files.drop(*names).withColumn("_found", F.arrow_udf(run, PROPERTIES).asNondeterministic()(F.col(content)))
    return own.select("*", "_found.*").drop("_found")


def decode_problems(inspected: DataFrame, path: str = "path", modes: tuple[str, ...] = ("RGB",), least: int = 1) -> DataFrame:
    """(path, problem): files with an error, of another mode, or with a side under `least`."""
    problem = F.when(F.col("error").isNotNull(), F.col("error")).when(~F.col("mode").isin(*modes), F.concat(F.lit("mode "), "mode")).when(F.least("width", "height") < least, "too small")
    return inspected.select(path, problem.alias("problem")).where("problem IS NOT NULL")


def dct_hash(grey: Column | str, side: int = 32, keep: int = 8) -> Column:
    """The 64 bits, in hex, that tell which of the keep x keep lowest frequencies of a side x side grey array (rows one after
    the other) lie above their median: a hash that small changes of the picture leave nearly the same. Null where the
    array is null or has another size."""
    n = np.arange(side)
    basis = np.cos(np.pi * (2 * n[None, :] + 1) * n[:keep, None] / (2 * side))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list[str | None] = [None] * len(batch)
            good = [i for i, x in enumerate(batch) if x.is_valid and len(x) == side * side]
            if good:
                x = batch.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(-1, side, side)
                low = (basis @ x @ basis.T).reshape(len(good), -1)
                bits = np.packbits(low > np.median(low, axis=1, keepdims=True), axis=1)
                for i, b in zip(good, bits, strict=True):
                    out[i] = b.tobytes().hex()
            yield pa.array(out, pa.string())

    return F.arrow_udf(run, "string")((F.col(grey) if isinstance(grey, str) else grey).cast("array<double>"))
