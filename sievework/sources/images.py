"""Headers and soundness of image files, read in Arrow batches.

Pillow does the decoding where it is installed. Without it PNG and BMP files
are decoded as far as it takes to know that every pixel is there, and of the
other formats the structure is followed to the end of the file.
"""

from __future__ import annotations

import io
import struct
import warnings
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = "width int, height int, format string"
CHECK = f"status string, message string, {HEADER}"
PNG = b"\x89PNG\r\n\x1a\n"


class Broken(ValueError):
    """The file can't be decoded."""


def _int(b: bytes, at: int, size: int, order: str = "big") -> int:
    if at + size > len(b):
        raise Broken("truncated")
    return int.from_bytes(b[at : at + size], order)


def _png(b: bytes, told: list[str]) -> tuple[int, int, str]:
    width, height = _int(b, 16, 4), _int(b, 20, 4)
    if b[12:16] != b"IHDR" or not width or not height:
        raise Broken("no image header")
    depth, colour, interlaced = _int(b, 24, 1), _int(b, 25, 1), _int(b, 28, 1)
    bits = depth * {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour, 0)
    if not bits:
        raise Broken("unknown colour type")
    inflate, raw, at, kind = zlib.decompressobj(), bytearray(), 8, b""
    while kind != b"IEND":
        size, kind = _int(b, at, 4), b[at + 4 : at + 8]
        stated = _int(b, at + 8 + size, 4)
        if zlib.crc32(b[at + 4 : at + 8 + size]) != stated:
            if kind[:1].isupper():
                raise Broken(f"bad checksum of {kind.decode('latin-1')}")
            told.append(f"bad checksum of {kind.decode('latin-1')}")
        if kind == b"IDAT":
            try:
                raw += inflate.decompress(b[at + 8 : at + 8 + size])
            except zlib.error as error:
                raise Broken("broken pixel data") from error
        at += 12 + size
    if at < len(b):
        told.append("data behind the end")
    # the passes of an interlaced image: first column, first row, steps
    passes = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if interlaced else [(0, 0, 1, 1)]
    left = 0
    for x, y, dx, dy in passes:
        columns, rows = -(-(width - x) // dx), -(-(height - y) // dy)
        row = 1 + -(-columns * bits // 8)
        if columns <= 0 or rows <= 0:
            continue
        if left + rows * row > len(raw):
            raise Broken("truncated")
        if any(f > 4 for f in raw[left : left + rows * row : row]):
            raise Broken("unknown row filter")
        left += rows * row
    return width, height, "PNG"


def _bmp(b: bytes, told: list[str]) -> tuple[int, int, str]:
    width, height = _int(b, 18, 4, "little"), abs(int.from_bytes(b[22:26], "little", signed=True))
    start, bits, packed = _int(b, 10, 4, "little"), _int(b, 28, 2, "little"), _int(b, 30, 4, "little")
    if not packed and start + -(-width * bits // 32) * 4 * height > len(b):
        raise Broken("truncated")
    if _int(b, 2, 4, "little") not in (0, len(b)):
        told.append("stated size differs")
    return width, height, "BMP"


def _jpeg(b: bytes, told: list[str]) -> tuple[int, int, str]:
    at, size, many = 2, None, False
    while True:
        if _int(b, at, 1) != 0xFF:
            raise Broken("no marker where one must be")
        kind = _int(b, at + 1, 1)
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD7:
            at += 1 if kind == 0xFF else 2
            continue
        if kind == 0xD9:
            break
        length = _int(b, at + 2, 2)
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            size = size or (_int(b, at + 7, 2), _int(b, at + 5, 2))
        many |= kind == 0xE2 and b[at + 4 : at + 8] == b"MPF\0"
        at += 2 + length
        if kind == 0xDA:
            # coded pixels run to the next marker that isn't a stuffed byte or a restart
            while True:
                at = b.find(b"\xff", at)
                if at < 0 or at + 1 >= len(b):
                    raise Broken("truncated")
                if b[at + 1] and not 0xD0 <= b[at + 1] <= 0xD7:
                    break
                at += 2
    if size is None:
        raise Broken("no image header")
    if at + 2 < len(b) and not many and b[at + 2 :].strip(b"\0"):
        told.append("data behind the end")
    return *size, "MPO" if many else "JPEG"


def _webp(b: bytes, told: list[str]) -> tuple[int, int, str]:
    if _int(b, 4, 4, "little") + 8 > len(b):
        raise Broken("truncated")
    kind = b[12:16]
    if kind == b"VP8X":
        return _int(b, 24, 3, "little") + 1, _int(b, 27, 3, "little") + 1, "WEBP"
    if kind == b"VP8L":
        both = _int(b, 21, 4, "little")
        return (both & 0x3FFF) + 1, (both >> 14 & 0x3FFF) + 1, "WEBP"
    if kind == b"VP8 ":
        return _int(b, 26, 2, "little") & 0x3FFF, _int(b, 28, 2, "little") & 0x3FFF, "WEBP"
    raise Broken("no image header")


def _tiff(b: bytes, told: list[str]) -> tuple[int, int, str]:
    order = "little" if b[:2] == b"II" else "big"
    at = _int(b, 4, 4, order)
    tags = {}
    for i in range(_int(b, at, 2, order)):
        entry = at + 2 + 12 * i
        tag, kind, n = _int(b, entry, 2, order), _int(b, entry + 2, 2, order), _int(b, entry + 4, 4, order)
        size = {1: 1, 3: 2, 4: 4}.get(kind)
        if size:
            place = entry + 8 if size * n <= 4 else _int(b, entry + 8, 4, order)
            tags[tag] = [_int(b, place + size * j, size, order) for j in range(n)]
    if not tags.get(256) or not tags.get(257):
        raise Broken("no image header")
    strips = zip(tags.get(273, tags.get(324, [])), tags.get(279, tags.get(325, [])), strict=False)
    if any(start + size > len(b) for start, size in strips):
        raise Broken("truncated")
    return tags[256][0], tags[257][0], "TIFF"


def _reader(b: bytes):
    if b[:8] == PNG:
        return _png
    if b[:2] == b"\xff\xd8":
        return _jpeg
    if b[:2] == b"BM":
        return _bmp
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        return _webp
    return _tiff if b[:4] in (b"II*\0", b"MM\0*") else None


def check(b: bytes | None) -> tuple[str, str, int | None, int | None, str | None]:
    """(status, message, width, height, format) of a file: ``valid``, ``warning`` (each told once) or ``corrupt``."""
    told: list[str] = []
    try:
        reader = _reader(b) if b else None
        if reader is None:
            raise Broken("no known format" if b else "no content")
        try:
            from PIL import Image
        except ImportError:
            width, height, kind = reader(b, told)
        else:
            with warnings.catch_warnings(record=True) as caught:
                warnings.simplefilter("always")
                Image.open(io.BytesIO(b)).verify()
                image = Image.open(io.BytesIO(b))
                image.load()
                (width, height), kind = image.size, image.format
            told += [str(w.message) for w in caught]
    except (OSError, SyntaxError, ValueError, struct.error) as error:
        return "corrupt", str(error), None, None, None
    return "warning" if told else "valid", " | ".join(dict.fromkeys(told)), width, height, kind


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({"width": "Int32", "height": "Int32"})


def image_check(content: Column) -> Column:
    """STRUCT(status, message, width, height, format) of file contents."""

    @F.pandas_udf(CHECK)
    def checked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _frame([check(None if b is None else bytes(b)) for b in batch], ["status", "message", "width", "height", "format"])

    return checked(content)


def _header(b: bytes | None) -> tuple[int | None, int | None, str | None]:
    if b and b[:8] == PNG:
        return (int.from_bytes(b[16:20], "big"), int.from_bytes(b[20:24], "big"), "PNG") if len(b) >= 24 else (None, None, None)
    if b and b[:2] == b"BM":
        return (int.from_bytes(b[18:22], "little"), abs(int.from_bytes(b[22:26], "little", signed=True)), "BMP") if len(b) >= 26 else (None, None, None)
    reader = _reader(b) if b else None
    if reader is _jpeg:
        return _jpeg_header(b)
    try:
        return reader(b, []) if reader else (None, None, None)
    except Broken:
        return None, None, None


def _jpeg_header(b: bytes) -> tuple[int | None, int | None, str | None]:
    """The size in the first frame; nothing behind it is read."""
    at, kind = 2, "JPEG"
    while at + 9 < len(b) and b[at] == 0xFF:
        mark = b[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(b[at + 7 : at + 9], "big"), int.from_bytes(b[at + 5 : at + 7], "big"), kind
        if mark == 0xE2 and b[at + 4 : at + 8] == b"MPF\0":
            kind = "MPO"
        at += 1 if mark == 0xFF else 2 if mark == 0x01 or 0xD0 <= mark <= 0xD7 else 2 + int.from_bytes(b[at + 2 : at + 4], "big")
    return None, None, None


def image_header(content: Column) -> Column:
    """STRUCT(width, height, format) from the bytes of a PNG, JPEG, MPO, BMP, WEBP or TIFF file; null fields for anything else."""

    @F.pandas_udf(HEADER)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _frame([_header(None if b is None else bytes(b)) for b in batch], ["width", "height", "format"])

    return read(content)
