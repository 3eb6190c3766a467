from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions.fingerprint import shrink
from sievework.sources import images, readers

from .test_sources import png

try:
    import PIL
except ImportError:
    PIL = None


def chunk(kind: bytes, body: bytes, crc: int | None = None) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body) if crc is None else crc)


def interlaced(w: int, h: int) -> bytes:
    rows = b"".join(b"\0" * (1 + -(-(w - x) // dx)) * -(-(h - y) // dy) for x, y, dx, dy in [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if w > x and h > y)
    return images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 1)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def bmp(w: int, h: int) -> bytes:
    body = bytes(-(-w * 24 // 32) * 4 * h)
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, -h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def jpeg(extra: bytes = b"", end: bytes = b"\xff\xd9") -> bytes:
    frame = b"\xff\xc0\x00\x0b\x08\x00\x07\x00\x09\x01\x01\x11\x00"
    return b"\xff\xd8" + extra + frame + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + b"\x12\xff\x00\x34\xff\xd0\x56" + end


def tiff(order: str, size: int) -> bytes:
    mark = b"II*\0" if order == "<" else b"MM\0*"
    entries = [(256, 3, 1, 6), (257, 4, 1, 4), (273, 4, 1, 100), (279, 4, 1, size)]
    body = b"".join(struct.pack(order + "HHI", t, k, n) + (struct.pack(order + "HH", v, 0) if k == 3 else struct.pack(order + "I", v)) for t, k, n, v in entries)
    return (mark + struct.pack(order + "I", 8) + struct.pack(order + "H", len(entries)) + body).ljust(124, b"\0")


WEBP = b"RIFF" + struct.pack("<I", 30) + b"WEBPVP8X" + struct.pack("<I", 10) + b"\0\0\0\0" + (11).to_bytes(3, "little") + (6).to_bytes(3, "little") + bytes(8)
MPF = b"\xff\xe2\x00\x06MPF\0"
SOUND = {
    "png": (png(3, 5), (3, 5, "PNG")), "interlaced": (interlaced(13, 9), (13, 9, "PNG")), "tiny": (interlaced(1, 1), (1, 1, "PNG")), "bmp": (bmp(5, 4), (5, 4, "BMP")),
    "jpeg": (jpeg(), (9, 7, "JPEG")), "mpo": (jpeg(MPF, b"\xff\xd9\xff\xd8 another image"), (9, 7, "MPO")), "webp": (WEBP, (12, 7, "WEBP")), "tif": (tiff("<", 24), (6, 4, "TIFF")), "tiff": (tiff(">", 24), (6, 4, "TIFF")),
}


@pytest.mark.skipif(PIL is not None, reason="decoded by Pillow")
@pytest.mark.parametrize("name", SOUND)
def test_states(name):
    data, size = SOUND[name]
    assert images.check(data) == ("valid", "", *size)
    assert images.check(data[: len(data) - (9 if name != "mpo" else 18)])[0] == "corrupt"
    assert all(images.check(data[:n])[0] in ("corrupt", "valid") for n in range(len(data)))


@pytest.mark.skipif(PIL is not None, reason="decoded by Pillow")
def test_warnings_and_damage():
    plain = png(3, 5)
    assert images.check(plain + b"x") == ("warning", "data behind the end", 3, 5, "PNG")
    note = chunk(b"tEXt", b"k\0v", 1)
    assert images.check(plain[:33] + note + note + plain[33:]) == ("warning", "bad checksum of tEXt", 3, 5, "PNG")
    assert images.check(plain[:45] + bytes([plain[45] ^ 1]) + plain[46:])[:2] == ("corrupt", "bad checksum of IDAT")
    assert images.check(jpeg() + b"tail")[0] == "warning" and images.check(jpeg() + b"\0\0")[0] == "valid"
    assert [images.check(b)[:2] for b in (None, b"", b"GIF89a", b"II*\0")] == [("corrupt", "no content")] * 2 + [("corrupt", "no known format"), ("corrupt", "truncated")]


@pytest.mark.skipif(PIL is not None, reason="decoded by Pillow")
def test_validated_images(spark, tmp_path):
    for name, (data, _) in SOUND.items():
        (tmp_path / f"{name}.{'png' if name in ('interlaced', 'tiny') else name}").write_bytes(data)
    (tmp_path / "cut.jpg").write_bytes(jpeg(end=b""))
    (tmp_path / "odd.bmp").write_bytes(bmp(2, 2) + b"\0")
    got = {r["path"].rsplit("/", 1)[1]: r for r in readers.validated_images(spark, str(tmp_path)).collect()}
    assert len(got) == len(SOUND) + 2
    assert got["cut.jpg"]["status"] == "corrupt" and (got["odd.bmp"]["status"], got["odd.bmp"]["message"]) == ("warning", "stated size differs")
    heads = readers.scan_images(spark, str(tmp_path)).select("path", readers.image_header(F.col("content")).alias("h")).select("path", "h.*").collect()
    assert {(r["width"], r["height"], r["format"]) for r in heads} >= {size for _, size in SOUND.values()}


def test_shrink_is_lanczos():
    flat = shrink(np.full((50, 70), 93))
    assert flat.shape == (32, 32) and (flat == 93).all()
    same = np.arange(1024).reshape(32, 32) % 251
    assert (shrink(same) == same).all()
    # by hand: every output pixel of a wider image, pixel by pixel
    wide = np.random.default_rng(3).integers(0, 256, (32, 80))
    sinc = lambda x: np.sinc(x) * np.sinc(x / 3) if abs(x) < 3 else 0.0
    for i in range(32):
        w = [sinc((x + 0.5 - (i + 0.5) * 2.5) / 2.5) for x in range(80)]
        want = np.clip(np.floor(wide @ np.array(w) / sum(w) + 0.5), 0, 255)
        assert (shrink(wide)[:, i] == want).all()
