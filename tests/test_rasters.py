"""Images read from files, against the arrays that they were written from."""

import struct
import zlib

import numpy as np
import pytest

from quern.sources import manifests


def write_png(path, pixels):
    h, w = pixels.shape[:2]
    kind = {1: 0, 3: 2}[1 if pixels.ndim == 2 else pixels.shape[2]]
    lines = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b""))


def test_images_come_back_as_grey_cells(spark, tmp_path):
    rng = np.random.default_rng(1)
    grey, colour = rng.integers(0, 256, (5, 9), dtype=np.uint8), rng.integers(0, 256, (7, 4, 3), dtype=np.uint8)
    colour[0, 0] = 255
    write_png(tmp_path / "a.png", grey)
    write_png(tmp_path / "b.png", colour)
    cells, sizes = manifests.raster_cells(manifests.read_rasters(spark, str(tmp_path)))
    rgb = colour.astype(int)
    want = {"a.png": grey.astype(int), "b.png": (rgb[..., 0] * 19595 + rgb[..., 1] * 38470 + rgb[..., 2] * 7471 + 32768) >> 16}
    got = {k: np.full(m.shape, np.nan) for k, m in want.items()}
    for r in cells.collect():
        got[r.image.rsplit("/", 1)[-1]][r.y, r.x] = r.value
    for k, m in want.items():
        assert got[k] == pytest.approx(m / 255.0)
    assert {(r.image.rsplit("/", 1)[-1], r.height, r.width) for r in sizes.collect()} == {("a.png", 5, 9), ("b.png", 7, 4)}


def test_a_file_that_is_no_image_raises(spark, tmp_path):
    (tmp_path / "c.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="not an image"):
        manifests.read_rasters(spark, str(tmp_path)).collect()
