import base64
import json
import struct
import zlib

import numpy as np
import pytest

from lodestar.functions import image as im
from lodestar.sources import catalog as cat
from lodestar.sources import images


def test_resize_and_crop():
    assert im.resize(np.array([[0, 0.2], [0.4, 1]], np.float32), 1, 1)[0, 0] == pytest.approx(0.4)
    grid = np.arange(16, dtype=np.float32).reshape(4, 4)
    assert im.resize(grid, 2, 2).ravel().tolist() == [2.5, 4.5, 10.5, 12.5]
    assert im.resize(np.array([[1, 2, 3, 4, 5]], np.float32), 3, 1).ravel().tolist() == [1, 2.5, 4.5]
    assert im.crop(grid, 0.5, 0.5, 0.5, 0.5).ravel().tolist() == [10, 11, 14, 15]
    with pytest.raises(ValueError):
        im.crop(grid, 0.9, 0, 0.5, 0.5)
    with pytest.raises(ValueError):
        im.inset(grid, 0.4)
    assert im.inset(grid, 0) is grid and len(im.windows(np.random.rand(50, 50))) == 10


def test_features_by_hand():
    rng = np.random.default_rng(1)
    img = rng.random((60, 70)).astype(np.float32)
    p, d, vec, bp = im.features(img)
    assert bin(p & (2**64 - 1)).count("1") == 32 and not p & 1 and len(vec) == len(bp) == 256
    small = im.resize(img, 32, 32).astype(float)
    c = [sum(small[y, x] * np.cos((2 * x + 1) * u * np.pi / 64) * np.cos((2 * y + 1) * v * np.pi / 64) for y in range(32) for x in range(32)) for v in range(8) for u in range(8)]
    cut = sum(sorted(c[1:])[30:32]) / 2
    assert p & (2**64 - 1) == sum(1 << i for i in range(1, 64) if c[i] > cut)
    flat = im.bandpass(np.full((16, 16), 0.5, np.float32))
    assert set(flat) == {128}


def scene():
    rng = np.random.default_rng(2)
    out = np.full((420, 480), 0.1, np.float32)
    quad = np.array([[40, 30], [430, 70], [420, 350], [30, 390]], float)
    y, x = np.mgrid[0:420, 0:480]
    inside = np.ones(out.shape, bool)
    for a, b in zip(quad, np.roll(quad, -1, 0), strict=True):
        inside &= (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0
    out[inside] = 0.55 + 0.45 * rng.random(inside.sum())
    return out, quad


def test_quad_and_rectify():
    img, quad = scene()
    found = im.detect_quad(img)
    assert abs(found[0] - quad[0]).max() < 0.06 * 480 and abs(found[2] - quad[2]).max() < 0.06 * 480
    assert im.try_rectify(img).shape == (380, 439)
    assert im.detect_quad(np.full((140, 160), 0.05, np.float32)) is None
    pic = np.random.default_rng(3).random((40, 50)).astype(np.float32)
    same = im.rectify(pic, np.array([[0, 0], [50, 0], [50, 40], [0, 40]], float), 50, 40)
    assert abs(same[:-1, :-1] - pic[:-1, :-1]).max() < 0.02
    with pytest.raises(ValueError):
        im.homography(np.zeros((4, 2)), 10, 10)


def test_components_band_and_average():
    mask = np.array([[1, 0, 1], [1, 1, 1], [0, 0, 0], [0, 1, 0]], bool)
    assert [len(c) for c in im.components(mask)] == [5, 1]
    page = np.full((300, 400), 0.9, np.float32)
    page[:62, :222] = 0.3  # light letters on a dark band
    for k in range(8):
        page[20:38, 10 + 24 * k : 20 + 24 * k] = 0.85
    band = im.zone_band(page)
    assert band is not None and set(np.unique(band)) == {0, 255} and band.shape[0] % 3 == 0
    assert im.zone_band(np.full((300, 400), 0.9, np.float32)) is None
    frames = [np.full((2, 2), v, np.float32) for v in (0.1, 0.2, 0.6)]
    assert im.average(frames[:2]) is None and im.average(frames)[0, 0] == pytest.approx(0.3)
    assert im.preview(np.array([[0.5]], np.float32)) == bytes([128, 128, 128, 255])
    assert im.gray(1, 1, b"\x00\x00\xff\xff", 4, bgr=True)[0, 0] == pytest.approx(0.299, abs=1e-6)


def png(img):
    raw = b"".join(b"\0" + bytes(np.repeat(r, 3)) for r in (img * 255).astype(np.uint8))
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_image_source(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(scene()[0]))
    (tmp_path / "bad.png").write_bytes(b"no image")
    rows = images.read_images(spark, str(tmp_path))
    assert sorted(r.ok for r in rows.collect()) == [False, True]
    good = rows.where("ok")
    f = images.window_features(good, (0.0, 0.04), rectified=True)
    assert f.count() == 40 and images.quads(good).first().found
    assert images.bands(good).count() == 0


def test_catalogue(spark, tmp_path):
    zero = base64.b64encode(bytes(255) + b"\x07").decode()
    v = {"pHash": "00000000000000ff", "dHash": "ff00000000000000", "vec16": zero, "vecBp": zero}
    entry = lambda i, z, vs: {"id": i, "grade": "g", "gradeName": "G", "zone": f"old {z}", "zoneId": z, "x": 12.34, "y": 5.6, "variants": vs}
    doc = {"version": 1, "entries": [entry("a1", 10, [v, v]), entry("b1", 20, [v]), entry("c1", 30, [v])], "zoneNames": {"10": {"en": "Zone A", "ja": "A"}, "20": {"en": "Zone B", "ja": "B"}, "30": {"ja": "C"}}, "unavailable": {"en": ["b1"]}}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    raw = cat.read_catalog(spark, str(tmp_path / "m.json"))
    rows = cat.variants(cat.entries(raw)).orderBy("flat").collect()
    assert len(rows) == 4 and rows[0].p == 255 and rows[0].d == -(1 << 56) and rows[0].vec[255] == 7 and len(rows[0].vec_bp) == 256

    from lodestar.operators import catalog_view as view

    names, gone = cat.names(raw), cat.unavailable(raw)
    en = view.with_location(view.localized(cat.entries(raw), names, gone, "en")).collect()
    assert [(r.id, r.zone_key, r.location) for r in en] == [("a1", "10", "Zone A (X:12.3, Y:5.6)")]
    assert view.localized(cat.entries(raw), names, gone, "ja").count() == 3 and view.localized(cat.entries(raw), None, None, "en").count() == 3
    assert [r.zone_label for r in view.zone_names(view.localized(cat.entries(raw), names, gone, "ja")).orderBy("ord").collect()] == ["A", "B", "C"]
    doc["entries"][0]["variants"] = []
    (tmp_path / "m.json").write_text(json.dumps(doc))
    with pytest.raises(Exception, match="without variants"):
        cat.variants(cat.entries(cat.read_catalog(spark, str(tmp_path / "m.json")))).collect()


def test_faults(spark):
    """Sides that are null, 0 or negative, and bytes that are null or not as many as the pixels need."""
    rows = [(1, 2, 3, 1, b"123456"), (2, 0, 3, 1, b""), (3, -1, -6, 1, b"123456"), (4, None, 3, 1, b"123"), (5, 2, 3, 4, b"123456"), (6, 2, 3, 1, None), (7, 1, 1, 4, "é¢".encode()), (8, 1, 2, None, b"12")]
    table = spark.createDataFrame(rows, "id int, width int, height int, channels int, data binary")
    got = {r.id: r.f for r in table.select("id", images.fault(*[table[c] for c in ("width", "height", "channels", "data")]).alias("f")).collect()}
    assert got == {1: None, 2: "size", 3: "size", 4: "size", 5: "bytes", 6: "bytes", 7: None, 8: "bytes"}
    assert sorted(r.id for r in images.sound(table).collect()) == [1, 7]
