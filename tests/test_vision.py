"""Image kernels on drawn images."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from tidelane.vision import kernels as K
from tidelane.vision.panel import Panel, load_templates, read_panels

#: Five by seven glyphs that are one piece each.
GLYPHS = {
    "0": "01110 10001 10001 10001 10001 10001 01110", "1": "00100 01100 00100 00100 00100 00100 01110", "2": "11110 00001 00001 01110 10000 10000 11111",
    "3": "11110 00001 00001 01110 00001 00001 11110", "4": "10001 10001 10001 11111 00001 00001 00001", "5": "11111 10000 11110 00001 00001 00001 11110",
    "7": "11111 00001 00010 00100 00100 01000 01000", "/": "00001 00010 00010 00100 01000 01000 10000",
}


def glyph(c: str, k: int = 3) -> np.ndarray:
    g = np.array([[int(v) for v in row] for row in GLYPHS[c].split()], np.uint8) * 255
    return np.kron(g, np.ones((k, k), np.uint8))


def png(img: np.ndarray) -> bytes:
    h, w = img.shape[:2]
    raw = b"".join(b"\0" + img[y].tobytes() for y in range(h))
    part = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def rgb(grey: np.ndarray) -> np.ndarray:
    return np.repeat(grey[:, :, None], 3, axis=2)


def write(text: str) -> np.ndarray:
    cells = [np.pad(glyph(c), ((2, 2), (3, 3))) for c in text]
    return rgb(np.hstack(cells))


TEMPLATES = {c: K.canvas(glyph(c)) for c in GLYPHS}
PANEL = Panel(200.0, {"wood_total": (20, 10, 130, 25), "population_total": (220, 10, 130, 25), "idle_vils": (420, 10, 40, 25)}, TEMPLATES)


def frame(wood: str, pop: str) -> np.ndarray:
    img = np.zeros((1000, 1600, 3), np.uint8)
    for x, t in ((20, wood), (220, pop)):
        d = write(t)
        img[10 : 10 + d.shape[0], x : x + d.shape[1]] = d
    img[20:32, 1388:1401] = (250, 10, 10)
    return img


def test_png_round_trip():
    img = frame("123", "45/50")
    assert (K.decode_png(png(img)) == img).all()


def test_scale():
    img = frame("1", "1")
    assert abs(K.ui_scale(img, 200.0) - 1.0) < 1e-9 and K.ui_scale(img * 0, 200.0) is None and K.ui_scale(img, 20.0) is None


def test_filters_and_predicates():
    grey, yellow = np.full((4, 4, 3), 200, np.uint8), np.tile(np.array([220, 210, 60], np.uint8), (4, 4, 1))
    assert (K.filtered(grey, 30, 100) == 200).all() and (K.filtered(yellow, 30, 100) == 0).all() and (K.filtered(yellow, 30, 100, yellow=True) == 220).all()
    assert K.has_yellow(yellow) and not K.has_yellow(grey) and K.is_overlay(yellow) and not K.is_overlay(grey[:0])
    over = yellow.copy()
    over[1, 1] = 255
    assert K.filtered(over, 30, 30, yellow[0, 0])[1, 1] == 255 and K.filtered(over, 30, 30, yellow[0, 0]).sum() == 255


def test_labels_split_and_merge():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 0]], bool)
    assert K.label(m, True).max() == 3 and K.label(m, False).max() == 4
    two = np.hstack([glyph("0"), glyph("0")])
    assert len(K.digit_boxes(rgb(two), 1.0)) == 2
    assert K.merged([(5, 0, 3, 10), (0, 0, 6, 10)]) == [(0, 0, 8, 10)] and len(K.merged([(5, 0, 9, 10), (0, 0, 6, 10)])) == 2


def test_every_glyph_matches_itself():
    names = list(TEMPLATES)
    t = np.stack([TEMPLATES[n] for n in names])
    for c in GLYPHS:
        assert K.match(glyph(c, 4), names, t, True)[0] == c
    assert K.match(glyph("/"), names, t, False)[0] != "/" and K.match(glyph("1"), [], t[:0], True) == ("?", 0.0)


def test_panel_operator(spark):
    rows = [(1, 0, 0, png(frame("120", "45/50"))), (1, 1, 250, png(frame("54", "1/2") * 0)), (1, 2, 500, b"junk")]
    got = {r.seq: r["values"] for r in read_panels(spark.createDataFrame(rows, "match_id long, seq long, ts_ms long, content binary"), PANEL).collect()}
    assert got[1] is None and got[2] is None
    assert got[0]["wood"]["total"] == "120" and got[0]["population"] == {"total": "45", "housing": "50", "color": "white"} and got[0]["idle"]["vils"] == "0"


def test_templates_from_files():
    good, bad = load_templates({"slash": png(rgb(glyph("/"))), "7": png(rgb(glyph("7"))), "x": b"no"})
    assert set(good) == {"/", "7"} and bad == ["x"]


def test_pixels_masks_and_symmetry():
    raw = bytes(range(1, 9)) + b"\0\0" + bytes(range(11, 19)) + b"\0\0"
    img = K.rgb_of(raw, 2, 2, 10)
    assert img.tolist() == [[[3, 2, 1], [7, 6, 5]], [[13, 12, 11], [17, 16, 15]]]
    kept = K.masked(img, [(1, 0, 1, 1)])
    assert kept[0, 1].tolist() == [7, 6, 5] and kept.sum() == 18
    assert K.asymmetry(np.array([[1.0, 0.0], [2.0, 2.0]])) == 2.0
