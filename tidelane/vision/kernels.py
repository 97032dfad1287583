"""Kernels on RGB arrays (height, width, 3; uint8): anchor, filters, predicates, components, digits."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Anchor scan (shares of the frame), red excess, box and pixel counts, scales.
ANCHOR_X, ANCHOR_Y, RED_EXCESS, RED_BOX, RED_PIXELS, SCALES = (0.5, 0.95), (0.015, 0.035), 140, 10, 12, (0.5, 2.0)
# Filters.
GREY, OUT_LEAST, OUT_LEAST_OVERLAY, SEG_LEAST, SEG_PEAK, SEG_PEAK_PLAIN, AREA = 30, 5, 30, 100, 230, 150, 15.0
LUMA = np.array([0.299, 0.587, 0.114], np.float32)
# Yellow and overlay predicates, UI mod.
YELLOW_LEAST, YELLOW_BLUE, YELLOW_GAP = 100, 50, 50
MOD_DIFF, MOD_PIXELS, MOD_RAISE, MOD_WIDEN, MOD_RED, MOD_REST = 150, 12, 0.6, 0.4, 150, 10
# Canvas.
HEIGHT, CANVAS, SIGMA = 36, 64, 1.0


def decode_png(data: bytes) -> np.ndarray:
    """An 8-bit RGB, RGBA or grey PNG without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        head = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    w, h, depth, color, _, _, lace = head
    if depth != 8 or lace or color not in (0, 2, 6):
        raise ValueError("unsupported PNG")
    c = {0: 1, 2: 3, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w * c), np.uint8)
    above = np.zeros(w * c, np.uint8)
    for y in range(h):
        line, f = raw[y, 1:].copy(), raw[y, 0]
        if f == 1:
            line = np.add.accumulate(line.reshape(w, c), axis=0, dtype=np.uint8).ravel()
        elif f == 2:
            line += above
        elif f in (3, 4):
            for i in range(w * c):
                a, b, d = (int(line[i - c]) if i >= c else 0), int(above[i]), (int(above[i - c]) if i >= c else 0)
                if f == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - d
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                line[i] = (int(line[i]) + guess) & 255
        out[y] = above = line
    img = out.reshape(h, w, c)
    return np.repeat(img, 3, axis=2) if c == 1 else img[:, :, :3]


def rgb_of(bgra: bytes, width: int, height: int, pitch: int) -> np.ndarray:
    """RGB of rows of BGRA pixels that start every `pitch` bytes."""
    rows = np.frombuffer(bgra, np.uint8)[: pitch * height].reshape(height, pitch)[:, : width * 4]
    return rows.reshape(height, width, 4)[:, :, 2::-1]


def _channels(img: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(img[..., k].astype(np.int16) for k in range(3))


def ui_scale(img: np.ndarray, margin: float) -> float | None:
    """The scale by the rightmost red pixel of the band that has RED_PIXELS red ones in the box left of and below it."""
    h, w = img.shape[:2]
    y0, y1 = int(h * ANCHOR_Y[0]), min(int(h * ANCHOR_Y[1]), h - 1)
    x0, x1 = int(w * ANCHOR_X[0]), min(int(w * ANCHOR_X[1]), w - 1)
    r, g, b = _channels(img[y0 : y1 + 1, x0 : x1 + 1])
    red = (r - g >= RED_EXCESS) & (r - b >= RED_EXCESS)
    total = np.pad(red.astype(int).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ys, xs = np.nonzero(red)
    if not len(xs):
        return None
    bottom, left = np.minimum(ys + RED_BOX, red.shape[0]), np.maximum(xs - RED_BOX + 1, 0)
    count = total[bottom, xs + 1] - total[ys, xs + 1] - total[bottom, left] + total[ys, left]
    good = xs[count >= RED_PIXELS]
    if not len(good):
        return None
    scale = (w - (x0 + good.max())) / margin
    return scale if SCALES[0] <= scale <= SCALES[1] else None


def is_overlay(img: np.ndarray) -> bool:
    if not img.size:
        return False
    r, g, b = img.reshape(-1, 3).mean(axis=0)
    return bool(r > 150 and g > 150 and b < 100)


def has_yellow(img: np.ndarray) -> bool:
    r, g, b = _channels(img)
    return bool(((r > YELLOW_LEAST) & (g > YELLOW_LEAST) & (b < np.minimum(r, g) - YELLOW_BLUE) & (np.abs(r - g) < YELLOW_GAP)).any())


def has_red(img: np.ndarray) -> bool:
    r, g, b = _channels(img)
    return bool(((r > MOD_RED) & (g < MOD_REST) & (b < MOD_REST)).any())


def has_mod(img: np.ndarray, x: int, y: int, w: int, h: int) -> bool:
    """Whether the villager box shows the mod's colour, and enough of it in the raised box."""

    def colored(top: int, rows: int) -> int:
        r, g, b = _channels(img[top : top + rows, x : x + w])
        return int(((r - b > MOD_DIFF) & (g - b > MOD_DIFF)).sum())

    up = int(h * MOD_RAISE)
    return colored(y, h) > 0 and colored(max(y - up, 0), h + up) >= MOD_PIXELS


def filtered(img: np.ndarray, grey: int, least: int, overlay: np.ndarray | None = None, yellow: bool = False, plain: bool = False) -> np.ndarray:
    """The image's digits as brightness, 0 elsewhere.

    plain: luminance. overlay: luminance above that colour, stretched to 0..255. Else near-grey pixels (and yellow
    ones if asked) by their highest channel. Values under `least` are 0.
    """
    if plain:
        luma = (img.astype(np.float32) @ LUMA).astype(np.uint8)
        return np.where(luma >= least, luma, 0).astype(np.uint8)
    if overlay is not None:
        luma = (np.maximum(img.astype(np.int16) - overlay.astype(np.int16), 0).astype(np.float32) @ LUMA).astype(np.uint8).astype(np.float32)
        low, high = (luma.min(), luma.max()) if luma.size else (0, 0)
        norm = ((luma - low) / (high - low) * 255).astype(np.uint8) if high > low else np.zeros(luma.shape, np.uint8)
        return np.where(norm >= least, norm, 0).astype(np.uint8)
    r, g, b = _channels(img)
    high, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    keep = high - low <= grey
    if yellow:
        keep |= (r > 150) & (g > 150) & (np.abs(r - g) < 50) & (b < high - 15)
    return np.where(keep & (high >= least), high, 0).astype(np.uint8)


def label(mask: np.ndarray, eight: bool) -> np.ndarray:
    """Component numbers from 1 in row order of their first pixels; the least place spreads until nothing changes."""
    h, w = mask.shape
    lab = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), h * w + 1)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    while True:
        old = lab.copy()
        for dy, dx in steps:
            a = (slice(0, h - dy), slice(max(-dx, 0), w - max(dx, 0)))
            b = (slice(dy, h), slice(max(dx, 0), w - max(-dx, 0)))
            both = mask[a] & mask[b]
            low = np.minimum(lab[a], lab[b])
            lab[a] = np.where(both, low, lab[a])
            lab[b] = np.where(both, np.minimum(low, lab[b]), lab[b])
        if (lab == old).all():
            break
    names = np.unique(lab[mask])
    return np.where(mask, np.searchsorted(names, lab) + 1, 0)


def _wide(w: int, h: int) -> bool:
    return w + 2 > h


def valleys(mask: np.ndarray, scale: float) -> tuple[int | None, int | None]:
    """Columns to split a wide blob at: one that leaves two balanced narrow parts, and the best of any.

    Candidates are local minima of the column sums, at most three tenths of the height. The best of any leaves the
    fewest wide parts, then has the least sum.
    """
    h, w = mask.shape
    sums, most, edge = mask.sum(axis=0), max(int(0.3 * h), 2), max(int(3 * scale), 2)
    if w <= 2 * edge:
        return None, None
    spots = [x for x in range(edge, w - edge) if sums[x] <= min(sums[x - 1], sums[x + 1]) and sums[x] <= most]
    wide = lambda x: _wide(x, h) + _wide(w - x, h)
    even = [x for x in spots if w > h + 1 and not wide(x) and min(x, w - x) / max(x, w - x) >= 0.7]
    return min(even, key=lambda x: sums[x], default=None), min(spots, key=lambda x: (wide(x), sums[x]), default=None)


def digit_boxes(img: np.ndarray, scale: float, overlay: np.ndarray | None = None, yellow: bool = False, plain: bool = False) -> list[tuple[int, int, int, int]]:
    """(x, y, w, h) of the digits of a box, in the order that components are found.

    Components of enough area and peak are digits if narrow. A wide one is cut out and looked at again; if it fills
    its cut-out, it is split at a balanced valley, or looked at with a higher threshold, then less tolerance, then
    split at any valley, then by four neighbours, and at last taken whole.
    """
    area, peak = max(int(AREA * scale * scale), 1), SEG_PEAK_PLAIN if plain else SEG_PEAK

    def find(roi: np.ndarray, grey: int, least: int, eight: bool, ox: int, oy: int) -> list[tuple[int, int, int, int]]:
        seg = filtered(roi, grey, least, overlay, yellow, plain)
        lab = label(seg > 0, eight)
        out, good = [], []
        for k in range(1, lab.max(initial=0) + 1):
            ys, xs = np.nonzero(lab == k)
            if len(ys) >= area and seg[ys, xs].max() >= peak:
                good.append((k, int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1))
        if len(good) == 1 and good[0][3:] == (roi.shape[1], roi.shape[0]) and _wide(*good[0][3:]):
            even, any_ = valleys(seg > 0, scale)

            def split(x: int) -> list[tuple[int, int, int, int]]:
                cut = roi.copy()
                cut[:, x] = 0
                return find(cut, GREY, SEG_LEAST, True, ox, oy)

            if even is not None:
                return split(even)
            if least < 160:
                return find(roi, grey, least + 10, eight, ox, oy)
            if grey > 2:
                return find(roi, grey - 2, least, eight, ox, oy)
            if any_ is not None:
                return split(any_)
            if eight:
                return find(roi, grey, least, False, ox, oy)
            return [(ox, oy, *good[0][3:])]
        for k, x, y, w, h in good:
            if _wide(w, h):
                own = lab[y : y + h, x : x + w] == k
                out += find(np.where(own[..., None], roi[y : y + h, x : x + w], 0).astype(np.uint8), grey, least, eight, ox + x, oy + y)
            else:
                out.append((ox + x, oy + y, w, h))
        return out

    return find(img, GREY, SEG_LEAST, True, 0, 0)


def merged(boxes: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Boxes left to right; one that overlaps the one before joins it while both stay narrow."""
    out: list[tuple[int, int, int, int]] = []
    for x, y, w, h in sorted(boxes, key=lambda b: b[0]):
        if out and x < out[-1][0] + out[-1][2]:
            px, py, pw, ph = out[-1]
            nx, ny = min(px, x), min(py, y)
            nw, nh = max(px + pw, x + w) - nx, max(py + ph, y + h) - ny
            if not _wide(nw, nh):
                out[-1] = (nx, ny, nw, nh)
                continue
        out.append((x, y, w, h))
    return out


def digits(img: np.ndarray, out_img: np.ndarray, scale: float, overlay: np.ndarray | None, yellow: bool, plain: bool) -> list[np.ndarray]:
    cuts = [out_img[y : y + h, x : x + w] for x, y, w, h in merged(digit_boxes(img, scale, overlay, yellow, plain))]
    return [c for c in cuts if c.size]


def baseline(img: np.ndarray, scale: float, plain: bool) -> tuple[int, int] | None:
    """(height, top) of a box's digits."""
    boxes = digit_boxes(img, scale, plain=plain)
    if not boxes:
        return None
    top = min(b[1] for b in boxes)
    return max(b[1] + b[3] for b in boxes) - top, top


def _weights(n: int, m: int, up: bool) -> np.ndarray:
    """Rows of m weights over n samples: Lanczos of three lobes when growing, a triangle when shrinking."""
    ratio = n / m
    reach = (3.0 if up else 1.0) * max(ratio, 1.0)
    x = np.arange(n)[None, :] + 0.5 - (np.arange(m)[:, None] + 0.5) * ratio
    t = x / max(ratio, 1.0)
    k = np.sinc(t) * np.sinc(t / 3) if up else 1 - np.abs(t)
    k = np.where(np.abs(x) < reach, k, 0)
    return k / k.sum(axis=1, keepdims=True)


def resized(img: np.ndarray, w: int, h: int, up: bool) -> np.ndarray:
    out = _weights(img.shape[0], h, up) @ img.astype(float) @ _weights(img.shape[1], w, up).T
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def canvas(img: np.ndarray) -> np.ndarray:
    """A digit at fixed height, centred on a square and blurred, as floats from 0 to 1; empty gives zeros."""
    out = np.zeros((CANVAS, CANVAS), np.float32)
    if not img.size:
        return out
    up = HEIGHT / img.shape[0] > 1
    big = resized(img, max(int(img.shape[1] * HEIGHT / img.shape[0]), 1), HEIGHT, up)
    ys, xs = np.nonzero(big > 1)
    if not len(ys):
        return out
    crop = big[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
    if max(crop.shape) > CANVAS:
        fit = CANVAS / max(crop.shape)
        crop = resized(crop, min(max(int(crop.shape[1] * fit), 1), CANVAS), min(max(int(crop.shape[0] * fit), 1), CANVAS), up)
    y, x = (CANVAS - crop.shape[0]) // 2, (CANVAS - crop.shape[1]) // 2
    out[y : y + crop.shape[0], x : x + crop.shape[1]] = crop / 255.0
    k = np.exp(-0.5 * (np.arange(-2, 3) / SIGMA) ** 2)
    k = (k / k.sum()).astype(np.float32)
    for axis in (0, 1):
        pad = np.pad(out, [(2, 2) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        out = sum(k[i] * np.take(pad, np.arange(i, i + CANVAS), axis) for i in range(5))
    return out


def distances(img: np.ndarray, templates: np.ndarray) -> np.ndarray:
    """For each template (n, CANVAS, CANVAS) the least sum of squares over shifts of one pixel each way."""
    pad = np.pad(canvas(img), 1)
    shifts = np.stack([pad[1 + dy : 1 + dy + CANVAS, 1 + dx : 1 + dx + CANVAS] for dy in (-1, 0, 1) for dx in (-1, 0, 1)]).reshape(9, -1)
    flat = templates.reshape(len(templates), -1)
    return ((shifts[:, None, :] - flat[None, :, :]) ** 2).sum(axis=2).min(axis=0)


def asymmetry(c: np.ndarray) -> float:
    return float(((c - c[:, ::-1]) ** 2).sum())


def match(img: np.ndarray, names: list[str], templates: np.ndarray, slash: bool) -> tuple[str, float]:
    """The nearest template's character and distance; 0 against 3, 6 or 9 within a fifth goes by symmetry."""
    use = [i for i, n in enumerate(names) if slash or n != "/"]
    if not use:
        return "?", 0.0
    d = distances(img, templates[use])
    order = np.argsort(d, kind="stable")
    best = [(names[use[i]], float(d[i])) for i in order[:2]]
    if len(best) == 2 and "0" in (pair := {best[0][0], best[1][0]}) and pair & {"3", "6", "9"} and best[1][1] - best[0][1] < 0.2 * best[0][1]:
        odd = asymmetry(canvas(img))
        if odd > 60 if best[0][0] == "0" else odd < 40:
            best.reverse()
    return best[0]


def masked(img: np.ndarray, keep: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The image with everything outside the (x, y, w, h) regions zeroed."""
    out = np.zeros_like(img)
    for x, y, w, h in keep:
        out[y : y + h, x : x + w] = img[y : y + h, x : x + w]
    return out
