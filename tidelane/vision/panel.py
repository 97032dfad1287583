"""Reading a whole panel, and the operator over frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidelane.vision import kernels as K

SCHEMA = "match_id long, seq long, ts_ms long, values map<string, map<string, string>>"


def split_name(name: str) -> tuple[str, str]:
    head, _, tail = name.partition("_")
    return head, tail or "value"


class Panel:
    """elements: name -> (x, y, w, h) at scale 1; templates: character -> canvas."""

    def __init__(self, margin: float, elements: dict[str, tuple[float, float, float, float]], templates: dict[str, np.ndarray]) -> None:
        self.margin, self.elements, self.names = margin, elements, list(templates)
        self.templates = np.stack([templates[n] for n in self.names]) if templates else np.zeros((0, K.CANVAS, K.CANVAS), np.float32)

    def _box(self, name: str, scale: float, mod: bool) -> tuple[int, int, int, int]:
        x, y, w, h = (v * scale for v in self.elements[name])
        x, y, w, h = int(x), int(y), int(max(w, 1)), int(max(h, 1))
        if mod and name.endswith("_vils"):
            up = int(h * K.MOD_RAISE)
            y, h = max(y - up, 0), h + up
        return x, y, w, h

    def read(self, img: np.ndarray) -> dict[str, dict[str, str]] | None:
        """Values by category and part, or None where no panel is seen."""
        scale = K.ui_scale(img, self.margin)
        if scale is None:
            return None
        inside = lambda b: b[0] + b[2] <= img.shape[1] and b[1] + b[3] <= img.shape[0]
        cut = lambda b: img[b[1] : b[1] + b[3], b[0] : b[0] + b[2]]
        mod = "wood_vils" in self.elements and inside(b := self._box("wood_vils", scale, False)) and K.has_mod(img, *b)
        lines = {}
        for kind, name in (("total", "wood_total"), ("vils", "wood_vils")):
            if name in self.elements and inside(b := self._box(name, scale, mod)):
                lines[kind] = K.baseline(cut(b), scale, mod and kind == "vils")
        out: dict[str, dict[str, str]] = {"meta": {"ui_scale": f"{scale:.4f}"}}
        color = "white"
        for name in self.elements:
            x, y, w, h = self._box(name, scale, mod)
            vils, pop, idle = name.endswith("_vils"), name == "population_total", name == "idle_vils"
            if idle and mod:
                w += int(w * K.MOD_WIDEN)
            line = None if idle else lines.get("vils" if vils else "total")
            if line:
                y, h = y + line[1], line[0]
            if not inside((x, y, w, h)):
                continue
            box, plain = cut((x, y, w, h)), mod and vils
            over = box[2, 2] if pop and min(box.shape[:2]) > 2 and K.is_overlay(box) else None
            if idle and not (K.has_red(box) if mod else K.has_yellow(box)):
                text = "0"
            else:
                shown = K.filtered(box, K.GREY, K.OUT_LEAST if over is None else K.OUT_LEAST_OVERLAY, over, pop, plain)
                text = self._text(K.digits(box, shown, scale, over, pop, plain), pop) or ("0" if idle else "")
            if pop:
                color = "overlay" if over is not None else "yellow" if K.has_yellow(box) else color
            head, part = split_name(name)
            if pop and "/" in text:
                text, _, room = text.partition("/")
                out.setdefault(head, {})["housing"] = room
                part = "total"
            out.setdefault(head, {})[part] = text
        out.setdefault("population", {})["color"] = color
        return out

    def _text(self, cuts: list[np.ndarray], pop: bool) -> str:
        """The digits' characters; a population of three or more has a slash, at the inner digit that is nearest to one."""
        inner = range(1, len(cuts) - 1) if pop and len(cuts) > 2 else range(0)
        found = [K.match(c, self.names, self.templates, i in inner) for i, c in enumerate(cuts)]
        chars = [f[0] for f in found]
        if inner and "/" not in chars and "/" in self.names:
            slash = self.templates[[self.names.index("/")]]
            chars[min(inner, key=lambda i: float(K.distances(cuts[i], slash)[0]) - found[i][1])] = "/"
        return "".join(chars)


def load_templates(images: dict[str, bytes]) -> tuple[dict[str, np.ndarray], list[str]]:
    """(character -> canvas, skipped names) of digit images by name; `slash` stands for /."""
    out, bad = {}, []
    for name, data in images.items():
        try:
            out["/" if name == "slash" else name] = K.canvas(K.decode_png(data).max(axis=2))
        except (ValueError, IndexError, KeyError, TypeError):
            bad.append(name)
    return out, bad


def read_panels(frames: DataFrame, panel: Panel) -> DataFrame:
    """SCHEMA of frames (match_id, seq, ts_ms, content as PNG); values is null where no panel is seen or no image is read."""
    shared = frames.sparkSession.sparkContext.broadcast(panel)  # a dozen templates

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            values = []
            for data in p["content"]:
                try:
                    values.append(shared.value.read(K.decode_png(bytes(data))))
                except (ValueError, TypeError):
                    values.append(None)
            yield p[["match_id", "seq", "ts_ms"]].assign(values=values)

    return frames.select("match_id", "seq", "ts_ms", "content").mapInPandas(run, SCHEMA)
