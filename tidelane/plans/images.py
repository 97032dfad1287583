"""Image kernels over small images: each vector is one of eight by eight pixels, as BGRA rows with padding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidelane.plans.tables import table
from tidelane.vision import kernels as K

QUERIES: dict = {}
ORACLE_SQL: dict = {}

SIDE, PITCH = 8, 36
#: The regions that a recorded frame keeps.
KEPT = [(1, 1, 3, 2), (4, 5, 4, 3)]
_SCHEMA = (
    "vec_id long, overlay boolean, yellow boolean, red boolean, mean_red double, asymmetry long, kept long, shown long, shown_plain long, "
    "components long, widest long, tallest long, largest long"
)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def bgra(vector: np.ndarray) -> bytes:
    """Red from a number's size, green and blue from red and the place; every row ends with padding."""
    i = np.arange(SIDE * SIDE)
    r = np.floor(np.abs(vector.astype(float)) * 997).astype(np.int64) % 256
    rows = np.full((SIDE, PITCH), 77, np.uint8)
    rows[:, : SIDE * 4] = np.stack([(r * 7 + i) % 256, r * 3 % 256, r, np.full_like(r, 255)], axis=1).reshape(SIDE, -1)
    return rows.tobytes()


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        out = []
        for vec_id, vector in zip(p["vec_id"], p["embedding"], strict=True):
            img = K.rgb_of(bgra(np.asarray(vector)), SIDE, SIDE, PITCH)
            red = img[..., 0].astype(np.int64)
            lab = K.label(red > 128, True)
            boxes = [np.nonzero(lab == k) for k in range(1, lab.max() + 1)]
            size = lambda at: int(at.max() - at.min() + 1)
            out.append(
                (
                    vec_id, K.is_overlay(img), K.has_yellow(img), K.has_red(img), round(float(red.mean()), 6), int(K.asymmetry(red)), int(K.masked(img, KEPT)[..., 0].astype(int).sum()),
                    int(K.filtered(img, K.GREY, K.OUT_LEAST, yellow=True).astype(int).sum()), int((K.filtered(img, K.GREY, 100, plain=True) > 0).sum()),
                    len(boxes), max((size(x) for _, x in boxes), default=0), max((size(y) for y, _ in boxes), default=0), max((len(x) for _, x in boxes), default=0),
                )
            )
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _SCHEMA.split(", ")])


@query("""WITH RECURSIVE p AS (
  SELECT vec_id, i, i % 8 AS x, i // 8 AS y, r, r * 3 % 256 AS g, (r * 7 + i) % 256 AS b FROM (
    SELECT vec_id, i, CAST(floor(abs(CAST(embedding[i + 1] AS DOUBLE)) * 997) AS BIGINT) % 256 AS r FROM embeddings, range(64) t(i))),
on_ AS (SELECT vec_id, i, x, y FROM p WHERE r > 128),
reach AS (
  SELECT vec_id, i, i AS j FROM on_
  UNION
  SELECT a.vec_id, a.i, c.i FROM reach a JOIN on_ b ON b.vec_id = a.vec_id AND b.i = a.j JOIN on_ c ON c.vec_id = b.vec_id AND abs(c.x - b.x) <= 1 AND abs(c.y - b.y) <= 1),
part AS (SELECT vec_id, i, min(j) AS k FROM reach GROUP BY vec_id, i),
box AS (SELECT q.vec_id, k, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS n FROM part q JOIN on_ ON on_.vec_id = q.vec_id AND on_.i = q.i GROUP BY q.vec_id, k),
boxes AS (SELECT vec_id, count(*) AS components, max(w) AS widest, max(h) AS tallest, max(n) AS largest FROM box GROUP BY vec_id),
m AS (
  SELECT p.vec_id, avg(r) > 150 AND avg(g) > 150 AND avg(b) < 100 AS overlay, bool_or(r > 100 AND g > 100 AND b < least(r, g) - 50 AND abs(r - g) < 50) AS yellow, bool_or(r > 150 AND g < 10 AND b < 10) AS red,
    round(avg(r), 6) AS mean_red, CAST(sum((r - mirrored) * (r - mirrored)) AS BIGINT) AS asymmetry,
    CAST(sum(CASE WHEN (x BETWEEN 1 AND 3 AND y BETWEEN 1 AND 2) OR (x BETWEEN 4 AND 7 AND y BETWEEN 5 AND 7) THEN r ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN (greatest(r, g, b) - least(r, g, b) <= 30 OR (r > 150 AND g > 150 AND abs(r - g) < 50 AND b < greatest(r, g, b) - 15)) AND greatest(r, g, b) >= 5 THEN greatest(r, g, b) ELSE 0 END) AS BIGINT) AS shown,
    CAST(sum(CASE WHEN floor(round(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE, 4)) >= 100 THEN 1 ELSE 0 END) AS BIGINT) AS shown_plain
  FROM p JOIN (SELECT vec_id, i AS at, r AS mirrored FROM p) q ON q.vec_id = p.vec_id AND q.at = p.y * 8 + 7 - p.x GROUP BY p.vec_id)
SELECT m.*, coalesce(components, 0) AS components, coalesce(widest, 0) AS widest, coalesce(tallest, 0) AS tallest, coalesce(largest, 0) AS largest FROM m LEFT JOIN boxes ON boxes.vec_id = m.vec_id""")
def image_measures(spark, d):
    """Predicates, means, symmetry, masks, filters and connected components of every image."""
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInPandas(_measured, _SCHEMA)
