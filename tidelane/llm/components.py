"""Connected components of an edge table: forests of pieces, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelane.llm.common import BROADCAST_ROWS, cut

#: Neighbours from which on a node is hot at least.
HOT = 1000
#: Edges of one piece; a table of no more is one task's work and takes no rounds.
PIECE_EDGES = 1 << 15
#: Edges that a task holds at once.
HELD_EDGES = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that it reaches) for each end of the edges (u, v), in order of node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    top = np.arange(len(nodes))
    while True:
        x, y = top[a], top[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[top]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while (top[top] != top).any():
            top = top[top]


def _forests(tops: bool, held: int = HELD_EDGES):
    """Rows (u, v) to those of the forest of each task, all nodes at their least one; tops: with a row for that one, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(node: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
            some = slice(None) if tops else node != low
            return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(low[some])], names=["u", "v"])

        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(x) for x, _ in parts) >= held:
                parts = [forest(*map(np.concatenate, zip(*parts, strict=True)))]
                if len(parts[0][0]) > held // 2:
                    yield rows(*parts.pop())
        if parts:
            yield rows(*forest(*map(np.concatenate, zip(*parts, strict=True))))

    return run


def _contracted(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_forests(False), "u long, v long")


def written(edges: DataFrame) -> tuple[DataFrame, int]:
    """(u, v), u > v, written once: a forest of each task's edges, which connects what they connect; and its rows."""
    ends = edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).where("u > v")
    seen = Observation()
    now = cut(_contracted(ends).observe(seen, F.count("*").alias("rows")))
    return now, seen.get["rows"]


def _star(edges: DataFrame, large: bool, hot_from: int) -> DataFrame:
    """Each node's neighbours (the larger ones, or itself and the smaller ones) linked to the least node that it sees.

    Minima are pre-aggregated. A hot node's neighbours take theirs from a broadcast table, the others by a shuffle, so
    that none meet in one task.
    """
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    least = both.groupBy("n").agg(F.least(F.col("n"), F.min("m")).alias("low"), F.count("*").alias("degree"))
    hot = least.where(F.col("degree") >= hot_from).select("n", "low")
    near = both.join(F.broadcast(hot), "n", "left")
    seen = near.where("low is not null").unionByName(near.where("low is null").drop("low").join(least.select("n", "low"), "n"))
    if large:
        out = seen.where("m > n").select(F.col("m").alias("u"), F.col("low").alias("v"))
    else:
        out = seen.select(F.col("m").alias("u"), F.col("low").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("low").alias("v")))
    return out.where("u > v").distinct()


def _round(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step where no node is hot: nodes' neighbours meet in windows, one shuffle a step, and nothing is written."""
    low = F.least("n", F.min("m").over(Window.partitionBy("n"))).alias("low")
    both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("m")), F.struct(F.col("v").alias("n"), F.col("u").alias("m")))).alias("e")).select("e.n", "e.m")
    once = both.select("n", "m", low).where("m > n").select(F.col("m").alias("n"), F.col("low").alias("m"))
    seen = once.where("n > m").select("n", "m", low)
    return seen.select(F.explode(F.array("n", "m")).alias("u"), F.col("low").alias("v")).where("u > v").distinct()


def components(edges: DataFrame, hot: int = HOT, piece: int = PIECE_EDGES, rows: int | None = None) -> DataFrame:
    """(node, component): for each node of an edge (u, v), the least node that it reaches.

    Null ends and loops are dropped; no edges give no rows. Each task makes a forest of its edges, and a table of no more
    than `piece` edges is one task's. Of larger ones rounds, each written to the shared folder, go on until all
    edges are stars around least nodes; every round lowers some node's neighbour, and as many as the logarithm of the
    longest chain are usual. A node is hot from `hot` neighbours on, and from so many that no more than BROADCAST_ROWS
    nodes are; without a hot node a round is one plan of three shuffles, as each costs the driver memory. rows: the
    second result of `written`, of which edges are the first.
    """
    kind = edges.schema["u"].dataType
    now, rows = written(edges) if rows is None else (edges, rows)
    while True:
        if rows <= piece:
            out = now.coalesce(1).mapInArrow(_forests(True, max(HELD_EDGES, 4 * piece)), "u long, v long")
            return out.select(F.col("u").cast(kind).alias("node"), F.col("v").cast(kind).alias("component"))
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up")))).alias("e"))
        nodes = ends.groupBy("e.n").agg(F.count("*").alias("degree"), F.sum("e.up").alias("up"))
        # a star's outer node has one edge, up to a centre, which has none up
        count, most, chained = nodes.agg(F.sum("up"), F.max("degree"), F.bool_or((F.col("up") > 0) & (F.col("degree") > 1))).head()
        if not chained:
            break
        hot_from = max(hot, 1 + 2 * count // BROADCAST_ROWS)
        # a node has no more smaller neighbours after a large-star step than it had before
        now, rows = written(_round(now) if most < hot_from else _star(cut(_star(now, True, hot_from)), False, hot_from))
    tops = now.select(F.col("v").alias("node")).distinct()
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
    return out.select(F.col("node").cast(kind), F.col("component").cast(kind))
