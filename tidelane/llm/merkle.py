"""Merkle manifests: a tree of digests for every group of rows, a root over the groups, and a proof for every row.

Rows are range-sorted by group and key, and each partition is packed into pieces of consecutive rows of one group. The
pieces' counts give the place of each piece in its group. A piece builds every run of ARITY nodes that lies wholly in it,
level by level; the nodes at its ragged ends, a few a level, are shuffled by their coordinate (group, level, run), where
the upper levels are finished. A proof needs runs of the piece and those few of the upper ones that the piece touches.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelane.llm.common import cut, parts_of, spread_join

#: Nodes of one run, which become one node of the next level.
ARITY = 8
#: Levels that are finished in one shuffle.
TILE = 4
#: Rows of one piece at most.
PIECE_ROWS = 8192
_PIECES = "g string, part int, piece int, n int, keys array<string>, leaves array<string>, changed array<string>"
_EDGES = "g string, part int, piece int, wanted boolean, level int, at long, total long, digest string"


def field(value: Column) -> Column:
    """A value as it enters a leaf: UTF-8 bytes, a colon and the value as text; `-` where it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*fields: Column) -> Column:
    """SHA-256 of the fields' concatenation, in lowercase hex."""
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def _packer(size: int):
    """Consecutive rows (part, g, key, leaf, changed) of one g as one row, at most `size` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group, count, piece, part = None, 0, 0, 0

        def packed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            one = pa.array([0, rows.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(one, rows[c].combine_chunks()) for c in ("key", "leaf", "changed")]
            ids = [pa.array([group]), pa.array([part], pa.int32()), pa.array([piece], pa.int32()), pa.array([rows.num_rows], pa.int32())]
            return pa.RecordBatch.from_arrays([*ids, *lists], names=["g", "part", "piece", "n", "keys", "leaves", "changed"])

        for batch in batches:
            runs = batch.column("g").to_pylist()
            at = 0
            while at < len(runs):
                if held and (runs[at] != group or count == size):
                    yield packed()
                    held, count, piece = [], 0, piece + 1
                group, part = runs[at], batch.column("part")[at].as_py()
                end = at + 1
                while end < len(runs) and runs[end] == group and count + end - at < size:
                    end += 1
                held.append(batch.slice(at, end - at))
                count += end - at
                at = end
        if held:
            yield packed()

    return run


def pieces(leaves: DataFrame, size: int = PIECE_ROWS) -> DataFrame:
    """leaves (g, key, leaf, changed), sorted by g and key over all partitions and packed, with start and total.

    Rows of one g and key are sorted by leaf; wholly equal ones are dealt apart by a number of their own, so that no
    range is larger for them. start is the place of a piece's first row in its group, total the group's number of rows:
    both are sums of the pieces' counts, first by part and then inside each.
    """
    settled = cut(leaves.withColumn("tie", F.monotonically_increasing_id()))
    order = ["g", F.asc_nulls_first("key"), "leaf", "tie"]
    ranged = settled.repartitionByRange(parts_of(settled.count(), least=1), *order).sortWithinPartitions(*order)
    ranged = ranged.select(F.spark_partition_id().alias("part"), "g", F.col("key").cast("string").alias("key"), "leaf", "changed")
    packed = cut(ranged.mapInArrow(_packer(size), _PIECES))
    counts = packed.select("g", "part", "piece", "n")
    parts = counts.groupBy("g", "part").agg(F.sum("n").alias("n"))
    along = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("g", "part", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("g")).alias("total"))
    inside = Window.partitionBy("g", "part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(parts, ["g", "part"]).select(
        "g", "part", "piece", (F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("start"), "total"
    )
    return spread_join(packed, offsets, ["g", "part", "piece"], F.xxhash64("part", "piece"), salts=1)


def _join(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def _climb(start: int, total: int, leaves: list[str]) -> Iterator[tuple[int, int, int, list[str], int, int]]:
    """(level, nodes of the level, first node here, nodes here, first and end of the runs that lie wholly here), upwards."""
    level, first, nodes = 0, start, leaves
    while True:
        end = first + len(nodes)
        low = -(-first // ARITY)
        high = -(-end // ARITY) if end == total else end // ARITY
        if total == 1 or high <= low:
            low = high = first // ARITY
        yield level, total, first, nodes, low, high
        if low == high:
            return
        nodes = [_join(nodes[max(0, r * ARITY - first) : (r + 1) * ARITY - first]) for r in range(low, high)]
        level, total, first = level + 1, -(-total // ARITY), low


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Pieces one by one: only one at a time is held as Python objects."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece the nodes that no whole run of it holds, and the runs (wanted) that it touches and can't build."""
    names = ["g", "part", "piece", "wanted", "level", "at", "total", "digest"]
    for batch in batches:
        out: list[tuple] = []
        for r in _rows(batch):
            one = (r["g"], r["part"], r["piece"])
            built = list(_climb(r["start"], r["total"], r["leaves"]))
            for level, total, first, nodes, low, high in built:
                inside = range(max(first, low * ARITY), min(first + len(nodes), high * ARITY))
                out += [(*one, False, level, first + i, total, x) for i, x in enumerate(nodes) if first + i not in inside]
            wholly = {level: (low, high) for level, _, _, _, low, high in built}
            a, b, total, level = r["start"], r["start"] + r["n"] - 1, r["total"], 0
            while total > 1:
                a, b = a // ARITY, b // ARITY
                low, high = wholly.get(level, (0, 0))
                out += [(*one, True, level, x, total, None) for x in sorted({a, b}) if not low <= x < high]
                level, total = level + 1, -(-total // ARITY)
        types = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        cols = list(zip(*out, strict=True)) if out else [[] for _ in types]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)


_RUNS = "g string, level int, run long, total long, digests array<string>, node string"


def _build(base: int):
    """The runs of levels base to base + TILE - 1 below one node, from the ragged nodes of these levels."""

    def run(rows: pa.Table) -> pa.Table:
        g = rows["g"][0].as_py()
        known: dict[tuple[int, int], dict[int, str]] = {}
        for level, at, total, x in zip(*(rows[c].to_pylist() for c in ("level", "at", "total", "digest")), strict=True):
            known.setdefault((level, total), {})[at] = x
        out = []
        for level in range(base, base + TILE):
            for (_, total), nodes in [x for x in known.items() if x[0][0] == level and x[0][1] > 1]:
                runs: dict[int, list[str]] = {}
                for at in sorted(nodes):
                    runs.setdefault(at // ARITY, []).append(nodes[at])
                made = {r: _join(x) for r, x in runs.items()}
                known.setdefault((level + 1, -(-total // ARITY)), {}).update(made)
                out += [(g, level, r, total, x, made[r]) for r, x in runs.items()]
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()]
        cols = list(zip(*out, strict=True)) if out else [[] for _ in types]
        return pa.table([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["g", "level", "run", "total", "digests", "node"])

    return run


def _finish(ragged: DataFrame, levels: int) -> DataFrame:
    """(g, level, run, total, digests, node) of every run that holds a ragged node (g, level, at, total, digest).

    One shuffle for TILE levels: ragged nodes, and those that the tiles below have made, meet by the coordinate of the
    node that all of them lead to, at most ARITY ** TILE of the lowest level and as many again in all others.
    """
    out = None
    below = ragged.select("g", "level", "at", "total", "digest").limit(0)
    for base in range(0, max(levels, 1), TILE):
        here = ragged.where(F.col("level").between(base, base + TILE - 1) & (F.col("total") > 1)).unionByName(below)
        tile = F.expr(f"`at` div cast(power({ARITY}, {base + TILE} - level) as bigint)").alias("tile")
        made = here.withColumn("tile", tile).groupBy("g", "tile").applyInArrow(_build(base), _RUNS)
        made = cut(made)
        above = F.expr(f"(total + {ARITY - 1}) div {ARITY}").alias("total")
        below = made.where((F.col("level") == base + TILE - 1) & (F.col("total") > ARITY)).select("g", F.lit(base + TILE).alias("level"), F.col("run").alias("at"), above, F.col("node").alias("digest"))
        out = made if out is None else out.unionByName(made)
    return out


def _walks(r: dict) -> tuple[str, Iterator[list[tuple[str, str]]]]:
    """The top of a piece's group, and for each row of the piece what stands left and right of its way there, by level."""
    runs: dict[tuple[int, int], list[str]] = {(x["level"], x["run"]): x["digests"] for x in r["runs"] or []}
    for level, _, first, nodes, low, high in _climb(r["start"], r["total"], r["leaves"]):
        for run in range(low, high):
            runs[level, run] = nodes[max(0, run * ARITY - first) : (run + 1) * ARITY - first]
    depth, total = 0, r["total"]
    while total > 1:
        depth, total = depth + 1, -(-total // ARITY)

    def walks() -> Iterator[list[tuple[str, str]]]:
        for at in range(r["start"], r["start"] + r["n"]):
            steps = []
            for level in range(depth):
                at, place = divmod(at, ARITY)
                nodes = runs[level, at]
                steps.append(("".join(nodes[:place]), "".join(nodes[place + 1 :])))
            yield steps

    return _join(runs[depth - 1, 0]) if depth else r["leaves"][0], walks()


def _fold(own: str, steps: list[tuple[str, str]]) -> str:
    for before, after in steps:
        own = sha256((before + own + after).encode()).hexdigest()
    return own


_PATHS = "key string, top string, steps array<struct<before: string, after: string>>"
_PROVED = "key string, leaf string, top string, root string, proof string, folded string"


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    for batch in batches:
        for r in _rows(batch):
            top, walks = _walks(r)
            steps = pa.array([[{"before": a, "after": b} for a, b in w] for w in walks], kind)
            yield pa.RecordBatch.from_arrays([pa.array(r["keys"], pa.string()), pa.array([top] * r["n"]), steps], names=["key", "top", "steps"])


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's proof through its group's tree and that of the groups, and what its changed leaf (or its own) leads to."""
    for batch in batches:
        for r in _rows(batch):
            top, walks = _walks(r)
            above = [(x["before"], x["after"]) for x in r["steps"]]
            proof, folded = [], []
            for leaf, changed, steps in zip(r["leaves"], r["changed"], walks, strict=True):
                steps += above
                proof.append(_join([x for step in steps for x in step]))
                folded.append(_fold(changed or leaf, steps))
            n = r["n"]
            cols = [r["keys"], r["leaves"], [top] * n, [r["root"]] * n, proof, folded]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["key", "leaf", "top", "root", "proof", "folded"])


def tree(packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packed with the runs that a piece touches and can't build, (g, top) of each group)."""
    edges = cut(packed.select("g", "part", "piece", "start", "total", "n", "leaves").mapInArrow(_edges, _EDGES))
    highest = edges.where("total > 1").agg(F.max("level")).head()[0]
    ragged = edges.where("not wanted").select("g", "level", "at", "total", "digest")
    runs = _finish(ragged, 1 + (highest or 0))
    tops = ragged.where("total = 1").select("g", F.col("digest").alias("top"))
    tops = tops.unionByName(runs.where(F.col("total") <= ARITY).select("g", F.col("node").alias("top")))
    wanted = edges.where("wanted").select("g", "part", "piece", "level", F.col("at").alias("run"))
    near = spread_join(wanted, runs.select("g", "level", "run", "digests"), ["g", "level", "run"], F.xxhash64("part", "piece"))
    near = near.groupBy("g", "part", "piece").agg(F.collect_list(F.struct("level", "run", "digests")).alias("runs"))
    return packed.join(near, ["g", "part", "piece"], "left"), tops


def proofs(leaves: DataFrame, size: int = PIECE_ROWS) -> DataFrame:
    """(key as text, leaf, top, root, proof, folded) for each row of leaves (g, key, leaf, changed).

    Each g has a tree of its leaves by key, nulls first; the tops of the groups by g have one as well, whose top is the
    root. proof is the digest of all siblings from the leaf to the root, level by level and left to right; folded is
    what these and the changed leaf (the own one where that is null) lead to.
    """
    rows, tops = tree(pieces(leaves, size))
    names = tops.select(F.lit("").alias("g"), F.col("g").alias("key"), F.col("top").alias("leaf"), F.lit(None).cast("string").alias("changed"))
    groups, _ = tree(pieces(names, size))
    upper = groups.mapInArrow(_paths, _PATHS).select(F.col("key").alias("g"), F.col("top").alias("root"), "steps")
    return spread_join(rows, cut(upper), ["g"], F.xxhash64("part", "piece")).mapInArrow(_prove, _PROVED)


def manifest(docs: DataFrame, size: int = PIECE_ROWS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of docs.

    A leaf is the digest of doc_id, source, lang, n_chars and text (see field). Each lang has a tree (subroot) of its
    leaves by doc_id; the subroots by lang, null first, have one as well (root). proof_sha256 is the digest of a row's
    siblings from the leaf to the root. Every row is proved: folded_root is what leaf and siblings lead to, verified
    whether that is the root. Where 3 divides the crc32 of the id, the leaf is that of a text with A to Z lower-cased,
    as if someone had changed the data; a text without such letters verifies even so.

    A null lang is a group of its own, apart from the empty one. Null ids come first in their group and are not
    tampered with; rows of one id are sorted by leaf, equal rows stand side by side, each in its own place. Null and
    empty values make different leaves. No rows give no rows. Other columns are not read.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rest = [field(doc_id), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars"))]
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0
    leaves = docs.select(
        F.concat(F.when(F.col("lang").isNull(), "0").otherwise("1"), F.coalesce(F.col("lang").cast("string"), F.lit(""))).alias("g"),
        doc_id.alias("key"),
        digest(*rest, field(text)).alias("leaf"),
        F.when(tampered, digest(*rest, field(lower))).alias("changed"),
    )
    return proofs(leaves, size).select(
        F.col("key").cast("long").alias("doc_id"),
        "leaf",
        F.col("top").alias("subroot"),
        "root",
        F.col("proof").alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
