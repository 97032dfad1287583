"""From candidate keys to connected groups: which documents of a key are linked, without all pairs of a key.

Documents that share a key (a table bucket, a prefix n-gram) may be linked. First every document is held against one
centre alone, the least id of the key that it shares most of, which settles groups of copies in linear work. What is
left are keys whose documents are not yet in one component; their documents are held against each other in blocks,
but for those that links already connect. So every pair of a key is decided, and each at most once a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelane.llm.common import BROADCAST_ROWS, cut, cut_with, join_frequent, lookup
from tidelane.llm.components import components, written

#: Shingles of one block of a group; a task holds two blocks.
BLOCK_SHINGLES = 1 << 19
#: Most ids of a group table that is broadcast to the texts, two numbers each.
MEMBER_ROWS = 500_000
#: Documents of one key and length up to which their pairs are listed.
PAIRED = 64
#: A document is held against a centre if it shares at least this part of the keys that a link asks for: of others that
#: they share another document may be the least one.
CENTRE_PART = 2

#: compare(sets, labels, side, alone): pairs of places whose sets are linked, enough to connect all that are. Sets with
#: equal labels are connected already, those of one side are not held against each other; alone: only place 0 against
#: the others.
Compare = Callable[[list[np.ndarray], np.ndarray, np.ndarray, bool], list[tuple[int, int]]]
#: The shingle sets of a column of texts.
Sets = Callable[[pa.ChunkedArray], Iterable[np.ndarray]]


def totals(count: str) -> tuple[Column, Column]:
    """Figures of a table for join_frequent: how many rows its keys have, all and at most."""
    return F.coalesce(F.sum(count), F.lit(0)).alias("total"), F.coalesce(F.max(count), F.lit(0)).alias("most")


def _met(rows: DataFrame) -> DataFrame:
    """(u, v) from rows (key, doc_id, label): for each key with several labels, its other documents u and the least one, v.

    Minima are pre-aggregated; keys of very many rows are joined by broadcast, others by a shuffle.
    """
    low = rows.groupBy("key").agg(F.min("doc_id").alias("v"), F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n"))
    low, seen = cut_with(low.where("a < b").select("key", "v", "n"), *totals("n"))
    near = join_frequent(rows.select("key", F.col("doc_id").alias("u")), low, ["key"], "n", seen["total"], seen["most"])
    return near.where("v < u").select("u", "v")


def stars(rows: DataFrame) -> DataFrame:
    """(u, v, shared) from rows (key, doc_id, label): how many keys of several labels u shares with v, the least document of the key."""
    return _met(rows).groupBy("u", "v").agg(F.count("*").alias("shared"))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each key, which come one after another; the first columns are the key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        if held and any(held[-1].column(i)[-1].as_py() != c[0] for i, c in enumerate(cols)):
            new[0] = True
        at = 0
        for b in np.flatnonzero(new):
            if b > at:
                held.append(batch.slice(at, b - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], b
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def common(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the others shares with own; own is sorted, none is empty."""
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, every), len(own) - 1)
    return np.add.reduceat((own[at] == every).astype(np.int64), np.append(0, np.cumsum([len(x) for x in others])[:-1]))


def merge(labels: np.ndarray, i: int, hits: np.ndarray) -> None:
    """Gives place i, the hits and all that are connected to them one label."""
    labels[np.isin(labels, labels[hits])] = labels[i]


def linked(percent: int) -> Compare:
    """Compare of sorted sets by 100 |a & b| >= percent |a | b|: each place against the later ones not connected to it."""

    def compare(sets: list[np.ndarray], labels: np.ndarray, side: np.ndarray, alone: bool) -> list[tuple[int, int]]:
        size, out = np.array([len(s) for s in sets]), []
        places = np.arange(len(sets))
        for i in range(1 if alone else len(sets)):
            near = places[i + 1 :]
            near = near[(labels[near] != labels[i]) & (side[near] != side[i]) & (size[near] > 0)]
            near = near[(100 * np.minimum(size[near], size[i]) >= percent * np.maximum(size[near], size[i]))]
            if not len(near):
                continue
            both = common(sets[i], [sets[j] for j in near])
            hits = near[100 * both >= percent * (size[near] + size[i] - both)]
            if len(hits):
                out += [(i, int(j)) for j in hits]
                merge(labels, i, hits)
        return out

    return compare


def _confirm(compare: Compare, sets_of: Sets):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 3):
            ids, centre = rows["doc_id"].to_numpy(), rows["centre"].to_numpy(zero_copy_only=False)
            order = np.lexsort((ids, ~centre))
            sets = list(sets_of(rows["text"]))
            sets = [sets[i] for i in order]
            side = rows["own"].to_numpy()[order] if rows["p"][0] != rows["q"][0] else np.arange(len(order))
            pairs = compare(sets, rows["label"].to_numpy()[order].copy(), side, bool(centre.any()))
            u, v = np.array(pairs, np.int64).reshape(-1, 2).T
            ids = ids[order]
            yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], names=["u", "v"])

    return run


def confirmed(texts: DataFrame, grouped: DataFrame, sets_of: Sets, compare: Compare, block: int = BLOCK_SHINGLES, star: bool = False) -> DataFrame:
    """Links (u, v) inside each group, enough to connect all documents that links of the group connect.

    texts: (doc_id, text); grouped: (doc_id, n_shingles, component, label, centre). With star every member of a group is
    held against its centre alone: the group is dealt into blocks of about `block` shingles, each with the centre. Else
    all pairs meet once, in tasks of one block or two, so that none grows with a group. Texts are shuffled, not sets,
    which are larger and don't compress.
    """
    figures = F.count("*").alias("rows"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("shingles")
    grouped, seen = cut_with(grouped.select("doc_id", "n_shingles", "component", "label", "centre"), *figures)
    if seen["shingles"] < block:
        dealt = grouped.withColumn("blocks", F.lit(1))
    else:
        big = grouped.groupBy("component").agg((F.sum("n_shingles") / F.lit(block)).cast("int").alias("more")).where("more > 0")
        if seen["shingles"] // block <= BROADCAST_ROWS:  # a big group has a block's shingles at least
            big = F.broadcast(big)
        dealt = grouped.join(big, "component", "left").withColumn("blocks", F.coalesce(F.col("more"), F.lit(0)) + 1)
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks").cast("long")).cast("int").alias("own")
    dealt = dealt.select("doc_id", "component", "label", "centre", "blocks", own)
    near = F.broadcast(dealt) if seen["rows"] <= MEMBER_ROWS else dealt.hint("shuffle_hash")
    rows = texts.join(near, "doc_id").select("text", "doc_id", "component", "label", "centre", "blocks", "own")
    # few bytes but much work: not left to the few tasks that a merged shuffle has
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    if star:
        z = F.when(F.col("centre"), every).otherwise(F.array("own"))
        pairs = rows.withColumn("p", F.explode(z)).withColumn("q", F.col("p"))
    else:
        pairs = rows.withColumn("z", F.explode(every)).withColumn("p", F.least("own", "z")).withColumn("q", F.greatest("own", "z"))
    pairs = pairs.select("component", "p", "q", "doc_id", "label", "centre", "own", "text")
    pairs = pairs.repartition(tasks, "component", "p", "q").sortWithinPartitions("component", "p", "q")
    return pairs.mapInArrow(_confirm(compare, sets_of), "u long, v long")


def _kind(percent: int) -> Column:
    """Lengths in classes of the ratio 100 to percent, the least bit wider; sets that can be linked are in one class or neighbouring ones."""
    return F.floor(F.log("n_shingles") / F.lit(math.log(100 / percent) * (1 + 1e-9)))


def by_length(rows: DataFrame, percent: int) -> DataFrame:
    """rows (key, doc_id, label, n_shingles) by key and length: twice each, so that two sets meet only if the smaller one can have percent of the larger."""
    kind = _kind(percent)
    return rows.withColumn("length", F.explode(F.array(kind, kind - 1))).select(F.xxhash64("key", "length").alias("key"), "doc_id", "label")


def stars_by_length(rows: DataFrame, percent: int) -> DataFrame:
    """stars of by_length. Rows may have `few`: true where few documents have the key, so that all of them fit a task.

    Such rows are shuffled once, by key, and are told apart by length only where their key is; the others are shuffled
    twice for each length.
    """
    if "few" not in rows.columns:
        return stars(by_length(rows, percent))
    near = rows.where("few").select("key", "doc_id", "label", _kind(percent).cast("int").alias("kind")).repartition("key")
    w = Window.partitionBy("key", "length")
    near = near.withColumn("length", F.explode(F.array(F.col("kind"), F.col("kind") - 1)))
    near = near.select(F.col("doc_id").alias("u"), F.min("doc_id").over(w).alias("v"), F.min("label").over(w).alias("a"), F.max("label").over(w).alias("b"))
    met = near.where("a < b and v < u").select("u", "v").unionByName(_met(by_length(rows.where("not few"), percent)))
    return met.groupBy("u", "v").agg(F.count("*").alias("shared"))


def _least_shared(m: Column, n: Column, percent: int) -> tuple[Column, Column]:
    """What sets of m and n elements share at least where they are linked: of all elements, and of their prefixes.

    Prefixes are the first n - ceil(percent / 100 n) + 1 in one order. What is shared beyond the prefix that ends first
    lies in the rest of that set, which is no longer than that of the longer set.
    """
    need = F.ceil(percent * (m + n) / F.lit(100 + percent))
    return need, need - F.ceil(percent * F.greatest(m, n) / F.lit(100)) + 1


def meeting(rows: DataFrame, percent: int) -> tuple[DataFrame, dict]:
    """rows (key, doc_id, n_shingles, place, few) by key and length as in by_length, where several documents meet.

    With `kind`, the row's own class of lengths, `met`, how many rows are of its key and length, and `least`, the least
    document of those; and how many rows have a greater `met` than PAIRED, `hot`.
    """
    rows = rows.select("key", "doc_id", F.col("n_shingles").cast("int").alias("n_shingles"), "place", "few").withColumn("kind", _kind(percent).cast("int"))
    lengths = F.explode(F.array(F.col("kind"), F.col("kind") - 1))
    w = Window.partitionBy("key", "length")
    near = rows.where("few").drop("few").repartition("key").withColumn("length", lengths)
    near = near.select("*", F.count("*").over(w).alias("met"), F.min("doc_id").over(w).alias("least"), F.max("doc_id").over(w).alias("last"))
    far = rows.where("not few").drop("few").withColumn("length", lengths)
    low = far.groupBy("key", "length").agg(F.count("*").alias("met"), F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last")
    low, seen = cut_with(low.withColumn("n", F.col("met")), *totals("met"))
    far = join_frequent(far, low, ["key", "length"], "n", seen["total"], seen["most"])
    return cut_with(near.unionByName(far).where("least < last").drop("last"), F.count_if(F.col("met") > PAIRED).alias("hot"))


def candidates(met: DataFrame, percent: int, hot: int) -> DataFrame:
    """Edges (u, v) that connect all documents of several labels that can be linked; met: as meeting returns, with label, keys in the places of a prefix.

    Pairs of one key and length are listed, and of them those are left whose prefixes share as many keys as a link asks
    for: far more than the one that documents share by chance, which in a large table nearly all do with some other. Keys of more
    than PAIRED documents count as shared; those with nothing else in common meet at the key's least document.
    """
    ahead = Window.partitionBy("key", "length").orderBy("doc_id").rowsBetween(1, PAIRED)
    others = F.collect_list(F.struct("doc_id", "label", "n_shingles", "place", "kind")).over(ahead)
    pairs = met.where(F.col("met") <= PAIRED).withColumn("others", others).withColumn("other", F.explode("others"))
    pairs = pairs.where("other.doc_id > doc_id and other.label <> label and least(other.kind, kind) = length")
    pairs = pairs.groupBy(F.col("other.doc_id").alias("u"), F.col("doc_id").alias("v"), F.col("other.n_shingles").alias("m"), F.col("n_shingles").alias("n"))
    pairs = pairs.agg(F.count("*").alias("shared"), F.min("other.place").alias("i"), F.min("place").alias("j"))
    need, heads = _least_shared(F.col("m").cast("long"), F.col("n").cast("long"), percent)
    can = F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) >= need
    alone = pairs.where((F.col("shared") >= heads) & can).select("u", "v")
    if not hot:
        return alone
    often = met.where(F.col("met") > PAIRED).select("key", "length", "doc_id", "label")
    low = often.groupBy("key", "length").agg(F.min("doc_id").alias("v"), F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n"))
    low, seen = cut_with(low.where("a < b").select("key", "length", "v", "n"), *totals("n"))
    if not seen["total"]:
        return alone
    often = join_frequent(often, low, ["key", "length"], "n", seen["total"], seen["most"]).where("v is not null")
    many = lookup(often.groupBy("doc_id").agg(F.countDistinct("key").alias("many")))
    for end in ("u", "v"):
        pairs = pairs.join(many.select(F.col("doc_id").alias(end), F.col("many").alias(f"{end}_hot")), end, "left")
    also = F.least(F.coalesce("u_hot", F.lit(0)), F.coalesce("v_hot", F.lit(0)))
    some = pairs.where((F.col("shared") + also >= heads) & (can | (also > 0))).select("u", "v")
    return some.unionByName(often.where("v < doc_id").select(F.col("doc_id").alias("u"), "v"))


def settle(
    lead: DataFrame,
    rows_of: Callable[[DataFrame | None], DataFrame],
    texts: DataFrame,
    sets_of: Sets,
    compare: Compare,
    percent: int,
    block: int = BLOCK_SHINGLES,
    lengths: bool = False,
) -> DataFrame:
    """(node, component) of all documents that are linked with another one.

    lead: (doc_id, n_shingles, ...); rows_of makes rows (key, doc_id, label, n_shingles) of the documents in labels
    (doc_id, label), or without labels of all, each its own label. Linked documents share a key. Those of one key and like length that the links with centres leave in different components
    are held against each other. With lengths, keys are taken by length for the centres, too: for keys that are shared by
    documents of any length. Rows then have place and few, their keys are those of prefixes, and those are held against
    each other that share enough of them (see candidates).
    """
    sizes = lead.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    rows = rows_of(None)
    if lengths:
        met, figures = meeting(rows, percent)
        edges = met.where("least < doc_id").groupBy(F.col("doc_id").alias("u"), F.col("least").alias("v")).agg(F.count("*").alias("shared"))
    edges = cut(edges if lengths else stars(rows))
    best = edges.groupBy(F.col("u").alias("doc_id")).agg(F.max_by("v", F.struct("shared", -F.col("v"))).alias("component"), F.max("shared").alias("shared"))
    if lengths:  # not held against what it shares a key with by chance
        near = best.join(sizes, "doc_id").join(sizes.select(F.col("doc_id").alias("component"), F.col("n_shingles").alias("n")), "component")
        best = near.where(CENTRE_PART * F.col("shared") >= _least_shared(F.col("n_shingles"), F.col("n"), percent)[1]).select("doc_id", "component")
    centres = best.select(F.col("component").alias("doc_id"), "component").distinct()
    grouped = best.select("doc_id", "component", F.lit(False).alias("centre")).unionByName(centres.withColumn("centre", F.lit(True))).join(sizes, "doc_id")
    first, linked_rows = written(confirmed(texts, grouped.withColumn("label", F.col("doc_id")), sets_of, compare, block, star=True))
    known = components(first, rows=linked_rows)
    nodes = edges.select(F.col("u").alias("doc_id")).unionByName(edges.select(F.col("v").alias("doc_id"))).distinct()
    label = F.coalesce("component", "doc_id").alias("label")
    labels, seen = cut_with(nodes.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", label), F.count("*").alias("rows"))
    near = F.broadcast(labels) if seen["rows"] <= BROADCAST_ROWS else labels
    left, left_rows = written(candidates(met.join(near, "doc_id"), percent, figures["hot"]) if lengths else stars_by_length(rows_of(near), percent))
    if not left_rows:
        return known
    groups = components(left, rows=left_rows).withColumnRenamed("node", "doc_id")
    rest = groups.join(labels, "doc_id").join(sizes, "doc_id").withColumn("centre", F.lit(False))
    return components(first.unionByName(confirmed(texts, rest, sets_of, compare, block)))


def expanded(known: DataFrame, reps: DataFrame, seen: dict, found: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of known (doc_id, n_shingles, set_key).

    reps: (set_key, doc_id, last, copies), the least and the greatest id of equal sets and their number; seen: how many
    copies there are, `total` and of one set at `most`; found: (node, component) of linked representatives. Frequent copies meet their representative by broadcast.
    """
    shared = reps.where("last > doc_id").select("set_key", F.col("doc_id").alias("rep"), "copies")
    rows = known.select("doc_id", "n_shingles", "set_key")
    copies = join_frequent(rows, shared, ["set_key"], "copies", seen["total"], seen["most"]).select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    out = copies.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def representatives(known: DataFrame) -> tuple[DataFrame, dict]:
    """(set_key, doc_id, last, copies): the least and greatest id of each set and how many rows have it; null ids and sets have none. With totals of copies."""
    some = known.where("doc_id is not null and set_key is not null")
    sets = some.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.count("*").alias("copies"))
    return cut_with(sets, *totals("copies"))
