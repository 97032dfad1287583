"""Exact n-gram Jaccard join by rare-first prefixes with length, positional and suffix filters.

Two sets of similarity t share an n-gram among the first |x| - ceil(t |x|) + 1 of either, in any order of all n-grams
that both use. The order puts n-grams of rare table places first: documents count into a table of fixed size by hash,
which is summed over all of them, so that frequent n-grams, whose place has a large count, stand last and in no prefix
unless a document has hardly others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm import links
from tidelane.llm.common import cut, small_batches
from tidelane.llm.words import SHINGLED_BYTES, mix, shingle_sets, shingles, slices, words

#: Places of the frequency table, 16 MB of classes whatever the corpus has, and those in one row of a partial sum.
PLACES, ROW_PLACES = 1 << 24, 1 << 12
#: Shingles that a task counts at once.
COUNTED = 1 << 20
#: Rows of a partial sum that a task hands on at once.
HANDED = 256
#: Tasks whose partial sums meet first.
FAN_IN = 256
#: Pivots of the suffix filter.
PIVOTS = 15

#: Shingles whose place counts no more are met where they are: by one shuffle to one task (see links.stars_by_length). As a
#: task counts up to 255, at most eight tasks' documents have one.
FEW = (1 << 11) - 1

_SKETCH = "doc_id long, n_shingles long, set_key binary, prefix array<long>, few int"


def prefix_length(n: np.ndarray | int, percent: int):
    """n - ceil(percent / 100 n) + 1."""
    return n + (-percent * n) // 100 + 1


def _packed(counts: np.ndarray) -> bytes:
    """A row of counts up to 255: bytes, or places (two bytes each) and counts of those above 0 where that is shorter."""
    at = np.flatnonzero(counts)
    return at.astype(np.uint16).tobytes() + counts[at].tobytes() if 3 * len(at) < ROW_PLACES else counts.tobytes()


def _add(total: np.ndarray, packed: bytes) -> None:
    if len(packed) == ROW_PLACES:
        total += np.frombuffer(packed, np.uint8)
    else:
        n = len(packed) // 3
        total[np.frombuffer(packed, np.uint16, n)] += np.frombuffer(packed, np.uint8, n, 2 * n)


def _counting(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(PLACES, np.uint8), [], 0

        def count() -> None:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            total[at] = np.minimum(total[at] + n, 255)
            held.clear()

        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0), SHINGLED_BYTES):
                h, _, bounds = words(data, offsets)
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    held.append((shingles(h[a:b], k) & np.uint64(PLACES - 1)).astype(np.int32))
                    size += len(held[-1])
                if size >= COUNTED:
                    count()
                    size = 0
        if held:
            count()
        rows = total.reshape(-1, ROW_PLACES)
        part = TaskContext.get().partitionId() // FAN_IN
        for a in range(0, len(rows), HANDED):
            at = a + np.flatnonzero(rows[a : a + HANDED].any(axis=1))
            cols = [pa.array(at.astype(np.int32)), pa.array(np.full(len(at), part, np.int32)), pa.array([_packed(rows[i]) for i in at], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "part", "counts"])

    return run


def _row(rows: pa.Table, counts: np.ndarray) -> pa.Table:
    return pa.table({"row": rows["row"].slice(0, 1), "part": rows["part"].slice(0, 1), "counts": pa.array([counts.tobytes()], pa.binary())})


def _sum(rows: pa.Table) -> pa.Table:
    total = np.zeros(ROW_PLACES, np.int64)
    for x in rows["counts"]:
        _add(total, x.as_py())
    return _row(rows, total.astype(np.uint32))


def _class(count: np.ndarray | int) -> np.ndarray:
    """Six classes for each doubling of the count."""
    return (6 * np.log2(1 + count)).astype(np.uint8)


def _classes(rows: pa.Table) -> pa.Table:
    total = np.zeros(ROW_PLACES, np.int64)
    for x in rows["counts"]:
        total += np.frombuffer(x.as_py(), np.uint32)
    return _row(rows, _class(total))


def frequency_classes(docs: DataFrame, k: int) -> Broadcast:
    """A broadcast table: for each place (the low bits of a shingle's hash) a class that grows with how many documents count there.

    A task counts up to 255 at a place; sums over tasks are exact.
    """
    schema = "row int, part int, counts binary"
    partial = docs.select("text").mapInArrow(_counting(k), schema).groupBy("row", "part").applyInArrow(_sum, schema)
    whole = partial.groupBy("row").applyInArrow(_classes, schema).toArrow()
    total = np.zeros((PLACES // ROW_PLACES, ROW_PLACES), np.uint8)
    for row, x in zip(whole["row"].to_pylist(), whole["counts"], strict=True):
        total[row] = np.frombuffer(x.as_py(), np.uint8)
    return docs.sparkSession.sparkContext.broadcast(total.ravel())


def _places(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return classes[(h & np.uint64(PLACES - 1)).astype(np.int64)]


def ranks(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A number of each shingle by which rare ones come first: its place's class, then bits of the hash."""
    low = h & np.uint64((1 << 52) - 1)
    return _places(h, classes).astype(np.uint64) << np.uint64(52) | low


def rare_first(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The set in the common order: by rank, then by the whole hash."""
    return h[np.lexsort((h, ranks(h, classes)))]


def _sketcher(k: int, percent: int, classes: Broadcast):
    least = _class(np.float64(FEW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, prefixes, few = [], [], [], []
            for x in shingle_sets(batch.column(1), k):
                counts.append(len(x))
                if len(x):
                    place = mix(x + np.arange(len(x), dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                    keys.append(np.array([np.add.reduce(place), np.bitwise_xor.reduce(x), len(x)], np.uint64).tobytes())
                    prefixes.append(head := rare_first(x, classes.value)[: prefix_length(len(x), percent)].view(np.int64))
                    few.append(int((_places(head.view(np.uint64), classes.value) <= least).sum()))
                else:
                    keys.append(None)
                    prefixes.append(np.zeros(0, np.int64))
                    few.append(0)
            ends = np.append(0, np.cumsum([len(x) for x in prefixes])).astype(np.int32)
            flat = pa.array(np.concatenate([*prefixes, np.zeros(0, np.int64)]))
            cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(few, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "set_key", "prefix", "few"])

    return run


def _sets(k: int, classes: Broadcast) -> links.Sets:
    return lambda column: (rare_first(x, classes.value) for x in shingle_sets(column, k))


def suffix_distance(a: np.ndarray, b: np.ndarray) -> int:
    """At least so many elements are in one of two sorted arrays alone: their sizes between pivots of the first differ by as many."""
    pivots = a[(np.arange(1, PIVOTS + 1) * len(a)) // (PIVOTS + 1)] if len(a) else a
    x = np.diff(np.concatenate([[0], np.searchsorted(a, pivots), [len(a)]]))
    y = np.diff(np.concatenate([[0], np.searchsorted(b, pivots), [len(b)]]))
    return int(np.abs(x - y).sum())


def joined(percent: int, classes: Broadcast) -> links.Compare:
    """Compare of sets in the common order: pairs that share a prefix n-gram pass three filters and are verified once.

    Length: the smaller set has percent of the larger one. Positional: with what follows the first shared n-gram in
    both, the overlap can reach what the similarity asks for. Suffix: so can it after what the sizes between pivots of
    the rest show to differ. Pairs that links connect already are not verified.
    """

    def compare(sets: list[np.ndarray], labels: np.ndarray, side: np.ndarray, alone: bool) -> list[tuple[int, int]]:
        n = np.array([len(x) for x in sets])
        heads = [x[: prefix_length(len(x), percent)] if len(x) else x for x in sets]
        flat = np.concatenate(heads)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in heads])
        place = np.concatenate([np.arange(len(x)) for x in heads])
        by = np.lexsort((owner, flat))
        flat, owner, place = flat[by], owner[by], place[by]
        rank: dict[int, np.ndarray] = {}
        out = []

        def rest(i: int, at: int) -> np.ndarray:
            if i not in rank:
                rank[i] = ranks(sets[i], classes.value)
            return rank[i][at + 1 :]

        for i in range(1 if alone else len(sets)):
            low, high = np.searchsorted(flat, heads[i], "left"), np.searchsorted(flat, heads[i], "right")
            runs = high - low
            at = np.repeat(low - np.append(0, np.cumsum(runs)[:-1]), runs) + np.arange(runs.sum())
            own = np.repeat(np.arange(len(heads[i])), runs)
            j, there = owner[at], place[at]
            ok = (j > i) & (labels[j] != labels[i]) & (side[j] != side[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))
            j, there, own = j[ok], there[ok], own[ok]
            j, first = np.unique(j, return_index=True)  # the first shared n-gram: own ascends
            there, own = there[first], own[first]
            need = -(-percent * (n[i] + n[j]) // (100 + percent))
            ok = 1 + np.minimum(n[i] - own - 1, n[j] - there - 1) >= need
            j, there, own, need = j[ok], there[ok], own[ok], need[ok]
            spare = (n[i] - own - 1) + (n[j] - there - 1) - 2 * (need - 1)
            ok = [suffix_distance(rest(i, a), rest(x, b)) <= s for x, a, b, s in zip(j.tolist(), own.tolist(), there.tolist(), spare.tolist(), strict=True)]
            j = j[np.array(ok, bool)]
            if not len(j):
                continue
            both = links.common(np.sort(sets[i]), [sets[x] for x in j])
            hits = j[100 * both >= percent * (n[j] + n[i] - both)]
            if len(hits):
                out += [(i, int(x)) for x in hits]
                links.merge(labels, i, hits)
        return out

    return compare


def _prefix_rows(lead: DataFrame, labels: DataFrame | None) -> DataFrame:
    lead = lead.withColumn("label", F.col("doc_id")) if labels is None else lead.join(labels, "doc_id")
    rows = lead.select(F.posexplode("prefix").alias("place", "key"), "doc_id", "label", "n_shingles", "few")
    return rows.select("key", "doc_id", "label", "n_shingles", "place", (F.col("place") < F.col("few")).alias("few"))


def ngram_join(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs, whose other columns are not read.

    Words are runs without ASCII white space, A to Z lower-cased; links join sets of distinct k-word n-grams (the whole
    sequence, where it is shorter) with 100 |a & b| >= percent |a | b|, and component_id is the least doc_id that they
    reach, itself included. n_shingles is the set's size. The join is exact on 64-bit hashes of n-grams.

    Equal sets enter the search once, by their least id. Empty and null texts have no n-gram and are linked with
    nothing. Rows with a repeated doc_id get a row each. A null doc_id is never linked; its component_id is null. No
    rows give no rows.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        classes = frequency_classes(ids, k)
        known = cut(ids.mapInArrow(_sketcher(k, percent, classes), _SKETCH))
        reps, copies = links.representatives(known)
        lead = known.join(reps.select("set_key", "doc_id"), ["set_key", "doc_id"], "left_semi").dropDuplicates(["doc_id", "set_key"])
        lead = cut(lead.select("doc_id", "n_shingles", "prefix", "few"))
        found = links.settle(lead, lambda labels: _prefix_rows(lead, labels), ids, _sets(k, classes), joined(percent, classes), percent, lengths=True)
        return links.expanded(known, reps, copies, found)
