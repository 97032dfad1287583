"""Phrase collocations: n-gram counts from suffix arrays of word ids, merged over all shards.

A shard is a few megabytes of text. Its words get ids, prefix doubling sorts the places of the text by the words that
follow, and each interval of neighbours whose common prefix has m words or more is an m-gram with its count. Counts of
all shards are summed by phrase; only those that reach the threshold go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelane.llm.common import cut, join_frequent, spread_join
from tidelane.llm.words import LOWER, mix, slices, words

#: Bytes of text in a shard, unless one piece alone is longer; a task holds some thirty times as many.
SHARD_BYTES = 2 << 20
#: Bits of the table of frequent phrases that sieves the next longer ones; a fixed size, whatever the corpus has.
SIEVE_BITS = 1 << 26
#: Parts in which a language's phrases are ranked before the best of each meet.
RANK_PARTS = 32
#: Tasks that sum counts, for each partition of a shuffle.
SUM_TASKS = 3

#: What parts pieces, and what parts the words of a piece (fixed values).
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
GAP = BREAK.copy()
GAP[[0x20, 9]] = True

_GRAMS = "lang string, size int, phrase string, n long"


def shards(column: pa.Array, most: int = SHARD_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts; a text longer than `most` bytes is cut between two pieces."""
    for row, end, data, offsets in slices(column, most):
        if end - row > 1 or len(data) <= most:
            yield row, data, offsets
            continue
        stops, at = np.flatnonzero(BREAK[data]), 0
        while at < len(data):
            k = int(np.searchsorted(stops, at + most))
            to = int(stops[k]) + 1 if k < len(stops) else len(data)
            yield row, data[at:to], np.array([0, to - at])
            at = to


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """The places sorted by the `depth` ids from each on, of which there are left[i]; doubling ranks 1, 2, 4 ... of them."""
    rank, known = ids, 1
    while known < depth and len(rank) and rank.max() < len(rank) - 1:
        at = np.flatnonzero(left > known)
        after = np.zeros(len(rank), np.int64)
        after[at] = rank[at + known] + 1
        rank = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)[1]
        known *= 2
    return np.argsort(rank, kind="stable")


def common_prefixes(ids: np.ndarray, left: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many ids, `depth` at most, each place of order shares with the one before; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    both = np.arange(1, len(order))
    for k in range(depth):
        a, b = order[both - 1], order[both]
        both = both[(left[a] > k) & (left[b] > k)]
        both = both[ids[order[both - 1] + k] == ids[order[both] + k]]
        out[both] += 1
    return out


def intervals(left: np.ndarray, order: np.ndarray, common: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each, count of each) of the n-grams of `size` ids."""
    first = np.flatnonzero(common < size)
    count = np.diff(np.append(first, len(order)))
    at = order[first]
    some = left[at] >= size
    return at[some], count[some]


def _hashes(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` words from each place on."""
    out = np.full(len(at), size, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[at + k] * np.uint64(0xA0761D6478BD642F))
    return out


class Shard:
    """The words of a shard: their hashes, ids, langs and how many words their piece has from each on."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> None:
        low = LOWER[data]
        self.h, length, bounds = words(data, offsets, GAP)
        n = len(self.h)
        place = np.flatnonzero(~GAP[low])
        ends = np.append(0, np.cumsum(length))
        text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(low[place])))
        self.text = text.dictionary_encode()
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        stops = np.cumsum(BREAK[low])[place[ends[:-1]]]
        first = np.flatnonzero(np.append(True, (np.diff(stops) > 0) | (np.diff(doc) > 0))) if n else np.zeros(0, np.int64)
        last = np.append(first[1:], n)[: len(first)]
        self.left = np.repeat(last, last - first) - np.arange(n)
        self.lang = codes[doc]
        self.ids = self.text.indices.to_numpy(zero_copy_only=False).astype(np.int64) + self.lang * len(self.text.dictionary)
        if n and int(self.ids.max()) >= 1 << 31:
            self.ids = np.unique(self.ids, return_inverse=True)[1]

    def sorted(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        order = suffix_array(self.ids, self.left, depth)
        return order, common_prefixes(self.ids, self.left, order, depth)

    def phrases(self, at: np.ndarray, size: int) -> pa.Array:
        parts = [self.text.dictionary.take(self.text.indices.take(pa.array(at + k))) for k in range(size)]
        return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if size > 1 else parts[0]


def _shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Shard]]:
    """(names of langs, shard) of batches (lang, text); shards without words are left out."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        codes = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for row, data, offsets in shards(batch.column(1)):
            shard = Shard(data, offsets, codes[row:])
            if len(shard.h):
                yield langs.dictionary, shard


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each shard's word pairs by hash."""
    for _, shard in _shards_of(batches):
        at, count = intervals(shard.left, *shard.sorted(2), 2)
        yield pa.RecordBatch.from_arrays([pa.array(_hashes(shard.h, at, 2).view(np.int64)), pa.array(count.astype(np.int64))], names=["h", "n"])


def _counter(sizes: list[int], sieve, width: int):
    """Counts of a shard's n-grams of these sizes, and under size 0 of its words if 1 is among them.

    sieve: a broadcast table of bits of frequent phrases of `width` words; n-grams that hold any other are left out.
    """

    def passing(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        ok = np.ones(len(at), bool)
        for shift in range(size - width + 1):
            x = _hashes(h, at + shift, width) & np.uint64(SIEVE_BITS - 1)
            ok &= (sieve.value[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) == 1
        return ok

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, shard in _shards_of(batches):
            order, common = shard.sorted(max(sizes))
            if 1 in sizes:
                some, count = np.unique(shard.lang, return_counts=True)
                yield _batch(names.take(pa.array(some)), 0, pa.array([""] * len(some)), count)
            for size in sizes:
                at, count = intervals(shard.left, order, common, size)
                ok = passing(shard.h, at, size)
                at, count = at[ok], count[ok]
                yield _batch(names.take(pa.array(shard.lang[at])), size, shard.phrases(at, size), count)

    return run


def _batch(lang: pa.Array, size: int, phrase: pa.Array, count: np.ndarray) -> pa.RecordBatch:
    cols = [lang.cast(pa.string()), pa.array(np.full(len(count), size, np.int32)), phrase.cast(pa.string()), pa.array(count.astype(np.int64))]
    return pa.RecordBatch.from_arrays(cols, names=["lang", "size", "phrase", "n"])


def _phrase_hashes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                h, _, bounds = words(data, offsets, GAP)
                yield pa.RecordBatch.from_arrays([pa.array(_hashes(h, bounds[:-1], size).view(np.int64))], names=["h"])

    return run


def _sieve(hashes: DataFrame):
    """A broadcast table of SIEVE_BITS bits in which every hash (h) has one."""
    low = F.col("h").bitwiseAND(F.lit(SIEVE_BITS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63)).cast("int"))
    found = hashes.select(F.shiftright(low, 6).cast("int").alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(SIEVE_BITS >> 6, np.uint64)
    table[found["at"].to_numpy()] = found["bit"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(table)


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """f, the sum of n, by keys.

    Rows are shuffled as shards make them: shards have few phrases in common, so that a table of a task's sums would be
    nearly as long and be held beside what is shuffled.
    """
    tasks = SUM_TASKS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *keys).groupBy(*keys).agg(F.sum("n").alias("f"))


def phrase_counts(docs: DataFrame, least: int = 10, most_words: int = 3) -> DataFrame:
    """(lang, size, phrase, f): how often each phrase of 1 to most_words words occurs, if `least` times or more.

    Size 0 has the number of all words of a lang, under an empty phrase. Texts are read once for counts of pairs by
    hash, then once for phrases of up to three words whose pairs are frequent, and once for each longer size.
    Hashes only sieve, and let too much pass where they meet; counts are of phrases.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))

    def counted(sizes: list[int], sieve, width: int) -> DataFrame:
        grams = _summed(rows.mapInArrow(_counter(sizes, sieve, width), _GRAMS), ["lang", "size", "phrase"])
        return cut(grams.where(F.col("f") >= F.when(F.col("size") == 0, 0).otherwise(least)))

    pairs = _summed(rows.mapInArrow(_pairs, "h long, n long"), ["h"]).where(F.col("f") >= least)
    out = now = counted([1, 2, 3][:most_words], _sieve(pairs), 2)
    for size in range(4, most_words + 1):
        now = counted([size], _sieve(now.where(F.col("size") == size - 1).select("phrase").mapInArrow(_phrase_hashes(size - 1), "h long")), size - 1)
        out = out.unionByName(now)
    return out


def _cuts(size: Column, ws: Column) -> Column:
    """Both sides of each cut of a phrase: (k, left, part)."""

    def at(k: Column) -> Column:
        first, rest = F.slice(ws, F.lit(1), k), F.slice(ws, k + 1, size - k)
        side = lambda left, x: F.struct(k.alias("k"), F.lit(left).alias("left"), F.array_join(x, " ").alias("part"))
        return F.array(side(True, first), side(False, rest))

    return F.flatten(F.transform(F.sequence(F.lit(1), size - 1), at))


def _inside(size: Column, ws: Column) -> Column:
    """The phrases of two words or more inside a longer one, each as often as it stands there."""
    shorter = F.sequence(F.lit(2), size - 1)
    return F.flatten(F.transform(shorter, lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice(ws, i, m), " "))))


def collocations(docs: DataFrame, least: int = 10, most_words: int = 3, share: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each lang by score, then a, then the phrase's bytes.

    Words are runs without space or tab in pieces between any of `. , ; : ! ?` and line ends, A to Z lower-cased. a is how
    often a phrase of 2 to most_words words occurs (`least` times or more), n how many words the lang has. A cut into two
    parts that occur l and r times scores floor(1000000 a a / (l r)); the least score counts, that of the first cut
    among equals. A phrase inside a longer one that occurs `share` percent as often or more is dropped.

    A null lang is `und`; null and empty texts have no words, repeated rows count each time, a null or repeated doc_id
    means nothing here, and other columns are not read. No rows, or no frequent phrase, give no rows.
    """
    counts = phrase_counts(docs, least, most_words)
    ws = F.split("phrase", " ")
    frequent = counts.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))
    parts = cut(frequent.select("lang", "phrase", "a", F.explode(_cuts(F.col("size"), ws)).alias("x")).select("lang", "phrase", "a", "x.k", "x.left", "x.part"))
    asked = parts.groupBy("lang", "part").agg(F.count("*").alias("asked"))
    known = asked.join(counts.where("size > 0").select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    met = join_frequent(parts, known, ["lang", "part"], "asked", parts.count())
    both = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    exact = "cast((cast(1000000 as decimal(7, 0)) * (cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0))) as bigint)"
    scored = both.withColumn("score", F.expr(exact)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    longer = frequent.where("size > 2").select("lang", "a", F.explode(_inside(F.col("size"), ws)).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    whole = scored.join(longer, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {share} * a")
    whole = whole.select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = whole.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return spread_join(best, totals, ["lang"], F.col("rank")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
