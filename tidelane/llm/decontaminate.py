"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact shingle similarity."""

from __future__ import annotations

from functools import partial
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import checkpointed as cut
from tidelane.llm.common import let, spread_join

#: Words of a shingle.
SHINGLE = 5
#: A fingerprint has BANDS blocks of BAND_BITS bits. Two fingerprints that differ in at most RADIUS bits differ in at
#: most RADIUS // BANDS of one block, so that looking up each block's neighbours finds every pair within RADIUS.
BANDS, BAND_BITS, RADIUS = 4, 16, 15
#: Most rows of a table that is broadcast, rows of a few numbers each; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Window starts of one segment; a segment's words are these and one window more.
SEGMENT = 128
#: Two counters of 32 bits in a long: a word's bits g and g + 32.
_LANES, _LOW = 32, (1 << 32) - 1


def text_words(text: Column) -> Column:
    """Lower-cased runs without ASCII white space; null has none."""
    t = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.filter(F.split(t, r"[ \t-\r]+"), lambda w: w != "")


def shingle_hashes(words: Column, k: int = SHINGLE) -> Column:
    """The hash of the k words from each place on, in order; too few words give none."""

    def of(w: Column) -> Column:
        n = F.size(w)
        some = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(n >= k, some).otherwise(F.array().cast("array<bigint>"))

    return let(words, of)


def item_shingles(words: Column) -> Column:
    """An item's (or window's) shingles: those of SHINGLE words, or the whole sequence as one where it is shorter."""
    short = F.when(F.size(words) == 0, F.array().cast("array<bigint>"))
    for n in range(1, SHINGLE):
        short = short.when(F.size(words) == n, shingle_hashes(words, n))
    return short.otherwise(shingle_hashes(words))


def window_prints(words: Column, length: Column) -> Column:
    """SimHash of each run of `length` words in order: bit b is set where more than half of the words' hashes have it.

    Rolling: counts of each bit are summed along the words once, two to a long, and a window's are the difference of
    two sums. Fewer words than that make one window.
    """

    def of(hashes: Column) -> Column:
        step = lambda sums, bits: F.concat(sums, F.array(F.element_at(sums, -1) + bits))
        two = lambda h, g: F.call_function("shiftrightunsigned", h, g).bitwiseAND(F.lit((1 << 32) | 1))
        return F.transform(
            F.sequence(F.lit(0), F.lit(_LANES - 1)),
            lambda g: F.aggregate(hashes, F.array(F.lit(0).cast("bigint")), lambda sums, h: step(sums, two(h, g))),
        )

    def prints(sums: Column) -> Column:
        n = F.size(words)
        size = F.least(n, length)
        one = lambda yes, at: F.when(yes, F.call_function("shiftleft", F.lit(1).cast("bigint"), at)).otherwise(F.lit(0).cast("bigint"))

        def bits(both: Column, g: Column) -> Column:
            low = both.bitwiseAND(F.lit(_LOW))
            high = F.shiftrightunsigned(both, 32)
            return one(2 * low > size, g).bitwiseOR(one(2 * high > size, g + 32))

        def window(s: Column) -> Column:
            parts = F.transform(sums, lambda lane, g: bits(F.get(lane, s + size) - F.get(lane, s), g))
            return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))

        return F.transform(F.sequence(F.lit(0), n - size), window)

    return let(of(F.transform(words, lambda w: F.xxhash64(w))), prints)


def simhash(words: Column) -> Column:
    """The fingerprint of all the words."""
    return F.get(window_prints(words, F.size(words)), 0)


def _bands(fp: Column) -> Column:
    mask = F.lit((1 << BAND_BITS) - 1).cast("bigint")
    return F.array(
        *[
            F.struct(
                F.lit(b).alias("band"),
                F.shiftrightunsigned(fp, b * BAND_BITS).bitwiseAND(mask).cast("int").alias("value"),
            ) for b in range(BANDS)
        ]
    )


def _near(radius: int) -> Column:
    """Every pattern of at most `radius` flipped bits of a band."""
    masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(BAND_BITS), r)]
    return F.array(*[F.lit(m) for m in masks])


def hamming_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(length, fp, r, bits) of all fingerprints (length, fp) and (length, r, fp) of one length at most RADIUS bits apart.

    The right side is indexed with the neighbours of its bands; each left fingerprint looks up BANDS keys. Windows meet
    only items of their own size, so that a key is of length, band and value.
    """
    index = right.select("length", "r", F.col("fp").alias("rfp"), F.explode(_bands(F.col("fp"))).alias("x"))
    index = index.select("length", "r", "rfp", "x.band", "x.value", F.explode(_near(RADIUS // BANDS)).alias("m"))
    index = index.select("length", "r", "rfp", "band", F.col("value").bitwiseXOR(F.col("m")).alias("value"))
    probes = left.select("length", "fp", F.explode(_bands(F.col("fp"))).alias("x")).select("length", "fp", "x.band", "x.value")
    met = probes.join(index, ["length", "band", "value"]).withColumn("bits", F.bit_count(F.col("fp").bitwiseXOR(F.col("rfp"))))
    return met.where(F.col("bits") <= RADIUS).select("length", "fp", "r", "bits").distinct()


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the lesser counts over the sum of the greater ones of two shingle lists; null if both are empty."""
    count = lambda xs, s: F.size(F.filter(xs, lambda x: x == s))
    single = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    shared = F.array_intersect(a, b)
    both = F.when(single, F.size(shared)).otherwise(F.aggregate(shared, F.lit(0), lambda t, s: t + F.least(count(a, s), count(b, s))))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ > 0, both / all_)


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("shuffle_hash")


def _counted_shingles(k: int, words: Column) -> Column:
    return F.struct(F.size(words).alias("n"), shingle_hashes(words, k).alias("hs"))


def _segments(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, key, length, chunk, first, last): starts of the windows of an item's length that hold one of its shingles.

    A shingle at a place of a document that some item of `length` words has lies in the windows that start up to
    length - SHINGLE places before it. Starts are gathered in chunks of SEGMENT, from the first to the last in each.
    """
    known = items.select(F.explode("sh").alias("h"), "length").distinct()
    sizes = [r["k"] for r in items.select(F.least("length", F.lit(SHINGLE)).alias("k")).distinct().collect()]  # SHINGLE of them at most
    out = None
    for k in sorted(sizes):
        mine = known.where(F.least("length", F.lit(SHINGLE)) == k)
        both = partial(_counted_shingles, k)
        marked = rows.select("doc_id", "key", let(text_words(F.col("text")), lambda w: both(w)).alias("x"))
        grams = marked.select("doc_id", "key", F.col("x.n").alias("n"), F.posexplode("x.hs").alias("pos", "h"))
        lengths = mine.groupBy("h").agg(F.collect_set("length").alias("lengths"))  # as many as items have sizes
        met = spread_join(grams, lengths, ["h"], F.xxhash64("doc_id", "pos"), BROADCAST_ROWS)
        hits = met.select("doc_id", "key", "n", "pos", F.explode("lengths").alias("length"))
        first = F.greatest(F.col("pos") - F.col("length") + k, F.lit(0))
        last = F.greatest(F.least(F.col("pos"), F.col("n") - F.col("length")), F.lit(0))
        placed = hits.select("doc_id", "key", "length", F.least(first, last).alias("first"), last.alias("last"))
        chunk = F.explode(F.sequence(F.expr(f"first div {SEGMENT}"), F.expr(f"last div {SEGMENT}"))).alias("chunk")
        dealt = placed.distinct().select("*", chunk)
        low, high = F.greatest("first", F.col("chunk") * SEGMENT), F.least("last", F.col("chunk") * SEGMENT + SEGMENT - 1)
        some = dealt.groupBy("doc_id", "key", "length", "chunk").agg(F.min(low).cast("int").alias("first"), F.max(high).cast("int").alias("last"))
        out = some if out is None else out.unionByName(some)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, bits, similarity, text_key) for each document and item with a window of that similarity.

    A window is a run of an item's number of words, or the whole text where that is shorter. Every window that holds a
    shingle of some item of its size is fingerprinted (no other one has a similarity above 0); its fingerprint is
    looked up among those of the items of its size, and pairs within RADIUS bits are held against each other on
    five-word shingles with their counts. Of the windows of a document and item the most similar is returned, the
    first among equals. text_key is xxhash64 of the text.

    Fingerprints are of words, since one edited word changes five shingles. Windows with one fingerprint are looked up
    once, and equal ones are verified once. Items of fewer than five words have their whole sequence as one shingle.
    Null and empty texts and items match nothing. Rows with equal doc_id and text count once; null ids are kept as
    null. Other columns are not read.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.select("item_id", "words", F.size("words").alias("length"), item_shingles(F.col("words")).alias("sh")).distinct()
    items = cut(items.select(F.monotonically_increasing_id().alias("r"), "*", simhash(F.col("words")).alias("fp")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))
    placed = _segments(rows, items)
    if placed is None:  # no item has a word
        return docs.sparkSession.createDataFrame([], _LEAKS)
    placed = cut(placed)
    in_docs = placed.groupBy(F.col("doc_id").alias("d_"), F.col("key").alias("k_")).agg(F.collect_list(F.struct("length", "first", "last")).alias("at"))
    found = rows.join(_maybe_broadcast(in_docs, placed.count()), (F.col("key") == F.col("k_")) & F.col("doc_id").eqNullSafe(F.col("d_")))
    # words are cut out before anything is copied or shuffled, so that no row holds more of a text than its segment
    words = let(text_words(F.col("text")), lambda ws: F.transform("at", lambda w: F.struct(w["length"].alias("length"), w["first"].alias("first"), F.slice(ws, w["first"] + 1, w["last"] - w["first"] + w["length"]).alias("words"))))
    found = found.select("doc_id", "key", F.explode(words).alias("w")).select("doc_id", "key", "w.*")
    # few bytes but much work: not left to the few tasks that a merged shuffle has; rows of one id and text meet there
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.repartition(tasks, "doc_id", "key", "length", "first").dropDuplicates(["doc_id", "key", "length", "first"])
    segments = cut(found.select(F.monotonically_increasing_id().alias("segment"), "doc_id", "key", "length", "first", "words"))
    windows = segments.select("segment", "length", F.posexplode(window_prints(F.col("words"), F.col("length"))).alias("at", "fp"))
    windows = cut(windows)
    pairs = hamming_pairs(windows.select("length", "fp").distinct(), items.select("length", "r", "fp"))
    near = pairs.groupBy("length", "fp").agg(F.collect_list(F.struct("r", "bits")).alias("near"))  # items of one size near one fingerprint
    met = spread_join(windows, near, ["length", "fp"], F.xxhash64("segment", "at"), BROADCAST_ROWS).join(segments, ["segment", "length"])
    start, part = (F.col("first") + F.col("at")).alias("start"), F.slice("words", F.col("at") + 1, F.col("length")).alias("words")
    met = met.select("doc_id", "key", start, part, F.explode("near").alias("x")).select("doc_id", "key", "start", "words", "x.r", "x.bits")
    met = cut(met.withColumn("l", F.sha2(F.array_join("words", " ").cast("binary"), 256)))
    known = met.groupBy("l", "r").agg(F.first("words").alias("words")).select("l", "r", item_shingles(F.col("words")).alias("a"))
    verified = (
        known.join(items.select("r", "item_id", F.col("sh").alias("b")), "r")
        .select("l", "r", "item_id", weighted_similarity(F.col("a"), F.col("b")).alias("similarity"))
        .where(F.col("similarity") >= similarity)
    )
    starts = met.select("doc_id", "key", "start", F.size("words").alias("n"), "bits", "l", "r")
    out = spread_join(starts, verified, ["l", "r"], F.xxhash64("doc_id", "key", "start"), BROADCAST_ROWS)
    best = out.groupBy("doc_id", "key", "item_id").agg(
        F.max_by(F.struct("start", "n", "bits", "similarity"), F.struct("similarity", -F.col("start"), -F.col("bits"))).alias("x")
    )
    return best.select(
        "doc_id",
        "item_id",
        F.col("x.start").cast("long").alias("first_word"),
        F.col("x.n").cast("long").alias("n_words"),
        F.col("x.bits").cast("int").alias("bits"),
        F.col("x.similarity").alias("similarity"),
        F.col("key").alias("text_key"),
    )


_LEAKS = "doc_id long, item_id long, first_word long, n_words long, bits int, similarity double, text_key long"
