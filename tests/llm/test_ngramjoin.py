"""The n-gram join and its filters against brute force."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_ops import DOCS, ODD, SF, brute_components
from tidelane.llm import links, queries
from tidelane.llm.ngramjoin import PLACES, joined, ngram_join, prefix_length, ranks, rare_first, suffix_distance


class Held:
    """Stands for a broadcast."""

    def __init__(self, value):
        self.value = value


def edited(seed, n=80, size=120, most=4):
    """Near copies of one text; pairs of copies are about as similar as the threshold asks for."""
    rng = random.Random(seed)
    base = [f"word{rng.randint(0, 400)}" for _ in range(size)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"new{i}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k", [1, 3])
def test_join_equals_brute_force(spark, k):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    texts |= {10_000 + i: t for i, t in enumerate(edited(k))} | {20_000: "", 20_001: " \t", 20_002: "Word a", 20_003: "word A", 20_004: "word a x", 20_005: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(df, k, 90).collect()}
    assert got == brute_components(texts, k, 90)


def test_join_of_odd_rows(spark):
    df = spark.createDataFrame(ODD * 2, DOCS).withColumn("label", F.lit("mine")).withColumn("Prefix", F.lit(1)).withColumn("key", F.lit(1))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (None, 1, None), (4, 1, 4), (5, got_size(5), 5)] * 2, key=repr)
    assert ngram_join(df.limit(0)).count() == 0


def got_size(doc_id):
    w = next(r[1] for r in ODD if r[0] == doc_id).lower().split()
    return len({tuple(w[i : i + 3]) for i in range(len(w) - 2)})


def brute_pairs(sets, percent):
    n = range(len(sets))
    return {(i, j) for i in n for j in n if i < j and 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}


@pytest.mark.parametrize("seed", range(6))
def test_filters_lose_no_pair(seed):
    """Every pair of sets, each in a label of its own and merged by none, at several thresholds and frequencies."""
    rng = np.random.default_rng(seed)
    classes = rng.integers(0, 200, PLACES).astype(np.uint8)
    pool = rng.integers(0, 2**63, 70, dtype=np.uint64)
    sets = [np.sort(rng.choice(pool, rng.integers(1, 60), replace=False)) for _ in range(40)]
    for i in range(40):  # near copies
        keep = rng.random(len(sets[i])) > 0.04
        sets.append(np.sort(np.append(sets[i][keep], rng.integers(0, 2**63, rng.integers(0, 3), dtype=np.uint64))))
    sets = [rare_first(x, classes) if len(x) else x for x in sets]
    for percent in (60, 80, 90):
        got = {p for i in range(len(sets)) for p in joined(percent, Held(classes))([sets[i], *sets[i + 1 :]], np.arange(len(sets) - i), np.arange(len(sets) - i), True)}
        alone = [
            joined(percent, Held(classes))([sets[i], sets[j]], np.arange(2), np.arange(2), False) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i]) and len(sets[j])
        ]
        want = brute_pairs([np.sort(x) for x in sets], percent) if all(map(len, sets)) else None
        assert got
        if want is not None:
            assert sum(map(len, alone)) == len(want)
        every = joined(percent, Held(classes))(sets, np.arange(len(sets)), np.arange(len(sets)), False)
        plain = links.linked(percent)([np.sort(x) for x in sets], np.arange(len(sets)), np.arange(len(sets)), False)
        assert groups(every, len(sets)) == groups(plain, len(sets))


def groups(pairs, n):
    root = list(range(n))
    for i, j in pairs:
        a, b = root[i], root[j]
        root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_suffix_distance_is_a_lower_bound():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = (np.sort(rng.choice(200, rng.integers(0, 80), replace=False)).astype(np.uint64) for _ in range(2))
        assert suffix_distance(a, b) <= len(np.setxor1d(a, b))
    assert suffix_distance(np.arange(50, dtype=np.uint64), np.arange(100, 150, dtype=np.uint64)) >= 90


def test_prefixes_are_rare_first():
    classes = np.zeros(PLACES, np.uint8)
    h = np.arange(1, 101, dtype=np.uint64) << np.uint64(24) | np.arange(100, dtype=np.uint64)
    classes[:50] = 9
    order = rare_first(h, classes)
    assert set(order[:50]) == set(h[50:]) and (np.diff(ranks(order, classes).astype(float)) >= 0).all()
    assert [prefix_length(n, 90) for n in (1, 9, 10, 11, 100)] == [1, 1, 2, 2, 11]


def test_join_sql_equals_brute_force():
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    texts = dict(db.execute("SELECT doc_id, text FROM documents").fetchall())
    got = {i: (n, c) for i, n, c in db.execute(queries.ORACLE_SQL["op11_ngramjoin"]).fetchall()}
    assert got == brute_components(texts, 3, 90)


def test_keys_of_few_documents_meet_by_one_shuffle(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(40), i, i // 3, rng.randrange(1, 60)) for i in range(300)]
    df = spark.createDataFrame(rows, "key long, doc_id long, label long, n_shingles long")
    marked = df.withColumn("few", F.col("key") % 3 > 0)
    got = links.stars_by_length(marked, 90)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in links.stars(links.by_length(df, 90)).collect()}
    # what is told apart by length is dealt by key alone
    plan = links.stars_by_length(marked.where("few"), 90)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key#" in plan and "hashpartitioning(key#" in next(x for x in plan.splitlines() if "REPARTITION_BY_COL" in x)


def test_few_counts_prefix_places():
    import pyarrow as pa

    from tidelane.llm.ngramjoin import FEW, _class, _sketcher
    from tidelane.llm.words import shingle_sets

    x = next(iter(shingle_sets(pa.chunked_array([pa.array([" ".join(f"w{i}" for i in range(102))])]), 3)))
    classes = np.full(PLACES, _class(FEW + 1000), np.uint8)
    classes[(x[:3] & np.uint64(PLACES - 1)).astype(np.int64)] = _class(FEW)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(f"w{i}" for i in range(102))])], names=["doc_id", "text"])
    out = next(_sketcher(3, 90, Held(classes))(iter([batch]))).to_pylist()[0]
    assert (out["few"], len(out["prefix"]), out["n_shingles"]) == (3, 11, 100)


def test_counting_task_holds_little_memory():
    """A task's arrays beside its table do not follow the number of shingles, and partial sums are handed on in parts."""
    import tracemalloc
    from unittest.mock import patch

    import pyarrow as pa

    from tidelane.llm import ngramjoin

    rng = np.random.Generator(np.random.PCG64(3))
    texts = pa.array([" ".join(rng.integers(0, 10**6, 50_000).astype(str)) for _ in range(70)])
    batches = [pa.RecordBatch.from_arrays([texts.slice(i, 1)], names=["text"]) for i in range(len(texts))]
    tracemalloc.start()
    total, most = 0, 0
    with patch.object(ngramjoin.TaskContext, "get") as task:
        task.return_value.partitionId.return_value = 0
        for out in ngramjoin._counting(3)(iter(batches)):
            most = max(most, out.num_rows)
            for x in out["counts"]:
                counts = np.zeros(ngramjoin.ROW_PLACES, np.int64)
                ngramjoin._add(counts, x.as_py())
                total += counts.sum()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 70 * 49_998
    assert most <= 256
    assert peak < 80e6


def test_texts_reach_workers_in_small_batches(spark, monkeypatch):
    import pyarrow as pa

    from tidelane.llm import minhash, ngramjoin
    from tidelane.llm.common import BATCH_BYTES, BATCH_SETTING, small_batches

    df = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence(F.col("id"), F.col("id") + 600)).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    with small_batches(spark):
        got = [r.n for r in df.mapInArrow(sizes, "n long").collect()]
    assert len(got) > 1 and max(got) < 1.2 * BATCH_BYTES
    assert spark.conf.get(BATCH_SETTING, None) is None

    class Seen(Exception):
        pass

    def seen(*_):
        raise Seen(spark.conf.get(BATCH_SETTING, None))

    monkeypatch.setattr(ngramjoin, "frequency_classes", seen)
    monkeypatch.setattr(minhash, "sketches", seen)
    for run in (ngramjoin.ngram_join, minhash.near_duplicates):
        with pytest.raises(Seen, match=str(BATCH_BYTES)):
            run(df)
        assert spark.conf.get(BATCH_SETTING, None) is None
    spark.conf.set(BATCH_SETTING, "1m")  # a lower setting stays
    try:
        with small_batches(spark):
            assert spark.conf.get(BATCH_SETTING) == "1m"
        assert spark.conf.get(BATCH_SETTING) == "1m"
    finally:
        spark.conf.unset(BATCH_SETTING)


def chained(n=60, size=60):
    """Texts that share a quarter of their words with the next one; none are linked."""
    return [" ".join([*(f"a{i}x{j}" for j in range(20)), *(f"w{i}x{j}" for j in range(size)), *(f"a{i + 1}x{j}" for j in range(20))]) for i in range(n)]


def test_ngrams_shared_by_chance_make_no_group(spark, monkeypatch):
    """What a document shares with others by chance connects most of a large table; texts are not held against all of that."""
    from tidelane.llm import ngramjoin

    # as where a table is so large that its places count alike
    monkeypatch.setattr(ngramjoin, "frequency_classes", lambda docs, k: docs.sparkSession.sparkContext.broadcast(np.zeros(PLACES, np.uint8)))
    held, confirmed = [], links.confirmed

    def seen(texts, grouped, *args, **kwargs):
        held.append(grouped.count())
        return confirmed(texts, grouped, *args, **kwargs)

    monkeypatch.setattr(links, "confirmed", seen)
    texts = dict(enumerate([*chained(), *edited(9, 30)]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(df).collect()}
    assert got == brute_components(texts, 3, 90)
    assert len(held) == 2 and held[1] <= 40, held  # of 30 near copies and 60 chained texts


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("paired", [2, 5, 64])
def test_candidates_lose_no_link(spark, monkeypatch, few, paired):
    """Linked sets are connected, whether keys are rare or not, by pairs or at a key's least document; repeated ids have several sets."""
    monkeypatch.setattr(links, "PAIRED", paired)
    rng = np.random.default_rng(paired)
    sets = []
    for size in (3, 8, 12, 40, 120):
        base = rng.choice(10**6, size, replace=False)
        for _ in range(12):  # some parts are left out, some added: sizes differ by up to a tenth
            keep = base[rng.permutation(size)[: size - rng.integers(0, size // 10 + 1)]]
            sets.append(np.union1d(keep, rng.integers(10**6, 2 * 10**6, rng.integers(0, size // 20 + 1))))
    ids = [i % 50 for i in range(len(sets))]  # the last ten ids are those of other sets, too
    rows = [(int(k), i, len(x), place) for i, x in zip(ids, sets, strict=True) for place, k in enumerate(x[: prefix_length(len(x), 90)])]
    df = spark.createDataFrame(rows, "key long, doc_id long, n_shingles long, place int").withColumn("few", F.lit(few) & (F.col("key") % 7 > 0))
    met, seen = links.meeting(df, 90)
    edges = {(r.u, r.v) for r in links.candidates(met.withColumn("label", F.col("doc_id")), 90, seen["hot"]).collect()}
    root = groups(edges, 50)
    want = {(ids[i], ids[j]) for i, j in brute_pairs(sets, 90)}
    assert len(want) > 60 and all(root[i] == root[j] for i, j in want)
    assert len(set(root)) >= 4  # repeated ids join the first and the last base, others stay apart
