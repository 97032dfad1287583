"""Phrase collocations against counts in plain Python."""

from __future__ import annotations

import collections
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_ops import DOCS, ODD, SF
from tidelane.llm import queries
from tidelane.llm.collocations import collocations, common_prefixes, intervals, shards, suffix_array

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, least=10, most=3, share=50, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + m])) for m in range(1, most + 1) for i in range(len(ws) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = collections.Counter()
    for (lang, ws), a in found.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                inside[lang, ws[i : i + m]] = max(a, inside[lang, ws[i : i + m]])
    by = collections.defaultdict(list)
    for (lang, ws), a in found.items():
        cuts = [(1000000 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        if 100 * inside[lang, ws] < share * a:
            by[lang].append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in by.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


def result(df, **options):
    return sorted(map(tuple, collocations(df, **options).collect()))


def test_collocations_equal_plain_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.collect()]
    want = brute(rows)
    assert result(docs.repartition(3)) == want and len({x[0] for x in want}) == 4 and any(x[2].count(" ") == 2 for x in want)
    assert result(docs, least=3, most_words=4, share=80, top=50) == brute(rows, 3, 4, 80, 50)


def test_collocations_of_odd_rows(spark):
    rows = [*ODD, (7, "A b. a b\ta  b! A B c", None, "s", 1), (8, "a b c a b c a b c", "und", "s", 1), (9, "\x00 \u00a0x y\u2003z ., ,", "en", "s", 1)]
    df = spark.createDataFrame(rows * 4, DOCS).withColumn("phrase", F.lit(1)).withColumn("Rank", F.lit(2)).withColumn("n", F.lit(3))
    for least in (1, 10):
        want = brute([(r[2], r[1]) for r in rows * 4], least)
        assert result(df, least=least) == want and want
    assert result(df.limit(0)) == result(df.where("text = 'one'").limit(3)) == []


@pytest.mark.parametrize("seed", range(4))
def test_intervals_count_every_ngram(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 9, 60)
    left = np.concatenate([np.arange(s, 0, -1) for s in sizes])
    ids = rng.integers(0, 3, len(left))
    order = suffix_array(ids, left, 5)
    assert sorted(order) == list(range(len(ids)))
    common = common_prefixes(ids, left, order, 5)
    for m in range(1, 6):
        want = collections.Counter(tuple(ids[i : i + m]) for i in range(len(ids)) if left[i] >= m)
        at, count = intervals(left, order, common, m)
        assert {tuple(ids[i : i + m]): c for i, c in zip(at, count, strict=True)} == want and len(at) == len(want)


def test_shards_cut_long_texts_between_pieces():
    texts = ["a b c. d e, " * 40, "", None, "x" * 300, "no stop in here " * 30 + ". end", "y"]
    got = collections.defaultdict(str)
    for row, data, offsets in shards(pa.array(texts), 50):
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            got[row + i] += data[a:b].tobytes().decode() + "|"
    assert "".join(got.values()).replace("|", "") == "".join(t or "" for t in texts)
    assert all(x[-1] in ".," for x in got[0].split("|")[:-2]) and got[0].count("|") > 5 and got[4].count("|") == 2


def test_counts_of_shards_are_shuffled_without_a_table_of_sums(spark, monkeypatch):
    """A task that makes counts holds no sums; those that sum are more than a shuffle's partitions."""
    from tidelane.llm import collocations as C

    plans = []
    monkeypatch.setattr(C, "cut", lambda df, cut=C.cut: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    monkeypatch.setattr(C, "_sieve", lambda hashes, sieve=C._sieve: plans.append(hashes._jdf.queryExecution().executedPlan().toString()) or sieve(hashes))
    docs = spark.createDataFrame([(i, "a b c. a b, d e", "en", "s", 1) for i in range(20)], DOCS)
    assert sorted((r.size, r.phrase, r.f) for r in C.phrase_counts(docs).collect() if r.size > 1) == [(2, "a b", 40), (2, "b c", 20), (2, "d e", 20), (3, "a b c", 20)]
    assert len(plans) == 2
    for plan in plans:
        above, below = plan.split("Exchange hashpartitioning")
        assert "Aggregate" in above and "MapInArrow" in below and "Aggregate" not in below


def test_collocations_sql_equals_plain_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(db.execute(queries.ORACLE_SQL["op12_collocations"]).fetchall()) == brute([(r.lang, r.text) for r in docs])
