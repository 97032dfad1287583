"""Merkle manifests against trees built in plain Python."""

from __future__ import annotations

import collections
import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.test_ops import DOCS, ODD, SF
from tidelane.llm import queries
from tidelane.llm.merkle import manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def steps(tree, i):
    out = []
    for nodes in tree[:-1]:
        a = i // 8 * 8
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 8])))
        i //= 8
    return out


def brute(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        values = [r.doc_id, r.source, r.lang, r.n_chars]
        leaf = digest(*map(field, [*values, r.text]))
        tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        own = digest(*map(field, [*values, lower(r.text)])) if tampered else leaf
        groups["0" if r.lang is None else "1" + r.lang].append(((r.doc_id is not None, r.doc_id or 0, leaf), r.doc_id, leaf, own))
    names = sorted(groups, key=str.encode)
    groups = {g: sorted(groups[g], key=lambda x: x[0]) for g in names}
    trees = {g: levels([x[2] for x in groups[g]]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, doc_id, leaf, own) in enumerate(groups[g]):
            way = steps(trees[g], i) + steps(top, k)
            for a, b in way:
                own = digest(a, own, b)
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], digest(*[x for s in way for x in s]), own, own == top[-1][0]))
    return sorted(out, key=repr)


def result(df, size=8192):
    return sorted(map(tuple, manifest(df, size).collect()), key=repr)


@pytest.mark.parametrize("size", [8192, 7])
def test_manifest_equals_plain_trees(spark, size):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute(docs.collect())
    assert result(docs, size) == want and 0 < sum(not x[-1] for x in want) < len(want)


def test_manifest_of_sizes_around_a_run(spark):
    # 1, 7, 8, 9, 64, 65 and 66 leaves, and twelve groups, so that the tree above them has two levels
    sizes = [1, 7, 8, 9, 64, 65, 66, 1, 2, 3, 4, 5]
    rows = [(1000 * k + i, f"Text {i}", f"l{k:02d}", "s", i) for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    assert result(df, 10) == brute(df.collect())


def test_manifest_of_odd_rows(spark):
    rows = [*ODD, (None, "Word", "en", None, None), (7, "Same", "fr", "s", 4), (7, "Other", "fr", "s", 5), (8, "x", "", "s", 1)]
    df = spark.createDataFrame(rows * 3, DOCS)
    more = df.withColumn("leaf", F.lit("mine")).withColumn("Part", F.lit(1)).withColumn("g", F.lit(2))
    assert result(more, 4) == brute(df.collect())
    one = df.where("doc_id = 8").limit(1)
    assert result(one)[0][1:4] == (result(one)[0][1],) * 3
    assert result(df.limit(0)) == []


def test_manifest_sql_equals_plain_trees(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(db.execute(queries.ORACLE_SQL["op13_merkle"]).fetchall(), key=repr) == brute(docs)
