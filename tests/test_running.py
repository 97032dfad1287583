"""Running sums in parts and as-of values with two policies, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidelane.operators import running
from tidelane.operators.decode import OPS, decode


@pytest.mark.parametrize("size", [3, 50, 20_000])
def test_running_sum_in_parts(spark, size):
    rng = random.Random(size)
    rows = [(k, o, rng.choice([None, 1, 2, 5])) for k in (1, 2, None) for o in rng.sample(range(-500, 500) if k != 2 else range(3), 200 if k == 1 else 3)]
    df = spark.createDataFrame(rows, "match_id long, op_seq long, v long")
    got = {(r.match_id, r.op_seq): r.total for r in running.running_sum(df, ["match_id"], "op_seq", "v", "total", size).collect()}
    assert got == {(k, o): sum(v or 0 for j, p, v in rows if j == k and p <= o) for k, o, _ in rows}
    assert running.running_sum(df.limit(0), ["match_id"], "op_seq", "v", "total", size).count() == 0


def test_long_keys_are_cut_into_parts(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(2).alias("k"), F.col("id").alias("o"))
    parts = {(r.k, r.part_): r.n for r in running.with_part(df, ["k"], "o", 100).groupBy("k", "part_").agg(F.count("*").alias("n")).collect()}
    assert len(parts) >= 10 and max(parts.values()) <= 101 and [p for k, p in parts if k == 2] == [0]


def test_values_as_of_overwrite_or_insert(spark):
    rng = random.Random(4)
    rows = [(k, o, rng.choice(["a", "b", None, None]), rng.choice(["x", "y", None])) for k in range(6) for o in range(20)]
    rows += [(7, o, None, "z" if o == 2 else None) for o in range(5)]
    df = spark.createDataFrame(rows, "k long, o long, s string, m string")
    got = {(r.k, r.o): (r.both, r.one) for r in running.as_of(running.as_of(df, ["k"], "o", "both", "s", "m"), ["k"], "o", "one", "s").collect()}
    for k, o, _, _ in rows:
        state = alone = None
        for j, p, s, m in rows:
            if j == k and p < o:
                state = s or state or m
                alone = s or alone
        assert got[k, o] == (state, alone)


class Registry:
    """Object names by a walk over the operations in order."""

    def __init__(self, start):
        self.names, self.pending = dict(start), {}

    def see(self, r, names):
        ids, kind, out = r["ids"] or [], r["kind"], []
        known = lambda i, unknown="Unknown Building": self.names.get(i, unknown)
        if kind == "dequeue":
            self.names |= dict.fromkeys(ids, names[r["code"]])
            out = [names[r["code"]]] * len(ids)
        elif kind == "queue":
            out = [known(ids[0])] * len(ids) if ids else []
        elif kind == "unqueue":
            out = [known(i) for i in ids]
        elif kind == "research":
            out = [known(r["object_id"])]
        elif kind == "delete":
            out = [known(r["object_id"], "Unknown")]
        elif kind == "build":
            self.pending[int(r["x"] * 10), int(r["y"] * 10)] = names[r["type_id"]]
        elif kind == "interact" and r["object_id"] > 0 and r["object_id"] not in self.names:
            a, b = int(r["x"] * 10), int(r["y"] * 10)
            for c in [(a, b)] + [(a + dx, b + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]:
                if c in self.pending:
                    self.names[r["object_id"]] = self.pending[c]
                    break
        return out


@pytest.mark.parametrize("seed", range(2))
def test_decoded_names_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    names = {i: f"b{i}" for i in range(6)}
    gd = spark.createDataFrame([("building", i, n, 1, 2, 3, 4) for i, n in names.items()], "kind string, id long, name string, food long, wood long, gold long, stone long")
    kinds = ["queue", "dequeue", "build", "build", "interact", "interact", "delete", "research", "unqueue"]
    fields = [c.split()[0] for c in OPS.split(", ")]
    ops = []
    for match in range(3):
        for n in range(300):
            ids = [rng.randrange(30) for _ in range(rng.randrange(3))]
            ids = rng.choice([None, ids]) if rng.random() < 0.1 else ids
            r = {"match_id": match, "op_seq": 10 * n, "kind": rng.choice(kinds), "time_increment": rng.randrange(5), "player_id": 1, "amount": 1}
            r |= {"type_id": rng.randrange(6), "code": rng.randrange(6), "object_id": rng.randrange(30), "x": rng.randrange(12) / 10 + 0.05, "y": rng.randrange(12) / 10 + 0.05, "ids": ids}
            ops.append({c: r.get(c) for c in fields})
    start = [(m, o, o % 6) for m in range(2) for o in range(0, 10, 3)]
    events, _ = decode(spark.createDataFrame([tuple(r.values()) for r in ops], OPS), gd, spark.createDataFrame(start, "match_id long, object_id long, type_id long"))
    got = {(r.match_id, r.seq.op_seq): (r.building_types, r.description, r.ts_ms) for r in events.collect()}
    seen = 0
    for match in range(3):
        walk, clock = Registry({o: names[t] for m, o, t in start if m == match}), 0
        for r in (r for r in ops if r["match_id"] == match):
            clock += r["time_increment"]
            want = walk.see(r, names)
            if (match, r["op_seq"]) in got:
                types, text, ts = got[match, r["op_seq"]]
                assert ts == clock
                assert text == f"Delete {want[0]}" if r["kind"] == "delete" else types == want
                seen += 1
    assert seen > 500 and {"Unknown Building"} < {t for x in got.values() for t in x[0]}
