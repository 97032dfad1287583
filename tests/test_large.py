"""Large tables' faults in small: many matches, long clocks, files of many lines, plans without needless work."""

from __future__ import annotations

import os
import random

import pyarrow as pa
from pyspark.sql import functions as F

from tidelane.functions import text
from tidelane.operators import decode, folds
from tidelane.plans import analyze, engine, games
from tidelane.sources import telemetry as S
from tidelane.sync.calibrate import PANEL, calibrate_matches

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_saved_frames_have_no_folder_a_match(spark, tmp_path):
    saved = spark.range(300).select(F.col("id").alias("match_id"), F.lit(1).cast("long").alias("seq"), F.lit("first").alias("reason"))
    frames = saved.select("match_id", "seq", F.lit(5).cast("long").alias("ts_ms"), F.lit("x").cast("binary").alias("content"))
    S.write_saved_frames(saved, frames, str(tmp_path / "f"))
    assert not [x for x in os.listdir(tmp_path / "f") if os.path.isdir(tmp_path / "f" / x)]
    assert spark.read.parquet(str(tmp_path / "f")).agg(F.countDistinct("match_id")).head()[0] == 300


def test_each_group_over_batches():
    rng = random.Random(1)
    rows = sorted(((rng.choice([None, 1, 2, 3, 9]), i) for i in range(60)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    for size in (1, 4, 7, 100):
        parts = [rows[i : i + size] for i in range(0, 60, size)] + [[]]
        batches = [pa.RecordBatch.from_arrays([pa.array([x[j] for x in p], pa.int64()) for j in (0, 1)], names=["k", "v"]) for p in parts]
        got = {k: t["v"].to_pylist() for (k,), t in folds.runs(batches, 1)}
        assert got == {k: [v for j, v in rows if j == k] for k, _ in rows}


def test_printed_clock_beyond_ninety_nine_minutes(spark):
    shown = spark.range(1).select(*[text.clock_single(F.lit(x).cast("long")) for x in (0, 61_500, 6_061_500, 99_999_999)]).head()
    assert tuple(shown) == ("00:00.000", "01:01.500", "101:01.500", "1666:39.999")


def test_findings_of_readings_settle_no_spends(spark):
    assert "MapInArrow" not in plan(games.sanity_findings(spark, SF)) and "FlatMapGroups" not in plan(games.sanity_findings(spark, SF))
    x = games.line(spark, SF)
    every = {tuple(r) for r in analyze.sanity(x)[0].where("section in ('glitch', 'increase', 'invariant')").collect()}
    assert every and {tuple(r) for r in games.sanity_findings(spark, SF).collect()} == every


def test_spends_are_settled_once(spark):
    for df in (games.spend_findings(spark, SF), games.sanity_spends(spark, SF)):
        assert "MapInArrow" not in plan(df) and "FlatMapGroups" not in plan(df)


def test_operations_find_names_without_a_broadcast(spark):
    ops, data, objects = engine.operations(spark, SF), engine.game_data(spark, SF), engine.objects(spark, SF)
    near, far = (decode.named_ops(ops, data, x) for x in (True, False))
    assert {str(r) for r in near.collect()} == {str(r) for r in far.select(*near.columns).collect()}
    x = decode.named_ops(ops, data, True)
    first = decode.interactions(x)
    assert first.count() == first.select("match_id", "object_id").distinct().count() > 0
    assert {r.match_id for r in objects.collect()} == {r.match_id for r in ops.select("match_id").distinct().collect()}


def test_operations_of_a_null_match_are_events(spark):
    rows = [(m, i, "build", 5, 1, 1, None, None, 0.5, 0.5, 0.0, 0.0, None, None) for m in (None, 1) for i in (1, 2)] + [(1, 3, "sync", 7, 1, 1, None, None, 0.5, 0.5, 0.0, 0.0, None, None)]
    ops = spark.createDataFrame(rows, decode.OPS)
    found, _ = decode.decode(ops, engine.game_data(spark, SF), spark.createDataFrame([], "match_id long, object_id long, type_id long"))
    assert sorted((r.match_id or 0, r.seq.op_seq, r.ts_ms) for r in found.collect()) == [(0, 1, 5), (0, 2, 10), (1, 1, 5), (1, 2, 10)]


def test_refunds_need_no_names_of_objects(spark):
    df = engine.refunds_and_spends(spark, SF)
    assert "Window" not in plan(df)
    events = engine._events(spark, SF)[0]
    want = events.groupBy("match_id", "kind").agg(F.count("*"), F.sum(decode.is_refund().cast("long")), F.sum(decode.is_spend().cast("long")))
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in want.collect()}


def test_calibration_of_many_matches_in_one_task(spark):
    r = spark.createDataFrame([(m, t, *[100 - t // 1000 if c == "food" else None for c in PANEL]) for m in (1, 2, None) for t in range(0, 9000, 1000)], "match_id long, ts_ms long, " + ", ".join(f"{c} int" for c in PANEL))
    s = spark.createDataFrame([(m, i, 500.0 * i, 5, 0, 0, 0) for m in (2, 3) for i in range(3)], "match_id long, seq long, ig_ms double, food long, wood long, gold long, stone long")
    df = calibrate_matches(r, s)
    got = {x.match_id: x.status for x in df.collect()}
    assert got[1] == got[None] == "no spends" and got[3] == "no drops" and len(got) == 4
    assert "MapInArrow" in plan(df)


def test_blocks_of_long_files_go_on_over_parts(spark, tmp_path):
    rng, want = random.Random(3), []
    for name in "ab":
        lines, file = ["lost: 1"], None
        for i in range(60):
            if rng.random() < 0.2:
                file = f"{name}{i}.png"
                lines.append(f"File: {file}")
            lines.append(f"k{i}: {i}")
            want += [(file, f"k{i}", str(i))] if file else []
        (tmp_path / f"{name}.txt").write_text("\n".join(lines))
    for size in (1, 5, 1000):
        assert sorted(map(tuple, S.read_blocks(spark, str(tmp_path), size).collect())) == sorted(want)
