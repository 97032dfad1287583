"""Operators against literal cases, and every query against its SQL."""

from __future__ import annotations

import datetime
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.functions import compare, text
from tidelane.operators import folds, intervals, phases, retime
from tidelane.plans import catalog
from tidelane.sync.calibrate import PANEL, calibrate
from tidelane.sync.mapping import Mapping

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    a = sorted(repr(tuple(map(plain, r))) for r in got.select(*cols).collect())
    r = duck.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    b = sorted(repr(tuple(plain(x[names.index(c)]) for c in cols)) for x in r.fetchall())
    assert a == b


def test_smoothing():
    assert folds.smooth([10, 10, 3, 10, 10]) == [10, 10, 10, 10, 10]
    assert folds.smooth([10, None, None, 11]) == [10, 10, 11, 11]
    assert folds.smooth([10, 12, 14, 16]) == [10, 12, 14, 16]
    assert folds.smooth([5, 0, 0, 0, 5], longest=2) == [5, 0, 0, 0, 5]
    assert folds.smooth([]) == []


def test_bridge_later_upgrade():
    b, out = folds.Bridge(), []
    for ts, color, gap in ((0, "overlay", 0), (200, "white", 5), (400, "yellow", 3), (800, "yellow", 6)):
        out += b.push(folds.Frame(ts, color, gap))
    out += b.close()
    assert [f.state for f in out] == ["housed", "queued", "queued", "queued"]


def _stream(spark, tmp_path, rows, schema, run, name, until, per_file=3):
    """The rows of a stream of files, polled until `until` of them are there."""
    import time

    src = str(tmp_path / f"{name}-in")
    for i in range(0, len(rows), per_file):
        spark.createDataFrame(rows[i : i + per_file], schema).coalesce(1).write.mode("append").parquet(src)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = run(stream).writeStream.format("memory").queryName(name).option(
        "checkpointLocation",
        str(tmp_path / f"{name}-cp"),
    ).outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        began = time.monotonic()
        while time.monotonic() - began < 120:
            got = spark.sql(f"select * from {name}").collect()
            if len(got) >= until:
                return got
            time.sleep(1)
        return got
    finally:
        q.stop()


def test_bridge_stream_equals_batch(spark, tmp_path):
    from tidelane.streaming.live import FRAMES, live_states

    rows = [
        (1, 0, 0, "overlay", 20, 20, True, True),
        (1, 1, 250, "overlay", 20, 20, True, True),
        (1, 2, 500, "white", 20, 20, True, True),
        (1, 3, 750, "overlay", 20, 20, True, True),
        (1, 4, 1000, "white", 20, 20, True, True),
        (1, 5, 1250, None, None, None, False, False),
    ]
    got = {r.seq: r.state for r in _stream(spark, tmp_path, rows, FRAMES, live_states, "live", 4)}
    assert got == {1: "housed", 2: "housed", 3: "housed", 4: "housed"}


def test_stream_of_a_match_that_just_stops(spark, tmp_path):
    from tidelane.streaming.live import FRAMES, live_states

    rows = [
        (1, 0, 0, "white", 20, 25, True, True),
        (1, 1, 250, "overlay", 20, 20, True, True),
        (1, 2, 500, "white", 20, 20, True, True),
        (1, 3, 750, "white", 20, 20, True, True),
    ]
    got = _stream(spark, tmp_path, rows, FRAMES, lambda s: live_states(s, idle_ms=3000), "stops", 3)
    assert {r.seq: r.state for r in got} == {1: "housed", 2: "housed", 3: "housed"}


def test_stream_of_saved_frames_equals_batch(spark, tmp_path):
    from tidelane.streaming.live import saved_frames

    schema = "match_id long, seq long, ts_ms long, color string, readable boolean, food long, pop long"
    rows = [(1, i, 250 * i, "yellow" if i in (9, 10) else "white", i != 30, 100 + 200 * (i >= 14), 5 if i % 7 else None) for i in range(33)]
    batch = folds.recorded(spark.createDataFrame(rows, schema).selectExpr("*", "not readable as lost"), ["food"], ["pop"])
    want = sorted((r.seq, r.reason) for r in batch.collect())
    assert want[-1] == (30, "end") and ("first" in {w for _, w in want})
    got = _stream(spark, tmp_path, rows, schema, lambda s: saved_frames(s, ["food"], ["pop"]), "saved", len(want), 7)
    assert sorted((r.seq, r.reason) for r in got) == want


def test_recorder_and_session():
    r = folds.Recorder()
    saved = []
    for i, (ts, food, color) in enumerate([(0, 100, "white"), (250, 100, "white"), (1500, 400, "white"), (1750, 400, "yellow"), (4000, 400, "white"), (9000, 400, "white")]):
        saved += r.offer(i, ts, {"food": food}, {}, color)
    assert saved == [(0, "first"), (1, "before"), (2, "change:food"), (3, "pop_color:start"), (4, "pop_color:end"), (5, "interval")]
    s = folds.Session()
    assert [s.push(a, b) for a, b in ((True, False), (True, True), (True, False), (False, False), (True, True))] == ["idle", "start", "row", "end", "after"]


def test_thinning():
    assert folds.kept_apart([0, 100, 250, 400, 500], 250) == [True, False, True, False, True]
    assert folds.on_schedule([0.0, 0.1, 0.25, 0.4999], 0.25) == [True, False, True, True]


def test_take_drops():
    falls = {"wood": [[1000, 60], [1300, 50]], "food": [[1200, 10]]}
    found = list(folds.take_drops([("a", 1000, {"wood": 50}), ("b", 1000, {"food": 50})], falls))
    assert found[0] == ("a", True, 300, {"wood": 50})
    assert found[1][1] is False and falls["food"] == [[1200, 10]]
    assert folds.left_over(falls) == (1, [])


def test_segments_and_zero_length(spark):
    r = spark.createDataFrame([(1, 0, 0, 3), (1, 1, 1000, None), (1, 2, 2000, 5), (1, 3, 3000, 5)], "match_id long, seq long, ts_ms long, value long")
    c = spark.createDataFrame([(1, 9, 2000, 1)], "match_id long, seq long, ts_ms long, phase int")
    got = sorted(tuple(x) for x in phases.segments(phases.merged(r, c)).collect())
    assert got == [(1, 0, 2000, 3, 0, "phase"), (1, 2000, 2000, 3, 1, "value"), (1, 2000, 3000, 5, 1, "end")]


def test_subtract(spark):
    runs = spark.createDataFrame([(1, 0, 45000), (1, 100000, 110000)], "match_id long, start_ms long, end_ms long")
    holes = spark.createDataFrame([(1, 20000, 22000), (1, 21000, 25000), (1, 90000, 120000)], "match_id long, from_ms long, to_ms long")
    got = sorted(tuple(x) for x in intervals.subtract(runs, holes).collect())
    assert got == [(1, 0, 20000), (1, 25000, 45000)]
    assert intervals.subtract(runs, holes, 30000).count() == 0


def game(speed, pause=0, n=60, seed=1):
    rng = np.random.default_rng(seed)
    ig = np.sort(rng.uniform(5000, 900000, n))
    menu = [(50, 0, 0, 0), (0, 60, 0, 0), (0, 25, 45, 0), (60, 0, 20, 0), (0, 100, 0, 0), (80, 0, 20, 0)]
    cost = np.array([menu[rng.integers(len(menu))] for _ in range(n)], float)
    rw = 1e6 + ig / speed + np.where(ig > 450000, pause, 0)
    ts = np.arange(1e6, rw[-1] + 4000, 250)
    p0 = 1e6 + 450000 / speed
    run = np.where(ts < p0, ts, np.where(ts < p0 + pause, p0, ts - pause))
    res = np.column_stack([5000 + np.floor((run - 1e6) / 3000 + k * 0.3) * 7 for k in range(4)])
    for t, c in zip(rw, cost, strict=True):
        res[ts >= t + 100] -= c
    return ts, np.hstack([res, np.full((len(ts), 4), 10.0)]), np.column_stack([ig, cost])


@pytest.mark.parametrize("speed", [1.0, 1.7, 3.0])
def test_calibration_finds_speed(speed):
    r = calibrate(*game(speed))
    assert r.status == "ok" and abs(r.mapping.speed_at(450000) - speed) < 0.01 and r.share > 0.97


def test_calibration_finds_pause_and_refuses_noise():
    r = calibrate(*game(1.7, pause=8000))
    assert len(r.mapping.pauses()) == 1 and abs(r.mapping.pauses()[0][2] - 8000) < 400
    ts, panel, spends = game(1.7)
    spends[:, 0] = np.sort(np.random.default_rng(5).uniform(0, 900000, len(spends)))
    assert calibrate(ts, panel, spends).status != "ok" or calibrate(ts, panel, spends).share < 0.8
    assert calibrate(ts, panel, spends[:0]).status == "no spends"


def test_mapping_inverse_at_pause():
    m = Mapping(np.array([0.0, 1000, 3000, 4000]), np.array([0.0, 1700, 1700, 3400]), 1.7, 1.7)
    assert float(m.rw_at(1700.0)) == 1000 and float(m.ig_at(2000.0)) == 1700 and m.segments() == 2
    assert float(m.ig_at(-1000.0)) == -1700 and float(m.ig_at(5000.0)) == 5100 and m.pauses() == [(1700.0, 1000.0, 2000.0)]


def test_analysis_end_to_end(spark):
    from tidelane.plans.analyze import analyze, sanity

    ts, panel, spends = game(1.7)
    rows = [(1, i, int(t), *[int(v) for v in p], "normal" if i % 20 else "housed") for i, (t, p) in enumerate(zip(ts, panel, strict=True))]
    readings = spark.createDataFrame(rows, "match_id long, seq long, ts_ms long, " + ", ".join(f"{c} int" for c in PANEL) + ", housing string")
    ev = [(1, i, int(s[0]), "queue", 83, f"Queue u{i}", *[int(c) for c in s[1:]], [1], ["b"], False) for i, s in enumerate(spends)]
    ev.append((1, 99, 300000, "research", 101, "Research age", 0, 0, 0, 0, [1], ["b"], False))
    events = spark.createDataFrame(
        ev,
        "match_id long, seq long, ts_ms long, kind string, type_id long, description string, food long, wood long, gold long, stone long, building_ids array<long>, building_types array<string>, gives_resources boolean",
    )
    a = analyze(readings, events)
    assert a.mappings.first().status == "ok"
    g = a.grades.first()
    assert g.housed_tier == "bronze" and g.overall_tier in ("bronze", "silver", "gold")
    assert {r.phase for r in a.floating_by_phase.collect()} == {0, 1}
    assert a.chart.where("floating_food").count() > 0
    found, stats = sanity(a.timeline)
    poor = a.timeline.where("src = 'screen'").unionByName(
        a.timeline.where("src = 'event' and kind = 'queue'").limit(1).withColumn("cost_food", F.lit(900000)).withColumn("cost_wood", F.lit(0)).withColumn("cost_gold", F.lit(0))
    )
    assert any("only" in r.detail and "available for 900000" in r.detail for r in sanity(poor)[0].where("section = 'unmatched'").collect())
    assert {r.section for r in found.collect()} <= {"glitch", "increase", "invariant", "unmatched", "overclaimed", "unexplained"}
    s = stats.first()
    assert s.total == len(spends) and s.matched >= 0.97 * s.total
    alone = analyze(readings, None)
    assert alone.mappings.first().status == "telemetry only" and alone.grades.first().overall_tier == "none"


def test_scalar_functions(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first().x
    assert pick(text.clock(F.lit(6_061_005))) == "101:01.005"
    assert pick(text.signed_clock(F.lit(-3_661_001))) == "-1:01:01.001"
    assert pick(text.parse_clock(F.lit("1:02:03.5"))) == 3_723_500 and pick(text.parse_clock(F.lit("x"))) is None
    assert pick(text.parse_clock(F.lit("1700000000000"))) == 1_700_000_000_000
    assert pick(text.newer_version(F.lit("v1.10.0"), F.lit("1.9.9"))) and not pick(text.newer_version(F.lit("1.2"), F.lit("1.1.1")))
    assert pick(text.percent_tier(F.lit(0.0396))[1]) == "bronze" and pick(text.percent_tier(F.lit(0.0194))[1]) == "gold"
    assert pick(text.file_name(F.lit("a/b: c"))) == "a_b__c"
    assert pick(text.panel_line([("Food", F.lit(5), F.lit(2)), ("Wood", F.lit(None), None)], F.lit(1.0), F.lit(3))) == "Food 5 (2) | scale 1.00 | 3 ms"
    assert pick(text.range_middle(F.lit(3), F.lit(6))) == 3 and pick(text.clock_single(F.lit(61_500))) == "01:01.500"


def test_decode(spark):
    from tidelane.operators.decode import OPS, decode, players, winners

    gd = spark.createDataFrame(
        [
            ("unit", 83, "Villager", 50, 0, 0, 0),
            ("building", 109, "Town Center", 0, 275, 0, 100),
            ("building", 70, "House", 0, 25, 0, 0),
            ("building", 117, "Wall", 0, 0, 0, 5),
            ("tech", 101, "Age", 500, 0, 0, 0),
            ("building", 50, "Farm", 0, 60, 0, 0),
        ],
        "kind string, id long, name string, food long, wood long, gold long, stone long",
    )
    op = lambda n, kind, **k: tuple({"match_id": 1, "op_seq": n, "kind": kind, "time_increment": 0, "player_id": 1, "amount": 0, **k}.get(c.split()[0]) for c in OPS.split(", "))
    ops = spark.createDataFrame(
        [
            op(1, "sync", time_increment=1000), op(2, "queue", type_id=83, amount=2, ids=[7]), op(3, "sync", time_increment=500), op(4, "build", type_id=70, x=1.25, y=2.0),
            op(5, "interact", object_id=9, x=1.3, y=2.0), op(6, "delete", object_id=9), op(7, "research", type_id=101, object_id=7), op(8, "wall", type_id=117, x=0.0, y=0.0, x2=3.0, y2=1.0),
            op(9, "sell", code=1, amount=2), op(10, "farm"), op(11, "queue", type_id=999, amount=1, ids=[8]), op(12, "resign", player_id=2), op(13, "queue", type_id=83, amount=0, ids=[7]),
        ],
        OPS,
    )
    objs = spark.createDataFrame([(1, 7, 109), (1, 8, 4)], "match_id long, object_id long, type_id long")
    events, missed = decode(ops, gd, objs)
    rows = sorted(events.collect(), key=lambda r: (r.seq.op_seq, r.seq.unit))
    assert [(r.description, r.ts_ms) for r in rows][:4] == [("Queue Villager", 1000)] * 2 + [("Build House", 1500), ("Delete House", 1500)]
    assert rows[0].building_types == ["Town Center"] and rows[4].building_types == ["Town Center"]
    assert rows[5].stone == 20 and rows[6].wood == 200 and rows[6].gives_resources and rows[7].wood == 60
    assert rows[8].description == "Queue Unknown unit 999" and len(rows) == 9
    assert [(r.dim, r.type_id, r.n) for r in missed.collect()] == [("unit", 999, 1)]
    from tidelane.sources.telemetry import event_lines

    lines = [r.line for r in event_lines(events).collect()]
    assert len(lines) == 9 and all(x.count("\t") == 9 for x in lines)
    p = spark.createDataFrame(
        [(1, 1, "", "", 2, 5, 2), (1, 2, "Bo", "", 2, 6, 2), (1, 3, "", "", 0, 6, 2)],
        "match_id long, slot int, name string, ai_name string, player_type int, civ_id long, rec_player int",
    )
    civ = spark.createDataFrame([(5, "Franks")], "id long, name string")
    out = sorted(winners(players(p, civ), ops).collect(), key=lambda r: r.place)
    assert [(r.name, r.civ, r.is_winner) for r in out] == [("Bo", "Unknown Civ 6", False), ("Player 1", "Franks", True)]


def test_codecs(spark, tmp_path):
    from tidelane.sources import telemetry as S

    head = ",".join(S.TELEMETRY)
    (tmp_path / "t.csv").write_text(head + "\n1000,5,,x,,7,,8,,1,2,3,4,housed\n1250,,,,,,,,,,,,,odd\n")
    rows = sorted(S.read_telemetry(spark, str(tmp_path / "t.csv")).collect(), key=lambda r: r.ts_ms)
    assert (rows[0].food, rows[0].wood, rows[0].housing) == (5, None, "housed") and rows[1].housing is None
    (tmp_path / "bad.csv").write_text(head + "\nx,5,,6,,7,,8,,1,2,3,4,housed\n")
    with pytest.raises(Exception, match="timestamp_ms"):
        S.read_telemetry(spark, str(tmp_path / "bad.csv")).collect()
    merged = spark.createDataFrame(
        [
            ("10", "ScreenGrab", "", "5", "", "7", "8", "99", "", "", "0", "1", "2", "3", "normal", ""),
            ("20", "RecEvent", "Queue Villager", "-50", "", "", "", "", "Town Center", "7", "", "", "", "", "", "83"),
            ("30", "RecEvent", "Nonsense", "", "", "", "", "", "", "", "", "", "", "", "", ""),
        ],
        S.MERGED,
    )
    line = S.decode_merged(merged)
    assert line.count() == 2
    S.write_merged(line, str(tmp_path / "m"))
    again = S.encode_merged(S.read_merged(spark, str(tmp_path / "m")))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merged.where("event_desc <> 'Nonsense'").collect()))
    (tmp_path / "n.csv").write_text("ID,Name\n1,A\nx,B\n1,C\n")
    assert [tuple(r) for r in S.read_id_names(spark, str(tmp_path / "n.csv")).collect()] == [(1, "C")]
    (tmp_path / "g.csv").write_text("kind,id,name,food,wood,gold,stone\nunit,1,A,1,2,3,4\nunit,1,B,1,2,3,4\n")
    with pytest.raises(Exception, match="repeated"):
        S.read_game_data(spark, str(tmp_path / "g.csv")).collect()
    (tmp_path / "b.txt").write_text("junk: 1\nFile: a.png\nfood: 5\nFile: b.png\n food :  6\n")
    assert sorted(map(tuple, S.read_blocks(spark, str(tmp_path / "b.txt")).collect())) == [("a.png", "food", "5"), ("b.png", "food", "6")]


def test_frames_and_latest_file(spark, tmp_path):
    from tidelane.sources import telemetry as S

    for name in ("750.png", "500.png", "x.png", "1000.txt"):
        (tmp_path / name).write_bytes(name.encode())
    assert [r.ts_ms for r in S.read_frames(spark, str(tmp_path)).collect()] == [500, 750]
    index = spark.createDataFrame([("x.png", 5), ("750.png", 7), ("gone.png", 1)], "file string, ts_ms long")
    assert [(r.ts_ms, bytes(r.content)) for r in S.read_frames(spark, str(tmp_path), index).collect()] == [(5, b"x.png"), (7, b"750.png")]
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception, match="no frames|does not exist|PATH_NOT_FOUND"):
        S.read_frames(spark, str(tmp_path / "empty"))
    import os

    os.utime(tmp_path / "500.png", (2_000_000_000, 2_000_000_000))
    assert S.latest_file(spark, [str(tmp_path)], "2001-01-01", "*.png").first().path.endswith("500.png")
    assert S.latest_file(spark, [str(tmp_path)], "2040-01-01", "*.png").count() == 0


def test_game_documents_refuse_conflicts(spark):
    from tidelane.sources.telemetry import merge_game_data

    row = "kind string, id long, section string, food long, wood long, gold long, stone long"
    names = spark.createDataFrame([("techs", 1, "A")], "section string, id long, name string")
    none = spark.createDataFrame([], "kind string, id long, name string")
    same = spark.createDataFrame([("tech", 1, "techs", 1, 0, 0, 0)] * 2, row)
    assert [tuple(r) for r in merge_game_data(same, names, none).collect()] == [("tech", 1, "A", 1, 0, 0, 0)]
    for bad in ([("tech", 1, "techs", 1, 0, 0, 0), ("tech", 1, "techs", 2, 0, 0, 0)], [("tech", 2, "techs", 1, 0, 0, 0)]):
        with pytest.raises(Exception, match="conflicting or unnamed"):
            merge_game_data(spark.createDataFrame(bad, row), names, none).collect()


def test_recorder_saves_the_end(spark):
    rows = [(1, i, 250 * i, "white", 100, i == 3) for i in range(6)]
    df = spark.createDataFrame(rows, "match_id long, seq long, ts_ms long, color string, food long, lost boolean")
    assert [(r.seq, r.reason) for r in folds.recorded(df, ["food"], []).collect()] == [(0, "first"), (3, "end")]


def test_clock_summary():
    r = calibrate(*game(1.7, pause=8000))
    told = r.summary()
    assert "1 pause(s)" in told and "speed 1.7" in told and f"{r.matched}/{r.spends} spends matched" in told
    assert calibrate(*game(1.7, n=3)).summary() == calibrate(*game(1.7, n=3)).status


def test_clock_fit_parts():
    """Runs, chains and their joints on pairs (ig, rw, uncertainty) of known lines."""
    from tidelane.sync import mapping as M

    rng = np.random.default_rng(2)
    ig = np.sort(rng.uniform(0, 600_000, 120))
    none = np.zeros(0), np.zeros((0, 8))
    pairs = lambda rw: np.column_stack([ig, rw + rng.uniform(-60, 60, len(ig)), np.full(len(ig), 60.0)])
    bend = np.where(ig < 300_000, ig / 1.7, 300_000 / 1.7 + (ig - 300_000) / 3.0)
    p = pairs(bend)
    p[::17, 1] += 5000  # wrong pairs
    runs = M.straight_runs(p)
    for r in runs:  # a run's line is the least-squares line of its pairs, and fits all of them
        q = np.array(r.pairs)
        slope, level = np.polyfit(q[:, 0], q[:, 1], 1)
        assert abs(r.slope - slope) < 1e-6 and (np.abs(q[:, 1] - r.rw(q[:, 0])) <= q[:, 2] + 125 + 1e-3).all()
    m = M.fit(p, *none)
    assert abs(m.before - 1.7) < 0.02 and abs(m.after - 3.0) < 0.05 and m.segments() >= 2 and not m.pauses()
    assert np.median(np.abs(m.rw_at(ig) - bend)) < 100
    stop = pairs(ig / 2.0 + np.where(ig > 300_000, 20_000, 0))
    ts = np.arange(0, 330_000, 250.0)
    panel = np.floor(np.where(ts < 150_000, ts, np.where(ts < 170_000, 150_000, ts - 20_000)) / 500)[:, None].repeat(8, axis=1)
    m = M.fit(stop, ts, panel)
    assert len(m.pauses()) == 1 and abs(m.pauses()[0][2] - 20_000) < 400 and abs(m.pauses()[0][1] - 150_000) < 1500
    assert M.fit(stop[:3], *none) is None and M.fit(stop[:0], *none) is None


def test_report():
    from tidelane.plans import report

    out = report.page("<b>", [{"name": "<x>", "civ": "C"}], {"overall_tier": "gold"}, {"label": '["00:01"]'}, [])
    assert "&lt;x&gt;" in out and "<x>" not in out and "★★★" in out
    found = [{"section": "glitch", "in_game_ms": i, "field": "food", "detail": "d"} for i in range(12)]
    assert "... 2 more" in report.findings_text(found, None)


def test_retiming(spark):
    rows = spark.createDataFrame([(1, i, 1000 + 250 * i, i) for i in range(4)] + [(2, 0, 0, 5)], "match_id long, seq long, ts_ms long, value long")
    got = sorted((r.match_id, r.ts_ms) for r in retime.stretched(rows, 2.0).collect())
    assert got == [(1, 1000), (1, 1500), (1, 2000), (1, 2500), (2, 0)]
    got = sorted((r.match_id, r.ts_ms, r.value, r.copy) for r in retime.paused(rows, 2, 600).collect())
    assert got == [(1, 1000, 0, 0), (1, 1250, 1, 0), (1, 1500, 1, 1), (1, 1750, 1, 2), (1, 2100, 2, 0), (1, 2350, 3, 0), (2, 0, 5, 0)]
    assert retime.paused(rows.where("false"), 2, 600).count() == 0


def test_change_bounds(spark):
    rows = spark.createDataFrame(
        [(1, 0, 0, 1), (1, 1, 1000, 1), (1, 2, 2000, 2), (1, 3, 3000, 1), (1, 4, 4000, 2)],
        "match_id long, seq long, ts_ms long, key long",
    )
    changes = spark.createDataFrame(
        [(1, 7, 1200, 1300, 1, 2), (1, 8, 1200, 1300, 2, 3), (1, 9, 9000, 9100, 1, 2), (1, 10, 1200, 1300, None, 2)],
        "match_id long, seq long, old_ms long, new_ms long, old_key long, new_key long",
    )
    assert [tuple(r) for r in retime.change_bounds(changes, rows, 0, 2500).collect()] == [(1, 7, -300, 800)]


def test_queries_over_whole_tables(spark):
    """Brute force over every user, order and reading."""
    def pick(name):
        return sorted(tuple(r) for r in catalog.QUERIES[name](spark, SF).collect())

    ev = [(r.user_id, r.event_id, r.ts, r.event_type, r.value) for r in spark.read.parquet(f"{SF}/events.parquet").collect()]
    assert {x[0] for x in pick("player_events_all")} == {x[0] for x in ev}
    orders = sorted((r.o_orderkey, r.o_custkey) for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey").collect())
    first = {}
    for k, c in orders:
        first.setdefault((c % 97, k % 23), k)
    around = [(0, 0)] + [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if (x, y) != (0, 0)]
    near = lambda x, y: next((first[x + a, y + b] for a, b in around if (x + a, y + b) in first), None)
    assert pick("nearby_cells_all") == [(k, near(c * 3 % 97, k * 7 % 23)) for k, c in orders]
    seen, want = {}, []
    for u, i, t, kind, v in sorted(ev, key=lambda x: (x[0], x[2], x[1])):
        if kind in ("view", "click") and v is not None:
            seen.setdefault(u, []).append((i, math.floor((t - datetime.datetime(1970, 1, 1)) / datetime.timedelta(milliseconds=1)), math.floor(v) // 25))
    for u, line in seen.items():
        steps = [(a, b) for a, b in zip(line, line[1:], strict=False) if a[2] != b[2]]
        for old, new in steps:
            met = [(a[1], b[1]) for a, b in steps if (a[2], b[2]) == (old[2], new[2]) and old[1] - 3600000 < a[1] <= new[1] + 3600000]
            want.append((u, new[0], min(met)[0] - new[1], min(met)[1] - old[1]))
    assert pick("change_bounds_all") == sorted(want) and len(want) > 100


def test_json_differences(spark):
    a = {"n": 1.0, "s": "x", "list": [1, 2, 3], "o": {"gone": {"deep": 1}}, "kind": {"k": 1}, "t": True}
    b = {"n": 1.0 + 1e-7, "s": "y", "list": [1, 5], "o": {"new": 1}, "kind": [1], "t": 1}
    assert compare.json_differences(a, a) == []
    assert compare.json_differences(a, b) == [
        ("$.kind", "value"),
        ("$.list", "length"),
        ("$.list[1]", "value"),
        ("$.o.gone", "missing"),
        ("$.o.new", "unexpected"),
        ("$.s", "value"),
        ("$.t", "value"),
    ]
    x = spark.createDataFrame([(1.0, 1.0 + 1e-7), (1.0, 1.1), (None, 1.0), (None, None)], "e double, a double")
    assert [r[0] for r in x.select(compare.beyond(F.col("e"), F.col("a"))).collect()] == [False, True, True, False]
