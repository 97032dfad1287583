"""Operators that cut long groups into pieces, against plain Python on random input."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tidelane import constants as C
from tidelane.operators import anomalies, folds, intervals, stats
from tidelane.sync import calibrate as cal
from tidelane.sync.mapping import frozen


@pytest.mark.parametrize("size", [2, 20_000])
def test_lower_percentiles_by_counts(spark, size):
    rng = random.Random(size)
    rows = [(k, rng.choice([None, *[x / 4 for x in range(-40, 40)]])) for k in ("a", "b", None) for _ in range(60 if k == "a" else 7)] + [("c", None)]
    got = {r.k: (r.p50, r.p90) for r in stats.lower_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p50": 50, "p90": 90}, size).collect()}
    for k in ("a", "b", None, "c"):
        v = sorted(x for j, x in rows if j == k and x is not None)
        assert got[k] == (tuple(v[(len(v) - 1) * p // 100] for p in (50, 90)) if v else (None, None))


@pytest.mark.parametrize("seed", range(3))
def test_subtraction_equals_points(spark, seed):
    rng = random.Random(seed)
    span = lambda most: (a := rng.randrange(60), a + rng.randrange(most))
    runs = [(m, i, *span(25)) for m in range(3) for i in range(8)] + [(1, 0, 5, 9)] * 2 + [(9, 0, 1, 4)]
    holes = [(m, *span(8)) for m in range(3) for _ in range(6 * m)]
    got = intervals.subtract(spark.createDataFrame(runs, "match_id long, tag long, start_ms long, end_ms long"), spark.createDataFrame(holes, "match_id long, from_ms long, to_ms long"))
    want = []
    for m, i, a, b in set(runs):
        cuts = sorted({x for j, c, d in holes if j == m for x in (c, d) if a < x < b} | {a, b})
        free = [(p, q) for p, q in zip(cuts, cuts[1:]) if not any(j == m and c <= p and q <= d for j, c, d in holes)]
        whole = []
        for p, q in free:  # joined unless a hole touches the place between them
            if whole and whole[-1][1] == p and not any(j == m and c <= p <= d for j, c, d in holes):
                whole[-1] = (whole[-1][0], q)
            else:
                whole.append((p, q))
        want += [(m, i, p, q) for p, q in whole]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("seed", range(2))
def test_frozen_stretch_equals_a_walk(spark, seed):
    rng = np.random.default_rng(seed)
    rows, want = [], {}
    for m in range(6):
        n = int(rng.integers(1, 60))
        panel = rng.choice([np.nan, 1.0, 2.0], (n, 3), p=[0.5, 0.4, 0.1])
        ts = np.cumsum(rng.integers(1, 20, n)).astype(float)
        rows += [(m, i, int(ts[i]), *[None if np.isnan(x) else float(x) for x in panel[i]]) for i in range(n)]
        if (found := frozen(ts, panel, ts[0], ts[-1])) is not None:
            want[m] = found
    df = spark.createDataFrame(rows, "match_id long, seq long, ts_ms long, a double, b double, c double")
    assert {r.match_id: (r.from_ms, r.to_ms) for r in anomalies.longest_frozen(df, ["a", "b", "c"]).collect()} == want


def test_resampling_in_pieces(spark):
    rng = random.Random(1)
    rows = []
    for m in range(3):
        t = 0
        for i in range(120):
            t += rng.choice([0, 1, 2, 3, 11, 12])
            rows.append((m, i, t))
    df = spark.createDataFrame(rows, "match_id long, seq long, ts_ms long")
    want, last = [], {}
    for m, i, t in rows:
        if m not in last or t - last[m] >= 10:
            last[m] = t
            want.append((m, i, t))
    for size in (1, 9, 2000):
        assert sorted(map(tuple, folds.resample(df, 10, size).collect())) == sorted(want)


def test_ledger_in_pieces(spark):
    """The same whether a match is one piece or many, and none of its windows is cut."""
    rng = random.Random(2)
    spends = [(m, i, 3000 * i + rng.randrange(9000), rng.choice([20, 50, 80])) for m in range(2) for i in range(60)]
    falls = [(m, i, 3000 * i + rng.randrange(9000), rng.choice([10, 50, 100])) for m in range(3) for i in range(60)]
    s, f = spark.createDataFrame(spends, "match_id long, seq long, ts_ms long, cost long"), spark.createDataFrame(falls, "match_id long, seq long, ts_ms long, delta long")
    want = []
    for m in range(2):
        pool = {"v": [[t, d] for t, _, d in sorted((t, i, d) for j, i, t, d in falls if j == m)]}
        for tag, ok, off, got in folds.take_drops([(i, t, {"v": c}) for t, i, c in sorted((t, i, c) for j, i, t, c in spends if j == m)], pool):
            want.append((m, tag, ok, off, got["v"]))
    assert sorted(map(tuple, folds.greedy_match(s, f).collect())) == sorted(want)
    keys = lambda key, a, b: a.assign(piece=key[1])[["match_id", "seq", "piece"]]
    pieces = {(r.match_id, r.seq): r.piece for r in folds.by_piece(s, f, keys, "match_id long, seq long, piece int", size=5).collect()}
    assert len(set(pieces.values())) > 5 and len(pieces) == len(spends)
    for m, i, t, _ in spends:
        for n, j, u, _ in spends:
            if m == n and abs(t - u) <= C.BEFORE_MS + C.AFTER_MS:
                assert pieces[m, i] == pieces[n, j]


def test_bands_hold_all_near_pairs():
    rng = np.random.default_rng(3)
    spends = np.column_stack([np.sort(rng.uniform(0, 9e4, 30)), rng.choice([0, 30, 60], (30, 4))])
    spends = spends[spends[:, 1:].any(axis=1)]
    drops = np.column_stack([rng.uniform(0, 9e4, 40), rng.uniform(50, 700, 40), rng.choice([0, 20, 50, 90], (40, 4))])
    bands, places = cal.Bands(spends, drops), spends[:, 0] + 100
    got = bands.band(np.arange(len(spends)), places, 500.0)
    want = set()
    for i, at in enumerate(places):
        for k, d in enumerate(drops):
            need = spends[i, 1:] > 0
            if abs(d[0] - at) <= 500 + d[1] and (d[2:][need] >= C.DROP_FRACTION * spends[i, 1:][need]).all():
                want.add((i, k))
    assert set(zip(got.spend.tolist(), got.drop.tolist(), strict=True)) == want and len(got.spend) == len(want)
    held = bands.claimed(got.nearest())
    assert len(set(got.nearest().spend[held].tolist())) == len(held)
