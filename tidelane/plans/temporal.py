"""Queries of the temporal operators over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelane.functions.cost import similarity
from tidelane.operators import anomalies, asof, intervals, phases, retime, stats
from tidelane.plans.tables import CTE, clicks, events, readings, spends, table

HOUR = 3_600_000
#: Thresholds by phase, status bounds and speeds for the event table's values.
LEVELS = (60, 50, 40, 30)
SPEEDS = (0.5, 1.0, 1.7, 2.0, 4.0)

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    return phases.merged(readings(spark, d), phases.effective_clicks(clicks(spark, d)))


def _series(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).select("match_id", "seq", "ts_ms", "value")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return intervals.threshold_runs(_timeline(spark, d), F.array(*[F.lit(x) for x in LEVELS]))


def _holes(spark: SparkSession, d: str) -> DataFrame:
    return clicks(spark, d).select("match_id", (F.col("ts_ms") - 4 * HOUR).alias("from_ms"), F.col("ts_ms").alias("to_ms"))


@query("SELECT match_id, src, seq, ts_ms, row_number() OVER (PARTITION BY match_id ORDER BY ts_ms, r, seq) AS pos FROM (SELECT o_custkey % 150 AS match_id, 'order' AS src, 0 AS r, o_orderkey AS seq, epoch_ms(o_orderdate) AS ts_ms FROM orders UNION ALL SELECT user_id, 'event', 1, event_id, epoch_us(ts) // 1000 FROM events)")
def timeline_merge(spark, d):
    orders = table(spark, d, "orders").select(
        (F.col("o_custkey") % 150).alias("match_id"),
        F.lit("order").alias("src"),
        F.lit(0).alias("r"),
        F.col("o_orderkey").alias("seq"),
        (F.unix_date(F.to_date("o_orderdate")).cast("long") * 86_400_000).alias("ts_ms"),
    )
    both = orders.unionByName(events(spark, d).select("match_id", F.lit("event").alias("src"), F.lit(1).alias("r"), "seq", "ts_ms"))
    return both.select(
        "match_id",
        "src",
        "seq",
        "ts_ms",
        F.row_number().over(Window.partitionBy("match_id").orderBy("ts_ms", "r", "seq")).cast("long").alias("pos"),
    )


@query(CTE + "SELECT match_id, phase, max(ts_ms) AS ts_ms FROM ck GROUP BY match_id, phase")
def last_phase_click(spark, d):
    return phases.last_clicks(clicks(spark, d))


@query(CTE + "SELECT match_id, seq, ts_ms, phase FROM ef")
def effective_phase(spark, d):
    return phases.effective_clicks(clicks(spark, d)).select("match_id", "seq", "ts_ms", "phase")


@query(CTE + "SELECT match_id, seq, ts_ms, now AS phase FROM tl WHERE rank = 1")
def phase_carry_forward(spark, d):
    return phases.with_phase(_timeline(spark, d)).where("rank = 1").select("match_id", "seq", "ts_ms", F.col("now").alias("phase"))


@query(CTE + "SELECT * FROM seg")
def segments_by_phase(spark, d):
    return phases.segments(_timeline(spark, d))


@query(CTE + "SELECT match_id, phase, CAST(sum((end_ms - start_ms) * value) AS BIGINT) / 1000.0::DOUBLE AS weighted_s FROM seg GROUP BY match_id, phase")
def weighted_value_by_phase(spark, d):
    return phases.weighted_by_phase(phases.segments(_timeline(spark, d)))


@query(CTE + "SELECT CAST(sum(end_ms - start_ms) AS BIGINT) AS all_ms, CAST(sum(CASE WHEN value > 0 THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS positive_ms, CAST(sum((end_ms - start_ms) * value) AS BIGINT) AS weighted_ms, phase FROM seg GROUP BY phase UNION ALL SELECT CAST(sum(end_ms - start_ms) AS BIGINT), CAST(sum(CASE WHEN value > 0 THEN end_ms - start_ms ELSE 0 END) AS BIGINT), CAST(sum((end_ms - start_ms) * value) AS BIGINT), -1 FROM seg")
def segment_totals(spark, d):
    ms = F.col("end_ms") - F.col("start_ms")
    out = phases.segments(_timeline(spark, d)).rollup("phase").agg(
        F.sum(ms).alias("all_ms"),
        F.sum(F.when(F.col("value") > 0, ms).otherwise(0)).alias("positive_ms"),
        F.sum(ms * F.col("value")).alias("weighted_ms"),
    )
    return out.withColumn("phase", F.coalesce("phase", F.lit(-1)))


_STATUS = "CASE WHEN value < 20 THEN 'normal' WHEN value < 80 THEN 'queued' ELSE 'housed' END"


@query(CTE + f", st AS (SELECT *, {_STATUS} AS status FROM seg) SELECT match_id, phase, " + ", ".join(f"CAST(sum(CASE WHEN status = '{s}' THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS {s}_ms" for s in ("normal", "queued", "housed")) + " FROM st GROUP BY match_id, phase")
def status_duration_pivot(spark, d):
    cut = phases.segments(_timeline(spark, d)).withColumn("status", F.expr(_STATUS))
    return phases.status_pivot(cut, "status", ["normal", "queued", "housed"])


@query(CTE + "SELECT match_id, start_ms, end_ms, CASE WHEN end_reason = 'phase' THEN ' (click)' ELSE '' END AS note FROM seg")
def segment_annotation(spark, d):
    return phases.segments(_timeline(spark, d)).select(
        "match_id",
        "start_ms",
        "end_ms",
        F.when(F.col("end_reason") == "phase", " (click)").otherwise("").alias("note"),
    )


@query(CTE + "SELECT * FROM run")
def threshold_runs(spark, d):
    return _runs(spark, d)


@query(CTE + "SELECT match_id, phase, start_ms, end_ms FROM run WHERE end_ms - start_ms >= 21600000")
def threshold_runs_min_duration(spark, d):
    return _runs(spark, d).where(F.col("end_ms") - F.col("start_ms") >= 6 * HOUR)


@query(CTE + "SELECT match_id, a AS from_ms, b AS to_ms, 'click' AS why FROM hole0 UNION ALL SELECT match_id, ts_ms - 3600000, ts_ms, 'spend' FROM sp")
def suppression_union(spark, d):
    s = spends(spark, d).select("match_id", (F.col("ts_ms") - HOUR).alias("from_ms"), F.col("ts_ms").alias("to_ms"), F.lit("spend").alias("why"))
    return _holes(spark, d).withColumn("why", F.lit("click")).unionByName(s)


@query(CTE + "SELECT match_id, phase, start_ms, end_ms FROM piece")
def interval_subtract(spark, d):
    return intervals.subtract(_runs(spark, d), _holes(spark, d))


@query(CTE + "SELECT p.phase, CAST(coalesce(sum(e.end_ms - e.start_ms), 0) AS BIGINT) AS floating_ms FROM (SELECT DISTINCT now AS phase FROM tl) p LEFT JOIN (SELECT * FROM piece WHERE end_ms - start_ms >= 21600000) e ON e.phase = p.phase GROUP BY p.phase")
def floating_by_phase(spark, d):
    seen = phases.with_phase(_timeline(spark, d)).select(F.col("now").alias("phase")).distinct()
    kept = intervals.subtract(_runs(spark, d), _holes(spark, d), 6 * HOUR).groupBy("phase").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    return seen.join(kept, "phase", "left").select("phase", F.coalesce("ms", F.lit(0)).alias("floating_ms"))


@query(CTE + "SELECT r.match_id, r.seq, EXISTS (SELECT 1 FROM run i WHERE i.match_id = r.match_id AND r.ts_ms BETWEEN i.start_ms AND i.end_ms) AS inside FROM rd r")
def in_interval_flags(spark, d):
    return intervals.inside(_series(spark, d), _runs(spark, d)).select("match_id", "seq", "inside")


@query(CTE + "SELECT match_id, seq, (prev_ts + ts_ms) / 2.0::DOUBLE AS at_ms, (ts_ms - prev_ts) / 2.0::DOUBLE AS slack_ms, prev - value AS delta FROM nb2 WHERE value < prev AND ts_ms - prev_ts <= 21600000 AND NOT glitch AND NOT was_glitch")
def drops(spark, d):
    return anomalies.drops(_series(spark, d), 6 * HOUR)


@query(CTE + "SELECT match_id, seq, ts_ms, prev, value FROM nb WHERE glitch")
def glitch_aba(spark, d):
    coarse = _series(spark, d)
    return anomalies.neighbours(coarse).where("glitch").select("match_id", "seq", "ts_ms", "prev", "value")


@query(CTE + "SELECT match_id, seq, ts_ms, prev, value, next FROM nb WHERE prev IS NOT NULL AND next IS NOT NULL AND (value + 2 < least(prev, next) OR value > greatest(prev, next) + 2)")
def pop_spike(spark, d):
    return anomalies.spikes(_series(spark, d), 2)


@query(CTE + "SELECT match_id, seq, ts_ms, value - prev AS rise FROM nb2 x WHERE value > prev + 80 AND NOT was_glitch AND NOT EXISTS (SELECT 1 FROM sp f WHERE f.match_id = x.match_id AND f.ts_ms BETWEEN x.ts_ms - 14400000 AND x.ts_ms + 7200000)")
def large_increase_no_refund(spark, d):
    return anomalies.large_increases(_series(spark, d), spends(spark, d), 80, 4 * HOUR, 2 * HOUR)


@query(CTE + ", b AS (SELECT match_id, ts_ms, seq, coalesce(value > 40, false) AS bad, row_number() OVER (PARTITION BY match_id ORDER BY ts_ms, seq) AS n FROM rd), i AS (SELECT *, n - row_number() OVER (PARTITION BY match_id ORDER BY ts_ms, seq) AS g FROM b WHERE bad) SELECT match_id, min(ts_ms) AS first_ms, count(*) AS frames FROM i GROUP BY match_id, g")
def invariant_runs(spark, d):
    return anomalies.invariant_runs(_series(spark, d), F.col("value") > 40)


@query(CTE + "SELECT match_id, count(*) - count(value) AS missing, count(*) AS n FROM rd GROUP BY match_id")
def missing_counts(spark, d):
    return _series(spark, d).groupBy("match_id").agg((F.count("*") - F.count("value")).alias("missing"), F.count("*").alias("n"))


@query(CTE + "SELECT match_id, list_sort(list(value) FILTER (value IS NOT NULL))[(count(value) - 1) * 50 // 100 + 1] AS p50, list_sort(list(value) FILTER (value IS NOT NULL))[(count(value) - 1) * 90 // 100 + 1] AS p90 FROM rd GROUP BY match_id")
def percentile_lower(spark, d):
    return stats.lower_percentiles(_series(spark, d), ["match_id"], "value", {"p50": 50, "p90": 90})


@query(CTE + ", v AS (SELECT match_id, value, ts_ms - 1704067200000 AS t FROM rd WHERE value IS NOT NULL), q AS (SELECT match_id, value, CAST(least(t * 4 // greatest(max(t) OVER (PARTITION BY match_id), 1), 3) AS INTEGER) AS quarter FROM v), f AS (SELECT match_id, quarter, list_sort(list(value))[(count(*) - 1) * 50 // 100 + 1] AS median FROM q GROUP BY match_id, quarter) SELECT g.match_id, g.quarter, f.median FROM (SELECT DISTINCT match_id, CAST(k AS INTEGER) AS quarter FROM v, range(4) t(k)) g LEFT JOIN f ON f.match_id = g.match_id AND f.quarter = g.quarter")
def quarter_median(spark, d):
    rows = _series(spark, d).where("value is not null").withColumn("ts_ms", F.col("ts_ms") - 1_704_067_200_000)
    return stats.quarter_medians(rows, "value")


@query(
    CTE.replace("WITH", "WITH RECURSIVE", 1)
    + """, shown AS (
  SELECT match_id, ts_ms, row_number() OVER (PARTITION BY match_id ORDER BY ts_ms, seq) AS n, CASE WHEN seq % 3 = 0 THEN NULL ELSE value // 40 END AS a, CASE WHEN seq % 4 = 1 THEN NULL ELSE value // 60 END AS b FROM rd),
still(match_id, n, start, a, b) AS (
  SELECT match_id, n, n, a, b FROM shown WHERE n = 1
  UNION ALL
  SELECT match_id, n, CASE WHEN broken THEN n ELSE start END, CASE WHEN broken THEN a ELSE coalesce(x, a) END, CASE WHEN broken THEN b ELSE coalesce(y, b) END FROM (
    SELECT p.match_id, p.n, p.a, p.b, r.start, r.a AS x, r.b AS y, coalesce(p.a <> r.a, false) OR coalesce(p.b <> r.b, false) AS broken FROM still r JOIN shown p ON p.match_id = r.match_id AND p.n = r.n + 1)),
span AS (SELECT r.match_id, r.start, min(p.ts_ms) AS from_ms, max(p.ts_ms) AS to_ms FROM still r JOIN shown p ON p.match_id = r.match_id AND p.n = r.n GROUP BY r.match_id, r.start)
SELECT match_id, from_ms, to_ms FROM span WHERE to_ms > from_ms QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY to_ms - from_ms DESC, start) = 1"""
)
def longest_frozen(spark, d):
    """The longest time in which neither of two numbers changed; every third reading of one and fourth of the other is missing."""
    r = _series(spark, d)
    shown = lambda every, at, by: F.when(F.col("seq") % every != at, F.expr(f"value div {by}"))
    return anomalies.longest_frozen(r.select("match_id", "seq", "ts_ms", shown(3, 0, 40).alias("a"), shown(4, 1, 60).alias("b")), ["a", "b"])


_SIM = "(cost * least(cost, delta)::DOUBLE / greatest(cost, delta)) / cost::DOUBLE"


@query(CTE + f", dr AS (SELECT match_id, seq AS drop_seq, prev - value AS delta FROM nb2 WHERE value < prev AND ts_ms - prev_ts <= 21600000 AND NOT glitch AND NOT was_glitch) SELECT s.match_id, s.seq, drop_seq, round({_SIM}, 9) AS similarity FROM sp s JOIN dr ON dr.match_id = s.match_id WHERE cost > 0 AND delta >= 0.4::DOUBLE * cost")
def spend_drop_candidates(spark, d):
    found = anomalies.drops(_series(spark, d), 6 * HOUR).select("match_id", F.col("seq").alias("drop_seq"), "delta")
    pairs = spends(spark, d).join(found, "match_id").withColumn("similarity", similarity([F.col("cost")], [F.col("delta")]))
    return pairs.where("similarity is not null").select("match_id", "seq", "drop_seq", F.round("similarity", 9).alias("similarity"))


@query(CTE + "SELECT match_id, seq, cost, round(1 / sqrt(count(*) OVER (PARTITION BY match_id, cost)), 9) AS weight FROM sp")
def spend_rarity(spark, d):
    same = F.count("*").over(Window.partitionBy("match_id", "cost"))
    return spends(spark, d).select("match_id", "seq", "cost", F.round(1 / F.sqrt(same), 9).alias("weight"))


@query(CTE + ", k0 AS (SELECT match_id, ts_ms AS x, row_number() OVER (PARTITION BY match_id ORDER BY ts_ms, seq) AS i FROM ck), k AS (SELECT match_id, x, i * 7200000.0::DOUBLE AS y, lead(x) OVER (PARTITION BY match_id ORDER BY x, i) AS nx, lead(i) OVER (PARTITION BY match_id ORDER BY x, i) * 7200000.0::DOUBLE AS ny, first(x) OVER (PARTITION BY match_id ORDER BY x, i) AS fx FROM k0) SELECT r.match_id, r.seq, round(CASE WHEN k.x IS NULL THEN 7200000.0::DOUBLE - (f.fx - r.ts_ms) * 1.5::DOUBLE WHEN k.nx IS NULL THEN k.y + (r.ts_ms - k.x) * 2.0::DOUBLE ELSE k.y + (k.ny - k.y) * (r.ts_ms - k.x) / (k.nx - k.x) END, 3) AS y FROM rd r JOIN (SELECT DISTINCT match_id, fx FROM k) f ON f.match_id = r.match_id LEFT JOIN k ON k.match_id = r.match_id AND k.x <= r.ts_ms AND (k.nx IS NULL OR r.ts_ms < k.nx)")
def clock_map_piecewise(spark, d):
    knots = clicks(spark, d).select(
        "match_id",
        F.col("ts_ms").alias("x"),
        (F.row_number().over(Window.partitionBy("match_id").orderBy("ts_ms", "seq")) * 7_200_000.0).alias("y"),
    )
    times = _series(spark, d).select("match_id", "seq", F.col("ts_ms").alias("x"))
    return asof.clock(times, knots, 1.5, 2.0).where("y is not null").select("match_id", "seq", F.round("y", 3).alias("y"))


_PAIRS = ", p AS (SELECT match_id, seq::DOUBLE AS x, value::DOUBLE AS y FROM rd WHERE value IS NOT NULL)"


@query(CTE + _PAIRS + " SELECT match_id, round(coalesce(regr_slope(y, x), 1.0), 6) AS slope, round(avg(y) - coalesce(regr_slope(y, x), 1.0) * avg(x), 4) AS intercept FROM p GROUP BY match_id")
def regression_fit(spark, d):
    fit = stats.least_squares(
        _series(spark, d).where("value is not null").select(
            "match_id",
            F.col("seq").cast("double").alias("x"),
            F.col("value").cast("double").alias("y"),
        )
    )
    return fit.select("match_id", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(CTE + _PAIRS + " SELECT match_id, round(sum(x * y) / sum(x * x), 9) AS slope FROM p GROUP BY match_id HAVING sum(x * x) > 0")
def anchored_slope(spark, d):
    fit = stats.anchored_slope(
        _series(spark, d).where("value is not null").select(
            "match_id",
            F.col("seq").cast("double").alias("x"),
            F.col("value").cast("double").alias("y"),
        )
    )
    return fit.where("slope is not null").select("match_id", F.round("slope", 9).alias("slope"))


@query(CTE + ", v AS (SELECT match_id, seq % 1000 AS x, value AS y, 1 + seq % 3 AS w FROM rd WHERE value IS NOT NULL), b AS (SELECT match_id, i AS speed_no, CAST(floor((y - x / s::DOUBLE) / 25.0::DOUBLE) AS BIGINT) AS bin, w FROM v, (VALUES (0, 0.5), (1, 1.0), (2, 1.7), (3, 2.0), (4, 4.0)) g(i, s)), h AS (SELECT match_id, speed_no, bin, sum(w) AS w FROM b GROUP BY ALL), s AS (SELECT a.match_id, a.speed_no, a.bin, CAST(sum(n.w) AS BIGINT) AS score FROM h a JOIN h n ON n.match_id = a.match_id AND n.speed_no = a.speed_no AND n.bin BETWEEN a.bin - 1 AND a.bin + 1 GROUP BY a.match_id, a.speed_no, a.bin) SELECT match_id, speed_no, bin, score FROM s QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY score DESC, speed_no, bin) = 1")
def hough_votes(spark, d):
    votes = _series(spark, d).where("value is not null").select(
        "match_id",
        (F.col("seq") % 1000).alias("x"),
        F.col("value").alias("y"),
        (1 + F.col("seq") % 3).alias("w"),
    )
    return stats.hough(votes, list(SPEEDS), 25.0)


@query(CTE + ", s AS (SELECT match_id, min(ts_ms) AS t0, max(ts_ms) AS t1 FROM sp GROUP BY match_id), w AS (SELECT match_id, t0, unnest(range(0, 1 + greatest(0, CAST(floor((t1 - t0 - 172800000) / 86400000.0::DOUBLE) AS BIGINT) + 1))) AS i FROM s) SELECT w.match_id, i AS \"window\", t0 + i * 86400000 AS first_ms, count(*) AS n FROM w JOIN sp ON sp.match_id = w.match_id AND sp.ts_ms >= t0 + i * 86400000 AND sp.ts_ms < t0 + i * 86400000 + 172800000 GROUP BY w.match_id, i, t0")
def sliding_windows_anchored(spark, d):
    return stats.anchored_windows(spends(spark, d), 48 * HOUR, 24 * HOUR)


@query(CTE + "SELECT s.match_id, s.seq, r.value AS reading FROM sp s ASOF LEFT JOIN (SELECT * FROM rd WHERE value IS NOT NULL) r ON r.match_id = s.match_id AND s.ts_ms >= r.ts_ms")
def asof_backward(spark, d):
    return asof.backward(spends(spark, d), _series(spark, d), "value", "reading").select("match_id", "seq", "reading")


@query(CTE + ", v AS (SELECT * FROM rd WHERE value IS NOT NULL), l AS (SELECT match_id, last(value ORDER BY ts_ms, seq) AS value FROM v GROUP BY match_id) SELECT s.match_id, s.seq, coalesce(r.value, l.value) AS reading FROM sp s ASOF LEFT JOIN v r ON r.match_id = s.match_id AND s.ts_ms <= r.ts_ms LEFT JOIN l ON l.match_id = s.match_id")
def asof_forward_fallback(spark, d):
    return asof.forward_or_last(spends(spark, d), _series(spark, d), "value", "reading").select("match_id", "seq", "reading")


@query(CTE + "SELECT match_id, seq, CAST(sum(cost) OVER (PARTITION BY match_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS clock_ms FROM sp")
def running_clock(spark, d):
    w = Window.partitionBy("match_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return spends(spark, d).select("match_id", "seq", F.sum("cost").over(w).alias("clock_ms"))


@query(CTE + "SELECT match_id, min(CASE WHEN value IS NOT NULL THEN ts_ms END) AS start_ms FROM rd GROUP BY match_id")
def first_readable(spark, d):
    return _series(spark, d).groupBy("match_id").agg(F.min(F.when(F.col("value").isNotNull(), F.col("ts_ms"))).alias("start_ms"))


@query(CTE + "SELECT s.match_id, s.seq FROM sp s JOIN (SELECT match_id, max(ts_ms) AS t FROM rd GROUP BY match_id) l ON l.match_id = s.match_id WHERE s.ts_ms <= l.t")
def events_within_capture(spark, d):
    both = events(spark, d).withColumn("t", F.max(F.when(F.col("kind").isin("view", "click", "error"), F.col("ts_ms"))).over(Window.partitionBy("match_id")))
    return both.where("kind = 'purchase' and ts_ms <= t").select("match_id", "seq")


@query(CTE + ", x AS (SELECT match_id, seq, value, lag(value) OVER w AS p, row_number() OVER w AS n FROM rd WINDOW w AS (PARTITION BY match_id ORDER BY ts_ms, seq)) SELECT match_id, seq, CASE WHEN n > 1 AND ((value IS NULL) <> (p IS NULL) OR abs(value - p) >= 50) THEN 'value' END AS changed FROM x")
def sharp_change(spark, d):
    return anomalies.sharp_change(_series(spark, d), ["value"], [], 50, 3).select("match_id", "seq", "changed")


@query(CTE + ", s AS (SELECT match_id, start_ms, end_ms FROM seg WHERE end_ms > start_ms), i AS (SELECT match_id % 10 AS match_id, start_ms, end_ms FROM s), e AS (SELECT match_id, start_ms AS x, 1 AS d FROM i UNION ALL SELECT match_id, end_ms, -1 FROM i), w AS (SELECT match_id, x, CAST(sum(d) OVER (PARTITION BY match_id ORDER BY x, d ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth, lead(x) OVER (PARTITION BY match_id ORDER BY x, d) AS until FROM e) SELECT match_id, x AS at, until, depth FROM w QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY depth DESC, x, until NULLS LAST) = 1")
def max_overlap_sweep(spark, d):
    cut = phases.segments(_timeline(spark, d)).where("end_ms > start_ms").withColumn("match_id", F.col("match_id") % 10)
    return intervals.max_overlap(cut)


@query(CTE + ", v AS (SELECT DISTINCT match_id, seq % 50 AS sample, value // 5 AS bin FROM rd WHERE value IS NOT NULL), n AS (SELECT match_id, bin, count(*) AS n FROM v GROUP BY ALL), b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY n DESC, bin) = 1) SELECT n.match_id, round(CAST(sum(n.bin * n.n) AS BIGINT) / CAST(sum(n.n) AS BIGINT)::DOUBLE, 9) AS centre, max(b.n) AS n FROM n JOIN b ON b.match_id = n.match_id AND n.bin BETWEEN b.bin - 1 AND b.bin + 1 GROUP BY n.match_id")
def vote_offset_mode(spark, d):
    votes = _series(spark, d).where("value is not null").select("match_id", (F.col("seq") % 50).alias("sample"), F.expr("value div 5").alias("bin"))
    return stats.vote_mode(votes).withColumn("centre", F.round("centre", 9))


@query(CTE + "SELECT match_id, max_by(seq, ts_ms) AS seq, max(ts_ms) AS ts_ms FROM ev WHERE ts_ms > 1704153600000 GROUP BY match_id")
def latest_by_time(spark, d):
    e = events(spark, d).where("ts_ms > 1704153600000")
    return e.groupBy("match_id").agg(F.max_by("seq", "ts_ms").alias("seq"), F.max("ts_ms").alias("ts_ms"))


@query(CTE + ", f AS (SELECT match_id, seq, ts_ms, row_number() OVER (PARTITION BY match_id ORDER BY ts_ms, seq) AS n, count(*) OVER (PARTITION BY match_id) AS total FROM nb WHERE glitch OR value > prev + 80) SELECT match_id, seq, ts_ms, greatest(total - 10, 0) AS more FROM f WHERE n <= 10")
def top_examples(spark, d):
    x = anomalies.neighbours(_series(spark, d)).where("glitch or value > prev + 80")
    n = F.row_number().over(Window.partitionBy("match_id").orderBy("ts_ms", "seq"))
    total = F.count("*").over(Window.partitionBy("match_id"))
    return x.select("match_id", "seq", "ts_ms", F.greatest(total - 10, F.lit(0)).alias("more"), n.alias("n")).where("n <= 10").drop("n")


@query(CTE + ", a AS (SELECT match_id AS k, count(*) AS n FROM nb WHERE glitch OR value > prev + 100 GROUP BY 1), b AS (SELECT match_id AS k, count(*) AS n FROM nb WHERE glitch OR value > prev + 120 GROUP BY 1) SELECT coalesce(a.k, b.k) AS match_id, CASE WHEN a.k IS NULL THEN 'gone' WHEN b.k IS NULL THEN 'new' WHEN a.n <> b.n THEN 'changed' ELSE 'same' END AS status FROM a FULL JOIN b ON a.k = b.k")
def set_diff_findings(spark, d):
    x = anomalies.neighbours(_series(spark, d))
    now = x.where("glitch or value > prev + 100").groupBy("match_id").agg(F.count("*").alias("n"))
    old = x.where("glitch or value > prev + 120").groupBy("match_id").agg(F.count("*").alias("m"))
    status = F.when(F.col("n").isNull(), "gone").when(F.col("m").isNull(), "new").when(F.col("n") != F.col("m"), "changed").otherwise("same")
    return now.join(old, "match_id", "full").select("match_id", status.alias("status"))


@query(CTE + ", g AS (SELECT match_id, seq, ts_ms, value FROM rd), c AS (SELECT match_id, seq, value, lag(value) OVER (PARTITION BY match_id ORDER BY ts_ms, seq) AS p FROM g) SELECT match_id, seq, p, value FROM c WHERE p IS NOT NULL AND value IS NOT NULL AND p <> value")
def change_pairs(spark, d):
    w = Window.partitionBy("match_id").orderBy("ts_ms", "seq")
    return _series(spark, d).withColumn("p", F.lag("value").over(w)).where(
        "p is not null and value is not null and p <> value"
    ).select("match_id", "seq", "p", "value")


@query(CTE + "SELECT match_id, last(seq ORDER BY ts_ms, seq) AS loser_seq, count(*) AS n FROM ev WHERE kind = 'error' GROUP BY match_id")
def last_resignation(spark, d):
    e = events(spark, d).where("kind = 'error'")
    return e.groupBy("match_id").agg(F.max_by("seq", F.struct("ts_ms", "seq")).alias("loser_seq"), F.count("*").alias("n"))


@query(CTE + "SELECT match_id, seq, CAST(round(t0 + (ts_ms - t0) * 1.7::DOUBLE) AS BIGINT) AS ts_ms, value FROM (SELECT *, min(ts_ms) OVER (PARTITION BY match_id) AS t0 FROM rd)")
def stretched_clock(spark, d):
    return retime.stretched(_series(spark, d), 1.7).select("match_id", "seq", "ts_ms", "value")


@query(CTE + ", n AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY ts_ms, seq) AS n, count(*) OVER (PARTITION BY match_id) AS c FROM rd) SELECT match_id, seq, ts_ms + (CASE WHEN n > 3 THEN 86400000 ELSE 0 END) + copy * 7200000 AS ts_ms, value, CAST(copy AS INTEGER) AS copy FROM (SELECT *, unnest(range(0, CASE WHEN n = 3 AND c > 3 THEN 13 ELSE 1 END)) AS copy FROM n)")
def pause_injected(spark, d):
    return retime.paused(_series(spark, d), 3, 24 * HOUR, 2 * HOUR).select("match_id", "seq", "ts_ms", "value", "copy")


@query(CTE + """, k AS (SELECT match_id, seq, ts_ms, value // 25 AS key FROM rd WHERE value IS NOT NULL),
s AS (SELECT *, lead(key) OVER w AS nkey, lead(ts_ms) OVER w AS nts FROM k WINDOW w AS (PARTITION BY match_id ORDER BY ts_ms, seq)),
v AS (SELECT match_id, seq, lag(ts_ms) OVER w AS o, ts_ms AS n, lag(key) OVER w AS ok, key AS nk FROM k WINDOW w AS (PARTITION BY match_id ORDER BY ts_ms, seq)),
m AS (SELECT v.match_id, v.seq, s.ts_ms - v.n AS low, s.nts - v.o AS high, row_number() OVER (PARTITION BY v.match_id, v.seq ORDER BY s.ts_ms, s.nts) AS z
  FROM v JOIN s ON s.match_id = v.match_id AND s.key = v.ok AND s.nkey = v.nk AND v.ok <> v.nk AND s.ts_ms > v.o - 3600000 AND s.ts_ms <= v.n + 3600000)
SELECT match_id, seq, low, high FROM m WHERE z = 1""")
def change_bounds(spark, d):
    """The offset between two views of every reading, as bounded by each change that both show."""
    rows = _series(spark, d).where("value is not null").select("match_id", "seq", "ts_ms", F.expr("value div 25").alias("key"))
    w = Window.partitionBy("match_id").orderBy("ts_ms", "seq")
    seen = rows.select(
        "match_id",
        "seq",
        F.lag("ts_ms").over(w).alias("old_ms"),
        F.col("ts_ms").alias("new_ms"),
        F.lag("key").over(w).alias("old_key"),
        F.col("key").alias("new_key"),
    )
    return retime.change_bounds(seen.where("old_key <> new_key"), rows, 0, HOUR)


@query(CTE + ", o AS (SELECT r.match_id, r.seq, r.value, row_number() OVER (PARTITION BY match_id ORDER BY ts_ms, seq) AS i FROM rd r) SELECT a.match_id, a.seq, bool_or(a.value = b.value) AS agrees FROM o a JOIN o b ON b.match_id = a.match_id AND b.i BETWEEN a.i - 1 AND a.i + 1 AND b.i <> a.i WHERE a.value IS NOT NULL GROUP BY ALL")
def neighbour_agreement(spark, d):
    w = Window.partitionBy("match_id").orderBy("ts_ms", "seq")
    x = _series(spark, d).withColumn("a", F.lag("value").over(w)).withColumn("b", F.lead("value").over(w)).withColumn(
        "alone",
        F.count("*").over(Window.partitionBy("match_id")) == 1,
    )
    agrees = F.when(
        (F.col("a") == F.col("value")) | (F.col("b") == F.col("value")),
        True,
    ).when(F.col("a").isNull() & F.col("b").isNull(), F.lit(None)).otherwise(False)
    return x.where("value is not null and not alone").select("match_id", "seq", agrees.alias("agrees"))


QUERIES["change_bounds_all"], ORACLE_SQL["change_bounds_all"] = QUERIES["change_bounds"], ORACLE_SQL["change_bounds"]
