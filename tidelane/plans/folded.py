"""Queries of the sequential operators; their SQL is recursive. The calibration has none and is tested on made games."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelane.operators import anomalies, folds
from tidelane.plans.tables import CTE, readings, spends
from tidelane.plans.temporal import HOUR
from tidelane.sync.calibrate import PANEL, calibrate_matches


def _readings(spark, d):
    return readings(spark, d).select("match_id", "seq", "ts_ms", "value")


def smooth_spikes(spark, d):
    return folds.smooth_readings(_readings(spark, d))


def resample_last_kept(spark, d):
    return folds.resample(_readings(spark, d), 12 * HOUR)


def _frames(spark, d):
    color = F.when(F.col("value") > 80, "overlay").when(F.col("value") > 50, "yellow").otherwise("white")
    return _readings(spark, d).withColumn("color", color).withColumn("pop_curr", F.col("value").cast("int")).withColumn("pop_max", F.lit(100))


def bridge_states(spark, d):
    return folds.bridge_states(_frames(spark, d), 24 * HOUR, 48 * HOUR)


def greedy_match(spark, d):
    falls = anomalies.drops(_readings(spark, d), 6 * HOUR).select("match_id", "seq", F.col("at_ms").cast("long").alias("ts_ms"), "delta")
    return folds.greedy_match(spends(spark, d), falls, before=6 * HOUR, after=12 * HOUR, delay=HOUR, fraction=0.4)


def recorder_policy(spark, d):
    """A frame without a reading, from the 40th of a match on, is one on which the match is lost."""
    place = F.row_number().over(Window.partitionBy("match_id").orderBy("ts_ms", "seq"))
    frames = _frames(spark, d).withColumn("lost", F.col("value").isNull() & (place >= 40))
    return folds.recorded(frames, ["value"], [], interval=24 * HOUR, gap=2 * HOUR, jump=50, window=12 * HOUR)


def session_roles(spark, d):
    x = _readings(spark, d)
    return folds.sessions(x.withColumn("readable", F.col("value").isNotNull()).withColumn("complete", F.coalesce(F.col("value") > 30, F.lit(False))))


def calibrate(spark, d):
    """Clocks of users against themselves: real time is event time, game time runs 1.7 times as fast from their first event."""
    r, s = _readings(spark, d), spends(spark, d)
    quarter = F.expr("ts_ms div 10000")
    panel = r.select(
        "match_id",
        quarter.alias("ts_ms"),
        *[F.col("value").cast("int").alias(c) if c == "food" else F.lit(None).cast("int").alias(c) for c in PANEL],
    )
    cost = s.select(
        "match_id",
        "seq",
        (quarter * 1.7).alias("ig_ms"),
        F.col("cost").alias("food"),
        *[F.lit(0).cast("long").alias(c) for c in ("wood", "gold", "stone")],
    )
    return calibrate_matches(panel, cost)


QUERIES = {f.__name__: f for f in (smooth_spikes, resample_last_kept, bridge_states, greedy_match, recorder_policy, session_roles, calibrate)}
ORACLE_SQL: dict[str, str] = {
    "resample_last_kept": CTE.replace("WITH", "WITH RECURSIVE", 1)
    + """, kept(match_id, ts_ms) AS (
  SELECT match_id, min(ts_ms) FROM rd GROUP BY match_id
  UNION ALL
  SELECT * FROM (SELECT k.match_id, (SELECT min(r.ts_ms) FROM rd r WHERE r.match_id = k.match_id AND r.ts_ms >= k.ts_ms + 43200000) AS t FROM kept k) WHERE t IS NOT NULL)
SELECT rd.match_id, rd.seq, rd.ts_ms FROM rd JOIN kept USING (match_id, ts_ms)""",
    "smooth_spikes": CTE.replace("WITH", "WITH RECURSIVE", 1)
    + """, s AS (SELECT match_id, seq, value, row_number() OVER (PARTITION BY match_id ORDER BY ts_ms, seq) AS n FROM rd),
ends AS (SELECT a.match_id, a.n AS i, b.n AS j, a.value AS v, b.value AS w FROM s a JOIN s b ON b.match_id = a.match_id AND b.n BETWEEN a.n + 2 AND a.n + 9 AND abs(b.value - a.value) < 2),
far AS (
  SELECT e.match_id, e.i, e.j FROM ends e JOIN s ON s.match_id = e.match_id AND s.n > e.i AND s.n < e.j GROUP BY ALL
  HAVING bool_and(s.value IS NULL OR abs(s.value - (e.v + (e.w - e.v) * (s.n - e.i) / (e.j - e.i)::DOUBLE)) >= 2)),
hop AS (SELECT match_id, i, min(j) AS j FROM far GROUP BY ALL),
walk(match_id, i, j) AS (
  SELECT s.match_id, CAST(1 AS BIGINT), hop.j FROM s LEFT JOIN hop ON hop.match_id = s.match_id AND hop.i = 1 WHERE s.n = 1
  UNION ALL
  SELECT w.match_id, s.n, hop.j FROM walk w JOIN s ON s.match_id = w.match_id AND s.n = coalesce(w.j, w.i + 1) LEFT JOIN hop ON hop.match_id = s.match_id AND hop.i = s.n),
line AS (
  SELECT s.match_id, s.seq, s.value, a.value AS v, b.value AS w, (s.n - k.i) / (k.j - k.i)::DOUBLE AS part
  FROM s LEFT JOIN walk k ON k.match_id = s.match_id AND s.n > k.i AND s.n < k.j LEFT JOIN s a ON a.match_id = k.match_id AND a.n = k.i LEFT JOIN s b ON b.match_id = k.match_id AND b.n = k.j)
SELECT match_id, seq, value AS before, CASE WHEN v IS NULL THEN value ELSE CAST(round(v + (w - v) * part) AS BIGINT) END AS after FROM line""",
    # whether a frame is held, and what closes over it, follow from the last overlay and the last coloured frame alone
    "bridge_states": CTE
    + """, f AS (
  SELECT match_id, seq, ts_ms, CASE WHEN value > 80 THEN 'overlay' WHEN value > 50 THEN 'yellow' ELSE 'white' END AS color, 100 - coalesce(value, 0) AS gap,
    row_number() OVER (PARTITION BY match_id ORDER BY ts_ms, seq) AS n FROM rd),
a AS (
  SELECT *, last_value(CASE WHEN color = 'overlay' THEN n END IGNORE NULLS) OVER w AS o, last_value(CASE WHEN color <> 'white' THEN n END IGNORE NULLS) OVER w AS c FROM f
  WINDOW w AS (PARTITION BY match_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (
  SELECT a.*, coalesce(a.ts_ms - x.ts_ms <= 86400000, false) AS housed, coalesce(a.ts_ms - y.ts_ms <= 172800000, false) AS queued, x.gap AS ogap, y.gap AS cgap, x.ts_ms AS ots, y.ts_ms AS cts, y.color AS ccolor
  FROM a LEFT JOIN f x ON x.match_id = a.match_id AND x.n = a.o LEFT JOIN f y ON y.match_id = a.match_id AND y.n = a.c),
r AS (  -- frames that let go of all that is held before them
  SELECT *, color = 'overlay' OR (color = 'yellow' AND NOT housed) OR (color = 'white' AND NOT housed AND NOT queued) AS frees FROM k),
g AS (SELECT *, coalesce(sum(CASE WHEN frees THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM r),
z AS (SELECT match_id, part, bool_or(frees) AS freed FROM g GROUP BY ALL),
whites AS (
  SELECT x.match_id, x.n, coalesce(bool_or(y.color = 'overlay' AND y.housed AND x.gap <= greatest(y.ogap, y.gap)), false) AS house,
    coalesce(bool_or(y.color <> 'white' AND y.queued AND x.gap <= greatest(y.cgap, y.gap)), false) AS queue
  FROM g x LEFT JOIN g y ON y.match_id = x.match_id AND y.part = x.part AND y.n > x.n AND y.color <> 'white'
  WHERE x.color = 'white' AND (x.housed OR x.queued) GROUP BY ALL),
late AS (  -- what is held at a match's end takes the state of the coloured frame before it
  SELECT x.match_id, x.n, x.ts_ms, x.gap, CASE WHEN inner_.n IS NOT NULL THEN inner_.color WHEN over.n IS NOT NULL THEN 'overlay' ELSE x.ccolor END AS color,
    CASE WHEN inner_.n IS NOT NULL THEN inner_.ts_ms WHEN over.n IS NOT NULL THEN over.ts_ms ELSE x.cts END AS at,
    CASE WHEN inner_.n IS NOT NULL THEN inner_.gap WHEN over.n IS NOT NULL THEN over.gap ELSE x.cgap END AS agap
  FROM g x JOIN z ON z.match_id = x.match_id AND z.part = x.part AND NOT z.freed
  LEFT JOIN g inner_ ON inner_.match_id = x.match_id AND inner_.part = x.part AND inner_.color <> 'white' AND inner_.n = x.c
  LEFT JOIN (SELECT match_id, part, max(o) AS o FROM g GROUP BY ALL) t ON t.match_id = x.match_id AND t.part = x.part
  LEFT JOIN g over ON over.match_id = x.match_id AND over.n = t.o AND NOT EXISTS (SELECT 1 FROM g q WHERE q.match_id = x.match_id AND q.n > t.o AND q.color = 'yellow' AND NOT q.housed)
  WHERE x.color = 'white')
SELECT g.match_id, g.seq, g.ts_ms, g.color, CASE
    WHEN g.color = 'overlay' THEN 'housed' WHEN g.color = 'yellow' THEN 'queued' WHEN w.house THEN 'housed' WHEN w.queue THEN 'queued'
    WHEN w.n IS NOT NULL AND l.n IS NOT NULL AND l.gap <= l.agap AND l.color = 'overlay' AND l.ts_ms - l.at <= 86400000 THEN 'housed'
    WHEN w.n IS NOT NULL AND l.n IS NOT NULL AND l.gap <= l.agap AND l.ts_ms - l.at <= 172800000 THEN 'queued' ELSE 'normal' END AS state
FROM g LEFT JOIN whites w ON w.match_id = g.match_id AND w.n = g.n LEFT JOIN late l ON l.match_id = g.match_id AND l.n = g.n""",
    "recorder_policy": CTE.replace("WITH", "WITH RECURSIVE", 1)
    + """, f AS (
  SELECT match_id, seq, ts_ms, value, coalesce(value > 50, false) AS lit, row_number() OVER (PARTITION BY match_id ORDER BY ts_ms, seq) AS n FROM rd),
lost AS (SELECT match_id, min(n) AS n FROM f WHERE value IS NULL AND n >= 40 GROUP BY match_id),
st(match_id, n, seq, value, saved, lamp, reason, prior) AS (
  SELECT match_id, n, seq, value, ts_ms, CASE WHEN lit THEN ts_ms END, CASE WHEN lit THEN 'pop_color:start' ELSE 'first' END, CAST(NULL AS BIGINT) FROM f WHERE n = 1
  UNION ALL
  SELECT match_id, n, seq, value, CASE WHEN reason IS NULL THEN saved ELSE ts_ms END, lamp, reason, CASE WHEN reason = 'change:value' AND open THEN old END FROM (
    SELECT *, CASE WHEN moved THEN 'change:value' WHEN turned IS NOT NULL THEN turned WHEN ts_ms - saved >= 86400000 THEN 'interval' END AS reason FROM (
      SELECT f.match_id, f.n, f.seq, f.value, f.ts_ms, st.saved, st.seq AS old, st.reason IS NULL AS open,
        CASE WHEN f.lit THEN f.ts_ms WHEN f.ts_ms - st.lamp >= 43200000 THEN NULL ELSE st.lamp END AS lamp,
        CASE WHEN f.lit AND st.lamp IS NULL THEN 'pop_color:start' WHEN NOT f.lit AND f.ts_ms - st.lamp >= 43200000 THEN 'pop_color:end' END AS turned,
        f.ts_ms - st.saved >= 7200000 AND ((f.value IS NULL) <> (st.value IS NULL) OR coalesce(abs(f.value - st.value) >= 50, false)) AS moved
      FROM st JOIN f ON f.match_id = st.match_id AND f.n = st.n + 1 LEFT JOIN lost ON lost.match_id = f.match_id WHERE lost.n IS NULL OR f.n < lost.n)))
SELECT match_id, seq, reason FROM st WHERE reason IS NOT NULL
UNION ALL SELECT match_id, prior, 'before' FROM st WHERE prior IS NOT NULL
UNION ALL SELECT f.match_id, f.seq, 'end' FROM f JOIN lost ON lost.match_id = f.match_id AND lost.n = f.n""",
    "greedy_match": CTE.replace("WITH", "WITH RECURSIVE", 1)
    + """, fall AS (
  SELECT match_id, list(mid ORDER BY mid, seq) AS ts, list(delta ORDER BY mid, seq) AS delta FROM (
    SELECT match_id, seq, CAST(trunc((prev_ts + ts_ms) / 2) AS BIGINT) AS mid, prev - value AS delta FROM nb2 WHERE value < prev AND ts_ms - prev_ts <= 21600000 AND NOT glitch AND NOT was_glitch) GROUP BY match_id),
want AS (SELECT match_id, seq, ts_ms, cost, row_number() OVER (PARTITION BY match_id ORDER BY ts_ms, seq) AS n FROM sp WHERE cost > 0),
step(match_id, n, seq, matched, offset_ms, got, remain) AS (
  SELECT w.match_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false, CAST(NULL AS BIGINT), CAST(0 AS BIGINT), coalesce(any_value(f.delta), []) FROM want w LEFT JOIN fall f ON f.match_id = w.match_id GROUP BY w.match_id
  UNION ALL
  SELECT match_id, n, seq, got >= 0.4 * cost, CASE WHEN got >= 0.4 * cost AND len(taken) > 0 THEN list_min(list_transform(taken, lambda t: ts[t.i])) - ts_ms END, got,
    CASE WHEN got >= 0.4 * cost THEN list_transform(range(1, len(remain) + 1), lambda i: remain[i] - CAST(coalesce(list_sum(list_transform(list_filter(taken, lambda t: t.i = i), lambda t: t.part)), 0) AS BIGINT)) ELSE remain END FROM (
    SELECT *, CAST(coalesce(list_sum(list_transform(taken, lambda t: t.part)), 0) AS BIGINT) AS got FROM (
      SELECT *, list_filter(list_transform(range(1, len(near) + 1), lambda j: {'i': near[j].i, 'before': before[j], 'part': least(remain[near[j].i], cost - before[j])}), lambda t: t.before < 0.4 * cost) AS taken FROM (
        SELECT *, list_transform(range(1, len(near) + 1), lambda j: CAST(coalesce(list_sum(list_transform(near[1:j - 1], lambda c: remain[c.i])), 0) AS BIGINT)) AS before FROM (
          SELECT w.match_id, w.n, w.seq, w.ts_ms, w.cost, s.remain, f.ts, list_sort(list_filter(list_transform(range(1, len(s.remain) + 1), lambda i: {'k': abs(f.ts[i] - w.ts_ms - 3600000), 'i': i}),
            lambda c: s.remain[c.i] > 0 AND f.ts[c.i] BETWEEN w.ts_ms - 21600000 AND w.ts_ms + 43200000)) AS near
          FROM step s JOIN want w ON w.match_id = s.match_id AND w.n = s.n + 1 LEFT JOIN fall f ON f.match_id = w.match_id))))) 
SELECT match_id, seq, matched, offset_ms, got FROM step WHERE n > 0""",
    "session_roles": CTE
    + """, a AS (SELECT match_id, min(ts_ms) AS t0 FROM rd WHERE value > 30 GROUP BY match_id),
b AS (SELECT rd.match_id, any_value(t0) AS t0, min(CASE WHEN ts_ms > t0 AND value IS NULL THEN ts_ms END) AS t1 FROM rd LEFT JOIN a ON a.match_id = rd.match_id GROUP BY rd.match_id)
SELECT rd.match_id, seq, CASE WHEN t0 IS NULL OR ts_ms < t0 THEN 'idle' WHEN ts_ms = t0 THEN 'start' WHEN t1 IS NULL OR ts_ms < t1 THEN 'row' WHEN ts_ms = t1 THEN 'end' ELSE 'after' END AS role
FROM rd JOIN b ON b.match_id = rd.match_id""",
}
