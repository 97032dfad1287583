"""The whole analysis over made games: users are matches whose panel and replay follow from their events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane import constants as C
from tidelane.plans import analyze as A
from tidelane.plans import report
from tidelane.plans import tables
from tidelane.sources.telemetry import kept

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: An hour of the event table is a second of real time; the game runs twice as fast and begins this late.
HOUR_MS, SPEED, LATE = 3600, 2.0, 20_000
#: What each number of the panel shows for a reading v; the same text in both dialects.
PANEL = {
    "food": "v * 10", "wood": "v * 37 % 1100", "gold": "v * 53 % 900", "stone": "v * 71 % 700",
    "pop_curr": "v", "pop_max": "v + seq % 3", "pop_vils": "v - v % 10 + seq % 13", "idle_vils": "v % 9 * (seq % 4)",
}
_HOUSING = "CASE WHEN v IS NULL THEN NULL WHEN v % 3 = 0 THEN 'normal' WHEN v % 3 = 1 THEN 'queued' ELSE 'housed' END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def readings(spark, d) -> DataFrame:
    r = tables.readings(spark, d).select("match_id", "seq", F.expr(f"ts_ms div {HOUR_MS}").alias("ts_ms"), F.col("value").alias("v"))
    return r.select("match_id", "seq", "ts_ms", *[F.expr(e).cast("int").alias(c) for c, e in PANEL.items()], F.expr(_HOUSING).alias("housing"))


def replay(spark, d) -> DataFrame:
    """Sign-ups research an age; of purchases every eleventh is a deletion, every fifth a castle, others queue a unit."""
    start = readings(spark, d).groupBy("match_id").agg((F.min("ts_ms") + LATE).alias("t0"))
    e = tables.events(spark, d).where("kind in ('signup', 'purchase')").join(start, "match_id")
    e = e.withColumn("ig", F.expr(f"(ts_ms div {HOUR_MS} - t0) * 2 + 1")).withColumn("cost", F.floor("amount").cast("long"))
    kind = F.when(F.col("kind") == "signup", "research").when(F.expr("seq % 11 = 0"), "delete").when(F.expr("seq % 5 = 0"), "build").otherwise("queue")
    text = F.when(kind == "research", "Research age").when(kind == "delete", "Delete x").when(kind == "build", "Build Castle").otherwise("Queue unit")
    type_id = F.when(kind == "research", 101 + F.col("seq") % 3).otherwise(F.lit(7)).cast("long")
    of = lambda k, c: F.when(kind == k, c).otherwise(0).cast("long")
    cost = [
        of("queue", F.col("cost")).alias("food"),
        F.lit(0).cast("long").alias("wood"),
        of("queue", F.col("cost") % 50).alias("gold"),
        of("build", F.lit(650)).alias("stone"),
    ]
    ids = F.array(F.col("seq")).alias("building_ids")
    return e.select(
        "match_id",
        "seq",
        F.col("ig").alias("ts_ms"),
        kind.alias("kind"),
        type_id.alias("type_id"),
        text.alias("description"),
        *cost,
        ids,
        F.array(F.lit("b")).alias("building_types"),
        F.lit(False).alias("gives_resources"),
    )


def maps(spark, d) -> DataFrame:
    """Every match's clock, as a calibration would give it."""
    start = readings(spark, d).groupBy("match_id").agg((F.min("ts_ms") + LATE).cast("double").alias("rw"))
    return start.select(
        "match_id",
        F.lit("ok").alias("status"),
        F.array(F.struct("rw", F.lit(0.0).alias("ig"))).alias("knots"),
        F.lit(SPEED).alias("speed_before"),
        F.lit(SPEED).alias("speed_after"),
    )


def line(spark, d) -> DataFrame:
    return A.timeline(readings(spark, d), replay(spark, d), maps(spark, d))


def _kept_line(spark, d) -> DataFrame:
    """The timeline, written once: findings read it several times."""
    return kept(line(spark, d), "timeline")


_GAMES = f"""WITH e AS (SELECT user_id AS match_id, event_id AS seq, (epoch_us(ts) // 1000) // {HOUR_MS} AS ts, event_type AS kind, value AS amount FROM events),
v AS (SELECT match_id, seq, ts, CASE WHEN kind <> 'error' THEN CAST(floor(amount) AS BIGINT) END AS v FROM e WHERE kind IN ('view', 'click', 'error')),
t AS (SELECT match_id, min(ts) + {LATE} AS t0 FROM v GROUP BY match_id),
shot AS (SELECT v.match_id, v.seq, v.ts, (v.ts - t0) * 2 AS ig, {", ".join(f"CAST({x} AS INTEGER) AS {c}" for c, x in PANEL.items())}, {_HOUSING} AS housing FROM v JOIN t ON t.match_id = v.match_id),
fin AS (SELECT match_id, greatest(arg_max(ig, ts), 0) AS fin FROM shot GROUP BY match_id),
act0 AS (
  SELECT e.match_id, e.seq, (e.ts - t0) * 2 + 1 AS ig, CAST(floor(amount) AS BIGINT) AS cost,
    CASE WHEN kind = 'signup' THEN 'research' WHEN e.seq % 11 = 0 THEN 'delete' WHEN e.seq % 5 = 0 THEN 'build' ELSE 'queue' END AS kind FROM e JOIN t ON t.match_id = e.match_id WHERE kind IN ('signup', 'purchase')),
act AS (
  SELECT a.match_id, seq, ig, kind, CASE WHEN kind = 'research' THEN 101 + seq % 3 ELSE 7 END AS type_id, CASE kind WHEN 'research' THEN 'Research age' WHEN 'delete' THEN 'Delete x' WHEN 'build' THEN 'Build Castle' ELSE 'Queue unit' END AS description,
    CASE WHEN kind = 'queue' THEN cost ELSE 0 END AS food, CASE WHEN kind = 'queue' THEN cost % 50 ELSE 0 END AS gold, CASE WHEN kind = 'build' THEN 650 ELSE 0 END AS stone
  FROM act0 a JOIN fin ON fin.match_id = a.match_id WHERE ig <= fin),
scr AS (SELECT * FROM shot WHERE ig >= 0),
clk AS (SELECT match_id, seq, ig, CAST(type_id - 100 AS INTEGER) AS phase FROM act WHERE kind = 'research'),
eff AS (SELECT * FROM clk QUALIFY ig = max(ig) OVER (PARTITION BY match_id, phase)),
base AS (
  SELECT match_id, ig AS ts, 1 AS rank, seq, NULL::INTEGER AS phase FROM scr
  UNION ALL SELECT a.match_id, a.ig, 0, a.seq, eff.phase FROM act a LEFT JOIN eff ON eff.match_id = a.match_id AND eff.seq = a.seq),
now AS (
  SELECT *, coalesce(last_value(phase IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY ts, rank, seq ROWS UNBOUNDED PRECEDING), 0) AS now, max(ts) OVER (PARTITION BY match_id) AS fin FROM base)
"""


@query(
    _GAMES
    + f"""SELECT match_id, 'screen' AS src, 1 AS rank, seq, ig AS in_game_ms, ts AS ts_ms, {", ".join(PANEL)}, housing, NULL AS kind, NULL::BIGINT AS type_id, NULL AS description, NULL::BIGINT AS cost_food, NULL::BIGINT AS cost_gold, NULL::BIGINT AS cost_stone FROM scr
UNION ALL SELECT match_id, 'event', 0, seq, ig, NULL, {", ".join("NULL" for _ in PANEL)}, NULL, kind, type_id, description, food, gold, stone FROM act"""
)
def analysis_timeline(spark, d):
    """Readings from game start on and events until the last reading, in game time."""
    cols = [
        "match_id",
        "src",
        "rank",
        F.col("seq.seq").alias("seq"),
        "in_game_ms",
        "ts_ms",
        *PANEL,
        "housing",
        "kind",
        "type_id",
        "description",
        "cost_food",
        "cost_gold",
        "cost_stone",
    ]
    return line(spark, d).select(*cols)


def _floats() -> str:
    """SQL of time above the phase's threshold, less what is saved for, in pieces of 30 s or more."""
    holes = {
        "food": "SELECT match_id, ig FROM clk",
        "gold": "SELECT match_id, ig FROM clk WHERE phase >= 2",
        "stone": "SELECT match_id, ig FROM act WHERE description = 'Build Castle'",
        "wood": "SELECT match_id, ig FROM clk WHERE false",
    }
    out = []
    for i, r in enumerate(C.RESOURCES):
        levels = [t[i] for t in C.THRESHOLDS]
        out.append(f"""o_{r} AS (
  SELECT n.match_id, n.ts, n.rank, n.seq, n.phase, n.now, n.fin, CASE WHEN n.phase IS NOT NULL THEN false ELSE s.{r} > {levels}[n.now + 1] END AS over
  FROM now n LEFT JOIN scr s ON n.rank = 1 AND s.match_id = n.match_id AND s.seq = n.seq WHERE n.phase IS NOT NULL OR s.{r} IS NOT NULL),
w_{r} AS (SELECT *, coalesce(lag(over) OVER (PARTITION BY match_id ORDER BY ts, rank, seq), false) AS was FROM o_{r}),
r_{r} AS (SELECT * FROM (
  SELECT match_id, now AS phase, ts AS a, over, coalesce(lead(ts) OVER (PARTITION BY match_id ORDER BY ts, rank, seq), fin) AS b FROM w_{r} WHERE over <> was OR phase IS NOT NULL) WHERE over AND b > a),
h_{r} AS (SELECT match_id, greatest(ig - {C.SAVE_UP_MS}, 0) AS a, ig AS b FROM ({holes[r]})),
c_{r} AS (  -- what of a run no hole covers: from its start, or a hole's end, to the next hole
  SELECT DISTINCT r.match_id, r.phase, r.a AS ra, r.b AS rb, p.at FROM r_{r} r, LATERAL (SELECT r.a AS at UNION SELECT h.b FROM h_{r} h WHERE h.match_id = r.match_id AND h.b > r.a AND h.b < r.b) p
  WHERE NOT EXISTS (SELECT 1 FROM h_{r} h WHERE h.match_id = r.match_id AND h.a <= p.at AND h.b > p.at)),
p_{r} AS (
  SELECT c.match_id, '{r}' AS resource, c.phase, c.at AS start_ms, coalesce((SELECT min(h.a) FROM h_{r} h WHERE h.match_id = c.match_id AND h.a > c.at AND h.a < c.rb AND h.b > h.a), c.rb) AS end_ms FROM c_{r} c)""")
    return ",\n" + ",\n".join(out) + ",\nfl AS (SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT * FROM p_{r}" for r in C.RESOURCES
    ) + f") WHERE end_ms - start_ms >= {C.FLOATING_MIN_MS})\n"


@query(_GAMES + _floats() + "SELECT match_id, resource, phase, start_ms, end_ms FROM fl")
def analysis_floating(spark, d):
    return A.floating(line(spark, d))


@query(
    _GAMES
    + _floats()
    + f"SELECT s.match_id, s.phase, {', '.join(f'''coalesce(sum(CASE WHEN resource = '{r}' THEN end_ms - start_ms END), 0) / 1000.0::DOUBLE AS {r}_s''' for r in C.RESOURCES)} FROM (SELECT DISTINCT match_id, now AS phase FROM now) s LEFT JOIN fl ON fl.match_id = s.match_id AND fl.phase = s.phase GROUP BY s.match_id, s.phase"
)
def analysis_floating_by_phase(spark, d):
    """Seconds of each of the four resources, a row for every phase that a match was in."""
    x = line(spark, d)
    return A.floating_by_phase(x, A.floating(x))


def _segments(name: str, value: str) -> str:
    return f"""i_{name} AS (
  SELECT n.*, {value} AS value FROM now n LEFT JOIN scr s ON n.rank = 1 AND s.match_id = n.match_id AND s.seq = n.seq),
j_{name} AS (
  SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY ts, rank, seq ROWS UNBOUNDED PRECEDING) AS cur,
    last_value(value IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY ts, rank, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM i_{name}),
g_{name} AS (
  SELECT match_id, ts AS a, coalesce(lead(ts) OVER w, fin) AS b, cur AS value, now AS phase, CASE WHEN lead(ts) OVER w IS NULL THEN 'end' WHEN lead(phase) OVER w IS NOT NULL THEN 'phase' ELSE 'value' END AS reason
  FROM j_{name} WHERE (value IS NOT NULL AND value IS DISTINCT FROM old) OR (phase IS NOT NULL AND cur IS NOT NULL) WINDOW w AS (PARTITION BY match_id ORDER BY ts, rank, seq))"""


_CODE = "CASE s.housing WHEN 'housed' THEN 2 WHEN 'queued' THEN 1 WHEN 'normal' THEN 0 END"
_GRADED = f""",
{_segments("vils", "s.pop_vils")},
{_segments("idle", "s.idle_vils")},
{_segments("house", _CODE)},
sums AS (
  SELECT l.match_id, l.length, i.lost, w.whole, h.housed, h.time FROM (SELECT match_id, max(ts) - min(ts) AS length FROM now GROUP BY match_id) l
  LEFT JOIN (SELECT match_id, sum((b - a) * value) AS lost FROM g_idle GROUP BY match_id) i ON i.match_id = l.match_id
  LEFT JOIN (SELECT match_id, sum((b - a) * value) AS whole FROM g_vils GROUP BY match_id) w ON w.match_id = l.match_id
  LEFT JOIN (SELECT match_id, sum(CASE WHEN value = 2 THEN b - a ELSE 0 END) AS housed, sum(b - a) AS time FROM g_house GROUP BY match_id) h ON h.match_id = l.match_id),
pct AS (
  SELECT match_id, CASE WHEN length > 0 THEN round(CASE WHEN whole > 0 THEN coalesce(lost, 0)::DOUBLE / whole ELSE 0 END * 100 * 10) / 10 END AS idle_pct,
    CASE WHEN length > 0 THEN round(CASE WHEN time > 0 THEN coalesce(housed, 0)::DOUBLE / time ELSE 0 END * 100 * 10) / 10 END AS housed_pct FROM sums),
graded AS (
  SELECT match_id, idle_pct, CASE WHEN idle_pct IS NULL THEN 'none' WHEN idle_pct < 2 THEN 'gold' WHEN idle_pct < 4 THEN 'silver' ELSE 'bronze' END AS idle_tier,
    CASE WHEN idle_pct IS NULL THEN 0 WHEN idle_pct < 2 THEN 3 WHEN idle_pct < 4 THEN 2 ELSE 1 END AS idle_stars, housed_pct,
    CASE WHEN housed_pct IS NULL THEN 'none' WHEN housed_pct < 2 THEN 'gold' WHEN housed_pct < 4 THEN 'silver' ELSE 'bronze' END AS housed_tier,
    CASE WHEN housed_pct IS NULL THEN 0 WHEN housed_pct < 2 THEN 3 WHEN housed_pct < 4 THEN 2 ELSE 1 END AS housed_stars FROM pct)
"""


@query(_GAMES + _GRADED + "SELECT *, CASE WHEN idle_pct IS NULL THEN 'none' WHEN idle_stars + housed_stars >= 6 THEN 'gold' WHEN idle_stars + housed_stars >= 4 THEN 'silver' ELSE 'bronze' END AS overall_tier FROM graded")
def analysis_grades(spark, d):
    return A.grades(line(spark, d), maps(spark, d).select("match_id"))


@query(_GAMES + _GRADED + "SELECT match_id, NULL::DOUBLE AS idle_pct, 'none' AS idle_tier, 0 AS idle_stars, NULL::DOUBLE AS housed_pct, 'none' AS housed_tier, 0 AS housed_stars, 'none' AS overall_tier FROM graded")
def grades_without_replay(spark, d):
    """Matches without a replay have no grade."""
    return A.grades(line(spark, d), maps(spark, d).where("false").select("match_id"))


@query(
    _GAMES
    + _floats()
    + f"""SELECT match_id, seq, ig AS ts_ms, lpad(CAST(ig // 60000 AS VARCHAR), CAST(greatest(2, len(CAST(ig // 60000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(ig % 60000 // 1000 AS VARCHAR), 2, '0') AS label, {", ".join(PANEL)}, coalesce(housing = 'housed', false) AS housed,
  {", ".join(f"EXISTS (SELECT 1 FROM fl WHERE fl.match_id = scr.match_id AND resource = '{r}' AND scr.ig BETWEEN start_ms AND end_ms) AS floating_{r}" for r in C.RESOURCES)} FROM scr"""
)
def analysis_chart(spark, d):
    """Each reading's label and flags as the report's charts show them."""
    x = line(spark, d)
    return A.chart(x, A.floating(x)).withColumn("seq", F.col("seq.seq"))


def _findings() -> str:
    parts = []
    for c in (*C.RESOURCES, "pop_curr", "pop_max", "pop_vils"):
        series = f"""(SELECT *, coalesce(lag(glitch) OVER (PARTITION BY match_id ORDER BY ig, seq), false) AS was FROM (SELECT *, coalesce(prev = next AND value <> prev, false) AS glitch FROM (
    SELECT match_id, seq, ig, {c} AS value, lag({c}) OVER w AS prev, lead({c}) OVER w AS next FROM scr WHERE {c} IS NOT NULL WINDOW w AS (PARTITION BY match_id ORDER BY ig, seq))))"""
        if c in C.RESOURCES:
            parts.append(
                f"SELECT match_id, 'glitch' AS section, ig AS in_game_ms, '{c}' AS field, prev || ' -> ' || value || ' -> ' || next AS detail FROM {series} WHERE glitch"
            )
            parts.append(f"""SELECT x.match_id, 'increase', x.ig, '{c}', '+' || (value - prev) FROM {series} x WHERE value > prev + {C.LARGE_INCREASE} AND NOT was
  AND NOT EXISTS (SELECT 1 FROM act WHERE act.match_id = x.match_id AND act.kind = 'delete' AND act.ig BETWEEN x.ig - {C.AFTER_MS} AND x.ig + {C.BEFORE_MS})""")
        else:
            parts.append(
                f"SELECT match_id, 'glitch', ig, '{c}', prev || ' -> ' || value || ' -> ' || next FROM {series} WHERE prev IS NOT NULL AND next IS NOT NULL AND (value + {C.POP_SPIKE} < least(prev, next) OR value > greatest(prev, next) + {C.POP_SPIKE})"
            )
    for big, small in (("pop_vils", "pop_curr"), ("idle_vils", "pop_vils")):
        parts.append(f"""SELECT match_id, 'invariant', min(ig), '{big}', '{big} > {small} in ' || count(*) || ' frames' FROM (
    SELECT match_id, ig, n - row_number() OVER (PARTITION BY match_id ORDER BY ig, seq) AS island FROM (
      SELECT match_id, ig, seq, {big} > {small} AS bad, row_number() OVER (PARTITION BY match_id ORDER BY ig, seq) AS n FROM scr) WHERE bad) GROUP BY match_id, island""")
    return "\nUNION ALL ".join(parts)


@query(_GAMES + _findings())
def sanity_findings(spark, d):
    """Glitches, spikes, increases without a refund and broken invariants of every match."""
    return A.misreads(_kept_line(spark, d))


@query(
    _GAMES
    + f""", f AS ({_findings()}),
r AS (SELECT *, row_number() OVER (PARTITION BY match_id, section ORDER BY in_game_ms, field, detail) AS n, count(*) OVER (PARTITION BY match_id, section) AS k FROM f)
SELECT match_id, section, 0 AS place, section || ': ' || k AS line FROM r WHERE n = 1
UNION ALL SELECT match_id, section, CAST(n AS INTEGER), '  ' || lpad(CAST(in_game_ms // 60000 AS VARCHAR), CAST(greatest(2, len(CAST(in_game_ms // 60000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(in_game_ms % 60000 // 1000 AS VARCHAR), 2, '0') || '.' || lpad(CAST(in_game_ms % 1000 AS VARCHAR), 3, '0') || ' ' || field || ': ' || detail
  FROM r WHERE n <= {C.EXAMPLES}
UNION ALL SELECT match_id, section, {C.EXAMPLES + 1}, '  ... ' || (k - {C.EXAMPLES}) || ' more' FROM r WHERE n = 1 AND k > {C.EXAMPLES}"""
)
def finding_lines(spark, d):
    """The lines of every match's findings: counts, first examples and what is left."""
    return report.finding_lines(sanity_findings(spark, d))


@query(
    _GAMES
    + _floats()
    + f""", c AS (
  SELECT match_id, seq, ig AS ts_ms, lpad(CAST(ig // 60000 AS VARCHAR), CAST(greatest(2, len(CAST(ig // 60000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(ig % 60000 // 1000 AS VARCHAR), 2, '0') AS label, {", ".join(PANEL)}, coalesce(housing = 'housed', false) AS housed,
    {", ".join(f"EXISTS (SELECT 1 FROM fl WHERE fl.match_id = scr.match_id AND resource = '{r}' AND scr.ig BETWEEN start_ms AND end_ms) AS floating_{r}" for r in C.RESOURCES)} FROM scr)
SELECT match_id, {", ".join(f"CAST(to_json(list({c} ORDER BY ts_ms, seq)) AS VARCHAR) AS {c}" for c in report.CHART)} FROM c GROUP BY match_id"""
)
def chart_arrays(spark, d):
    """The JSON arrays of every match's charts."""
    x = line(spark, d)
    return report.chart_columns(A.chart(x, A.floating(x)))


def _ledger() -> str:
    """Recursive SQL of the ledger: remain is what is left of each fall of a match after its first n spends."""
    paid = ("food", "gold", "stone")  # nothing costs wood in these games
    falls = " UNION ALL ".join(
        f"""SELECT match_id, ig, seq, {k} AS k, '{c}' AS resource, prev - value AS delta FROM (SELECT *, coalesce(lag(glitch) OVER (PARTITION BY match_id ORDER BY ig, seq), false) AS was FROM (
    SELECT *, coalesce(prev = next AND value <> prev, false) AS glitch FROM (SELECT match_id, seq, ig, {c} AS value, lag({c}) OVER w AS prev, lead({c}) OVER w AS next FROM scr WHERE {c} IS NOT NULL WINDOW w AS (PARTITION BY match_id ORDER BY ig, seq))))
  WHERE value < prev AND NOT glitch AND NOT was"""
        for k, c in enumerate(C.RESOURCES)
    )
    span = lambda xs, f: f"CAST(coalesce(list_sum(list_transform({xs}, lambda t: {f})), 0) AS BIGINT)"
    near = ", ".join(
        f"""list_sort(list_filter(list_transform(range(1, len(s.remain) + 1), lambda i: {{'k': abs(f.ts[i] - w.ig - {C.DELAY_MS}), 'i': i}}),
            lambda c: f.res[c.i] = '{r}' AND s.remain[c.i] > 0 AND f.ts[c.i] BETWEEN w.ig - {C.BEFORE_MS} AND w.ig + {C.AFTER_MS})) AS near_{r}"""
        for r in paid
    )
    before = ", ".join(f"list_transform(range(1, len(near_{r}) + 1), lambda j: {span(f'near_{r}[1:j - 1]', 'remain[t.i]')}) AS before_{r}" for r in paid)
    taken = ", ".join(
        f"list_filter(list_transform(range(1, len(near_{r}) + 1), lambda j: {{'i': near_{r}[j].i, 'before': before_{r}[j], 'part': least(remain[near_{r}[j].i], {r} - before_{r}[j])}}), lambda t: t.before < {C.TAKE_FRACTION} * {r}) AS taken_{r}"
        for r in paid
    )
    got = ", ".join(f"{span(f'taken_{r}', 't.part')} AS got_{r}" for r in paid)
    fine = " AND ".join(f"got_{r} >= {C.TAKE_FRACTION} * {r}" for r in paid)
    every = "list_concat(list_concat(taken_food, taken_gold), taken_stone)"
    return f""",
fall AS ({falls}),
lists AS (SELECT match_id, list(ig ORDER BY ig, seq, k) AS ts, list(resource ORDER BY ig, seq, k) AS res, list(delta ORDER BY ig, seq, k) AS delta FROM fall GROUP BY match_id),
want AS (
  SELECT a.match_id, a.seq, a.ig, a.description, a.food, a.gold, a.stone, row_number() OVER (PARTITION BY a.match_id ORDER BY a.ig, a.seq) AS n
  FROM act a JOIN (SELECT match_id, min(ig) AS t0 FROM scr GROUP BY match_id) t ON t.match_id = a.match_id WHERE a.ig >= t0 AND greatest(a.food, a.gold, a.stone) > 0),
step(match_id, n, fine, offset_ms, got_food, got_gold, got_stone, remain) AS (
  SELECT m.match_id, CAST(0 AS BIGINT), false, CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), coalesce(l.delta, [])
  FROM (SELECT match_id FROM want UNION SELECT match_id FROM lists) m LEFT JOIN lists l ON l.match_id = m.match_id
  UNION ALL
  SELECT match_id, n, fine, CASE WHEN fine AND len(every) > 0 THEN list_min(list_transform(every, lambda t: ts[t.i])) - ig END, got_food, got_gold, got_stone,
    CASE WHEN fine THEN list_transform(range(1, len(remain) + 1), lambda i: remain[i] - {span("list_filter(every, lambda t: t.i = i)", "t.part")}) ELSE remain END FROM (
    SELECT *, {fine} AS fine, {every} AS every FROM (
      SELECT *, {got} FROM (
        SELECT *, {taken} FROM (
          SELECT *, {before} FROM (
            SELECT w.*, s.remain, f.ts, {near}
            FROM step s JOIN want w ON w.match_id = s.match_id AND w.n = s.n + 1 LEFT JOIN lists f ON f.match_id = w.match_id)))))),
spent AS (SELECT w.*, s.fine, s.offset_ms, s.got_food, s.got_gold, s.got_stone FROM step s JOIN want w ON w.match_id = s.match_id AND w.n = s.n),
rest AS (
  SELECT * FROM (SELECT s.match_id, unnest(l.ts) AS ig, unnest(l.res) AS resource, unnest(s.remain) AS remain FROM step s JOIN lists l ON l.match_id = s.match_id QUALIFY s.n = max(s.n) OVER (PARTITION BY s.match_id))
  WHERE remain >= {C.LEAST_DROP})
"""


_RECURSIVE = _GAMES.replace("WITH", "WITH RECURSIVE", 1)
_RESEED = f"resource = 'wood' AND remain BETWEEN {C.RESEED_LOW} AND {C.RESEED_HIGH}"
_SHORT = [f"CASE WHEN {r} > 0 AND got_{r} < {C.TAKE_FRACTION} * {r} THEN '{r}' END" for r in ("food", "gold", "stone")]


@query(
    _RECURSIVE
    + _ledger()
    + f"""SELECT m.match_id, coalesce(s.matched, 0) AS matched, coalesce(s.total, 0) AS total, coalesce(r.reseeds, 0) AS reseeds, s.median_ms
FROM (SELECT match_id FROM spent UNION SELECT match_id FROM rest) m
LEFT JOIN (SELECT match_id, CAST(sum(CASE WHEN fine THEN 1 ELSE 0 END) AS BIGINT) AS matched, count(*) AS total,
  list_sort(list(offset_ms) FILTER (WHERE offset_ms IS NOT NULL))[(count(offset_ms) - 1) * 50 // 100 + 1] AS median_ms FROM spent GROUP BY match_id) s ON s.match_id = m.match_id
LEFT JOIN (SELECT match_id, CAST(sum(CASE WHEN {_RESEED} THEN 1 ELSE 0 END) AS BIGINT) AS reseeds FROM rest GROUP BY match_id) r ON r.match_id = m.match_id"""
)
def sanity_spends(spark, d):
    """Matched and all spends of every match by the ledger of the four resources, reseeds, and the median offset."""
    return A.settled_spends(_kept_line(spark, d))[2]


def _why() -> str:
    """Per short resource of an unmatched spend: what the last reading before it showed, or that no drop was seen."""
    parts = []
    for r in ("food", "gold", "stone"):
        had = f"(SELECT arg_max({r}, struct_pack(ig := s.ig, seq := s.seq)) FROM scr s WHERE s.match_id = p.match_id AND s.ig <= p.ig AND s.{r} IS NOT NULL)"
        parts.append(f"""CASE WHEN {r} > 0 AND got_{r} < {C.TAKE_FRACTION} * {r} THEN '{r}: ' || CASE WHEN {had} < {r} THEN 'only ' || {had} || ' available for ' || {r} ELSE 'no drop of ~' || {r} || ' on screen' END END""")
    return f"concat_ws('; ', {', '.join(parts)})"


@query(
    _RECURSIVE
    + _ledger()
    + f"""SELECT match_id, 'unmatched' AS section, ig AS in_game_ms, coalesce({", ".join(_SHORT)}) AS field, description || ': ' || {_why()} AS detail FROM spent p WHERE NOT fine
UNION ALL SELECT match_id, 'unexplained', ig, resource, '-' || remain FROM rest WHERE NOT ({_RESEED})"""
)
def spend_findings(spark, d):
    """Spends that no drop explains, with the reason of each resource that falls short, and drops that no spend explains."""
    return A.spend_checks(_kept_line(spark, d))[0]
