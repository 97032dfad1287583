"""Queries of files and codecs, written and read again, and of the joins and samplers around recordings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelane import constants as C
from tidelane.functions import text
from tidelane.operators import anomalies, asof, folds, retime
from tidelane.plans import engine, folded, games, tables
from tidelane.plans.folded import HOUR
from tidelane.plans.tables import CTE, table
from tidelane.sources import telemetry as S
from tidelane.vision.layout import layout, write_layout

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# files --------------------------------------------------------------------------------------------------------------

_NUMBERS = ", ".join(games.PANEL)


@query(games._GAMES + f"SELECT ts AS ts_ms, {', '.join(f'CASE WHEN {c} >= 0 THEN {c} END AS {c}' for c in games.PANEL)}, housing FROM shot")
def telemetry_files(spark, d):
    """Readings as telemetry CSV and back."""
    path = S.workplace(spark, "telemetry")
    S.write_telemetry(games.readings(spark, d), path)
    return S.read_telemetry(spark, path).drop("match_id")


@query(
    games._GAMES
    + f"""SELECT ig AS in_game_ms, 'screen' AS src, NULL AS kind, NULL AS description, {_NUMBERS}, NULL::BIGINT AS cost_food, NULL::BIGINT AS cost_gold, NULL::BIGINT AS cost_stone, ts AS ts_ms, housing, NULL AS building_ids, NULL::BIGINT AS type_id FROM scr
UNION ALL SELECT ig, 'event', kind, description, {', '.join('NULL' for _ in games.PANEL)}, food, gold, stone, NULL, NULL, CAST(seq AS VARCHAR), type_id FROM act"""
)
def merged_files(spark, d):
    """The merged timeline as a CSV of sixteen columns and back."""
    path = S.workplace(spark, "merged")
    S.write_merged(games.line(spark, d), path)
    x = S.read_merged(spark, path).withColumn("building_ids", F.array_join(F.transform("building_ids", lambda i: i.cast("string")), ","))
    return x.select(
        "in_game_ms",
        "src",
        "kind",
        "description",
        *games.PANEL,
        "cost_food",
        "cost_gold",
        "cost_stone",
        "ts_ms",
        "housing",
        "building_ids",
        "type_id",
    )


@query(engine._GAME + "SELECT kind, id, name, food, wood, gold, stone FROM gd")
def game_data_file(spark, d):
    path = S.workplace(spark, "gamedata")
    engine.game_data(spark, d).write.csv(path, header=True)
    return S.read_game_data(spark, path)


@query("SELECT CAST(n_nationkey % 7 AS BIGINT) AS id, arg_max(n_name, n_nationkey) AS name FROM nation WHERE n_nationkey % 5 <> 0 GROUP BY 1")
def id_name_file(spark, d):
    """Rows without an id are skipped, and of repeated ids the last one holds."""
    path = S.workplace(spark, "names")
    key = F.when(F.col("n_nationkey") % 5 == 0, F.lit("x")).otherwise((F.col("n_nationkey") % 7).cast("string"))
    table(spark, d, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select(
        key.alias("ID"),
        F.col("n_name").alias("Name"),
    ).write.csv(path, header=True)
    return S.read_id_names(spark, path)


@query("""WITH u AS (SELECT 'unit' AS kind, n_nationkey AS id, n_name AS name, n_regionkey AS f FROM nation), b AS (SELECT 'building', r_regionkey, 'own ' || r_name, 0 FROM region WHERE r_regionkey = 2 UNION ALL SELECT 'building', r_regionkey, r_name, 0 FROM region WHERE r_regionkey <> 2)
SELECT kind, CAST(id AS BIGINT) AS id, name, CAST(f AS BIGINT) AS food, CAST(CASE WHEN kind = 'building' THEN 5 ELSE 0 END AS BIGINT) AS wood, CAST(0 AS BIGINT) AS gold, CAST(CASE WHEN kind = 'tech' THEN 9 ELSE 0 END AS BIGINT) AS stone
FROM (SELECT * FROM u UNION ALL SELECT * FROM b UNION ALL SELECT 'tech', n_nationkey + 100, n_name || ' tech', 0 FROM nation WHERE n_nationkey < 10)""")
def game_documents(spark, d):
    """Game data from its two JSON documents: nations are units and techs, regions buildings, one of which is renamed."""
    path = S.workplace(spark, "documents")
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    doc = lambda rows, key, value, name: rows.agg(F.map_from_entries(F.collect_list(F.struct(key.cast("string"), value))).alias(name))
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    cost = lambda k, v: F.struct(F.create_map(F.lit(k), v.cast("long")).alias("Cost"))
    up = F.struct((n + 100).alias("ID"), F.create_map(F.lit("Stone"), F.lit(9).cast("long")).alias("Cost"))
    costs = doc(nation, n, cost("Food", F.col("n_regionkey")), "Unit").join(doc(region, r, cost("Wood", F.lit(5)), "Building")).join(
        doc(nation.where("n_nationkey < 5"), n + 100, cost("Stone", F.lit(9)), "Tech")
    ).join(doc(nation.where("n_nationkey < 10"), n, up, "unit_upgrades"))
    costs.select(F.struct("Unit", "Building", "Tech", "unit_upgrades").alias("data")).coalesce(1).write.json(f"{path}/costs")
    told = lambda c: F.struct(c.alias("localised_name"))
    both = nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).unionByName(
        region.where("r_regionkey < 0").select(r.alias("k"), F.col("r_name").alias("name"))
    )
    names = doc(both, F.col("k"), told(F.col("name")), "units_buildings").join(doc(nation, n + 100, told(F.concat("n_name", F.lit(" tech"))), "techs"))
    names.coalesce(1).write.json(f"{path}/names")
    found, known = S.read_game_documents(spark, f"{path}/costs", f"{path}/names")
    own = region.select(
        F.lit("building").alias("kind"),
        r.alias("id"),
        F.when(r == 2, F.concat(F.lit("own "), "r_name")).otherwise(F.col("r_name")).alias("name"),
    )
    return S.merge_game_data(found, known, own)


_BOXES = """SELECT 263.0::DOUBLE AS baseline_margin, name, CAST(x AS DOUBLE) AS x_px, CAST(y AS DOUBLE) AS y_px, CAST(w AS DOUBLE) AS w_px, CAST(h AS DOUBLE) AS h_px, 1.0::DOUBLE AS split_pct FROM (
  SELECT ['wood', 'food', 'gold', 'stone', 'population'][i + 1] || '_total' AS name, 64 + i * 125 AS x, 25 AS y, CASE WHEN i = 4 THEN 75 ELSE 65 END AS w, 22 AS h FROM range(5) t(i)
  UNION ALL SELECT ['wood', 'food', 'gold', 'stone', 'population'][i + 1] || '_vils', 22 + i * 125, 47, 37, 16 FROM range(5) t(i)
  UNION ALL SELECT 'idle_vils', 64 + 4 * 125 + 92, 37, 37, 16)"""


@query(_BOXES)
def ui_map_file(spark, d):
    """The panel's layout, made, written as JSON and read."""
    path = S.workplace(spark, "layout")
    write_layout(layout(spark), path)
    return S.read_ui_map(spark, path)


@query("SELECT p_partkey || '.png' AS file, unnest(['food', 'wood']) AS key, unnest([CAST(p_size AS VARCHAR), 'x: ' || p_brand]) AS value FROM part")
def text_blocks(spark, d):
    """`key: value` lines under `File:` lines."""
    path = S.workplace(spark, "blocks")
    lines = F.array(
        F.concat(F.lit("File: "), F.col("p_partkey").cast("string"), F.lit(".png")),
        F.concat(F.lit(" food :  "), F.col("p_size").cast("string")),
        F.concat(F.lit("wood: x: "), "p_brand"),
        F.lit("no colon"),
    )
    table(spark, d, "part").select(F.explode(lines).alias("value")).write.text(path)
    return S.read_blocks(spark, path)


@query(CTE + "SELECT '{\"match_id\":' || match_id || ',\"seq\":' || seq || ',\"value\":' || coalesce(CAST(value AS VARCHAR), 'null') || ',\"kind\":\"' || kind || '\"}' AS value FROM rd")
def json_lines(spark, d):
    path = S.workplace(spark, "json")
    S.write_json(tables.readings(spark, d).select("match_id", "seq", "value", "kind"), path)
    return spark.read.text(path)


@query(CTE + "SELECT CAST(seq AS VARCHAR) AS seq, CASE WHEN value > 50 THEN CAST(value + 1 AS VARCHAR) ELSE coalesce(CAST(value AS VARCHAR), '') END AS value, kind FROM rd")
def rewritten_column(spark, d):
    """One column of a text table replaced where there is a new value; all others stay as they are."""
    x = tables.readings(spark, d)
    rows = x.select(F.col("seq").cast("string").alias("seq"), F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"), "kind")
    return S.rewrite_column(rows, "value", x.where("value > 50").select(F.col("seq").cast("string").alias("seq"), (F.col("value") + 1).alias("value")), "seq")


@query(folded.ORACLE_SQL["recorder_policy"].replace("SELECT match_id, seq, reason FROM st WHERE reason IS NOT NULL", "SELECT x.match_id, f.ts_ms || '.png' AS file, f.ts_ms, x.reason, f.seq || '' AS content FROM (SELECT match_id, seq, reason FROM st WHERE reason IS NOT NULL") + ") x JOIN f ON f.match_id = x.match_id AND f.seq = x.seq")
def saved_frame_files(spark, d):
    """The frames that the recorder saves, with their images and an index, written and read."""
    path = S.workplace(spark, "frames")
    frames = tables.readings(spark, d).select("match_id", "seq", "ts_ms", F.col("seq").cast("string").cast("binary").alias("content"))
    S.write_saved_frames(folded.recorder_policy(spark, d), frames, path)
    return spark.read.parquet(path).select(
        F.col("match_id").cast("long").alias("match_id"),
        "file",
        "ts_ms",
        "reason",
        F.col("content").cast("string").alias("content"),
    )


# recordings ---------------------------------------------------------------------------------------------------------


@query(
    games._GAMES
    + ", "
    + ", ".join(f"""n_{r} AS (SELECT *, coalesce(lag(glitch) OVER (PARTITION BY match_id ORDER BY ts, seq), false) AS was FROM (SELECT *, coalesce(prev = next AND value <> prev, false) AS glitch FROM (
  SELECT match_id, seq, ts, {r} AS value, lag({r}) OVER w AS prev, lead({r}) OVER w AS next, lag(ts) OVER w AS pts FROM shot WHERE {r} IS NOT NULL WINDOW w AS (PARTITION BY match_id ORDER BY ts, seq)))),
m_{r} AS (SELECT match_id, seq, ts, pts, '{r}' AS r, prev - value AS fall FROM n_{r} WHERE value < prev AND ts - pts <= 30000 AND NOT glitch AND NOT was)""" for r in C.RESOURCES)
    + f""" SELECT match_id, seq, (max(pts) + ts) / 2.0::DOUBLE AS at_ms, (ts - max(pts)) / 2.0::DOUBLE AS slack_ms, {", ".join(f"CAST(coalesce(sum(CASE WHEN r = '{r}' THEN fall END), 0) AS BIGINT) AS {r}" for r in C.RESOURCES)}
FROM ({" UNION ALL ".join(f"SELECT * FROM m_{r}" for r in C.RESOURCES)}) GROUP BY match_id, seq, ts"""
)
def merged_drops(spark, d):
    """Falls of all four resources, a row for each reading."""
    return anomalies.merged_drops(games.readings(spark, d), list(C.RESOURCES), 30_000)


@query(
    folded.ORACLE_SQL["greedy_match"].replace("SELECT match_id, seq, matched, offset_ms, got FROM step WHERE n > 0", "")
    + "SELECT match_id, CAST(sum(CASE WHEN matched THEN 1 ELSE 0 END) AS BIGINT) AS matched, count(*) AS total, sum(CASE WHEN matched THEN 1 ELSE 0 END) / count(*)::DOUBLE AS share, CASE WHEN sum(CASE WHEN matched THEN 1 ELSE 0 END) >= 10 AND sum(CASE WHEN matched THEN 1 ELSE 0 END) / count(*)::DOUBLE >= 0.5 THEN 'ok' ELSE 'too few matches' END AS status FROM step WHERE n > 0 GROUP BY match_id"
)
def match_quality(spark, d):
    """How many spends found their drop, and whether that is enough."""
    return folds.match_quality(folded.greedy_match(spark, d))


@query(CTE.replace("WITH", "WITH RECURSIVE", 1) + """, s AS (SELECT match_id, seq, ts_ms, ts_ms - min(ts_ms) OVER (PARTITION BY match_id) AS t, row_number() OVER (PARTITION BY match_id ORDER BY ts_ms, seq) AS n FROM rd),
pick(match_id, k, n) AS (
  SELECT match_id, CAST(1 AS BIGINT), CAST(1 AS BIGINT) FROM s WHERE n = 1
  UNION ALL
  SELECT match_id, k, n FROM (SELECT p.match_id, p.k + 1 AS k, min(s.n) AS n FROM pick p JOIN s ON s.match_id = p.match_id AND s.n > p.n AND s.t >= p.k * 43200000 - 1 GROUP BY p.match_id, p.k))
SELECT s.match_id, s.seq, s.ts_ms FROM s JOIN pick ON pick.match_id = s.match_id AND pick.n = s.n""")
def sampled_rows(spark, d):
    """A reading for each point of a grid of twelve hours."""
    return folds.sampled(tables.readings(spark, d), 12 * HOUR)


@query(ORACLE_SQL["sampled_rows"].replace("SELECT s.match_id, s.seq, s.ts_ms FROM s", "SELECT rd.match_id, rd.seq, rd.ts_ms, rd.value FROM rd JOIN s ON s.match_id = rd.match_id AND s.seq = rd.seq") + " WHERE rd.value IS DISTINCT FROM 50")
def outlier_frames(spark, d):
    """Of the sampled readings those that do not show the target."""
    return folds.outliers(tables.readings(spark, d).select("match_id", "seq", "ts_ms", "value"), "value", 50, 12 * HOUR)


def _sampled_bridge() -> str:
    """SQL of the bridge over the frames that sampling every six hours keeps."""
    grid = ORACLE_SQL["sampled_rows"].split("\nSELECT s.match_id")[0].replace("43200000 - 1", "21600000 - 1")
    bridge = folded.ORACLE_SQL["bridge_states"].removeprefix(CTE)
    kept = "rd WHERE EXISTS (SELECT 1 FROM s JOIN pick ON pick.match_id = s.match_id AND pick.n = s.n WHERE s.match_id = rd.match_id AND s.seq = rd.seq)"
    return grid + bridge.replace("AS n FROM rd),", f"AS n FROM {kept}),", 1)


@query(_sampled_bridge())
def sampled_states(spark, d):
    """A recording read every six hours and bridged."""
    frames = folded._frames(spark, d)
    return folds.sampled_states(frames, 6 * HOUR, housed_ms=24 * HOUR, queued_ms=48 * HOUR)


@query(CTE + """, k AS (SELECT match_id, ts_ms, seq, value // 25 AS a, lag(value // 25) OVER w AS b, lead(value // 25) OVER w AS c FROM rd WINDOW w AS (PARTITION BY match_id ORDER BY ts_ms, seq)),
u AS (SELECT match_id, ts_ms, arg_max(a, seq) AS a, arg_max(b, seq) AS b, arg_max(c, seq) AS c FROM (SELECT match_id, ts_ms, seq, coalesce(a, -1) AS a, coalesce(b, -1) AS b, coalesce(c, -1) AS c FROM k) GROUP BY match_id, ts_ms)
SELECT s.match_id, s.seq, s.cost // 25 AS key, coalesce(s.cost // 25 IN (u.a, u.b, u.c), false) AS agrees FROM sp s ASOF LEFT JOIN u ON u.match_id = s.match_id AND s.ts_ms >= u.ts_ms""")
def samples_agree(spark, d):
    """Whether a sample shows what the row in effect, or the one before or after it, shows."""
    samples = tables.spends(spark, d).select("match_id", "seq", "ts_ms", F.expr("cost div 25").alias("key"))
    rows = tables.readings(spark, d).select("match_id", "seq", "ts_ms", F.expr("value div 25").alias("key"))
    return asof.agreement(samples, rows, "key").select("match_id", "seq", "key", "agrees")


@query(CTE + """, k AS (SELECT match_id, seq, ts_ms, value // 25 AS key FROM rd WHERE value IS NOT NULL),
s AS (SELECT *, lead(key) OVER w AS nkey FROM k WINDOW w AS (PARTITION BY match_id ORDER BY ts_ms, seq)),
v AS (SELECT match_id, seq, lag(ts_ms) OVER w AS o, ts_ms AS n, lag(cost // 25) OVER w AS ok, cost // 25 AS nk FROM sp WINDOW w AS (PARTITION BY match_id ORDER BY ts_ms, seq))
SELECT v.match_id, v.seq, EXISTS (SELECT 1 FROM s WHERE s.match_id = v.match_id AND s.key = v.ok AND s.nkey = v.nk AND s.ts_ms > v.o - 86400000 AND s.ts_ms <= v.n + 86400000) AS seen FROM v WHERE ok <> nk""")
def changes_seen(spark, d):
    """Changes between consecutive samples, and whether the rows make the same step near them."""
    w = Window.partitionBy("match_id").orderBy("ts_ms", "seq")
    key = F.expr("cost div 25")
    x = tables.spends(spark, d).select(
        "match_id",
        "seq",
        F.lag("ts_ms").over(w).alias("old_ms"),
        F.col("ts_ms").alias("new_ms"),
        F.lag(key).over(w).alias("old_key"),
        key.alias("new_key"),
    )
    rows = tables.readings(spark, d).where("value is not null").select("match_id", "seq", "ts_ms", F.expr("value div 25").alias("key"))
    return retime.changes_seen(x.where("old_key <> new_key"), rows, 0, 24 * HOUR).select("match_id", "seq", "seen")


@query("""WITH v AS (SELECT vec_id, embedding AS e FROM embeddings), t AS (SELECT vec_id AS template, e FROM v WHERE vec_id < 10),
s AS (SELECT v.vec_id, t.template, round(list_sum(list_transform(list_zip(v.e, t.e), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 6) AS ssd FROM v, t)
SELECT vec_id, CAST(row_number() OVER w AS INTEGER) AS place, template, ssd FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY ssd, template) QUALIFY row_number() OVER w <= 2""")
def ssd_two_nearest(spark, d):
    """The two templates nearest to each vector."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    t = F.broadcast(v.where("vec_id < 10").agg(F.collect_list(F.struct(F.col("vec_id").alias("template"), F.col("e").alias("t"))).alias("ts")))  # ten rows
    ssd = lambda a, b: F.round(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x), 6)
    near = F.slice(F.array_sort(F.transform("ts", lambda x: F.struct(ssd(F.col("e"), x["t"]).alias("ssd"), x["template"].alias("template")))), 1, 2)
    both = v.crossJoin(t).select("vec_id", F.posexplode(near).alias("place", "b"))
    return both.select("vec_id", (F.col("place") + 1).alias("place"), "b.template", "b.ssd")


# printed forms --------------------------------------------------------------------------------------------------------

_CLOCK = "lpad(CAST({0} // 60000 AS VARCHAR), CAST(greatest(2, len(CAST({0} // 60000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST({0} % 60000 // 1000 AS VARCHAR), 2, '0') || '.' || lpad(CAST({0} % 1000 AS VARCHAR), 3, '0')"


@query(games._GAMES + "," + games._segments("idle", "s.idle_vils") + f""" SELECT match_id, a AS start_ms, {_CLOCK.format("a")} || ' | ' || {_CLOCK.format("b")} || ' | ' || printf('%.3f', (b - a) / 1000.0::DOUBLE) || 's | ' || value || ' | ' || printf('%.3f', (b - a) * value / 1000.0::DOUBLE)
  || CASE WHEN reason = 'phase' THEN ' (' || ['Dark', 'Feudal', 'Castle', 'Imperial'][next + 1] || ' Click)' ELSE '' END AS line
FROM (SELECT *, lead(phase) OVER (PARTITION BY match_id ORDER BY a, b) AS next FROM g_idle)""")
def analyzer_lines(spark, d):
    """The analyzer's table of segments: start, end, length, value, loss, and the click that ended it."""
    from tidelane.plans import analyze as A
    from tidelane.plans.report import segment_lines

    return segment_lines(A.phase_segments(games.line(spark, d), F.col("idle_vils")))


@query(games._GAMES + "," + games._segments("idle", "s.idle_vils") + """ SELECT match_id, coalesce(CASE phase WHEN 0 THEN 'Dark' WHEN 1 THEN 'Feudal' WHEN 2 THEN 'Castle' WHEN 3 THEN 'Imperial' END, 'TOTAL') AS phase, printf('%.3f', sum((b - a) * value) / 1000.0::DOUBLE) || ' VS' AS lost FROM g_idle GROUP BY GROUPING SETS ((match_id, phase), (match_id))""")
def analyzer_totals(spark, d):
    """Loss by phase and in all."""
    from tidelane.plans import analyze as A
    from tidelane.plans.report import phase_totals

    return phase_totals(A.phase_segments(games.line(spark, d), F.col("idle_vils")))


@query(f"""SELECT match_id, {_CLOCK.format("(max(ig) - min(ig))")} AS length FROM ({games._GAMES} SELECT match_id, ig FROM scr) GROUP BY match_id""")
def match_length(spark, d):
    """A telemetry-only match's length: last less first reading in game time."""
    x = games.line(spark, d).where("src = 'screen'")
    return x.groupBy("match_id").agg(text.clock(F.max("in_game_ms") - F.min("in_game_ms")).alias("length"))


@query("SELECT p_partkey, concat_ws(' | ', 'Food ' || p_size || coalesce(' (' || CASE WHEN p_size % 2 = 0 THEN p_size END || ')', ''), CASE WHEN p_size % 3 <> 0 THEN 'Wood ' || p_partkey END, 'scale ' || printf('%.2f', p_size / 50.0::DOUBLE), p_size || ' ms') AS line, (p_size + p_partkey) // 2 - 1 AS middle FROM part")
def panel_lines(spark, d):
    """The console's panel line, and the middle of a range of frames."""
    size, key = F.col("p_size"), F.col("p_partkey")
    line = text.panel_line([("Food", size, F.when(size % 2 == 0, size)), ("Wood", F.when(size % 3 != 0, key), None)], size / 50.0, size)
    return table(spark, d, "part").select("p_partkey", line.alias("line"), text.range_middle(size, key).cast("long").alias("middle"))
