"""Queries of the engine's larger parts: replay decoding, players, the whole analysis and its findings, files and codecs.

The driver's tables stand for games: line items are a replay's operations, parts its dimension, customers its players.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.operators import decode as D
from tidelane.plans.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}

_KINDS = "sync queue dequeue build interact delete research unqueue wall sell farm chat".split()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def game_data(spark, d) -> DataFrame:
    """(kind, id, name, costs) of the parts; every tenth part is missing."""
    kind = F.get(F.array(*[F.lit(k) for k in ("unit", "building", "tech")]), (F.col("p_partkey") % 3).cast("int"))
    size = F.col("p_size").cast("long")
    cost = [size.alias("food"), (size * 2).alias("wood"), (size % 7).alias("gold"), (size % 3).alias("stone")]
    return table(spark, d, "part").where("p_partkey % 10 <> 0").select(
        kind.alias("kind"),
        F.expr("p_partkey div 3").alias("id"),
        F.col("p_name").alias("name"),
        *cost,
    )


_MATCH = "cast(if(l_suppkey % 3 = 0, 0, 1 + l_orderkey div 256) as long)"


def operations(spark, d) -> DataFrame:
    """D.OPS of the line items: match 0 has a third of them, the others those of 256 order keys each."""
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), ((F.col("l_partkey") + F.col("l_linenumber")) % 12).cast("int"))
    at = lambda c, n: F.when(kind == "wall", F.col(c) % n).otherwise(F.col(c) % n * 0.1 + 0.05)
    items = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("l_quantity"))
    return items.select(
        F.expr(_MATCH).alias("match_id"),
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).cast("long").alias("op_seq"),
        kind.alias("kind"),
        F.when(kind == "sync", F.col("l_quantity").cast("long") * 10).otherwise(0).cast("long").alias("time_increment"),
        (F.col("l_linenumber") % 2 + 1).cast("int").alias("player_id"),
        F.expr("cast(l_partkey div 3 as long)").alias("type_id"),
        (F.col("l_partkey") % 30).cast("long").alias("object_id"),
        (F.col("l_linenumber") % 3).cast("long").alias("amount"),
        at("l_partkey", 20).alias("x"),
        at("l_orderkey", 20).alias("y"),
        at("l_orderkey", 17).alias("x2"),
        at("l_partkey", 13).alias("y2"),
        F.when(kind == "dequeue", F.expr("l_partkey div 3")).otherwise(F.col("l_linenumber") % 4).cast("long").alias("code"),
        F.array((F.col("l_partkey") % 30).cast("long"), (F.col("l_orderkey") % 30).cast("long")).alias("ids"),
    )


def objects(spark, d) -> DataFrame:
    """Every match starts with the even objects up to 18."""
    made = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(18).cast("long"), F.lit(2).cast("long")))
    return table(spark, d, "lineitem").select(F.expr(_MATCH).alias("match_id")).distinct().select("match_id", made.alias("object_id")).withColumn("type_id", F.col("object_id") * 7)


_GAME = """WITH gd AS (
  SELECT ['unit', 'building', 'tech'][p_partkey % 3 + 1] AS kind, p_partkey // 3 AS id, p_name AS name, CAST(p_size AS BIGINT) AS food, CAST(p_size * 2 AS BIGINT) AS wood, CAST(p_size % 7 AS BIGINT) AS gold, CAST(p_size % 3 AS BIGINT) AS stone
  FROM part WHERE p_partkey % 10 <> 0),
op0 AS (
  SELECT CAST(CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE 1 + l_orderkey // 256 END AS BIGINT) AS match_id, CAST(((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey AS BIGINT) AS op_seq,
    ['sync', 'queue', 'dequeue', 'build', 'interact', 'delete', 'research', 'unqueue', 'wall', 'sell', 'farm', 'chat'][(l_partkey + l_linenumber) % 12 + 1] AS kind, CAST(l_quantity AS BIGINT) * 10 AS q,
    CAST(l_linenumber % 2 + 1 AS INTEGER) AS player_id, l_partkey // 3 AS raw_type, CAST(l_partkey % 30 AS BIGINT) AS object_id, CAST(l_linenumber % 3 AS BIGINT) AS amount,
    l_partkey % 20 AS cx, l_orderkey % 20 AS cy, l_orderkey % 17 AS cx2, l_partkey % 13 AS cy2, l_linenumber % 4 AS sells, [CAST(l_partkey % 30 AS BIGINT), CAST(l_orderkey % 30 AS BIGINT)] AS ids
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)),
op AS (
  SELECT *, coalesce(sum(CASE WHEN kind = 'sync' THEN q ELSE 0 END) OVER (PARTITION BY match_id ORDER BY op_seq ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS ts_ms, CASE WHEN kind = 'farm' THEN 50 ELSE raw_type END AS type_id,
    CASE WHEN kind = 'research' THEN 'tech' WHEN kind IN ('queue', 'dequeue') THEN 'unit' WHEN kind IN ('build', 'wall', 'farm') THEN 'building' END AS dim FROM op0),
named AS (
  SELECT op.*, gd.name IS NULL AND dim IS NOT NULL AS miss, coalesce(gd.name, 'Unknown ' || dim || ' ' || op.type_id) AS name, coalesce(food, 0) AS food, coalesce(wood, 0) AS wood, coalesce(gold, 0) AS gold, coalesce(stone, 0) AS stone
  FROM op LEFT JOIN gd ON gd.kind = dim AND gd.id = op.type_id),
ob AS (
  SELECT m.match_id, o.object_id, coalesce(b.name, u.name, 'Unknown (' || o.object_id * 7 || ')') AS name FROM (SELECT DISTINCT match_id FROM op) m, (SELECT unnest(range(0, 19, 2)) AS object_id) o
  LEFT JOIN gd b ON b.kind = 'building' AND b.id = o.object_id * 7 LEFT JOIN gd u ON u.kind = 'unit' AND u.id = o.object_id * 7),
cell AS (SELECT dx, dy, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE 1 + (dx + 1) * 3 + dy + 1 END AS k FROM (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
touch AS (SELECT match_id, op_seq, object_id, k, cx + dx AS cx, cy + dy AS cy FROM named, cell WHERE kind = 'interact' AND object_id > 0),
near AS (  -- the first of the nine cells that has a build before, and that cell's last one
  SELECT t.match_id, t.op_seq, t.object_id, arg_min(b.name, t.k) AS name
  FROM touch t ASOF JOIN (SELECT match_id, op_seq, cx, cy, name FROM named WHERE kind = 'build') b ON b.match_id = t.match_id AND b.cx = t.cx AND b.cy = t.cy AND b.op_seq < t.op_seq
  GROUP BY t.match_id, t.op_seq, t.object_id),
sure AS (
  SELECT match_id, object_id, -1 AS op_seq, name FROM ob
  UNION ALL SELECT DISTINCT o.match_id, unnest(ids), op_seq, coalesce(gd.name, 'Unknown building ' || raw_type) FROM op o LEFT JOIN gd ON gd.kind = 'building' AND gd.id = raw_type WHERE o.kind = 'dequeue'),
given AS (
  SELECT match_id, object_id, op_seq, name FROM sure
  UNION ALL
  SELECT n.match_id, n.object_id, n.op_seq, n.name FROM (SELECT match_id, object_id, min(op_seq) AS op_seq, arg_min(name, op_seq) AS name FROM near GROUP BY ALL) n
  WHERE NOT EXISTS (SELECT 1 FROM sure s WHERE s.match_id = n.match_id AND s.object_id = n.object_id AND s.op_seq < n.op_seq)),
asked AS (
  SELECT match_id, op_seq, kind, unnest(ids) AS object_id, unnest([1, 2]) AS k FROM named WHERE kind IN ('queue', 'unqueue')
  UNION ALL SELECT match_id, op_seq, kind, object_id, 1 FROM named WHERE kind IN ('research', 'delete')),
seen AS (
  SELECT a.match_id, a.op_seq, a.kind, a.k, coalesce(g.name, CASE WHEN a.kind = 'delete' THEN 'Unknown' ELSE 'Unknown Building' END) AS name
  FROM asked a ASOF LEFT JOIN given g ON g.match_id = a.match_id AND g.object_id = a.object_id AND g.op_seq < a.op_seq),
types AS (
  SELECT match_id, op_seq, CASE WHEN kind = 'queue' THEN max(CASE WHEN k = 1 THEN name END) || ',' || max(CASE WHEN k = 1 THEN name END) ELSE string_agg(name, ',' ORDER BY k) END AS types
  FROM seen GROUP BY match_id, op_seq, kind
  UNION ALL SELECT o.match_id, o.op_seq, coalesce(gd.name, 'Unknown building ' || raw_type) || ',' || coalesce(gd.name, 'Unknown building ' || raw_type) FROM op o LEFT JOIN gd ON gd.kind = 'building' AND gd.id = raw_type WHERE o.kind = 'dequeue'),
made AS (
  SELECT n.*, t.types, (greatest(abs(cx - cx2), abs(cy - cy2)) + 1)::BIGINT AS tiles, unnest(CASE WHEN n.kind IN ('queue', 'dequeue') THEN range(1, amount + 1) ELSE [1] END) AS unit
  FROM named n LEFT JOIN types t ON t.match_id = n.match_id AND t.op_seq = n.op_seq WHERE n.kind NOT IN ('sync', 'interact', 'chat')),
event AS (
  SELECT match_id, op_seq, unit, ts_ms, player_id, CASE kind WHEN 'dequeue' THEN 'queue' WHEN 'wall' THEN 'build' ELSE kind END AS kind, type_id,
    CASE WHEN kind = 'research' THEN 'Research ' || name WHEN kind IN ('queue', 'dequeue') THEN 'Queue ' || name WHEN kind = 'unqueue' THEN 'Unqueue' WHEN kind IN ('build', 'wall') THEN 'Build ' || name
      WHEN kind = 'delete' THEN 'Delete ' || types WHEN kind = 'farm' THEN 'Farm queue' ELSE 'Market sell ' || ['Food', 'Wood', 'Stone', 'Unknown'][sells + 1] END AS description,
    CASE WHEN kind = 'sell' THEN CASE WHEN sells = 0 THEN 100 * amount ELSE 0 END WHEN kind IN ('unqueue', 'delete') THEN 0 WHEN kind = 'wall' THEN food * tiles ELSE food END AS food,
    CASE WHEN kind = 'sell' THEN CASE WHEN sells = 1 THEN 100 * amount ELSE 0 END WHEN kind IN ('unqueue', 'delete') THEN 0 WHEN kind = 'wall' THEN wood * tiles ELSE wood END AS wood,
    CASE WHEN kind IN ('sell', 'unqueue', 'delete') THEN 0 WHEN kind = 'wall' THEN gold * tiles ELSE gold END AS gold,
    CASE WHEN kind = 'sell' THEN CASE WHEN sells = 2 THEN 100 * amount ELSE 0 END WHEN kind IN ('unqueue', 'delete') THEN 0 WHEN kind = 'wall' THEN stone * tiles ELSE stone END AS stone,
    CASE WHEN kind = 'research' THEN CAST(object_id AS VARCHAR) ELSE ids[1] || ',' || ids[2] END AS building_ids, CASE WHEN kind = 'delete' THEN '' ELSE coalesce(types, '') END AS building_types, kind = 'sell' AS gives_resources
  FROM made)
"""


def _events(spark, d) -> tuple[DataFrame, DataFrame]:
    return D.decode(operations(spark, d), game_data(spark, d), objects(spark, d))


@query(_GAME + "SELECT match_id, op_seq, unit, ts_ms, player_id, kind, type_id, description, food, wood, gold, stone, building_ids, building_types, gives_resources FROM event")
def decode_events(spark, d):
    """Operations to events: clock, names and costs, object names by registry, a row for each unit."""
    found, _ = _events(spark, d)
    ids = F.array_join(F.transform("building_ids", lambda i: i.cast("string")), ",")
    return found.select(
        "match_id",
        "seq.op_seq",
        "seq.unit",
        *found.columns[2:-3],
        ids.alias("building_ids"),
        F.array_join("building_types", ",").alias("building_types"),
        "gives_resources",
    )


@query(_GAME + "SELECT dim, type_id, count(*) AS n FROM named WHERE miss GROUP BY dim, type_id")
def decode_misses(spark, d):
    return _events(spark, d)[1]


@query(_GAME + "SELECT match_id, kind, count(*) AS n, CAST(sum(CASE WHEN kind IN ('unqueue', 'delete') OR gives_resources THEN 1 ELSE 0 END) AS BIGINT) AS refunds, CAST(sum(CASE WHEN food + wood + gold + stone > 0 THEN 1 ELSE 0 END) AS BIGINT) AS spends FROM event GROUP BY match_id, kind")
def refunds_and_spends(spark, d):
    """What gives resources back and what takes some, by kind."""
    found = D.event_costs(operations(spark, d), game_data(spark, d))
    of = lambda c: F.sum(F.when(c, F.col("units")).otherwise(0))
    return found.groupBy("match_id", "kind").agg(F.sum("units").alias("n"), of(D.is_refund()).alias("refunds"), of(D.is_spend()).alias("spends"))


@query(
    _GAME
    + """SELECT match_id, op_seq, unit, concat_ws(chr(9), lpad(CAST(ts_ms // 60000 AS VARCHAR), CAST(greatest(2, len(CAST(ts_ms // 60000 AS VARCHAR))) AS INTEGER), '0') || ':' || printf('%06.3f', CAST(ts_ms % 60000 AS FLOAT) / CAST(1000 AS FLOAT)), player_id, kind, type_id, description,
    food || '/' || wood || '/' || gold || '/' || stone, building_ids, building_types, gives_resources, match_id) AS line FROM event"""
)
def printed_events(spark, d):
    """The ten columns of a printed event; times in single precision."""
    from tidelane.sources.telemetry import event_lines

    return event_lines(_events(spark, d)[0]).select("match_id", "seq.op_seq", "seq.unit", "line")


def player_rows(spark, d) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.col("c_nationkey").cast("long").alias("match_id"),
        c.cast("int").alias("slot"),
        F.when(c % 4 == 0, " ").when(c % 7 == 0, "Same").otherwise(F.col("c_name")).alias("name"),
        F.when(c % 8 == 0, "Bot").otherwise("").alias("ai_name"),
        (c % 5).cast("int").alias("player_type"),
        (c % 7).cast("long").alias("civ_id"),
        (c - c % 10).cast("int").alias("rec_player"),
    )


_PLAYERS = """WITH c AS (
  SELECT CAST(c_nationkey AS BIGINT) AS match_id, CAST(c_custkey AS INTEGER) AS slot, CASE WHEN c_custkey % 4 = 0 THEN ' ' WHEN c_custkey % 7 = 0 THEN 'Same' ELSE c_name END AS raw, CASE WHEN c_custkey % 8 = 0 THEN 'Bot' ELSE '' END AS ai,
    c_custkey % 5 AS kind, c_custkey % 7 AS civ_id, c_custkey % 10 = 0 AS own FROM customer),
p AS (
  SELECT match_id, slot, coalesce(nullif(trim(raw), ''), nullif(trim(ai), ''), 'Player ' || slot) AS name, coalesce(r_name, 'Unknown Civ ' || civ_id) AS civ,
    CAST(row_number() OVER (PARTITION BY match_id ORDER BY CASE WHEN own THEN 0 ELSE 1 END, slot) AS INTEGER) AS place
  FROM c LEFT JOIN region ON r_regionkey = civ_id WHERE kind IN (2, 4) OR trim(raw) <> '' OR trim(ai) <> '')
"""


def _players(spark, d) -> DataFrame:
    return D.players(player_rows(spark, d), table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name")))


@query(_PLAYERS + "SELECT * FROM p")
def player_list(spark, d):
    """Who plays: people, computers and anyone with a name, with civilisations, the recorded player first."""
    return _players(spark, d)


@query(
    _PLAYERS
    + """, resigned AS (SELECT match_id, arg_max(slot, slot * 7919 % 99991) AS slot FROM (SELECT CAST(c_nationkey AS BIGINT) AS match_id, c_custkey AS slot FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey % 5 <> 0) GROUP BY match_id),
lost AS (SELECT p.match_id, p.name FROM p JOIN resigned r ON r.match_id = p.match_id AND r.slot = p.slot)
SELECT p.*, coalesce(p.name <> lost.name, false) AS is_winner FROM p LEFT JOIN lost ON lost.match_id = p.match_id"""
)
def match_winners(spark, d):
    """The last to resign loses, and everyone of another name wins."""
    c = table(spark, d, "customer").where("c_custkey % 3 = 0 and c_nationkey % 5 <> 0")
    ops = c.select(
        F.col("c_nationkey").cast("long").alias("match_id"),
        (F.col("c_custkey") * 7919 % 99991).alias("op_seq"),
        F.lit("resign").alias("kind"),
        F.col("c_custkey").cast("int").alias("player_id"),
    )
    return D.winners(_players(spark, d), ops)
