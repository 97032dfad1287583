"""Queries of lookups, scalar functions, codecs and kernels over the other tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelane.functions import cost, text
from tidelane.operators import lookups
from tidelane.plans.tables import CTE, events, table
from tidelane.sources.telemetry import MERGED, decode_merged

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT l_orderkey, l_linenumber, coalesce(p_name, 'Unknown part ' || l_partkey) AS name, coalesce(p_size, 0) AS size, p_partkey IS NULL AS miss FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 10 <> 0) p ON p_partkey = l_partkey")
def dim_lookup_unknown(spark, d):
    dim = table(spark, d, "part").where("p_partkey % 10 <> 0").select(
        F.col("p_partkey").alias("l_partkey"),
        F.col("p_name").alias("name"),
        F.col("p_size").alias("size"),
    )
    facts = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    out = lookups.named(facts, dim, ["l_partkey"], "name", F.concat(F.lit("Unknown part "), F.col("l_partkey").cast("string")), ["size"])
    return out.select("l_orderkey", "l_linenumber", "name", "size", "miss")


@query("SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0) GROUP BY l_partkey")
def unknown_id_counts(spark, d):
    dim = table(spark, d, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    found = lookups.named(table(spark, d, "lineitem").select("l_partkey"), dim, ["l_partkey"], "name", F.lit("Unknown"), [])
    return lookups.misses(found, ["l_partkey"])


@query("SELECT o_orderkey, coalesce(s_name, c_name, 'Unknown (' || o_custkey || ')') AS name FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey AND s_suppkey % 2 = 0 LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 <> 0")
def two_step_names(spark, d):
    a = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("o_custkey"), "s_name")
    b = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    out = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lookups.small(a), "o_custkey", "left").join(lookups.small(b), "o_custkey", "left")
    return out.select("o_orderkey", F.coalesce("s_name", "c_name", F.concat(F.lit("Unknown ("), F.col("o_custkey").cast("string"), F.lit(")"))).alias("name"))


@query("SELECT n_nationkey, coalesce(r_name, 'Unknown Region (' || n_regionkey || ')') AS region FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) r ON r_regionkey = n_regionkey")
def id_names(spark, d):
    dim = table(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    out = lookups.named(table(spark, d, "nation"), dim, ["n_regionkey"], "region", F.format_string("Unknown Region (%d)", "n_regionkey"), [])
    return out.select("n_nationkey", "region")


@query("SELECT l_orderkey, l_linenumber, CAST(unnest(range(CAST(l_quantity AS BIGINT))) AS INTEGER) AS unit, l_extendedprice FROM lineitem")
def explode_units(spark, d):
    x = table(spark, d, "lineitem").where("l_quantity >= 1").select(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        F.explode(F.expr("sequence(0, cast(l_quantity as int) - 1)")).alias("unit"),
    )
    return x.select("l_orderkey", "l_linenumber", "unit", "l_extendedprice")


_TIER = "CASE WHEN pct < 2 THEN 'gold' WHEN pct < 4 THEN 'silver' ELSE 'bronze' END"


@query(f"SELECT l_orderkey, l_linenumber, pct, {_TIER} AS tier, CASE WHEN pct < 2 THEN 3 WHEN pct < 4 THEN 2 ELSE 1 END AS stars FROM (SELECT *, round(l_discount * 100 * 10) / 10 AS pct FROM lineitem)")
def grade_tiers(spark, d):
    pct, tier, stars = text.percent_tier(F.col("l_discount"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", pct.alias("pct"), tier.alias("tier"), stars.alias("stars"))


@query(f"SELECT l_orderkey, CAST(sum(stars) AS BIGINT) AS stars, CASE WHEN sum(stars) >= 6 THEN 'gold' WHEN sum(stars) >= 4 THEN 'silver' ELSE 'bronze' END AS tier FROM (SELECT l_orderkey, CASE WHEN pct < 2 THEN 3 WHEN pct < 4 THEN 2 ELSE 1 END AS stars FROM (SELECT *, round(l_discount * 100 * 10) / 10 AS pct FROM lineitem)) GROUP BY l_orderkey")
def overall_tier(spark, d):
    _, _, stars = text.percent_tier(F.col("l_discount"))
    x = table(spark, d, "lineitem").select("l_orderkey", stars.alias("s")).groupBy("l_orderkey").agg(F.sum("s").alias("stars"))
    return x.select("l_orderkey", "stars", text.overall_tier(F.col("stars")).alias("tier"))


_MS = "(event_id * 7919) % 9000000"


@query(f"SELECT event_id, printf('%02d:%02d.%03d', ms // 60000, ms % 60000 // 1000, ms % 1000) AS clock, printf('%d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS long_clock FROM (SELECT event_id, {_MS} AS ms FROM events)")
def format_time(spark, d):
    x = table(spark, d, "events").select("event_id", F.expr(_MS).alias("ms"))
    return x.select("event_id", text.clock(F.col("ms")).alias("clock"), text.signed_clock(F.col("ms")).alias("long_clock"))


@query(f"SELECT event_id, ms FROM (SELECT event_id, {_MS} AS ms FROM events)")
def parse_clock(spark, d):
    x = table(spark, d, "events").select("event_id", text.signed_clock(F.expr(_MS)).alias("t"))
    return x.select("event_id", text.parse_clock(F.col("t")).alias("ms"))


@query("SELECT page_id, regexp_replace(url, '[<>:\"/\\\\|?*\\s[:cntrl:]]', '_', 'g') AS file FROM pages")
def filename_sanitize(spark, d):
    return table(spark, d, "pages").select("page_id", text.file_name(F.col("url")).alias("file"))


@query("SELECT event_id, (a, b, c) > (1, 4, 2) AS newer FROM (SELECT event_id, event_id % 3 AS a, event_id % 7 AS b, event_id % 5 AS c FROM events)")
def version_compare(spark, d):
    v = F.concat(F.lit("v"), F.concat_ws(".", *[(F.col("event_id") % k).cast("string") for k in (3, 7, 5)]))
    return table(spark, d, "events").select("event_id", text.newer_version(v, F.lit("1.4.2")).alias("newer"))


@query("SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), '/', '&#x2f;') AS escaped FROM pages")
def html_escape_pages(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN q > 40 THEN '-' || q ELSE '' END AS txt, CASE WHEN q > 40 THEN q END AS back FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem)")
def cost_codec(spark, d):
    q = F.col("l_quantity").cast("long")
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.cost_text(F.when(q > 40, q)).alias("txt"))
    return x.withColumn("back", text.cost_value(F.col("txt")))


@query("SELECT o_orderkey, len(list_filter([try_cast(trim(x) AS BIGINT) FOR x IN string_split(s, ',')], lambda v: v IS NOT NULL)) AS n, list_sum([try_cast(trim(x) AS BIGINT) FOR x IN string_split(s, ',')])::BIGINT AS total FROM (SELECT o_orderkey, o_orderkey || ', x,' || o_custkey AS s FROM orders)")
def comma_ids(spark, d):
    ids = text.int_list(F.concat(F.col("o_orderkey").cast("string"), F.lit(", x,"), F.col("o_custkey").cast("string")))
    x = table(spark, d, "orders").select("o_orderkey", ids.alias("ids"))
    return x.select("o_orderkey", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


_TOLD = ("Farm queue", "Market sell Food", "Research x", "Queue y", "Unqueue", "Build w", "Delete v", "Other")


@query(f"SELECT event_id, kind, kind = 'sell' AS gives_resources FROM (SELECT event_id, ['farm', 'sell', 'research', 'queue', 'unqueue', 'build', 'delete', NULL][CAST(event_id % 8 AS INTEGER) + 1] AS kind FROM events) WHERE kind IS NOT NULL")
def event_kind(spark, d):
    """Kinds of merged rows by how their description begins; rows of no known kind are left out."""
    told = F.get(F.array(*[F.lit(x) for x in _TOLD]), (F.col("event_id") % 8).cast("int"))
    made = {"in_game_ms": F.col("event_id").cast("string"), "observation_type": F.lit("RecEvent"), "event_desc": told}
    rows = table(spark, d, "events").select(*[made.get(c, F.lit("")).alias(c) for c in MERGED])
    return decode_merged(rows).select(F.col("in_game_ms").alias("event_id"), "kind", "gives_resources")


@query("SELECT l_orderkey, l_linenumber, 5 * (greatest(abs(l_partkey % 50 - l_suppkey % 50), abs(l_linenumber - l_partkey % 7)) + 1) AS cost FROM lineitem")
def wall_cost(spark, d):
    x1, x2, y1, y2 = F.col("l_partkey") % 50, F.col("l_suppkey") % 50, F.col("l_linenumber"), F.col("l_partkey") % 7
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cost.wall_cost(F.lit(5), x1, y1, x2, y2).alias("cost"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'food' WHEN 1 THEN 'wood' WHEN 2 THEN 'stone' ELSE 'Unknown' END AS name, CASE WHEN event_id % 4 = 0 THEN 100 * (event_id % 9) ELSE 0 END AS food, CASE WHEN event_id % 4 = 1 THEN 100 * (event_id % 9) ELSE 0 END AS wood, CASE WHEN event_id % 4 = 2 THEN 100 * (event_id % 9) ELSE 0 END AS stone FROM events")
def market_sale(spark, d):
    return table(spark, d, "events").select("event_id", cost.market_sale(F.col("event_id") % 4, F.col("event_id") % 9).alias("s")).select("event_id", "s.*")


@query("WITH v AS (SELECT vec_id, embedding AS e FROM embeddings), t AS (SELECT vec_id AS template, e FROM v WHERE vec_id < 10), s AS (SELECT v.vec_id, t.template, round(list_sum(list_transform(list_zip(v.e, t.e), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 6) AS ssd FROM v, t) SELECT vec_id, template, ssd FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY ssd, template) = 1")
def ssd_nearest_template(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    t = v.where("vec_id < 10").agg(F.collect_list(F.struct(F.col("vec_id").alias("template"), F.col("e").alias("t"))).alias("ts"))
    ssd = lambda a, b: F.round(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x), 6)
    both = v.crossJoin(F.broadcast(t))  # one row: the fixed set of templates
    best = F.array_min(F.transform("ts", lambda x: F.struct(ssd(F.col("e"), x["t"]).alias("ssd"), x["template"].alias("template"))))
    return both.select("vec_id", best.alias("b")).select("vec_id", "b.template", "b.ssd")


@query("WITH p AS (SELECT o_orderkey AS id, CAST(o_custkey * 3 % 97 AS BIGINT) AS cx, CAST(o_orderkey * 7 % 23 AS BIGINT) AS cy FROM orders), q AS (SELECT o_orderkey AS what, CAST(o_custkey % 97 AS BIGINT) AS cx, CAST(o_orderkey % 23 AS BIGINT) AS cy FROM orders), m AS (SELECT p.id, q.what, CASE WHEN q.cx = p.cx AND q.cy = p.cy THEN -1 ELSE (q.cx - p.cx + 1) * 3 + q.cy - p.cy + 1 END AS k FROM p JOIN q ON q.cx BETWEEN p.cx - 1 AND p.cx + 1 AND q.cy BETWEEN p.cy - 1 AND p.cy + 1), b AS (SELECT id, what FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY k, what) = 1) SELECT p.id, b.what FROM p LEFT JOIN b ON b.id = p.id")
def nearby_cells(spark, d):
    """The first order in each order's cell or the cells around."""
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 3 % 97).alias("cx"), (F.col("o_orderkey") * 7 % 23).alias("cy"))
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("what"), (F.col("o_custkey") % 97).alias("cx"), (F.col("o_orderkey") % 23).alias("cy"))
    return lookups.nearby(p, q, "id", "what").select("id", "what")


@query("SELECT a.l_orderkey, a.l_linenumber, b.o_custkey FROM lineitem a JOIN orders b ON b.o_orderkey = a.l_orderkey AND b.o_custkey = a.l_partkey")
def exact_key_join(spark, d):
    a = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("o_custkey"))
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lookups.same_key(a, b, ["l_orderkey", "o_custkey"]).select("l_orderkey", "l_linenumber", "o_custkey")


@query("WITH c AS (SELECT l_returnflag AS field, l_linestatus = CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'F' ELSE 'O' END AS ok FROM lineitem) SELECT field, CAST(count(*) FILTER (ok) AS BIGINT) AS correct, count(*) AS total FROM c GROUP BY field UNION ALL SELECT 'all', count(*) FILTER (ok), count(*) FROM c")
def accuracy_rollup(spark, d):
    x = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("field"),
        "l_orderkey",
        "l_linenumber",
        "l_linestatus",
        F.expr("case when year(l_shipdate) < 1998 then 'F' else 'O' end").alias("guess"),
    )
    return lookups.accuracy(x.withColumn("correct", F.col("l_linestatus").eqNullSafe(F.col("guess"))), "field")


@query("SELECT coalesce(a.k, b.k) AS k, a.v AS expected, b.v AS actual, a.v IS NOT DISTINCT FROM b.v AS correct FROM (SELECT p_partkey AS k, p_brand AS v FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN p_brand END AS v FROM part WHERE p_partkey % 5 <> 0) b ON a.k = b.k")
def expected_vs_actual(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("v"))
    b = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("k"), F.expr("case when p_size > 25 then p_brand end").alias("v"))
    return lookups.compare(a, b, ["k"], "v")


@query("SELECT p_type AS kind, count(DISTINCT p_size) AS n FROM part GROUP BY p_type HAVING count(DISTINCT p_size) > 1")
def unit_cost_consistency(spark, d):
    return lookups.conflicting(table(spark, d, "part").select(F.col("p_type").alias("kind"), "p_size"), "kind", "p_size")


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def last_duplicate_wins(spark, d):
    return lookups.latest_per_key(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", ["event_id"])


@query("SELECT page_id, CASE WHEN instr(url, '.') > 0 THEN substr(url, 1, instr(url, '.') - 1) ELSE url END AS label FROM pages")
def label_stem(spark, d):
    return table(spark, d, "pages").select("page_id", text.stem(F.col("url")).alias("label"))


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey")
def json_columns(spark, d):
    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("o_orderkey")).alias("a"))
    ids = F.regexp_replace(F.to_json("a"), r"[\[\]]", "")
    return x.select("o_custkey", "n", ids.alias("ids"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at, replace(replace(replace(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '-', ''), ':', ''), ' ', '-') AS stamp FROM orders")
def date_format(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"))
    return x.withColumn("stamp", text.date_stamp(F.col("at")))


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 1 END, c_custkey) AS place FROM customer")
def players_order(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.when(F.col("c_custkey") % 10 == 0, 0).otherwise(1), "c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_name END), ''), 'Player ' || c_custkey) AS name FROM customer")
def display_name(spark, d):
    raw = F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_name"))
    return table(spark, d, "customer").select(
        "c_custkey",
        F.coalesce(F.nullif(F.trim(raw), F.lit("")), F.concat(F.lit("Player "), F.col("c_custkey").cast("string"))).alias("name"),
    )


@query("SELECT p_partkey, split_part(v, '/', 1) AS cur, split_part(v, '/', 2) AS most FROM (SELECT p_partkey, p_size || '/' || (p_size + 5) AS v FROM part)")
def panel_split(spark, d):
    v = F.concat(F.col("p_size").cast("string"), F.lit("/"), (F.col("p_size") + 5).cast("string"))
    x = table(spark, d, "part").select("p_partkey", F.split(v, "/", 2).alias("s"))
    return x.select("p_partkey", F.get("s", 0).alias("cur"), F.get("s", 1).alias("most"))


@query(CTE + "SELECT match_id, CAST(count(*) AS BIGINT) AS n, CASE WHEN max(ts_ms) > min(ts_ms) THEN 'ok' ELSE 'empty' END AS status FROM ev GROUP BY match_id")
def player_events(spark, d):
    """Every match's events and whether they span any time."""
    return events(spark, d).groupBy("match_id").agg(F.count("*").alias("n"), F.when(F.max("ts_ms") > F.min("ts_ms"), "ok").otherwise("empty").alias("status"))


# the names that these had beside versions of a part of the table
for _name in ("player_events", "nearby_cells"):
    QUERIES[f"{_name}_all"], ORACLE_SQL[f"{_name}_all"] = QUERIES[_name], ORACLE_SQL[_name]
