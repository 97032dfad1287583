"""Files of readings, merged timelines, dimensions and frames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelane.functions.text import clock_single, cost_text, cost_value, int_list

TELEMETRY = [
    "timestamp_ms",
    "food_total",
    "food_vils",
    "wood_total",
    "wood_vils",
    "gold_total",
    "gold_vils",
    "stone_total",
    "stone_vils",
    "pop_curr",
    "pop_max",
    "pop_vils",
    "idle_vils",
    "housing",
]
NUMBERS = {
    "food_total": "food",
    "wood_total": "wood",
    "gold_total": "gold",
    "stone_total": "stone",
    "pop_curr": "pop_curr",
    "pop_max": "pop_max",
    "pop_vils": "pop_vils",
    "idle_vils": "idle_vils",
}
MERGED = [
    "in_game_ms",
    "observation_type",
    "event_desc",
    "food",
    "wood",
    "gold",
    "stone",
    "rw_timestamp_ms",
    "building_type",
    "building_ids",
    "idle_vils",
    "pop_curr",
    "pop_max",
    "pop_vils",
    "housing",
    "type_id",
]


def _strings(names: list[str]) -> str:
    return ", ".join(f"`{n}` string" for n in names)


def workplace(spark: SparkSession, name: str) -> str:
    """A new path for files in the folder that the cluster shares (spark.checkpoint.dir).

    Where that is unset it is in the warehouse, or in local mode a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not path:
        local = spark.sparkContext.master.startswith("local")
        path = tempfile.mkdtemp(prefix="tidelane-") if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written once to a new workplace and read from there: for tables that several others are computed from."""
    path = workplace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def status(text: Column) -> Column:
    return F.when(text.isin("normal", "housed", "queued"), text)


def read_telemetry(spark: SparkSession, path: str, match_id: Column | None = None) -> DataFrame:
    """Readings of CSV files, a match for each file unless match_id says otherwise.

    Uneven rows and unreadable times are errors; numbers that can't be read are null, and so are other states.
    """
    raw = spark.read.csv(path, header=True, schema=_strings(TELEMETRY), mode="FAILFAST", enforceSchema=False)
    ts = F.col("timestamp_ms").try_cast("long")
    checked = F.when(F.assert_true(ts.isNotNull(), F.lit("timestamp_ms can't be read")).isNull(), ts)
    out = raw.withColumn("match_id", F.col("_metadata.file_path") if match_id is None else match_id)
    return out.select(
        "match_id",
        checked.alias("ts_ms"),
        *[F.when(F.col(a).try_cast("int") >= 0, F.col(a).try_cast("int")).alias(b) for a, b in NUMBERS.items()],
        status(F.col("housing")).alias("housing"),
    )


def write_telemetry(readings: DataFrame, path: str) -> None:
    text = {b: F.coalesce(F.col(b).cast("string"), F.lit("")) for b in NUMBERS.values()}
    cols = [
        F.col("ts_ms").cast("string").alias(c) if c == "timestamp_ms" else text[NUMBERS[c]].alias(c) if c in NUMBERS else F.coalesce("housing", F.lit("")).alias(c) if c == "housing" else F.lit("").alias(c) for c in TELEMETRY
    ]
    readings.select(*cols).write.mode("append").csv(path, header=True, emptyValue="")


def rewrite_column(rows: DataFrame, name: str, fixed: DataFrame, key: str) -> DataFrame:
    """rows with column `name` (found by its header) replaced by fixed's where that is not null; other columns stay as text."""
    if name not in rows.columns:
        raise ValueError(f"no column {name}")
    out = rows.join(fixed.select(key, F.col(name).alias("new_")), key, "left")
    return out.select(*[F.coalesce(F.col("new_").cast("string"), F.col(name)).alias(name) if c == name else F.col(c) for c in rows.columns])


def encode_merged(timeline: DataFrame) -> DataFrame:
    """A timeline (src screen or event, in_game_ms, readings, event columns) as text columns in the file's order."""
    screen = F.col("src") == "screen"
    num = lambda c: F.coalesce(F.when(screen, F.col(c).cast("string")), F.lit(""))
    res = lambda c: F.when(screen, F.coalesce(F.col(c).cast("string"), F.lit(""))).otherwise(cost_text(F.coalesce(F.col(f"cost_{c}"), F.lit(0))))
    event = lambda c: F.coalesce(F.when(~screen, c), F.lit(""))
    made = {
        "in_game_ms": F.col("in_game_ms").cast("string"),
        "observation_type": F.when(screen, "ScreenGrab").otherwise("RecEvent"),
        "event_desc": event(F.col("description")),
        **{r: res(r) for r in ("food", "wood", "gold", "stone")},
        "rw_timestamp_ms": num("ts_ms"),
        "building_type": event(F.array_join("building_types", ",")),
        "building_ids": event(F.array_join(F.transform("building_ids", lambda i: i.cast("string")), ",")),
        **{c: num(c) for c in ("idle_vils", "pop_curr", "pop_max", "pop_vils")},
        "housing": num("housing"),
        "type_id": event(F.col("type_id").cast("string")),
    }
    return timeline.select(*[made[c].alias(c) for c in MERGED])


def decode_merged(rows: DataFrame) -> DataFrame:
    """The timeline of merged text rows; rows of no known kind are left out. What the file does not hold is null."""
    desc = F.col("event_desc")
    is_event = F.col("observation_type") == "RecEvent"
    screen = F.col("observation_type") == "ScreenGrab"
    sell, farm = desc.startswith("Market sell "), desc == "Farm queue"
    kind = (
        F.when(farm, "farm").when(sell, "sell").when(desc.startswith("Research "), "research").when(desc.startswith("Queue "), "queue")
        .when(desc == "Unqueue", "unqueue").when(desc.startswith("Build "), "build").when(desc.startswith("Delete "), "delete")
    )
    x = rows.withColumn("kind", F.when(is_event, kind)).where(screen | (is_event & F.col("kind").isNotNull()))
    num = lambda c: F.when(screen, F.col(c).try_cast("int"))
    return x.select(
        F.col("in_game_ms").cast("long").alias("in_game_ms"),
        F.when(screen, "screen").otherwise("event").alias("src"),
        "kind",
        F.when(is_event, desc).alias("description"),
        *[num(c).alias(c) for c in ("food", "wood", "gold", "stone", "idle_vils", "pop_curr", "pop_max", "pop_vils")],
        *[F.when(is_event, F.coalesce(cost_value(F.col(c)), F.lit(0))).alias(f"cost_{c}") for c in ("food", "wood", "gold", "stone")],
        F.when(screen, F.coalesce(F.col("rw_timestamp_ms").try_cast("long"), F.lit(0))).alias("ts_ms"),
        F.when(screen, status(F.col("housing"))).alias("housing"),
        F.when(is_event, F.filter(F.split("building_type", ","), lambda t: t != "")).alias("building_types"),
        F.when(is_event, int_list(F.col("building_ids"))).alias("building_ids"),
        F.when(is_event, F.coalesce(F.col("type_id").try_cast("long"), F.lit(0))).alias("type_id"),
        F.when(is_event, sell).alias("gives_resources"),
    )


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, schema=_strings(MERGED), mode="PERMISSIVE", emptyValue="", nullValue="\0")
    return decode_merged(raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in MERGED]))


def write_merged(timeline: DataFrame, path: str) -> None:
    encode_merged(timeline).write.mode("overwrite").csv(path, header=True, emptyValue="")


def read_game_data(spark: SparkSession, path: str) -> DataFrame:
    """(kind, id, name, food, wood, gold, stone); a bad number, an unknown kind or a repeated (kind, id) is an error."""
    raw = spark.read.csv(path, header=True, schema="kind string, id long, name string, food long, wood long, gold long, stone long", mode="FAILFAST")
    n = F.count("*").over(Window.partitionBy("kind", "id"))
    ok = F.assert_true(F.col("kind").isin("unit", "building", "tech") & (F.col("n_") == 1), F.lit("unknown kind or repeated id"))
    return raw.withColumn("n_", n).where(ok.isNull()).drop("n_")


def read_id_names(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) of a two-column CSV; rows without a readable id are skipped, of repeated ids the last row holds."""
    raw = spark.read.csv(path, header=True, schema="a string, name string", mode="PERMISSIVE").withColumn("line_", F.monotonically_increasing_id())
    x = raw.withColumn("id", F.col("a").try_cast("long")).where("id is not null")
    return x.groupBy("id").agg(F.max_by("name", "line_").alias("name"))


def read_ui_map(spark: SparkSession, path: str) -> DataFrame:
    """(baseline_margin, name, x_px, y_px, w_px, h_px, split_pct) of each element of a UI map."""
    schema = "baseline_margin double, elements map<string, struct<x_px:double,y_px:double,w_px:double,h_px:double,split_pct:double>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(
        "baseline_margin",
        F.explode("elements").alias("name", "e"),
    ).select("baseline_margin", "name", "e.*")


def read_frames(spark: SparkSession, folder: str, index: DataFrame | None = None) -> DataFrame:
    """(ts_ms, path, content) of recorded images by time, from an index (file, ts_ms) or <ts>.png names; none is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder).withColumn("file", F.substring_index("path", "/", -1))
    timed = files.join(index, "file") if index is not None else files.withColumn(
        "ts_ms",
        F.regexp_extract("file", r"^(\d+)\.png$", 1).try_cast("long"),
    ).where("ts_ms is not null")
    if timed.select("path").isEmpty():
        raise ValueError(f"no frames in {folder}")
    return timed.select("ts_ms", "path", "content").orderBy("ts_ms", "path")


def latest_file(spark: SparkSession, folders: list[str], after: str, pattern: str) -> DataFrame:
    """The newest file of any folder that changed after a time; no row if there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folders).select("path", "modificationTime")
    return files.where(F.col("modificationTime") > F.lit(after).cast("timestamp")).orderBy(F.col("modificationTime").desc(), "path").limit(1)


#: Lines of one part of a file of blocks.
PART_LINES = 1 << 16


def read_blocks(spark: SparkSession, path: str, size: int = PART_LINES) -> DataFrame:
    """(file, key, value) of `key: value` lines in blocks that a `File: name` line opens; lines before any block go.

    Files are read in parts of at most `size` lines; a part goes on with the last name of the parts before it.
    """
    n = F.monotonically_increasing_id()
    part = F.struct(F.col("_metadata.file_block_start").alias("at"), F.expr(f"n div {size}").alias("i")).alias("part")
    lines = spark.read.text(path).withColumn("n", n).select(F.col("_metadata.file_path").alias("src"), part, "n", "value")
    m = lambda i: F.regexp_extract("value", r"^\s*([^:]+?)\s*:\s*(.*?)\s*$", i)
    x = lines.select("src", "part", "n", m(1).alias("key"), m(2).alias("v")).where("key <> ''")
    opened = F.when(F.col("key") == "File", F.col("v"))
    ends = x.groupBy("src", "part").agg(F.max_by("v", F.when(F.col("key") == "File", F.col("n"))).alias("end"))
    along = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(F.col("src").alias("src_"), F.col("part").alias("part_"), F.last("end", True).over(along).alias("before"))
    inside = F.last(opened, True).over(Window.partitionBy("src", "part").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("own", inside).where("key <> 'File'")
    x = x.join(before, (F.col("src") == F.col("src_")) & (F.col("part") == F.col("part_"))).withColumn("file", F.coalesce("own", "before"))
    return x.where("file is not null").select("file", "key", F.col("v").alias("value"))


_COST = "map<string, bigint>"
_ITEM = f"map<string, struct<Cost: {_COST}>>"
_COSTS = f"data struct<Unit: {_ITEM}, Building: {_ITEM}, Tech: {_ITEM}, unit_upgrades: map<string, struct<ID: bigint, Cost: {_COST}>>>"
_NAMES = "units_buildings map<string, struct<localised_name: string>>, techs map<string, struct<localised_name: string>>"


def read_game_documents(spark: SparkSession, costs: str, names: str) -> tuple[DataFrame, DataFrame]:
    """(kind, id, section, costs) and (section, id, name) of the two JSON documents that game data is made from.

    The first has costs by kind and id, and upgrades, which are techs of their own ID; the second has names of units and
    buildings, and of techs.
    """
    doc = spark.read.schema(_COSTS).json(costs, multiLine=True)
    parts = []
    for kind, section in (("unit", "Unit"), ("building", "Building"), ("tech", "Tech")):
        parts.append(
            doc.select(F.explode(f"data.{section}").alias("key", "e")).select(
                F.lit(kind).alias("kind"),
                F.col("key").cast("long").alias("id"),
                F.col("e.Cost").alias("cost"),
            )
        )
    parts.append(
        doc.select(F.explode("data.unit_upgrades").alias("key", "e")).select(
            F.lit("tech").alias("kind"),
            F.col("e.ID").alias("id"),
            F.col("e.Cost").alias("cost"),
        )
    )
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    amount = [F.coalesce(F.try_element_at("cost", F.lit(r.capitalize())), F.lit(0)).alias(r) for r in ("food", "wood", "gold", "stone")]
    section = F.when(F.col("kind") == "tech", "techs").otherwise("units_buildings").alias("section")
    told = spark.read.schema(_NAMES).json(names, multiLine=True)
    both = [told.select(F.lit(c).alias("section"), F.explode(c).alias("key", "e")) for c in ("units_buildings", "techs")]
    return found.select("kind", "id", section, *amount), both[0].unionByName(both[1]).select(
        "section",
        F.col("key").cast("long").alias("id"),
        F.col("e.localised_name").alias("name"),
    )


def merge_game_data(costs: DataFrame, names: DataFrame, overrides: DataFrame) -> DataFrame:
    """(kind, id, name, food, wood, gold, stone) by kind and id: the overrides' name (kind, id, name), else the document's.

    An id without a name, or with two different rows, is an error; equal rows are one.
    """
    own = overrides.select("kind", "id", F.col("name").alias("own_"))
    x = costs.join(names, ["section", "id"], "left").join(own, ["kind", "id"], "left").withColumn("name", F.coalesce("own_", F.nullif("name", F.lit(""))))
    x = x.select("kind", "id", "name", "food", "wood", "gold", "stone").distinct()
    n = F.count("*").over(Window.partitionBy("kind", "id"))
    bad = F.assert_true((F.col("n_") == 1) & F.col("name").isNotNull(), F.lit("conflicting or unnamed id"))
    place = F.array_position(F.array(F.lit("unit"), F.lit("building"), F.lit("tech")), F.col("kind"))
    return x.withColumn("n_", n).where(bad.isNull()).drop("n_").orderBy(place, "id")


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, fields that are null included."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def event_lines(events: DataFrame) -> DataFrame:
    """(match_id, seq, line): a printed line of ten columns for each event."""
    cost = F.concat_ws("/", *[F.col(r).cast("string") for r in ("food", "wood", "gold", "stone")])
    ids = F.array_join(F.transform("building_ids", lambda i: i.cast("string")), ",")
    line = F.concat_ws(
        "\t",
        clock_single(F.col("ts_ms")),
        F.col("player_id").cast("string"),
        "kind",
        F.coalesce(F.col("type_id").cast("string"), F.lit("")),
        "description",
        cost,
        ids,
        F.array_join("building_types", ","),
        F.col("gives_resources").cast("string"),
        F.col("match_id").cast("string"),
    )
    return events.select("match_id", "seq", line.alias("line"))


def write_saved_frames(saved: DataFrame, frames: DataFrame, path: str) -> None:
    """The chosen frames (match_id, seq, reason) with their images and an index (file, ts_ms, reason), as Parquet.

    match_id is a column, no folder: there can be very many matches of a few frames each.
    """
    out = saved.join(frames, ["match_id", "seq"]).withColumn("file", F.concat(F.col("ts_ms").cast("string"), F.lit(".png")))
    out.select("match_id", "file", "ts_ms", "reason", "content").write.mode("append").parquet(path)
