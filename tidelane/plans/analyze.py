"""The whole analysis: readings and events of many matches to timelines, metrics, grades and findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelane import constants as C
from tidelane.functions.text import clock, overall_tier, percent_tier, stem
from tidelane.operators import anomalies, asof, folds, intervals, phases
from tidelane.operators import stats as stats_
from tidelane.operators.decode import is_refund
from tidelane.sources.telemetry import kept
from tidelane.sync.calibrate import PANEL, calibrate_matches

#: Events: match_id, seq, ts_ms (in game), kind, type_id, description, four costs, building_ids, building_types, gives_resources.
COSTS = list(C.RESOURCES)


def smoothed(readings: DataFrame) -> DataFrame:
    """readings with spikes of pop_vils smoothed."""
    new = folds.smooth_readings(readings, "pop_vils").select("match_id", "seq", F.col("after").cast("int").alias("fixed_"))
    return readings.join(new, ["match_id", "seq"]).withColumn("pop_vils", F.col("fixed_")).drop("fixed_")


def mappings(readings: DataFrame, events: DataFrame | None) -> DataFrame:
    """(match_id, status, knots, speed_before, speed_after): calibrated, or for matches without events from their first
    reading with all four resources at the fixed speed. A match that can be neither has no knots."""
    ready = F.min(F.when(F.expr(" and ".join(f"{r} is not null" for r in C.RESOURCES)), F.col("ts_ms")))
    start = readings.groupBy("match_id").agg(ready.alias("t0"))
    plain = F.when(F.col("t0").isNotNull(), F.array(F.struct(F.col("t0").cast("double").alias("rw"), F.lit(0.0).alias("ig"))))
    alone = start.select(
        "match_id",
        F.when(F.col("t0").isNotNull(), "telemetry only").otherwise("no complete reading").alias("status"),
        plain.alias("knots"),
        F.lit(C.TELEMETRY_SPEED).alias("speed_before"),
        F.lit(C.TELEMETRY_SPEED).alias("speed_after"),
    )
    if events is None:
        return alone
    fitted = calibrate_matches(readings, events.withColumn("ig_ms", F.col("ts_ms"))).where("knots is not null").select(
        "match_id",
        "status",
        "knots",
        "speed_before",
        "speed_after",
    )
    return fitted.unionByName(alone.join(fitted, "match_id", "left_anti"))


def in_game(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """rows with ig: ts_ms through the match's mapping, as a double."""
    t = F.col("ts_ms").cast("double")
    first, last = F.element_at("knots", 1), F.element_at("knots", -1)
    below = F.filter("knots", lambda k: k["rw"] <= t)
    a, b = F.element_at(below, -1), F.element_at(F.filter("knots", lambda k: k["rw"] > t), 1)
    inner = a["ig"] + (b["ig"] - a["ig"]) * (t - a["rw"]) / (b["rw"] - a["rw"])
    ig = F.when(
        t <= first["rw"],
        first["ig"] - (first["rw"] - t) * F.col("speed_before"),
    ).when(t >= last["rw"], last["ig"] + (t - last["rw"]) * F.col("speed_after")).otherwise(inner)
    return rows.join(
        maps.where("knots is not null").select("match_id", "knots", "speed_before", "speed_after"),
        "match_id",
    ).withColumn("ig", ig).drop("knots", "speed_before", "speed_after")


def timeline(readings: DataFrame, events: DataFrame | None, maps: DataFrame) -> DataFrame:
    """One row a reading from game start on and one an event until the last reading, in the order (in_game_ms, rank, seq).

    Events of unmapped or telemetry-only matches are left out.
    """
    shots = in_game(readings, maps)
    screens = shots.where("ig >= 0").select(
        "match_id",
        F.lit("screen").alias("src"),
        F.lit(1).alias("rank"),
        F.struct(F.col("seq"), F.lit(0).cast("long").alias("unit")).alias("seq"),
        F.round("ig").cast("long").alias("in_game_ms"),
        "ts_ms",
        *PANEL,
        "housing",
    )
    if events is None:
        return screens
    end = shots.groupBy("match_id").agg(F.round(F.greatest(F.max_by("ig", "ts_ms"), F.lit(0.0))).cast("long").alias("end_"))
    told = events.join(maps.where("status = 'ok'").select("match_id"), "match_id", "left_semi").join(end, "match_id").where("ts_ms <= end_")
    kind = events.schema["seq"].dataType
    parts = [F.col(f"seq.{n}") for n in kind.fieldNames()] if hasattr(kind, "fieldNames") else [F.col("seq"), F.lit(0).cast("long")]
    told = told.select(
        "match_id",
        F.lit("event").alias("src"),
        F.lit(0).alias("rank"),
        F.struct(parts[0].alias("seq"), parts[1].alias("unit")).alias("seq"),
        F.col("ts_ms").alias("in_game_ms"),
        "kind",
        "type_id",
        "description",
        *[F.col(r).alias(f"cost_{r}") for r in COSTS],
        "building_ids",
        "building_types",
        "gives_resources",
    )
    return screens.unionByName(told, allowMissingColumns=True)


def _clicks(line: DataFrame) -> DataFrame:
    tech = F.create_map(*[F.lit(x) for kv in C.PHASE_TECHS.items() for x in kv])
    return line.where("src = 'event' and kind = 'research'").withColumn("phase", tech[F.col("type_id").cast("int")]).where("phase is not null").select("match_id", F.col("in_game_ms").alias("ts_ms"), "seq", "phase")


def _rows(line: DataFrame, value: Column, kind: str) -> DataFrame:
    """All rows of the timeline for phases.segments, with a value of that type: other events end the last segment but carry nothing."""
    rows = line.where("not (src = 'event' and coalesce(kind = 'research', false))").select(
        "match_id",
        F.col("in_game_ms").alias("ts_ms"),
        "rank",
        "seq",
        F.when(F.col("src") == "screen", value).cast(kind).alias("value"),
        F.lit(None).cast("int").alias("phase"),
    )
    research = line.where("src = 'event' and kind = 'research'").select(
        "match_id",
        F.col("in_game_ms").alias("ts_ms"),
        "rank",
        "seq",
        F.lit(None).cast(kind).alias("value"),
    )
    clicks = phases.effective_clicks(_clicks(line)).select("match_id", "seq", "phase")
    return rows.unionByName(research.join(clicks, ["match_id", "seq"], "left").select(*rows.columns))


def _series(line: DataFrame, value: Column) -> DataFrame:
    return _rows(line, value, "long")


def keyed(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """rows of several numbers (array `value`, in the order of names) as one table of series: match_id is (match, name).

    Operators take any key as match_id, so that all series go through one plan.
    """
    x = rows.withColumn("x_", F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("name"), F.sequence(F.lit(0), F.lit(len(names) - 1)).alias("i"))))
    return x.withColumn("match_id", F.struct(F.col("match_id").alias("match"), F.col("x_.name").alias("name"))).withColumn("value", F.get("value", F.col("x_.i"))).drop("x_")


def _of(match: str, name: Column) -> Column:
    return F.struct(F.col(match).alias("match"), name.alias("name")).alias("match_id")


def _unkeyed(rows: DataFrame, name: str) -> DataFrame:
    rest = [c for c in rows.columns if c != "match_id"]
    return rows.select(F.col("match_id.match").alias("match_id"), F.col("match_id.name").alias(name), *rest)


def phase_segments(line: DataFrame, value) -> DataFrame:
    """Segments of one of a timeline's numbers."""
    return phases.segments(_series(line, value))


def floating(line: DataFrame) -> DataFrame:
    """(match_id, resource, phase, start_ms, end_ms): time above the phase's threshold, less what is saved for, 30 s or more."""
    clicks = _clicks(line)
    castles = line.where("src = 'event' and kind = 'build' and description = 'Build Castle'").select("match_id", F.col("in_game_ms").alias("ts_ms"), F.lit("stone").alias("name"))
    saved = F.when(F.col("phase") >= 2, F.array(F.lit("food"), F.lit("gold"))).otherwise(F.array(F.lit("food")))
    ends = clicks.select("match_id", "ts_ms", F.explode(saved).alias("name")).unionByName(castles)
    holes = ends.select(_of("match_id", F.col("name")), F.greatest(F.col("ts_ms") - C.SAVE_UP_MS, F.lit(0)).alias("from_ms"), F.col("ts_ms").alias("to_ms"))
    series = keyed(_rows(line, F.array(*[F.col(r).cast("long") for r in C.RESOURCES]), "array<bigint>"), C.RESOURCES)
    levels = F.create_map(*[x for i, r in enumerate(C.RESOURCES) for x in (F.lit(r), F.array(*[F.lit(t[i]) for t in C.THRESHOLDS]))])
    pieces = intervals.subtract(intervals.threshold_runs(series, levels[F.col("match_id.name")]), holes, C.FLOATING_MIN_MS)
    return _unkeyed(pieces, "resource")


def floating_by_phase(line: DataFrame, floats: DataFrame) -> DataFrame:
    """(match_id, phase, seconds of each resource), a row for every phase that the match was in."""
    seen = phases.with_phase(_series(line, F.lit(None))).select("match_id", F.col("now").alias("phase")).distinct()
    ms = F.col("end_ms") - F.col("start_ms")
    sums = floats.groupBy("match_id", "phase").agg(*[(F.sum(F.when(F.col("resource") == r, ms).otherwise(0)) / 1000.0).alias(f"{r}_s") for r in C.RESOURCES])
    return seen.join(sums, ["match_id", "phase"], "left").fillna(0.0, [f"{r}_s" for r in C.RESOURCES])


def grades(line: DataFrame, has_events: DataFrame) -> DataFrame:
    """(match_id, idle_pct, idle_tier, idle_stars, housed_..., overall_tier); no events or no time is no grade."""
    vils = phases.segments(_series(line, F.col("pop_vils")))
    idle = phases.segments(_series(line, F.col("idle_vils")))
    code = F.when(F.col("housing") == "housed", 2).when(F.col("housing") == "queued", 1).when(F.col("housing") == "normal", 0)
    house = phases.segments(_series(line, code))
    ms = F.col("end_ms") - F.col("start_ms")
    x = idle.groupBy("match_id").agg(F.sum(ms * F.col("value")).alias("lost"))
    x = x.join(vils.groupBy("match_id").agg(F.sum(ms * F.col("value")).alias("whole")), "match_id", "full")
    x = x.join(house.groupBy("match_id").agg(F.sum(F.when(F.col("value") == 2, ms).otherwise(0)).alias("housed"), F.sum(ms).alias("time")), "match_id", "full")
    x = x.join(has_events.withColumn("known", F.lit(True)), "match_id", "left")
    length = line.groupBy("match_id").agg((F.max("in_game_ms") - F.min("in_game_ms")).alias("length"))
    x = length.join(x, "match_id", "left")
    ok = F.coalesce(F.col("known"), F.lit(False)) & (F.col("length") > 0)
    share = lambda a, b: F.when(ok, F.when(F.col(b) > 0, F.coalesce(F.col(a), F.lit(0)) / F.col(b)).otherwise(0.0))
    (ip, it, i_s), (hp, ht, h_s) = percent_tier(share("lost", "whole")), percent_tier(share("housed", "time"))
    return x.select(
        "match_id",
        ip.alias("idle_pct"),
        it.alias("idle_tier"),
        i_s.alias("idle_stars"),
        hp.alias("housed_pct"),
        ht.alias("housed_tier"),
        h_s.alias("housed_stars"),
        F.when(ok, overall_tier(i_s + h_s)).otherwise("none").alias("overall_tier"),
    )


def chart(line: DataFrame, floats: DataFrame) -> DataFrame:
    """Each reading's label and flags for the report's charts."""
    out = line.where("src = 'screen'").select(
        "match_id",
        "seq",
        F.col("in_game_ms").alias("ts_ms"),
        stem(clock(F.col("in_game_ms"))).alias("label"),
        *PANEL,
        (F.coalesce(F.col("housing") == "housed", F.lit(False))).alias("housed"),
    )
    return intervals.inside_each(out, floats, "resource", C.RESOURCES, "floating_")


#: Numbers that are watched for misreads, and which must not exceed which.
WATCHED = (*C.RESOURCES, "pop_curr", "pop_max", "pop_vils")
ORDERED = (("pop_vils", "pop_curr"), ("idle_vils", "pop_vils"))


def _watched(line: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The readings of a timeline with s_, their number, and the watched numbers as series."""
    shots = line.where("src = 'screen'").withColumn("s_", F.col("seq.seq"))
    rows = shots.select("match_id", F.col("s_").alias("seq"), F.col("in_game_ms").alias("ts_ms"), F.array(*[F.col(c).cast("long") for c in WATCHED]).alias("value"))
    return shots, keyed(rows, WATCHED)


def misreads(line: DataFrame) -> DataFrame:
    """Findings (match_id, section, in_game_ms, field, detail) of the readings alone: glitch, increase and invariant."""
    shots, series = _watched(line)
    refunds = line.where(F.coalesce(is_refund(), F.lit(False)) & (F.col("src") == "event")).select("match_id", F.col("in_game_ms").alias("ts_ms"), F.explode(F.array(*[F.lit(r) for r in C.RESOURCES])).alias("name"))
    resource = F.col("match_id.name").isin(*C.RESOURCES)
    near = anomalies.neighbours(series)

    def finding(df: DataFrame, section: str, detail: Column) -> DataFrame:
        return df.select(F.col("match_id.match").alias("match_id"), F.lit(section).alias("section"), F.col("ts_ms").alias("in_game_ms"), F.col("match_id.name").alias("field"), detail.alias("detail"))

    odd = F.when(resource, F.col("glitch")).otherwise(anomalies.is_spike(C.POP_SPIKE))
    found = finding(near.where(odd), "glitch", F.concat_ws(" -> ", "prev", "value", "next"))
    rises = anomalies.large_increases(series.where(resource), refunds.select(_of("match_id", F.col("name")), "ts_ms"), C.LARGE_INCREASE, C.AFTER_MS, C.BEFORE_MS)
    found = found.unionByName(finding(rises, "increase", F.concat(F.lit("+"), F.col("rise").cast("string"))))
    bigger = F.array(*[F.struct(F.lit(a).alias("big"), F.lit(b).alias("small"), (F.col(a) > F.col(b)).alias("bad")) for a, b in ORDERED])
    pairs = shots.select("match_id", F.col("s_").alias("seq"), F.col("in_game_ms").alias("ts_ms"), F.explode(bigger).alias("x"))
    text = F.concat_ws(" > ", "x.big", "x.small")
    runs = anomalies.invariant_runs(pairs.select(_of("match_id", F.struct("x.big", text.alias("text"))), "seq", "ts_ms", "x.bad"), F.col("bad"))
    frames = F.concat(F.col("match_id.name.text"), F.lit(" in "), F.col("frames").cast("string"), F.lit(" frames"))
    return found.unionByName(
        runs.select(F.col("match_id.match").alias("match_id"), F.lit("invariant").alias("section"), F.col("first_ms").alias("in_game_ms"), F.col("match_id.name.big").alias("field"), frames.alias("detail"))
    )


def settled_spends(line: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(settled, shots, stats): every spend by the ledger and the drops that it leaves, written once; the readings; and spends (match_id, matched, total, reseeds, median_ms)."""
    shots, series = _watched(line)
    near = anomalies.neighbours(series.where(F.col("match_id.name").isin(*C.RESOURCES)))
    needs = line.where("src = 'event'").where(" or ".join(f"cost_{r} > 0" for r in C.RESOURCES))
    first = shots.groupBy("match_id").agg(F.min("in_game_ms").alias("t0"))
    spends = needs.join(first, "match_id").where("in_game_ms >= t0").select(
        "match_id",
        "seq.seq",
        "seq.unit",
        F.col("in_game_ms").alias("ts_ms"),
        "description",
        F.greatest(F.size("building_ids"), F.lit(1)).alias("buildings"),
        *[F.col(f"cost_{r}").alias(r) for r in C.RESOURCES],
    )

    def settle(key: tuple, s: list[dict], f: list[dict]) -> list[tuple]:
        s, first = sorted(s, key=lambda x: (x["ts_ms"], x["seq"], x["unit"])), int(key[1]) << 32
        pool: dict[str, list] = {}
        for x in f:
            pool.setdefault(x["resource"], []).append([x["ts_ms"], int(x["delta"])])
        want = [(i, x["ts_ms"], {r: int(x[r]) for r in C.RESOURCES if (x[r] or 0) > 0}) for i, x in enumerate(s)]
        rows = []
        for i, ok, off, got in folds.take_drops(want, pool):
            x, need = s[i], want[i][2]
            over = ok and x["buildings"] > 1 and all(got[r] < C.OVERCLAIM * n for r, n in need.items())
            short = {r: n for r, n in need.items() if got[r] < C.TAKE_FRACTION * n}
            shown = ", ".join(f"{r} {n} charged, ~{got[r]} on screen" for r, n in need.items())
            text = f"{x['description']} with {x['buildings']} buildings: {shown}" if over else x["description"]
            section = "overclaimed" if over else "matched" if ok else "unmatched"
            rows.append((key[0], first + i, section, x["ts_ms"], next(iter(short or need)), text, off, [{"resource": r, "need": n} for r, n in short.items()]))
        seeds, rest = folds.left_over(pool)
        return rows + [(key[0], -1, "reseed", 0, "wood", "", None, [])] * seeds + [(key[0], -1, "unexplained", ts, r, f"-{left}", None, []) for r, ts, left in rest]

    w = Window.partitionBy("match_id").orderBy("ts_ms", "seq")
    falls = near.withColumn("was", F.coalesce(F.lag("glitch").over(w), F.lit(False))).where("value < prev and not glitch and not was")
    falls = _unkeyed(falls.select("match_id", "seq", "ts_ms", (F.col("prev") - F.col("value")).alias("delta")), "resource")
    settled = folds.settled_pieces(
        spends,
        falls,
        settle,
        f"match_id {dict(line.dtypes)['match_id']}, n long, section string, in_game_ms long, field string, detail string, offset_ms long, short array<struct<resource:string,need:long>>",
    )
    settled = kept(settled, "settled")
    is_ = lambda *k: F.sum(F.col("section").isin(*k).cast("long"))
    stats = settled.groupBy("match_id").agg(
        is_("matched", "overclaimed").alias("matched"),
        is_("matched", "overclaimed", "unmatched").alias("total"),
        is_("reseed").alias("reseeds"),
    ).join(stats_.lower_percentiles(settled, ["match_id"], "offset_ms", {"median_ms": 50}), "match_id")
    return settled, shots, stats


def spend_checks(line: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings unmatched, overclaimed and unexplained, spends) of timelines (see sanity)."""
    settled, shots, stats = settled_spends(line)
    # why a spend found no drop: the last reading before it could not pay, or none was seen
    short = settled.where("section = 'unmatched'").select(
        "match_id",
        "n",
        F.col("in_game_ms").alias("ts_ms"),
        F.explode("short").alias("s"),
    ).select("match_id", "n", "ts_ms", "s.*")
    shown = shots.select(
        "match_id",
        "s_",
        "in_game_ms",
        F.explode(F.array(*[F.struct(F.lit(r).alias("resource"), F.col(r).alias("value")) for r in C.RESOURCES])).alias("x"),
    )
    shown = shown.select(
        "match_id",
        F.col("x.resource").alias("resource"),
        F.col("in_game_ms").alias("ts_ms"),
        F.col("s_").alias("seq"),
        F.col("x.value").cast("long").alias("value"),
    )
    had = asof.backward(short, shown, "value", "had", ("match_id", "resource"))
    poor = F.concat("resource", F.lit(": only "), F.col("had").cast("string"), F.lit(" available for "), F.col("need").cast("string"))
    none = F.concat("resource", F.lit(": no drop of ~"), F.col("need").cast("string"), F.lit(" on screen"))
    order = F.array_position(F.array(*[F.lit(r) for r in C.RESOURCES]), F.col("resource"))
    why = had.withColumn("why", F.when(F.col("had") < F.col("need"), poor).otherwise(none)).groupBy("match_id", "n").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), "why"))), lambda x: x["why"]), "; ").alias("why")
    )
    found = settled.where(
        "section in ('unmatched', 'overclaimed', 'unexplained')"
    ).join(why, ["match_id", "n"], "left").withColumn("detail", F.concat_ws(": ", "detail", "why")).select("match_id", "section", "in_game_ms", "field", "detail")
    return found, stats


def sanity(line: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings (match_id, section, in_game_ms, field, detail), spends (match_id, matched, total, reseeds)) of timelines."""
    line = kept(line, "timeline")
    found, stats = spend_checks(line)
    return misreads(line).unionByName(found), stats


@dataclass
class Analysis:
    mappings: DataFrame
    timeline: DataFrame
    floating: DataFrame
    floating_by_phase: DataFrame
    grades: DataFrame
    chart: DataFrame
    kept: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Frees the tables that the others are computed from."""
        for x in self.kept:
            x.unpersist()


def analyze(readings: DataFrame, events: DataFrame | None) -> Analysis:
    """Readings (match_id, seq, ts_ms, PANEL, housing) and events of any number of matches."""
    fixed = smoothed(readings)
    maps = mappings(fixed, events).persist()
    line = timeline(fixed, events, maps).persist()
    kept = (maps, line)
    if events is None:
        for c, t in (("kind", "string"), ("type_id", "long"), ("description", "string")):
            line = line.withColumn(c, F.lit(None).cast(t))
    floats = floating(line)
    return Analysis(
        maps,
        line,
        floats,
        floating_by_phase(line, floats),
        grades(line, maps.where("status = 'ok'").select("match_id")),
        chart(line, floats),
        kept,
    )
