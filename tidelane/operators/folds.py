"""Sequential operators: small state machines over one match's rows, shared by batch (applyInPandas) and streams."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tidelane import constants as C


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by match (or keys) over all shuffle partitions: folds cost processor time, not bytes, so small stages must not be merged."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(keys or ("match_id",)))


def per_match(rows: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: tuple[str, ...] = ("ts_ms", "seq")) -> DataFrame:
    """run over each match's rows in order; one match is one group, thousands of rows at most."""
    return spread(rows).groupBy("match_id").applyInPandas(lambda p: run(p.sort_values(list(order), kind="stable")), schema)


#: Rows of results that a task holds back, about.
OUT_ROWS = 5000


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of each key, whose rows come one after another; the first columns are the key, null equals null."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
        if held and k[0] != last:
            yield last, pa.Table.from_batches(held)
            held = []
        at = 0
        for i in range(1, len(k)):
            if k[i] != k[i - 1]:
                yield k[at], pa.Table.from_batches([*held, batch.slice(at, i - at)])
                held, at = [], i
        held.append(batch.slice(at))
        last = k[-1]
    if held:
        yield last, pa.Table.from_batches(held)


def each_group(rows: DataFrame, keys: list[str], order: list[str], run: Callable[[tuple, pa.Table], list[tuple]], schema: str) -> DataFrame:
    """Rows run(key, rows of the key in order) for each key: a group after another in a task, for very many small groups.

    applyInPandas makes a pandas table and a message of each group, which takes longer than folding a few rows.
    """
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, group in runs(batches, len(keys)):
            out += run(key, group)
            if len(out) >= OUT_ROWS:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    rest = [c for c in rows.columns if c not in keys]
    return spread(rows, *keys).sortWithinPartitions(*keys, *order).select(*keys, *rest).mapInArrow(go, schema)


def half_away(x: float) -> int:
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)


# smoothing --------------------------------------------------------------------------------------------------------


def smooth(values: list[int | None], spike: int = C.MIN_SPIKE, longest: int = C.MAX_SPIKE_MS // C.CAPTURE_INTERVAL_MS) -> list[int | None]:
    """Readings between two near values at most longest + 1 apart become the line between them, if none of them is near it.

    Looked for from left to right; the shortest gap wins, and the search goes on from its right end. Missing readings
    in the gap are filled too.
    """
    out = list(values)

    def bridged(i: int, j: int) -> list[float] | None:
        a, b = out[i], out[j]
        if b is None or abs(b - a) >= spike:
            return None
        line = [a + (b - a) * (k - i) / (j - i) for k in range(i + 1, j)]
        off = all(v is None or abs(v - t) >= spike for v, t in zip(out[i + 1 : j], line, strict=True))
        return line if off else None

    at = 0
    while at < len(out):
        ahead = at + 1
        if out[at] is not None:
            for j in range(at + 2, min(at + longest + 2, len(out))):
                if (line := bridged(at, j)) is not None:
                    out[at + 1 : j] = [half_away(t) for t in line]
                    ahead = j
                    break
        at = ahead
    return out


def smooth_readings(rows: DataFrame, column: str = "value") -> DataFrame:
    """(match_id, seq, before, after) of each reading."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        raw = [None if pd.isna(v) else int(v) for v in p[column]]
        return pd.DataFrame({"match_id": p["match_id"], "seq": p["seq"], "before": pd.array(raw, "Int64"), "after": pd.array(smooth(raw), "Int64")})

    return per_match(rows.select("match_id", "seq", "ts_ms", column), run, "match_id long, seq long, before long, after long")


# housing bridge ---------------------------------------------------------------------------------------------------


@dataclass
class Frame:
    ts_ms: int
    color: str
    gap: int
    tag: object = None
    state: str = "normal"


@dataclass
class Bridge:
    """Fills white frames between blinking ones. Frames come out in order, held back while a bridge can still close.

    Two overlays within `housed_ms` make the frames between them housed; two coloured frames within `queued_ms` make
    those still normal queued. A frame whose gap (room less population) is above both ends' keeps its state.
    """

    housed_ms: int = C.HOUSED_TIMEOUT_MS
    queued_ms: int = C.QUEUED_TIMEOUT_MS
    held: list[Frame] = field(default_factory=list)
    overlay: Frame | None = None
    colored: Frame | None = None

    def _near(self, end: Frame | None, ts: int, limit: int) -> bool:
        return end is not None and ts - end.ts_ms <= limit

    def _release(self, *more: Frame) -> list[Frame]:
        out, self.held = [*self.held, *more], []
        return out

    def push(self, f: Frame) -> list[Frame]:
        housed, queued = self._near(self.overlay, f.ts_ms, self.housed_ms), self._near(self.colored, f.ts_ms, self.queued_ms)
        if f.color not in ("overlay", "yellow"):
            if housed or queued:
                self.held.append(f)
                return []
            self.overlay = self.colored = None
            return self._release(f)
        closing = [("housed", self.overlay)] if f.color == "overlay" and housed else []
        closing += [("queued", self.colored)] if queued else []
        for state, end in closing:
            for x in self.held:
                if x.gap <= max(end.gap, f.gap) and (state == "housed" or x.state == "normal"):
                    x.state = state
        self.colored = f
        if f.color == "overlay":
            f.state, self.overlay = "housed", f
            return self._release(f)
        f.state = "queued"
        if housed:
            self.held.append(f)
            return []
        self.overlay = None
        return self._release(f)

    def close(self) -> list[Frame]:
        """The end of a match: each held white frame takes the state of the coloured frame before it while that lasts."""
        last = self.overlay or self.colored
        for x in self.held:
            if x.color in ("overlay", "yellow"):
                last = x
            elif last and x.state == "normal" and x.gap <= last.gap:
                if last.color == "overlay" and x.ts_ms - last.ts_ms <= self.housed_ms:
                    x.state = "housed"
                elif x.ts_ms - last.ts_ms <= self.queued_ms:
                    x.state = "queued"
        return self._release()


def bridge_states(frames: DataFrame, housed_ms: int = C.HOUSED_TIMEOUT_MS, queued_ms: int = C.QUEUED_TIMEOUT_MS) -> DataFrame:
    """(match_id, seq, ts_ms, color, state) for frames (match_id, seq, ts_ms, color, pop_curr, pop_max).

    An unread population or room counts as 0; an unread colour is white.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        bridge, out = Bridge(housed_ms, queued_ms), []
        for r in p.itertuples(index=False):
            room, pop = (0 if pd.isna(v) else int(v) for v in (r.pop_max, r.pop_curr))
            out += bridge.push(Frame(int(r.ts_ms), r.color if isinstance(r.color, str) else "white", room - pop, r.seq))
        out += bridge.close()
        m = p["match_id"].iloc[0]
        return pd.DataFrame([(m, f.tag, f.ts_ms, f.color, f.state) for f in out], columns=["match_id", "seq", "ts_ms", "color", "state"])

    return per_match(frames.select("match_id", "seq", "ts_ms", "color", "pop_curr", "pop_max"), run, "match_id long, seq long, ts_ms long, color string, state string")


# thinning ---------------------------------------------------------------------------------------------------------


def kept_apart(times: Iterable[int], interval: int) -> list[bool]:
    """True for the first time and each one at least `interval` after the last kept."""
    out, last = [], None
    for t in times:
        out.append(last is None or t - last >= interval)
        last = t if out[-1] else last
    return out


def on_schedule(times: Iterable[float], interval: float) -> list[bool]:
    """True for each time that reaches the next point of a grid from 0 (a thousandth early is in time); one point a time."""
    out, due = [], 0.0
    for t in times:
        out.append(t >= due - 0.001)
        due += interval if out[-1] else 0.0
    return out


def resample(rows: DataFrame, interval_ms: int, size: int = 2000) -> DataFrame:
    """(match_id, seq, ts_ms) of the rows that are interval_ms or more after the last kept one, from each match's first on.

    A row that far after the one before it is kept whatever was kept before: matches are folded in pieces of `size` rows
    or so that begin at such rows.
    """
    w = Window.partitionBy("match_id").orderBy("ts_ms", "seq")
    fresh = F.coalesce(F.col("ts_ms") - F.lag("ts_ms").over(w) >= interval_ms, F.lit(True))
    x = rows.select("match_id", "seq", "ts_ms").withColumn("n_", F.row_number().over(w)).withColumn("fresh_", fresh)
    start = F.max(F.when(F.col("fresh_"), F.col("n_"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("start_", start).select("match_id", "seq", "ts_ms", F.expr(f"cast(start_ div {size} as int)").alias("piece_"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["ts_ms", "seq"], kind="stable")
        return p[kept_apart(p["ts_ms"], interval_ms)][["match_id", "seq", "ts_ms"]]

    return spread(x, "match_id", "piece_").groupBy("match_id", "piece_").applyInPandas(run, "match_id long, seq long, ts_ms long")


def sampled(rows: DataFrame, interval_ms: int) -> DataFrame:
    """(match_id, seq, ts_ms) of the rows that reach the next point of a grid from each match's first row (see on_schedule)."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        return p[on_schedule((p["ts_ms"] - p["ts_ms"].iloc[0]) / 1000, interval_ms / 1000)]

    return per_match(rows.select("match_id", "seq", "ts_ms"), run, "match_id long, seq long, ts_ms long")


def outliers(rows: DataFrame, value: str, target: object, interval_ms: int) -> DataFrame:
    """The sampled rows whose value is not the target; an unread one is none."""
    kept = sampled(rows, interval_ms).select("match_id", "seq")
    return rows.join(kept, ["match_id", "seq"], "left_semi").where(~F.col(value).eqNullSafe(F.lit(target)))


def sampled_states(frames: DataFrame, interval_ms: int, **limits: int) -> DataFrame:
    """Housing states of the frames that sampling keeps: a recording read every interval, then bridged."""
    kept = sampled(frames, interval_ms).select("match_id", "seq")
    return bridge_states(frames.join(kept, ["match_id", "seq"], "left_semi"), **limits)


# recorder ---------------------------------------------------------------------------------------------------------


@dataclass
class Recorder:
    """Which frames to save and why.

    A frame's events are, by precedence: a sharp change (from `gap` after the last save on; it saves the frame before
    too, unless that was saved), the population colour lighting up or having been out for `window`, the first frame,
    and `interval` since the last save. The frame on which the match is lost ends it and is always saved.
    """

    interval: int = C.RECORD_INTERVAL_MS
    gap: int = C.RECORD_GAP_MS
    jump: int = C.RESOURCE_JUMP
    count_jump: int = C.COUNT_JUMP
    window: int = C.BLINK_WINDOW_MS
    saved_at: int | None = None
    lit_at: int | None = None
    shown: dict | None = None
    pending: object = None  # the last frame, if it was not saved

    def _moved(self, now: dict[str, int | None], steps: dict[str, int]) -> str | None:
        """The first number that moved by its step or that only one of the two frames shows."""
        pairs = ((name, self.shown.get(name), v) for name, v in now.items())
        return next((name for name, old, v in pairs if (old is None) ^ (v is None) or None not in (old, v) and abs(v - old) >= steps[name]), None)

    def _lamp(self, ts: int, lit: bool) -> str | None:
        """start or end as the lamp goes from out to lit, or has been out for the window."""
        was = self.lit_at
        turn = {(True, True): "start", (False, False): "end"}.get((lit, was is None))
        if lit:
            self.lit_at = ts
        elif was is not None and ts - was < self.window:
            turn = None
        elif was is not None:
            self.lit_at = None
        return turn

    def offer(self, tag: object, ts: int, totals: dict, counts: dict, color: str | None) -> list[tuple[object, str]]:
        """(tag, reason) of the frames that this one makes worth saving."""
        numbers = totals | counts
        steps = dict.fromkeys(totals, self.jump) | dict.fromkeys(counts, self.count_jump)
        age = None if self.saved_at is None else max(ts - self.saved_at, 0)
        lamp = self._lamp(ts, color not in (None, "white"))
        moved = self._moved(numbers, steps) if self.shown is not None and age is not None and age >= self.gap else None
        due = "first" if age is None else "interval" if age >= self.interval else None
        events = [moved and f"change:{moved}", lamp and f"pop_color:{lamp}", due]
        reason = next(filter(None, events), None)
        out = [(self.pending, "before")] if moved and self.pending is not None else []
        self.shown, self.pending = numbers, tag
        if reason:
            out.append((tag, reason))
            self.saved_at, self.pending = ts, None
        return out

    def end(self, tag: object) -> list[tuple[object, str]]:
        """The frame on which the match was lost."""
        return [(tag, "end")]


def recorded(rows: DataFrame, totals: list[str], counts: list[str], **options: int) -> DataFrame:
    """(match_id, seq, reason) of saved frames, by time.

    rows (match_id, seq, ts_ms, color, totals, counts) may have `lost`: the first frame where it is true ends the
    match, and later ones are not looked at.
    """
    ends, numbers = "lost" in rows.columns, [*totals, *counts]

    def run(key: tuple, p: pa.Table) -> list[tuple]:
        r, out = Recorder(**options), []
        for x in p.to_pylist():
            if ends and x["lost"]:
                out += r.end(x["seq"])
                break
            num = {c: None if x[c] is None else int(x[c]) for c in numbers}
            out += r.offer(x["seq"], x["ts_ms"], {c: num[c] for c in totals}, {c: num[c] for c in counts}, x["color"])
        return [(key[0], *o) for o in out]

    x = rows.select("match_id", "seq", "ts_ms", "color", *numbers, *(["lost"] if ends else []))
    return each_group(x, ["match_id"], ["ts_ms", "seq"], run, "match_id long, seq long, reason string")


# session ----------------------------------------------------------------------------------------------------------


@dataclass
class Session:
    """waiting -> recording at the first complete frame (it writes no row) -> ended at the first unreadable one."""

    state: str = "waiting"

    def push(self, readable: bool, complete: bool) -> str:
        """What a frame is: idle, start, row, end or after."""
        if self.state == "waiting":
            if readable and complete:
                self.state = "recording"
                return "start"
            return "idle"
        if self.state == "recording":
            if readable:
                return "row"
            self.state = "ended"
            return "end"
        return "after"


def sessions(frames: DataFrame) -> DataFrame:
    """(match_id, seq, role) for frames with readable and complete flags; null flags are false.

    The first complete frame starts a match and the first unreadable one after it ends it: two minima over each match.
    """
    w = Window.partitionBy("match_id")
    readable, complete = (F.coalesce(c, F.lit(False)) for c in ("readable", "complete"))
    at, start, end = F.struct("ts_ms", "seq"), F.col("start_"), F.col("end_")
    x = frames.withColumn("at_", at).withColumn("start_", F.min(F.when(readable & complete, at)).over(w))
    x = x.withColumn("end_", F.min(F.when(~readable & (F.col("at_") > start), F.col("at_"))).over(w))
    at = F.col("at_")
    role = F.when(start.isNull() | (at < start), "idle").when(at == start, "start").when(end.isNull() | (at < end), "row").when(at == end, "end").otherwise("after")
    return x.select("match_id", "seq", role.alias("role"))


# spends and drops -------------------------------------------------------------------------------------------------


def take_drops(spends: list[tuple], falls: dict[str, list[list]], before: int = C.BEFORE_MS, after: int = C.AFTER_MS, delay: int = C.DELAY_MS, fraction: float = C.TAKE_FRACTION) -> Iterator[tuple]:
    """For each spend (tag, ts, {resource: need}) in order: (tag, matched, offset, {resource: got}).

    falls: by resource [ts, left] by time, changed in place. Each resource takes from the falls in [ts - before, ts + after],
    nearest to ts + delay first, until it has `fraction` of its need; a spend takes anything only if all of its
    resources get that. The offset is the earliest taken fall's time less the spend's.
    """
    times = {name: [d[0] for d in ds] for name, ds in falls.items()}
    for tag, ts, needs in spends:
        plan, got = [], {}
        for name, need in needs.items():
            a, b = bisect_left(times.get(name, ()), ts - before), bisect_right(times.get(name, ()), ts + after)
            window = [d for d in falls.get(name, ())[a:b] if d[1] > 0]
            window.sort(key=lambda d: abs(d[0] - ts - delay))
            have = 0
            for d in window:
                if have >= min(need, fraction * need):
                    break
                part = min(d[1], need - have)
                plan.append((d, part))
                have += part
            got[name] = have
        ok = all(got[n] >= fraction * need for n, need in needs.items())
        if ok:
            for d, part in plan:
                d[1] -= part
        yield tag, ok, min((d[0] for d, _ in plan), default=None) - ts if ok and plan else None, got


def left_over(falls: dict[str, list[list]]) -> tuple[int, list[tuple[str, int, int]]]:
    """(farm reseeds, unexplained (resource, ts, left) by time) of what take_drops left."""
    rest = [(r, ts, left) for r, ds in falls.items() for ts, left in ds if left >= C.LEAST_DROP]
    seeds = [x for x in rest if x[0] == "wood" and C.RESEED_LOW <= x[2] <= C.RESEED_HIGH]
    return len(seeds), sorted((x for x in rest if x not in seeds), key=lambda x: x[1])


def match_quality(found: DataFrame, least: int = C.MIN_MATCHED, share: float = C.MIN_SHARE) -> DataFrame:
    """(match_id, matched, total, share, status): ok, or too few matches, of greedy_match's rows."""
    x = found.groupBy("match_id").agg(F.sum(F.col("matched").cast("long")).alias("matched"), F.count("*").alias("total"))
    part = F.col("matched") / F.col("total")
    return x.select("match_id", "matched", "total", part.alias("share"), F.when((F.col("matched") >= least) & (part >= share), "ok").otherwise("too few matches").alias("status"))


#: Spends and falls of one piece of a match, about.
PIECE_ROWS = 2000


def _pieces(spends: DataFrame, falls: DataFrame, before: int, after: int, size: int) -> DataFrame:
    """Rows of both with side_ (0 and 1) and piece_ (see by_piece)."""
    s = spends.withColumn("side_", F.lit(0)).withColumn("from_", F.col("ts_ms") - before).withColumn("to_", F.col("ts_ms") + after)
    f = falls.withColumn("side_", F.lit(1)).withColumn("from_", F.col("ts_ms")).withColumn("to_", F.col("ts_ms"))
    w = Window.partitionBy("match_id").orderBy("from_", "side_", "seq")
    reach = F.max("to_").over(w.rowsBetween(Window.unboundedPreceding, -1))
    both = s.unionByName(f, allowMissingColumns=True).withColumn("fresh_", F.coalesce(F.col("from_") > reach, F.lit(True))).withColumn("n_", F.row_number().over(w))
    piece = F.expr(f"cast(start_ div {size} as int)")
    both = both.withColumn("start_", F.max(F.when(F.col("fresh_"), F.col("n_"))).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("piece_", piece)
    return both.select(*dict.fromkeys([*spends.columns, *falls.columns, "side_", "piece_"]))


def by_piece(spends: DataFrame, falls: DataFrame, run, schema: str, before: int = C.BEFORE_MS, after: int = C.AFTER_MS, size: int = PIECE_ROWS) -> DataFrame:
    """run(key, spends, falls) on pieces of matches, key (match_id, piece): rows of both are sorted by ts_ms and seq.

    Spends that see a common fall, directly or over others, stay together: a piece begins where no window of an earlier
    spend reaches, and has `size` rows or so if the match has such places. Spends without falls and falls without spends
    come, too. match_id, seq and ts_ms are columns of both.
    """
    own, theirs = spends.columns, falls.columns

    def both_sides(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["ts_ms", "seq"], kind="stable")
        return run(key, p[p["side_"] == 0][own], p[p["side_"] == 1][theirs])

    kept = _pieces(spends, falls, before, after, size)
    return spread(kept, "match_id", "piece_").groupBy("match_id", "piece_").applyInPandas(both_sides, schema)


def settled_pieces(spends: DataFrame, falls: DataFrame, run, schema: str, before: int = C.BEFORE_MS, after: int = C.AFTER_MS, size: int = PIECE_ROWS) -> DataFrame:
    """As by_piece, for very many small pieces: run(key, spends, falls) takes lists of dicts and gives a list of tuples."""

    def both_sides(key: tuple, p: pa.Table) -> list[tuple]:
        rows = p.to_pylist()
        return run(key, [x for x in rows if x["side_"] == 0], [x for x in rows if x["side_"] == 1])

    return each_group(_pieces(spends, falls, before, after, size), ["match_id", "piece_"], ["ts_ms", "seq"], both_sides, schema)


def greedy_match(spends: DataFrame, falls: DataFrame, **options: float) -> DataFrame:
    """(match_id, seq, matched, offset_ms, got) for spends (match_id, seq, ts_ms, cost) and falls (match_id, seq, ts_ms, delta)."""

    def run(key: tuple, s: list[dict], f: list[dict]) -> list[tuple]:
        pool = {"v": [[x["ts_ms"], int(x["delta"])] for x in f]}
        found = take_drops([(x["seq"], x["ts_ms"], {"v": int(x["cost"])}) for x in s if (x["cost"] or 0) > 0], pool, **options)
        return [(key[0], tag, ok, off, got["v"]) for tag, ok, off, got in found]

    window = {k: int(options[k]) for k in ("before", "after") if k in options}
    falls = falls.select("match_id", "seq", "ts_ms", "delta")
    return settled_pieces(spends.select("match_id", "seq", "ts_ms", "cost"), falls, run, "match_id long, seq long, matched boolean, offset_ms long, got long", **window)
