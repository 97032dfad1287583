"""Streams of frames: the session and the housing bridge as one stateful operator, the recorder as another."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelane.operators.folds import Bridge, Frame, Recorder, Session

FRAMES = "match_id long, seq long, ts_ms long, color string, pop_curr int, pop_max int, readable boolean, complete boolean"
STATES = "match_id long, seq long, ts_ms long, color string, state string"
SAVED = "match_id long, seq long, reason string"

#: How long a match may show nothing before it counts as over, in milliseconds of processing time.
IDLE_MS = 600_000

_FRAME = "ts_ms long, color string, gap long, seq long, state string"


def _number(v) -> int | None:
    return None if pd.isna(v) else int(v)


def _color(v) -> str | None:
    return v if isinstance(v, str) else None


def _frame(row: tuple | None) -> Frame | None:
    return None if row is None or row[0] is None else Frame(int(row[0]), row[1], int(row[2]), int(row[3]), row[4])


def _row(f: Frame | None) -> tuple:
    return (None,) * 5 if f is None else (f.ts_ms, f.color, f.gap, f.tag, f.state)


class _Expiring(StatefulProcessor):
    """One timer for each match, IDLE_MS after its last frame; all state of a match goes with it."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def _wait(self, timer) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timer.getCurrentProcessingTimeInMs() + self.idle_ms)

    def close(self) -> None:
        pass


class Live(_Expiring):
    """Rows of a recorded match with housing states.

    The end of a session, or of the wait for a match that just stops, releases what is held back.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "state string")
        self.overlay = handle.getValueState("overlay", _FRAME)
        self.colored = handle.getValueState("colored", _FRAME)
        self.held = handle.getListState("held", _FRAME)

    def _load(self) -> tuple[Session, Bridge]:
        session = Session(self.session.get()[0]) if self.session.exists() else Session()
        read = lambda v: _frame(v.get()) if v.exists() else None
        held = [_frame(x) for x in self.held.get()] if self.held.exists() else []
        return session, Bridge(held=held, overlay=read(self.overlay), colored=read(self.colored))

    def _save(self, session: Session, bridge: Bridge) -> None:
        self.session.update((session.state,))
        self.overlay.update(_row(bridge.overlay))
        self.colored.update(_row(bridge.colored))
        if bridge.held:
            self.held.put([_row(f) for f in bridge.held])
        else:
            self.held.clear()

    @staticmethod
    def _told(key, out: list[Frame]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], f.tag, f.ts_ms, f.color, f.state) for f in out], columns=["match_id", "seq", "ts_ms", "color", "state"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        session, bridge = self._load()
        out: list[Frame] = []
        for r in pd.concat(list(rows)).sort_values(["ts_ms", "seq"], kind="stable").itertuples(index=False):
            role = session.push(bool(r.readable), bool(r.complete))
            if role == "row":
                room, pop = (_number(v) or 0 for v in (r.pop_max, r.pop_curr))
                out += bridge.push(Frame(int(r.ts_ms), _color(r.color) or "white", room - pop, int(r.seq)))
            elif role == "end":
                out += bridge.close()
        self._save(session, bridge)
        self._wait(timerValues)
        yield self._told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, bridge = self._load()
        out = bridge.close()
        for state in (self.session, self.overlay, self.colored, self.held):
            state.clear()
        yield self._told(key, out)


class Saver(_Expiring):
    """Frames that the recorder saves; the first unreadable one after a start ends the match and is saved."""

    def __init__(self, totals: list[str], counts: list[str], idle_ms: int) -> None:
        super().__init__(idle_ms)
        self.totals, self.counts = totals, counts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        shown = ", ".join(f"{c} long" for c in (*self.totals, *self.counts))
        self.recorder = handle.getValueState("recorder", f"over boolean, saved_at long, lit_at long, pending long, {shown}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names, recorder, over, out = (*self.totals, *self.counts), Recorder(), False, []
        if self.recorder.exists():
            over, recorder.saved_at, recorder.lit_at, recorder.pending, *shown = self.recorder.get()
            recorder.shown = dict(zip(names, shown, strict=True))
        for x in pd.concat(list(rows)).sort_values(["ts_ms", "seq"], kind="stable").to_dict("records"):
            if over:
                break
            if "readable" in x and not x["readable"]:
                over = recorder.shown is not None
                out += recorder.end(int(x["seq"])) if over else []
                continue
            numbers = [{c: _number(x[c]) for c in part} for part in (self.totals, self.counts)]
            out += recorder.offer(int(x["seq"]), int(x["ts_ms"]), *numbers, _color(x["color"]))
        if recorder.shown is not None:
            self.recorder.update((over, recorder.saved_at, recorder.lit_at, recorder.pending, *[recorder.shown[c] for c in names]))
        self._wait(timerValues)
        yield pd.DataFrame([(key[0], int(s), why) for s, why in out], columns=["match_id", "seq", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.recorder.clear()
        yield pd.DataFrame([], columns=["match_id", "seq", "reason"])


def live_states(frames: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """STATES of a stream of FRAMES. Frames of a match arrive in order over batches and in any order within one.

    A match without frames for idle_ms of processing time is over: what is held comes out, and its state is dropped.
    """
    return frames.groupBy("match_id").transformWithStateInPandas(Live(idle_ms), STATES, "append", "processingTime")


def saved_frames(frames: DataFrame, totals: list[str], counts: list[str], idle_ms: int = IDLE_MS) -> DataFrame:
    """SAVED of a stream of FRAMES with numbers; state of a match without frames for idle_ms is dropped."""
    return frames.groupBy("match_id").transformWithStateInPandas(Saver(totals, counts, idle_ms), SAVED, "append", "processingTime")


def telemetry_sink(states: DataFrame, path: str, checkpoint: str, **trigger: object):
    """Starts appending states to CSV files, a flush for each batch."""
    write = states.writeStream.format("csv").option("header", "true").option("path", path).option("checkpointLocation", checkpoint)
    return write.outputMode("append").trigger(**(trigger or {"processingTime": "250 milliseconds"})).start()
