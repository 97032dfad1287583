"""Rendering of one match's small result tables."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelane.constants import EXAMPLES, PHASES, RESOURCES
from tidelane.functions.text import clock


def _phase_name(phase: Column) -> Column:
    return F.get(F.array(*[F.lit(p) for p in PHASES]), phase)


def segment_lines(cut: DataFrame) -> DataFrame:
    """(match_id, start_ms, line) of segments: start, end, length, value, loss and the click that ended it."""
    w = Window.partitionBy("match_id").orderBy("start_ms", "end_ms")
    ms = F.col("end_ms") - F.col("start_ms")
    click = F.when(F.col("end_reason") == "phase", F.concat(F.lit(" ("), _phase_name(F.lead("phase").over(w)), F.lit(" Click)"))).otherwise("")
    parts = [clock(F.col("start_ms")), clock(F.col("end_ms")), F.format_string("%.3fs", ms / 1000.0), F.col("value").cast("string"), F.format_string("%.3f", ms * F.col("value") / 1000.0)]
    return cut.select("match_id", "start_ms", F.concat(F.concat_ws(" | ", *parts), click).alias("line"))


def phase_totals(cut: DataFrame) -> DataFrame:
    """(match_id, phase, lost): what segments lost in each phase, and TOTAL."""
    ms = (F.col("end_ms") - F.col("start_ms")) * F.col("value")
    x = cut.groupingSets([["match_id", "phase"], ["match_id"]], "match_id", "phase").agg(F.sum(ms).alias("ms"))
    return x.select("match_id", F.coalesce(_phase_name(F.col("phase")), F.lit("TOTAL")).alias("phase"), F.format_string("%.3f VS", F.col("ms") / 1000.0).alias("lost"))


def findings_text(findings: list[dict], stats: dict | None) -> str:
    """Sections with their first examples, and how many more there are."""
    out = []
    if stats:
        out.append(f"spends matched: {stats['matched']}/{stats['total']}, reseeds: {stats['reseeds']}")
    for section in dict.fromkeys(f["section"] for f in findings):
        rows = sorted((f for f in findings if f["section"] == section), key=lambda f: f["in_game_ms"])
        out.append(f"{section}: {len(rows)}")
        out += [f"  {f['in_game_ms'] // 60000:02d}:{f['in_game_ms'] % 60000 / 1000:06.3f} {f['field']}: {f['detail']}" for f in rows[:EXAMPLES]]
        if len(rows) > EXAMPLES:
            out.append(f"  ... {len(rows) - EXAMPLES} more")
    return "\n".join(out)


def finding_lines(findings: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """(match_id, section, place, line): how many findings a match's section has, its first ones by time, and how many more there are."""
    group = Window.partitionBy("match_id", "section")
    x = findings.withColumn("n", F.row_number().over(group.orderBy("in_game_ms", "field", "detail"))).withColumn("all", F.count("*").over(group)).where(F.col("n") <= most)
    line = F.format_string("  %s %s: %s", clock(F.col("in_game_ms")), "field", "detail")
    head = F.struct(F.lit(0).alias("place"), F.format_string("%s: %d", "section", "all").alias("line"))
    more = F.struct(F.lit(most + 1).alias("place"), F.format_string("  ... %d more", F.col("all") - most).alias("line"))
    own = F.struct(F.col("n").alias("place"), line.alias("line"))
    lines = F.when(F.col("n") > 1, F.array(own)).when(F.col("all") > most, F.array(head, own, more)).otherwise(F.array(head, own))
    return x.select("match_id", "section", F.explode(lines).alias("x")).select("match_id", "section", "x.place", "x.line")


#: The columns of a report's charts.
CHART = ("label", "pop_vils", "idle_vils", "housed", *[f"floating_{r}" for r in RESOURCES], *RESOURCES)


def chart_columns(chart: DataFrame) -> DataFrame:
    """(match_id, a JSON array for each chart column, in time order): one row a match, the report's own size."""
    points = F.sort_array(F.collect_list(F.struct("ts_ms", "seq", *CHART)))
    x = chart.groupBy("match_id").agg(points.alias("x"))
    return x.select("match_id", *[F.to_json(F.col(f"x.{c}")).alias(c) for c in CHART])


def page(title: str, players: list[dict], grade: dict, charts: dict[str, str], phases: list[dict]) -> str:
    """A page without outside resources; names are escaped, chart arrays are JSON."""
    stars = {"gold": "★★★", "silver": "★★", "bronze": "★"}
    rows = "".join(f"<tr><td>{html.escape(p['name'])}</td><td>{html.escape(p['civ'])}</td><td>{'won' if p.get('is_winner') else ''}</td></tr>" for p in players)
    table = "".join(f"<tr><td>{p['phase']}</td>" + "".join(f"<td>{p[f'{r}_s']:.1f}</td>" for r in RESOURCES) + "</tr>" for p in phases)
    data = "".join(f"const {n} = {v.replace('</', '<\\/')};\n" for n, v in charts.items())
    return (
        f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table>{rows}</table>"
        f"<p class='{grade['overall_tier']}'>{stars.get(grade['overall_tier'], '—')}</p><table>{table}</table><script>\n{data}</script></body></html>"
    )
