"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(ms: Column) -> Column:
    """MM:SS.mmm; minutes may have three digits or more."""
    return F.format_string("%02d:%02d.%03d", F.floor(ms / 60000), F.floor(ms % 60000 / 1000), ms % 1000)


def clock_single(ms: Column) -> Column:
    """MM:SS.mmm with seconds computed in single precision, as events are printed; minutes may have three digits or more."""
    seconds = (ms % 60000).cast("float") / F.lit(1000.0).cast("float")
    return F.format_string("%02d:%06.3f", F.floor(ms / 60000), seconds.cast("double"))


def signed_clock(ms: Column) -> Column:
    """[-]h:mm:ss.fff"""
    a = F.abs(ms)
    return F.concat(
        F.when(ms < 0, "-").otherwise(""),
        F.format_string("%d:%02d:%02d.%03d", F.floor(a / 3600000), F.floor(a / 60000) % 60, F.floor(a / 1000) % 60, a % 1000),
    )


def parse_clock(text: Column) -> Column:
    """Milliseconds of [h:]mm:ss[.f], or of epoch milliseconds above 1e11 (then those); null for anything else."""
    epoch = F.when(text.rlike("^[0-9]+$") & (text.try_cast("double") > 1e11), text.try_cast("long"))
    parts = F.aggregate(F.transform(F.split(text, ":"), lambda p: p.try_cast("double")), F.lit(0.0), lambda acc, x: acc * 60 + x)
    return F.coalesce(epoch, F.when(text.rlike(r"^[0-9]+(:[0-9]+)*(\.[0-9]+)?$"), F.round(parts * 1000).cast("long")))


def file_name(text: Column) -> Column:
    """Characters that file systems refuse, white space and controls become _."""
    return F.regexp_replace(text, r'[<>:"/\\|?*\s\p{Cntrl}]', "_")


def date_stamp(text: Column) -> Column:
    """A date for file names: - and : go, spaces become -."""
    return F.translate(F.translate(text, "-:", ""), " ", "-")


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("/", "&#x2f;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def newer_version(new: Column, old: Column) -> Column:
    """Whether [v]a.b.c is above another; false unless both have exactly three numbers."""
    pattern = r"^v?([0-9]{1,9})\.([0-9]{1,9})\.([0-9]{1,9})$"

    def parts(x: Column) -> Column:
        return F.array(*[F.regexp_extract(x, pattern, i).try_cast("int") for i in (1, 2, 3)])

    ok = new.rlike(pattern) & old.rlike(pattern)
    return F.coalesce(F.when(ok, parts(new) > parts(old)), F.lit(False))


def cost_text(cost: Column) -> Column:
    """A spend as -N; nothing for 0 or null."""
    return F.when(cost > 0, F.concat(F.lit("-"), cost.cast("string"))).otherwise(F.lit(""))


def cost_value(text: Column) -> Column:
    """The number behind leading dashes; null where there is none."""
    return F.ltrim(text, F.lit("-")).try_cast("long")


def int_list(text: Column) -> Column:
    """Whole numbers of a comma list; what is none is skipped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("long")), lambda x: x.isNotNull())


def stem(text: Column) -> Column:
    """The text before the first dot."""
    return F.substring_index(text, ".", 1)


def percent_tier(part: Column, gold: float = 2.0, silver: float = 4.0) -> tuple[Column, Column, Column]:
    """(percent to one digit, tier, stars); tiers go by the rounded percent, and no share is no grade."""
    pct = F.round(part * 100 * 10, 0) / 10
    tier = F.when(part.isNull(), "none").when(pct < gold, "gold").when(pct < silver, "silver").otherwise("bronze")
    stars = F.when(part.isNull(), 0).when(pct < gold, 3).when(pct < silver, 2).otherwise(1)
    return pct, tier, stars


def overall_tier(stars: Column, gold: int = 6, silver: int = 4) -> Column:
    return F.when(stars >= gold, "gold").when(stars >= silver, "silver").otherwise("bronze")


def panel_line(parts: list[tuple[str, Column, Column | None]], scale: Column, elapsed_ms: Column) -> Column:
    """`label total (vils)` for each part that was read, the scale and the time it took; a second number is optional."""
    shown = []
    for name, total, more in parts:
        second = F.lit("") if more is None else F.coalesce(F.concat(F.lit(" ("), more.cast("string"), F.lit(")")), F.lit(""))
        shown.append(F.when(total.isNotNull() & (total.cast("string") != ""), F.concat(F.lit(f"{name} "), total.cast("string"), second)))
    return F.concat_ws(" | ", *shown, F.concat(F.lit("scale "), F.format_string("%.2f", scale)), F.concat(elapsed_ms.cast("string"), F.lit(" ms")))


def range_middle(start: Column, end: Column) -> Column:
    """The 0-based middle of a 1-based range."""
    return F.floor((start + end) / 2) - 1
