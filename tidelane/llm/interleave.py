"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelane.llm.common import cut, lookup, parts_of

#: Rows of one group that are kept in a row of the shuffle at most, as a part of a shard.
GROUP_SHARE = 50


def _ranked(rows: DataFrame, group: list[str], part: str, order: list[Column | str], out: str) -> DataFrame:
    """rows with out: the place from 1 of each row in its group by (part, order).

    Two steps: rows are counted for each part, the counts of one group's parts are summed along, and rows are numbered
    inside their part alone.
    """
    sizes = rows.groupBy(*group, part).agg(F.count("*").alias("n_"))
    along = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before_", F.coalesce(F.sum("n_").over(along), F.lit(0))).drop("n_")
    inside = Window.partitionBy(*group, part).orderBy(*order)
    numbered = rows.withColumn("in_", F.row_number().over(inside))
    return numbered.join(starts, [*group, part]).withColumn(out, F.col("before_") + F.col("in_")).drop("before_", "in_")


def _hash(seed: str, x: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(x.cast("string"), F.lit(""))).cast("binary"))


def _number(h: Column) -> Column:
    """The first 32 bits of a hash."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def interleaved(rows: DataFrame, n_shards: int, seed: str = "0", parts: int | None = None, group: str | None = None) -> DataFrame:
    """rows (doc_id, source and any others) with shard and slot added, in place of columns of these names.

    Rows of each source are shuffled by the MD5 of seed and doc_id, and row r of n gets the fraction (r - 1 + u) / n,
    where u from 0 to 1 is a hash of the source: sources of one row do not all stand in the middle. All rows sorted by
    fraction (ties by source, shuffle and doc_id) are cut into n_shards runs whose counts differ by one at most, so a
    shard's share of a source differs from the whole's by less than two rows, and by the rounding of all sources
    together. slot counts from 0 in a shard.

    With `group`, a column of group names, rows are shuffled by the MD5 of seed and group first, so that a group's rows
    have neighbouring fractions in each source, and near ones in all, and mostly come in one shard. Counts have
    precedence: groups at a cut are split, and one of more than a GROUP_SHARE-th of a shard is shuffled row by row.

    A null source is a source; null doc_ids and repeated rows are placed like others, in any order among equals.
    No rows give no rows. The rows are written once to the shared folder: pass ids and measures, not texts.
    """
    kept = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    source, doc_id = F.col("row_.source").cast("string"), F.col("row_.doc_id")
    base = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row_"))
    base = base.withColumn("s_", F.concat(F.when(source.isNull(), "0").otherwise("1"), F.coalesce(source, F.lit("")))).withColumn("d_", _hash(seed, doc_id))
    base = base.withColumn("g_", _hash(seed, F.col(f"row_.{group}")) if group else F.col("d_"))
    base = cut(base)
    total = base.count()
    parts = parts or parts_of(total)  # only to spread the work: no place depends on their number
    if group:  # at most n_shards * GROUP_SHARE names
        big = base.groupBy("g_").agg(F.count("*").alias("n_")).where(F.col("n_") * (n_shards * GROUP_SHARE) > total).select("g_", F.lit(True).alias("big_"))
        base = base.join(F.broadcast(big), "g_", "left").withColumn("g_", F.when(F.col("big_"), F.col("d_")).otherwise(F.col("g_"))).drop("big_")
    base = base.withColumn("number_", _number(F.col("g_"))).withColumn("p_", F.expr(f"cast((number_ * {parts}) div 4294967296 as int)")).drop("number_")
    ranked = _ranked(base, ["s_"], "p_", ["g_", "d_", "row_.doc_id"], "r_").drop("p_")
    sizes = base.groupBy("s_").agg(F.count("*").alias("n_")).withColumn("u_", _number(_hash(seed, F.col("s_"))))
    at = ((F.col("r_") - 1) * F.lit(2**32) + F.col("u_")).cast("double") / (F.col("n_").cast("double") * F.lit(float(2**32)))
    placed = ranked.join(lookup(sizes), "s_").withColumn("f_", at)
    placed = placed.withColumn("p_", F.least(F.floor(F.col("f_") * parts), F.lit(parts - 1)).cast("int")).withColumn("z_", F.lit(0))
    ordered = _ranked(placed, ["z_"], "p_", ["f_", "s_", "r_"], "at_")
    placed = ordered.withColumn("shard_", F.expr(f"cast(((at_ - 1) * {n_shards}) div {max(total, 1)} as int)"))
    first = F.expr(f"(shard_ * {total}L + {n_shards - 1}) div {n_shards}")
    return placed.select("row_.*", F.col("shard_").alias("shard"), (F.col("at_") - 1 - first).alias("slot"))


def shard_digest(docs: DataFrame, n_shards: int, seed: str = "0") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs; law is `rows`.

    size is the text's UTF-8 bytes plus 8; a null text has no bytes, and the checksum of none. Equal texts are groups
    (see interleaved).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("text_md5"),
    )
    out = interleaved(rows, n_shards, seed, group="text_md5")
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
