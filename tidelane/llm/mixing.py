"""Mixing sources to target weights: hierarchical token budgets over a domain-language-source tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelane.llm.common import cut, lookup, parts_of


def token_count(text: Column) -> Column:
    """Words of a text: runs without white space; null has none."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.regexp_count(t, F.lit(r"[^ \t-\r]+")).cast("long")


def numbered_domain(source: Column, domains: int = 4) -> Column:
    """A source's domain where the data names none: d0 to d3 by the number that ends its name, d0 without one."""
    digits = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.pmod(F.coalesce(digits.try_cast("int"), F.lit(0)), F.lit(domains)).cast("string"))


def weight_of(column: str, weights: dict[str, int], other: int) -> Column:
    pairs = [x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[F.col(column)] if pairs else F.lit(None), F.lit(other)).cast("long")


def _shared(nodes: DataFrame, parent: list[str], child: str, weight: Column) -> DataFrame:
    """nodes (parent, child, cap, budget of the parent) with `got`: the child's part.

    Water filling in whole tokens: children in order of cap / weight; as long as the next one's cap is below its part
    of what is left by weight it is filled, and its shortage stays with the siblings behind it. The rest is shared by
    weight, rounded down, and the last one takes what rounding left, up to its cap. Children of weight 0 get none.
    """
    w = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), child)
    before, onward = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    x = nodes.withColumn("w", weight).where("w > 0")
    x = x.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("ws", F.sum("w").over(onward))
    x = x.withColumn("full", F.col("cap").cast("decimal(38,0)") * F.col("ws") <= F.col("left").cast("decimal(38,0)") * F.col("w"))
    x = x.withColumn("open", ~F.col("full"))
    free = Window.partitionBy(*parent)
    x = x.withColumn(
        "rest",
        F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(free),
    ).withColumn("wr", F.sum(F.when(F.col("open"), F.col("w")).otherwise(0)).over(free))
    part = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("cast(floor(cast(rest as decimal(38,0)) * w / greatest(wr, 1)) as long)"))
    x = x.withColumn("part", part)
    last = F.row_number().over(Window.partitionBy(*parent).orderBy(F.col("full").asc(), (F.col("cap") / F.col("w")).desc(), F.col(child).desc()))
    x = x.withColumn("last", (last == 1) & ~F.col("full")).withColumn("spare", F.col("budget") - F.sum("part").over(free))
    return x.withColumn(
        "got",
        F.when(F.col("last"), F.least("cap", F.col("part") + F.col("spare"))).otherwise(F.col("part")),
    ).drop("w", "left", "ws", "full", "open", "rest", "wr", "part", "last", "spare")


def leaf_budgets(leaves: DataFrame, total: Column | int | None, share: tuple[int, int] | None, domains: dict[str, int], languages: dict[str, int], sources: dict[str, int], max_epochs: int, other: int = 1) -> DataFrame:
    """(domain, lang, source, tokens, got) for leaves (domain, lang, source, tokens).

    A node can give its leaves' tokens times max_epochs at most. The budget is total, or share (a/b) of what the root
    can give, or without both the largest one at which every domain gives its weight. Each level shares its budget among its children (see _shared): what a child can't give goes to its
    siblings, and to the level above only when no sibling has room, since a node's own cap is its leaves' sum.
    """
    leaf = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    lang = leaf.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    dom = lang.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("root", F.lit(0))
    room = F.sum("cap").over(Window.partitionBy("root"))
    dom = dom.withColumn("weight", weight_of("domain", domains, other))
    if total is not None:
        want = F.lit(total) if isinstance(total, int) else total
    elif share is not None:
        want = F.expr(f"(sum(cap) over (partition by root) * {int(share[0])}) div {int(share[1])}")
    else:
        dom = dom.withColumn("weights", F.sum("weight").over(Window.partitionBy("root")))
        want = F.min(F.when(F.col("weight") > 0, F.expr("cast(floor(cast(cap as decimal(38,0)) * weights / weight) as long)"))).over(Window.partitionBy("root"))
    dom = dom.withColumn("budget", F.least(room, want.cast("long")))
    dom = _shared(dom, ["root"], "domain", weight_of("domain", domains, other)).select("domain", F.col("got").alias("budget"))
    lang = _shared(lang.join(dom, "domain"), ["domain"], "lang", weight_of("lang", languages, other)).select("domain", "lang", F.col("got").alias("budget"))
    return _shared(
        leaf.join(lang, ["domain", "lang"]),
        ["domain", "lang"],
        "source",
        weight_of("source", sources, other),
    ).select("domain", "lang", "source", "tokens", "got")


def mixture(
    docs: DataFrame,
    domains: dict[str, int],
    languages: dict[str, int],
    sources: dict[str, int] | None = None,
    total: int | None = None,
    share: tuple[int, int] | None = (1, 2),
    max_epochs: int = 1,
    seed: str = "0",
    other: int = 1,
    domain: Column | None = None,
    parts: int | None = None,
) -> DataFrame:
    """(doc_id, epoch, domain, lang, source, n_tokens, text_key) of the chosen rows; docs' other columns but text are not
    read. text_key is xxhash64 of the text.

    Weights are whole numbers and `other` holds for names without one. Each leaf's rows are put in an order of their
    own for each epoch, by the MD5 of seed, epoch and doc_id; the leaf takes whole epochs and then the prefix whose
    rows start before its budget ends, so it exceeds its budget by less than one document. Null lang, source and
    domain are the name ''; null and empty texts have no token, never end a prefix, and come with the rows around
    them. Repeated doc_ids are rows of their own; among equal hashes any order holds. No rows give no rows.
    """
    leafed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        (numbered_domain(F.col("source").cast("string")) if domain is None else F.coalesce(domain, F.lit(""))).alias("domain"),
        token_count(F.col("text")).alias("n_tokens"),
        F.xxhash64("text").alias("text_key"),
    )
    rows = cut(leafed)
    # a leaf's seeded order is cut in parts by hash; only rows of the part that the budget ends in are ranked
    parts = parts or parts_of(rows.count())
    key = ["domain", "lang", "source"]
    leaves = rows.groupBy(*key).agg(F.sum("n_tokens").alias("tokens"))
    got = leaf_budgets(leaves, total, share, domains, languages, sources or {}, max_epochs, other)
    # whole epochs, and what the one after them gives
    plan = got.withColumn(
        "whole",
        F.expr("case when tokens > 0 then got div tokens else 0 end"),
    ).withColumn("rest", F.col("got") - F.col("whole") * F.col("tokens"))
    plan = cut(plan.select(*key, F.col("whole").cast("int").alias("whole"), "rest"))
    epochs = rows.join(lookup(plan), key).withColumn("epoch", F.explode(F.expr("sequence(0, whole)"))).where("epoch < whole or rest > 0")
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    full = epochs.where("epoch < whole")
    part = epochs.where("epoch = whole").withColumn("h_", hashed).withColumn(
        "p_",
        (F.conv(F.substring("h_", 1, 8), 16, 10).cast("long") * parts / 2**32).cast("int"),
    )
    sums = part.groupBy(*key, "p_").agg(F.sum("n_tokens").alias("t_"))
    along = Window.partitionBy(*key).orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*key, "p_", F.coalesce(F.sum("t_").over(along), F.lit(0)).alias("b_"))
    inside = Window.partitionBy(*key, "p_").orderBy("h_", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    part = part.join(starts, [*key, "p_"]).where("b_ < rest").withColumn(
        "b_",
        F.col("b_") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)),
    ).where("b_ < rest")
    cols = ["doc_id", "epoch", *key, "n_tokens", "text_key"]
    return full.select(*cols).unionByName(part.select(*cols))
