"""Problem 9: sources are combined to target shares of the total size, with capped repeats.

Method: hierarchical budgeting. The tree is source, language, domain (the site). Sources have their
target weights; below a source, nodes weigh a power of their tokens (``ALPHA``; 0.5 lifts small
languages and domains, 1 keeps their proportions). A node's budget is shared among its children by
weight, and what a child cannot take (all its tokens, repeated as often as allowed) goes to its
siblings, so a short domain is made up by domains of its language, a short language by languages of
its source, and only a short source by other sources. Each leaf then takes whole epochs and a prefix
of one more, in an order seeded by epoch, so the same seed selects the same rows.

Rows at the ends of the prefixes are settled over all leaves of a source, largest covered part
first, so a source misses its budget by half a row at most.

All steps are aggregates, windows over nodes (never over rows) and joins. A leaf's rows are put in
order by hash buckets: sums per bucket find the bucket where the prefix ends, and only that bucket
is ordered row by row, so a leaf that holds a third of all rows is no single task.

Defined results: rows without text or tokens are left out; sources without target are left out; a
NULL language or domain is a node of its own; a target without rows has share 0 and its weight goes
to the others; repeated rows each count. Without ``total`` the size is the largest at which every
source that has tokens reaches its share; a larger total uses more, and short sources fall behind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankweave.session import written

LEVELS = ("source", "lang", "site")
ALPHA = 0.5
BUCKETS = 4096
SMALL = 200_000  # leaves up to which their budgets are broadcast
SALTS = 16  # parts of the rows of one leaf where they are not


def fill(children: DataFrame, parent: list[str], budget: str, weight: str, cap: str) -> DataFrame:
    """Adds ``granted``: min(cap, level * weight), the level such that a parent's budget is used up or all caps are.

    Sorted by cap/weight the level follows in closed form from running sums, so redistribution
    needs no iteration: it is the first candidate level that its own child can take, which is the
    largest such, as the candidates after it fall.
    """
    node = W.partitionBy(*parent)
    order = node.orderBy(F.col("_ratio"), *[c for c in children.columns if c not in (budget, weight, cap)])
    before = order.rowsBetween(W.unboundedPreceding, -1)
    c = children.withColumn("_ratio", F.when(F.col(weight) > 0, F.col(cap) / F.col(weight)).otherwise(F.lit(float("inf"))))
    c = c.withColumn("_caps", F.coalesce(F.sum(cap).over(before), F.lit(0.0))).withColumn("_rest", F.sum(weight).over(node) - F.coalesce(F.sum(weight).over(before), F.lit(0.0)))
    c = c.withColumn("_level", (F.col(budget) - F.col("_caps")) / F.when(F.col("_rest") > 0, F.col("_rest")))
    c = c.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio") * (1 + 1e-12), F.col("_level"))).over(node))
    granted = F.when(F.col(weight) > 0, F.least(F.col(cap), F.coalesce(F.col("_level") * F.col(weight), F.col(cap)))).otherwise(F.lit(0.0))
    return c.withColumn("granted", granted).drop("_ratio", "_caps", "_rest", "_level")


def named(sized: DataFrame) -> DataFrame:
    """Rows with tokens, with a name for each node."""
    return sized.filter("n_tokens > 0").withColumns({c: F.coalesce(c, F.lit("")) for c in LEVELS[1:]})


def leaf_budgets(sized: DataFrame, targets: DataFrame, total: float | None = None, alpha: float = ALPHA) -> DataFrame:
    """Budgets of the leaves (source, lang, site) of ``sized`` under ``targets``, with those of their parents."""
    t = targets.filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    have = named(sized).groupBy(*LEVELS).agg(F.sum("n_tokens").cast("double").alias("available"), F.count("*").alias("n_rows"))
    have = written(have.join(F.broadcast(t.select("source", "max_repeats")) if t.count() <= SMALL else t.select("source", "max_repeats"), "source"), "leaves")
    everywhere = W.partitionBy(F.lit(1))  # over sources: as many rows as targets
    top = have.groupBy("source").agg(F.sum(F.col("available") * F.col("max_repeats")).alias("cap")).join(t.select("source", "weight"), "source")
    top = top.withColumn("weight", F.col("weight") / F.sum("weight").over(everywhere))
    top = top.withColumn("budget", F.lit(float(total)) if total is not None else F.min(F.col("cap") / F.col("weight")).over(everywhere)).withColumn("_root", F.lit(0))
    got = fill(top, ["_root"], "budget", "weight", "cap").select("source", F.col("granted").alias("source_budget"))
    for depth in (2, 3):
        parent, node = list(LEVELS[: depth - 1]), list(LEVELS[:depth])
        above = f"{parent[-1]}_budget"
        nodes = have.groupBy(*node).agg(F.sum(F.col("available") * F.col("max_repeats")).alias("cap"), F.pow(F.sum("available"), F.lit(float(alpha))).alias("weight"))
        below = fill(nodes.join(got, parent).select(*node, "cap", "weight", above), parent, above, "weight", "cap")
        got = below.select(*node, F.col("granted").alias(f"{node[-1]}_budget"))
    return written(have.join(got, list(LEVELS)).withColumnRenamed("site_budget", "budget"), "budgets")


def node_report(budgets: DataFrame, depth: int) -> DataFrame:
    """The nodes of a level: tokens available and budget, the budget their weight alone would give, and whether they are short."""
    node, parent = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
    n = budgets.groupBy(*node).agg(F.sum("available").alias("available"), F.sum(F.col("available") * F.col("max_repeats")).alias("cap"), F.sum("budget").alias("budget"))
    weight = F.pow("available", F.lit(ALPHA))
    by_weight = F.sum("budget").over(W.partitionBy(*parent)) * weight / F.sum(weight).over(W.partitionBy(*parent))
    return n.withColumn("by_weight", F.round(by_weight, 3)).withColumn("short", F.col("cap") < F.col("by_weight")).withColumns({c: F.round(c, 3) for c in ("budget", "cap")})


def _with_budget(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Rows with the budget of their leaf; the rows of one leaf are never brought together."""
    leaf = list(LEVELS)
    if budgets.count() <= SMALL:
        return rows.join(F.broadcast(budgets), leaf)
    salted = budgets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod("_hash", F.lit(SALTS)).cast("int")).join(salted, [*leaf, "_salt"]).drop("_salt")


def selection(sized: DataFrame, budgets: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """``key``, ``source``, ``lang``, ``site``, ``n_tokens`` and ``uses`` (times it is used) of each row taken."""
    leaf = list(LEVELS)
    b = budgets.select(*leaf, "budget", "available", "max_repeats").withColumn("_full", F.least(F.floor(F.col("budget") / F.col("available") + 1e-9), F.col("max_repeats")).cast("int"))
    b = b.withColumn("_left", F.greatest(F.col("budget") - F.col("_full") * F.col("available"), F.lit(0.0))).select(*leaf, "_full", "_left")
    rows = named(sized).select(F.col(key).alias("_key"), *leaf, "n_tokens").withColumn("_hash", F.xxhash64("_key"))
    rows = _with_budget(rows, b).withColumn("_hash", F.xxhash64("_key", F.lit(seed), F.col("_full"))).withColumn("_bucket", F.pmod("_hash", F.lit(BUCKETS)).cast("int"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    sums = rows.groupBy(*leaf, "_bucket").agg(F.sum("n_tokens").alias("_sum"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(W.partitionBy(*leaf).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = rows.join(sums, [*leaf, "_bucket"])
    whole = F.col("_before") + F.col("_sum") <= F.col("_left") + 1e-6
    ends = ~whole & (F.col("_before") < F.col("_left"))
    within = W.partitionBy(*leaf, "_bucket").orderBy("_hash", "_key", "_row").rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = placed.filter(ends).withColumn("_upto", F.col("_before") + F.sum("n_tokens").over(within))
    cut = written(cut.select("_key", *leaf, "n_tokens", "_full", "_left", "_upto"), "prefix-ends")
    inside = F.col("_upto") <= F.col("_left") + 1e-6
    straddles = ~inside & (F.col("_upto") - F.col("n_tokens") < F.col("_left"))
    # one row a leaf: what of it the budget covers is settled over the source
    covered = F.col("_left") - F.col("_upto") + F.col("n_tokens")
    last = cut.filter(straddles).withColumn("_covered", covered)
    due = F.sum("_covered").over(W.partitionBy("source"))
    running = F.sum("n_tokens").over(W.partitionBy("source").orderBy((F.col("_covered") / F.col("n_tokens")).desc(), *leaf[1:], "_key").rowsBetween(W.unboundedPreceding, W.currentRow))
    last = last.withColumn("_extra", (running - F.col("n_tokens") / 2 <= due).cast("int"))
    parts = [
        last,
        cut.filter(~straddles).withColumn("_extra", inside.cast("int")),
        placed.filter(~ends).withColumn("_extra", (whole & (F.col("_left") > 0)).cast("int")),
    ]
    every = [p.select("_key", *leaf, "n_tokens", (F.col("_full") + F.col("_extra")).alias("uses")) for p in parts]
    return reduce(DataFrame.unionByName, every).filter("uses > 0").withColumnRenamed("_key", key)


def _per(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(F.round(a / F.nullif(b, F.lit(0)), 6), F.lit(0.0))


def share_report(taken: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: target share, tokens available and used, share reached, mean and most repeats of the rows used."""
    got = taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.count("*").alias("used_rows"), F.sum("uses").alias("_uses"), F.max("uses").alias("most_uses"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    r = targets.filter("source IS NOT NULL").select("source", "target_share", "max_repeats").join(have, "source", "left").join(got, "source", "left")
    r = r.fillna(0, ["available_tokens", "used_tokens", "used_rows", "_uses", "most_uses"])
    total = F.sum("used_tokens").over(W.partitionBy(F.lit(1)))
    return r.withColumn("share", _per("used_tokens", total)).withColumn("mean_uses", _per("_uses", "used_rows")).drop("_uses")
