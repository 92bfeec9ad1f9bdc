"""Rank tests: Kruskal-Wallis and pairwise Mann-Whitney, with ties."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rankweave.session import written


EXACT, EXACT_CELLS = 8, 200_000


def running_before(df: DataFrame, within: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of ``within`` that come before a row by ``order``.

    Rows (one for each ``within`` and ``order``) are range-partitioned and summed in each partition; what
    precedes a partition follows from the partitions' sums. So a group of any size is no single task.
    """
    cut = written(df.repartitionByRange(*within, order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = cut.groupBy(*within, "_part").agg(F.sum(value).alias("_sum"))
    above = W.partitionBy(*within).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition and group
    sums = sums.withColumn("_above", F.coalesce(F.sum("_sum").over(above), F.lit(0))).drop("_sum")
    inside = W.partitionBy(*within, "_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return cut.join(sums, [*within, "_part"]).withColumn(name, F.col("_above") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_above", "_part")


def average_ranks(df: DataFrame, value: str, within: list[str]) -> DataFrame:
    """``rank`` (ties share their mean) and ``ties`` of each row, from counts per distinct value."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*within, value).agg(F.count("*").alias("ties"))
    ranks = running_before(n, within, value, "ties", "_before").withColumn("rank", F.col("_before") + (F.col("ties") + 1) / 2).drop("_before")
    return df.join(ranks, [*within, value])


def chi2_survival(h: float, df: int) -> float:
    """Upper tail of the chi-squared distribution, by the series and the continued fraction of the incomplete gamma function."""
    a, x = df / 2, h / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    b, c = x + 1 - a, 1e300
    d = 1 / b
    f = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d or 1e-300)
        c = b + an / c
        c = c or 1e-300
        f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return f * scale


def _chi2_p(h: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_survival(x, int(k)) if x == x else None for x, k in zip(h, df)])


def _exact_p(u: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([exact_u_p(float(a), int(b), int(c)) if b == b else None for a, b, c in zip(u, n, m)])


def _two_sided_normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([min(1.0, math.erfc(abs(x) / math.sqrt(2))) if x == x else None for x in z])


def exact_u_p(u: float, n: int, m: int) -> float:
    """Two-sided p of U without ties, from its exact distribution."""
    counts = [1] + [0] * (n * m)
    for i in range(1, n + 1):
        for k in range(n * m, m + i - 1, -1):
            counts[k] -= counts[k - m - i]
        for k in range(i, n * m + 1):
            counts[k] += counts[k - i]
    top = max(u, n * m - u)
    tail = sum(counts[math.ceil(top) :])
    return min(1.0, 2 * tail / sum(counts))


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """STA2: n, groups, tie-corrected H and p, one row."""
    r = average_ranks(df.select(group, value).filter(F.col(group).isNotNull()).withColumn("_all", F.lit(1)), value, ["_all"])
    g = r.groupBy(group).agg(F.count("*").alias("n"), F.sum("rank").alias("s"))
    h = g.agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"))
    t = r.groupBy(value).agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("t"))
    n = F.col("n").cast("double")
    j = h.crossJoin(t)  # one row each
    raw = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    j = j.withColumn("h", raw / F.nullif(1 - F.col("t") / (n * n * n - n), F.lit(0.0)))
    return j.select("n", "groups", "h", pandas_udf(_chi2_p, "double")("h", F.col("groups") - 1).alias("p"))


def mann_whitney_pairs(df: DataFrame, group: str, value: str) -> DataFrame:
    """STA1: U, two-sided p and Bonferroni p of each pair of groups.

    p is exact where the smaller group has at most ``EXACT`` values and no two values are equal (and the
    distribution of U at most ``EXACT_CELLS`` places), else tie-corrected normal with continuity. U follows
    from counts per distinct value, so no pair of rows is formed.
    """
    v = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    groups = v.groupBy("g").agg(F.sum("c").alias("n"))
    pairs = groups.select(F.col("g").alias("a"), F.col("n").alias("n_a")).join(groups.select(F.col("g").alias("b"), F.col("n").alias("n_b")), F.col("a") < F.col("b"))  # groups by groups
    both = pairs.join(v.withColumnRenamed("g", "a"), "a").withColumn("x", F.col("c")).withColumn("y", F.lit(0)).unionByName(pairs.join(v.withColumnRenamed("g", "b"), "b").withColumn("x", F.lit(0)).withColumn("y", F.col("c")))
    at = both.groupBy("a", "b", "n_a", "n_b", "v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    at = running_before(at, ["a", "b"], "v", "y", "_below")
    at = at.withColumn("u", F.col("x") * (F.col("_below") + F.col("y") / 2)).withColumn("t", F.pow((F.col("x") + F.col("y")).cast("double"), 3) - (F.col("x") + F.col("y")))
    s = at.groupBy("a", "b", "n_a", "n_b").agg(F.sum("u").alias("u"), F.sum("t").alias("t"))
    n, m = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    sd = F.sqrt(n * m / 12 * ((n + m + 1) - F.col("t") / ((n + m) * (n + m - 1))))
    z = (F.greatest(F.abs(F.col("u") - n * m / 2) - 0.5, F.lit(0.0))) / F.nullif(sd, F.lit(0.0))
    count = F.count("*").over(W.partitionBy(F.lit(1)))
    small = (F.col("t") == 0) & (F.least("n_a", "n_b") <= EXACT) & (n * m <= EXACT_CELLS)
    exact = pandas_udf(_exact_p, "double")("u", F.when(small, F.col("n_a")), F.when(small, F.col("n_b")))
    s = s.withColumn("_normal", pandas_udf(_two_sided_normal_p, "double")(z)).withColumn("_exact", exact).withColumn("p", F.coalesce("_exact", "_normal")).withColumn("p_bonferroni", F.least(F.col("p") * count, F.lit(1.0)))
    return s.select("a", "b", "n_a", "n_b", "u", "p", "p_bonferroni")


def formatted_p(p: Column) -> Column:
    """STA3."""
    return F.when(p < 0.001, F.lit("<0.001")).otherwise(F.format_number(p, 3))
