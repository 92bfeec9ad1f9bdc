"""Integrity checks as one table of (check, value, ok)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checks(df: DataFrame, name: str, key: str, url: str) -> DataFrame:
    """VAL1: rows, blank keys, duplicate keys, redirects left, in one pass per table and one over its keys."""
    k, u = F.trim(F.coalesce(F.col(key), F.lit(""))), F.coalesce(F.col(url), F.lit(""))
    per_key = df.groupBy(k.alias("_k")).agg(F.count("*").alias("n"), F.count_if(F.contains(u, F.lit("/ck/a"))).alias("redirects"))
    one = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("_k") == "", F.col("n"))), F.lit(0)).alias("blank_keys"),
        F.count_if((F.col("_k") != "") & (F.col("n") > 1)).alias("duplicate_keys"), F.coalesce(F.sum("redirects"), F.lit(0)).alias("redirects"),
    )
    rule = {"rows": F.col("rows") > 0, "blank_keys": F.col("blank_keys") == 0, "duplicate_keys": F.col("duplicate_keys") == 0, "redirects": F.col("redirects") == 0}
    return one.select(F.explode(F.array(*[F.struct(F.concat(F.lit(f"{name}."), F.lit(c)).alias("check"), F.col(c).cast("bigint").alias("value"), r.alias("ok")) for c, r in rule.items()])).alias("c")).select("c.*")


# The reasons, and the words from which a page is not thin.
UNREACHABLE, THIN, FIRST, PANEL, LATER, FAILED = (
    "Skipped (Manual unreachable)", "Failed: Thin Content (<100 words)", "Pending Fetch (High Priority)", "Side-Panel Only (Skipped)", "Pending Fetch (Uncategorized)", "Failed: Fetch Error (403/429/Timeout)",
)
THIN_WORDS = 100


def missing_reason(df: DataFrame) -> DataFrame:
    """MRG18: why a page has no usable text; '' if it has.

    Columns: existing_reason, has_content, word_count, attempted, and the memberships is_inline, is_ranked, is_additional.
    """
    c = lambda n: F.coalesce(F.col(n), F.lit(False))
    wanted = c("is_inline") | c("is_ranked")
    without = F.when(~c("attempted"), F.when(wanted, FIRST).when(c("is_additional"), PANEL).otherwise(LATER)).when(c("is_additional") & ~wanted, PANEL).otherwise(FAILED)
    with_text = F.when(wanted & (F.coalesce("word_count", F.lit(0)) < THIN_WORDS), THIN).otherwise("")
    return df.withColumn("missing_reason", F.when(F.trim(F.coalesce("existing_reason", F.lit(""))) == UNREACHABLE, UNREACHABLE).when(c("has_content"), with_text).otherwise(without))
