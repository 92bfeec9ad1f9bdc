"""Maintenance of tables by joins: upserts, merges, replacements, cascades, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def filled(c: Column | str) -> Column:
    """NULL for blanks."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(x.cast("string")) != "", x)


def _joined(dst: DataFrame, src: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    shared = [c for c in dst.columns if c in src.columns and c not in keys]
    renamed = src.select(*keys, *[F.col(c).alias(f"_src_{c}") for c in src.columns if c not in keys])
    return dst.join(renamed, keys, "full_outer"), shared, [c for c in src.columns if c not in dst.columns]


def upsert(dst: DataFrame, src: DataFrame, keys: list[str]) -> DataFrame:
    """MRG1, MRG3: rows of ``src`` are added or overwrite, blanks never do. Keys must be unique in both."""
    j, shared, new = _joined(dst, src, keys)
    own = [c for c in dst.columns if c not in keys and c not in shared]
    return j.select(*keys, *[F.coalesce(filled(f"_src_{c}"), F.col(c)).alias(c) for c in shared], *own, *[F.col(f"_src_{c}").alias(c) for c in new])


def fill_blanks(dst: DataFrame, src: DataFrame, keys: list[str]) -> DataFrame:
    """MRG2: as ``upsert``, but only blanks of ``dst`` are filled."""
    j, shared, new = _joined(dst, src, keys)
    own = [c for c in dst.columns if c not in keys and c not in shared]
    return j.select(*keys, *[F.coalesce(filled(c), F.col(f"_src_{c}")).alias(c) for c in shared], *own, *[F.col(f"_src_{c}").alias(c) for c in new])


def merge_duplicates(df: DataFrame, key: str, order: str, columns: list[str], overwrite: bool = False) -> DataFrame:
    """MRG4: one row per key; each column is its first (or last) value that is not blank.

    An aggregate, not a window: duplicates are combined before the shuffle, so a hot key is no hot task.
    """
    pick = F.max_by if overwrite else F.min_by
    return df.groupBy(key).agg(F.min(order).alias(order), F.count("*").alias("n_merged"), *[pick(F.col(c), F.when(filled(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def replace_keys(dst: DataFrame, src: DataFrame, keys: list[str]) -> DataFrame:
    """MRG6: all rows of the keys in ``src`` are replaced by those of ``src``."""
    return dst.join(src.select(*keys).distinct(), keys, "left_anti").unionByName(src, allowMissingColumns=True)


def update_from(dst: DataFrame, src: DataFrame, keys: list[str], columns: list[str], keep: bool = True) -> DataFrame:
    """MRG7: ``columns`` are taken from ``src``; rows without match keep theirs, or become NULL with ``keep=False``."""
    j = dst.join(src.select(*keys, *[F.col(c).alias(f"_src_{c}") for c in columns], F.lit(True).alias("_hit")), keys, "left")
    out = [F.when(F.col("_hit"), F.col(f"_src_{c}")).otherwise(F.col(c) if keep else F.lit(None)).alias(c) if c in columns else F.col(c) for c in dst.columns]
    return j.select(*out, *[F.col(f"_src_{c}").alias(c) for c in columns if c not in dst.columns])


def insert_missing(dst: DataFrame, src: DataFrame, key: str, order: list[str]) -> DataFrame:
    """MRG8, MRG15: the first row of each key of ``src`` that ``dst`` lacks is added."""
    from rankweave.operators.setops import first_wins

    new = first_wins(src.join(dst.select(key), key, "left_anti"), [key], order)
    return dst.unionByName(new.select(*[c for c in new.columns if c in dst.columns]), allowMissingColumns=True)


def flag(df: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """MRG14: 1 for rows whose key is in ``other``, else 0."""
    return df.join(other.select(*keys).distinct().withColumn("_in", F.lit(1)), keys, "left").withColumn(name, F.coalesce("_in", F.lit(0))).drop("_in")


def cascade(parents: DataFrame, keep: Column, children: dict[str, DataFrame], key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """MRG16: parents that fail ``keep`` go, and their children with them."""
    kept = parents.filter(keep)
    return kept, {n: c.join(kept.select(key), key, "left_semi") for n, c in children.items()}


def drop_unreferenced(df: DataFrame, key: str, references: list[DataFrame]) -> DataFrame:
    """MRG16, MRG17: rows whose key no table refers to any more go."""
    refs = references[0].select(key)
    for r in references[1:]:
        refs = refs.union(r.select(key))
    return df.join(refs.distinct(), key, "left_semi")


def ensure_columns(df: DataFrame, schema: StructType) -> DataFrame:
    """MRG19, MRG20: columns of ``schema`` in order (missing ones NULL), then the others; names trimmed."""
    df = df.toDF(*[c.strip() for c in df.columns])
    have = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*have, *[c for c in df.columns if c not in schema.names])


def repaired_groups(df: DataFrame, rank: str, size: str) -> DataFrame:
    """MRG11: a group is at least as large as a rank in it."""
    return df.withColumn(size, F.greatest(F.col(size), F.col(rank)))


def replicated(df: DataFrame, n: int, name: str = "copy_no") -> DataFrame:
    """MRG22: each row n times, numbered."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(n))))


def first_filled_over(column: str, keys: list[str], order: str) -> Column:
    """MRG4 in place: the first filled value of a group, for every row of it."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return F.first(filled(column), ignorenulls=True).over(w)
