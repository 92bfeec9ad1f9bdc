"""Queries of problem 4 over serp_export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.hosts import site_of
from rankweave.operators.timestamps import ENTRY, normalise_timestamps, raw_values, value_dictionary
from rankweave.session import fresh_path, table

FIELDS = ["published_date", "modified_date"]
ZONES_LIMIT = 8 << 20  # bytes of site_zones up to which it is broadcast; beyond, Spark chooses the join


def _zoned(spark: SparkSession, sf: str) -> DataFrame:
    """serp_export with the zone of the site of each row: of its url, else its domain, else its key."""
    zones = table(spark, sf, "site_zones").select(F.col("domain").alias("_site"), F.col("time_zone").alias("_zone")).dropDuplicates(["_site"])
    if zones._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= ZONES_LIMIT:
        zones = F.broadcast(zones)
    rows = table(spark, sf, "serp_export").select("row_id", "domain", "url", "url_key", *FIELDS)
    blank = lambda c: F.when(F.lower(F.trim(c)).isin("", "nan", "null"), None).otherwise(c)
    site = F.coalesce(*[site_of(blank(F.col(c))) for c in ("url", "domain", "url_key")])
    return rows.withColumn("_site", site).join(zones, "_site", "left")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "dictionary")
    return normalise_timestamps(_zoned(spark, sf), FIELDS, "_zone", ["row_id"], path, "_site").select("row_id", "field", "utc_ms")


def p4_increments(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary that grows: the values of one field, then those of the other, of which only new ones are parsed."""
    path, rows = fresh_path(spark, "dictionary"), _zoned(spark, sf)
    steps, before = [], 0
    for field in FIELDS:
        values = raw_values(rows, [field], "_zone", "_site")
        after = value_dictionary(values, path).count()
        n = values.select(*ENTRY).distinct().agg(F.lit(field).alias("field"), F.count("*").alias("n_values"))
        steps.append(n.withColumn("n_parsed", F.lit(after - before).cast("bigint")))
        before = after
    return steps[0].unionByName(steps[1])


def p4_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Values per field: all, not blank, normalised."""
    rows = _zoned(spark, sf)
    done = normalise_timestamps(rows, FIELDS, "_zone", ["row_id"]).groupBy("field").agg(F.count("*").alias("n_instants"))
    at = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("raw")) for f in FIELDS])).alias("v")
    every = rows.select(at).groupBy("v.field").agg(F.count("*").alias("n_rows"), F.count_if(F.trim("v.raw") != "").alias("n_values"))
    return every.join(done, "field", "left").select("field", "n_rows", "n_values", F.coalesce("n_instants", F.lit(0)).alias("n_instants"))


QUERIES = {"p4_found": p4_found, "p4_coverage": p4_coverage, "p4_increments": p4_increments}
SQL: dict[str, str] = {}
