"""Queries of problems 1, 2, 5 and 6 over serp_export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.hosts import site_of
from rankweave.llm.body import body_labels, body_text
from rankweave.llm.copies import canonical_url
from rankweave.llm.cut import cut_rates, score_cuts
from rankweave.llm.residue import residue_pages
from rankweave.llm.spam import stuffed_pages
from rankweave.session import table


def _pages(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    rows = table(spark, sf, "serp_export").select("row_id", "domain", "url", "url_key", "content", *more)
    site = F.coalesce(*[site_of(F.when(F.trim(c) != "", F.col(c))) for c in ("url", "domain", "url_key")])
    return rows.withColumn("_site", site)


def _page_of(url: str = "url"):
    return F.when(F.regexp_replace(url, r"[^\p{L}\p{N}]", "") != "", canonical_url(F.col(url)))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return stuffed_pages(_pages(spark, sf), "row_id", "_site", "content").select("row_id")


def p1_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The flagged pages with their evidence."""
    return stuffed_pages(_pages(spark, sf), "row_id", "_site", "content")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue_pages(_pages(spark, sf), "row_id", "_site", "content", _page_of()).select("row_id")


def p2_clean(spark: SparkSession, sf: str) -> DataFrame:
    """serp_export without the excluded rows, per site, with the hints' agreement."""
    rows = _pages(spark, sf, "contentError", "js_render_suspected")
    bad = residue_pages(rows, "row_id", "_site", "content", _page_of()).select("row_id", F.lit(True).alias("_bad"))
    kept = rows.select("row_id", "_site", "contentError", "js_render_suspected").join(bad, "row_id", "left")
    hint = (F.trim(F.coalesce("contentError", F.lit(""))) != "") | (F.lower("js_render_suspected") == "true")
    return kept.groupBy(F.col("_site").alias("site")).agg(F.count_if(F.col("_bad").isNull()).alias("n_kept"), F.count("_bad").alias("n_excluded"), F.count_if(F.col("_bad").isNotNull() & hint).alias("n_hinted"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return body_labels(table(spark, sf, "serp_export"), "row_id", "content")


def p5_body(spark: SparkSession, sf: str) -> DataFrame:
    return body_text(table(spark, sf, "serp_export"), "row_id", "content")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pages(spark, sf, "contentLength")
    return score_cuts(rows, "row_id", "content", _page_of(), "contentLength", "_site")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).filter("score >= 0.5").select("row_id")


def p6_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of cut rows per site."""
    return cut_rates(_scored(spark, sf), "_site").withColumnRenamed("_site", "domain")


QUERIES = {f.__name__: f for f in (p1_found, p1_evidence, p2_found, p2_clean, p5_found, p5_body, p6_found, p6_rates)}
SQL: dict[str, str] = {}
