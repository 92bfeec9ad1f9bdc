"""Queries of problem 7 over run_export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators.nested import json_triples, path_groups, pivot_group
from rankweave.session import table

SOURCES = ("sources_cited_json", "sources_additional_json")
ITEM, GROUP, LINK = "$[]", "$[].chip_groups[]", "$[].chip_groups[].links[]"
REPEATED = {"sources_cited_json": ("$",), "sources_additional_json": ("$",), "items_json": ("$", "$[].chip_groups", "$[].chip_groups[].links")}
URLS = {c: (ITEM, f"{ITEM}.url", f"{ITEM}.link") for c in SOURCES} | {"items_json": (LINK, f"{LINK}.url", f"{LINK}.link")}
PANEL = {"sources_cited_json": "cited", "sources_additional_json": "additional", "items_json": "item"}


def _url(d: DataFrame):
    """The element itself if it is a string, else its ``url``, else its ``link``; empty counts as missing."""
    text = [F.when((F.col(f"{c}_kind") == "string") & (F.col(c) != ""), F.col(c)) for c in ("self", "url", "link")]
    return F.coalesce(*text)


def _panel():
    return F.create_map(*[F.lit(x) for kv in PANEL.items() for x in kv])[F.col("doc")]


def run_triples(spark: SparkSession, sf: str, keep=None) -> DataFrame:
    return json_triples(table(spark, sf, "run_export"), "row_id", REPEATED, keep)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    t = run_triples(spark, sf, URLS)
    fields = {"self": "", "url": ".url", "link": ".link"}
    sources = pivot_group(t, "row_id", list(SOURCES), ITEM, fields)
    links = pivot_group(t, "row_id", ["items_json"], LINK, fields)
    o = F.col("ordinals")
    flat = sources.select("row_id", _panel().alias("panel"), F.lit(0).alias("item_no"), F.lit(0).alias("group_no"), o[0].alias("link_no"), _url(sources).alias("url")).unionByName(
        links.select("row_id", _panel().alias("panel"), o[0].alias("item_no"), o[1].alias("group_no"), o[2].alias("link_no"), _url(links).alias("url"))
    )
    return flat.filter(F.col("url").isNotNull())


def p7_sources(spark: SparkSession, sf: str) -> DataFrame:
    d = pivot_group(run_triples(spark, sf), "row_id", list(SOURCES), ITEM, {"self": "", "url": ".url", "link": ".link", "title": ".title", "description": ".description", "domain": ".domain"})
    return d.select("row_id", _panel().alias("panel"), F.col("ordinals")[0].alias("source_no"), _url(d).alias("url"), "title", "description", "domain")


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    d = pivot_group(run_triples(spark, sf), "row_id", ["items_json"], ITEM, {"item_section_title": ".item_section_title", "item_position": ".item_position", "item_name": ".item_name", "item_text": ".item_text"})
    return d.select("row_id", F.col("ordinals")[0].alias("item_no"), "item_section_title", F.col("item_position").try_cast("int").alias("item_position"), "item_name", "item_text")


def p7_link_groups(spark: SparkSession, sf: str) -> DataFrame:
    d = pivot_group(run_triples(spark, sf), "row_id", ["items_json"], GROUP, {"label": ".label"})
    return d.select("row_id", F.col("ordinals")[0].alias("item_no"), F.col("ordinals")[1].alias("group_no"), "label")


def p7_links(spark: SparkSession, sf: str) -> DataFrame:
    d = pivot_group(run_triples(spark, sf), "row_id", ["items_json"], LINK, {"self": "", "url": ".url", "link": ".link", "title": ".title", "domain": ".domain"})
    o = F.col("ordinals")
    return d.select("row_id", o[0].alias("item_no"), o[1].alias("group_no"), o[2].alias("link_no"), _url(d).alias("url"), "title", "domain")


def p7_path_groups(spark: SparkSession, sf: str) -> DataFrame:
    g = path_groups(run_triples(spark, sf))
    return g.select("doc", "ancestor", F.array_join("paths", " ").alias("paths"), "n_triples")


QUERIES = {"p7_found": p7_found, "p7_sources": p7_sources, "p7_items": p7_items, "p7_link_groups": p7_link_groups, "p7_links": p7_links, "p7_path_groups": p7_path_groups}
SQL: dict[str, str] = {}
