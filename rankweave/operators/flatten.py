"""Run exports become citation rows: both panels and the links inside the answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions.text import element_url, entities, items, source_urls
from rankweave.functions.urls import domain1, url_key2
from rankweave.operators.setops import first_wins


def panel_citations(runs: DataFrame) -> DataFrame:
    """Rows of the panels ``cited`` and ``additional``, positions from 1."""
    both = [runs.select("run_id", F.lit(s).alias("citation_type"), F.posexplode(source_urls(c)).alias("_p", "url")) for s, c in (("cited", "sources_cited_json"), ("additional", "sources_additional_json"))]
    return both[0].unionByName(both[1]).select("run_id", "citation_type", (F.col("_p") + 1).alias("cite_position"), "url", url_key2("url").alias("key"))


def inline_citations(runs: DataFrame) -> DataFrame:
    """Rows of the links in the answer: item, group and rank in the group; the panel position is filled by key, the cited panel first."""
    i = runs.select("run_id", F.posexplode(items("items_json")).alias("_i", "item"))
    g = i.select("run_id", (F.col("_i") + 1).alias("item_no"), "item.item_name", F.posexplode("item.chip_groups").alias("_g", "group"))
    links = F.filter(F.transform("group.links", element_url), lambda u: u.isNotNull() & (u != ""))
    g = g.withColumn("_links", F.coalesce(links, F.array().cast("array<string>")))
    flat = g.select("run_id", "item_no", "item_name", F.array_join(entities("item_name"), " + ").alias("entities"), (F.col("_g") + 1).alias("group_index"), F.size("_links").alias("group_size"), F.posexplode("_links").alias("_r", "url"))
    flat = flat.withColumn("rank_in_group", F.col("_r") + 1).withColumn("key", url_key2("url")).withColumn("domain", domain1("url")).drop("_r")
    panel = panel_citations(runs).withColumn("_o", F.when(F.col("citation_type") == "cited", 0).otherwise(1))
    at = first_wins(panel, ["run_id", "key"], ["_o", "cite_position"]).select("run_id", "key", F.col("citation_type").alias("panel"), F.col("cite_position").alias("panel_position"))
    return flat.join(at, ["run_id", "key"], "left")
