"""Tables around page labels: best texts to send, answers taken apart, latest answers, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions.text import unfenced, valid_json
from rankweave.operators.setops import first_wins, latest_wins

RESPONSE = (
    "struct<urls:struct<type:string,content_format:string,tone:string,promotional_intensity_score:string,spamminess_score:string,primary_intent:string>,"
    "listicles:struct<title:string,category:string,n_products_listed:string,bias:string>,listicle_products:array<struct<position_in_listicle:string,product_name:string,product_url:string,product_domain:string,mention_type:string>>>"
)


def best_text(sources: list[tuple[DataFrame, str]], key: str, columns: list[str]) -> DataFrame:
    """LLM1: of each key the texts of the first source that has them; sources in order of trust, each with its order column."""
    parts = [s.select(key, *columns, F.lit(i).alias("_src"), F.col(o).cast("bigint").alias("_o")) for i, (s, o) in enumerate(sources)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    rank = F.struct("_src", "_o")
    return every.groupBy(key).agg(*[F.min_by(F.col(c), F.when(F.trim(F.coalesce(c, F.lit(""))) != "", rank)).alias(c) for c in columns])


def parsed_responses(log: DataFrame, response: str) -> DataFrame:
    """LLM2: adds ``label``, the answer as a struct; NULL if it is not readable."""
    text = unfenced(response)
    return log.withColumn("label", F.when(valid_json(text), F.from_json(text, RESPONSE)))


def label_tables(log: DataFrame, url: str, response: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """LLM2, LLM3, LLM5: urls, listicles and products of the answers; products once per (url, position, name)."""
    p = parsed_responses(log, response).filter("label IS NOT NULL")
    urls = p.select(F.col(url).alias("url"), "label.urls.*")
    listicles = p.filter("label.listicles IS NOT NULL").select(F.col(url).alias("listicle_url"), "label.listicles.*")
    products = p.select(F.col(url).alias("listicle_url"), F.posexplode("label.listicle_products").alias("_o", "p")).select("listicle_url", "_o", "p.*")
    products = first_wins(products, ["listicle_url", "position_in_listicle", "product_name"], ["_o"]).drop("_o")
    return urls, listicles, products


def latest_labels(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """LLM4: the last successful answer of each key, by file order."""
    return latest_wins(log.filter("ok"), [key], order)


def failures(log: DataFrame) -> DataFrame:
    """LLM6."""
    return log.filter(~F.coalesce("ok", F.lit(False)))


def to_label_int(x: Column) -> Column:
    """LLM7: booleans are 0 or 1, numbers and their texts are cut to whole ones, the rest (also the text "true") is NULL."""
    text = F.trim(x.cast("string"))
    return F.when(F.typeof(x) == "boolean", (text == "true").cast("int")).otherwise(text.try_cast("double").try_cast("int"))


def unlabelled(urls: DataFrame, done: DataFrame, failed: DataFrame | None, key: str) -> DataFrame:
    """FLT18, STM2: keys not labelled yet; with ``failed`` also those that failed are skipped."""
    rest = urls.filter(F.trim(F.coalesce("type", F.lit(""))) == "").join(done.select(key).distinct(), key, "left_anti")
    return rest if failed is None else rest.join(failed.select(key).distinct(), key, "left_anti")


def host_bias(products: DataFrame) -> DataFrame:
    """LLM8: pages whose own product is listed first."""
    own = products.filter((F.col("product_domain") == F.col("listicle_domain")) & (F.col("position_in_listicle").try_cast("int") == 1))
    return own.select("listicle_url").distinct()
