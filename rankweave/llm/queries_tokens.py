"""Queries of problems 3, 8, 9 and 10."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankweave.llm.copies import canonical_run, canonical_text, canonical_url, collapsed, copy_membership
from rankweave.llm.mixing import leaf_budgets, node_report, selection, share_report
from rankweave.llm.splitting import split_documents
from rankweave.llm.tokens import encoded, token_counts, vocabulary_path
from rankweave.session import table, written

TOKENIZER = "byte_bpe_50k"


def _keyed(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    rows = table(spark, sf, "serp_export").select("row_id", "run_id", "url", *more)
    page = canonical_url(F.col("url"))
    key = F.concat_ws("|", F.coalesce(canonical_run(F.col("run_id")), F.lit("")), page)
    return rows.withColumn("_key", F.when(F.regexp_replace(F.col("url"), r"[^\p{L}\p{N}]", "") != "", key))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    m = copy_membership(_keyed(spark, sf), "_key", "row_id")
    return m.filter("id > first").select(F.col("first").alias("first_row_id"), F.col("id").alias("row_id"))


def p3_records(spark: SparkSession, sf: str) -> DataFrame:
    """One record per result, with its number of copies."""
    n = collapsed(copy_membership(_keyed(spark, sf), "_key", "row_id"))
    rows = table(spark, sf, "serp_export").select("row_id", "run_id", "url", "title")
    return rows.join(n, rows["row_id"] == n["first"]).select("row_id", canonical_run(F.col("run_id")).alias("run_id"), "url", "title", "n_copies")


def p3_document_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Class and number of copies of each document whose text differs in formatting only."""
    docs = table(spark, sf, "documents").select("doc_id", F.nullif(canonical_text(F.col("text")), F.lit("")).alias("_key"))
    m = copy_membership(docs, "_key", "doc_id")
    return collapsed(m).select(F.col("first").alias("doc_id"), "n_copies")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(table(spark, sf, "documents"), "doc_id", "text", vocabulary_path(TOKENIZER))


def p8_counts(spark: SparkSession, sf: str) -> DataFrame:
    sized = token_counts(table(spark, sf, "documents"), ["doc_id", "lang"], "text", vocabulary_path(TOKENIZER))
    return sized.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("most_tokens"))


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", F.lower(F.substring_index("lang", "-", 1)).alias("lang"), "site", "text")
    return written(token_counts(docs, ["doc_id", "source", "lang", "site"], "text", vocabulary_path(TOKENIZER)), "sizes")


def p9_mix(spark: SparkSession, sf: str, total: float | None = None) -> DataFrame:
    """Shares reached per source, at ``total`` tokens or as many as leave every source its share."""
    sized, targets = _sized(spark, sf), table(spark, sf, "mix_targets")
    return share_report(selection(sized, leaf_budgets(sized, targets, total), "doc_id"), sized, targets)


def p9_selection(spark: SparkSession, sf: str) -> DataFrame:
    sized, targets = _sized(spark, sf), table(spark, sf, "mix_targets")
    return selection(sized, leaf_budgets(sized, targets), "doc_id")


def p9_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Budgets of the languages of each source, and which are short and made up by their siblings."""
    sized, targets = _sized(spark, sf), table(spark, sf, "mix_targets")
    return node_report(leaf_budgets(sized, targets), 2)


def p9_mix_by_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """As p9_mix over one and a half times the listed tokens: short sources give their shortage to the others."""
    sized, targets = _sized(spark, sf), table(spark, sf, "mix_targets")
    listed = sized.join(F.broadcast(targets.select("source")), "source", "left_semi")  # targets: one row a source, fixed
    total = (listed.agg(F.sum("n_tokens")).first()[0] or 0) * 1.5
    return share_report(selection(sized, leaf_budgets(sized, targets, total), "doc_id"), sized, targets)


@functools.wraps(split_documents)
def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    limits = table(spark, sf, "split_limits").first()  # one row, fixed
    name, most, overlap = (limits["tokenizer"], limits["max_tokens"], limits["overlap_tokens"]) if limits else (TOKENIZER, None, None)
    return split_documents(table(spark, sf, "documents"), "doc_id", "text", vocabulary_path(name or TOKENIZER), most, overlap)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).filter("piece_no = 1").select("doc_id")


def p10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf)


def p10_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """Where the pieces end: pieces by kind of cut, and the share of each among the cuts."""
    kinds = F.create_map(*[F.lit(x) for kv in {0: "none", 1: "sentence", 2: "line", 3: "paragraph", 4: "end of text"}.items() for x in kv])
    n = _pieces(spark, sf).groupBy("cut").agg(F.count("*").alias("n_pieces"), F.max("n_tokens").alias("most_tokens"))
    cuts = F.sum(F.when(F.col("cut") < 4, F.col("n_pieces"))).over(W.partitionBy(F.lit(1)))  # over five kinds
    return n.select(kinds[F.col("cut")].alias("boundary"), "n_pieces", "most_tokens", F.round(F.when(F.col("cut") < 4, F.col("n_pieces") / cuts), 6).alias("cut_share"))


QUERIES = {f.__name__: f for f in (p3_found, p3_records, p3_document_copies, p8_ids, p8_counts, p9_mix, p9_selection, p9_languages, p9_mix_by_repeats, p10_found, p10_pieces, p10_boundaries)}
SQL: dict[str, str] = {}
