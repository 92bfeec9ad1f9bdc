"""Reports over the study's relations: cleaning counters, wide rankings, matrices, exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankweave.functions.urls import decode_redirect
from rankweave.operators.merge import ensure_columns
from rankweave.operators.setops import is_ad_click, top_k
from rankweave.plans.base import CITATIONS, RUNS, SERP, citations, runs, serp
from rankweave.plans.overlap_queries import SQL as OVERLAP_SQL
from rankweave.plans.overlap_queries import xr_cqmiso, xr_csmso, xr_miso
from rankweave.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    f"""WITH {SERP}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id, query, key ORDER BY "position", row_id) AS rn FROM serp WHERE key <> '')
SELECT (SELECT count(*) FROM serp_export) AS input_rows, (SELECT count(*) FROM serp_export WHERE trim(coalesce(url, '')) = '') AS missing_url, count(*) FILTER (rn > 1) AS duplicate_url, count(*) FILTER (rn = 1) AS kept, count(DISTINCT (run_id, query)) AS groups FROM k"""
)
def win_clean_stats(spark: SparkSession, sf: str) -> DataFrame:
    """WIN2s: rows read, without url, repeated, and kept by the cleaning before its cut-off."""
    e = table(spark, sf, "serp_export").agg(F.count("*").alias("input_rows"), F.count_if(F.trim(F.coalesce("url", F.lit(""))) == "").alias("missing_url"))
    s = serp(spark, sf).filter((F.col("key") != "") & ~is_ad_click(F.col("url")))
    g = s.groupBy("run_id", "query", "key").agg(F.count("*").alias("n"))
    k = g.agg(F.sum(F.col("n") - 1).alias("duplicate_url"), F.count("*").alias("kept"), F.count_distinct("run_id", F.coalesce("query", F.lit(""))).alias("groups"))
    return e.crossJoin(k)  # one row each


@query(
    f"""WITH {SERP}, r AS (SELECT query, domain, row_number() OVER (PARTITION BY query ORDER BY "position", row_id) AS n FROM serp)
SELECT query, max(CASE WHEN n = 1 THEN domain END) AS rank_1, max(CASE WHEN n = 2 THEN domain END) AS rank_2, max(CASE WHEN n = 3 THEN domain END) AS rank_3 FROM r GROUP BY query"""
)
def src_wide_top3(spark: SparkSession, sf: str) -> DataFrame:
    """SRC14: one row per query with its first three domains side by side."""
    t = top_k(serp(spark, sf).select("query", "domain", "position", "row_id"), ["query"], ["position", "row_id"], 3)
    return t.groupBy("query").agg(*[F.max(F.when(F.col("rank") == k, F.col("domain"))).alias(f"rank_{k}") for k in (1, 2, 3)])


@query(
    f"""WITH {CITATIONS}, {SERP}, a AS (SELECT key, bool_or(section <> 'additional') AS main FROM citations GROUP BY 1) SELECT a.key, (a.main OR a.key IN (SELECT key FROM serp)) AS keep FROM a"""
)
def filter_additional_only(spark: SparkSession, sf: str) -> DataFrame:
    """FLT14: pages that are only offered in addition, and not among the results, are not kept."""
    a = citations(spark, sf).groupBy("key").agg(F.bool_or(F.col("section") != "additional").alias("main"))
    s = serp(spark, sf).select("key").distinct().withColumn("hit", F.lit(True))
    return a.join(s, "key", "left").select("key", (F.col("main") | F.coalesce("hit", F.lit(False))).alias("keep"))


@query(
    f"""WITH {CITATIONS}, n AS (SELECT run_id, count(*) AS c FROM citations GROUP BY 1), r AS (SELECT r.prompt_id, (coalesce(n.c, 0) > 0) AS rag FROM runs r LEFT JOIN n USING (run_id)), g AS (SELECT prompt_id, count(*) AS total_runs, count(*) FILTER (rag) AS rag_runs FROM r GROUP BY 1)
SELECT * FROM g WHERE rag_runs > 0 AND rag_runs < total_runs"""
)
def xrc_mixed_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """FLT19, XRC3: prompts some of whose runs cite sources and some do not."""
    n = citations(spark, sf).groupBy("run_id").agg(F.count("*").alias("c"))
    g = runs(spark, sf).select("run_id", "prompt_id").join(n, "run_id", "left").groupBy("prompt_id").agg(F.count("*").alias("total_runs"), F.count_if(F.col("c") > 0).alias("rag_runs"))
    return g.filter("rag_runs > 0 AND rag_runs < total_runs")


@query(
    f"""WITH {CITATIONS}, r AS (SELECT run_id, prompt_id FROM runs) SELECT r.prompt_id, r.run_id, (SELECT count(*) FROM citations c WHERE c.run_id = r.run_id) AS n_citations, (SELECT count(DISTINCT c.domain) FROM citations c WHERE c.run_id = r.run_id) AS n_domains FROM r"""
)
def jon_scalar_counts(spark: SparkSession, sf: str) -> DataFrame:
    """JON8, JON11, SRC9: counts per run, 0 where there is none."""
    n = citations(spark, sf).groupBy("run_id").agg(F.count("*").alias("n_citations"), F.count_distinct("domain").alias("n_domains"))
    return runs(spark, sf).select("run_id", "prompt_id").join(n, "run_id", "left").fillna(0, ["n_citations", "n_domains"])


@query(
    f"""WITH m AS ({OVERLAP_SQL["xr_cqmiso"]}), q AS (SELECT prompt_id, product, 'q' || row_number() OVER (PARTITION BY product ORDER BY prompt_id) AS label FROM prompts)
SELECT a.product, a.label AS label_i, b.label AS label_j, coalesce(m.cqmiso, 0.0) AS value FROM q a JOIN q b ON a.product = b.product LEFT JOIN m ON m.product = a.product AND m.prompt_i = a.prompt_id AND m.prompt_j = b.prompt_id"""
)
def xq_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    """XQ6, XR4, MTH5: the matrix of each product, labelled in prompt order, unmeasured cells 0."""
    q = table(spark, sf, "prompts").select("prompt_id", "product", F.concat(F.lit("q"), F.row_number().over(W.partitionBy("product").orderBy("prompt_id"))).alias("label"))
    a = q.select("product", F.col("prompt_id").alias("prompt_i"), F.col("label").alias("label_i"))
    b = q.select("product", F.col("prompt_id").alias("prompt_j"), F.col("label").alias("label_j"))
    cells = a.join(b, "product")  # prompts of one product: a fixed table
    return cells.join(xr_cqmiso(spark, sf), ["product", "prompt_i", "prompt_j"], "left").select("product", "label_i", "label_j", F.coalesce("cqmiso", F.lit(0.0)).alias("value"))


@query(
    """WITH s AS (SELECT row_id, trim(coalesce(url, '')) AS u FROM serp_export) SELECT count(*) AS n, count(*) FILTER (contains(lower(u), 'bing.com/ck/a')) AS n_redirects, count(*) FILTER (u = '') AS n_blank FROM s"""
)
def mrg_redirects(spark: SparkSession, sf: str) -> DataFrame:
    """MRG5: redirects decoded in place; what cannot be decoded becomes blank."""
    s = table(spark, sf, "serp_export").select("row_id", F.trim(F.coalesce("url", F.lit(""))).alias("u"), decode_redirect("url").alias("target"))
    return s.agg(F.count("*").alias("n"), F.count_if(F.contains(F.lower("u"), F.lit("bing.com/ck/a"))).alias("n_redirects"), F.count_if(F.col("target") == "").alias("n_blank"))


@query(
    """SELECT prompt_id, NULL AS notes, query FROM prompts"""
)
def mrg_columns(spark: SparkSession, sf: str) -> DataFrame:
    """MRG19: columns of a schema in order, missing ones NULL."""
    from pyspark.sql.types import StringType, StructField, StructType

    want = StructType([StructField(c, StringType()) for c in ("prompt_id", "notes", "query")])
    return ensure_columns(table(spark, sf, "prompts").select("query", "prompt_id"), want)


@query(
    f"""WITH {SERP}, f AS (SELECT run_id, query, key, title, row_id, row_number() OVER (PARTITION BY run_id ORDER BY "position", row_id) AS n FROM serp) SELECT run_id, count(*) AS n_rows, first(title ORDER BY n) AS first_title, last(key ORDER BY n) AS last_key FROM f GROUP BY run_id"""
)
def win_ends(spark: SparkSession, sf: str) -> DataFrame:
    """WIN6, SRT1: the first and the last result of each run."""
    s = serp(spark, sf)
    o = F.struct("position", "row_id")
    return s.groupBy("run_id").agg(F.count("*").alias("n_rows"), F.min_by("title", o).alias("first_title"), F.max_by("key", o).alias("last_key"))

@query(
    f"""WITH {CITATIONS}, n AS (SELECT prompt_id, count(*) AS runs FROM runs GROUP BY 1), u AS (SELECT prompt_id, key, count(DISTINCT run_id) AS k FROM citations GROUP BY 1, 2)
SELECT prompt_id, any_value(runs) AS n_runs, count(key) AS n_pages, count(*) FILTER (k >= 2) AS in_two_runs, count(*) FILTER (k = 1) AS in_one_run, count(*) FILTER (k = runs) AS in_all_runs,
 coalesce(round(count(*) FILTER (k >= 2) / nullif(count(key), 0), 9), 0.0) AS overlap_rate, coalesce(round(count(*) FILTER (k = 1) / nullif(count(key), 0), 9), 0.0) AS churn_rate FROM n LEFT JOIN u USING (prompt_id) GROUP BY 1"""
)
def xrc_shares(spark: SparkSession, sf: str) -> DataFrame:
    """XRC4: of the pages a prompt's runs cite, those of two runs or more, of one run only, and of all runs."""
    n = runs(spark, sf).groupBy("prompt_id").agg(F.count("*").alias("n_runs"))
    u = citations(spark, sf).groupBy("prompt_id", "key").agg(F.count_distinct("run_id").alias("k"))
    j = n.join(u, "prompt_id", "left").groupBy("prompt_id", "n_runs").agg(
        F.count("key").alias("n_pages"), F.count_if(F.col("k") >= 2).alias("in_two_runs"), F.count_if(F.col("k") == 1).alias("in_one_run"), F.count_if(F.col("k") == F.col("n_runs")).alias("in_all_runs"),
    )
    share = lambda c, name: F.coalesce(F.round(F.col(c) / F.nullif(F.col("n_pages"), F.lit(0)), 9), F.lit(0.0)).alias(name)
    return j.select("*", share("in_two_runs", "overlap_rate"), share("in_one_run", "churn_rate"))


@query(
    f"""WITH {RUNS}, q AS (SELECT prompt_id, run_id, unnest(regexp_extract_all(lower(generated_search_query), '[a-z0-9]+')) AS t FROM runs WHERE lower(trim(coalesce(generated_search_query, ''))) NOT IN ('', 'nan', 'n/a')),
c AS (SELECT prompt_id, run_id, t, count(*) AS n FROM q GROUP BY ALL), l AS (SELECT run_id, sqrt(sum(n * n)) AS l FROM c GROUP BY 1), d AS (SELECT DISTINCT prompt_id, run_id FROM c),
p AS (SELECT a.prompt_id, a.run_id AS x, b.run_id AS y FROM d a JOIN d b ON a.prompt_id = b.prompt_id AND a.run_id < b.run_id),
s AS (SELECT p.prompt_id, p.x, p.y, coalesce(sum(c.n * e.n), 0) / any_value(lx.l * ly.l) AS cos FROM p JOIN l lx ON lx.run_id = p.x JOIN l ly ON ly.run_id = p.y LEFT JOIN c ON c.run_id = p.x LEFT JOIN c e ON e.run_id = p.y AND e.t = c.t GROUP BY 1, 2, 3)
SELECT prompt_id, count(*) AS n_pairs, round(avg(cos), 9) AS rewrite_similarity FROM s GROUP BY 1"""
)
def xrc_rewrites(spark: SparkSession, sf: str) -> DataFrame:
    """XRC4: mean token cosine of the search queries that the runs of a prompt rewrote it to.

    The mean over all pairs of n unit vectors is (|sum|^2 - n) / (n (n - 1)), so no pair is formed.
    """
    text = F.lower(F.coalesce("generated_search_query", F.lit("")))
    q = runs(spark, sf).filter(~F.trim(text).isin("", "nan", "n/a")).select("prompt_id", "run_id", F.explode(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))).alias("t"))
    c = q.groupBy("prompt_id", "run_id", "t").agg(F.count("*").alias("n"))
    length = c.groupBy("run_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("l"))
    t = c.join(length, "run_id").groupBy("prompt_id", "t").agg(F.sum(F.col("n") / F.col("l")).alias("s"))
    n = length.join(c.select("run_id", "prompt_id").distinct(), "run_id").groupBy("prompt_id").agg(F.count("*").alias("n"))
    j = t.groupBy("prompt_id").agg(F.sum(F.col("s") * F.col("s")).alias("q")).join(n.filter("n > 1"), "prompt_id")
    pairs = F.col("n") * (F.col("n") - 1)
    return j.select("prompt_id", F.floor(pairs / 2).alias("n_pairs"), F.round((F.col("q") - F.col("n")) / pairs, 9).alias("rewrite_similarity"))


_FRAMES = ("xr_csmso", "xr_miso", "xrc_shares", "xrc_rewrites")


def jon_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """JON14: four frames of figures side by side, joined by prompt and not by the order of their rows."""
    csmso, miso = xr_csmso(spark, sf).select("prompt_id", "csmso_mean"), xr_miso(spark, sf).select("prompt_id", "miso_mean")
    shares, similar = xrc_shares(spark, sf).select("prompt_id", "overlap_rate"), xrc_rewrites(spark, sf).select("prompt_id", "rewrite_similarity")
    p = table(spark, sf, "prompts").select("prompt_id", "query", "market_type", "query_level", "product")
    for f in (csmso, miso, shares, similar):
        p = p.join(f, "prompt_id", "left")
    return p


QUERIES["jon_metrics"] = jon_metrics
SQL["jon_metrics"] = "SELECT p.prompt_id, p.query, p.market_type, p.query_level, p.product, a.csmso_mean, b.miso_mean, c.overlap_rate, d.rewrite_similarity FROM prompts p " + " ".join(
    f"LEFT JOIN ({(OVERLAP_SQL | SQL)[f]}) {x} ON {x}.prompt_id = p.prompt_id" for f, x in zip(_FRAMES, "abcd")
)
