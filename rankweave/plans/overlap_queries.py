"""Overlap, ranking and coverage queries over runs, citations and result pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankweave.functions.text import literal_list, percentage
from rankweave.functions.urls import domain4, domain11, url_key8
from rankweave.operators.overlap import BUCKETS, best_rank_match, bucket_overlap, overlap_stats, rank_biased, simpson
from rankweave.operators.setops import cleaned, first_wins, position_of, renumbered, top_k
from rankweave.plans.base import CITATIONS, DEEP, PLATFORM_SQL, PLATFORMS, RUNS, SERP, citations, deep, runs, serp, sql_domain, sql_key8, sql_literal, sql_part, sql_run
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


def _ranked(spark: SparkSession, sf: str, most: int | None = None) -> DataFrame:
    """Keys and domains of each run in rank order, of its first ``most`` results (then a run of any size gives a bounded list)."""
    rows = serp(spark, sf).select("run_id", "position", "row_id", "key", "domain")
    if most is not None:
        rows = top_k(rows, ["run_id"], ["position", "row_id"], most)
    s = rows.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("position", "row_id", "key", "domain"))).alias("r"))
    return s.select("run_id", F.col("r.key").alias("keys"), F.col("r.domain").alias("domains"))


def _cited_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Keys and domains of both sections of each run, also of empty ones."""
    c = citations(spark, sf).groupBy("run_id", "section").agg(F.array_sort(F.collect_list(F.struct("cite_position", "key", "domain"))).alias("c"))
    every = runs(spark, sf).select("run_id", F.explode(F.array(F.lit("cited"), F.lit("additional"))).alias("section"))
    none = F.array().cast("array<string>")
    return every.join(c, ["run_id", "section"], "left").select("run_id", "section", F.coalesce(F.col("c.key"), none).alias("keys"), F.coalesce(F.col("c.domain"), none).alias("domains"))


@query(
    f"""WITH {CITATIONS}, {SERP},
r AS (SELECT run_id, list(key ORDER BY "position", row_id) AS ks, list(domain ORDER BY "position", row_id) AS ds FROM serp GROUP BY run_id),
c AS (SELECT run_id, section, list(key ORDER BY cite_position) AS ks, list(domain ORDER BY cite_position) AS ds FROM citations GROUP BY run_id, section),
e AS (SELECT run_id, unnest(['cited', 'additional']) AS section FROM runs),
j AS (SELECT e.run_id, e.section, k.bucket_k, list_distinct(coalesce(c.ks, [])) AS a, list_distinct(coalesce(c.ds, [])) AS da, list_distinct(r.ks[1:k.bucket_k]) AS b, list_distinct(r.ds[1:k.bucket_k]) AS db
 FROM e JOIN r USING (run_id) LEFT JOIN c USING (run_id, section) CROSS JOIN (SELECT unnest([1, 3, 5, 10, 30]) AS bucket_k) k),
n AS (SELECT run_id, section, bucket_k, len(a) AS n_sources, len(b) AS n_serp, len(list_intersect(a, b)) AS n_overlap, len(da) AS n_domains, len(db) AS n_serp_domains, len(list_intersect(da, db)) AS n_domain_overlap FROM j)
SELECT run_id, section, bucket_k, n_sources, n_serp, n_overlap, coalesce(n_overlap / nullif(n_sources, 0), 0.0) AS frac_sources_in_serp, coalesce(n_overlap / nullif(least(n_sources, n_serp), 0), 0.0) AS overlap_coeff,
 n_domains, n_serp_domains, n_domain_overlap, coalesce(n_domain_overlap / nullif(n_domains, 0), 0.0) AS frac_domains_in_serp, coalesce(n_domain_overlap / nullif(least(n_domains, n_serp_domains), 0), 0.0) AS domain_overlap_coeff FROM n"""
)
def ovl_topk(spark: SparkSession, sf: str) -> DataFrame:
    """OVL6 (with OVL1, ARR2, STR11): overlap of cited sources with the top k results."""
    return bucket_overlap(_cited_lists(spark, sf), _ranked(spark, sf, max(BUCKETS)), BUCKETS)




_Q = "lower(trim(coalesce(generated_search_query, '')))"
_WEB = "CASE WHEN starts_with(url, 'http') THEN url ELSE 'http://' || url END"


@query(
    rf"""WITH {RUNS}, u AS (SELECT run_id, generated_search_query AS query, {_Q} AS q, {sql_literal("coalesce(sources_cited, '')")} AS us FROM runs WHERE {_Q} NOT IN ('', 'nan', 'n/a')),
c AS (SELECT run_id, query, q, {sql_key8("url")} AS key, lower(regexp_replace({sql_part(_WEB, 1)}, '^www\.', '')) AS domain FROM (SELECT run_id, query, q, unnest(us) AS url FROM u)),
s AS (SELECT lower(trim(query)) AS q, {sql_key8("url")} AS key, replace(coalesce(domain, ''), 'www.', '') AS domain, coalesce(CASE WHEN regexp_matches(trim("position"), '^[+-]?\d+$') THEN try_cast(trim("position") AS INTEGER) END, 1000000000) AS p FROM serp_export),
k AS (SELECT q, key, min(p) AS kp FROM s GROUP BY 1, 2), d AS (SELECT q, domain, min(p) AS dp FROM s GROUP BY 1, 2),
m AS (SELECT c.run_id, c.query, CASE WHEN kp IS NOT NULL THEN 'exact' WHEN dp IS NOT NULL THEN 'domain' ELSE 'none' END AS match, coalesce(kp, dp) AS r FROM c LEFT JOIN k USING (q, key) LEFT JOIN d USING (q, domain) WHERE c.q IN (SELECT q FROM s WHERE q IS NOT NULL))
SELECT run_id, query, count(*) AS total_citations, count(*) FILTER (match = 'exact') AS exact_matches, count(*) FILTER (match = 'domain') AS domain_matches, round(100.0 * count(*) FILTER (match = 'exact') / count(*), 6) AS exact_match_pct, round(100.0 * count(*) FILTER (match <> 'none') / count(*), 6) AS domain_match_pct,
 coalesce(round(avg(r), 6), 0.0) AS avg_rank, {", ".join(f"round(100.0 * count(*) FILTER (r <= {k}) / count(*), 6) AS top{k}_match_pct" for k in (1, 3, 5, 10))} FROM m GROUP BY 1, 2"""
)
def ovl_run_match(spark: SparkSession, sf: str) -> DataFrame:
    """OVL7 (URL8, DOM4, DOM11, ARR1, STR10, MTH3): exact, else domain match of each citation, ranks and shares per run.

    Duplicated citations count; a run whose query has no results is left out.
    """
    q = F.lower(F.trim(F.coalesce("generated_search_query", F.lit(""))))
    r = runs(spark, sf).filter(~q.isin("", "nan", "n/a")).select("run_id", F.col("generated_search_query").alias("query"), q.alias("q"), F.posexplode(literal_list("sources_cited")).alias("cite_id", "url"))
    cited = r.select("run_id", "query", "q", "cite_id", url_key8("url").alias("key"), domain4("url").alias("domain"))
    s = table(spark, sf, "serp_export").select(F.lower(F.trim("query")).alias("q"), url_key8("url").alias("key"), domain11("domain").alias("domain"), position_of("position").alias("position"))
    m = best_rank_match(cited, s, ["q"])
    n = F.count("*")
    share = lambda c: F.round(percentage(F.count_if(c), n), 6)
    return m.groupBy("run_id", "query").agg(
        n.alias("total_citations"), F.count_if(F.col("match") == "exact").alias("exact_matches"), F.count_if(F.col("match") == "domain").alias("domain_matches"), share(F.col("match") == "exact").alias("exact_match_pct"), share(F.col("match") != "none").alias("domain_match_pct"),
        F.coalesce(F.round(F.avg("best_rank"), 6), F.lit(0.0)).alias("avg_rank"), *[share(F.col("best_rank") <= k).alias(f"top{k}_match_pct") for k in (1, 3, 5, 10)],
    )


@query(
    rf"""WITH {CITATIONS}, q AS (SELECT run_id, {_Q} AS q FROM runs WHERE {_Q} NOT IN ('', 'nan', 'n/a')),
s AS (SELECT lower(trim(query)) AS q, {sql_domain("url")} AS domain, coalesce(CASE WHEN regexp_matches(trim("position"), '^[+-]?\d+$') THEN try_cast(trim("position") AS INTEGER) END, 1000000000) AS p, row_id FROM serp_export WHERE trim(coalesce(url, '')) <> '' AND query IS NOT NULL),
best AS (SELECT q, domain, arg_min(p, row_id) AS p FROM s GROUP BY 1, 2)
SELECT c.run_id, c.domain, count(*) AS n_citations, coalesce(any_value(b.p)::VARCHAR, 'Not in Top 10') AS first_rank FROM citations c JOIN q USING (run_id) LEFT JOIN best b USING (q, domain) WHERE c.section = 'cited' AND q.q IN (SELECT q FROM s) GROUP BY 1, 2"""
)
def ovl_domain_rank(spark: SparkSession, sf: str) -> DataFrame:
    """OVL8: of each domain a run cites, the rank of the first result (in file order) that its query has from it; runs whose query has no results are left out."""
    q = F.lower(F.trim(F.coalesce("generated_search_query", F.lit(""))))
    asked = runs(spark, sf).filter(~q.isin("", "nan", "n/a")).select("run_id", q.alias("q"))
    s = serp(spark, sf).filter("query IS NOT NULL").withColumn("q", F.lower(F.trim("query")))
    best = s.groupBy("q", "domain").agg(F.min_by("position", "row_id").alias("p"))
    c = citations(spark, sf).filter("section = 'cited'").groupBy("run_id", "domain").agg(F.count("*").alias("n_citations")).join(asked, "run_id").join(s.select("q"), "q", "left_semi")
    return c.join(best, ["q", "domain"], "left").select("run_id", "domain", "n_citations", F.coalesce(F.col("p").cast("string"), F.lit("Not in Top 10")).alias("first_rank"))


def _key_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Cited keys of each run, in order, distinct."""
    return _cited_lists(spark, sf).filter("section = 'cited'").select("run_id", F.regexp_extract("run_id", r"^(.*)_r\d+$", 1).alias("prompt_id"), F.array_distinct("keys").alias("keys"))


_SETS = f"""{CITATIONS}, sets AS (SELECT r.run_id, r.prompt_id, coalesce(c.ks, []) AS ks FROM runs r LEFT JOIN (SELECT run_id, list_distinct(list(key)) AS ks FROM citations WHERE section = 'cited' GROUP BY run_id) c USING (run_id))"""
_SIMPSON = "CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / least(len({a}), len({b})) END"


@query(
    f"""WITH {_SETS}, p AS (SELECT a.prompt_id, {_SIMPSON.format(a="a.ks", b="b.ks")} AS v FROM sets a JOIN sets b ON a.prompt_id = b.prompt_id AND a.run_id < b.run_id)
SELECT prompt_id, count(*) AS n_pairs, round(avg(v), 9) AS miso_mean, round(var_pop(v), 9) AS miso_var, round(stddev_pop(v), 9) AS miso_std FROM p GROUP BY prompt_id"""
)
def xr_miso(spark: SparkSession, sf: str) -> DataFrame:
    """XR2 (OVL2): agreement of the runs of a prompt on their cited sources."""
    s = _key_sets(spark, sf)
    o = s.select(F.col("run_id").alias("_r"), "prompt_id", F.col("keys").alias("_k"))
    p = s.join(o, "prompt_id").filter(F.col("run_id") < F.col("_r")).withColumn("v", simpson(F.col("keys"), F.col("_k")))
    return p.groupBy("prompt_id").agg(F.count("*").alias("n_pairs"), F.round(F.avg("v"), 9).alias("miso_mean"), F.round(F.var_pop("v"), 9).alias("miso_var"), F.round(F.stddev_pop("v"), 9).alias("miso_std"))


@query(
    f"""WITH {_SETS}, s AS (SELECT s.*, p.product AS grp FROM sets s JOIN prompts p USING (prompt_id)),
p AS (SELECT a.grp, a.prompt_id AS prompt_i, b.prompt_id AS prompt_j, avg({_SIMPSON.format(a="a.ks", b="b.ks")}) AS v FROM s a JOIN s b ON a.grp = b.grp AND a.prompt_id <= b.prompt_id GROUP BY 1, 2, 3)
SELECT grp AS product, prompt_i, prompt_j, round(v, 9) AS cqmiso FROM p UNION ALL SELECT grp, prompt_j, prompt_i, round(v, 9) FROM p WHERE prompt_i <> prompt_j"""
)
def xr_cqmiso(spark: SparkSession, sf: str) -> DataFrame:
    """XR4: mean agreement of the runs of two prompts of one product; the upper triangle is computed and mirrored."""
    s = _key_sets(spark, sf).join(table(spark, sf, "prompts").select("prompt_id", "product"), "prompt_id")
    o = s.select("product", F.col("prompt_id").alias("prompt_j"), F.col("keys").alias("_k"))
    p = s.withColumnRenamed("prompt_id", "prompt_i").join(o, "product").filter("prompt_i <= prompt_j").groupBy("product", "prompt_i", "prompt_j").agg(F.round(F.avg(simpson(F.col("keys"), F.col("_k"))), 9).alias("cqmiso"))
    return p.unionByName(p.filter("prompt_i <> prompt_j").select("product", F.col("prompt_j").alias("prompt_i"), F.col("prompt_i").alias("prompt_j"), "cqmiso"))


_PROMPT_SERP = f"""{SERP}, per AS (SELECT regexp_extract(run_id, '^(.*)_r\\d+$', 1) AS prompt_id, list_distinct(list(key)) AS ks FROM serp GROUP BY 1), ps AS (SELECT per.*, p.product AS grp FROM per JOIN prompts p USING (prompt_id))"""


@query(
    f"""WITH {_PROMPT_SERP}
SELECT a.grp AS product, a.prompt_id AS prompt_i, b.prompt_id AS prompt_j, round({_SIMPSON.format(a="a.ks", b="b.ks")}, 9) AS overlap FROM ps a JOIN ps b ON a.grp = b.grp AND a.prompt_id <= b.prompt_id"""
)
def xr_serp_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """XR6: agreement of the result lists of two prompts of one product."""
    s = serp(spark, sf).groupBy(F.regexp_extract("run_id", r"^(.*)_r\d+$", 1).alias("prompt_id")).agg(F.collect_set("key").alias("ks")).join(table(spark, sf, "prompts").select("prompt_id", "product"), "prompt_id")
    o = s.select("product", F.col("prompt_id").alias("prompt_j"), F.col("ks").alias("_k"))
    return s.withColumnRenamed("prompt_id", "prompt_i").join(o, "product").filter("prompt_i <= prompt_j").select("product", "prompt_i", "prompt_j", F.round(simpson(F.col("ks"), F.col("_k")), 9).alias("overlap"))


@query(
    f"""WITH {_SETS}, {SERP}, r AS (SELECT run_id, list_distinct(list(key)) AS b FROM serp GROUP BY run_id), v AS (SELECT s.prompt_id, {_SIMPSON.format(a="s.ks", b="r.b")} AS v FROM sets s JOIN r USING (run_id))
SELECT prompt_id, count(*) AS n_runs, round(avg(v), 9) AS csmso_mean, round(stddev_pop(v), 9) AS csmso_std FROM v GROUP BY prompt_id"""
)
def xr_csmso(spark: SparkSession, sf: str) -> DataFrame:
    """XR9: agreement of a run's cited sources with its result list."""
    r = serp(spark, sf).groupBy("run_id").agg(F.collect_set("key").alias("b"))
    v = _key_sets(spark, sf).join(r, "run_id").withColumn("v", simpson(F.col("keys"), F.col("b")))
    return v.groupBy("prompt_id").agg(F.count("*").alias("n_runs"), F.round(F.avg("v"), 9).alias("csmso_mean"), F.round(F.stddev_pop("v"), 9).alias("csmso_std"))


@query(
    f"""WITH {CITATIONS}, {SERP}, c AS (SELECT run_id, list(key ORDER BY p) AS a FROM (SELECT run_id, key, min(cite_position) AS p FROM citations WHERE section = 'cited' GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT run_id, key, row_number() OVER (PARTITION BY run_id ORDER BY "position", row_id) AS p FROM serp), b AS (SELECT run_id, list(key ORDER BY p) AS b FROM (SELECT run_id, key, min(p) AS p FROM f GROUP BY 1, 2) GROUP BY 1),
j AS (SELECT run_id, len(a) AS n, len(b) AS m, least(len(a), len(b)) AS s, greatest(len(a), len(b)) AS l, list_transform(list_intersect(a, b), lambda e: greatest(list_position(a, e), list_position(b, e))) AS shared FROM c JOIN b USING (run_id)),
g AS (SELECT *, list_transform(range(1, l + 1), lambda d: 2.0::DOUBLE * len(list_filter(shared, lambda x: x <= d)) / (least(d, n) + least(d, m))) AS g FROM j)
SELECT run_id, round(0.1::DOUBLE / 0.9 * list_sum(list_transform(range(1, l + 1), lambda d: pow(0.9::DOUBLE, d) * (g[d] + CASE WHEN d > s THEN g[s] * s * (d - s) / (s * d) ELSE 0 END))) + pow(0.9::DOUBLE, l) * ((g[l] * s - g[s] * s) / l + g[s]), 9) AS rbo FROM g"""
)
def ovl_rank_biased(spark: SparkSession, sf: str) -> DataFrame:
    """OVL4: rank-biased overlap of a run's cited keys and its results."""
    c = _cited_lists(spark, sf).filter("section = 'cited' AND size(keys) > 0").select("run_id", F.array_distinct("keys").alias("a"))
    r = _ranked(spark, sf).select("run_id", F.array_distinct("keys").alias("b"))
    return c.join(r, "run_id").select("run_id", F.round(rank_biased(F.col("a"), F.col("b")), 9).alias("rbo"))


_RAG = f"""{CITATIONS}, n AS (SELECT run_id, count(DISTINCT key) AS cc FROM citations GROUP BY run_id),
r AS (SELECT r.prompt_id, r.run_id, (coalesce(n.cc, 0) > 0 OR coalesce(lower(trim(r.generated_search_query)) NOT IN ('', 'n/a', 'nan'), false)) AS rag FROM runs r LEFT JOIN n USING (run_id))"""


@query(
    f"""WITH {_RAG}, u AS (SELECT prompt_id, key, count(*) AS n_rows, count(DISTINCT run_id) AS n_runs FROM citations GROUP BY 1, 2),
s AS (SELECT prompt_id, count(*) AS unique_citations, count(*) FILTER (n_rows >= 3) AS stable_3plus, count(*) FILTER (n_rows = 1) AS one_off, count(*) FILTER (n_runs >= 2) AS in_two_runs, max(n_runs) AS most_runs FROM u GROUP BY 1)
SELECT r.prompt_id, count(*) AS total_runs, count(*) FILTER (rag) AS rag_runs, round((count(*) - count(*) FILTER (rag)) / count(*), 9) AS rag_failure_rate, coalesce(any_value(unique_citations), 0) AS unique_citations, coalesce(any_value(stable_3plus), 0) AS stable_3plus,
 coalesce(any_value(one_off), 0) AS one_off, coalesce(any_value(in_two_runs), 0) AS in_two_runs, coalesce(any_value(most_runs), 0) AS most_runs, coalesce(round(100.0 * any_value(stable_3plus) / any_value(unique_citations), 9), 0.0) AS stability_pct
FROM r LEFT JOIN s USING (prompt_id) GROUP BY r.prompt_id"""
)
def xrc_stability(spark: SparkSession, sf: str) -> DataFrame:
    """XRC1 to XRC3 (JON1, FLT19): stability of a prompt's citations over its runs, by rows and by runs."""
    c = citations(spark, sf)
    n = c.groupBy("run_id").agg(F.count_distinct("key").alias("cc"))
    q = F.lower(F.trim("generated_search_query"))
    r = runs(spark, sf).join(n, "run_id", "left").select("prompt_id", ((F.coalesce("cc", F.lit(0)) > 0) | F.coalesce(~q.isin("", "n/a", "nan"), F.lit(False))).alias("rag"))
    r = r.groupBy("prompt_id").agg(F.count("*").alias("total_runs"), F.count_if("rag").alias("rag_runs"))
    u = c.groupBy("prompt_id", "key").agg(F.count("*").alias("n_rows"), F.count_distinct("run_id").alias("n_runs"))
    s = u.groupBy("prompt_id").agg(F.count("*").alias("unique_citations"), F.count_if(F.col("n_rows") >= 3).alias("stable_3plus"), F.count_if(F.col("n_rows") == 1).alias("one_off"), F.count_if(F.col("n_runs") >= 2).alias("in_two_runs"), F.max("n_runs").alias("most_runs"))
    j = r.join(s, "prompt_id", "left").fillna(0, ["unique_citations", "stable_3plus", "one_off", "in_two_runs", "most_runs"])
    rate = F.round((F.col("total_runs") - F.col("rag_runs")) / F.col("total_runs"), 9).alias("rag_failure_rate")
    return j.select("prompt_id", "total_runs", "rag_runs", rate, "unique_citations", "stable_3plus", "one_off", "in_two_runs", "most_runs", F.round(percentage("stable_3plus", "unique_citations"), 9).alias("stability_pct"))


@query(
    f"""WITH {CITATIONS}, {SERP}, j AS (SELECT s."position" AS rank FROM citations c JOIN serp s USING (run_id, key)), n AS (SELECT count(*) AS n FROM citations)
SELECT g.rank, count(j.rank) AS n_matches, round(100.0 * count(j.rank) / any_value(n.n), 9) AS share_pct FROM (SELECT unnest(range(1, 31)) AS rank) g LEFT JOIN j ON j.rank = g.rank CROSS JOIN n GROUP BY g.rank"""
)
def cnt_rank_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """CNT1 (JON2): citations by rank of their page; a page listed twice counts twice, all citations are the base."""
    c = citations(spark, sf)
    j = c.join(serp(spark, sf).select("run_id", "key", F.col("position").alias("rank")), ["run_id", "key"]).filter("rank BETWEEN 1 AND 30").groupBy("rank").agg(F.count("*").alias("n_matches"))
    grid = spark.range(1, 31).select(F.col("id").alias("rank"))
    total = c.agg(F.count("*").alias("n"))
    return grid.join(j, "rank", "left").crossJoin(F.broadcast(total)).select("rank", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.round(percentage(F.coalesce("n_matches", F.lit(0)), "n"), 9).alias("share_pct"))  # one row of totals, thirty of ranks


@query(
    f"""WITH {CITATIONS}, {DEEP}, d AS (SELECT run_id, key, min(page_num) AS p FROM deep GROUP BY 1, 2)
SELECT coalesce(d.p, 0) AS page_num, count(*) AS n_citations FROM citations c LEFT JOIN d USING (run_id, key) GROUP BY 1"""
)
def cnt_page_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """CNT2 (MTH4): citations by the first later page that lists them; 0 for none."""
    d = deep(spark, sf).groupBy("run_id", "key").agg(F.min("page_num").alias("p"))
    return citations(spark, sf).join(d, ["run_id", "key"], "left").groupBy(F.coalesce("p", F.lit(0)).alias("page_num")).agg(F.count("*").alias("n_citations"))


@query(
    f"""WITH {CITATIONS}, {SERP}, s AS (SELECT run_id, count(*) FILTER ("position" <= 10) AS page1 FROM serp GROUP BY 1), j AS (SELECT c.run_id, s."position" AS p FROM citations c LEFT JOIN serp s USING (run_id, key)),
m AS (SELECT run_id, count(*) AS total, count(*) FILTER (p <= 10) AS hits FROM j GROUP BY 1)
SELECT s.page1, CASE WHEN s.page1 <= 4 THEN 'low' ELSE 'high' END AS density, count(*) AS n_runs, round(avg(hits / total), 9) AS mean_share FROM s JOIN m USING (run_id) GROUP BY 1, 2"""
)
def cnt_density(spark: SparkSession, sf: str) -> DataFrame:
    """CNT3 (JON4): share of citations in the top ten by the number of results on the first page (counted after the fan-out)."""
    s = serp(spark, sf)
    page = s.groupBy("run_id").agg(F.count_if(F.col("position") <= 10).alias("page1"))
    j = citations(spark, sf).join(s.select("run_id", "key", F.col("position").alias("p")), ["run_id", "key"], "left").groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(F.col("p") <= 10).alias("hits"))
    return page.join(j, "run_id").groupBy("page1").agg(F.count("*").alias("n_runs"), F.round(F.avg(F.col("hits") / F.col("total")), 9).alias("mean_share")).withColumn("density", F.when(F.col("page1") <= 4, "low").otherwise("high"))


@query(
    f"""WITH {CITATIONS}, {SERP}, c AS (SELECT 'cited' AS side, domain, count(*) AS n FROM citations GROUP BY 2 UNION ALL SELECT 'top3', domain, count(*) FROM serp WHERE "position" <= 3 GROUP BY 2)
SELECT side, rank, domain, n FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY n DESC, domain) AS rank FROM c) WHERE rank <= 10"""
)
def cnt_top_domains(spark: SparkSession, sf: str) -> DataFrame:
    """CNT4 (FLT12, SRT3): the ten most frequent domains of both sides, ties by name."""
    both = citations(spark, sf).select(F.lit("cited").alias("side"), "domain").unionByName(serp(spark, sf).filter("position <= 3").select(F.lit("top3").alias("side"), "domain"))
    n = both.groupBy("side", "domain").agg(F.count("*").alias("n"))
    return top_k(n, ["side"], [F.col("n").desc(), F.col("domain")], 10)


@query(
    f"""WITH {RUNS}, r AS (SELECT prompt_id, len({sql_literal("coalesce(sources_cited, '')")}) AS a, len({sql_literal("coalesce(sources_additional, '')")}) AS b, len({sql_literal("coalesce(domains_all, '')")}) AS d FROM runs)
SELECT query_level, count(*) AS n_runs, round(avg(a), 2) AS mean_cited, round(avg(b), 2) AS mean_additional, round(avg(d), 2) AS mean_domains FROM r JOIN prompts USING (prompt_id) GROUP BY 1"""
)
def cnt_list_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """CNT6 (ARR5): mean list lengths by level of the prompt."""
    r = runs(spark, sf).select("prompt_id", F.size(literal_list("sources_cited")).alias("a"), F.size(literal_list("sources_additional")).alias("b"), F.size(literal_list("domains_all")).alias("d")).join(table(spark, sf, "prompts").select("prompt_id", "query_level"), "prompt_id")
    return r.groupBy("query_level").agg(F.count("*").alias("n_runs"), *[F.round(F.avg(c), 2).alias(n) for c, n in (("a", "mean_cited"), ("b", "mean_additional"), ("d", "mean_domains"))])


@query(
    f"""WITH {CITATIONS}, {SERP}, b AS (SELECT run_id, key, min("position") AS r FROM serp GROUP BY 1, 2), k AS (SELECT unnest([1, 3, 5, 10, 30]) AS k),
m AS (SELECT k, 100.0 * count(*) FILTER (b.r <= k) / count(*) AS cum FROM citations c LEFT JOIN b USING (run_id, key) CROSS JOIN k GROUP BY k)
SELECT k, round(cum, 6) AS cumulative_pct, round(cum - coalesce(lag(cum) OVER (ORDER BY k), 0), 6) AS marginal_pct FROM m"""
)
def cnt_marginal(spark: SparkSession, sf: str) -> DataFrame:
    """CNT7 (WIN10, WIN12): cumulative and marginal share of citations by bucket of their best rank."""
    b = serp(spark, sf).groupBy("run_id", "key").agg(F.min("position").alias("r"))
    j = citations(spark, sf).join(b, ["run_id", "key"], "left").agg(F.count("*").alias("n"), *[F.count_if(F.col("r") <= k).alias(f"k{k}") for k in BUCKETS])
    cum = j.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("hits")) for k in BUCKETS])).alias("b")).select(F.col("b.k"), percentage("b.hits", "n").alias("cum"))
    before = F.coalesce(F.lag("cum").over(W.orderBy("k")), F.lit(0.0))  # five rows
    return cum.select("k", F.round("cum", 6).alias("cumulative_pct"), F.round(F.col("cum") - before, 6).alias("marginal_pct"))


_COVER = f"""{CITATIONS}, {SERP}, {DEEP},
c AS (SELECT *, EXISTS (SELECT 1 FROM serp b WHERE b.run_id = c.run_id AND b.key = c.key) AS su, EXISTS (SELECT 1 FROM deep d WHERE d.run_id = c.run_id AND d.key = c.key) AS du,
 (domain NOT IN ({PLATFORM_SQL}) AND EXISTS (SELECT 1 FROM serp b WHERE b.run_id = c.run_id AND b.domain = c.domain)) AS sd, (domain NOT IN ({PLATFORM_SQL}) AND EXISTS (SELECT 1 FROM deep d WHERE d.run_id = c.run_id AND d.domain = c.domain)) AS dd FROM citations c)"""


def _covered(spark: SparkSession, sf: str) -> DataFrame:
    """Citations with what lists them: results or later pages, by key or by domain (platforms by key only)."""
    c = citations(spark, sf)
    s, d = serp(spark, sf), deep(spark, sf)
    for other, by, name in ((s, "key", "su"), (d, "key", "du"), (s, "domain", "sd"), (d, "domain", "dd")):
        c = c.join(other.select("run_id", by, F.lit(True).alias(name)).distinct(), ["run_id", by], "left").fillna(False, [name])
    for name in ("sd", "dd"):
        c = c.withColumn(name, F.col(name) & ~F.col("domain").isin(*PLATFORMS))
    return c


@query(
    f"""WITH {_COVER} SELECT section, count(*) AS total, count(*) FILTER (su OR du) AS strict_matches, count(*) FILTER (su OR du OR sd OR dd) AS domain_matches, count(*) FILTER (su OR sd) AS results_only, count(*) FILTER (du OR dd) AS deep_only FROM c GROUP BY section"""
)
def cnt_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """CNT8, CNT9 (JON6, JON7, FLT9): citations found strictly or by domain, per section."""
    u, d = F.col("su") | F.col("du"), F.col("sd") | F.col("dd")
    return _covered(spark, sf).groupBy("section").agg(F.count("*").alias("total"), F.count_if(u).alias("strict_matches"), F.count_if(u | d).alias("domain_matches"), F.count_if(F.col("su") | F.col("sd")).alias("results_only"), F.count_if(F.col("du") | F.col("dd")).alias("deep_only"))


@query(f"""WITH {_COVER} SELECT domain, count(*) AS n FROM c WHERE NOT (du OR dd) GROUP BY domain ORDER BY n DESC, domain LIMIT 100""")
def cnt_invisible_domains(spark: SparkSession, sf: str) -> DataFrame:
    """CNT10 (SRT1, SRT2): the hundred domains most cited and never on a later page."""
    return _covered(spark, sf).filter(~(F.col("du") | F.col("dd"))).groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(100)


@query(
    f"""WITH {CITATIONS}, {DEEP}, c AS (SELECT *, row_number() OVER (ORDER BY run_id, section, cite_position) AS cid FROM citations)
SELECT d.page_num, count(DISTINCT c.cid) AS n_matches FROM deep d JOIN c ON d.run_id = c.run_id AND (d.key = c.key OR d.domain = c.domain) GROUP BY 1"""
)
def cnt_page_matches(spark: SparkSession, sf: str) -> DataFrame:
    """CNT11 (JON5): citations matched on each later page by key or domain.

    The OR is split in two equi-joins over distinct keys, so no run fans out to all its pairs.
    """
    c = citations(spark, sf).select("run_id", "section", "cite_position", "key", "domain")
    d = deep(spark, sf)
    hit = lambda by: c.join(d.select("run_id", by, "page_num").distinct(), ["run_id", by]).select("page_num", "run_id", "section", "cite_position")
    return hit("key").union(hit("domain")).distinct().groupBy("page_num").agg(F.count("*").alias("n_matches"))


@query(
    f"""WITH {CITATIONS}, {SERP}, b AS (SELECT run_id, key, min("position") AS r FROM serp GROUP BY 1, 2)
SELECT section, CASE WHEN r IS NULL OR r > 30 THEN 'not in 30' WHEN r = 1 THEN '1' WHEN r <= 3 THEN '2-3' WHEN r <= 5 THEN '4-5' WHEN r <= 10 THEN '6-10' ELSE '11-30' END AS bucket, count(*) AS n_citations, count(DISTINCT (run_id, key)) AS n_unique FROM citations LEFT JOIN b USING (run_id, key) GROUP BY 1, 2"""
)
def cnt_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """CNT12: citations and distinct citations by bucket of their best rank."""
    b = serp(spark, sf).groupBy("run_id", "key").agg(F.min("position").alias("r"))
    r = F.col("r")
    bucket = F.when(r.isNull() | (r > 30), "not in 30").when(r == 1, "1").when(r <= 3, "2-3").when(r <= 5, "4-5").when(r <= 10, "6-10").otherwise("11-30")
    return citations(spark, sf).join(b, ["run_id", "key"], "left").groupBy("section", bucket.alias("bucket")).agg(F.count("*").alias("n_citations"), F.count_distinct("run_id", "key").alias("n_unique"))


@query(
    f"""WITH {SERP}, {DEEP}, c AS (SELECT run_id, key, "position" AS rank, 1 AS page_num, domain, url FROM serp UNION ALL SELECT run_id, key, "position" + 10 * (page_num - 1), page_num, domain, url FROM deep),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY rank, page_num, url) AS rn FROM c) SELECT run_id, key, rank, page_num, rank > 30 AS is_deep FROM r WHERE rn = 1"""
)
def win_combined(spark: SparkSession, sf: str) -> DataFrame:
    """WIN1: results and later pages in one ranking, the best rank of each page."""
    s = serp(spark, sf).select("run_id", "key", F.col("position").alias("rank"), F.lit(1).alias("page_num"), "url")
    d = deep(spark, sf).select("run_id", "key", (F.col("position") + 10 * (F.col("page_num") - 1)).alias("rank"), "page_num", "url")
    return first_wins(s.unionByName(d), ["run_id", "key"], ["rank", "page_num", "url"]).select("run_id", "key", "rank", "page_num", (F.col("rank") > 30).alias("is_deep"))


@query(
    f"""WITH {SERP}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id, query, key ORDER BY "position", row_id) AS rn FROM serp WHERE key <> '' AND NOT regexp_matches(domain, '(^|\\.)bing\\.com$')),
p AS (SELECT *, row_number() OVER (PARTITION BY run_id, query ORDER BY "position", row_id) AS clean_position FROM k WHERE rn = 1) SELECT run_id, query, row_id, clean_position, key FROM p WHERE clean_position <= 30"""
)
def win_clean(spark: SparkSession, sf: str) -> DataFrame:
    """WIN2 (URL1, URL12, FLT2, FLT21): cleaned results per run and query, renumbered, at most thirty."""
    s = serp(spark, sf).select("run_id", "query", "row_id", "url", "position")
    return cleaned(s, 30).select("run_id", "query", "row_id", "clean_position", F.col("clean_key").alias("key"))


@query(
    f"""WITH {DEEP}, d AS (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY page_num, "position", url) AS rn FROM deep)
SELECT run_id, key, page_num, "position", row_number() OVER (PARTITION BY run_id ORDER BY page_num, "position", key) AS absolute_rank FROM d WHERE rn = 1"""
)
def win_resequenced(spark: SparkSession, sf: str) -> DataFrame:
    """WIN4, WIN5: ranks that start again on each page become one sequence per run."""
    d = first_wins(deep(spark, sf), ["run_id", "key"], ["page_num", "position", "url"])
    return renumbered(d, ["run_id"], ["page_num", "position", "key"], "absolute_rank").select("run_id", "key", "page_num", "position", "absolute_rank")


@query(
    f"""WITH s AS (SELECT {sql_run("run_id")} AS run_id, query, url, row_id, row_number() OVER (PARTITION BY query, url ORDER BY row_id) AS rn FROM serp_export WHERE trim(coalesce(url, '')) <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY row_id) AS n FROM s WHERE rn = 1) SELECT query, n, row_id FROM k WHERE n <= 30"""
)
def win_audit(spark: SparkSession, sf: str) -> DataFrame:
    """WIN3, WIN9: first-seen raw urls of a query in file order, thirty at most."""
    s = table(spark, sf, "serp_export").filter(F.trim(F.coalesce("url", F.lit(""))) != "").select("query", "url", "row_id")
    return renumbered(first_wins(s, ["query", "url"], ["row_id"]), ["query"], ["row_id"], "n", 30).select("query", "n", "row_id")


@query(
    f"""WITH {SERP} SELECT key, first(url ORDER BY length(url), row_id) AS url, count(*) AS n_rows, min(row_id) AS first_row FROM serp GROUP BY key"""
)
def win_shortest(spark: SparkSession, sf: str) -> DataFrame:
    """WIN6 to WIN8: of each page the shortest url as written, and its first row."""
    return serp(spark, sf).groupBy("key").agg(F.min_by("url", F.struct(F.length("url"), F.col("row_id"))).alias("url"), F.count("*").alias("n_rows"), F.min("row_id").alias("first_row"))


@query(
    f"""WITH {SERP} SELECT query, list(domain ORDER BY "position", row_id)[1:3] AS top_domains FROM serp GROUP BY query"""
)
def win_top_domains(spark: SparkSession, sf: str) -> DataFrame:
    """WIN11: domains of the first three results of a query."""
    s = top_k(serp(spark, sf).select("query", "domain", "position", "row_id"), ["query"], ["position", "row_id"], 3)
    return s.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "domain"))).alias("d")).select("query", F.col("d.domain").alias("top_domains"))


@query(
    f"""WITH {CITATIONS} SELECT a.section AS section_a, b.section AS section_b, count(*) AS n_pairs FROM (SELECT DISTINCT run_id, section, key FROM citations) a JOIN (SELECT DISTINCT run_id, section, key FROM citations) b USING (run_id, key) WHERE a.section <= b.section GROUP BY 1, 2"""
)
def jon_section_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """JON12, JON13, ARR4: pages shared by the two panels of a run."""
    a = citations(spark, sf).select("run_id", "section", "key").distinct()
    b = a.withColumnRenamed("section", "section_b")
    return a.withColumnRenamed("section", "section_a").join(b, ["run_id", "key"]).filter("section_a <= section_b").groupBy("section_a", "section_b").agg(F.count("*").alias("n_pairs"))


def _stats_frame(spark: SparkSession, sf: str) -> DataFrame:
    c = _cited_lists(spark, sf).filter("section = 'cited'").join(_ranked(spark, sf).select("run_id", F.col("keys").alias("_k")), "run_id")
    return c.select("run_id", overlap_stats(F.col("keys"), F.col("_k")).alias("s")).select("run_id", "s.*")


@query(
    f"""WITH {_SETS}, {SERP}, r AS (SELECT run_id, list_distinct(list(key)) AS b FROM serp GROUP BY run_id)
SELECT run_id, len(ks) AS n_a, len(b) AS n_b, len(list_intersect(ks, b)) AS n_both, coalesce(len(list_intersect(ks, b)) / nullif(len(ks), 0), 0.0) AS frac_in_a, coalesce(len(list_intersect(ks, b)) / nullif(least(len(ks), len(b)), 0), 0.0) AS overlap_coeff FROM sets JOIN r USING (run_id)"""
)
def ovl_stats(spark: SparkSession, sf: str) -> DataFrame:
    """OVL1: sizes and shares of a run's cited set and its whole result list."""
    return _stats_frame(spark, sf)
