"""Queries of the maintenance, label, page-structure, statistics and semantic operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.text import canonical_run_id, word_count
from rankweave.functions.urls import domain1, domain10, url_key2
from rankweave.operators import html as H
from rankweave.operators import merge as M
from rankweave.operators.flatten import inline_citations, panel_citations
from rankweave.operators.labels import best_text, latest_labels
from rankweave.operators.overlap import named_matches
from rankweave.operators.saved_pages import html_items, result_rows, source_rows
from rankweave.operators.semantic import VECTORS, blocked, cross_overlap, overlap_udf, pair_overlap, system_overlap, top_semantic
from rankweave.operators.setops import first_wins, latest_wins, top_k
from rankweave.operators.stats import average_ranks, formatted_p, kruskal_wallis, mann_whitney_pairs
from rankweave.operators.validate import checks, missing_reason
from rankweave.plans.base import CITATIONS, DEEP, SERP, citations, deep, runs, serp, sql_domain, sql_key, sql_run
from rankweave.session import table
from rankweave.streaming.sse import paced

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_NB = lambda c: f"CASE WHEN trim({c}) <> '' THEN {c} END"
PAGE = ["title", "page_title", "meta_description"]
_PAGES = f"""p AS (SELECT {sql_key("url")} AS key, row_id, title, page_title, meta_description FROM serp_export WHERE trim(coalesce(url, '')) <> ''),
f AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY row_id) AS rn FROM p) WHERE rn = 1), l AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY row_id DESC) AS rn FROM p) WHERE rn = 1)"""


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "serp_export").filter(F.trim(F.coalesce("url", F.lit(""))) != "")
    return s.select(url_key2("url").alias("key"), "row_id", *PAGE)


@query(f"""WITH {_PAGES} SELECT key, {", ".join(f"coalesce({_NB('l.' + c)}, f.{c}) AS {c}" for c in PAGE)} FROM f FULL JOIN l USING (key)""")
def mrg_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """MRG1, MRG3: the first capture of each page, overwritten by what the last one has."""
    p = _pages(spark, sf)
    return M.upsert(first_wins(p, ["key"], ["row_id"]).drop("row_id"), latest_wins(p, ["key"], ["row_id"]).drop("row_id"), ["key"])


@query(f"""WITH {_PAGES} SELECT key, {", ".join(f"coalesce({_NB('f.' + c)}, l.{c}) AS {c}" for c in PAGE)} FROM f FULL JOIN l USING (key)""")
def mrg_fill(spark: SparkSession, sf: str) -> DataFrame:
    """MRG2: blanks of the first capture filled from the last."""
    p = _pages(spark, sf)
    return M.fill_blanks(first_wins(p, ["key"], ["row_id"]).drop("row_id"), latest_wins(p, ["key"], ["row_id"]).drop("row_id"), ["key"])


@query(f"""WITH {_PAGES} SELECT key, min(row_id) AS row_id, count(*) AS n_merged, {", ".join(f"first({c} ORDER BY row_id) FILTER (trim({c}) <> '') AS {c}" for c in PAGE)} FROM p GROUP BY key""")
def mrg_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """MRG4: captures of a page merged, the first filled value of each column."""
    return M.merge_duplicates(_pages(spark, sf), "key", "row_id", PAGE)


@query(
    f"""WITH {SERP}, {DEEP}, s AS (SELECT run_id, key, "position" FROM serp), d AS (SELECT run_id, key, "position" FROM deep) SELECT run_id, key, "position" FROM s WHERE run_id NOT IN (SELECT run_id FROM d) UNION ALL SELECT * FROM d"""
)
def mrg_replace(spark: SparkSession, sf: str) -> DataFrame:
    """MRG6: results of runs that have later pages are replaced by them."""
    cols = ["run_id", "key", "position"]
    return M.replace_keys(serp(spark, sf).select(*cols), deep(spark, sf).select(*cols), ["run_id"])


@query(
    f"""WITH r AS (SELECT prompt_id, query FROM prompts), u AS (SELECT DISTINCT regexp_extract({sql_run("run_id")}, '^(.*)_r\\d+$', 1) AS prompt_id FROM serp_export)
SELECT r.prompt_id, CASE WHEN u.prompt_id IS NOT NULL THEN 'seen' END AS state, r.query FROM r LEFT JOIN u USING (prompt_id)"""
)
def mrg_update(spark: SparkSession, sf: str) -> DataFrame:
    """MRG7, JON3, JON9: an update from a table; prompts it lacks become NULL."""
    p = table(spark, sf, "prompts").select("prompt_id", "query").withColumn("state", F.lit("new"))
    seen = table(spark, sf, "serp_export").select(F.regexp_extract(canonical_run_id("run_id"), r"^(.*)_r\d+$", 1).alias("prompt_id")).distinct().withColumn("state", F.lit("seen"))
    return M.update_from(p, seen, ["prompt_id"], ["state"], keep=False)


@query(
    f"""WITH {CITATIONS}, {SERP}, s AS (SELECT DISTINCT key FROM serp), c AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY run_id, section DESC, cite_position) AS rn, run_id FROM citations)
SELECT key, NULL AS run_id FROM s UNION ALL SELECT key, run_id FROM c WHERE rn = 1 AND key NOT IN (SELECT key FROM s)"""
)
def mrg_insert_missing(spark: SparkSession, sf: str) -> DataFrame:
    """MRG8, MRG15: pages of the results, and the cited pages they lack with the run first seen in."""
    known = serp(spark, sf).select("key").distinct().withColumn("run_id", F.lit(None).cast("string"))
    new = citations(spark, sf).withColumn("_s", F.when(F.col("section") == "cited", 0).otherwise(1))
    return M.insert_missing(known, new.select("key", "run_id", "_s", "cite_position"), "key", ["run_id", "_s", "cite_position"])


@query(
    f"""WITH {CITATIONS}, {SERP}, {DEEP}, u AS (SELECT DISTINCT key FROM citations) SELECT key, (key IN (SELECT key FROM serp))::INT AS is_strict_match, (key IN (SELECT key FROM deep))::INT AS is_grounded_deep FROM u"""
)
def mrg_flags(spark: SparkSession, sf: str) -> DataFrame:
    """MRG14: cited pages found among the results, or on later pages."""
    u = citations(spark, sf).select("key").distinct()
    return M.flag(M.flag(u, serp(spark, sf), ["key"], "is_strict_match"), deep(spark, sf), ["key"], "is_grounded_deep")


@query(
    f"""WITH {CITATIONS}, ok AS (SELECT run_id FROM runs WHERE lower(trim(coalesce(generated_search_query, ''))) NOT IN ('', 'nan', 'n/a')), c AS (SELECT * FROM citations WHERE run_id IN (SELECT run_id FROM ok)) SELECT run_id, section, count(*) AS n FROM c GROUP BY 1, 2"""
)
def mrg_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """MRG16, MRG17 (FLT6): failed runs go, and their citations with them."""
    q = F.lower(F.trim(F.coalesce("generated_search_query", F.lit(""))))
    _, children = M.cascade(runs(spark, sf), ~q.isin("", "nan", "n/a"), {"citations": citations(spark, sf)}, "run_id")
    return children["citations"].groupBy("run_id", "section").agg(F.count("*").alias("n"))


@query()
def mrg_inline(spark: SparkSession, sf: str) -> DataFrame:
    """MRG9 to MRG11 (JSN2, JSN3, STR7): links in the answers with their group, rank and panel position."""
    return M.repaired_groups(inline_citations(runs(spark, sf)), "rank_in_group", "group_size")


@query(
    f"""WITH {CITATIONS} SELECT section AS citation_type, count(*) AS n, count(DISTINCT key) AS n_pages, max(cite_position) AS last_position FROM citations GROUP BY 1"""
)
def mrg_panels(spark: SparkSession, sf: str) -> DataFrame:
    """MRG9: rows of the two panels."""
    return panel_citations(runs(spark, sf)).groupBy("citation_type").agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_pages"), F.max("cite_position").alias("last_position"))


@query(
    f"""SELECT row_id, CASE WHEN contains(lower(url), '/wiki/') THEN 'reference' ELSE 'page' END AS type, ({sql_domain("url")} = regexp_replace(lower(trim(domain)), '^www\\.', ''))::INT AS is_host FROM serp_export WHERE trim(coalesce(url, '')) <> '' AND trim(coalesce(domain, '')) <> ''"""
)
def mrg_types(spark: SparkSession, sf: str) -> DataFrame:
    """MRG12, MRG13: reference pages by url, and whether a row's domain is its url's host."""
    s = table(spark, sf, "serp_export").filter((F.trim(F.coalesce("url", F.lit(""))) != "") & (F.trim(F.coalesce("domain", F.lit(""))) != ""))
    return s.select("row_id", F.when(F.contains(F.lower("url"), F.lit("/wiki/")), "reference").otherwise("page").alias("type"), (domain1("url") == F.regexp_replace(F.lower(F.trim("domain")), r"^www\.", "")).cast("int").alias("is_host"))


@query("""SELECT prompt_id, unnest(range(1, 5))::INT AS copy_no FROM prompts""")
def mrg_replicate(spark: SparkSession, sf: str) -> DataFrame:
    """MRG22: four runs planned for each prompt."""
    return M.replicated(table(spark, sf, "prompts").select("prompt_id"), 4)


@query(
    """WITH e AS (SELECT prompt_id, query FROM prompts), h AS (SELECT query, count(*) AS n FROM run_export GROUP BY 1) SELECT e.prompt_id, coalesce(h.n, 0) AS n_exports FROM e LEFT JOIN h USING (query)"""
)
def mrg_history(spark: SparkSession, sf: str) -> DataFrame:
    """MRG21: exports of each prompt's query."""
    h = table(spark, sf, "run_export").groupBy("query").agg(F.count("*").alias("n"))
    return table(spark, sf, "prompts").select("prompt_id", "query").join(h, "query", "left").select("prompt_id", F.coalesce("n", F.lit(0)).alias("n_exports"))


@query(
    rf"""WITH {CITATIONS}, {SERP}, r AS (SELECT key, max(coalesce(content_words, 0)) AS words, bool_or(content_words IS NOT NULL) AS has_content, bool_or(captured_at IS NOT NULL) AS attempted FROM
 (SELECT s.key, e.captured_at, CASE WHEN trim(coalesce(e.content, '')) <> '' THEN len(regexp_extract_all(e.content, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?')) END AS content_words FROM serp s JOIN serp_export e USING (row_id)) GROUP BY 1),
c AS (SELECT key, bool_or(section = 'cited') AS is_inline, bool_or(section = 'additional') AS is_additional FROM citations GROUP BY 1),
p AS (SELECT key, r.key IS NOT NULL AS is_ranked, coalesce(is_inline, false) AS is_inline, coalesce(is_additional, false) AS is_additional, coalesce(has_content, false) AS has_content, coalesce(words, 0) AS words, coalesce(attempted, false) AS attempted FROM r FULL JOIN c USING (key))
SELECT missing_reason, count(*) AS n FROM (SELECT CASE WHEN has_content THEN CASE WHEN (is_inline OR is_ranked) AND words < 100 THEN 'Failed: Thin Content (<100 words)' ELSE '' END
 WHEN NOT attempted THEN CASE WHEN is_inline OR is_ranked THEN 'Pending Fetch (High Priority)' WHEN is_additional THEN 'Side-Panel Only (Skipped)' ELSE 'Pending Fetch (Uncategorized)' END
 WHEN is_additional AND NOT is_inline AND NOT is_ranked THEN 'Side-Panel Only (Skipped)' ELSE 'Failed: Fetch Error (403/429/Timeout)' END AS missing_reason FROM p) GROUP BY 1"""
)
def mrg_missing_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """MRG18, MRG23: why pages have no usable text: all pages that are ranked or cited, with the words of their longest text."""
    text = table(spark, sf, "serp_export").select("row_id", "captured_at", F.when(F.trim(F.coalesce("content", F.lit(""))) != "", word_count("content")).alias("_words"))
    ranked = serp(spark, sf).select("row_id", "key").join(text, "row_id").groupBy("key").agg(F.max("_words").alias("word_count"), F.max(F.col("_words").isNotNull()).alias("has_content"), F.max(F.col("captured_at").isNotNull()).alias("attempted"), F.lit(True).alias("is_ranked"))
    cited = citations(spark, sf).groupBy("key").agg(F.max(F.col("section") == "cited").alias("is_inline"), F.max(F.col("section") == "additional").alias("is_additional"))
    pages = ranked.join(cited, "key", "full").withColumn("existing_reason", F.lit(None).cast("string"))
    return missing_reason(pages).groupBy("missing_reason").agg(F.count("*").alias("n"))


_CHECK = """{t}_k AS (SELECT trim(coalesce({k}, '')) AS k, count(*) AS n, count(*) FILTER (contains(coalesce(url, ''), '/ck/a')) AS r FROM {t} GROUP BY 1), {t}_c AS (SELECT coalesce(sum(n), 0)::BIGINT AS rows, coalesce(sum(n) FILTER (k = ''), 0)::BIGINT AS blank, count(*) FILTER (k <> '' AND n > 1) AS dup, coalesce(sum(r), 0)::BIGINT AS red FROM {t}_k)"""
_ROWS = """SELECT '{t}.rows' AS "check", rows AS value, rows > 0 AS ok FROM {t}_c UNION ALL SELECT '{t}.blank_keys', blank, blank = 0 FROM {t}_c UNION ALL SELECT '{t}.duplicate_keys', dup, dup = 0 FROM {t}_c UNION ALL SELECT '{t}.redirects', red, red = 0 FROM {t}_c"""


@query(f"""WITH {_CHECK.format(t="serp_export", k="url_key")}, {_CHECK.format(t="deep_results", k="url")} {_ROWS.format(t="serp_export")} UNION ALL {_ROWS.format(t="deep_results")}""")
def val_checks(spark: SparkSession, sf: str) -> DataFrame:
    """VAL1: integrity of both result tables."""
    return checks(table(spark, sf, "serp_export"), "serp_export", "url_key", "url").unionByName(checks(table(spark, sf, "deep_results"), "deep_results", "url", "url"))


@query(
    f"""WITH {CITATIONS}, s AS (SELECT {sql_key("url")} AS key, max((length(trim(coalesce(content, ''))) >= 200)::INT) AS has_text FROM serp_export GROUP BY 1), {DEEP}, d AS (SELECT DISTINCT key FROM deep), c AS (SELECT DISTINCT key, section FROM citations)
SELECT c.section, d.key IS NOT NULL AS in_deep, count(*) AS n_pages, coalesce(sum(s.has_text), 0)::BIGINT AS n_with_text FROM c LEFT JOIN s USING (key) LEFT JOIN d ON d.key = c.key GROUP BY 1, 2"""
)
def val_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """VAL2, VAL3: cited pages with usable text, by section and later pages."""
    s = table(spark, sf, "serp_export").groupBy(url_key2("url").alias("key")).agg(F.max((F.length(F.trim(F.coalesce("content", F.lit("")))) >= 200).cast("int")).alias("has_text"))
    d = deep(spark, sf).select("key").distinct().withColumn("in_deep", F.lit(True))
    c = citations(spark, sf).select("key", "section").distinct().join(s, "key", "left").join(d, "key", "left")
    return c.groupBy("section", F.coalesce("in_deep", F.lit(False)).alias("in_deep")).agg(F.count("*").alias("n_pages"), F.coalesce(F.sum("has_text"), F.lit(0)).alias("n_with_text"))


# labels


@query(
    f"""WITH {CITATIONS}, p AS (SELECT {sql_key("url")} AS key, 0 AS src, row_id AS o, page_title AS title, meta_description AS snippet FROM serp_export UNION ALL SELECT {sql_key("url")}, 1, row_id, title, snippet FROM serp_export)
SELECT key, first(title ORDER BY src, o) FILTER (trim(title) <> '') AS title, first(snippet ORDER BY src, o) FILTER (trim(snippet) <> '') AS snippet FROM p GROUP BY key"""
)
def lbl_best_text(spark: SparkSession, sf: str) -> DataFrame:
    """LLM1: title and snippet of each page: its own metadata first, then the result list's."""
    s = table(spark, sf, "serp_export").withColumn("key", url_key2("url"))
    own = s.select("key", "row_id", F.col("page_title").alias("title"), F.col("meta_description").alias("snippet"))
    return best_text([(own, "row_id"), (s.select("key", "row_id", "title", "snippet"), "row_id")], "key", ["title", "snippet"])


@query(
    r"""SELECT url, n, model, error_type, http_status FROM (SELECT url, model, error_type, http_status, count(*) OVER (PARTITION BY url) AS n, row_number() OVER (PARTITION BY url ORDER BY ts DESC NULLS LAST, coalesce(model, '') DESC, coalesce(error_type, '') DESC, coalesce(http_status, -1) DESC, coalesce(error_message, '') DESC, coalesce(http_body_snippet, '') DESC) AS rn FROM label_failures) WHERE rn = 1"""
)
def lbl_failures(spark: SparkSession, sf: str) -> DataFrame:
    """LLM4, LLM6: the latest failure of each page and how many there were."""
    log = table(spark, sf, "label_failures").withColumn("ok", F.lit(True))
    blank = {"_m": "model", "_e": "error_type", "_x": "error_message", "_b": "http_body_snippet"}
    log = log.withColumns({k: F.coalesce(c, F.lit("")) for k, c in blank.items()} | {"_s": F.coalesce("http_status", F.lit(-1)), "_t": F.coalesce("ts", F.timestamp_micros(F.lit(-(1 << 55))))})
    n = log.groupBy(F.col("url").alias("_url")).agg(F.count("*").alias("n"))
    last = latest_labels(log, "url", ["_t", "_m", "_e", "_s", "_x", "_b"])
    return last.join(n, F.col("url").eqNullSafe(F.col("_url"))).select("url", "n", "model", "error_type", "http_status")


@query(
    f"""WITH {CITATIONS}, s AS (SELECT {sql_key("url")} AS key, lower(trim(has_schema_markup)) IN ('true', '1') AS m, lower(trim(has_table)) IN ('true', '1') AS t, length(content) AS n FROM serp_export),
p AS (SELECT key, bool_or(coalesce(m, false)) AS m, bool_or(coalesce(t, false)) AS t, max(n) AS n FROM s GROUP BY 1), g AS (SELECT p.*, CASE WHEN key IN (SELECT key FROM citations WHERE section = 'cited') THEN 'cited' WHEN key IN (SELECT key FROM citations) THEN 'additional' ELSE 'ignored' END AS cohort FROM p)
SELECT cohort, count(*) AS n_pages, round(avg(m::INT), 9) AS share_markup, round(avg(t::INT), 9) AS share_tables, round(avg(n), 6) AS mean_length FROM g GROUP BY 1"""
)
def lbl_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    """LLM10: pages cited, offered in addition, and ignored, compared."""
    yes = lambda c: F.coalesce(F.lower(F.trim(c)).isin("true", "1"), F.lit(False))
    p = table(spark, sf, "serp_export").groupBy(url_key2("url").alias("key")).agg(F.bool_or(yes("has_schema_markup")).alias("m"), F.bool_or(yes("has_table")).alias("t"), F.max(F.length("content")).alias("n"))
    c = citations(spark, sf).groupBy("key").agg(F.max((F.col("section") == "cited").cast("int")).alias("cited"))
    cohort = F.when(F.col("cited") == 1, "cited").when(F.col("cited") == 0, "additional").otherwise("ignored")
    return p.join(c, "key", "left").groupBy(cohort.alias("cohort")).agg(F.count("*").alias("n_pages"), F.round(F.avg(F.col("m").cast("int")), 9).alias("share_markup"), F.round(F.avg(F.col("t").cast("int")), 9).alias("share_tables"), F.round(F.avg("n"), 6).alias("mean_length"))


@query()
def ovl_three_way(spark: SparkSession, sf: str) -> DataFrame:
    """OVL9 (STR5, STR6, OVL5): items of the answers, the page each cites, its rank, and the page title that names the item."""
    inline = inline_citations(runs(spark, sf)).filter("item_name IS NOT NULL")
    items = inline.select(F.concat_ws("|", "run_id", "item_no", "group_index", "rank_in_group").alias("item_id"), "run_id", F.col("key").alias("page"), "item_name")
    s = serp(spark, sf)
    names = s.groupBy("key", "title").agg(F.min("row_id").alias("ord"), F.min("position").alias("product_position"))
    parts = names.select(F.col("key").alias("page"), "ord", "product_position", F.explode(F.split("title", r" (?:vs|o|ou|oder|review|im Test|a prueba)\b")).alias("product_name"))
    rank = s.groupBy("run_id", F.col("key").alias("page")).agg(F.min("position").alias("serp_rank"))
    return named_matches(items, parts, 0.5).join(rank, ["run_id", "page"], "left").select("item_id", "item_name", "page", "serp_rank", "method", F.round("similarity", 9).alias("similarity"), "product_name", "product_position")


# page structure, over pages put together from the captured fields


def _html(spark: SparkSession, sf: str) -> DataFrame:
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    body = F.array_join(F.transform(F.split(F.coalesce("content", F.lit("")), "\n"), lambda x: F.concat(F.lit("<p>"), esc(x), F.lit("</p>"))), "")
    page = F.concat(
        F.lit("<html><head><title>"), esc("page_title"), F.lit('</title><meta name="description" content="'), esc("meta_description"), F.lit('"><link rel="canonical" href="'), esc("canonical_url"), F.lit('"><meta property="article:published_time" content="'), esc("published_date"),
        F.lit('"><script>var a = "<b>";</script></head><body><nav class="menu"><a href="/">Home</a></nav>'), F.when(F.lower("has_table") == "true", F.lit("<table><tr><td>1</td></tr></table>")).otherwise(F.lit("")), body, F.lit('<div class="cookie footer">x</div></body></html>'),
    )
    return table(spark, sf, "serp_export").select("row_id", "page_title", "content", page.alias("html"))


@query()
def htm_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """HTM6, HTM7, HTM7b, JSN6: metadata of every page by both priority orders, and as rendered."""
    d = _html(spark, sf).select("row_id", H.html_metadata("html").alias("a"), H.html_metadata_og("html").alias("b"), H.html_metadata_rendered("html").alias("c"))
    return d.select("row_id", "a.*", F.col("b.title").alias("og_title"), F.col("b.published").alias("og_published"), F.col("c.js_render_suspected").alias("rendered_js"))


@query()
def htm_text(spark: SparkSession, sf: str) -> DataFrame:
    """HTM1, HTM2, HTM5: text of every page by its structure, by whole class names, parts of names, and without."""
    return _html(spark, sf).select("row_id", F.md5(H.html_text("html")).alias("text_md5"), F.length(H.html_text_parts("html")).alias("parts_length"), F.length(H.html_text_plain("html")).alias("plain_length"))


@query(
    r"""SELECT row_id, length(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(content, ''), '(?is)<(?:script|style|noscript)\b.*?</(?:script|style|noscript)\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS stripped_length, contains(lower(coalesce(content, '')), '<table') AS has_table FROM serp_export"""
)
def htm_stripped(spark: SparkSession, sf: str) -> DataFrame:
    """HTM4, HTM8: text by patterns."""
    c = F.coalesce("content", F.lit(""))
    return table(spark, sf, "serp_export").select("row_id", F.length(H.stripped(c)).alias("stripped_length"), H.has_table(c).alias("has_table"))


_SQL_ESC = lambda c: f"replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '\"', '&quot;')"
_SQL_PAGE = (
    f"""'<html><head><title>' || {_SQL_ESC("page_title")} || '</title><meta name="description" content="' || {_SQL_ESC("meta_description")} || '"><link rel="canonical" href="' || {_SQL_ESC("canonical_url")} || '"><meta property="article:published_time" content="' || {_SQL_ESC("published_date")}"""
    f""" || '"><script>var a = "<b>";</script></head><body><nav class="menu"><a href="/">Home</a></nav>' || CASE WHEN lower(has_table) = 'true' THEN '<table><tr><td>1</td></tr></table>' ELSE '' END || array_to_string(list_transform(string_split(coalesce(content, ''), chr(10)), lambda x: '<p>' || {_SQL_ESC("x")} || '</p>'), '') || '<div class="cookie footer">x</div></body></html>'"""
)
_SQL_WORDS = " + ".join(f"contains(h, '{w}')::INT" for w in ("comparison", "compare", "vs", "price", "pricing", "rating", "score", "features", "feature", "pros", "cons", "best for"))


@query(
    rf"""WITH p AS (SELECT row_id, coalesce(content, '') AS content, {_SQL_PAGE} AS html FROM serp_export), q AS (SELECT *, lower(html) AS h, lower(content) AS t FROM p), w AS (SELECT *, {_SQL_WORDS} AS w FROM q)
SELECT row_id, contains(h, 'type="application/ld+json"') OR (contains(h, 'itemscope') AND contains(h, 'itemtype')) OR (contains(h, 'typeof=') AND contains(h, 'property=')) AS has_schema_markup,
 CASE WHEN contains(h, '<table') THEN round(least(1.0::DOUBLE, CASE WHEN len(regexp_extract_all(h, '<tr')) >= 6 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN len(regexp_extract_all(h, '<th')) >= 4 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN w >= 4 THEN 0.35::DOUBLE WHEN w >= 2 THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN regexp_matches(h, '(?:class|id)=["''][^"'']*(?:comparison|compare|vs|pricing[-_ ]table)[^"'']*["'']') THEN 0.25::DOUBLE ELSE 0 END), 2) ELSE 0.0::DOUBLE END AS comparison_score,
 round(CASE WHEN instr(t, 'pros') > 0 AND instr(t, 'cons') > 0 AND abs(instr(t, 'pros') - instr(t, 'cons')) <= 250 THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(h, '(?:class|id)=["''][^"'']*(?:pros|cons)[^"'']*["'']') THEN 0.2::DOUBLE ELSE 0 END, 2) AS pros_cons_score,
 length(trim(regexp_replace(content, '\s+', ' ', 'g'))) < 400 AND (contains(html, '__NEXT_DATA__') OR contains(html, 'data-reactroot') OR contains(html, 'id="app"') OR contains(html, 'id="root"') OR contains(html, 'window.__INITIAL_STATE__') OR contains(html, 'webpackJsonp') OR contains(html, 'ng-version')) AS js_suspected,
 length(content) > 12000 AS content_truncated, '' AS freshness FROM w"""
)
def htm_features(spark: SparkSession, sf: str) -> DataFrame:
    """HTM9 to HTM13, HTM17, DAT3: structural features and scores of every page."""
    h = F.col("html")
    return _html(spark, sf).select(
        "row_id", H.has_schema_markup(h).alias("has_schema_markup"), H.comparison_score(h).alias("comparison_score"), H.pros_cons_score(h, F.col("content")).alias("pros_cons_score"), H.js_suspected(F.coalesce("content", F.lit("")), h).alias("js_suspected"),
        H.capped(F.coalesce("content", F.lit("")), 12000)["content_truncated"].alias("content_truncated"), H.freshness(h).alias("freshness"),
    )


@query()
def htm_results(spark: SparkSession, sf: str) -> DataFrame:
    """The links of a saved page, each url once: rows back from a page of links of each query."""
    link = F.concat(F.lit('<li><a href="'), F.replace(F.trim("url"), F.lit("&"), F.lit("&amp;")), F.lit('">'), F.coalesce("title", F.lit("")), F.lit("</a></li>"))
    s = serp(spark, sf).withColumn("_l", link)
    pages = s.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "row_id", "_l"))), lambda x: x["_l"]), "").alias("html"))
    return pages.select("run_id", F.explode(H.html_results("html")).alias("r")).select("run_id", "r.position", "r.title", domain10("r.url").alias("domain"))


def _esc(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.coalesce(c, F.lit(""))


def _saved(rows: DataFrame, keys: list[str], order: list[str], part: Column) -> DataFrame:
    """The parts of each page in order, as one text."""
    parts = F.array_sort(F.collect_list(F.struct(*order, part.alias("_l"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["_l"]), "").alias("_parts"))


@query()
def htm_cards(spark: SparkSession, sf: str) -> DataFrame:
    """HTM14: result cards back from a saved result page of each run, which has a menu and an advert besides."""
    card = F.concat(F.lit('<li class="b_algo"><h2><a href="'), _esc(F.trim("url")), F.lit('">'), _esc(F.col("title")), F.lit('</a></h2><div class="b_caption"><p>'), _esc(F.col("query")), F.lit("</p></div></li>"))
    pages = _saved(serp(spark, sf), ["run_id"], ["position", "row_id"], card)
    ad = '<nav><a href="https://menu.example/">Menu</a></nav><ol><li class="b_algo"><p>Sponsored</p><h2><a href="https://ad.example/">Advert</a></h2></li><li></li><li></li><li></li>'
    return result_rows(pages.select("run_id", F.concat(F.lit(ad), "_parts", F.lit('</ol><a class="sb_pagS">1</a>')).alias("html")), "run_id", "html").select("run_id", "position", "title", "domain", "snippet", "page_num")


@query()
def htm_items(spark: SparkSession, sf: str) -> DataFrame:
    """HTM15: items, headings and links back from a saved answer of each run."""
    item = F.concat(F.when(F.col("cite_position") == 1, F.concat(F.lit("<h2>"), F.col("section"), F.lit("</h2>"))).otherwise(F.lit("")), F.lit("<li>"), _esc(F.col("domain")), F.lit(' — source <a href="'), _esc(F.trim("url")), F.lit('">link</a></li>'))
    pages = _saved(citations(spark, sf), ["run_id"], ["section", "cite_position"], item)
    return pages.select("run_id", F.explode(html_items("_parts")).alias("i")).select("run_id", "i.*")


@query()
def htm_sources(spark: SparkSession, sf: str) -> DataFrame:
    """HTM16: cited and further sources back from a saved panel of each run."""
    head = F.when(F.col("section") == "cited", "Citations").otherwise("More")
    link = F.concat(F.lit('<li><a target="_blank" rel="noopener" href="'), _esc(F.trim("url")), F.lit('"><div class="font-semibold">'), _esc(F.col("domain")), F.lit("</div></a></li>"))
    lists = _saved(citations(spark, sf), ["run_id", "section"], ["cite_position"], link).withColumn("_list", F.concat(F.lit('<li class="sticky">'), head, F.lit("</li><ul>"), "_parts", F.lit("</ul>")))
    pages = _saved(lists.withColumn("_o", F.col("section") == "additional"), ["run_id"], ["_o"], F.col("_list"))
    return source_rows(pages, "run_id", "_parts").select("run_id", "section", "position", "title", "domain")


# statistics


@query(
    """WITH v AS (SELECT o_totalprice AS v, count(*) AS t FROM orders GROUP BY 1), r AS (SELECT v, t, coalesce(sum(t) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS r FROM v),
g AS (SELECT o_orderpriority, count(*) AS n, sum(r) AS s FROM orders JOIN r ON o_totalprice = v GROUP BY 1), h AS (SELECT sum(n)::DOUBLE AS n, count(*) AS k, sum(s * s / n) AS q FROM g), c AS (SELECT sum(t::DOUBLE * t * t - t) AS t FROM v)
SELECT n::BIGINT AS n, k AS groups, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - c.t / (n * n * n - n)), 4) AS h FROM h, c"""
)
def sta_kruskal(spark: SparkSession, sf: str) -> DataFrame:
    """STA2: order totals by priority (H; the p value is tested apart)."""
    return kruskal_wallis(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice").select("n", "groups", F.round("h", 4).alias("h"))


@query(
    """WITH v AS (SELECT o_orderpriority AS g, o_totalprice AS v, count(*) AS c FROM orders GROUP BY 1, 2), n AS (SELECT g, sum(c)::BIGINT AS n FROM v GROUP BY 1),
p AS (SELECT a.g AS a, b.g AS b, a.n AS n_a, b.n AS n_b FROM n a JOIN n b ON a.g < b.g), x AS (SELECT a, b, v, sum(x) AS x, sum(y) AS y FROM (SELECT a, b, v, c AS x, 0 AS y FROM p JOIN v ON v.g = a UNION ALL SELECT a, b, v, 0, c FROM p JOIN v ON v.g = b) GROUP BY 1, 2, 3),
u AS (SELECT a, b, x * (coalesce(sum(y) OVER (PARTITION BY a, b ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + y / 2) AS u FROM x) SELECT p.a, p.b, p.n_a, p.n_b, round(sum(u.u), 3) AS u FROM p JOIN u USING (a, b) GROUP BY 1, 2, 3, 4"""
)
def sta_mann_whitney(spark: SparkSession, sf: str) -> DataFrame:
    """STA1, STA3, XQ6: pairwise tests of order totals by priority (U; the p value is tested apart)."""
    return mann_whitney_pairs(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice").select("a", "b", "n_a", "n_b", F.round("u", 3).alias("u"))


@query()
def sta_p_values(spark: SparkSession, sf: str) -> DataFrame:
    """STA1 to STA3: p values, written out."""
    m = mann_whitney_pairs(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    return m.select("a", "b", F.round("p", 6).alias("p"), formatted_p(F.col("p_bonferroni")).alias("p_bonferroni"))


@query(
    """WITH v AS (SELECT event_type, value AS v, count(*) AS t FROM events WHERE value IS NOT NULL GROUP BY 1, 2) SELECT event_type, round(max(r), 3) AS max_rank, max(t) AS most_ties FROM (SELECT *, coalesce(sum(t) OVER (PARTITION BY event_type ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS r FROM v) GROUP BY 1"""
)
def sta_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Average ranks within groups."""
    r = average_ranks(table(spark, sf, "events").select("event_type", "value"), "value", ["event_type"])
    return r.groupBy("event_type").agg(F.round(F.max("rank"), 3).alias("max_rank"), F.max("ties").alias("most_ties"))


# vectors


def _vector_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of the vectors of one label, in the order of their ids: the runs of a prompt."""
    e = table(spark, sf, "embeddings").withColumn("list_id", F.floor(F.col("vec_id") / 100))
    v = e.groupBy("label", "list_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    return v.select("label", "list_id", F.col("v.embedding").cast(VECTORS).alias("vectors"))


@query()
def xr_mipo(spark: SparkSession, sf: str) -> DataFrame:
    """XR1, OVL3: agreement of the lists of a label by optimal assignment of vectors."""
    return pair_overlap(_vector_lists(spark, sf), "label", "list_id", "vectors", 0.3).select("label", "n_pairs", *[F.round(c, 6).alias(f"mipo_{c}") for c in ("mean", "var", "std")])


@query()
def xr_cqmipo(spark: SparkSession, sf: str) -> DataFrame:
    """XR3: agreement of all lists of two labels, the whole matrix."""
    return cross_overlap(_vector_lists(spark, sf), "label", "list_id", "vectors", 0.3).select("label_i", "label_j", F.round("mean", 6).alias("cqmipo"))


@query()
def xr_cqmipo_sample(spark: SparkSession, sf: str) -> DataFrame:
    """XR5: agreement of three lists of each of two labels, chosen by hash as the study samples three; the whole matrix."""
    lists = top_k(_vector_lists(spark, sf), ["label"], [F.xxhash64("label", "list_id", F.lit(2025))], 3)
    return cross_overlap(lists, "label", "list_id", "vectors", 0.3).select("label_i", "label_j", F.round("mean", 6).alias("cqmipo"))


@query()
def xr_csmpo(spark: SparkSession, sf: str) -> DataFrame:
    """XR8: agreement of two systems on a label; lists of even number stand for one system, of odd number for the other."""
    lists = _vector_lists(spark, sf)
    s = system_overlap(lists.filter("list_id % 2 = 0"), lists.filter("list_id % 2 = 1"), "label", "vectors", 0.3)
    return s.select("label", "n_pairs", *[F.round(c, 6).alias(f"csmpo_{c}") for c in ("mean", "var", "std")])


@query()
def clu_top(spark: SparkSession, sf: str) -> DataFrame:
    """CLU1: representatives of the clusters of each list."""
    lists = table(spark, sf, "embeddings").withColumn("list_id", F.floor(F.col("vec_id") / 100))
    d = lists.withColumn("_list", F.concat_ws("-", "label", "list_id"))
    return top_semantic(d, "_list", "vec_id", "vec_id", "embedding", 10, 0.3)


@query()
def xr_cqopo(spark: SparkSession, sf: str) -> DataFrame:
    """XR7, XR10: agreement of two labels on their largest clusters, of all vectors of a label."""
    top = top_semantic(table(spark, sf, "embeddings"), "label", "vec_id", "vec_id", "embedding", 5, 0.3).withColumn("vec_id", F.col("name").cast("bigint"))
    v = top.join(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("position", "embedding"))).alias("v")).select("label", F.col("v.embedding").cast(VECTORS).alias("v"))
    p = blocked(v, ["label"], v.select(F.col("label").alias("label_j"), F.col("v").alias("w")), ["label_j"]).filter("label < label_j")  # labels by labels
    return p.select("label", "label_j", F.round(overlap_udf(0.3)("v", "w"), 6).alias("cqopo"))


# pacing


@query(
    """WITH e AS (SELECT event_id, user_id, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT event_id, max(t - n * 2500) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) + n * 2500 - t AS wait_ms FROM e"""
)
def stm_paced(spark: SparkSession, sf: str) -> DataFrame:
    """STM3: waits when a user's events start at least 2.5 seconds apart."""
    return paced(table(spark, sf, "events"), "user_id", "ts", "event_id", 2500).select("event_id", "wait_ms")


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stm_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly totals, as the stream query of the tests computes them under a watermark."""
    e = table(spark, sf, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
