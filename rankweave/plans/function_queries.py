"""Queries of the scalar functions and predicates over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions import text as T
from rankweave.functions import urls as U
from rankweave.operators.setops import first_wins, has_platform, is_ad_click, is_ad_link, is_ad_text, is_challenge, is_missing, is_platform, is_sponsored
from rankweave.plans.base import PLATFORM_SQL, PLATFORMS, SERP, serp, sql_domain, sql_key, sql_literal, sql_part, sql_text
from rankweave.session import table

# Redirects and links as adverts and pages like them write them: (name, what stands before a url, whether the url follows as it is).
AD_WRAPPERS = (
    ("none", "", True), ("bing ad", "https://www.bing.com/aclick?ld=1&u=", False), ("bing click", "https://bing.com/clk?u=", False), ("bing short", "http://cn.bing.com/sclk/x?u=", False), ("bing search", "https://www.bing.com/search?q=/clk&u=", False),
    ("network", "https://ad.doubleclick.net/ddm/clk?u=", False), ("search ads", "https://x.example/doubleclick.net/searchads?u=", False), ("syndication", "https://tpc.googlesyndication.com/a?u=", False), ("service", "adservice.google.com/?u=", False), ("like a network", "https://notdoubleclick.net/?u=", False),
)
PLATFORM_NAMES, PLATFORM_PATHS = ("cedarsignal", "kettle"), ("compare",)  # parts of hosts and of urls that the queries leave out
PROBABILITIES = ("no_search_prob", "simple_search_prob", "complex_search_prob", "search_complexity_threshold")

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_T = sql_text("url")
_K8 = rf"regexp_replace(regexp_replace(CASE WHEN contains(lower({_T}), '://') THEN split_part(lower({_T}), '://', 2) ELSE lower({_T}) END, '^www\.', ''), '/$', '')"
_K9 = rf"regexp_replace(split_part(lower({_T}), '?', 1), '/+$', '')"
_D7 = rf"regexp_replace({sql_domain('url')}, ':\d+$', '')"


@query(
    f"""SELECT row_id, {sql_key("url")} AS key2, {_K8} AS key8, {_K9} AS key9, {sql_domain("url")} AS domain1, array_to_string(list_slice(string_split({_D7}, '.'), greatest(len(string_split({_D7}, '.')) - 1, 1), len(string_split({_D7}, '.'))), '.') AS domain9,
 replace(coalesce(domain, ''), 'www.', '') AS domain11, substr(sha256({sql_key("url")}), 1, 16) AS hash FROM serp_export"""
)
def url_keys(spark: SparkSession, sf: str) -> DataFrame:
    """URL2, URL8, URL9, URL14, DOM1, DOM9, DOM11 over all result urls."""
    s = table(spark, sf, "serp_export")
    return s.select("row_id", U.url_key2("url").alias("key2"), U.url_key8("url").alias("key8"), U.url_key9("url").alias("key9"), U.domain1("url").alias("domain1"), U.domain9("url").alias("domain9"), U.domain11("domain").alias("domain11"), U.short_hash(U.url_key2("url")).alias("hash"))


def _names(*x: str) -> str:
    return ", ".join(f"'{n}'" for n in x)


_HEAD7 = rf"lower(regexp_replace({_T}, '#.*$', ''))"
_QUERY7 = rf"array_to_string(list_filter(string_split(regexp_extract({_HEAD7}, '\?(.*)$', 1), '&'), lambda kv: split_part(kv, '=', 1) NOT IN ('test_uuid', 'test_variant')), '&')"
_FULL10 = f"CASE WHEN contains(lower({_T}), '://') THEN lower({_T}) ELSE 'https://' || lower({_T}) END"


def sql_clean(u: str) -> str:
    """URL11."""
    kept = rf"array_to_string(list_filter(string_split(regexp_extract({u}, '^[^?#]*\?([^#]*)', 1), '&'), lambda kv: kv <> '' AND split_part(kv, '=', 1) NOT IN ({_names(*U.LINK_TRACKING)})), '&')"
    return f"CASE WHEN starts_with({u}, 'http') THEN regexp_extract({u}, '^([^?#]*)', 1) || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END || regexp_extract({u}, '(#.*)$', 1) ELSE {u} END"


_RAW = "coalesce(url, '')"
_HOST8 = rf"regexp_replace(lower({sql_part(_T, 1)}), ':\d+$', '')"
_D10 = sql_domain("url")
for _p in ("apps", "play", "chrome", "itunes", "microsoft", "addons"):
    _D10 = rf"regexp_replace({_D10}, '^{_p}\.', '')"
_WEB4 = f"CASE WHEN starts_with({_RAW}, 'http') THEN {_RAW} ELSE 'http://' || {_RAW} END"


@query(
    rf"""SELECT row_id, {sql_key("url", _names(*U.CLICK, "ref"))} AS url3, {sql_key("url", _names(*U.CLICK, *U.MAIL, "ref", "ref_src"), False)} AS url4, {sql_key("url", _names(*U.CLICK, *U.MAIL), False)} AS url5,
 {sql_key("url", _names(*U.CLICK, *U.MAIL, "test_uuid", "test_variant"), False, True)} AS url6, regexp_replace(split_part({_HEAD7}, '?', 1) || CASE WHEN {_QUERY7} <> '' THEN '?' || {_QUERY7} ELSE '' END, '/$', '') AS url7,
 CASE WHEN {_T} = '' THEN '' ELSE regexp_replace({sql_part(_FULL10, 1)}, '^www\.', '') || regexp_replace({sql_part(_FULL10, 2)}, '/+$', '') END AS url10, {sql_clean(_RAW)} AS url11,
 regexp_replace(CASE WHEN contains({_T}, '://') THEN {sql_part(_T, 1)} ELSE regexp_extract({_T}, '^([^?#]*)', 1) END, '^www\.', '') AS domain2, CASE WHEN contains({_T}, '://') THEN lower(regexp_replace({sql_part(_T, 1)}, '^www\.', '')) ELSE '' END AS domain3,
 lower(regexp_replace({sql_part(_WEB4, 1)}, '^www\.', '')) AS domain4, regexp_replace({sql_part(_T, 1)}, '^www\.', '') AS domain5, {sql_part(_T, 1)} AS domain6, {_D7} AS domain7,
 CASE WHEN {_HOST8} = '' THEN {_T} ELSE regexp_replace({_HOST8}, '^(.*?)www\.', '\1') END AS domain8, {_D10} AS domain10 FROM serp_export"""
)
def url_variants(spark: SparkSession, sf: str) -> DataFrame:
    """URL3 to URL7, URL10, URL11, DOM2 to DOM8, DOM10 of every result url."""
    named = {f"url{i}": getattr(U, f"url_key{i}")("url") for i in (3, 4, 5, 6, 7, 10)} | {"url11": U.clean_url("url")} | {f"domain{i}": getattr(U, f"domain{i}")("url") for i in (2, 3, 4, 5, 6, 7, 8, 10)}
    return table(spark, sf, "serp_export").select("row_id", *[c.alias(n) for n, c in named.items()])


@query(f"""SELECT row_id, trim(url) AS target, {sql_key("trim(url)")} AS key, {sql_clean("trim(url)")} AS cleaned FROM serp_export WHERE starts_with(trim(coalesce(url, '')), 'http')""")
def url_redirects(spark: SparkSession, sf: str) -> DataFrame:
    """URL1, URL12, URL13: keys and targets of every result url, wrapped in a redirect as a ranked page writes it."""
    s = table(spark, sf, "serp_export").filter(F.trim(F.coalesce("url", F.lit(""))).startswith("http")).select("row_id", F.trim("url").alias("url"))
    coded = F.regexp_replace(F.translate(F.base64(F.col("url").cast("binary")), "+/", "-_"), r"[=\s]+", "")
    r = s.withColumn("r", F.concat(F.lit("https://www.bing.com/ck/a?!&p=1&u=a1"), coded, F.lit("&ntb=1")))
    return r.select("row_id", U.decode_redirect("r").alias("target"), U.url_key1("r").alias("key"), U.decode_any("r").alias("cleaned"))


@query(
    r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?')) AS words,
 CASE WHEN regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') = '' THEN 0 ELSE len(string_split_regex(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '\s+')) END AS space_words FROM documents"""
)
def text_word_counts(spark: SparkSession, sf: str) -> DataFrame:
    """STR3, STR4: words of every document, by two rules."""
    return table(spark, sf, "documents").select("doc_id", T.word_count("text").alias("words"), T.space_word_count("text").alias("space_words"))


@query(
    r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+(?:''[A-Za-z]+)?') AS ws FROM documents),
s AS (SELECT doc_id, len(ws) AS n, greatest(len(regexp_extract_all(t, '[.!?]+')), 1) AS m, list_transform(list_transform(ws, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), lambda x: greatest(len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN ends_with(x, 'e') AND len(regexp_extract_all(x, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END, 1)) AS sy FROM w)
SELECT doc_id, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE round(greatest(least(206.835::DOUBLE - 1.015::DOUBLE * (n::DOUBLE / m) - 84.6::DOUBLE * (list_sum(sy)::DOUBLE / n), 130.0::DOUBLE), -50.0::DOUBLE), 6) END AS reading_ease FROM s"""
)
def text_reading_ease(spark: SparkSession, sf: str) -> DataFrame:
    """MTH1, MTH2: reading ease of every document."""
    return table(spark, sf, "documents").select("doc_id", F.round(T.reading_ease("text"), 6).alias("reading_ease"))


@query(
    r"""WITH n AS (SELECT row_id, CASE WHEN title IS NULL OR lower(trim(title)) = 'nan' THEN '' ELSE trim(title) END AS s FROM serp_export),
a AS (SELECT row_id, regexp_replace(s, '^\s*(?:#?\d+[).\s-]+)+', '') AS s FROM n),
b AS (SELECT row_id, CASE WHEN length(regexp_extract(s, '^(.*?)\s*(?:[–—\-:|]|$)', 1)) >= 2 THEN regexp_extract(s, '^(.*?)\s*(?:[–—\-:|]|$)', 1) ELSE s END AS s FROM a),
c AS (SELECT row_id, lower(regexp_replace(s, '\s*\([^)]*\)\s*', ' ', 'g')) AS s FROM b),
d AS (SELECT row_id, trim(regexp_replace(replace(s, '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS name FROM c)
SELECT row_id, name, len(list_filter(list_distinct(string_split(name, ' ')), lambda w: w NOT IN ('the', 'a', 'an', 'best', 'for', 'and', 'to', 'of', 'in', 'with', 'free', ''))) AS n_tokens FROM d"""
)
def text_product_names(spark: SparkSession, sf: str) -> DataFrame:
    """STR1, STR5, STR6: names in titles and the words that tell them apart."""
    return table(spark, sf, "serp_export").select("row_id", T.product_name("title").alias("name"), F.size(T.name_tokens("title")).alias("n_tokens"))


@query(
    r"""SELECT row_id, CASE WHEN lower(trim(title)) <> 'nan' THEN title END AS title, CASE WHEN contentError IS NULL OR lower(trim(contentError)) = 'nan' THEN '' ELSE trim(contentError) END AS error, lower(trim(regexp_replace(coalesce(query, ''), '^"+|"+$', '', 'g'))) AS query_key FROM serp_export"""
)
def text_blanks(spark: SparkSession, sf: str) -> DataFrame:
    """STR1, STR2, STR10: ``nan`` as missing, blanks, query keys."""
    return table(spark, sf, "serp_export").select("row_id", T.nan_to_null("title").alias("title"), T.safe_str("contentError").alias("error"), T.query_key("query").alias("query_key"))


@query(
    r"""SELECT row_id, coalesce(nullif(trim(prompt_id), ''), printf('P%04d', query_index)) || '_r' || run_number AS run_id FROM run_export"""
)
def text_run_ids(spark: SparkSession, sf: str) -> DataFrame:
    """STR11: run ids of the export."""
    return table(spark, sf, "run_export").select("row_id", T.run_id("prompt_id", "run_number", "query_index").alias("run_id"))


@query(
    r"""SELECT regexp_extract(r, '^(.*)_r\d+$', 1) AS prompt_id, max(try_cast(regexp_extract(r, '_r(\d+)$', 1) AS INTEGER)) + 1 AS next_run FROM (SELECT regexp_replace(trim(run_id), '_[rR]0*(\d+)$', '_r\1') AS r FROM serp_export) GROUP BY 1"""
)
def text_next_runs(spark: SparkSession, sf: str) -> DataFrame:
    """STR12: the next run number of each prompt."""
    p = table(spark, sf, "serp_export").select(T.run_parts("run_id").alias("p"))
    return p.groupBy("p.prompt_id").agg((F.max("p.run_number") + 1).alias("next_run"))


@query(
    r"""WITH i AS (SELECT row_id, unnest(range(1, 1 + len(es))) AS item_no, unnest(es) AS e FROM (SELECT row_id, CASE WHEN json_valid(items_json) AND json_type(items_json) = 'ARRAY' THEN json_extract(items_json, '$[*]') ELSE [] END AS es FROM run_export)),
n AS (SELECT row_id, item_no, e->>'$.item_name' AS item_name, coalesce(e->>'$.item_text', '') AS t FROM i), s AS (SELECT *, CASE WHEN item_name IS NULL OR lower(trim(item_name)) = 'nan' THEN '' ELSE trim(item_name) END AS s FROM n),
c AS (SELECT *, CASE WHEN contains(s, ' & ') THEN ' & ' WHEN contains(s, ' and ') THEN ' and ' WHEN contains(s, ' / ') THEN ' / ' WHEN contains(s, ' | ') THEN ' | ' WHEN contains(s, ' + ') THEN ' + ' WHEN contains(s, ', ') THEN ',' END AS sep FROM s),
p AS (SELECT *, CASE WHEN sep IS NULL THEN [s] ELSE list_filter(list_transform(string_split(s, sep), lambda x: trim(x)), lambda x: x <> '') END AS parts FROM c)
SELECT row_id, item_no::INT AS item_no, item_name, CASE WHEN s = '' THEN '' WHEN len(parts) >= 2 THEN array_to_string(parts, ' + ') ELSE s END AS entities,
 CASE WHEN regexp_matches(t, '^\s*[^—\-:]{2,80}\s*[—\-:]\s+') THEN trim(regexp_extract(t, '^\s*([^—\-:]{2,80})\s*[—\-:]\s+', 1)) ELSE array_to_string(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')[1:3], ' ') END AS derived_name FROM p"""
)
def text_item_names(spark: SparkSession, sf: str) -> DataFrame:
    """JSN2, STR7, STR8: items of the answers, their names and the parts of joint names."""
    i = table(spark, sf, "run_export").select("row_id", F.posexplode(T.items("items_json")).alias("p", "i"))
    return i.select("row_id", (F.col("p") + 1).alias("item_no"), F.col("i.item_name").alias("item_name"), F.array_join(T.entities("i.item_name"), " + ").alias("entities"), T.item_name("i.item_text").alias("derived_name"))


@query(
    rf"""WITH r AS (SELECT row_id, coalesce(response_text, '') AS t, response_text, raw_api_response_json AS j FROM run_export), c AS (SELECT *, trim(regexp_replace(t, '\s+', ' ', 'g')) AS s, list_transform(regexp_extract_all(t, '(?i)https?://[^\s<>"'')\]]+'), lambda u: regexp_replace(u, '[.,;:!?]+$', '')) AS us FROM r)
SELECT row_id, regexp_replace(trim(regexp_extract(s, '(?i)(?:Searching|Searched)\s+(?:the\s+web\s+)?for\s+(.+)', 1)), '^["“”'']+|["“”'']+$', '', 'g') AS searched, floor(length(response_text) / 4)::BIGINT AS payload_tokens,
 len(list_distinct(list_filter(list_transform(us, lambda u: {sql_clean("u")}), lambda u: u <> ''))) AS n_urls, length(trim(regexp_replace(trim(j), '^```(?:json)?\s*|\s*```$', '', 'g'))) AS n_raw FROM c"""
)
def text_searches(spark: SparkSession, sf: str) -> DataFrame:
    """STR9, STR14, STR15, URL15: what an answer says it searched, payload sizes, urls in the answer."""
    r = table(spark, sf, "run_export")
    return r.select("row_id", T.searched_for("response_text").alias("searched"), T.payload_tokens(F.length("response_text")).alias("payload_tokens"), F.size(U.urls_in("response_text")).alias("n_urls"), F.length(T.unfenced("raw_api_response_json")).alias("n_raw"))


@query(
    r"""WITH r AS (SELECT row_id, coalesce(nullif(trim(prompt_id), ''), 'Q' || query_index) || '_r' || run_number AS run_id, generated_search_query AS g, hidden_queries_json AS j FROM run_export WHERE run_number IS NOT NULL),
e AS (SELECT row_id, run_id, 0 AS p, trim(g) AS query FROM r WHERE g IS NOT NULL AND g <> 'N/A' UNION ALL
 SELECT row_id, run_id, unnest(range(1, 1 + len(qs))), trim(unnest(qs)) FROM (SELECT row_id, run_id, CASE WHEN json_valid(j) AND json_type(j) = 'ARRAY' THEN json_extract_string(j, '$[*]') ELSE [] END AS qs FROM r)),
f AS (SELECT *, row_number() OVER (PARTITION BY run_id, query ORDER BY row_id, p) AS n FROM e WHERE query IS NOT NULL AND (p = 0 OR query <> ''))
SELECT row_id, run_id, query, p > 0 AS hidden FROM f WHERE n = 1"""
)
def json_hidden_queries(spark: SparkSession, sf: str) -> DataFrame:
    """JSN5: the search queries of each run, the shown one before the hidden ones, each once by its first place in the file."""
    r = table(spark, sf, "run_export").filter("run_number IS NOT NULL")
    prompt = F.coalesce(F.nullif(F.trim("prompt_id"), F.lit("")), F.concat(F.lit("Q"), F.col("query_index").cast("string")))
    r = r.withColumn("run_id", F.concat(prompt, F.lit("_r"), F.col("run_number").cast("string")))
    shown = F.when(F.col("generated_search_query") != "N/A", F.array("generated_search_query")).otherwise(F.array(F.lit(None).cast("string")))
    e = r.select("row_id", "run_id", F.posexplode(F.concat(shown, T.json_elements("hidden_queries_json"))).alias("p", "query")).withColumn("query", F.trim("query"))
    e = e.filter(F.col("query").isNotNull() & ((F.col("p") == 0) | (F.col("query") != "")))
    return first_wins(e, ["run_id", "query"], ["row_id", "p"]).select("row_id", "run_id", "query", (F.col("p") > 0).alias("hidden"))


@query("SELECT row_id, " + ", ".join(f"CASE WHEN json_valid(sonic_classification_json) THEN try_cast(sonic_classification_json->>'$.{n}' AS DOUBLE) END AS {n}" for n in PROBABILITIES) + " FROM run_export")
def json_classification(spark: SparkSession, sf: str) -> DataFrame:
    """JSN4: named probabilities of the classification."""
    return table(spark, sf, "run_export").select("row_id", T.classification("sonic_classification_json", PROBABILITIES).alias("c")).select("row_id", "c.*")


@query(
    r"""SELECT row_id, len(list_filter(list_transform(CASE WHEN json_valid(sources_cited_json) AND json_type(sources_cited_json) = 'ARRAY' THEN json_extract(sources_cited_json, '$[*]') ELSE [] END, lambda e: CASE json_type(e) WHEN 'OBJECT' THEN CASE WHEN json_type(e, '$.url') = 'VARCHAR' THEN e->>'$.url' END WHEN 'VARCHAR' THEN e->>'$' END), lambda u: u IS NOT NULL AND u <> '')) AS n_urls FROM run_export"""
)
def json_source_counts(spark: SparkSession, sf: str) -> DataFrame:
    """JSN1, JSN3: urls in the cited panel."""
    return table(spark, sf, "run_export").select("row_id", F.size(T.source_urls("sources_cited_json")).alias("n_urls"))


@query(
    rf"""WITH l AS (SELECT row_id, {sql_literal("coalesce(sources_cited, '')")} AS a, {sql_literal("coalesce(sources_additional, '')")} AS b FROM run_export)
SELECT row_id, len(list_distinct(a))::INT AS n_distinct, len(list_distinct(list_concat(a, b)))::INT AS n_union, md5('[' || array_to_string(list_transform(a, lambda x: '''' || replace(x, '''', '\''') || ''''), ', ') || ']') AS literal_md5, (len(a) + len(b)) / 2.0::DOUBLE AS mean_size FROM l"""
)
def list_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """ARR1 to ARR5: list literals, parsed, made distinct, united and written again."""
    a, b = T.literal_list("sources_cited"), T.literal_list("sources_additional")
    return table(spark, sf, "run_export").select("row_id", F.size(T.ordered_distinct(a)).alias("n_distinct"), F.size(T.ordered_union(a, b)).alias("n_union"), F.md5(T.as_literal(a)).alias("literal_md5"), T.mean_size(F.array(a, b)).alias("mean_size"))


def _iso(c: str) -> str:
    """DAT1 in DuckDB."""
    t = rf"regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g')"
    ymd = "CASE " + " ".join(f"WHEN regexp_matches({t}, '{p}') THEN " + " || '-' || ".join(f"lpad(regexp_extract({t}, '{p}', {g}), {4 if i == 0 else 2}, '0')" for i, g in enumerate(o)) for p, o in T._DATES) + " END"
    return f"coalesce(strftime(try_strptime({ymd}, '%Y-%m-%d'), '%Y-%m-%d'), '')"


@query(
    rf"""SELECT row_id, {_iso("published_date")} AS published, CASE WHEN regexp_matches(trim(modified_date), '^\d{{4}}-\d{{2}}-\d{{2}}') THEN trim(modified_date) WHEN {_iso("modified_date")} <> '' THEN {_iso("modified_date")} || 'T00:00:00.000Z' ELSE trim(modified_date) END AS modified FROM serp_export"""
)
def date_forms(spark: SparkSession, sf: str) -> DataFrame:
    """DAT1, DAT2: dates of one of the six plain formats."""
    return table(spark, sf, "serp_export").select("row_id", T.iso_date("published_date").alias("published"), T.iso_or_raw("modified_date").alias("modified"))


@query(
    f"""WITH {SERP} SELECT domain, count(*) AS n, count(*) FILTER (domain NOT IN ({PLATFORM_SQL})) AS n_exact, count(*) FILTER (NOT (contains(domain, 'cedarsignal') OR contains(domain, 'kettle'))) AS n_host, count(*) FILTER (NOT contains(lower(url), 'compare')) AS n_url, count(*) FILTER ("position" <= 3) AS n_top3 FROM serp GROUP BY domain"""
)
def filter_platforms(spark: SparkSession, sf: str) -> DataFrame:
    """FLT9 to FLT12: exclusion by exact domain, by part of the host, by part of the url; rank threshold."""
    return serp(spark, sf).groupBy("domain").agg(
        F.count("*").alias("n"), F.count_if(~is_platform(F.col("domain"), PLATFORMS)).alias("n_exact"), F.count_if(~has_platform(F.col("domain"), PLATFORM_NAMES)).alias("n_host"),
        F.count_if(~has_platform(F.col("url"), PLATFORM_PATHS)).alias("n_url"), F.count_if(F.col("position") <= 3).alias("n_top3"),
    )


@query(
    r"""SELECT row_id, generated_search_query AS query, web_search_triggered AS triggered FROM run_export WHERE lower(trim(coalesce(generated_search_query, ''))) NOT IN ('', 'nan', 'n/a') AND web_search_triggered = true"""
)
def filter_valid_queries(spark: SparkSession, sf: str) -> DataFrame:
    """FLT1, FLT6, FLT7: rewritten queries of runs that searched."""
    r = table(spark, sf, "run_export")
    return r.filter(~F.lower(F.trim(F.coalesce("generated_search_query", F.lit("")))).isin("", "nan", "n/a") & (F.col("web_search_triggered") == F.lit(True))).select("row_id", F.col("generated_search_query").alias("query"), F.col("web_search_triggered").alias("triggered"))


@query(
    r"""SELECT coalesce(error_type, '') AS error_type, count(*) AS n, count(*) FILTER (http_status IN (0, 403, 429) OR http_status >= 500) AS n_retry, count(DISTINCT url) AS n_urls FROM label_failures GROUP BY 1"""
)
def filter_retry(spark: SparkSession, sf: str) -> DataFrame:
    """FLT16, FLT17: failures by type, and those worth another try."""
    s = F.col("http_status")
    return table(spark, sf, "label_failures").groupBy(F.coalesce("error_type", F.lit("")).alias("error_type")).agg(F.count("*").alias("n"), F.count_if(s.isin(0, 403, 429) | (s >= 500)).alias("n_retry"), F.count_distinct("url").alias("n_urls"))


@query(
    r"""SELECT row_id, CASE WHEN trim(coalesce(content, '')) = '' THEN 'no text' WHEN lower(trim(coalesce(contentError, ''))) NOT IN ('', 'nan') THEN 'error' WHEN length(trim(content)) < 200 THEN 'short' ELSE 'usable' END AS state FROM serp_export"""
)
def filter_usable(spark: SparkSession, sf: str) -> DataFrame:
    """FLT13, FLT15: usability of the content: present, without error, 200 characters or more."""
    c, e = F.trim(F.coalesce("content", F.lit(""))), F.lower(F.trim(F.coalesce("contentError", F.lit(""))))
    state = F.when(c == "", "no text").when(~e.isin("", "nan"), "error").when(F.length(c) < 200, "short").otherwise("usable")
    return table(spark, sf, "serp_export").select("row_id", state.alias("state"))


_LOW = "lower(coalesce(u, ''))"
_FULL = "CASE WHEN contains(trim(u), '://') THEN trim(u) ELSE 'https://' || trim(u) END"
_HOST = rf"regexp_replace(lower(regexp_extract({_FULL}, '^[^/?#]*//([^/?#]*)', 1)), '^www\.', '')"
_PATH = f"regexp_extract({_FULL}, '^[^/?#]*//[^/?#]*([^?#]*)', 1)"
_AD_HOST = "(" + " OR ".join(f"{_HOST} = '{h}' OR ends_with({_HOST}, '.{h}')" for h in ("doubleclick.net", "googleadservices.com", "googlesyndication.com", "adservice.google.com")) + ")"
_AD = {
    "n_ad_click": f"{_AD_HOST} OR (ends_with({_HOST}, 'bing.com') AND (starts_with({_PATH}, '/aclick') OR starts_with({_PATH}, '/clk') OR starts_with({_PATH}, '/sclk'))) OR contains({_LOW}, 'doubleclick.net/searchads')",
    "n_ad_text": " OR ".join(f"contains({_LOW}, '{x}')" for x in ("doubleclick.net", "googleadservices.com", "googlesyndication.com", "adservice.google.com", "bing.com/aclick", "bing.com/clk", "bing.com/sclk")),
    "n_ad_link": rf"regexp_matches(u, '^\s*[A-Za-z][A-Za-z0-9+.-]*:') AND ({_AD_HOST} OR (ends_with({_HOST}, 'bing.com') AND (contains({_LOW}, '/aclick') OR contains({_LOW}, '/clk') OR contains({_LOW}, '/sclk'))) OR contains({_LOW}, 'doubleclick.net/searchads'))",
}
_WRAPPED = ", ".join(f"('{n}', '{h}', {p})" for n, h, p in AD_WRAPPERS)


@query(
    "SELECT wrapper, count(*) AS n, "
    + ", ".join(f"count(*) FILTER ({rule}) AS {name}" for name, rule in _AD.items())
    + f" FROM (SELECT w.wrapper, w.head || CASE WHEN w.plain THEN coalesce(s.url, '') ELSE url_encode(coalesce(s.url, '')) END AS u FROM serp_export s CROSS JOIN (VALUES {_WRAPPED}) w(wrapper, head, plain)) GROUP BY wrapper"
)
def filter_adverts(spark: SparkSession, sf: str) -> DataFrame:
    """FLT2 to FLT4: advert rules over every result url as it is, and as advert redirects and links near them write it."""
    wrap = F.explode(F.array(*[F.struct(F.lit(n).alias("wrapper"), F.lit(h).alias("head"), F.lit(p).alias("plain")) for n, h, p in AD_WRAPPERS])).alias("w")
    s = table(spark, sf, "serp_export").select(F.coalesce("url", F.lit("")).alias("url"), wrap)
    s = s.select("w.wrapper", F.concat("w.head", F.when(F.col("w.plain"), F.col("url")).otherwise(F.url_encode("url"))).alias("u"))
    return s.groupBy("wrapper").agg(F.count("*").alias("n"), F.count_if(is_ad_click(F.col("u"))).alias("n_ad_click"), F.count_if(is_ad_text(F.col("u"))).alias("n_ad_text"), F.count_if(is_ad_link(F.col("u"))).alias("n_ad_link"))


@query(
    r"""SELECT count(*) AS n, count(*) FILTER (NOT contains(coalesce(url, ''), 'google.com/search') AND NOT starts_with(coalesce(url, ''), 'javascript:')) AS n_external, count(*) FILTER (NOT contains(coalesce(url, ''), 'bing.com/ck/')) AS n_decoded,
 count(*) FILTER (regexp_matches(coalesce(snippet, ''), '(?i)^\s*sponsored\b') OR regexp_matches(coalesce(content, ''), 'adsMv|b_ads|ad_em')) AS n_sponsored,
 count(*) FILTER (contains(lower(coalesce(page_title, '')), 'just a moment') OR contains(coalesce(content, ''), 'Verifying you are human') OR contains(coalesce(content, ''), 'Checking your browser') OR contains(coalesce(content, ''), 'DDoS protection by') OR contains(coalesce(url, ''), 'google.com/sorry/index')) AS n_challenge FROM serp_export"""
)
def filter_results(spark: SparkSession, sf: str) -> DataFrame:
    """FLT5, FLT20 to FLT22: sponsored blocks, internal and undecoded links, challenge pages."""
    u = F.coalesce("url", F.lit(""))
    return table(spark, sf, "serp_export").agg(
        F.count("*").alias("n"), F.count_if(~F.contains(u, F.lit("google.com/search")) & ~u.startswith("javascript:")).alias("n_external"), F.count_if(~F.contains(u, F.lit("bing.com/ck/"))).alias("n_decoded"),
        F.count_if(is_sponsored(F.col("snippet"), F.col("content"))).alias("n_sponsored"), F.count_if(is_challenge(F.col("page_title"), F.col("content"), u)).alias("n_challenge"),
    )


@query(
    "SELECT row_id, "
    + ", ".join(f"{rule} AS missing_{mode}" for mode, rule in (("type", "t"), ("content", "c"), ("both", "(t AND c)"), ("any", "(t OR c)")))
    + " FROM (SELECT row_id, trim(coalesce(schema_types, '')) = '' AS t, trim(coalesce(content, '')) = '' AS c FROM serp_export)"
)
def filter_missing(spark: SparkSession, sf: str) -> DataFrame:
    """FLT13: pages without type, content, both or any, by mode."""
    return table(spark, sf, "serp_export").select("row_id", *[is_missing(m, F.col("schema_types"), F.col("content")).alias(f"missing_{m}") for m in ("type", "content", "both", "any")])


@query(
    r"""SELECT DISTINCT query FROM serp_export s WHERE NOT EXISTS (SELECT 1 FROM deep_results d WHERE d.query = s.query) AND query IS NOT NULL"""
)
def filter_membership(spark: SparkSession, sf: str) -> DataFrame:
    """FLT8, JON10: queries without later result pages."""
    return table(spark, sf, "serp_export").filter("query IS NOT NULL").select("query").distinct().join(table(spark, sf, "deep_results").select("query"), "query", "left_anti")
