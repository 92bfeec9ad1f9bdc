"""Relations of the study over the given tables, in Spark and as DuckDB text.

``runs`` (one row per run, the first export wins), ``citations`` (one row per cited source),
``serp`` (ranked results with key and domain), ``deep`` (later result pages).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.text import canonical_run_id, run_id, source_urls
from rankweave.functions.urls import ALL_TRACKING, domain1, url_key2
from rankweave.operators.setops import first_wins, position_of
from rankweave.session import table

PLATFORMS = ("cedarsignal.example", "kettlepost.example", "velvetlane.example")  # sites that host many, as app stores do


def runs(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "run_export").withColumn("run_id", run_id("prompt_id", "run_number", "query_index")).filter("run_number IS NOT NULL")
    return first_wins(r, ["run_id"], ["row_id"]).withColumn("prompt_id", F.regexp_extract("run_id", r"^(.*)_r\d+$", 1))


def citations(spark: SparkSession, sf: str) -> DataFrame:
    r = runs(spark, sf).select("run_id", "prompt_id", source_urls("sources_cited_json").alias("cited"), source_urls("sources_additional_json").alias("additional"))
    at = F.explode(F.array(F.struct(F.lit("cited").alias("section"), F.col("cited").alias("urls")), F.struct(F.lit("additional").alias("section"), F.col("additional").alias("urls"))))
    flat = r.select("run_id", "prompt_id", at.alias("s")).select("run_id", "prompt_id", "s.section", F.posexplode("s.urls").alias("_p", "url"))
    return flat.select("run_id", "prompt_id", "section", (F.col("_p") + 1).alias("cite_position"), "url", url_key2("url").alias("key"), domain1("url").alias("domain"))


def serp(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "serp_export").filter(F.trim(F.coalesce("url", F.lit(""))) != "")
    return s.select(canonical_run_id("run_id").alias("run_id"), "query", position_of("position").alias("position"), "row_id", "title", "url", url_key2("url").alias("key"), domain1("url").alias("domain"))


def deep(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "deep_results").filter(F.trim(F.coalesce("url", F.lit(""))) != "")
    return d.select(canonical_run_id("run_id").alias("run_id"), "query", "position", "page_num", "url", url_key2("url").alias("key"), domain1("url").alias("domain"))


# The same in DuckDB.

_P = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_DROP = ", ".join(f"'{x}'" for x in ALL_TRACKING)


def _dec(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def _enc(x: str) -> str:
    return f"replace(url_encode({_dec(x)}), '%20', '+')"


def sql_text(u: str) -> str:
    return rf"regexp_replace(coalesce({u}, ''), '^\s+|\s+$', '', 'g')"


def sql_full(u: str) -> str:
    t = sql_text(u)
    return f"CASE WHEN contains({t}, '://') THEN {t} ELSE 'https://' || {t} END"


def sql_key(u: str, drop: str = _DROP, port: bool = True, microsoft: bool = False) -> str:
    """URL2, and with other parameters URL3 to URL6."""
    name = _dec("split_part(kv, '=', 1)")
    host = rf"regexp_replace(lower(regexp_extract(f, '{_P}', 1)), '^www\.', '')"
    if not port:
        host = rf"regexp_replace(regexp_replace({host}, '^[^@]*@', ''), ':\d+$', '')"
    store = f" AND NOT ({host} = 'apps.microsoft.com' AND lower({name}) IN ('hl', 'gl'))" if microsoft else ""
    query = f"array_to_string(list_transform(list_filter(string_split(regexp_extract(f, '{_P}', 3), '&'), lambda kv: kv <> '' AND NOT starts_with(lower({name}), 'utm_') AND lower({name}) NOT IN ({drop}){store}), lambda kv: {_enc('''split_part(kv, '=', 1)''')} || '=' || {_enc('''regexp_extract(kv, '=(.*)$', 1)''')}), '&')"
    path = f"CASE WHEN regexp_extract(f, '{_P}', 2) = '' THEN '/' WHEN length(regexp_extract(f, '{_P}', 2)) > 1 THEN regexp_replace(regexp_extract(f, '{_P}', 2), '/$', '') ELSE regexp_extract(f, '{_P}', 2) END"
    key = f"list_transform([{sql_full(u)}], lambda f: {host} || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END)[1]"
    stripped = f"ltrim({key}, '/')" if port else key
    return f"CASE WHEN {sql_text(u)} = '' THEN '' ELSE {stripped} END"


def sql_part(u: str, n: int) -> str:
    return f"regexp_extract({u}, '{_P}', {n})"


def sql_key8(u: str) -> str:
    """URL8."""
    t = f"lower({sql_text(u)})"
    return rf"regexp_replace(regexp_replace(CASE WHEN contains({t}, '://') THEN split_part({t}, '://', 2) ELSE {t} END, '^www\.', ''), '/$', '')"


def sql_literal(c: str) -> str:
    """ARR1: the strings of a Python list literal."""
    quoted = r"""(?:'''(?:[^''\\]|\\.)*''|"(?:[^"\\]|\\.)*")""".replace("'''", "''", 1)
    return rf"list_transform(regexp_extract_all(CASE WHEN starts_with({c}, '[') AND ends_with({c}, ']') THEN {c} ELSE '' END, '{quoted}'), lambda x: regexp_replace(substr(x, 2, length(x) - 2), '\\(.)', '\1', 'g'))"


def sql_domain(u: str) -> str:
    """DOM1."""
    return rf"CASE WHEN {sql_text(u)} = '' THEN '' ELSE regexp_replace(lower(regexp_extract({sql_full(u)}, '{_P}', 1)), '^www\.', '') END"


def sql_run(x: str) -> str:
    return rf"regexp_replace(trim({x}), '_[rR]0*(\d+)$', '_r\1')"


def _sources(c: str) -> str:
    inner = f"list_filter(list_transform(CASE WHEN json_valid({c}) AND json_type({c}) = 'ARRAY' THEN json_extract({c}, '$[*]') ELSE [] END, lambda e: CASE json_type(e) WHEN 'OBJECT' THEN CASE WHEN json_type(e, '$.url') = 'VARCHAR' THEN e->>'$.url' END WHEN 'VARCHAR' THEN e->>'$' END), lambda u: u IS NOT NULL AND u <> '')"
    return inner


RUNS = """runs_ AS (SELECT *, coalesce(nullif(trim(prompt_id), ''), printf('P%04d', query_index)) || '_r' || run_number AS rid FROM run_export WHERE run_number IS NOT NULL),
runs AS (SELECT * EXCLUDE (rn, prompt_id), regexp_extract(rid, '^(.*)_r\\d+$', 1) AS prompt_id, rid AS run_id FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY row_id) AS rn FROM runs_) WHERE rn = 1)"""
CITATIONS = (
    RUNS
    + f""",
cit_ AS (SELECT run_id, prompt_id, 'cited' AS section, {_sources("sources_cited_json")} AS urls FROM runs UNION ALL SELECT run_id, prompt_id, 'additional', {_sources("sources_additional_json")} FROM runs),
cit__ AS (SELECT run_id, prompt_id, section, unnest(range(1, len(urls) + 1)) AS cite_position, unnest(urls) AS url FROM cit_),
citations AS (SELECT run_id, prompt_id, section, cite_position, url, {sql_key("url")} AS key, {sql_domain("url")} AS domain FROM cit__)"""
)
SERP = f"""serp AS (SELECT {sql_run("run_id")} AS run_id, query, coalesce(CASE WHEN regexp_matches(trim("position"), '^[+-]?\\d+$') THEN try_cast(trim("position") AS INTEGER) END, 1000000000) AS "position", row_id, title, url, {sql_key("url")} AS key, {sql_domain("url")} AS domain FROM serp_export WHERE trim(coalesce(url, '')) <> '')"""
DEEP = f"""deep AS (SELECT {sql_run("run_id")} AS run_id, query, "position", page_num, url, {sql_key("url")} AS key, {sql_domain("url")} AS domain FROM deep_results WHERE trim(coalesce(url, '')) <> '')"""
PLATFORM_SQL = ", ".join(f"'{p}'" for p in PLATFORMS)
