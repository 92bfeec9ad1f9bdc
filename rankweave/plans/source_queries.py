"""Queries of sources, sinks, label tables and nested columns: tables written in a file form and read back, labels taken apart.

The files lie in the shared folder and go when the application ends.
"""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.text import fetch_error, fill_template, literal_list
from rankweave.functions.urls import short_hash
from rankweave.operators.html import text_lines
from rankweave.operators.labels import failures, host_bias, label_tables, to_label_int, unlabelled
from rankweave.operators.merge import drop_unreferenced, ensure_columns
from rankweave.operators.setops import top_k
from rankweave.plans.base import CITATIONS, DEEP, RUNS, SERP, citations, deep, runs, serp, sql_literal
from rankweave.session import fresh_path, table
from rankweave.sources import files as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TEXTS = ["title", "snippet", "domain", "content"]


@query("SELECT row_id::VARCHAR AS row_id, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in _TEXTS) + " FROM serp_export")
def src_csv(spark: SparkSession, sf: str) -> DataFrame:
    """SRC1 to SRC3, SNK1: texts with quotes and line breaks as CSV and back."""
    path = fresh_path(spark, "csv")
    S.write_csv(table(spark, sf, "serp_export").select(*_TEXTS, "row_id"), path, preferred=["row_id"])
    return S.read_csv(spark, path)


@query(r"""SELECT row_id::VARCHAR AS row_id, regexp_replace(coalesce(content, ''), '[\r\n]+', ' ', 'g') AS content FROM serp_export""")
def src_csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    """SRC4, SNK2, SNK2b: every field quoted and on one line."""
    path = fresh_path(spark, "csv")
    S.write_csv(table(spark, sf, "serp_export").select("row_id", "content"), path, quote_all=True, one_line=True)
    return S.read_csv(spark, path, squash=("content",))


@query("""SELECT trim(prompt_id) AS prompt_id, regexp_replace(trim(query), '^"|"$', '', 'g') AS query FROM prompts""")
def src_first_comma(spark: SparkSession, sf: str) -> DataFrame:
    """SRC5, SRC6: prompts as lines that are cut at the first comma only."""
    path = fresh_path(spark, "lines")
    table(spark, sf, "prompts").select(F.concat_ws(",", "prompt_id", "query").alias("value")).write.mode("overwrite").text(path)
    return S.read_first_comma(spark, path)


@query("SELECT prompt_id, query, product FROM prompts")
def src_sqlite(spark: SparkSession, sf: str) -> DataFrame:
    """SRC9: prompts (a fixed table) in a database file and back."""
    S.register(spark)
    path = fresh_path(spark, "database").removeprefix("file://").removeprefix("file:") + "/prompts.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE prompts (prompt_id TEXT, query TEXT, product TEXT)")
        db.executemany("INSERT INTO prompts VALUES (?, ?, ?)", [tuple(r) for r in table(spark, sf, "prompts").select("prompt_id", "query", "product").collect()])
    return spark.read.format("sqlite").option("path", path).option("query", "SELECT prompt_id, query, product FROM prompts").load()


@query("SELECT doc_id, text, source, n_chars FROM documents UNION ALL SELECT doc_id, text, source, n_chars FROM documents WHERE lang = 'en'")
def src_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """SRC10, SNK4: JSON lines, appended to and read back."""
    path, docs = fresh_path(spark, "log"), table(spark, sf, "documents")
    for part in (docs, docs.filter("lang = 'en'")):
        S.append_jsonl(part.select("doc_id", "text", "source", "n_chars"), path)
    return S.read_jsonl(spark, path, "doc_id bigint, text string, source string, n_chars bigint")


@query(
    """SELECT 0 AS file_no, count(*) AS n, count(DISTINCT run_id) AS n_runs FROM deep_results UNION ALL SELECT 2, count(*), count(DISTINCT run_id) FROM serp_export"""
)
def src_matching(spark: SparkSession, sf: str) -> DataFrame:
    """SRC11: of three CSV folders those with the needed columns, united by name."""
    root = fresh_path(spark, "folders")
    for name, df in (("a", table(spark, sf, "deep_results")), ("b", table(spark, sf, "prompts")), ("c", table(spark, sf, "serp_export").select("run_id", "url", "position"))):
        S.write_csv(df, f"{root}/{name}")
    m = S.read_matching(spark, [f"{root}/{n}" for n in "abc"], ["run_id", "url"])
    return m.groupBy("file_no").agg(F.count("*").alias("n"), F.count_distinct(F.nullif("run_id", F.lit(""))).alias("n_runs"))


@query("""SELECT md5(content) AS hash, length(content) AS size FROM serp_export WHERE trim(coalesce(content, '')) <> '' GROUP BY content""")
def src_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """SRC12, SNK3, SNK5: contents under their hash, each stored once though written twice, in a version of its own."""
    path = fresh_path(spark, "snapshots")
    rows = table(spark, sf, "serp_export").select("row_id", "content", F.md5("content").alias("key"))
    for _ in range(2):
        S.write_snapshots(rows, "key", "content", "row_id", path)
    stored = spark.read.parquet(path).select("hash", F.length("text").alias("size"))
    return spark.read.parquet(S.write_version(stored, fresh_path(spark, "versions")))


TEMPLATE = "Label the page {{url}} by its title and text.\nTitle: {{title}}\nText: {{content}}"


@query(
    """SELECT row_id, md5('Label the page ' || left(coalesce(url, ''), 12000) || ' by its title and text.' || chr(10) || 'Title: ' || left(coalesce(title, ''), 12000) || chr(10) || 'Text: ' || left(coalesce(content, ''), 12000)) AS prompt_md5 FROM serp_export"""
)
def lbl_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """STR13: the prompt of every page."""
    return table(spark, sf, "serp_export").select("row_id", F.md5(fill_template(TEMPLATE, url=F.col("url"), title=F.col("title"), content=F.col("content"))).alias("prompt_md5"))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers as models write them: fenced JSON of a page's labels and products, each product twice; every seventh is cut."""
    product = lambda k: F.struct(F.lit(str(k)).alias("position_in_listicle"), F.concat("title", F.lit(f" {k}")).alias("product_name"), F.col("domain").alias("product_domain"))
    label = F.struct(
        F.struct(F.coalesce("schema_types", F.lit("")).alias("type"), F.col("table_count").cast("string").alias("promotional_intensity_score")).alias("urls"),
        F.when(F.col("table_count") > 0, F.struct(F.col("title").alias("title"), F.lit("2.0").alias("n_products_listed"))).alias("listicles"),
        F.array(product(1), product(2), product(1)).alias("listicle_products"),
    )
    text = F.concat(F.lit("```json\n"), F.to_json(label), F.lit("\n```"))
    pages = table(spark, sf, "serp_export").filter("title IS NOT NULL").select(F.col("row_id").cast("string").alias("url"), F.when(F.col("row_id") % 7 == 0, F.lit('```json\n{"urls": {"type": "cu')).otherwise(text).alias("response"))
    return pages


_SQL_PAGES = "SELECT row_id::VARCHAR AS url, coalesce(schema_types, '') AS type, table_count, title, domain FROM serp_export WHERE title IS NOT NULL AND row_id % 7 <> 0"


@query(f"SELECT url, type, table_count AS intensity FROM ({_SQL_PAGES})")
def lbl_urls(spark: SparkSession, sf: str) -> DataFrame:
    """LLM2, LLM7: labels of the pages from the answers that can be read, scores as whole numbers."""
    urls, _, _ = label_tables(_answers(spark, sf), "url", "response")
    return urls.select("url", "type", to_label_int(F.col("promotional_intensity_score")).alias("intensity"))


@query(f"SELECT url AS listicle_url, title, 2 AS n_listed FROM ({_SQL_PAGES}) WHERE table_count > 0")
def lbl_listicles(spark: SparkSession, sf: str) -> DataFrame:
    """LLM3: lists of products that the answers describe."""
    _, lists, _ = label_tables(_answers(spark, sf), "url", "response")
    return lists.select("listicle_url", "title", to_label_int(F.col("n_products_listed")).alias("n_listed"))


@query(f"SELECT url AS listicle_url, k::VARCHAR AS position, title || ' ' || k AS name FROM ({_SQL_PAGES}) CROSS JOIN (VALUES (1), (2)) p(k)")
def lbl_products(spark: SparkSession, sf: str) -> DataFrame:
    """LLM5: products of the lists, each once."""
    _, _, products = label_tables(_answers(spark, sf), "url", "response")
    return products.select("listicle_url", F.col("position_in_listicle").alias("position"), F.col("product_name").alias("name"))


@query(f"SELECT url AS listicle_url FROM ({_SQL_PAGES}) WHERE domain IS NOT NULL")
def lbl_host_bias(spark: SparkSession, sf: str) -> DataFrame:
    """LLM8: lists that put a product of their own host first."""
    _, _, products = label_tables(_answers(spark, sf), "url", "response")
    host = table(spark, sf, "serp_export").select(F.col("row_id").cast("string").alias("listicle_url"), F.col("domain").alias("listicle_domain"))
    return host_bias(products.join(host, "listicle_url"))


@query("SELECT url, error_type, http_status FROM label_failures WHERE coalesce(error_type, '') <> ''")
def lbl_failed(spark: SparkSession, sf: str) -> DataFrame:
    """LLM6: the failures of a log in which rows without an error count as answered."""
    log = table(spark, sf, "label_failures").withColumn("ok", F.coalesce("error_type", F.lit("")) == "")
    return failures(log).select("url", "error_type", "http_status")


@query(
    """WITH u AS (SELECT url, max(coalesce(schema_types, '')) AS type FROM serp_export WHERE url IS NOT NULL GROUP BY 1) SELECT url FROM u WHERE trim(type) = '' AND url NOT IN (SELECT url FROM deep_results WHERE url IS NOT NULL) AND url NOT IN (SELECT url FROM label_failures WHERE url IS NOT NULL)"""
)
def lbl_unlabelled(spark: SparkSession, sf: str) -> DataFrame:
    """FLT18, STM2: urls without a type that are neither done (here: among the later pages) nor failed."""
    urls = table(spark, sf, "serp_export").filter("url IS NOT NULL").groupBy("url").agg(F.max(F.coalesce("schema_types", F.lit(""))).alias("type"))
    return unlabelled(urls, table(spark, sf, "deep_results").filter("url IS NOT NULL"), table(spark, sf, "label_failures").filter("url IS NOT NULL"), "url").select("url")


@query(f"WITH {CITATIONS}, {SERP}, {DEEP} SELECT DISTINCT key, substr(sha256(key), 1, 16) AS hash FROM serp WHERE key IN (SELECT key FROM citations) OR key IN (SELECT key FROM deep)")
def mrg_referenced(spark: SparkSession, sf: str) -> DataFrame:
    """MRG17: result pages that a citation or a later result page still refers to."""
    pages = serp(spark, sf).select("key").distinct()
    return drop_unreferenced(pages, "key", [citations(spark, sf), deep(spark, sf)]).select("key", short_hash("key").alias("hash"))


@query("SELECT NULL::VARCHAR AS added, page_num::BIGINT AS page_num, run_id, url FROM deep_results")
def mrg_missing_columns(spark: SparkSession, sf: str) -> DataFrame:
    """MRG20: a table brought to a schema with one column more."""
    want = spark.createDataFrame([], "added string, page_num bigint, run_id string").schema
    return ensure_columns(table(spark, sf, "deep_results").select("run_id", "page_num", "url"), want)

@query(
    """SELECT url, CASE WHEN error_type = 'AbortError' THEN 'Request timeout' WHEN contains(coalesce(error_message, ''), 'Failed to fetch') THEN 'Network error or blocked' WHEN contains(coalesce(error_message, ''), 'NetworkError') THEN 'Network error'
 WHEN contains(coalesce(error_message, ''), 'TypeError') THEN 'Invalid URL or network error' ELSE coalesce(error_message, '') END AS error FROM label_failures"""
)
def src_fetch_errors(spark: SparkSession, sf: str) -> DataFrame:
    """SRC13: what an error of a fetch is called."""
    return table(spark, sf, "label_failures").select("url", fetch_error("error_type", "error_message").alias("error"))


_COUNTED = " UNION ALL ".join(f"SELECT prompt_id, '{c}' AS c, unnest({sql_literal(f'''coalesce({c}, '')''')}) AS domain FROM runs" for c in ("domains_cited", "domains_additional"))


@query(
    f"""WITH {RUNS}, d AS ({_COUNTED}), n AS (SELECT p.product, d.domain, count(*) FILTER (c = 'domains_cited') AS domains_cited, count(*) FILTER (c = 'domains_additional') AS domains_additional, count(*) AS domains_all FROM d JOIN prompts p USING (prompt_id) WHERE trim(domain) <> '' GROUP BY 1, 2)
SELECT product, rank, domain, domains_cited, domains_additional, domains_all FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY domains_all DESC, domain) AS rank FROM n) WHERE rank <= 10"""
)
def cnt_domain_columns(spark: SparkSession, sf: str) -> DataFrame:
    """CNT5: of each product the ten most frequent domains over two nested columns, ``domains_all`` being their sum; ties by name."""
    columns = ("domains_cited", "domains_additional")
    r = runs(spark, sf).select("prompt_id", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), literal_list(c).alias("l")) for c in columns])).alias("s"))
    d = r.select("prompt_id", "s.c", F.explode("s.l").alias("domain")).filter(F.trim("domain") != "").join(table(spark, sf, "prompts").select("prompt_id", "product"), "prompt_id")
    n = d.groupBy("product", "domain").agg(*[F.count_if(F.col("c") == c).alias(c) for c in columns], F.count("*").alias("domains_all"))
    return top_k(n, ["product"], [F.col("domains_all").desc(), F.col("domain")], 10)


@query(
    r"""WITH l AS (SELECT row_id, trim(regexp_replace(unnest(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(content, ''), '(?is)<(?:script|style|noscript)\b.*?</(?:script|style|noscript)\s*>', chr(10), 'g'), '(?i)</?(?:p|div|li|br|tr|td|th|h[1-6]|section|article|header|footer|main|aside)\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g'), chr(10))), '\s+', ' ', 'g')) AS s FROM serp_export),
m AS (SELECT row_id, lower(s) AS s, length(s) AS n, length(regexp_replace(s, '[^\p{L}]', '', 'g')) AS k FROM l)
SELECT row_id, count(*) FILTER (s <> '' AND NOT (regexp_matches(s, '^(?:@layer |@media |@supports |:root|--|function\()') OR (contains(s, 'css') AND contains(s, '}')) OR regexp_matches(s, 'var\(--|--color-|--font-|webpack|window\.__') OR (k <= 5 AND n > 40) OR (k > 0 AND (n - k) / k > 2.5))) AS n_lines FROM m GROUP BY 1"""
)
def htm_lines(spark: SparkSession, sf: str) -> DataFrame:
    """HTM3: lines of text that patterns leave, block tags being line breaks and lines of code or marks left out."""
    return table(spark, sf, "serp_export").select("row_id", F.size(text_lines(F.col("content"))).cast("bigint").alias("n_lines"))
