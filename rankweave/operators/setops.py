"""First-wins deduplication, ranking and cleaning. Order always comes from explicit columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankweave.functions.urls import url_key1

NO_POSITION = 1_000_000_000


def position_of(x: Column | str) -> Column:
    """A rank; what is no whole number sorts last."""
    c = F.col(x) if isinstance(x, str) else x
    t = F.trim(c.cast("string"))
    return F.coalesce(F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("int")), F.lit(NO_POSITION))


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; ``order`` must be total."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def latest_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return first_wins(df, keys, [F.col(c).desc() for c in order])


def shortest_wins(df: DataFrame, key: str, url: str, order: str) -> DataFrame:
    """The row with the shortest url of each key, the first of equals."""
    return first_wins(df, [key], [F.length(url), F.col(order)])


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each key, numbered."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def renumbered(df: DataFrame, keys: list[str], order: list, name: str, cap: int | None = None) -> DataFrame:
    """Strict numbers from 1 within each key."""
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return out if cap is None else out.filter(F.col(name) <= cap)


# Hosts of adverts, and paths of click counters.
AD_HOSTS = ("doubleclick.net", "googleadservices.com", "googlesyndication.com", "adservice.google.com")
AD_PATHS = ("/aclick", "/clk", "/sclk")


def _host_and_rest(url: Column) -> tuple[Column, Column]:
    """Host without ``www.`` and what follows it, of a url with or without scheme."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    full = F.when(F.contains(raw, F.lit("://")), raw).otherwise(F.concat(F.lit("https://"), raw))
    host = F.regexp_replace(F.lower(F.regexp_extract(full, r"^[^/?#]*//([^/?#]*)", 1)), r"^www\.", "")
    return host, F.regexp_extract(full, r"^[^/?#]*//[^/?#]*(.*)$", 1)


def _on(host: Column, names: tuple[str, ...]) -> Column:
    return reduce(or_, [(host == h) | host.endswith("." + h) for h in names])


def is_ad_click(url: Column) -> Column:
    """FLT2: adverts by host, and click counters of bing hosts by the start of their path."""
    host, rest = _host_and_rest(url)
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    return _on(host, AD_HOSTS) | (host.endswith("bing.com") & reduce(or_, [path.startswith(x) for x in AD_PATHS])) | F.contains(F.lower(F.coalesce(url, F.lit(""))), F.lit("doubleclick.net/searchads"))


def is_ad_text(url: Column) -> Column:
    """FLT3: the substring form, for urls and domains."""
    u = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    return reduce(or_, [F.contains(u, F.lit(x)) for x in (*AD_HOSTS, *("bing.com" + x for x in AD_PATHS))])


def is_ad_link(url: Column) -> Column:
    """FLT4: as FLT2 for absolute urls only, with the click paths anywhere in the url."""
    host, _ = _host_and_rest(url)
    u = F.lower(F.coalesce(url, F.lit("")))
    ad = _on(host, AD_HOSTS) | (host.endswith("bing.com") & reduce(or_, [F.contains(u, F.lit(x)) for x in AD_PATHS])) | F.contains(u, F.lit("doubleclick.net/searchads"))
    return ad & F.coalesce(url, F.lit("")).rlike(r"^\s*[A-Za-z][A-Za-z0-9+.-]*:")


# Class names of sponsored blocks.
SPONSORED_CLASS = r"adsMv|b_ads|ad_em"


def is_sponsored(text: Column, html: Column | None = None) -> Column:
    """FLT5: a block whose text starts with the label, or whose markup has the classes of one."""
    by_text = F.coalesce(text, F.lit("")).rlike(r"(?i)^\s*sponsored\b")
    return by_text if html is None else by_text | F.coalesce(html, F.lit("")).rlike(SPONSORED_CLASS)


def is_challenge(title: Column, text: Column, url: Column) -> Column:
    """FLT22: pages that want to see a human first: by title, body or url."""
    body, none = F.coalesce(text, F.lit("")), F.lit("")
    phrases = ("Verifying you are human", "Checking your browser", "DDoS protection by")
    return F.contains(F.lower(F.coalesce(title, none)), F.lit("just a moment")) | reduce(or_, [F.contains(body, F.lit(x)) for x in phrases]) | F.contains(F.coalesce(url, none), F.lit("google.com/sorry/index"))


def is_platform(domain: Column, names: list[str] | tuple[str, ...]) -> Column:
    """FLT9: exactly one of the named platforms; NULL for a NULL domain."""
    return domain.isin(*names)


def has_platform(text: Column, names: list[str] | tuple[str, ...]) -> Column:
    """FLT10 (of a host), FLT11 (of a url): one of the names anywhere in it."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(or_, [F.contains(low, F.lit(n.lower())) for n in names], F.lit(False))


def is_missing(mode: str, type_: Column, content: Column) -> Column:
    """FLT13: pages that lack their ``type``, their ``content``, ``both``, or ``any`` of the two."""
    blank = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""
    t, c = blank(type_), blank(content)
    return {"type": t, "content": c, "both": t & c, "any": t | c}[mode]


def cleaned(serp: DataFrame, top_n: int, order: str = "row_id") -> DataFrame:
    """WIN2: per run and query the first row of each page by position, ads and undecodable urls left out, the best ``top_n`` renumbered."""
    rows = serp.withColumn("_pos", position_of("position")).withColumn("_key", url_key1(F.col("url")))
    rows = rows.filter((F.trim(F.coalesce("url", F.lit(""))) != "") & (F.col("_key") != "") & ~is_ad_click(F.col("url")))
    kept = first_wins(rows, ["run_id", "query", "_key"], ["_pos", order])
    return renumbered(kept, ["run_id", "query"], ["_pos", order], "clean_position", top_n).withColumn("clean_key", F.col("_key")).drop("_pos", "_key")
