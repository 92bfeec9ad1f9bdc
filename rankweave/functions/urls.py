"""URL keys and domains as Column expressions.

Each variant is a function of its own: a join is only reproducible with the key it was made with.
No ``parse_url``: it keeps the host's case and gives NULL for hosts that the key rules accept.
A NULL or blank url has the key ``''``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tracking parameters of the key rules.
CLICK = ("gclid", "fbclid", "msclkid", "yclid")
MAIL = ("mc_cid", "mc_eid", "igshid")
ALL_TRACKING = (*CLICK, *MAIL, "ref", "ref_src", "spm")

_SPLIT = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _text(url: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_c(url), F.lit("")), r"^\s+|\s+$", "")


def _with_scheme(url: Column, scheme: str = "https://") -> Column:
    return F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit(scheme), url))


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _SPLIT, n)


def netloc(url: Column | str) -> Column:
    return _part(_with_scheme(_text(url)), 1)


def _bare_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def _encoded(x: Column) -> Column:
    """Percent-encoding of form data: as Python and browsers write it."""
    plain = F.coalesce(F.try_url_decode(x), x)
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_kept(query: Column, drop: tuple[str, ...], prefix: str = "utm_", extra: Column | None = None) -> Column:
    """The query without tracking parameters, in order, re-encoded; blank values stay."""
    pairs = F.filter(F.split(query, "&"), lambda kv: kv != "")
    name = lambda kv: F.coalesce(F.try_url_decode(F.split_part(kv, F.lit("="), F.lit(1))), F.split_part(kv, F.lit("="), F.lit(1)))

    def keep(kv: Column) -> Column:
        ok = ~F.lower(name(kv)).startswith(prefix) & ~F.lower(name(kv)).isin(*drop)
        return ok if extra is None else ok & ~(extra & F.lower(name(kv)).isin("hl", "gl"))

    return F.array_join(F.transform(F.filter(pairs, keep), lambda kv: F.concat(_encoded(F.split_part(kv, F.lit("="), F.lit(1))), F.lit("="), _encoded(F.regexp_extract(kv, r"=(.*)$", 1)))), "&")


def _assembled(host: Column, path: Column, query: Column) -> Column:
    path = F.when(path == "", "/").otherwise(path)
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def _key(url: Column | str, drop: tuple[str, ...], port: bool = True, microsoft: bool = False) -> Column:
    raw = _text(url)
    full = _with_scheme(raw)
    host = _bare_host(_part(full, 1))
    if not port:
        host = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":\d+$", "")
    query = query_kept(_part(full, 3), drop, extra=(host == "apps.microsoft.com") if microsoft else None)
    key = _assembled(host, _part(full, 2), query)
    return F.when(raw == "", F.lit("")).otherwise(F.ltrim(key, F.lit("/")) if port else key)


def decode_redirect(url: Column | str) -> Column:
    """URL12: the target of a click-tracking redirect; '' if it cannot be decoded; other urls unchanged."""
    raw = _text(url)
    full = _with_scheme(raw)
    is_redirect = _bare_host(_part(full, 1)).rlike(r"(?:^|\.)bing\.com$") & _part(full, 2).startswith("/ck/a")
    coded = F.regexp_extract(_part(full, 3), r"(?:^|&)u=a1([^&]*)", 1)
    plain = F.try_to_binary(F.translate(coded, "-_", "+/"), F.lit("base64")).cast("string")
    return F.when(is_redirect, F.when(F.coalesce(plain, F.lit("")).startswith("http"), plain).otherwise(F.lit(""))).otherwise(raw)


def url_key1(url: Column | str) -> Column:
    """URL1: canonical key, redirects decoded."""
    return _key(decode_redirect(url), ALL_TRACKING)


def url_key2(url: Column | str) -> Column:
    """URL2: as URL1 without decoding."""
    return _key(url, ALL_TRACKING)


def url_key3(url: Column | str) -> Column:
    """URL3: fewer tracking parameters."""
    return _key(url, (*CLICK, "ref"))


def url_key4(url: Column | str) -> Column:
    """URL4: host without port."""
    return _key(url, (*CLICK, *MAIL, "ref", "ref_src"), port=False)


def url_key5(url: Column | str) -> Column:
    """URL5: as URL4, ``ref`` and ``ref_src`` kept."""
    return _key(url, (*CLICK, *MAIL), port=False)


def url_key6(url: Column | str) -> Column:
    """URL6: as URL5, test parameters dropped; no language parameters on an app store."""
    return _key(url, (*CLICK, *MAIL, "test_uuid", "test_variant"), port=False, microsoft=True)


def url_key7(url: Column | str) -> Column:
    """URL7: the whole url in lower case without fragment and test parameters; scheme and www stay."""
    raw = F.lower(F.regexp_replace(_text(url), r"#.*$", ""))
    head, query = F.split_part(raw, F.lit("?"), F.lit(1)), F.regexp_extract(raw, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda kv: ~F.split_part(kv, F.lit("="), F.lit(1)).isin("test_uuid", "test_variant")), "&")
    return F.regexp_replace(F.concat(head, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))), "/$", "")


def url_key8(url: Column | str) -> Column:
    """URL8: lower case, scheme and www cut, one trailing slash cut, query kept."""
    low = F.lower(_text(url))
    rest = F.when(F.contains(low, F.lit("://")), F.split_part(low, F.lit("://"), F.lit(2))).otherwise(low)
    return F.regexp_replace(F.regexp_replace(rest, r"^www\.", ""), "/$", "")


def url_key9(url: Column | str) -> Column:
    """URL9: cut at the first ``?``, all trailing slashes cut; scheme and www stay."""
    return F.regexp_replace(F.split_part(F.lower(_text(url)), F.lit("?"), F.lit(1)), "/+$", "")


def url_key10(url: Column | str) -> Column:
    """URL10: host and path in lower case; query dropped."""
    full = _with_scheme(F.lower(_text(url)))
    return F.when(_text(url) == "", F.lit("")).otherwise(F.concat(F.regexp_replace(_part(full, 1), r"^www\.", ""), F.regexp_replace(_part(full, 2), "/+$", "")))


# Parameters that the saved-page tools delete.
LINK_TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source")


def clean_url(url: Column | str, drop: tuple[str, ...] = LINK_TRACKING) -> Column:
    """URL11: a web url without the named parameters; anything else as it is."""
    raw = F.coalesce(_c(url), F.lit(""))
    head, query, mark = F.regexp_extract(raw, r"^([^?#]*)", 1), F.regexp_extract(raw, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(raw, r"(#.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda kv: (kv != "") & ~F.split_part(kv, F.lit("="), F.lit(1)).isin(*drop)), "&")
    return F.when(raw.startswith("http"), F.concat(head, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")), mark)).otherwise(raw)


def decode_any(url: Column | str) -> Column:
    """URL13: the target of a bing redirect in any of its encodings: plain, base64 after the mark ``a1`` or after one to four
    other marks, hex, then base64 in the path; cleaned; NULL for other urls and where there is none."""
    raw = _text(url)
    value = F.regexp_extract(raw, r"[?&]u=([^&#]*)", 1)
    web = lambda c: F.when(c.startswith("http"), c)
    coded = lambda c: web(F.try_to_binary(F.translate(c, "-_", "+/"), F.lit("base64")).cast("string"))
    marked = F.when(value.startswith("a1"), coded(F.substring(value, 3, 1 << 30))).otherwise(F.coalesce(*[coded(F.substring(value, n + 1, 1 << 30)) for n in (1, 2, 3, 4, 0)]))
    digits = F.when(value.rlike("^[0-9a-fA-F]+$"), F.try_to_binary(value, F.lit("hex")).cast("string"))
    in_path = F.coalesce(F.try_url_decode(F.regexp_extract(raw, r"/(?:aclick|ck)/.*?u=([^&]+)", 1)), F.lit(""))
    found = F.coalesce(web(F.try_url_decode(value)), marked, F.when(F.contains(digits, F.lit("http")), digits), coded(F.regexp_replace(in_path, "^a1", "")), web(in_path))
    return F.when(F.contains(raw, F.lit("bing.com")) & found.isNotNull(), clean_url(found))


def short_hash(key: Column | str) -> Column:
    """URL14: the first 16 hex digits of the key's SHA-256."""
    return F.substring(F.sha2(_c(key), 256), 1, 16)


def urls_in(text: Column | str) -> Column:
    """URL15: distinct http(s) urls of free text, up to a blank, quote or closing bracket, closing punctuation cut, cleaned."""
    found = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"(?i)(https?://[^\s<>\"')\]]+)"), F.lit(1))
    return F.filter(F.array_distinct(F.transform(found, lambda u: clean_url(F.regexp_replace(u, r"[.,;:!?]+$", "")))), lambda u: u != "")


def domain1(url: Column | str) -> Column:
    """DOM1: host with port, in lower case, without www."""
    return F.when(_text(url) == "", F.lit("")).otherwise(_bare_host(netloc(url)))


def domain2(url: Column | str) -> Column:
    """DOM2: host, or the path of a url without scheme; case kept; www cut."""
    raw = _text(url)
    host = F.when(F.contains(raw, F.lit("://")), _part(raw, 1)).otherwise(F.regexp_extract(raw, r"^([^?#]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def domain3(url: Column | str) -> Column:
    """DOM3: '' without scheme; www cut before lowering, so ``WWW.`` stays."""
    raw = _text(url)
    return F.when(F.contains(raw, F.lit("://")), F.lower(F.regexp_replace(_part(raw, 1), r"^www\.", ""))).otherwise(F.lit(""))


def domain4(url: Column | str) -> Column:
    """DOM4: ``http://`` put before what does not start with ``http``; www cut, then lowered."""
    raw = F.coalesce(_c(url), F.lit(""))
    full = F.when(raw.startswith("http"), raw).otherwise(F.concat(F.lit("http://"), raw))
    return F.lower(F.regexp_replace(_part(full, 1), r"^www\.", ""))


def domain5(url: Column | str) -> Column:
    """DOM5: host without www, case kept."""
    return F.regexp_replace(_part(_text(url), 1), r"^www\.", "")


def domain6(url: Column | str) -> Column:
    """DOM6: host as written."""
    return _part(_text(url), 1)


def domain7(url: Column | str) -> Column:
    """DOM7: host without port and www, in lower case."""
    return F.regexp_replace(domain1(url), r":\d+$", "")


def domain8(url: Column | str) -> Column:
    """DOM8: the first ``www.`` anywhere is cut; what is no url stays as it is."""
    raw = _text(url)
    host = F.regexp_replace(F.lower(_part(raw, 1)), r":\d+$", "")
    return F.when(host == "", raw).otherwise(F.regexp_replace(host, r"^(.*?)www\.", "$1"))


def domain9(url: Column | str) -> Column:
    """DOM9: the last two labels of the host."""
    labels = F.split(domain7(url), r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")


def domain10(url: Column | str) -> Column:
    """DOM10: host with port; store prefixes are cut one after the other, each where it then stands first."""
    stores = ("apps", "play", "chrome", "itunes", "microsoft", "addons")
    return F.regexp_replace(domain1(url), "^" + "".join(rf"(?:{p}\.)?" for p in stores), "")


def domain11(domain: Column | str) -> Column:
    """DOM11: every ``www.`` is cut."""
    return F.replace(F.coalesce(_c(domain), F.lit("")), F.lit("www."), F.lit(""))
