"""String, list, JSON, date and arithmetic rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that do not tell products apart.
NAME_STOP = ("the", "a", "an", "best", "for", "and", "to", "of", "in", "with", "free")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_str(x: Column | str) -> Column:
    """STR1: trimmed; NULL and ``nan`` are ''."""
    t = F.trim(_c(x))
    return F.when(_c(x).isNull() | (F.lower(t) == "nan"), F.lit("")).otherwise(t)


def nan_to_null(x: Column | str) -> Column:
    """STR2."""
    return F.when(F.lower(F.trim(_c(x))) != "nan", _c(x))


def word_count(x: Column | str) -> Column:
    """STR3: runs of ASCII letters and digits, with one apostrophe part."""
    return F.regexp_count(F.coalesce(_c(x), F.lit("")), F.lit(r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?"))


def space_word_count(x: Column | str) -> Column:
    """STR4: parts between white space."""
    t = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"^\s+|\s+$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+")))


def product_name(x: Column | str) -> Column:
    """STR5: numbering, what follows a dash, colon or bar, and parentheses cut; letters and digits only."""
    s = F.regexp_replace(safe_str(x), r"^\s*(?:#?\d+[).\s-]+)+", "")
    first = F.regexp_extract(s, r"^(.*?)\s*(?:[–—\-:|]|$)", 1)
    s = F.when(F.length(first) >= 2, first).otherwise(s)
    s = F.lower(F.regexp_replace(s, r"\s*\([^)]*\)\s*", " "))
    s = F.regexp_replace(F.replace(s, F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", " ")
    return F.trim(s)


def name_tokens(x: Column | str) -> Column:
    """STR6: distinct words of the name that tell products apart."""
    return F.array_except(F.array_distinct(F.split(product_name(x), " ")), F.array(*[F.lit(w) for w in (*NAME_STOP, "")]))


def entities(x: Column | str) -> Column:
    """STR7: the parts of a joint name, by the first separator that occurs."""
    s = safe_str(x)
    whole = F.array(s)
    out = whole
    for sep, cut in reversed(((" & ", " & "), (" and ", " and "), (" / ", " / "), (" | ", r" \| "), (" + ", r" \+ "), (", ", ","))):
        parts = F.filter(F.transform(F.split(s, cut), lambda p: F.trim(p)), lambda p: p != "")
        out = F.when(F.contains(s, F.lit(sep)), F.when(F.size(parts) >= 2, parts).otherwise(whole)).otherwise(out)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(out)


def item_name(x: Column | str) -> Column:
    """STR8: the text before the first dash or colon (2 to 80 characters, a space after the mark), else the first three words."""
    t = F.coalesce(_c(x), F.lit(""))
    head = F.trim(F.regexp_extract(t, r"^\s*([^—\-:]{2,80})\s*[—\-:]\s+", 1))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    return F.when(t.rlike(r"^\s*[^—\-:]{2,80}\s*[—\-:]\s+"), head).otherwise(F.array_join(F.slice(words, 1, 3), " "))


def searched_for(x: Column | str) -> Column:
    """STR9: what follows the first "Searching for" or "Searched the web for" of a text, spaces squeezed, without quotes; '' if there is none."""
    t = F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"\s+", " "))
    found = F.trim(F.regexp_extract(t, r"(?i)(?:Searching|Searched)\s+(?:the\s+web\s+)?for\s+(.+)", 1))
    return F.regexp_replace(found, "^[\"“”']+|[\"“”']+$", "")


def query_key(x: Column | str) -> Column:
    """STR10: quotes, then surrounding space cut, in this order; lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), '^"+|"+$', "")))


def run_id(prompt: Column | str, number: Column | str, index: Column | str) -> Column:
    """STR11: ``P0001_r3``; a blank prompt id is made from the query index."""
    p = F.coalesce(F.nullif(F.trim(_c(prompt)), F.lit("")), F.format_string("P%04d", _c(index)))
    return F.concat(p, F.lit("_r"), _c(number).cast("string"))


def canonical_run_id(x: Column | str) -> Column:
    """STR12: ``P0001_R03`` is ``P0001_r3``."""
    return F.regexp_replace(F.trim(_c(x)), r"_[rR]0*(\d+)$", "_r$1")


def run_parts(x: Column | str) -> Column:
    """STR12: (prompt, number) of a run id."""
    c = canonical_run_id(x)
    return F.struct(F.regexp_extract(c, r"^(.*)_r\d+$", 1).alias("prompt_id"), F.regexp_extract(c, r"_r(\d+)$", 1).try_cast("int").alias("run_number"))


def fill_template(template: str, cap: int = 12000, **fields: Column) -> Column:
    """STR13: ``{{name}}`` replaced by its field; the text capped."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.substring(F.coalesce(value, F.lit("")), 1, cap))
    return out


def unfenced(x: Column | str) -> Column:
    """STR14: JSON text without its Markdown fence."""
    return F.trim(F.regexp_replace(F.trim(_c(x)), r"^```(?:json)?\s*|\s*```$", ""))


def payload_tokens(n: Column | str) -> Column:
    """STR15: size estimate, four characters a token."""
    return F.floor(F.greatest(_c(n), F.lit(0)) / 4)


def fetch_error(name: Column | str, message: Column | str) -> Column:
    """SRC13: what an error of a fetch is called, by its name, else by its message."""
    m = F.coalesce(_c(message), F.lit(""))
    has = lambda x: F.contains(m, F.lit(x))
    return F.when(_c(name) == "AbortError", "Request timeout").when(has("Failed to fetch"), "Network error or blocked").when(has("NetworkError"), "Network error").when(has("TypeError"), "Invalid URL or network error").otherwise(m)


# JSON


def valid_json(x: Column | str) -> Column:
    return F.try_parse_json(_c(x)).isNotNull()


def json_elements(x: Column | str) -> Column:
    """Elements of a JSON array as text (strings as they are, objects as JSON); anything else is empty."""
    return F.coalesce(F.when(valid_json(x), F.from_json(_c(x), "array<string>")), F.array().cast("array<string>"))


def element_url(e: Column) -> Column:
    """JSN1, JSN3: the url of an element, which is a string or an object with ``url``."""
    return F.when(e.startswith("{"), F.get_json_object(e, "$.url")).otherwise(e)


def source_urls(x: Column | str) -> Column:
    """JSN1: urls of a sources cell, in order."""
    return F.filter(F.transform(json_elements(x), element_url), lambda u: u.isNotNull() & (u != ""))


ITEMS = "array<struct<item_section_title:string,item_position:int,item_name:string,item_text:string,chip_groups:array<struct<links:array<string>>>>>"


def items(x: Column | str) -> Column:
    """JSN2: items of an items cell."""
    return F.coalesce(F.when(valid_json(x) & _c(x).rlike(r"^\s*\["), F.from_json(_c(x), ITEMS)), F.array().cast(ITEMS))


def classification(x: Column | str, names: tuple[str, ...]) -> Column:
    """JSN4: named probabilities; NULL where missing."""
    return F.from_json(_c(x), "struct<" + ",".join(f"{n}:double" for n in names) + ">")


# lists


def literal_list(x: Column | str) -> Column:
    """ARR1: a Python list literal; NULL or unreadable is empty."""
    return F.coalesce(F.from_json(_c(x), "array<string>"), F.array().cast("array<string>"))


def ordered_distinct(a: Column | str) -> Column:
    """ARR2."""
    return F.array_distinct(_c(a))


def as_literal(a: Column | str) -> Column:
    """ARR3: a Python list literal of strings."""
    return F.concat(F.lit("["), F.array_join(F.transform(_c(a), lambda e: F.concat(F.lit("'"), F.replace(e, F.lit("'"), F.lit("\\'")), F.lit("'"))), ", "), F.lit("]"))


def ordered_union(a: Column | str, b: Column | str) -> Column:
    """ARR4."""
    return F.array_union(_c(a), _c(b))


def mean_size(a: Column | str) -> Column:
    """ARR5: mean length of the inner lists; 0 for none."""
    n = F.size(_c(a))
    return F.when(n > 0, F.aggregate(_c(a), F.lit(0), lambda s, e: s + F.greatest(F.size(e), F.lit(0))) / n).otherwise(F.lit(0.0))


# dates and numbers


# The six forms of DAT1: pattern, and the groups of year, month and day. Hours are checked, the day is that of the value's own zone.
_DATES = (
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", (1, 2, 3)),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", (1, 2, 3)),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", (3, 2, 1)),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", (3, 1, 2)),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})T(?:2[0-3]|[01]?\d):[0-5]?\d:(?:6[01]|[0-5]?\d)(?:\.\d{1,6})?(?:Z|[+-]\d{2}:?[0-5]\d(?::?[0-5]\d)?)$", (1, 2, 3)),
)


def iso_date(x: Column | str) -> Column:
    """DAT1: a date in one of six formats, as ``yyyy-MM-dd``; '' if none fits. The study's seventh step never matches, so there is none here."""
    s = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"^\s+|\s+$", "")
    ymd = F.lit(None).cast("string")
    for pattern, order in reversed(_DATES):
        ymd = F.when(s.rlike(pattern), F.concat_ws("-", *[F.regexp_extract(s, pattern, g) for g in order])).otherwise(ymd)
    return F.coalesce(F.date_format(F.try_to_timestamp(ymd, F.lit("y-M-d")), "yyyy-MM-dd"), F.lit(""))


def iso_or_raw(x: Column | str) -> Column:
    """DAT2: ISO-like values stay; others become ISO if they can be read, else stay."""
    s = F.trim(_c(x))
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), s).otherwise(F.coalesce(F.concat(F.nullif(iso_date(s), F.lit("")), F.lit("T00:00:00.000Z")), s))


def syllables(word: Column | str) -> Column:
    """MTH1: groups of vowels among the letters, less one for a final e where there are more; at least one, 0 without letters."""
    w = F.regexp_replace(F.lower(_c(word)), "[^a-z]", "")
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.when(w == "", 0).otherwise(F.greatest(groups - (w.endswith("e") & (groups > 1)).cast("int"), F.lit(1)))


def reading_ease(text: Column | str) -> Column:
    """MTH2: Flesch reading ease, between -50 and 130; 0 without words."""
    t = F.coalesce(_c(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(r"([A-Za-z]+(?:'[A-Za-z]+)?)"), F.lit(1))
    n = F.size(words)
    sentences = F.greatest(F.regexp_count(t, F.lit("[.!?]+")), F.lit(1))
    total = F.aggregate(words, F.lit(0), lambda s, w: s + syllables(w))
    score = F.lit(206.835) - 1.015 * (n / sentences) - 84.6 * (total / n)
    return F.when(n > 0, F.greatest(F.least(score, F.lit(130.0)), F.lit(-50.0))).otherwise(F.lit(0.0))


def percentage(part: Column | str, whole: Column | str) -> Column:
    """MTH3: 0 of nothing."""
    return F.when(_c(whole) == 0, F.lit(0.0)).otherwise(100.0 * _c(part) / _c(whole))


def page_of_rank(rank: Column | str) -> Column:
    """MTH4."""
    return (F.floor((_c(rank) - 1) / 10) + 1).cast("int")


def clamp01(x: Column | str) -> Column:
    """MTH5."""
    return F.least(F.greatest(_c(x), F.lit(0.0)), F.lit(1.0))
