"""Problem 4: timestamps in mixed formats, precisions and zones become one UTC instant.

Method: the raw strings are deduplicated together with their source and zone into a dictionary of
distinct values, each of which is parsed once; the dictionary can be kept in a folder and is then only
extended by values not yet in it; the instants are joined back to the rows. Values that two writers
add at once are in the folder twice; they are read once.

Everything runs in the JVM. A pattern rewrites a value into fixed fields
``y|m|d|H|M|S|frac|ampm|zone``; ``try_make_timestamp`` then checks the calendar, and takes the
earlier instant of a local time that comes twice and moves on a skipped one by the gap.

Defined results: NULL, blank, relative, impossible or dateless values give no row, nor do bare numbers
of over 19 digits; fractions of any length count, cut off after milliseconds; a NULL, unknown
or invalid zone is read as UTC; repeated rows each keep their own row; an empty table gives none.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.session import exists, written

# Month names (English, German, Spanish, French) and their usual short forms.
MONTHS = {
    1: "january jan januar jänner enero ene janvier janv",
    2: "february feb februar febrero février fevrier févr",
    3: "march mar märz maerz marzo mars",
    4: "april apr abril abr avril avr",
    5: "may mai mayo",
    6: "june jun juni junio juin",
    7: "july jul juli julio juillet juil",
    8: "august aug agosto ago août aout",
    9: "september sep sept septiembre septembre",
    10: "october oct oktober okt octubre octobre",
    11: "november nov noviembre novembre",
    12: "december dec dezember dez diciembre dic décembre decembre déc",
}
# Zone abbreviations and their offsets from UTC in minutes.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "brt": -180, "ist": 330, "npt": 345, "jst": 540,
    "kst": 540, "aest": 600, "aedt": 660, "acst": 570, "acdt": 630, "awst": 480, "nzst": 720, "nzdt": 780,
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)? ?([AaPp]\.?[Mm]\.?)?"
_ZONE = r" ?((?:(?:UTC|GMT|utc|gmt) ?)?[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{1,5})?(?: ?\[[^\]]*\]| ?\([^)]*\))?"
_AFTER = rf"(?:(?:,? (?:at |um |a las |à )?|[Tt])?{_TIME}{_ZONE})?"
_DOW = r"(?:[\p{L}]{2,10}\.?,? )?"
_NAME = r"(\p{L}{3,10})\.?"
# (pattern, groups of y, m, d, first group of the time)
SHAPES = (
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_AFTER}$", (1, 2, 3), 4),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt ](\d{{2}}):?(\d{{2}}):?(\d{{2}})?(?:[.,](\d+))?(){_ZONE}$", (1, 2, 3), 4),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){_AFTER}$", (3, 1, 2), 4),
    (rf"^(\d{{1,2}})([-.])(\d{{1,2}})\2(\d{{4}}){_AFTER}$", (4, 3, 1), 5),
    (rf"^{_DOW}{_NAME} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}){_AFTER}$", (3, 1, 2), 4),
    (rf"^{_DOW}(\d{{1,2}})(?:\.|st|nd|rd|th|er|º)?[ -](?:de |of )?{_NAME},?[ -](?:de |del )?(\d{{4}}){_AFTER}$", (3, 2, 1), 4),
    (rf"^{_TIME}{_ZONE},? (\d{{1,2}})\.? {_NAME} (\d{{4}})$", (9, 8, 7), 1),
    (rf"^{_TIME}{_ZONE},? {_NAME} (\d{{1,2}}),? (\d{{4}})$", (9, 7, 8), 1),
)


def _fields(s: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, (y, m, d), t in reversed(SHAPES):
        to = f"${y}|${m}|${d}|${t}|${t + 1}|${t + 2}|${t + 3}|${t + 4}|${t + 5}"
        out = F.when(s.rlike(pattern), F.regexp_replace(s, pattern, to)).otherwise(out)
    return out


def _offset_minutes(zone: Column) -> Column:
    """Minutes from UTC of an explicit zone; NULL if it is none."""
    known = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    digits = F.regexp_replace(zone, r"^(?:UTC|GMT|utc|gmt)? ?([+-])(\d{1,2}?):?(\d{2})?$", "$1|$2|$3")
    part = F.split(digits, r"\|")
    hours, minutes = F.try_element_at(part, F.lit(2)).try_cast("int"), F.coalesce(F.try_element_at(part, F.lit(3)).try_cast("int"), F.lit(0))
    sign = F.when(F.try_element_at(part, F.lit(1)) == "-", -1).otherwise(1)
    numeric = F.when((hours <= 18) & (minutes < 60), sign * (hours * 60 + minutes))
    return F.when(zone.rlike(r"[+-]\d"), numeric).otherwise(F.try_element_at(known, F.lower(zone)))


def parse_instant(raw: Column, zone: Column) -> Column:
    """UTC milliseconds of ``raw``, read in ``zone`` where it names none; NULL if it is no time."""
    s = F.trim(F.regexp_replace(raw, r"[\s  -​ 　]+", " "))
    names = F.create_map(*[F.lit(x) for n, words in MONTHS.items() for w in words.split() for x in (w, n)])
    f = F.split(_fields(s), r"\|")
    month = F.coalesce(f[1].try_cast("int"), F.try_element_at(names, F.lower(f[1])))
    hour, minute, second = (F.coalesce(f[i].try_cast("int"), F.lit(0)) for i in (3, 4, 5))
    half = F.lower(F.substring(f[7], 1, 1))
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    offset = _offset_minutes(f[8])
    args = F.struct(
        f[0].try_cast("int").alias("y"), month.alias("m"), f[2].try_cast("int").alias("d"), hour.alias("h"), minute.alias("mi"),
        second.cast("decimal(8,6)").alias("s"), F.when(f[8] == "", zone).otherwise(F.lit("UTC")).alias("z"),
        F.when(f[8] == "", 0).otherwise(offset).alias("off"), F.substring(F.rpad(f[6], 3, "0"), 1, 3).try_cast("int").alias("ms"),
    )
    stamp = F.transform(
        F.array(args),
        lambda a: F.unix_millis(F.try_make_timestamp(a.y, a.m, a.d, a.h, a.mi, a.s, a.z)) - a.off * F.lit(60000).cast("bigint") + F.coalesce(a.ms, F.lit(0)),
    )[0]
    number = F.regexp_replace(s, r"(\.\d{9})\d+$", "$1").try_cast("decimal(30,9)")
    size = F.abs(number)
    epoch = F.floor(F.when(size < 10**11, number * 1000).when(size < 10**14, number).when(size < 10**17, number / 1000).otherwise(number / 1000000)).cast("bigint")
    return F.when(s.rlike(r"^-?\d{1,19}(?:\.\d+)?$"), epoch).otherwise(stamp)


def valid_zone(zone: Column) -> Column:
    """``zone`` if it is a known zone id, else UTC."""
    known = sorted(zoneinfo.available_timezones())
    return F.when(zone.isin(known) if known else zone.isNotNull(), zone).otherwise(F.lit("UTC"))


ENTRY = ["raw", "source", "zone"]


def value_dictionary(values: DataFrame, path: str | None = None) -> DataFrame:
    """Distinct ``(raw, source, zone)`` of ``values`` with ``utc_ms``, each parsed once.

    With ``path`` the dictionary is a Parquet table there: only values not yet in it are parsed and
    appended, so a later run over more rows parses just its new values.
    """
    fresh = values.select(*ENTRY).distinct()
    parsed = lambda d: d.withColumn("utc_ms", parse_instant(F.col("raw"), F.col("zone")))
    if path is None:
        return parsed(fresh)
    spark = values.sparkSession
    shape = "raw string, source string, zone string, utc_ms bigint"
    if exists(spark, path):
        known = spark.read.schema(shape).parquet(path).select(*ENTRY)
        fresh = fresh.join(known, [fresh[c].eqNullSafe(known[c]) for c in ENTRY], "left_anti")
    parsed(fresh).write.mode("append").parquet(path)
    # stored once more without repeats, so that the join back reads plain files and can split a hot value
    return written(spark.read.schema(shape).parquet(path).dropDuplicates(ENTRY), "instants")


def normalise_timestamps(rows: DataFrame, fields: list[str], zone: str, keys: list[str], path: str | None = None, source: str | None = None) -> DataFrame:
    """``keys``, ``field``, ``raw``, ``utc_ms`` of each value of ``fields`` that names a point in time.

    ``zone`` is the column with the zone of a row (NULL or unknown: UTC), ``source`` that of the site
    that wrote it, if values are to be kept apart by source.
    """
    inner = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    long = raw_values(rows, fields, zone, source, inner)
    done = long.join(value_dictionary(long, path), ENTRY).filter(F.col("utc_ms").isNotNull())
    return done.select(*[F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)], "field", "raw", "utc_ms")


def raw_values(rows: DataFrame, fields: list[str], zone: str, source: str | None = None, more: list[Column] | None = None) -> DataFrame:
    """``field``, ``raw``, ``source`` and ``zone`` of each value with a digit; without one it is no date."""
    at = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("raw")) for f in fields]))
    who = F.lit("") if source is None else F.coalesce(F.col(source).cast("string"), F.lit(""))
    long = rows.select(*(more or []), who.alias("source"), valid_zone(F.col(zone)).alias("zone"), at.alias("_at")).select("*", "_at.field", "_at.raw").drop("_at")
    return long.filter(F.col("raw").rlike(r"\d"))
