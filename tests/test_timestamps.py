from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pytest

from rankweave.operators.timestamps import normalise_timestamps, value_dictionary


def ms(y, m, d, h=0, mi=0, s=0, f=0, zone="UTC"):
    return int(datetime(y, m, d, h, mi, s, tzinfo=ZoneInfo(zone)).astimezone(UTC).timestamp()) * 1000 + f


B, NY = "Europe/Berlin", "America/New_York"
CASES = [
    ("2024-03-05", B, ms(2024, 3, 5, zone=B)), ("2024-03-05T10:11:12Z", B, ms(2024, 3, 5, 10, 11, 12)), ("2024-03-05T10:11:12.123456789Z", B, ms(2024, 3, 5, 10, 11, 12, 123)), ("20240305T101112Z", B, ms(2024, 3, 5, 10, 11, 12)),
    ("2024-03-05 10:11", B, ms(2024, 3, 5, 10, 11, zone=B)), ("2024-03-05T10:11:12+0530", B, ms(2024, 3, 5, 4, 41, 12)), ("2024-03-05 10:11:12 UTC-05:00", B, ms(2024, 3, 5, 15, 11, 12)), ("2024-03-05T10:11:12+02:00[Europe/Madrid]", NY, ms(2024, 3, 5, 8, 11, 12)),
    ("03/05/2024", B, ms(2024, 3, 5, zone=B)), ("05-03-2024", B, ms(2024, 3, 5, zone=B)), ("05.03.2024 10:11", B, ms(2024, 3, 5, 10, 11, zone=B)), ("2024/3/5", B, ms(2024, 3, 5, zone=B)), ("03/05/2024 02:42 PM", B, ms(2024, 3, 5, 14, 42, zone=B)), ("03/05/2024 12:05 AM", B, ms(2024, 3, 5, 0, 5, zone=B)),
    ("Tue, 05 Mar 2024 10:11:12 GMT", B, ms(2024, 3, 5, 10, 11, 12)), ("Tue, 05 Mar 2024 10:11:12 +0545", B, ms(2024, 3, 5, 4, 26, 12)), ("March 5, 2024", B, ms(2024, 3, 5, zone=B)), ("Mar 5, 2024", NY, ms(2024, 3, 5, zone=NY)), ("March 5, 2024 3:29 PM CET", NY, ms(2024, 3, 5, 14, 29)),
    ("August 5, 2024 3:29 PM PDT", B, ms(2024, 8, 5, 22, 29)), ("10:11, 5 Mar 2024", B, ms(2024, 3, 5, 10, 11, zone=B)), ("5. März 2024", B, ms(2024, 3, 5, zone=B)), ("5 de marzo de 2024", B, ms(2024, 3, 5, zone=B)), ("5 août 2024", B, ms(2024, 8, 5, zone=B)), (" \t2024-03-05\n", B, ms(2024, 3, 5, zone=B)),
    ("1709633472", B, 1709633472000), ("1709633472123", B, 1709633472123), ("1709633472123456", B, 1709633472123), ("1709633472.5", B, 1709633472500), ("2024-03-05T10:11:12." + "9" * 13 + "Z", B, ms(2024, 3, 5, 10, 11, 12, 999)), ("1709633472." + "9" * 14, B, 1709633472999),
    # a local time that comes twice: the earlier; one that is skipped: on by the gap
    ("2024-10-27 02:30:00", B, ms(2024, 10, 27, 0, 30)), ("2024-03-31 02:30:00", B, ms(2024, 3, 31, 1, 30)), ("2024-11-03 01:30", NY, ms(2024, 11, 3, 5, 30)), ("2024-03-10 02:15", NY, ms(2024, 3, 10, 7, 15)),
    ("2024-03-05 10:11", None, ms(2024, 3, 5, 10, 11)), ("2024-03-05 10:11", "No/Where", ms(2024, 3, 5, 10, 11)),
]
NONE = [None, "", "  ", "nan", "yesterday", "2 days ago", "vor 3 Tagen", "2024-13-05T08:00:00Z", "2025-02-30", "31/31/2025", "0000-00-00", "N/A", "Updated recently", "2024-03-05 25:00", "13:99, 5 Mar 2024", "March 5", "x" * 10000]


def run(spark, rows, path=None):
    df = spark.createDataFrame([(i, v, z, "clash") for i, (v, z) in enumerate(rows)], "row_id long, published_date string, z string, utc_ms string")
    return {r["row_id"]: r["utc_ms"] for r in normalise_timestamps(df, ["published_date"], "z", ["row_id"], path).collect()}


def test_forms(spark):
    got = run(spark, [(v, z) for v, z, _ in CASES])
    assert {i: (CASES[i][0], got.get(i)) for i in range(len(CASES))} == {i: (v, w) for i, (v, _, w) in enumerate(CASES)}


def test_no_cases(spark):
    assert run(spark, [(v, B) for v in NONE]) == {}


def test_zones_against_python(spark):
    rows, want = [], {}
    for zone in ("Asia/Kathmandu", "America/Sao_Paulo", "Australia/Sydney", B, NY):
        for day in range(1, 29):
            for month in (3, 4, 10, 11):
                rows.append((f"2023-{month:02}-{day:02} 02:30:15", zone))
                want[len(rows) - 1] = ms(2023, month, day, 2, 30, 15, zone=zone)
    assert run(spark, rows) == want


def test_repeats_empty_and_incremental_dictionary(spark, tmp_path):
    path = str(tmp_path / "dictionary")
    assert run(spark, [("2024-03-05", B)] * 3, path) == dict.fromkeys(range(3), ms(2024, 3, 5, zone=B))
    assert spark.read.parquet(path).count() == 1
    assert len(run(spark, [("2024-03-05", B), ("2024-03-06", B)], path)) == 2
    assert spark.read.parquet(path).count() == 2  # only the new value was parsed and added
    empty = spark.createDataFrame([], "row_id long, a string, b string, z string")
    assert normalise_timestamps(empty, ["a", "b"], "z", ["row_id"]).count() == 0
    assert value_dictionary(spark.createDataFrame([], "raw string, source string, zone string")).count() == 0


def test_entries_written_twice_are_read_once(spark, tmp_path):
    path = str(tmp_path / "twice")
    run(spark, [("2024-03-05", B)], path)
    spark.read.parquet(path).write.mode("append").parquet(path + "2")
    spark.read.parquet(path).write.mode("append").parquet(path + "2")
    df = spark.createDataFrame([(1, "2024-03-05", B)], "row_id long, published_date string, z string")
    assert normalise_timestamps(df, ["published_date"], "z", ["row_id"], path + "2").count() == 1


def test_entries_are_kept_apart_by_source(spark, tmp_path):
    path = str(tmp_path / "sources")
    df = spark.createDataFrame([(1, "2024-03-05", B, "a"), (2, "2024-03-05", B, "b"), (3, "2024-03-05", B, None), (4, "2024-03-05", B, "a")], "row_id long, d string, z string, site string")
    assert normalise_timestamps(df, ["d"], "z", ["row_id"], path, "site").count() == 4
    assert spark.read.parquet(path).count() == 3


@pytest.mark.parametrize("fields", [["a"], ["a", "b"]])
def test_field_names(spark, fields):
    df = spark.createDataFrame([(1, "2024-01-01", "2024-01-02", None)], "row_id long, a string, b string, z string")
    assert sorted(r["field"] for r in normalise_timestamps(df, fields, "z", ["row_id"]).collect()) == fields
