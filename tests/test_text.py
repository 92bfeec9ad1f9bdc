import pytest
from pyspark.sql import functions as F

from rankweave.functions import text as T


def one(spark, f, *args):
    row = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args)))).select(f(*[F.col(f"c{i}") for i in range(len(args))]).alias("x")).first()
    return row[0]


@pytest.mark.parametrize(
    ("f", "x", "want"),
    [
        (T.safe_str, " nan ", ""), (T.safe_str, None, ""), (T.safe_str, " a ", "a"), (T.nan_to_null, "NaN", None), (T.word_count, "it's 2 b-c é", 4), (T.word_count, None, 0), (T.space_word_count, "  a b\nc ", 3), (T.space_word_count, " ", 0),
        (T.product_name, "3. Acme Pro (2024) - best tool", "acme pro"), (T.product_name, "#2 A & B", "a and b"), (T.product_name, None, ""), (T.name_tokens, "The Best Acme for Free", ["acme"]),
        (T.entities, "Clip & Snap", ["Clip", "Snap"]), (T.entities, "A, B, C", ["A", "B", "C"]), (T.entities, "Solo", ["Solo"]), (T.entities, "", []), (T.item_name, "Acme Pro - does it", "Acme Pro"), (T.item_name, "one two three four", "one two three"), (T.item_name, "Well-known tool", "Well-known tool"), (T.item_name, "A: b", "A: b"), (T.item_name, "Acme — does - it", "Acme"), (T.item_name, "Acme – does it now", "Acme – does"), (T.item_name, None, ""),
        (T.searched_for, 'Searching the  web for "a b"', "a b"), (T.searched_for, "Searched the web for x y\nz", "x y z"), (T.searched_for, "searched for “q”", "q"), (T.searched_for, "Search for x", ""), (T.query_key, '" A b"', "a b"), (T.query_key, '"A b" ', 'a b"'), (T.canonical_run_id, "P0001_R03", "P0001_r3"), (T.unfenced, "```json\n{}\n```", "{}"),
        (T.literal_list, "['a', 'it\\'s']", ["a", "it's"]), (T.literal_list, "bad", []), (T.json_elements, '["a", {"url": "b"}, null]', ["a", '{"url":"b"}', None]), (T.json_elements, "{}", []), (T.json_elements, None, []),
        (T.source_urls, '["a", {"url": "b"}, {"title": "c"}, null]', ["a", "b"]), (T.source_urls, '[{"url": "a"}, {"u', []), (T.iso_date, "March 5, 2024", ""), (T.iso_date, "x", ""), (T.iso_date, "13/04/2024", ""), (T.iso_date, "04/13/2024", "2024-04-13"), (T.iso_date, "03-04-2024", "2024-04-03"), (T.iso_date, " 2024/3/5\n", "2024-03-05"), (T.iso_date, "2024-02-30", ""),
        (T.iso_date, "2024-03-05T23:30:00-05:00", "2024-03-05"), (T.iso_date, "2024-03-05T23:30:00.5Z", "2024-03-05"), (T.iso_date, "2024-03-05T25:00:00Z", ""), (T.iso_date, "on 2024-03-05", ""), (T.iso_date, None, ""), (T.iso_or_raw, "soon", "soon"),
        (T.syllables, "table", 1), (T.syllables, "apple", 1), (T.syllables, "made", 1), (T.syllables, "the", 1), (T.syllables, "beautiful", 3), (T.syllables, "rhythm", 1), (T.syllables, "42", 0), (T.reading_ease, "", 0.0),
    ],
)
def test_cases(spark, f, x, want):
    assert one(spark, f, x) == want


def test_more(spark):
    d = spark.createDataFrame([("", 3, 7), ("P0002", 1, 2)], "p string, n int, i int")
    assert [r[0] for r in d.select(T.run_id("p", "n", "i")).collect()] == ["P0007_r3", "P0002_r1"]
    assert d.select(T.as_literal(F.array(F.lit("a"), F.lit("it's")))).first()[0] == "['a', 'it\\'s']"
    assert d.select(T.mean_size(F.array(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2), F.lit(3))))).first()[0] == 2.0
    assert d.select(T.percentage(F.lit(1), F.lit(0)), T.percentage(F.lit(1), F.lit(4)), T.page_of_rank(F.lit(11)), T.clamp01(F.lit(1.5)), T.payload_tokens(F.lit(9))).first()[:] == (0.0, 25.0, 2, 1.0, 2)
    assert d.select(T.fill_template("<{{a}}>", 2, a=F.lit("xyz"))).first()[0] == "<xy>"
    assert d.select(T.run_parts(F.lit("P1_R07"))).first()[0] == ("P1", 7)
    e = [("AbortError", "x", "Request timeout"), ("E", "Failed to fetch", "Network error or blocked"), (None, "NetworkError when", "Network error"), ("", "TypeError: u", "Invalid URL or network error"), ("E", "HTTP 404", "HTTP 404"), (None, None, "")]
    assert [r[0] for r in spark.createDataFrame([x[:2] for x in e], "n string, m string").coalesce(1).select(T.fetch_error("n", "m")).collect()] == [w for *_, w in e]
