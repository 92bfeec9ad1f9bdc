"""Evidence of problem 6 from the other captures of a page."""

from pyspark.sql import functions as F

from rankweave.llm.cut import facts_of


def test_every_longer_capture_counts(spark):
    """The longest capture of a page is another edition; a cut is seen by the shorter whole one."""
    whole = "The phone charges in an hour. The battery lasts two days. It is light."
    rows = [(1, "p", "Menu. Home. " + whole * 3, 5), (2, "p", whole, 5), (3, "p", whole[:29], 5), (4, "p", whole[:29] + " [...]", 5), (5, "q", whole[:29], 5), (6, "q", whole[:29] + " [...]", 5), (7, None, whole[:29], 5)]
    df = spark.createDataFrame(rows, "row_id long, page string, content string, stated int")
    got = {r["_key"]: r["longer"] for r in facts_of(df, "row_id", "content", F.col("page"), "stated").collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: False, 6: False, 7: False}
