import pytest

from rankweave.llm import queries_pages, queries_tokens


@pytest.mark.parametrize("name", [*queries_pages.QUERIES, *queries_tokens.QUERIES])
def test_query(spark, sf, name):
    q = {**queries_pages.QUERIES, **queries_tokens.QUERIES}[name]
    df = q(spark, sf)
    assert df.columns
    df.count()
