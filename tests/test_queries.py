import pytest

from penprint.plans import style, tagged  # noqa: F401 (tagged adds its queries to style's)


@pytest.mark.parametrize("name", sorted(style.SQL))
def test_query_equals_its_sql(same, name):
    same(style.QUERIES[name], style.SQL[name])


def test_query_without_sql_has_a_row_for_each(spark, sf):
    assert set(style.QUERIES) - set(style.SQL) == {"page_text"}
    want = {r[0] for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id").collect()}
    assert {r[0] for r in style.QUERIES["page_text"](spark, sf).select("page_id").collect()} == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
