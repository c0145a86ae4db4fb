import pytest

from lineloom.plans import catalog
from tests.oracle import both

STRIPPED = ["homily_page", "html_allowlist_strip"]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, small, name):
    ours, theirs = both(spark, small, catalog.QUERIES[name], catalog.ORACLE_SQL[name])
    assert ours == theirs


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", STRIPPED)
def test_allowed_tags_only(spark, small, name):
    import re

    rows = catalog.QUERIES[name](spark, small).collect()
    assert len(rows) == 50
    allowed = {"p", "em", "strong", "sup", "a", "ol", "li"}
    for r in rows:
        assert {t.lower() for t in re.findall(r"</?([A-Za-z0-9]+)", r["html"])} <= allowed
        assert "<p></p>" not in r["html"]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
