"""Queries against the whole of their tables, by SQL or Python of the tests' own."""

from pathlib import Path

import pandas as pd

from lineloom.plans import catalog
from tests.oracle import both


def test_all_orders_meet_suppliers(spark, small):
    span = lambda k, x: ((k % 40, k % 7), (k % 40 + x % 3 - 1, x % 11))
    o, s = (pd.read_parquet(f"{small}/{t}.parquet") for t in ("orders", "supplier"))
    a = [(k, *span(k, x)) for k, x in zip(o["o_orderkey"].tolist(), o["o_custkey"].tolist(), strict=True)]
    b = [(k, *span(k, x)) for k, x in zip(s["s_suppkey"].tolist(), s["s_nationkey"].tolist(), strict=True)]
    want = sorted((i, j) for i, p, q in a for j, x, y in b if p <= y and q >= x)
    assert sorted((r["a_id"], r["b_id"]) for r in catalog.interval_overlap(spark, small).collect()) == want


def test_orders_and_suppliers_without_bounds_meet_too(spark, small, tmp_path):
    for p in Path(small).iterdir():
        if p.name not in ("orders.parquet", "supplier.parquet"):
            (tmp_path / p.name).symlink_to(p)
    for name, key, other in (("orders", "o_orderkey", "o_custkey"), ("supplier", "s_suppkey", "s_nationkey")):
        t = pd.read_parquet(f"{small}/{name}.parquet").astype({key: "Int64", other: "Int64"})
        t.loc[t.index % 5 == 1, other] = pd.NA
        t.loc[t.index % 7 == 2, key] = pd.NA
        t.to_parquet(tmp_path / f"{name}.parquet", index=False)
    ours, theirs = both(spark, str(tmp_path), catalog.interval_overlap, catalog.ORACLE_SQL["interval_overlap"])
    assert ours == theirs and any(r[0] is None for r in ours)
    assert "PushedFilters: [Is" not in catalog.interval_overlap(spark, str(tmp_path))._jdf.queryExecution().toString()


def test_all_orders_are_exploded(spark, small):
    ours, theirs = both(spark, small, catalog.range_explode, catalog.ORACLE_SQL["range_explode"])
    assert ours == theirs


def test_all_customers_are_ranges(spark):
    ours, theirs = both(spark, "/root/testdata/sf0.01", catalog.crossref_chain, catalog.ORACLE_SQL["crossref_chain"])
    assert ours == theirs


def test_points_in_any_document(spark, small, tmp_path):
    for p in Path(small).iterdir():
        if p.name != "nation.parquet":
            (tmp_path / p.name).symlink_to(p)
    n = pd.read_parquet(f"{small}/nation.parquet")
    n.assign(n_nationkey=n["n_nationkey"] + 100).to_parquet(tmp_path / "nation.parquet", index=False)
    ours, theirs = both(spark, str(tmp_path), catalog.canon_view, catalog.ORACLE_SQL["canon_view"])
    assert ours == theirs and any("not available" not in r for r in ours)


def test_all_lines_are_unpivoted(spark, small):
    ours, theirs = both(spark, small, catalog.unpivot_lookup, catalog.ORACLE_SQL["unpivot_lookup"])
    assert ours == theirs


def test_whole_texts_are_highlighted(spark, small):
    ours, theirs = both(spark, small, catalog.search_highlight, catalog.ORACLE_SQL["search_highlight"])
    assert ours == theirs and max(len(r[1]) for r in ours) > 10_000


def test_long_texts_have_windows(spark, small):
    ours, theirs = both(spark, small, catalog.text_windows, catalog.ORACLE_SQL["text_windows"])
    assert ours == theirs
