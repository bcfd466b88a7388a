"""The load step behind queries() and the steps that must not grow faster than their tables (findings F1 to F4 of round 3)."""

import contextlib
import io
import os

import pytest
from builders import M, D, item, tables
from conftest import SF001
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.operators import marts, quality
from promolens.operators.campaigns import ATTRIBUTION_COLS
from promolens.plans import registry
from promolens.sources import fixture
from promolens.sources import schemas as S
from promolens.sources.tables import CAMPAIGN_FLAG


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue().split("\n\n")[0]


def enrol(campaign, product, discount, n=""):
    return {"product_campaign_id": f"{campaign}/{product}{n}", "campaign_id": campaign, "product_id": product, "discount_percent": discount if discount is None else M(discount)}


@pytest.fixture
def fresh(spark, tmp_path):
    """A bundle that no query has read from yet."""
    link = str(tmp_path / "sf")
    os.symlink(SF001, link)
    return link, registry.tables_for(spark, link)


def stored(t) -> set:
    return {"orders", "campaigns", "products", "product_campaign", "website_sessions", "session_activities", "_items"} & set(vars(t))


def test_f1_rows_of_a_key_may_differ_in_their_nulls(spark):
    t = tables(spark, products=[{"product_id": p, "seller_id": "S1", "category": c, "product_name": n}
                                for p, c, n in [("P1", "A", None), ("P1", None, None), ("P1", "B", "x"), ("P2", None, "y"), ("P3", "C", "z")]])
    got = {r["table_name"]: r for r in quality.profile(t).collect()}
    p = got["raw_products"]
    nulls = {x["column_name"]: x["n"] for x in p["nulls"]}
    assert (p["n_rows"], p["n_distinct"], p["n_null"]) == (5, 3, 0)
    assert (nulls["category"], nulls["product_name"], nulls["seller_id"], nulls["weight"]) == (2, 2, 0, 5)
    empty = got["raw_orders"]
    assert (empty["n_rows"], empty["n_distinct"], empty["n_null"]) == (0, 0, 0) and {x["n"] for x in empty["nulls"]} == {0}


def test_f1_no_count_per_column_is_shuffled_with_a_key(spark, monkeypatch):
    t = fixture.load(spark, SF001)
    monkeypatch.setattr(quality, "materialize", lambda df, name: df)
    monkeypatch.setattr(quality.Tables, "shared", lambda self, key, build: build())
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        quality.profile(t).explain("formatted")
    keyed = [x for x in buf.getvalue().split("\n\n") if "HashAggregate" in x and "Keys [" in x]
    assert keyed and max(x.count("partial_") for x in keyed) <= 4


def test_f2_a_query_stores_the_tables_it_reads_alone(spark, fresh):
    link, t = fresh
    assert stored(t) == set()
    registry.run(spark, link, "fact_funnel").collect()
    assert stored(t) == {"website_sessions", "session_activities"}


def test_f2_stored_tables_are_the_mapped_ones(spark, fresh):
    _, t = fresh
    mapped = fixture.load(spark, SF001)
    for name, df in mapped.as_dict().items():
        got = t.as_dict()[name]
        assert got.schema.simpleString() == df.schema.simpleString() and rows(got) == rows(df)
    for campaign in (None, True, False):
        got = t.item_orders(campaign)
        assert rows(got.drop(CAMPAIGN_FLAG)) == rows(mapped.item_orders(campaign).select(*got.drop(CAMPAIGN_FLAG).columns))


def test_f3_no_task_holds_the_enrolments(spark, fresh):
    """They are products times campaigns: never broadcast, and not expanded or hashed before they are dealt out."""
    _, t = fresh
    camp = t.item_orders(True).drop("product_campaign_id")
    assert "SortMergeJoin" in plan(fixture.enrolled(camp, t.product_campaign))
    tree = plan(marts.dim_campaign(t))
    assert "Expand" not in tree
    scan = tree[:tree.rindex("SortMergeJoin")]
    assert "Window" in scan and "HashAggregate" not in scan[scan.rindex("Window"):]


def test_f3_counts_with_repeated_products_and_enrolments(spark):
    t = tables(spark, campaigns=[{"campaign_id": c, "campaign_name": c, "campaign_type": "x", "start_date": D("2024-01-01"), "end_date": D("2024-01-02")} for c in ("C1", "C2")],
               products=[{"product_id": p, "seller_id": s} for p, s in [("P1", "S1"), ("P1", "S2"), ("P2", "S1"), ("P3", "S3")]],
               enrol=[enrol("C1", "P1", 10), enrol("C1", "P1", 40, "b"), enrol("C1", "P2", None), enrol("C1", "P9", 5), enrol("C3", "P3", 7)])
    got = {r["campaign_id"]: r for r in marts.dim_campaign(t).collect()}
    c = got["C1"]
    assert (c["total_products_enrolled"], c["total_sellers_enrolled"]) == (3, 2)
    assert c["avg_seller_discount_offered_pct"] == 21.0                  # 10, 10, 40, 40 and 5
    assert (got["C2"]["total_products_enrolled"], got["C2"]["total_sellers_enrolled"], got["C2"]["avg_seller_discount_offered_pct"]) == (0, 0, None)
    assert "C3" not in got


def test_f4_the_item_fact_is_stored_once_in_the_order_of_its_join(spark, fresh):
    link, t = fresh
    registry.run(spark, link, "attribution_audit").collect()
    assert stored(t) == {"_items"}
    files = lambda df: {f.rsplit("/promolens-tables/", 1)[1].split("/")[0] for f in df.inputFiles()}
    assert files(t.order_items) == files(t.item_orders()) and len(files(t.order_items)) == 2


def test_f4_stored_items_hold_the_columns_of_their_join_alone(spark, fresh):
    """Texts and amounts that follow from them are made when they are read."""
    link, t = fresh
    registry.run(spark, link, "attribution_audit").collect()
    for folder in {f.split("/raw-items-")[0] + "/raw-items-" + f.split("/raw-items-")[1].split("/")[0] for f in t.item_orders(False).inputFiles()}:
        kinds = dict(spark.read.parquet(folder).drop(CAMPAIGN_FLAG).dtypes)
        assert len(kinds) == 13 and {c for c, k in kinds.items() if k == "string"} == {"campaign_id"}
        assert not {"line_total", "commission_amount", "maintenance_amount", "unit_price_after_discount"} & set(kinds)


def test_f4_doubles_become_the_decimals_of_a_cast(spark):
    odd = [0.0, -0.0, 0.01, 0.005, 0.015, 1.005, 2.675, 0.29, 0.57, 1.15, 1e-9, 1e-3, 4.35, 99999.995, 8999999999.99, 9999999999.99, 9999999999.994, 123456789.125, None]
    xs = odd + [-x for x in odd if x] + [i / 100 for i in range(100000, 103000)] + [i / 1000 for i in range(3000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select("x", fixture._two_places("x", S.MONEY_12).alias("a"), F.col("x").cast(S.MONEY_12).alias("b"))
    assert got.schema["a"].dataType == S.MONEY_12 and got.where("NOT (a <=> b)").collect() == []
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        wild = spark.createDataFrame([(x,) for x in (1e10, -1e10, 9999999999.995, 1e300, float("nan"), float("inf"), 100.0)], "x double")
        for kind in (S.MONEY_12, T.DecimalType(4, 2)):
            assert wild.select(fixture._two_places("x", kind).alias("a"), F.col("x").cast(kind).alias("b")).where("NOT (a <=> b)").collect() == []
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_f4_months_of_odd_items_add_up_exactly(spark):
    big = "999999999999.99"
    orders = [{"order_id": i, "order_date": D(d), "customer_id": "U1", "campaign_id": c}
              for i, d, c in [(1, "2024-01-01", None), (1, "2024-01-31", "C1"), (2, "2024-01-01", "C1"), (3, "2024-02-29", None), (4, "2023-02-01", "C1")]]
    items = [item(1, big, is_campaign=1, pc="C1/P1"), item(1, big, status="Refunded"), item(1, "-0.01", is_campaign=1), item(2, big, commission="9999999999.99", maintenance="9999999999.99", is_campaign=1),
             item(2, "0.29", is_campaign=1, pc="C1/P2", commission="0.57"), item(3, "4.35", status=None, is_campaign=1), item(4, 0) | {"line_total": None, "is_campaign": None}, item(9, 5)]
    got = marts.monthly_summary(tables(spark, orders, items))
    kinds = {f.name: f.dataType.simpleString() for f in got.schema}
    assert kinds == {"order_year": "bigint", "order_month": "bigint", "total_orders": "bigint", "days_in_month": "bigint", "gmv": "decimal(24,2)", "realized": "decimal(24,2)",
                     "rev": "decimal(23,2)", **dict.fromkeys(ATTRIBUTION_COLS, "bigint")}
    m = {(r["order_year"], r["order_month"]): r.asDict() for r in got.collect()}
    a = 5 * M(big) - M("0.02") + M("0.29")                                     # order 1 has two rows, so its items count twice
    assert m[2024, 1] == {"order_year": 2024, "order_month": 1, "total_orders": 2, "days_in_month": 2, "gmv": a, "realized": a - 2 * M(big), "rev": M("20000000000.55"),
                          "fully_attributed": 2, "partial": 2, "unattributable": 2, "total_flagged": 6}
    assert (m[2024, 2]["gmv"], m[2024, 2]["realized"], m[2024, 2]["unattributable"], m[2024, 2]["total_flagged"]) == (M("4.35"), 0, 1, 1)
    assert (m[2023, 2]["gmv"], m[2023, 2]["realized"], m[2023, 2]["total_orders"], m[2023, 2]["total_flagged"]) == (None, None, 1, 0)
    assert len(m) == 3


def test_f4_no_decimal_is_shuffled_with_an_order(spark, monkeypatch):
    """The first level has a row for every order: its sums are longs (Spark keeps a sum of such decimals with a flag, isEmpty)."""
    monkeypatch.setattr(marts, "materialize", lambda df, name: df)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        marts.monthly_summary(tables(spark, [{"order_id": 1, "order_date": D("2024-01-01"), "customer_id": "U1"}], [item(1, 5)])).explain("formatted")
    keyed = [x for x in buf.getvalue().split("\n\n") if "HashAggregate" in x and "order_id#" in x.split("Keys [")[-1].split("\n")[0]]
    assert keyed and not any("isEmpty" in x for x in keyed)
