"""Sources and sinks: raw layout round trip, CSV export with load fixes, catalog tables."""

import os
import tempfile
from decimal import ROUND_HALF_UP, Decimal

from conftest import SF001
from promolens.operators import marts
from promolens.plans.registry import REGISTRY
from promolens.sources import fixture, raw


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_parquet_round_trip_gives_same_metrics(spark):
    t = fixture.load(spark, SF001)
    root = os.path.join(tempfile.mkdtemp(), "raw")
    fixture.write_raw_tables(spark, SF001, root)
    stored = raw.read_raw(spark, root)
    joined = raw.read_raw(spark, root, with_item_orders=False)      # metrics build the join
    for name in ("fact_campaign_performance", "category_share", "fact_funnel", "pk_uniqueness"):
        expect = _rows(REGISTRY[name](t))
        assert _rows(REGISTRY[name](stored)) == expect
        assert _rows(REGISTRY[name](joined)) == expect


def test_csv_export_is_cleaned(spark):
    t = fixture.load(spark, SF001)
    root = tempfile.mkdtemp()
    o = t.orders.selectExpr("order_id", "concat(cast(order_date as string), ' 00:00:00') AS order_date",
                            "customer_id", "subtotal_amount", "shipping_fee_total", "commission_total",
                            "maintenance_total", "total_amount", "campaign_id", "'Monday' AS order_day", "'1995-01' AS year_month")
    o.write.option("header", True).csv(f"{root}/raw_orders")
    for attr, name in [("order_items", "raw_order_items"), ("campaigns", "raw_campaigns"),
                       ("products", "raw_products"), ("product_campaign", "raw_product_campaign"),
                       ("website_sessions", "raw_website_sessions"),
                       ("session_activities", "raw_session_activities")]:
        getattr(t, attr).write.option("header", True).csv(f"{root}/{name}")
    c = raw.read_csv_export(spark, root)
    assert "order_day" not in c.orders.columns
    assert _rows(c.orders.select("order_id", "order_date")) == _rows(t.orders.select("order_id", "order_date"))
    assert _rows(REGISTRY["fact_daily_baseline"](c)) == _rows(REGISTRY["fact_daily_baseline"](t))


def test_catalog_tables_and_marts(spark):
    t = fixture.load(spark, SF001)
    raw.save_raw_tables(t, "shop_campaign")
    c = raw.read_catalog(spark, "shop_campaign")
    assert spark.catalog.currentDatabase() == "shop_campaign"
    saved = marts.save_marts(c, "shop_marts")
    assert set(saved) <= {x.name for x in spark.catalog.listTables("shop_marts")}
    assert _rows(spark.table("shop_marts.fact_daily_baseline")) == _rows(REGISTRY["fact_daily_baseline"](t))
    spark.catalog.setCurrentDatabase("default")


def test_scale_conf_sizes_partitions_from_input():
    from promolens.plans.tuning import scale_conf
    big = scale_conf(100 * 1024 ** 4, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 409600
    assert int(scale_conf(10 ** 6, 8)["spark.sql.shuffle.partitions"]) == 16


def test_sql_over_registered_views(spark):
    """Source-style SQL runs unchanged in Spark SQL over the registered views."""
    from promolens.plans.registry import run, tables_for
    t = tables_for(spark, SF001)
    assert "raw_orders" in t.register_views()
    by_status = spark.sql("""
        WITH promoted AS (SELECT order_id FROM raw_orders WHERE NOT isnull(campaign_id))
        SELECT item_status, sum(line_total) AS amount FROM raw_order_items LEFT SEMI JOIN promoted USING (order_id)
        GROUP BY item_status""").collect()
    amounts = {r["item_status"]: r["amount"] for r in by_status}
    df = run(spark, SF001, "campaign_gmv_totals").first()
    whole = Decimal(1)
    assert float(sum(amounts.values()).quantize(whole, ROUND_HALF_UP)) == df["total_campaign_gmv"]
    assert float(amounts["Completed"].quantize(whole, ROUND_HALF_UP)) == df["realized_gmv"]


def test_batch_job_writes_marts_and_reports(spark):
    from promolens.plans import jobs
    root = tempfile.mkdtemp(prefix="promolens-job-")
    jobs.main(["--raw", f"{root}/raw", "--load-fixture", SF001, "--marts", f"{root}/marts",
               "--reports", f"{root}/reports", "--only", "fact_daily_baseline", "overall_cvr"])
    assert sorted(x for x in os.listdir(f"{root}/marts") if not x.startswith(".")) == sorted([*marts.MART_BUILDERS, "manifest.json"])
    got = spark.read.parquet(f"{root}/reports/overall_cvr")
    assert got.count() == 2
    stored = spark.read.parquet(f"{root}/marts/fact_daily_baseline").collect()
    assert _rows(spark.createDataFrame(stored)) == _rows(REGISTRY["fact_daily_baseline"](fixture.load(spark, SF001)))


def test_batch_job_bucketed_catalog(spark):
    from promolens.plans import jobs
    root = tempfile.mkdtemp(prefix="promolens-job-")
    jobs.main(["--raw", f"{root}/raw", "--load-fixture", SF001, "--raw-database", "job_raw_db",
               "--bucket-raw", "4", "--reports", f"{root}/reports", "--only", "fact_daily_baseline"])
    spark.catalog.setCurrentDatabase("default")
    got = spark.read.parquet(f"{root}/reports/fact_daily_baseline")
    assert _rows(got) == _rows(REGISTRY["fact_daily_baseline"](fixture.load(spark, SF001)))
    detail = spark.sql("DESCRIBE EXTENDED job_raw_db.raw_order_items").collect()
    assert any(r["col_name"] == "Num Buckets" and r["data_type"] == "4" for r in detail)


def test_missing_column_and_bad_date_stop_the_load(spark):
    import pytest
    from promolens.sources import schemas as S
    with pytest.raises(ValueError, match="campaign_id"):
        S.conform(spark.createDataFrame([(1,)], "order_id long"), S.ORDERS)
    good = spark.createDataFrame([("2024-01-05",), ("2024-01-05 00:00:00",), (None,)], "d string")
    days = [r[0] for r in good.select(raw.midnight_date(good["d"])).collect()]
    assert days[0] == days[1] and str(days[0]) == "2024-01-05" and days[2] is None
    for text in ("2024-01-05 13:45:00", "2024-01-051"):
        with pytest.raises(Exception):
            bad = spark.createDataFrame([(text,)], "d string")
            bad.select(raw.midnight_date(bad["d"])).collect()


def _broken(spark):
    from pyspark.sql import functions as F
    return spark.range(4).select(F.raise_error(F.lit("broken on purpose")).cast("long").alias("x"))


def test_failed_mart_write_leaves_the_old_tables(spark, monkeypatch, tmp_path):
    import pytest
    t = fixture.load(spark, SF001)
    out = str(tmp_path / "marts")
    small = {"dim_category": marts.dim_category, "dim_campaign": marts.dim_campaign}
    monkeypatch.setattr(marts, "MART_BUILDERS", small)
    paths = marts.write_marts(t, out)
    before = {n: _rows(spark.read.parquet(p)) for n, p in paths.items()}
    manifest = open(f"{out}/manifest.json").read()
    monkeypatch.setattr(marts, "MART_BUILDERS", {**small, "dim_campaign": lambda t: _broken(spark)})
    with pytest.raises(Exception, match="broken on purpose"):
        marts.write_marts(t, out)
    assert {n: _rows(spark.read.parquet(p)) for n, p in paths.items()} == before
    assert open(f"{out}/manifest.json").read() == manifest and not [x for x in os.listdir(out) if x.startswith("_")]
    with pytest.raises(FileExistsError):
        marts.write_marts(t, out, mode="errorifexists")


def test_failed_swap_is_undone(spark, monkeypatch, tmp_path):
    import pytest
    from promolens.plans import publish as P
    out = str(tmp_path / "x")
    write = lambda n: {k: (lambda path, v=n + i: spark.range(v).write.parquet(path)) for i, k in enumerate(("a", "b"))}
    P.publish(spark, out, write(3))
    first = P.published(spark, out)
    real, calls = P._Files.rename, []

    def rename(self, old, new):
        calls.append(new)
        if new.endswith("/b"):
            raise OSError("no rename")
        real(self, old, new)
    monkeypatch.setattr(P._Files, "rename", rename)
    with pytest.raises(OSError):
        P.publish(spark, out, write(7))
    monkeypatch.setattr(P._Files, "rename", real)
    assert spark.read.parquet(f"{out}/a").count() == 3 and spark.read.parquet(f"{out}/b").count() == 4
    assert P.published(spark, out) == first and len(calls) >= 2
    P.publish(spark, out, write(7))
    assert spark.read.parquet(f"{out}/a").count() == 7 and spark.read.parquet(f"{out}/b").count() == 8 and P.published(spark, out) != first


def test_failed_catalog_marts_keep_the_old_tables(spark, monkeypatch):
    import pytest
    t = fixture.load(spark, SF001)
    monkeypatch.setattr(marts, "MART_BUILDERS", {"dim_category": marts.dim_category, "dim_campaign": marts.dim_campaign})
    marts.save_marts(t, "atomic_marts")
    before = _rows(spark.table("dim_category"))
    monkeypatch.setattr(marts, "MART_BUILDERS", {"dim_category": lambda t: marts.dim_category(t).limit(1), "dim_campaign": lambda t: _broken(spark)})
    with pytest.raises(Exception, match="broken on purpose"):
        marts.save_marts(t, "atomic_marts")
    assert _rows(spark.table("dim_category")) == before
    assert sorted(x.name for x in spark.catalog.listTables("atomic_marts") if not x.isTemporary) == ["dim_campaign", "dim_category"]
    spark.catalog.setCurrentDatabase("default")


def test_hot_key_is_stored_without_buckets(spark, tmp_path, monkeypatch):
    from promolens.plans.publish import published
    monkeypatch.setattr(raw, "HOT_ROWS", 1)
    t = fixture.load(spark, SF001)
    one = t.session_activities.withColumn("session_id", t.website_sessions.agg({"session_id": "max"}).scalar())
    t.session_activities = one
    raw.write_raw(t, str(tmp_path / "raw"), buckets=8)
    layout = published(spark, str(tmp_path / "raw"))["layout"]
    assert "raw_session_activities" not in layout and layout["raw_orders"] == {"buckets": 8}
    assert raw.read_raw(spark, str(tmp_path / "raw")).session_activities.count() == one.count()
