"""Physical plan checks: the shapes the design relies on at scale."""

import contextlib
import io
import os
import tempfile
from dataclasses import replace

import pytest

from conftest import SF01
from promolens.plans.registry import REGISTRY, run
from promolens.sources import fixture, raw


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def stored(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="promolens-raw-"), "raw")
    raw.write_raw(fixture.load(spark, SF01), root)
    return raw.read_raw(spark, root)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_no_cross_join_and_no_python(spark, stored, name):
    p = plan(REGISTRY[name](stored))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert banned not in p, (name, banned)


@pytest.mark.parametrize("name", ["campaign_cvr_and_lift", "overall_cvr"])
def test_conversions_take_no_expand(spark, stored, name):
    assert "Expand" not in plan(REGISTRY[name](stored))


def test_campaign_filter_reaches_the_scan(spark, stored):
    p = plan(REGISTRY["campaign_gmv_totals"](stored))
    assert "PushedFilters: [IsNotNull(campaign_id)]" in p


def test_column_pruning_on_items(spark, stored):
    p = plan(REGISTRY["campaign_gmv_totals"](stored))
    scan = [line for line in p.splitlines() if line.strip().startswith("ReadSchema")][0]
    for unused in ("order_item_id", "product_id", "quantity", "unit_price", "discount_percent"):
        assert unused not in scan


def test_campaigns_are_broadcast(spark, stored):
    from promolens.operators.campaigns import campaign_items
    p = plan(campaign_items(stored))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_campaign_scans_prune_the_partition(spark, stored):
    from promolens.operators.campaigns import campaign_items
    p = plan(campaign_items(stored))
    assert "PartitionFilters: [isnotnull(campaign_order#" in p and "(campaign_order#" in p


@pytest.fixture
def lazy(spark, stored, monkeypatch):
    """Fresh bundle on the stored layout whose shared tables stay lazy, with the join shapes of large inputs."""
    from promolens.operators import campaigns, categories, customers, marts, quality, sessions
    for m in (campaigns, categories, customers, marts, quality, sessions):
        monkeypatch.setattr(m, "materialize", lambda df, name: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield replace(stored, _cache={})
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_session_order_join_has_no_null_keys(lazy):
    """Session rows without a usable order key are dropped before the join (NULL keys would meet in one task)."""
    from promolens.operators import campaigns
    campaigns.campaign_cvr_and_lift(lazy)
    p = plan(lazy.shared("reached_orders", None))
    assert "isnotnull(try_cast(order_id" in p.lower().replace("(order_id#", "(order_id").replace("isnotnull(cast(order_id", "isnotnull(try_cast(order_id")
    assert lazy.shared("reached_orders", None).where("_okey IS NULL").count() == 0


def test_bloom_filter_runs_in_the_item_scan(lazy):
    """Most items that no campaign session reached are dropped in their scan stage, before any exchange."""
    from promolens.operators import campaigns
    from promolens.plans.bloom import might_match
    p = plan(campaigns.campaign_cvr_and_lift(lazy))
    tree = p.split("\n\n")[0].splitlines()
    at = next(i for i, line in enumerate(tree) if "item_orders_" in line)
    number = tree[at - 1].split("(")[1].split(")")[0]
    assert "Filter" in tree[at - 1] and "xxhash64" in p.split(f"\n({number}) Filter")[1].split("\n\n")[0] and "bit_or" in p
    reached = lazy.shared("reached_orders", None)
    items = lazy.item_orders().select("order_id")
    kept = might_match(items, "order_id", reached, "_okey", reached.count())
    assert "Exchange" not in plan(kept).split("Subqueries")[0].split("\n\n")[0]
    exact = items.join(reached.select(reached["_okey"].alias("order_id")).distinct(), "order_id", "left_semi").count()
    n, all_ = kept.count(), items.count()
    assert exact <= n <= exact + 0.03 * (all_ - exact) + 5 and n < 0.9 * all_
    assert might_match(items, "order_id", reached, "_okey", 10 ** 9) is items           # beyond the proven size: none


def test_bloom_filter_never_drops_a_key(spark):
    from promolens.plans.bloom import might_match
    keys = spark.range(0, 40_000, 7).selectExpr("id * 1000003 - 20000000 AS k")
    rows = spark.range(0, 40_000).selectExpr("id * 1000003 - 20000000 AS k", "id")
    kept = might_match(rows, "k", keys, "k", keys.count())
    assert kept.where("id % 7 = 0").count() == keys.count()
    assert kept.where("id % 7 <> 0").count() < 0.03 * rows.count()


@pytest.mark.parametrize("builder", ["marts.monthly_summary", "campaigns.campaign_summary", "campaigns._campaign_year_revenue",
                                     "categories._category_totals", "categories.fact_category_performance", "categories.category_order_value",
                                     "customers.new_buyers_by_day_type"])
def test_distinct_counts_take_no_expand(lazy, builder):
    module, fn = builder.split(".")
    import importlib
    p = plan(getattr(importlib.import_module(f"promolens.operators.{module}"), fn)(lazy))
    assert "Expand" not in p


@pytest.mark.parametrize("builder", ["marts.monthly_summary", "campaigns.campaign_orders", "categories.shelf"])
def test_item_fact_is_scanned_once_and_stays_in_its_buckets(lazy, builder):
    """One scan of the item fact, and the step keyed by order_id has no exchange of the items."""
    import importlib
    module, fn = builder.split(".")
    df = getattr(importlib.import_module(f"promolens.operators.{module}"), fn)(lazy)
    tree = plan(df).split("\n\n")[0]
    assert tree.count("item_orders_") == 1, tree
    above_scan = tree[:tree.index("Scan parquet")]
    below = above_scan[above_scan.rindex("HashAggregate"):]
    assert "Exchange" not in below, tree


def test_session_masks_need_no_join_distinct_or_sort(lazy):
    from promolens.operators import sessions
    p = plan(sessions.session_masks(lazy))
    for banned in ("Join", "Expand", "SortAggregate", "Window"):
        assert banned not in p, banned


def test_first_orders_need_no_window_or_sort_by_customer(lazy):
    from promolens.operators import customers
    p = plan(customers.first_orders(lazy)[0])
    tree = p.split("\n\n")[0]
    for banned in ("SortAggregate", "Expand"):
        assert banned not in tree, banned
    top = tree[:tree.index("Join")]                       # the numbering of a date's campaigns lies below the join
    assert "Window" not in top and "Sort" not in top and top.count("HashAggregate") >= 4


def test_references_on_the_stored_keys_need_no_exchange(lazy):
    """Q02: items -> orders and activities -> sessions meet in their buckets."""
    for child, parent, key in ((lazy.order_items, lazy.orders, "order_id"), (lazy.session_activities, lazy.website_sessions, "session_id")):
        per_key = child.groupBy(key).count()
        p = plan(per_key.join(parent.select(key), key, "left_anti")).split("\n\n")[0]
        assert "SortMergeJoin" in p and "Exchange" not in p


def test_profile_scans_each_table_once(lazy):
    from promolens.operators import quality
    p = plan(quality.profile(lazy)).split("\n\n")[0]
    assert p.count("Scan parquet") == 7 and "Expand" not in p


def test_bucketed_catalog_joins_without_exchange(spark):
    """Items and orders bucketed by order_id: the item -> order join has no exchange."""
    t = fixture.load(spark, SF01)
    raw.save_raw_tables(t, "bucketed_raw", buckets=8)
    c = raw.read_catalog(spark, "bucketed_raw")
    spark.catalog.setCurrentDatabase("default")
    joined = c.item_orders().groupBy("order_id").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # the shape at scale
    try:
        p = plan(joined).split("\n\n")[0]
        n = joined.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in p and "Exchange" not in p
    assert n == t.item_orders().select("order_id").distinct().count()


def test_bounded_broadcast_falls_back_beyond_the_bound(spark):
    from promolens.plans.joins import bounded_broadcast
    a, b = spark.range(100), spark.range(10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = plan(a.join(bounded_broadcast(b, max_rows=50), "id"))
        large = plan(a.join(bounded_broadcast(b, max_rows=5), "id"))
        known = plan(a.join(bounded_broadcast(b, max_rows=5, known_max_rows=3), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in small and "BroadcastHashJoin" in known
    assert "SortMergeJoin" in large and "BroadcastHashJoin" not in large


def test_tuning_sets_only_unset_keys(spark):
    from promolens.plans.tuning import apply_where_unset
    conf = {"spark.sql.shuffle.partitions": "999", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "7"}
    before = spark.conf.get("spark.sql.adaptive.skewJoin.skewedPartitionFactor", None)
    applied = apply_where_unset(spark, conf)
    try:
        assert "spark.sql.shuffle.partitions" not in applied            # set by the test session
        assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
        if before is None:
            assert applied == {"spark.sql.adaptive.skewJoin.skewedPartitionFactor": "7"}
    finally:
        for k in applied:
            spark.conf.unset(k)
