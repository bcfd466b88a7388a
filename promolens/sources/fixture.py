"""Build the seven raw tables from the driver's TPC-H-like test tables.

The mapping is the one documented in FIXTURES.md section 3; the DuckDB prelude
in :mod:`promolens.plans.oracle` states the same mapping in SQL. Everything is
derived from ``orders``, ``lineitem``, ``part`` and ``events`` so that the work
grows with them; the campaign years are the years spanned by the orders.

Scale notes: the big-by-big join is lineitem x orders (shuffle on the
order key); products are broadcast behind a row-count check; the campaign
calendar (at most 7 days a year) is broadcast by construction; the enrolment
lookup joins only the items of campaign orders, so the bulk of lineitem is not
shuffled a second time.
"""

from __future__ import annotations

from decimal import Decimal
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.joins import bounded_broadcast
from ..plans.materialize import materialize
from . import schemas as S
from .tables import CAMPAIGN_FLAG, ORDER_COLUMNS, Tables

# Fixed values of the test-table mapping (must equal FIXTURES.md section 3).
# (event number, campaign name, month, first day, length in days)
EVENTS = [
    (1, "Spring Sale", 4, 13, 3),
    (2, "9.9 Sale", 9, 9, 1),
    (3, "10.10 Sale", 10, 10, 1),
    (4, "11.11 Sale", 11, 11, 1),
    (5, "12.12 Sale", 12, 12, 1),
]
# campaign_type by (year + event) % 4
CAMPAIGN_TYPES = ["flash-sale", "discount", "bundle", "voucher"]
# device_type by k % 3
DEVICE_TYPES = ["Mobile", "Desktop", "Tablet"]
# page_url by event_type; 'error' is '/checkout' for even ids, '/billing' for odd
PAGE_URLS = {"view": "/Home", "signup": "/Cart", "purchase": "/Thank-You"}
PRODUCT_URL_PREFIX = "/product/"
MAINTENANCE_RATE = "0.0200"
COMMISSION_BASE, COMMISSION_STEP = "0.0400", "0.0100"
SELLER_MOD, ENROL_MOD, DISCOUNT_MOD, DISCOUNT_BASE = 97, 5, 40, 5
# item_status as the stored items hold it
COMPLETED, REFUNDED, CANCELLED = 0, 1, 2
NON_CAMPAIGN_EVERY = 4          # o_orderkey % 4 = 0 -> never a campaign order
# A DateType year lies in 1..9999, so the calendar has at most this many rows.
CAMPAIGN_ROWS_BOUND = len(EVENTS) * 9999


def read_driver_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    names = ("orders", "lineitem", "part", "events")
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def campaigns_from_orders(orders: DataFrame) -> DataFrame:
    """Five events for every year spanned by the orders, with a dense index."""
    event_structs = F.array(*[
        F.struct(F.lit(e).alias("e"), F.lit(name).alias("campaign_name"),
                 F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(n).alias("len"))
        for e, name, m, d, n in EVENTS])
    yr = orders.agg(F.min(F.year("o_orderdate")).alias("y0"),
                    F.max(F.year("o_orderdate")).alias("y1"))
    c = (yr.select("y0", "y1", F.explode(F.sequence("y0", "y1")).alias("y"))
           .select("*", F.explode(event_structs).alias("ev"))
           .select("y", "y0", "y1", "ev.*"))
    start = F.make_date("y", "m", "d")
    types = F.array(*[F.lit(t) for t in CAMPAIGN_TYPES])
    return c.select(
        F.concat(F.lit("C"), F.col("y").cast("string"), F.lit("-"),
                 F.col("e").cast("string")).alias("campaign_id"),
        "campaign_name",
        start.alias("start_date"),
        F.date_add(start, F.col("len") - 1).alias("end_date"),
        F.element_at(types, F.pmod(F.col("y") + F.col("e"), F.lit(4)) + 1).alias("campaign_type"),
        ((F.col("y") - F.col("y0")) * len(EVENTS) + F.col("e") - 1).cast("long").alias("campaign_idx"),
    )


def map_orders(orders: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Orders with a campaign when the date lies in a window (and key % 4 <> 0)."""
    calendar = F.broadcast(campaigns.select(
        "campaign_id", F.explode(F.sequence("start_date", "end_date")).alias("order_date")))
    o = orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.to_date("o_orderdate").alias("order_date"),
        _customer_id("o_custkey").alias("customer_id"),
        F.col("o_totalprice").cast(S.MONEY_14).alias("total_amount"),
        "o_custkey",
    )
    return (o.join(calendar, "order_date", "left")
             .withColumn("campaign_id", F.when(
                 F.pmod("order_id", F.lit(NON_CAMPAIGN_EVERY)) != 0, F.col("campaign_id"))))


def map_products(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.select(
        _product_id(k).alias("product_id"),
        F.concat(F.lit("S"), F.pmod(k, F.lit(SELLER_MOD)).cast("string")).alias("seller_id"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("product_name"),
        F.lit(MAINTENANCE_RATE).cast(S.RATE).alias("maintenance_rate"),
        (F.lit(COMMISSION_BASE).cast(S.RATE)
         + F.lit(COMMISSION_STEP).cast(S.RATE) * F.pmod(k, F.lit(3))).cast(S.RATE).alias("commission_rate"),
        F.col("p_size").cast(S.WEIGHT).alias("weight"),
        k.alias("p_partkey"),
    )


def map_product_campaign(products: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Every (product, campaign) with p_partkey % 5 = campaign year % 5."""
    c = F.broadcast(campaigns.select(
        "campaign_id", F.pmod(F.year("start_date"), F.lit(ENROL_MOD)).alias("k5")))
    p = products.select("product_id", "p_partkey",
                        F.pmod("p_partkey", F.lit(ENROL_MOD)).alias("k5"))
    return p.join(c, "k5").select(
        F.concat("campaign_id", F.lit("/"), "product_id").alias("product_campaign_id"),
        "product_id", "campaign_id",
        (F.lit(DISCOUNT_BASE) + F.pmod("p_partkey", F.lit(DISCOUNT_MOD))).cast(S.PERCENT)
        .alias("discount_percent"),
    )


def joined_items(lineitem: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """Items with the rates of their product and the columns of their order (NULL for orphans), in the order of the join by order key.

    The columns are the few that :func:`item_columns` needs, as numbers: this is what the shuffles carry and the load step stores.
    The products are joined first, on the numeric key.
    """
    li = lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.col("l_quantity").cast("int").alias("quantity"),
        _two_places("l_extendedprice", S.MONEY_12).alias("price"),
        _two_places("l_discount", T.DecimalType(4, 2)).alias("disc"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), REFUNDED)
         .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), CANCELLED)
         .otherwise(COMPLETED).cast("tinyint").alias("status"),
    )
    rates = bounded_broadcast(products.select(F.col("p_partkey").alias("l_partkey"), "commission_rate", "maintenance_rate"))
    o = orders.select(F.col("order_id").alias("l_orderkey"), "order_date", "o_custkey", "campaign_id",
                      F.lit(True).alias("_has_order"))
    return li.join(rates, "l_partkey", "left").join(o, "l_orderkey", "left")


def item_columns(joined: DataFrame) -> DataFrame:
    """Order items with the order columns, from :func:`joined_items` (and ``product_campaign_id``, if looked up already)."""
    line_total = F.round(F.col("price") * (F.lit(1) - F.col("disc")), 2).cast(S.MONEY_14)
    items = joined.withColumn("line_total", line_total)
    looked_up = [c for c in ("product_campaign_id",) if c in joined.columns]
    return items.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_item_id"),
        F.col("l_orderkey").alias("order_id"),
        _product_id("l_partkey").alias("product_id"),
        "quantity",
        F.col("price").alias("unit_price"),
        F.round(F.col("price") * (F.lit(1) - F.col("disc")), 2).cast(S.MONEY_12)
        .alias("unit_price_after_discount"),
        "line_total",
        (F.col("disc") * 100).cast(S.PERCENT).alias("discount_percent"),
        F.round(F.col("line_total") * F.col("commission_rate"), 2).cast(S.MONEY_12)
        .alias("commission_amount"),
        F.round(F.col("line_total") * F.col("maintenance_rate"), 2).cast(S.MONEY_12)
        .alias("maintenance_amount"),
        F.when(F.col("status") == REFUNDED, "Refunded").when(F.col("status") == CANCELLED, "Cancelled")
         .otherwise("Completed").alias("item_status"),
        F.when(F.col("l_linenumber") == 1, 1).otherwise(0).cast("short").alias("is_campaign"),
        "order_date", _customer_id("o_custkey").alias("customer_id"), "campaign_id", "_has_order", *looked_up,
    )


def enrolled(campaign_items: DataFrame, product_campaign: DataFrame) -> DataFrame:
    """Items of campaign orders with the enrolment of their product in that campaign (NULL if there is none).

    Enrolments are products times campaigns, which the planner takes for far fewer: left to it, all of them would be broadcast.
    """
    pc = product_campaign.select("product_id", "campaign_id", "product_campaign_id").hint("merge")
    return campaign_items.join(pc, ["product_id", "campaign_id"], "left")


def not_enrolled(other_items: DataFrame) -> DataFrame:
    return other_items.withColumn("product_campaign_id", F.lit(None).cast("string"))


def map_items(lineitem: DataFrame, orders: DataFrame, products: DataFrame,
              product_campaign: DataFrame, persist: bool = False) -> DataFrame:
    """Order items, still carrying the order columns (NULL for orphans).

    ``persist`` keeps the item x order join (memory, spilling to disk) so
    that writing several outputs from it runs the join once.
    """
    items = item_columns(joined_items(lineitem, orders, products))
    if persist:
        items = items.persist(StorageLevel.MEMORY_AND_DISK)
    # Enrolment lookup only for campaign items; the rest keep a NULL id.
    has = F.col("campaign_id").isNotNull()
    return enrolled(items.where(has), product_campaign).unionByName(not_enrolled(items.where(~has)))


def map_sessions(events: DataFrame, campaigns: DataFrame) -> DataFrame:
    """One session per (user, day) of events.

    The campaign slot is ``k % (2 * number of campaigns)``; the count enters
    as a scalar subquery, so building the plan runs no job.
    """
    ev = events.select("event_id", "ts", "user_id", "event_type",
                       F.to_date("ts").alias("session_date"))
    s = ev.groupBy("user_id", "session_date").agg(
        F.min("ts").alias("session_start_time"),
        F.max("ts").alias("session_end_time"),
        F.min(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("oid"),
    )
    k = F.col("user_id") * 31 + F.dayofmonth("session_date")
    modulus = campaigns.agg((F.count(F.lit(1)) * 2).alias("m")).scalar()
    s = s.withColumn("k", k).withColumn("slot", F.pmod("k", modulus))
    c = F.broadcast(campaigns.select("campaign_id", F.col("campaign_idx").alias("slot")))
    devices = F.array(*[F.lit(d) for d in DEVICE_TYPES])
    return s.join(c, "slot", "left").select(
        _session_id("user_id", "session_date").alias("session_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_id"),
        "session_date", "session_start_time", "session_end_time",
        F.lit(None).cast("string").alias("utm_source"),
        "campaign_id",
        F.element_at(devices, F.pmod("k", F.lit(3)).cast("int") + 1).alias("device_type"),
        F.col("oid").cast("string").alias("order_id"),
    )


def map_activities(events: DataFrame) -> DataFrame:
    et, eid = F.col("event_type"), F.col("event_id")
    url = (F.when(et == "view", PAGE_URLS["view"])
            .when(et == "click", F.concat(F.lit(PRODUCT_URL_PREFIX), eid.cast("string")))
            .when(et == "signup", PAGE_URLS["signup"])
            .when(et == "error", F.when(F.pmod(eid, F.lit(2)) == 0, "/checkout").otherwise("/billing"))
            .when(et == "purchase", PAGE_URLS["purchase"]))
    return events.select(
        eid.alias("activity_id"),
        _session_id("user_id", F.to_date("ts")).alias("session_id"),
        url.alias("page_url"),
        F.col("ts").alias("session_start_time"),
        F.col("ts").alias("session_end_time"),
    )


def _two_places(amount: str, kind: T.DecimalType) -> F.Column:
    """A double as a 2-place decimal: by way of its cents if they give it back exactly, which spares the cast's detour over a text."""
    x = F.col(amount)
    cents = F.floor(x * 100 + 0.5)
    exact = (F.abs(x) < 1e10) & (cents.cast("double") / F.lit(100.0) == x)
    return F.when(exact, (cents.cast("decimal(12,0)") * F.lit(Decimal("0.01"))).cast(kind)).otherwise(x.cast(kind))


def _customer_id(key) -> F.Column:
    return F.concat(F.lit("U"), F.col(key).cast("string"))


def _product_id(key) -> F.Column:
    return F.concat(F.lit("P"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _session_id(user, day) -> F.Column:
    user = F.col(user) if isinstance(user, str) else user
    day = F.col(day) if isinstance(day, str) else day
    return F.concat(F.lit("W"), user.cast("string"), F.lit("-"), F.date_format(day, "yyyy-MM-dd"))


def load(spark: SparkSession, sf_dir: str, persist: bool = False) -> Tables:
    """The raw tables, mapped from the driver tables under ``sf_dir``.

    With ``persist`` the mapped items are kept while several outputs are
    written from them; call ``Tables.release()`` afterwards.
    """
    d = read_driver_tables(spark, sf_dir)
    campaigns_full = campaigns_from_orders(d["orders"])
    orders = map_orders(d["orders"], campaigns_full)
    products = map_products(d["part"])
    pc = map_product_campaign(products, campaigns_full)
    items = map_items(d["lineitem"], orders, products, pc, persist=persist)
    sessions = map_sessions(d["events"], campaigns_full)
    activities = map_activities(d["events"])
    item_orders = (items.where(F.col("_has_order"))
                        .select(*S.conform_columns(items, S.ORDER_ITEMS, fill=True),
                                "order_date", "customer_id", "campaign_id"))
    t = Tables(
        orders=S.conform(orders, S.ORDERS, fill=True),
        order_items=S.conform(items, S.ORDER_ITEMS, fill=True),
        campaigns=S.conform(campaigns_full, S.CAMPAIGNS, fill=True),
        products=S.conform(products, S.PRODUCTS, fill=True),
        product_campaign=S.conform(pc, S.PRODUCT_CAMPAIGN, fill=True),
        website_sessions=S.conform(sessions, S.WEBSITE_SESSIONS, fill=True),
        session_activities=S.conform(activities, S.SESSION_ACTIVITIES, fill=True),
        item_orders_df=item_orders,
        campaign_rows_bound=CAMPAIGN_ROWS_BOUND,
    )
    if persist:
        t.hold(items)
    return t


class StoredTables(Tables):
    """The raw tables mapped from the driver tables, each stored when a query first asks for it.

    A query so pays for the tables it reads alone. Order items and the item x order fact are one stored table, split by the campaign
    flag while it is written; it is neither dealt out nor sorted once more, as its rows come in the order of the join by order_id.
    Stored are the columns of the join; texts and amounts are made from them when they are read, only those a query asks for.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._d = read_driver_tables(spark, sf_dir)
        self._spark = spark
        self._mapped_campaigns = campaigns_from_orders(self._d["orders"])
        self._mapped_orders = map_orders(self._d["orders"], self._mapped_campaigns)
        self._mapped_products = map_products(self._d["part"])
        self._mapped_enrolments = map_product_campaign(self._mapped_products, self._mapped_campaigns)
        self.campaign_rows_bound = CAMPAIGN_ROWS_BOUND
        self._cache = {}

    @property
    def spark(self) -> SparkSession:
        return self._spark

    @cached_property
    def orders(self) -> DataFrame:
        return materialize(S.conform(self._mapped_orders, S.ORDERS, fill=True), "raw-orders")

    @cached_property
    def campaigns(self) -> DataFrame:
        return materialize(S.conform(self._mapped_campaigns, S.CAMPAIGNS, fill=True), "raw-campaigns")

    @cached_property
    def products(self) -> DataFrame:
        return materialize(S.conform(self._mapped_products, S.PRODUCTS, fill=True), "raw-products")

    @cached_property
    def product_campaign(self) -> DataFrame:
        return materialize(S.conform(self._mapped_enrolments, S.PRODUCT_CAMPAIGN, fill=True), "raw-product-campaign")

    @cached_property
    def website_sessions(self) -> DataFrame:
        return materialize(S.conform(map_sessions(self._d["events"], self._mapped_campaigns), S.WEBSITE_SESSIONS, fill=True), "raw-sessions")

    @cached_property
    def session_activities(self) -> DataFrame:
        return materialize(S.conform(map_activities(self._d["events"]), S.SESSION_ACTIVITIES, fill=True), "raw-activities")

    @cached_property
    def _items(self) -> DataFrame:
        joined = joined_items(self._d["lineitem"], self._mapped_orders, self._mapped_products)
        split = materialize(joined.withColumn(CAMPAIGN_FLAG, F.col("campaign_id").isNotNull()), "raw-items", partition_by=CAMPAIGN_FLAG)
        flag = F.col(CAMPAIGN_FLAG)
        camp = split.where(flag).drop(CAMPAIGN_FLAG).withColumn("product_id", _product_id("l_partkey"))
        # Products are a small file that few tasks read, enrolments several rows of each.
        enrolments = map_product_campaign(self._mapped_products.repartition("p_partkey"), self._mapped_campaigns)
        camp = materialize(enrolled(camp, enrolments).drop("product_id"), "raw-campaign-items")
        rest = not_enrolled(split.where(~flag).drop(CAMPAIGN_FLAG))
        return (item_columns(camp).withColumn(CAMPAIGN_FLAG, F.lit(True))
                .unionByName(item_columns(rest).withColumn(CAMPAIGN_FLAG, F.lit(False))))

    @cached_property
    def order_items(self) -> DataFrame:
        return S.conform(self._items, S.ORDER_ITEMS, fill=True)

    @cached_property
    def item_orders_df(self) -> DataFrame:
        items = self._items
        return items.where(F.col("_has_order")).select(*S.conform_columns(items, S.ORDER_ITEMS, fill=True), *ORDER_COLUMNS, CAMPAIGN_FLAG)


def write_raw_tables(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Load step: map the driver tables once and store the raw layout under ``root``."""
    from .raw import write_raw

    t = load(spark, sf_dir, persist=True)
    try:
        write_raw(t, root)
    finally:
        t.release()
