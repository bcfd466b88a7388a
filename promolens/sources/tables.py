"""The seven raw tables as one lazily evaluated bundle.

``Tables`` is what every metric builder takes. It holds plain DataFrames; the
only extra is ``item_orders``: order items already joined to their order
(inner join on ``order_id``), carrying ``order_date``, ``customer_id`` and
``campaign_id``. A source that joins the two anyway (the test-table mapping
does) hands that frame over, so metrics do not repeat the largest join;
otherwise it is built here with a plain equi-join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import bounded_broadcast

ORDER_COLUMNS = ("order_date", "customer_id", "campaign_id")
# Partition column of the stored item x order fact: campaign_id IS NOT NULL.
CAMPAIGN_FLAG = "campaign_order"


@dataclass
class Tables:
    orders: DataFrame
    order_items: DataFrame
    campaigns: DataFrame
    products: DataFrame
    product_campaign: DataFrame
    website_sessions: DataFrame
    session_activities: DataFrame
    item_orders_df: DataFrame | None = None
    # Provable upper bound on the campaign rows, if the source knows one.
    campaign_rows_bound: int | None = None
    _cache: dict = field(default_factory=dict, repr=False)

    @property
    def spark(self):
        return self.orders.sparkSession

    def item_orders(self, campaign: bool | None = None) -> DataFrame:
        """Order items inner-joined to orders (one row per item).

        ``campaign=True`` keeps campaign orders (``campaign_id IS NOT NULL``),
        ``False`` the others. When the stored fact is partitioned by the
        campaign flag, the flag is filtered too, so the scan prunes whole
        directories (campaign orders are a few percent of all orders).
        """
        if self.item_orders_df is not None:
            df = self.item_orders_df
        else:
            o = self.orders.select("order_id", *ORDER_COLUMNS)
            df = self.order_items.join(o, "order_id")
        if campaign is None:
            return df
        if CAMPAIGN_FLAG in df.columns:
            df = df.where(F.col(CAMPAIGN_FLAG) == F.lit(bool(campaign)))
        cid = F.col("campaign_id")
        return df.where(cid.isNotNull() if campaign else cid.isNull())

    def shared(self, key: str, build):
        """A sub-result used by several metrics, built once per bundle."""
        k = ("shared", key)
        if k not in self._cache:
            self._cache[k] = build()
        return self._cache[k]

    def campaigns_small(self) -> DataFrame:
        """Campaigns, broadcast when their number is proven small."""
        if "campaigns" not in self._cache:
            self._cache["campaigns"] = bounded_broadcast(
                self.campaigns, known_max_rows=self.campaign_rows_bound)
        return self._cache["campaigns"]

    def products_small(self, *cols: str) -> DataFrame:
        """A projection of products, broadcast only below the row bound."""
        key = ("products",) + cols
        if key not in self._cache:
            df = self.products.select(*cols) if cols else self.products
            self._cache[key] = bounded_broadcast(df)
        return self._cache[key]

    def hold(self, df: DataFrame) -> None:
        """Register a persisted frame that ``release`` unpersists."""
        self._cache.setdefault("held", []).append(df)

    def release(self) -> None:
        for df in self._cache.pop("held", []):
            df.unpersist()

    def register_views(self) -> list[str]:
        """Register the raw tables as temp views (``raw_orders`` ...) for Spark SQL users."""
        for name, df in self.as_dict().items():
            df.createOrReplaceTempView(name)
        return list(self.as_dict())

    def as_dict(self) -> dict[str, DataFrame]:
        return {
            "raw_orders": self.orders,
            "raw_order_items": self.order_items,
            "raw_campaigns": self.campaigns,
            "raw_products": self.products,
            "raw_product_campaign": self.product_campaign,
            "raw_website_sessions": self.website_sessions,
            "raw_session_activities": self.session_activities,
        }
