"""The stages of a run over the feed, each computed once per session and folder.

Dimensions are cleaned and written before transactions are flagged, and the flagged table is
written before anything is derived from it. Later steps read those tables, so lost executors
cost a re-read and joins see true sizes.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillproof.catalog import catalog_frame, with_expected
from tillproof.config import FEED_CONFIG, RunConfig
from tillproof.functions.text import normalise_frame
from tillproof.operators import audit, products, star, stores, transactions
from tillproof.plans import feed
from tillproof.scale import bucketed, compiled, new_folder, written
from tillproof.sources.sinks import read_star


class Workspace:
    def __init__(
        self, spark: SparkSession, raw: dict[str, DataFrame], config: RunConfig,
        expected: DataFrame | None = None,
    ):
        self.spark, self.raw, self.config, self.expected = spark, raw, config, expected

    @cached_property
    def stores(self) -> DataFrame:
        return written(stores.clean_stores(self.raw["stores"], self.config), "stores")

    @cached_property
    def products(self) -> DataFrame:
        return written(products.clean_products(self.raw["products"], self.config), "products")

    @cached_property
    def flagged(self) -> DataFrame:
        rows = transactions.flag_transactions(self.raw_rows, self.stores, self.products, self.config)
        with compiled(self.spark):
            return bucketed(rows, "source_row", "flagged", placed=True)

    @property
    def lineage(self) -> DataFrame:
        return transactions.lineage(self.flagged)

    @cached_property
    def sales(self) -> DataFrame:
        return transactions.clean_transactions(self.flagged, self.config)

    # Tables that meet on source_row without a shuffle, the flagged one among them. The raw rows are derived
    # and moved once, here; what is found out about single rows is looked up from there by row number.
    @cached_property
    def raw_rows(self) -> DataFrame:
        return bucketed(self.raw["transactions"], "source_row", "raw-rows")

    @cached_property
    def published_rows(self) -> DataFrame:
        """The cleaned transactions as published, with the place of their source row."""
        return bucketed(transactions.clean_transactions(self.flagged, self.config, row_key=True), "source_row", "published-rows", placed=True)

    @property
    def lineage_rows(self) -> DataFrame:
        return self.lineage

    @cached_property
    def star_path(self) -> str:
        path = new_folder(self.spark, "published-star")
        self.star_report = star.load_star(self.stores, self.products, self.sales, self.config, path)
        return path

    @property
    def star(self) -> dict[str, DataFrame]:
        return read_star(self.spark, self.star_path)

    @cached_property
    def dimension_defects(self) -> DataFrame:
        return written(
            stores.store_defects(self.raw["stores"])
            .unionByName(products.product_defects(self.raw["products"])), "dimension-defects")

    @property
    def detections(self) -> DataFrame:
        return self.dimension_defects.unionByName(transactions.transaction_defects(self.flagged))

    @property
    def quarantine(self) -> DataFrame:
        """Withheld and evidence rows of every slice, with dataset, key and outcome."""
        held = transactions.quarantine_view(self.flagged).select(
            F.lit("transactions").alias("dataset"), "reason_code", "reason_detail", "source_row",
            F.col("transaction_id").alias("row_key"), "disposition")
        sliced = ("ST-01", "ST-02", "PR-01", "PR-02", "PR-04")
        rest = self.dimension_defects.filter(F.col("code").isin(*sliced))
        words = F.broadcast(catalog_frame(self.spark).select("code", "title"))
        return held.unionByName(rest.join(words, "code").select(
            "dataset", F.col("code").alias("reason_code"), F.col("title").alias("reason_detail"),
            "source_row", "row_key", "disposition")).unionByName(self.keyless)

    @property
    def keyless(self) -> DataFrame:
        """Dimension rows without a key. Of equal product rows the first one stands for all."""
        return stores.keyless_rows(stores.prepared_stores(self.raw["stores"]), "store_id", "stores").unionByName(
            stores.keyless_rows(products.drop_exact_duplicates(
                normalise_frame(self.raw["products"], products.COLUMNS)), "product_id", "products"))

    @property
    def dimension_budget(self) -> DataFrame:
        """Every row of both dimensions accounted for."""
        return reduce(DataFrame.unionByName, [
            stores.dimension_budget(self.raw[name], clean, self.dimension_defects, self.keyless.filter(F.col("dataset") == name), name)
            for name, clean in (("stores", self.stores), ("products", self.products))])

    @cached_property
    def ledger(self) -> DataFrame:
        return written(audit.defect_ledger(self.detections, self.config.key_cap), "ledger")

    @cached_property
    def catalog(self) -> DataFrame:
        catalog = catalog_frame(self.spark)
        return catalog if self.expected is None else written(with_expected(catalog, self.expected), "catalog")


_OPEN: dict[tuple[str, str], Workspace] = {}


def open_feed(spark: SparkSession, sf_dir: str, fresh: bool = False) -> Workspace:
    """The workspace over the TPC-H style tables of a folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if fresh or key not in _OPEN:
        raw = {
            "stores": feed.raw_stores(spark, sf_dir),
            "products": feed.raw_products(spark, sf_dir),
            "transactions": feed.raw_transactions(spark, sf_dir),
        }
        work = Workspace(spark, raw, FEED_CONFIG, feed.expected_counts(spark, sf_dir, FEED_CONFIG))
        if fresh:
            return work
        _OPEN[key] = work
    return _OPEN[key]
