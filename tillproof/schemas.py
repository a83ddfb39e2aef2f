"""Table contracts. Raw tables are text only; clean tables have fixed, typed column lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

RAW_COLUMNS: dict[str, tuple[str, ...]] = {
    "stores": (
        "store_id", "store_name", "city", "state", "zip_code", "region", "opened_date",
    ),
    "products": ("product_id", "product_name", "category", "unit_price", "supplier_id"),
    "transactions": (
        "transaction_id", "transaction_date", "store_id", "product_id", "customer_id",
        "quantity", "unit_price", "total_amount",
    ),
}

RAW_SCHEMAS: dict[str, T.StructType] = {
    name: T.StructType([T.StructField(c, T.StringType(), True) for c in cols])
    for name, cols in RAW_COLUMNS.items()
}

STORES_CLEAN = (
    "store_id", "store_name", "city", "state", "zip_code", "zip_is_suspect", "region",
    "region_is_imputed", "opened_date",
)
PRODUCTS_CLEAN = (
    "product_id", "product_name", "category", "category_is_imputed", "list_unit_price",
    "price_is_imputed", "price_conflict", "supplier_id",
)
TRANSACTIONS_CLEAN = (
    "transaction_id", "transaction_date", "store_id", "product_id", "customer_id", "is_guest",
    "quantity", "unit_price", "extended_amount", "total_amount", "discount_amount",
    "has_discount", "is_return",
)

MONEY = "decimal(18,2)"


def require_columns(df: DataFrame, columns: tuple[str, ...] | list[str], what: str) -> None:
    """Fail early, by name, when a contracted column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing column(s) {missing}")
