"""Raw lines to typed lines: names, dates, prices."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketflow.functions.dates import parse_sale_date

# Column names of the raw sheet and the names used from here on.
RAW_COLUMN_NAMES = {
    "ItemNumber": "stock_code",
    "ItemDescription": "description",
    "CustomerId": "customer_id",
    "Sales Quantity 2024": "quantity",
    "Sales Amount 2024": "line_amount",
    "Date": "invoice_date",
    "Showroom": "country",
    "Brand": "brand",
    "GL Class": "category",
    "Vendor Prefix": "vendor",
    "Model": "model",
    "ShortItemNo": "short_item_no",
    "SalesChannel": "sales_channel",
    "Customer_VAT_Status": "vat_status",
    "UNQTRN": "unique_transaction",
    "No of Trans 2024": "num_transactions",
}


def has(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def standardize_columns(df: DataFrame, names: Mapping[str, str] = RAW_COLUMN_NAMES) -> DataFrame:
    """Renames the raw columns that are present."""
    return df.withColumnsRenamed(dict(names))


def as_number(col: Column) -> Column:
    """Numeric value, or null where the text is no number; NaN is no number."""
    number = col.try_cast("double")
    return F.when(~F.isnan(number), number)


def parse_dates(df: DataFrame, column: str = "invoice_date") -> DataFrame:
    if not has(df, column):
        return df
    return df.withColumn(column, parse_sale_date(F.col(column), df.schema[column].dataType))


def date_success(df: DataFrame, column: str = "invoice_date") -> DataFrame:
    """Share of rows whose parsed date is present."""
    return df.agg(F.avg(F.col(column).isNotNull().cast("double")).alias("valid_ratio"))


def require_dates(df: DataFrame, column: str = "invoice_date") -> None:
    """Raises when a table with rows has no parsed date at all; stops at the first good one."""
    if df.where(F.col(column).isNotNull()).isEmpty() and not df.isEmpty():
        raise ValueError(f"no value of {column} could be parsed")


def finite(col: Column) -> Column:
    return F.when(~F.isnan(col) & (F.abs(col) < float("inf")), col)


def compute_prices(df: DataFrame) -> DataFrame:
    """Unit price = amount / quantity; null where that is no finite number."""
    if not has(df, "quantity", "line_amount"):
        return df
    price = F.try_divide(as_number(F.col("line_amount")), as_number(F.col("quantity")))
    return df.withColumn("price", finite(price))


def recompute_amount(df: DataFrame) -> DataFrame:
    """Line amount = quantity × price where a price is known."""
    if not has(df, "price", "quantity", "line_amount"):
        return df
    product = as_number(F.col("quantity")) * F.col("price")
    return df.withColumn("line_amount", F.when(F.col("price").isNotNull(), product).otherwise(F.col("line_amount")))


def nan_as_missing(df: DataFrame) -> DataFrame:
    """NaN of floating columns becomes null."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)) for c in floats})


def typed_lines(df: DataFrame) -> DataFrame:
    """Rename, NaN to null, parse dates, price: everything before cleaning."""
    return df.transform(standardize_columns).transform(nan_as_missing).transform(parse_dates).transform(compute_prices)
