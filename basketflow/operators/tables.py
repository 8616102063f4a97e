"""Clean tables: interactions, item catalog, customers, dense id maps, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.operators.ordering import row_index
from basketflow.operators.quantiles import grouped_prices
from basketflow.schemas import INTERACTIONS

ITEM_ATTRIBUTES = ("description", "brand", "category", "vendor")


def interactions_table(lines: DataFrame) -> DataFrame:
    return lines.select(*INTERACTIONS.fieldNames())


def sorted_for_export(interactions: DataFrame) -> DataFrame:
    """Ordered by customer and date; needed only where a file is read in order."""
    return interactions.orderBy("customer_id", "invoice_date", "stock_code")


def modes(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per key and column, smallest on a tie, null when there is none.

    Values are counted per key first: the second step sees one row per
    distinct value, however many lines a popular key has.
    """
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    cells = df.select(key, F.inline(F.array(*pairs))).where(F.col("value").isNotNull())
    counts = cells.groupBy(key, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = lambda c: F.min_by(
        F.when(F.col("column") == c, F.col("value")),
        F.when(F.col("column") == c, F.struct(-F.col("n"), F.col("value"))),
    )
    return counts.groupBy(key).agg(*[best(c).alias(c) for c in columns])


def item_catalog(interactions: DataFrame, attributes: Sequence[str] = ITEM_ATTRIBUTES) -> DataFrame:
    """Per item the usual attributes, median and mean price and the number of lines; each attribute named has its values counted."""
    prices = grouped_prices(interactions, ["stock_code"], "price", "price_median", "price_mean", "popularity")
    if attributes:
        prices = prices.join(modes(interactions, "stock_code", attributes), "stock_code", "left")
    order = ("stock_code", "description", "price_median", "price_mean", "popularity", "brand", "category", "vendor")
    return prices.select(*[c for c in order if c not in ITEM_ATTRIBUTES or c in attributes])


def by_popularity(items: DataFrame) -> DataFrame:
    return items.orderBy(F.col("popularity").desc(), "stock_code")


def customer_table(interactions: DataFrame) -> DataFrame:
    """First and last date, distinct dates, lines, usual country and spend per customer."""
    # Distinct dates are counted from (customer, date) rows, so a large customer is split by date.
    days = interactions.groupBy("customer_id", "invoice_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("line_amount").alias("spent")
    )
    totals = days.groupBy("customer_id").agg(
        F.min("invoice_date").alias("first_date"),
        F.max("invoice_date").alias("last_date"),
        F.count("invoice_date").alias("n_events"),
        F.sum("n").alias("n_lines"),
        F.sum("spent").alias("total_spent"),
    )
    country = modes(interactions, "customer_id", ["country"]).withColumnRenamed("country", "country_mode")
    return totals.join(country, "customer_id", "left").select(
        "customer_id", "first_date", "last_date", "n_events", "n_lines", "country_mode", "total_spent"
    )


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """``(key, name)``: ids 0, 1, 2, … in the order of the distinct keys."""
    return row_index(df.select(key).where(F.col(key).isNotNull()).distinct(), [F.col(key)], name)


def item_id_map(interactions: DataFrame) -> DataFrame:
    return dense_ids(interactions, "stock_code", "item_idx")


def customer_id_map(interactions: DataFrame) -> DataFrame:
    return dense_ids(interactions, "customer_id", "user_idx")


def with_ids(interactions: DataFrame, item_map: DataFrame, customer_map: DataFrame) -> DataFrame:
    """Interactions with both dense ids; rows unknown to a map are left out."""
    return interactions.join(item_map, "stock_code").join(customer_map, "customer_id")


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """``(column, bin, low, high, n)`` with equal-width bins; the last bin includes its upper edge."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    ranges = df.agg(*[F.min(c).cast("double").alias(f"{c}_min") for c in columns],
                    *[F.max(c).cast("double").alias(f"{c}_max") for c in columns])
    edges = ranges.select(F.struct("*")).scalar()
    low = F.lit(None).cast("double")
    high = low
    for c in columns:
        low = F.when(F.col("column") == c, edges[f"{c}_min"]).otherwise(low)
        high = F.when(F.col("column") == c, edges[f"{c}_max"]).otherwise(high)
    # A column with a single value is spread over one unit around it.
    flat = low == high
    low, high = F.when(flat, low - 0.5).otherwise(low), F.when(flat, high + 0.5).otherwise(high)
    rows = df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())
    rows = rows.withColumn("low", low).withColumn("width", (high - low) / bins)
    place = F.least(F.floor((F.col("value") - F.col("low")) / F.col("width")), F.lit(bins - 1)).cast("long")
    counts = rows.withColumn("bin", place).groupBy("column", "bin", "low", "width")
    return counts.agg(F.count(F.lit(1)).alias("n")).select(
        "column", "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("low"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("high"),
        "n",
    )
