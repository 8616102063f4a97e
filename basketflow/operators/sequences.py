"""Time-ordered samples "what was bought before → what was bought next", with time splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketflow.functions.dates import micros
from basketflow.functions.text import format_id_list, parse_id_list
from basketflow.operators.ordering import lay_out, previous_in_layout, row_index
from basketflow.operators.quantiles import exact_quantiles

MAX_HISTORY = 15
MIN_HISTORY = 2


def time_cutoffs(lines: DataFrame, ts: str = "ts", probs=(0.80, 0.90)) -> DataFrame:
    """One row with ``cutoffs``: exact time quantiles in microseconds."""
    return exact_quantiles(lines, {"cutoffs": micros(F.col(ts))}, probs)


def split_of(ts: Column, cutoffs: DataFrame) -> Column:
    """train before the first cutoff, val before the second, test from there on."""
    limits = cutoffs.select("cutoffs").scalar()
    at = micros(ts).cast("double")
    return F.when(at < limits[0], "train").when(at < limits[1], "val").otherwise("test")


def last_country(lines: DataFrame, order: list[str]) -> DataFrame:
    """Country of the customer's latest line, over all splits."""
    return lines.groupBy("user_idx").agg(F.max_by("country", F.struct(*order)).alias("country"))


def build_sequences(
    lines: DataFrame,
    tie: str = "stock_code",
    query_id: str | None = None,
    max_history: int = MAX_HISTORY,
    min_history: int = MIN_HISTORY,
    train_share: float = 0.80,
    val_share: float = 0.90,
) -> DataFrame:
    """One sample per line with at least ``min_history`` earlier lines of its customer.

    ``lines`` has customer_id, user_idx, item_idx, ts and ``tie``, which orders
    lines of one customer and time; country is optional.  History may reach
    back over a split boundary.  Lines without a time are no events: they are
    no samples and stand in no history.  Without a ``query_id`` column samples
    are numbered in (customer, time, tie) order.
    """
    order = ["ts", tie]
    extra = [query_id] if query_id and query_id != tie else []
    country = ["country"] if "country" in lines.columns else []
    lines = lines.where(F.col("ts").isNotNull()).select("customer_id", "user_idx", "item_idx", *order, *extra, *country)
    # One layout, written once, serves histories, cutoffs and countries.
    rows = lay_out(lines, [F.col(c) for c in ("user_idx", *order)])
    lines = rows.select(*lines.columns)
    samples = previous_in_layout(rows.drop("country"), "user_idx", "item_idx", "history", max_history)
    samples = samples.where(F.size("history") >= min_history)
    samples = samples.withColumn("split", split_of(F.col("ts"), time_cutoffs(lines, "ts", (train_share, val_share))))
    if "country" in lines.columns:
        samples = samples.join(last_country(lines, order), "user_idx")
    if query_id:
        samples = samples.withColumnRenamed(query_id, "query_id")
    else:
        samples = row_index(samples, [F.col(c) for c in ("user_idx", *order)], "query_id")
    return samples.select(
        "query_id", "customer_id", "user_idx", "ts", "history",
        F.col("item_idx").alias("pos_item_idx"), *country, "split",
    )


def of_split(sequences: DataFrame, *splits: str) -> DataFrame:
    return sequences.where(F.col("split").isin(*splits))


def train_dev_split(train: DataFrame, share: float = 0.90, ts: str = "ts") -> DataFrame:
    """Adds ``part``: train before the time quantile ``share`` of the table, dev from there on."""
    limit = time_cutoffs(train, ts, (share,)).select("cutoffs").scalar()
    return train.withColumn("part", F.when(micros(F.col(ts)).cast("double") < limit[0], "train").otherwise("dev"))


def last_items(history: Column, count: int = MAX_HISTORY) -> Column:
    """The last ``count`` entries of an array."""
    return F.slice(history, F.greatest(F.size(history) - (count - 1), F.lit(1)), F.lit(count))


def valid_items(history: Column, n_items: int) -> Column:
    """Entries that are item indices below ``n_items``."""
    return F.filter(history, lambda x: (x >= 0) & (x < n_items))


def to_text_lists(sequences: DataFrame) -> DataFrame:
    """Exchange form: ``history_idx`` as space-separated text instead of an array."""
    return sequences.withColumn("history_idx", format_id_list(F.col("history"))).drop("history")


def from_text_lists(sequences: DataFrame) -> DataFrame:
    return sequences.withColumn("history", parse_id_list(F.col("history_idx"))).drop("history_idx")


def until_last_train(lines: DataFrame, sequences: DataFrame, ts: str = "ts") -> DataFrame:
    """Lines at or before the latest training sample."""
    cutoff = of_split(sequences, "train").agg(F.max("ts")).scalar()
    return lines.where(F.col(ts) <= cutoff)


def dataset_statistics(sequences: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """``(name, value)``: users, items and samples per split."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("name"), "value")
    splits = sequences.groupBy("split").agg(F.count(F.lit(1)).alias("value"))
    splits = splits.select(F.concat("split", F.lit("_sequences")).alias("name"), "value")
    return count(users, "n_users").unionByName(count(items, "n_items")).unionByName(splits)
