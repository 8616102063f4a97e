"""The preparation job: raw lines to clean tables, id maps, sequences and reports.

The raw lines are scanned once; rows and counters come from one cleaning
chain.  Each table is written before the next step reads it, so later steps
start from files that survive a lost executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketflow.operators.clean import CleaningRules, clean_with_counts, row_counts, size_checks
from basketflow.operators.ingest import require_dates, typed_lines
from basketflow.operators.negatives import with_negatives
from basketflow.operators.sequences import build_sequences
from basketflow.operators.tables import (
    customer_id_map, customer_table, interactions_table, item_catalog, item_id_map, with_ids,
)
from basketflow.sources.tables import read_id_maps, write_report, write_sequences, write_table


def prepare(
    raw: DataFrame,
    folder: str,
    rules: CleaningRules = CleaningRules(),
    negatives: int = 0,
    seed: int = 42,
) -> None:
    """Writes every prepared table below ``folder``."""
    spark: SparkSession = raw.sparkSession
    cleaned, removed, lines = clean_with_counts(typed_lines(raw), rules)
    if "invoice_date" in lines.columns:
        require_dates(lines)
    write_table(interactions_table(cleaned), f"{folder}/interactions_clean")
    interactions = spark.read.parquet(f"{folder}/interactions_clean")
    write_table(item_catalog(interactions), f"{folder}/items_clean")
    write_table(customer_table(interactions), f"{folder}/customers_clean")
    write_table(item_id_map(interactions), f"{folder}/item_id_map")
    write_table(customer_id_map(interactions), f"{folder}/customer_id_map")
    item_map, customer_map = read_id_maps(spark, folder)
    mapped = with_ids(interactions, item_map, customer_map).withColumnRenamed("invoice_date", "ts")
    sequences = build_sequences(mapped, tie="stock_code")
    if negatives:
        sequences = with_negatives(sequences, item_map.count(), negatives, seed)
    write_sequences(sequences, f"{folder}/sequences")
    write_report(removed.orderBy("ordinal"), f"{folder}/quality_report")
    raw_rows = lines.agg(F.sum("_copies").alias("rows")).select(F.lit("raw").alias("table"), F.coalesce("rows", F.lit(0)).alias("rows"))
    counts = row_counts(
        interactions=interactions,
        items=spark.read.parquet(f"{folder}/items_clean"), customers=spark.read.parquet(f"{folder}/customers_clean"),
    )
    write_report(raw_rows.unionByName(counts), f"{folder}/row_counts")
    write_report(size_checks(interactions), f"{folder}/size_checks")


def prepared(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")
