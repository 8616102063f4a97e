"""The row rules on a stream of raw lines.

Renaming, typing, the row rules and the text rules keep no state, so the
batch operators apply to a streaming table unchanged.  Steps that compare
rows (duplicates, merge, outliers, frequencies) stay in the batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from basketflow.operators.clean import CleaningRules, drop_non_products, keep_valid_rows, normalize_lines
from basketflow.operators.ingest import typed_lines


def valid_lines(lines: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Typed, valid, normalised product lines of a batch or streaming table."""
    rows = keep_valid_rows(typed_lines(lines), rules)
    return drop_non_products(normalize_lines(rows), rules.non_product_patterns)


def start(lines: DataFrame, path: str, checkpoint: str, rules: CleaningRules = CleaningRules(), **trigger):
    """Appends the valid lines of a stream to a Parquet table."""
    writer = valid_lines(lines, rules).writeStream.format("parquet").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()
