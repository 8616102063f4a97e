"""The registered queries of the corpus operators and the pipeline, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from basketflow.llm import queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = queries.QUERIES | {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = dict(queries.ORACLES)
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
