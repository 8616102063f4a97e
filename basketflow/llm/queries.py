"""One thin query per operator: reads the table, calls the operator, derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketflow.llm import oracles
from basketflow.llm.decontaminate import contaminated
from basketflow.llm.histogram_sort import shard_rows
from basketflow.llm.licence_rules import licence_scan
from basketflow.llm.line_templates import drop_templates
from basketflow.llm.nbsvm import quality_scores
from basketflow.llm.norm_search import integer_vectors, top_products
from basketflow.llm.odd_sketch import near_duplicates
from basketflow.llm.pseudo_likelihood import pseudo_likelihood
from basketflow.llm.spelling_groups import spelling_groups
from basketflow.llm.temperature_mix import temperature_mix
from basketflow.llm.term_search import term_search
from basketflow.llm.token_counts import token_counts
from basketflow.llm.zip_warc import page_records, write_packages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, with its SQL where there is one."""

    def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(oracles.PAGE_RECORDS)
def op1_zip_warc(spark: SparkSession, folder: str) -> DataFrame:
    return page_records(write_packages(table(spark, folder, "pages"), least_bytes=0))


@query()
def op2_pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    return pseudo_likelihood(table(spark, folder, "documents"))


@query()
def op5_odd_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query()
def op9_nbsvm(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op10_block_max_wand(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(oracles.MIX)
def op7_temperature(spark: SparkSession, folder: str) -> DataFrame:
    mix = temperature_mix(table(spark, folder, "documents"), target_entropy=0.95, max_repeats=4.0)
    return mix.select("doc_id", "source", "mix_tokens", F.round("mix_weight", 9).alias("mix_weight"), "mix_quota", "mix_pass")


@query(oracles.SHARDS)
def op4_histogram_sort(spark: SparkSession, folder: str) -> DataFrame:
    shards = shard_rows(table(spark, folder, "documents"), 8, ("doc_id",))
    return shards.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@query(oracles.TOP_PRODUCTS)
def op3_norm_sorted(spark: SparkSession, folder: str) -> DataFrame:
    vectors = integer_vectors(table(spark, folder, "embeddings"), 64.0)
    return top_products(vectors, "vec_id % 20 = 0", 20)


@query(oracles.licence_scan())
def op8_sentence_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = licence_scan(table(spark, folder, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("sentence_ids", "licences")})


@query(oracles.licence_scan(oracles.headed_documents()))
def op8_sentence_rules_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document below a licence header that its id chooses: sentences with inner signs, notices of several sentences."""
    headers = F.array(*[F.lit(h) for h in oracles.HEADERS])
    header = F.get(headers, F.pmod(F.col("doc_id"), F.lit(len(oracles.HEADERS))).cast("int"))
    docs = table(spark, folder, "documents").select("doc_id", F.concat(header, F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("text"))
    found = licence_scan(docs)
    return found.withColumns({c: F.array_join(c, ",") for c in ("sentence_ids", "licences")})


@query(oracles.LINE_TEMPLATES)
def op6_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    kept = drop_templates(table(spark, folder, "documents"))
    return kept.select("doc_id", "lines", "lines_dropped", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


@query()
def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"))


@query(oracles.TERM_SEARCH)
def op13_term_at_a_time(spark: SparkSession, folder: str) -> DataFrame:
    return term_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(oracles.SPELLING_GROUPS)
def op11_trie_frontier(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_groups(table(spark, folder, "documents"))
