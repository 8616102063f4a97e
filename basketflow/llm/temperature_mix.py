"""Temperature mixing: source weights are token shares to a power, realised as block permutations under a token budget.

Weights are proportional to share ** exponent: 1 keeps the natural mix, 0 makes
all sources equal.  The exponent is found by bisection, so that the weights
have a given entropy or no source repeats too often.  Each source then gives
its quota: whole passes over its documents first, and of one more pass the
leading blocks of a permutation, and of the block at the cut the leading
documents, as long as the quota lasts.

The permutations are orders of seeded hashes, so the cut of a source is one
pair of hashes: the documents are not sorted, and meet only a table with one
row per source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basketflow.llm.hashing import keyed
from basketflow.session import Scratch, settle

BLOCKS = 4096  # per source and pass
TOP = 4.0  # largest exponent tried
BITS = 4  # bisections that one job evaluates together
STEPS = 40  # bisections


def _named(column: Column, missing: str = "-") -> Column:
    return F.coalesce(column.cast("string"), F.lit(missing))


def tokens(text: str = "text") -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the whole text plus one end of document."""
    return (F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1).cast("long")


def exponent(sources: DataFrame, target_entropy: float | None, max_repeats: float | None, budget_share: float | None) -> float:
    """The smallest exponent whose weights meet both limits, to 40 bisections, rounded to 9 digits.

    ``sources`` has one row (tokens) per source.  ``target_entropy`` is a share
    of the largest possible entropy; weights may not be flatter than that.
    ``max_repeats`` bounds the passes over any source, given the budget as a
    share of all tokens (None: the smallest budget that uses every document).
    Each job sums 2 ** BITS - 1 exponents at once: only sums reach the driver.
    """
    total, count, least, most = sources.agg(F.sum("tokens"), F.count(F.lit(1)), F.min("tokens"), F.max("tokens")).first()
    if not count:
        return 1.0
    share = F.col("tokens") / F.lit(float(total))

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        columns = [F.sum(F.pow(share, F.lit(e))) for e in exponents] + [F.sum(F.pow(share, F.lit(e)) * F.log(share)) for e in exponents]
        row = sources.agg(*columns).first()
        return list(zip(row[: len(exponents)], row[len(exponents) :], strict=True))

    def search(fits, low: float, high: float) -> float:
        """The smallest exponent that fits, where all larger ones in the interval do."""
        for _ in range(STEPS // BITS):
            inner = [low + (high - low) * i / (1 << BITS) for i in range(1, 1 << BITS)]
            good = [e for e, s in zip(inner, sums(inner), strict=True) if fits(e, *s)]
            first = inner.index(good[0]) if good else len(inner)
            low, high = ([low, *inner])[first], ([*inner, high])[first]
        return high

    def entropy_fits(e: float, z: float, zlog: float) -> bool:
        return math.log(z) - e * zlog / z <= target_entropy * math.log(count)

    def repeats_fit(e: float, z: float, _: float) -> bool:
        if budget_share is None:
            return (most / least) ** (1 - e) <= max_repeats
        return budget_share * (least / total) ** (e - 1) / z <= max_repeats

    found = [] if target_entropy is not None or max_repeats is not None else [1.0]
    if target_entropy is not None:
        found.append(search(entropy_fits, 0.0, TOP) if count > 1 else 1.0)
    if max_repeats is not None:
        if max_repeats < (1.0 if budget_share is None else budget_share):
            raise ValueError("the budget asks for more passes over all sources than max_repeats allows")
        found.append(search(repeats_fit, 0.0, 1.0))
    return round(max(found), 9)


def source_plan(
    docs: DataFrame, scratch: Scratch, source: str, target_entropy: float | None, max_repeats: float | None,
    budget_share: float | None, seed: int,
) -> DataFrame:
    """Rows (source, weight, quota, whole passes, block and document hash at the cut), one per source."""
    narrow = scratch.settle(docs.select(F.col(source).alias("_source"), tokens().alias("tokens"), _document_key().alias("_key")))
    sources = scratch.settle(narrow.groupBy("_source").agg(F.sum("tokens").alias("tokens")))
    power = exponent(sources, target_entropy, max_repeats, budget_share)
    total, norm, most = sources.agg(
        F.sum("tokens"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(power))), F.max("tokens")
    ).first()
    norm, total, most = norm or 1.0, total or 0, most or 1
    budget = most**(1 - power) * norm if budget_share is None else total * budget_share
    weight = F.pow(F.col("tokens").cast("double"), F.lit(power)) / F.lit(norm)
    # the rounding keeps a quota that is whole passes from falling a token short of them
    quota = F.floor(F.round(weight * F.lit(float(budget)), 3)).cast("long")
    plan = sources.withColumn("weight", weight).withColumn("quota", quota)
    plan = plan.withColumn("passes", F.floor(F.col("quota") / F.col("tokens")).cast("long"))
    plan = plan.withColumn("rest", F.col("quota") - F.col("passes") * F.col("tokens"))
    plan = scratch.settle(plan.withColumn("exponent", F.lit(power)))
    # cumulated block sizes in permuted order: at most BLOCKS rows per source
    short = plan.select(F.col("_source").alias("_of"), "passes", "rest")
    totals = narrow.groupBy("_source", _block().alias("_block")).agg(F.sum("tokens").alias("tokens"))
    totals = totals.join(short, F.col("_source").eqNullSafe(F.col("_of")))
    totals = totals.withColumn("_order", _block_order("_source", "_block", "passes", seed))
    in_order = W.partitionBy("_of").orderBy("_order", "_block")
    totals = totals.withColumn("_before", F.sum("tokens").over(in_order) - F.col("tokens"))
    cut = totals.where((F.col("_before") <= F.col("rest")) & (F.col("rest") < F.col("_before") + F.col("tokens")))
    cut = scratch.settle(cut.select("_of", "_block", "_order", "passes", (F.col("rest") - F.col("_before")).alias("_left")))
    # the documents of the block at the cut: one block per source
    at = cut.select(F.col("_of").alias("_cut"), F.col("_block").alias("_at"), "passes", "_left")
    inside = narrow.withColumn("_block", _block()).join(
        at, F.col("_source").eqNullSafe(F.col("_cut")) & (F.col("_block") == F.col("_at"))
    )
    inside = inside.groupBy("_cut", "_left", _document_order("_key", "passes", seed).alias("_place")).agg(F.sum("tokens").alias("tokens"))
    running = F.sum("tokens").over(W.partitionBy("_cut").orderBy("_place"))
    fitting = inside.withColumn("_sum", running).where("_sum <= _left").groupBy("_cut").agg(F.max("_place").alias("cut_document"))
    cut = cut.select("_of", F.col("_order").alias("cut_block"))
    plan = plan.join(cut, F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of")
    plan = plan.join(fitting, F.col("_source").eqNullSafe(F.col("_cut")), "left").drop("_cut")
    return settle(plan.withColumnsRenamed({"tokens": "source_tokens"}))


def _document_key() -> Column:
    return F.concat_ws(":", _named(F.col("doc_id")), _named(F.md5(F.col("text").cast("binary"))))


def _block(key: str = "_key") -> Column:
    return F.pmod(keyed("block", F.col(key)), F.lit(BLOCKS))


def _block_order(source: str, block: str, passes: str, seed: int) -> Column:
    return keyed(str(seed), F.col(passes), F.col(block), _named(F.col(source)))


def _document_order(key: str, passes: str, seed: int) -> Column:
    return keyed(str(seed), F.col(passes), F.col(key))


def temperature_mix(
    docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget_share: float | None = 1.0,
    source: str = "source", seed: int = 7,
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them, with columns of the plan.

    Adds mix_tokens, mix_pass (from 0), mix_weight, mix_quota.  A source gives
    at most its quota of tokens and falls short of it by less than one
    document; rows equal in doc_id and text are taken or left together in the
    last pass.  Columns named as the added ones are replaced, all others are
    kept.  With ``budget_share`` None the budget is the smallest that uses
    every document.  A null source is a source; a null or empty text is
    one token.  Without rows the result is empty.
    """
    with Scratch(docs.sparkSession) as scratch:
        plan = source_plan(docs, scratch, source, target_entropy, max_repeats, budget_share, seed)
    plan = plan.select(F.col("_source").alias("_mix_source"), *[F.col(c).alias(f"_mix_{c}") for c in ("weight", "quota", "passes", "cut_block", "cut_document")])
    carried = [c for c in docs.columns if c not in ("mix_tokens", "mix_weight", "mix_quota", "mix_pass")]
    # whatever their names, the caller's columns stay apart from those of the mix
    rows = docs.select(F.struct(*carried).alias("_mix_row"), F.col(source).alias("_mix_from"), tokens().alias("_mix_tokens"), _document_key().alias("_mix_key"))
    rows = rows.join(plan, F.col("_mix_from").eqNullSafe(F.col("_mix_source")))
    rows = rows.withColumn("_mix_block", _block("_mix_key"))
    order = _block_order("_mix_from", "_mix_block", "_mix_passes", seed)
    place = _document_order("_mix_key", "_mix_passes", seed)
    last = (order < F.col("_mix_cut_block")) | ((order == F.col("_mix_cut_block")) & (place <= F.coalesce("_mix_cut_document", F.lit(-1))))
    times = F.col("_mix_passes") + F.coalesce(last, F.lit(False)).cast("int")
    rows = rows.withColumn("_mix_times", times).where("_mix_times > 0")
    return rows.select(
        *[F.col("_mix_row")[c].alias(c) for c in carried], F.col("_mix_tokens").alias("mix_tokens"), F.col("_mix_weight").alias("mix_weight"), F.col("_mix_quota").alias("mix_quota"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_mix_times") - 1)).alias("mix_pass"),
    )
