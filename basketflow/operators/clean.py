"""Cleaning of typed lines, with counts of what each step removed."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketflow.functions.text import NON_PRODUCT_PATTERNS, is_non_product, normalize_text
from basketflow.operators.ingest import as_number, finite, has, recompute_amount
from basketflow.operators.quantiles import exact_quantiles
from basketflow.session import settle

# The columns a line must have, the names of the counters, and of the settings below.
CORE_COLUMNS = ("invoice_date", "stock_code", "description", "country", "customer_id")
MERGE_KEYS = ("customer_id", "stock_code", "invoice_date")
MERGED_ATTRIBUTES = ("description", "country", "brand", "category", "vendor")
MEASURES = ("price", "quantity", "line_amount")


@dataclass(frozen=True)
class CleaningRules:
    positive_quantity: bool = True
    positive_price: bool = True
    drop_returns: bool = True
    drop_duplicates: bool = True
    handle_outliers: bool = True
    winsorize: bool = False
    iqr_multiplier: float = 3.0
    log_epsilon: float = 1e-6
    min_events_per_user: int = 1
    min_purchases_per_item: int = 1
    non_product_patterns: tuple[str, ...] = NON_PRODUCT_PATTERNS


# ---- row rules: each is a condition a kept row meets (null counts as not met) -----------------
# They keep to plain comparisons, so the scan can apply them, and also work on a stream.

def has_core(df: DataFrame) -> Column | None:
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    missing = lambda c: F.col(c).isNull() | F.isnan(c) if c in floats else F.col(c).isNull()
    return _all([~missing(c) for c in CORE_COLUMNS if c in df.columns])


def is_sale(df: DataFrame) -> Column | None:
    """Not a return; a missing transaction id counts as a sale."""
    if not has(df, "unique_transaction"):
        return None
    ident = F.col("unique_transaction")
    return ident.isNull() | ~ident.cast("string").startswith("C")


def is_positive(df: DataFrame, column: str) -> Column | None:
    if not has(df, column):
        return None
    kind = df.schema[column].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(column) > 0
    number = F.col(column) if isinstance(kind, (T.DoubleType, T.FloatType)) else as_number(F.col(column))
    # NaN stands above all numbers in comparisons, but is a missing value here.
    return (number > 0) & ~F.isnan(number)


def _all(conditions: Iterable[Column]) -> Column | None:
    joined = None
    for condition in conditions:
        joined = condition if joined is None else joined & condition
    return joined


def row_rules(df: DataFrame, rules: CleaningRules = CleaningRules()) -> dict[str, Column]:
    """The row rules in force for the columns at hand, in order, by the name of their counter."""
    wanted = {
        "drop_missing_core": has_core(df),
        "drop_returns": is_sale(df) if rules.drop_returns else None,
        "drop_nonpositive_qty": is_positive(df, "quantity") if rules.positive_quantity else None,
        "drop_nonpositive_price": is_positive(df, "price") if rules.positive_price else None,
    }
    return {name: keep for name, keep in wanted.items() if keep is not None}


def keep_valid_rows(df: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    keep = _all(row_rules(df, rules).values())
    return df if keep is None else df.where(keep)


def normalize_lines(df: DataFrame) -> DataFrame:
    """Normalised description, upper-case item code."""
    if has(df, "description"):
        df = df.withColumn("description", normalize_text(F.col("description")))
    if has(df, "stock_code"):
        df = df.withColumn("stock_code", F.upper(F.col("stock_code").cast("string")))
    return df


def drop_non_products(df: DataFrame, patterns=NON_PRODUCT_PATTERNS) -> DataFrame:
    return df.where(~is_non_product(F.col("description"), patterns)) if has(df, "description") else df


# ---- table rules ------------------------------------------------------------------------------

def merge_lines(df: DataFrame, attributes: Sequence[str] = MERGED_ATTRIBUTES) -> DataFrame:
    """One row per customer, item and date: summed quantity and amount, price from the sums.

    Attributes keep their smallest non-null value.  All of it combines before
    the shuffle, so many lines of one key cost no more than one.  The smallest
    of texts is found in sorted rows, sums alone in a hash table: who needs no
    attribute names none.
    """
    keys = [k for k in MERGE_KEYS if k in df.columns]
    if len(keys) < 2:
        return df
    df = recompute_amount(df)
    sums = [F.sum(as_number(F.col(c))).alias(c) for c in ("quantity", "line_amount") if c in df.columns]
    firsts = [F.min(c).alias(c) for c in attributes if c in df.columns]
    if not sums and not firsts:
        return df
    known = _all([F.col(k).isNotNull() for k in keys])
    merged = df.where(known).groupBy(*keys).agg(*sums, *firsts)
    if has(merged, "quantity", "line_amount"):
        price = F.try_divide(F.col("line_amount"), F.col("quantity"))
        merged = merged.withColumn("price", finite(price))
    return merged


def iqr_bounds(df: DataFrame, columns=MEASURES, multiplier: float = 3.0, epsilon: float = 1e-6, stored: bool = False) -> DataFrame:
    """One row with ``<column>_lo`` and ``<column>_hi``: quartiles ± multiplier·IQR on the log scale.

    A column without values gets the bounds 0 and infinity.  ``stored`` rows
    are read again in each pass and not written a second time.
    """
    logs = {c: F.log(F.greatest(F.col(c).cast("double"), F.lit(epsilon))) for c in columns}
    logs = {c: F.when(F.col(c).isNotNull(), log) for c, log in logs.items()}
    quartiles = exact_quantiles(df, logs, [0.25, 0.75], stored)
    out = []
    for c in columns:
        low, high = F.get(F.col(c), F.lit(0)), F.get(F.col(c), F.lit(1))
        reach = (high - low) * multiplier
        out.append(F.coalesce(F.exp(low - reach), F.lit(0.0)).alias(f"{c}_lo"))
        out.append(F.coalesce(F.exp(high + reach), F.lit(float("inf"))).alias(f"{c}_hi"))
    return quartiles.select(*out)


def _bound_pairs(df: DataFrame, bounds: DataFrame) -> dict[str, tuple[Column, Column]]:
    """Per measure its two bounds, as one scalar subquery over the one-row table."""
    row = bounds.select(F.struct(*bounds.columns)).scalar()
    return {c: (row[f"{c}_lo"], row[f"{c}_hi"]) for c in MEASURES if c in df.columns}


def inside_bounds(df: DataFrame, bounds: DataFrame) -> Column:
    pairs = _bound_pairs(df, bounds)
    return F.coalesce(_all([F.col(c).between(lo, hi) for c, (lo, hi) in pairs.items()]), F.lit(False))


def drop_outliers(df: DataFrame, bounds: DataFrame) -> DataFrame:
    return df.where(inside_bounds(df, bounds))


def winsorize(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Measures pulled to their bounds, then amount = quantity × price; null stays null."""
    for c, (lo, hi) in _bound_pairs(df, bounds).items():
        df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), lo), hi)))
    return df.withColumn("line_amount", F.col("quantity") * F.col("price")) if has(df, *MEASURES) else df


def keep_frequent(df: DataFrame, key: str, minimum: int) -> DataFrame:
    """Rows whose key has at least ``minimum`` rows."""
    if minimum <= 1 or not has(df, key):
        return df
    frequent = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum).select(key)
    return df.join(frequent, key, "left_semi")


def _distinct_products(df: DataFrame, rules: CleaningRules, attributes: Sequence[str] = MERGED_ATTRIBUTES) -> DataFrame:
    """Distinct lines of products, normalised, dealt out by what they are merged by.

    Two lines are equal by what they say before they are normalised.  Equal
    lines have one customer, item and date, and so have lines to merge: both
    steps work on one exchange by these, not on one each.  A description that
    is no attribute is not sent in its normalised form.
    """
    raw = df.columns
    normal = normalize_lines(df.select("*", *[F.col(c).alias(f"_raw_{c}") for c in ("description", "stock_code") if c in raw]))
    products = drop_non_products(normal, rules.non_product_patterns)
    products = products if "description" in attributes else products.drop("description")
    return products.repartition(*MERGE_KEYS).dropDuplicates().select(*[c for c in raw if c in products.columns])


def until_merged(df: DataFrame, rules: CleaningRules = CleaningRules(), attributes: Sequence[str] = MERGED_ATTRIBUTES) -> DataFrame:
    df = keep_valid_rows(df, rules)
    if rules.drop_duplicates and has(df, *MERGE_KEYS):
        return merge_lines(_distinct_products(df, rules, attributes), attributes)
    df = df.dropDuplicates() if rules.drop_duplicates else df
    return merge_lines(drop_non_products(normalize_lines(df), rules.non_product_patterns), attributes)


def _bounds(settled: DataFrame, rules: CleaningRules) -> DataFrame:
    measures = [c for c in MEASURES if c in settled.columns]
    return iqr_bounds(settled, measures, rules.iqr_multiplier, rules.log_epsilon, stored=True)


def _handle_outliers(df: DataFrame, rules: CleaningRules) -> DataFrame:
    if not rules.handle_outliers:
        return df
    return (winsorize if rules.winsorize else drop_outliers)(df, _bounds(df, rules))


def clean_lines(df: DataFrame, rules: CleaningRules = CleaningRules(), attributes: Sequence[str] = MERGED_ATTRIBUTES) -> DataFrame:
    """All cleaning steps in order: rare items go before rare users, each once.

    The merged lines feed both the bounds and the rows the bounds apply to,
    so they are settled first and the steps before them run once.  Of the
    ``attributes`` of merged lines those that are named are kept.
    """
    df = until_merged(df, rules, attributes)
    df = _handle_outliers(settle(df), rules) if rules.handle_outliers else df
    df = keep_frequent(df, "stock_code", rules.min_purchases_per_item)
    return keep_frequent(df, "customer_id", rules.min_events_per_user)


def clean_with_counts(df: DataFrame, rules: CleaningRules = CleaningRules()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The clean lines, rows removed per step ``(ordinal, step, rows_removed)``, and the distinct input with ``_copies``.

    The input is scanned once, into its distinct rows with their number of
    copies; the row rules are counted there, the merged lines come from there.
    """
    distinct = settle(df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies")))
    checks = row_rules(distinct, rules)
    passed, columns = F.lit(True), []
    for name, keep in checks.items():
        keep = F.coalesce(keep, F.lit(False))
        columns.append(F.coalesce(F.sum(F.when(passed & ~keep, F.col("_copies")).otherwise(0)), F.lit(0)).alias(name))
        passed = passed & keep
    first = distinct.agg(*columns) if columns else None
    valid = keep_valid_rows(distinct, rules)
    noise = is_non_product(normalize_text(F.col("description")), rules.non_product_patterns) if has(df, "description") else F.lit(False)
    kept_copies = F.lit(1) if rules.drop_duplicates else F.col("_copies")
    second = valid.agg(
        F.coalesce(F.sum(F.col("_copies") - kept_copies), F.lit(0)).alias("drop_duplicates"),
        F.coalesce(F.sum(F.when(noise, kept_copies).otherwise(0)), F.lit(0)).alias("drop_non_product_patterns"),
        F.coalesce(F.sum(F.when(noise, 0).otherwise(kept_copies)), F.lit(0)).alias("_products"),
    )
    lines = valid
    if not rules.drop_duplicates:
        lines = lines.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop("_copy")
    merged = settle(merge_lines(drop_non_products(normalize_lines(lines.drop("_copies")), rules.non_product_patterns)))
    kept, drops = merged, rules.handle_outliers and not rules.winsorize
    inside = F.lit(True)
    if rules.handle_outliers:
        bounds = settle(_bounds(merged, rules))
        kept = (winsorize if rules.winsorize else drop_outliers)(merged, bounds)
        inside = inside_bounds(merged, bounds) if drops else inside
    rows = lambda d: d.agg(F.count(F.lit(1)).alias("n")).scalar()
    second = second.withColumn("aggregated_duplicate_lines", F.col("_products") - rows(merged))
    third = merged.agg(F.coalesce(F.sum((~inside).cast("long")), F.lit(0)).alias("drop_outliers"))
    frequent = keep_frequent(kept, "stock_code", rules.min_purchases_per_item)
    final = keep_frequent(frequent, "customer_id", rules.min_events_per_user)
    pieces = [_stack(first, list(checks), 0)] if checks else []
    pieces += [
        _stack(second, ["drop_duplicates", "drop_non_product_patterns", "aggregated_duplicate_lines"], 4),
        _stack(third, ["drop_outliers"], 7),
    ]
    for ordinal, step, before, after, least in (
        (8, "drop_rare_items", kept, frequent, rules.min_purchases_per_item),
        (9, "drop_rare_users", frequent, final, rules.min_events_per_user),
    ):
        if least > 1:
            removed = before.agg(F.count(F.lit(1)).alias("n"))
            pieces.append(removed.select(F.lit(ordinal).alias("ordinal"), F.lit(step).alias("step"), (F.col("n") - rows(after)).alias("rows_removed")))
    report = pieces[0]
    for piece in pieces[1:]:
        report = report.unionByName(piece)
    return final, report.select(F.col("ordinal").cast("long"), "step", F.col("rows_removed").cast("long")), distinct


def quality_counts(df: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Rows removed per step: ``(ordinal, step, rows_removed)``."""
    return clean_with_counts(df, rules)[1]


def _stack(counts: DataFrame, names: list[str], start: int) -> DataFrame:
    rows = [
        F.struct(F.lit(start + i).alias("ordinal"), F.lit(n).alias("step"), F.col(n).alias("rows_removed"))
        for i, n in enumerate(names)
    ]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def size_checks(interactions: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """``(check, actual, minimum, ok)`` for rows, users and items."""
    limits = limits or {"interactions": 1000, "users": 100, "items": 100}
    sizes = interactions.agg(
        F.count(F.lit(1)).alias("interactions"),
        F.countDistinct("customer_id").alias("users"),
        F.countDistinct("stock_code").alias("items"),
    )
    rows = [
        F.struct(F.lit(n).alias("check"), F.col(n).alias("actual"), F.lit(m).cast("long").alias("minimum"),
                 (F.col(n) >= m).alias("ok"))
        for n, m in limits.items()
    ]
    return sizes.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def row_counts(**tables: DataFrame) -> DataFrame:
    """``(table, rows)`` of several tables."""
    out = None
    for name, table in tables.items():
        part = table.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out
