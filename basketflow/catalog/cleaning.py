"""Queries over raw sales lines: ingestion, cleaning, clean tables, id maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketflow.catalog import query, views as V
from basketflow.catalog.sql import INSIDE, PATTERNS, bounds_of, part, sql
from basketflow.functions.text import brand_label, category_label, is_non_product, normalize_text, short_title
from basketflow.operators import clean as C, ingest as I, tables as T
from basketflow.sources.retail import raw_lines, table

LINE = "stock_code, description, customer_id, quantity, line_amount, invoice_date, country, brand, category, vendor, unique_transaction"


# ---- ingestion --------------------------------------------------------------------------------
@query("p1_standard_names", sql("raw", f"SELECT {LINE} FROM raw"))
def p1(spark, d):
    back = {new: old for old, new in I.RAW_COLUMN_NAMES.items()}
    return I.standardize_columns(raw_lines(spark, d).withColumnsRenamed(back))


# Order dates written in nineteen ways, by order key; SQL states what each must become from the date itself.
SPELLINGS = {
    1: "MMM-dd", 3: "dd/MM/yyyy", 4: "yyyy-MM-dd HH:mm:ss", 5: "MM/dd/yyyy", 7: "dd-MMM-yyyy", 8: "d-MMM-yy", 9: "MMMM d, yyyy",
    10: "dd MMMM yyyy", 11: "yyyy-MM-dd HH:mm:ss.SSS", 12: "yyyy-MM-dd'T'HH:mm:ss'Z'", 13: "MM/dd/yy", 14: "dd-MM-yyyy HH:mm",
    15: "d/M/yyyy h:mm a", 16: "dd.MM.yyyy HH:mm", 17: "yyyyMMdd", 18: "yyyy-M-d",
}
WAYS = 19
_DAY = "o_orderdate::DATE::TIMESTAMP"
_TURNED = "make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), 0, 0, 0)"
_MONTH_FIRST = f"CASE WHEN day(o_orderdate) <= 12 THEN {_TURNED} ELSE {_DAY} END"
_DAY_OF_2024 = "make_timestamp(2024, month(o_orderdate), day(o_orderdate), 0, 0, 0)"
part("parsed", "", f"""
SELECT o_orderkey, CASE o_orderkey % {WAYS}
  WHEN 1 THEN {_DAY_OF_2024} WHEN 2 THEN {_DAY_OF_2024} WHEN 4 THEN date_trunc('second', o_orderdate)
  WHEN 5 THEN {_MONTH_FIRST} WHEN 6 THEN NULL WHEN 11 THEN date_trunc('millisecond', o_orderdate)
  WHEN 12 THEN date_trunc('second', o_orderdate) WHEN 13 THEN {_MONTH_FIRST}
  WHEN 14 THEN date_trunc('minute', o_orderdate) WHEN 15 THEN date_trunc('minute', o_orderdate)
  WHEN 16 THEN date_trunc('minute', o_orderdate)
  WHEN 18 THEN CASE WHEN month(o_orderdate) >= 10 AND day(o_orderdate) >= 10 THEN {_DAY} ELSE {_MONTH_FIRST} END
  ELSE {_DAY} END AS invoice_date FROM orders""")


def _written(spark, d):
    at, key = F.col("o_orderdate"), F.col("o_orderkey") % WAYS
    shown = lambda form: F.date_format(at.cast("timestamp"), form)
    text = (
        F.when(key == 0, F.datediff(at.cast("date"), F.lit("1899-12-30").cast("date")).cast("string"))
        .when(key == 2, F.lower(shown("MMM dd"))).when(key == 6, F.concat(F.lit("about "), shown("yyyy")))
    )
    for way, form in SPELLINGS.items():
        text = text.when(key == way, shown(form))
    return table(spark, d, "orders").select("o_orderkey", text.alias("invoice_date"))


@query("p2_parse_dates", sql("parsed", "SELECT o_orderkey, invoice_date FROM parsed"))
def p2(spark, d):
    return I.parse_dates(_written(spark, d))


@query("p3_date_success", sql("parsed", "SELECT round(avg((invoice_date IS NOT NULL)::INT::DOUBLE), 6) AS valid_ratio FROM parsed"))
def p3(spark, d):
    return I.date_success(I.parse_dates(_written(spark, d))).select(*V.six("valid_ratio"))


def _rough(spark, d):
    """Line quantities as typed by hand: some zero, some not a number."""
    number = F.col("l_linenumber")
    text = F.when(number == 3, "n/a").when(number == 4, "0").otherwise(F.col("l_quantity").cast("string"))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", text.alias("quantity"), F.col("l_extendedprice").cast("string").alias("line_amount")
    )


ROUGH = "CASE WHEN l_linenumber IN (3, 4) THEN NULL ELSE l_extendedprice / l_quantity END"


@query("p4_prices", f"SELECT l_orderkey, l_linenumber, round({ROUGH}, 9) AS price FROM lineitem")
def p4(spark, d):
    return I.compute_prices(_rough(spark, d)).select("l_orderkey", "l_linenumber", *V.nine("price"))


@query("p5_lenient_numbers", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN 0 ELSE l_quantity END AS quantity
FROM lineitem""")
def p5(spark, d):
    return _rough(spark, d).select("l_orderkey", "l_linenumber", I.as_number(F.col("quantity")).alias("quantity"))


@query("p6_line_amounts", f"""
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber IN (3, 4) THEN l_extendedprice
  ELSE l_quantity * (l_extendedprice / l_quantity) END, 6) AS line_amount FROM lineitem""")
def p6(spark, d):
    rows = I.compute_prices(_rough(spark, d)).withColumn("line_amount", I.as_number(F.col("line_amount")))
    return I.recompute_amount(rows).select("l_orderkey", "l_linenumber", *V.six("line_amount"))


# ---- row rules --------------------------------------------------------------------------------
GAPS = f"""
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber = 2 THEN NULL ELSE l_partkey END AS stock_code,
  CASE WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN NULL ELSE l_shipdate END AS invoice_date,
  CASE WHEN l_linenumber = 4 THEN NULL WHEN l_returnflag = 'R' THEN 'C' ELSE 'c' END AS unique_transaction,
  CASE WHEN l_linenumber = 7 THEN 'NaN'::DOUBLE ELSE l_suppkey END AS customer_id,
  CASE WHEN l_linenumber = 6 THEN 'NaN'::DOUBLE ELSE l_quantity - 25 END AS quantity,
  CASE WHEN l_linenumber = 5 THEN 'NaN'::DOUBLE ELSE l_discount - 0.05 END AS price FROM lineitem"""


def _gaps(spark, d):
    number, rows = F.col("l_linenumber"), table(spark, d, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber",
        F.when(number != 2, F.col("l_partkey")).alias("stock_code"),
        F.when(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"), F.col("l_shipdate")).alias("invoice_date"),
        F.when(number != 4, F.when(F.col("l_returnflag") == "R", "C").otherwise("c")).alias("unique_transaction"),
        F.when(number == 7, F.lit(float("nan"))).otherwise(F.col("l_suppkey").cast("double")).alias("customer_id"),
        F.when(number == 6, F.lit(float("nan"))).otherwise(F.col("l_quantity") - 25).alias("quantity"),
        F.when(number == 5, F.lit(float("nan"))).otherwise(F.col("l_discount") - 0.05).alias("price"),
    )


KEYS = ("l_orderkey", "l_linenumber")


@query("f1_core_fields", f"SELECT l_orderkey, l_linenumber FROM ({GAPS}) WHERE stock_code IS NOT NULL AND invoice_date IS NOT NULL AND l_linenumber <> 7")
def f1(spark, d):
    rows = _gaps(spark, d)
    return rows.where(C.has_core(rows)).select(*KEYS)


@query("f2_returns", f"SELECT l_orderkey, l_linenumber FROM ({GAPS}) WHERE unique_transaction IS NULL OR unique_transaction NOT LIKE 'C%'")
def f2(spark, d):
    rows = _gaps(spark, d)
    return rows.where(C.is_sale(rows)).select(*KEYS)


@query("f3_positive_quantity", f"SELECT l_orderkey, l_linenumber FROM ({GAPS}) WHERE quantity > 0 AND l_linenumber <> 6")
def f3(spark, d):
    rows = _gaps(spark, d)
    return rows.where(C.is_positive(rows, "quantity")).select(*KEYS)


@query("f4_positive_price", f"SELECT l_orderkey, l_linenumber FROM ({GAPS}) WHERE price > 0 AND l_linenumber <> 5")
def f4(spark, d):
    rows = _gaps(spark, d)
    return rows.where(C.is_positive(rows, "price")).select(*KEYS)


@query("f5_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_quantity FROM lineitem")
def f5(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity").dropDuplicates()


@query("f6_normalized_text", r"""
SELECT doc_id, upper(replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), 'ß', 'SS')) AS text
FROM documents""")
def f6(spark, d):
    return table(spark, d, "documents").select("doc_id", normalize_text(F.col("text")).alias("text"))


@query("f7_item_codes", "SELECT p_partkey, upper(p_name) AS stock_code FROM part")
def f7(spark, d):
    return C.normalize_lines(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("stock_code")))


@query("f8_non_products", sql("raw", "SELECT stock_code, customer_id, invoice_date FROM raw WHERE NOT regexp_matches(description, '(?i)RING|BOLT')"))
def f8(spark, d):
    rows = C.drop_non_products(raw_lines(spark, d), ("RING", "BOLT"))
    return rows.select("stock_code", "customer_id", "invoice_date")


@query("f8_non_product_texts", f"SELECT doc_id, regexp_matches(text, '(?i){PATTERNS}') AS non_product FROM documents")
def f8_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", is_non_product(F.col("text")).alias("non_product"))


# ---- table rules ------------------------------------------------------------------------------
BOUNDS = ("price_lo", "price_hi", "quantity_lo", "quantity_hi", "line_amount_lo", "line_amount_hi")


@query("f9_iqr_bounds", sql("merged bounds", "SELECT " + ", ".join(f"round({b}, 6) AS {b}" for b in BOUNDS) + " FROM bounds"))
def f9(spark, d):
    return C.iqr_bounds(V.merged(spark, d)).select(*V.six(*BOUNDS))


part("narrow", "priced", bounds_of("priced", 1.5))


@query("f10_outliers", sql("priced narrow", f"SELECT stock_code, customer_id, invoice_date, round(price, 9) AS price FROM priced, narrow WHERE {INSIDE}"))
def f10(spark, d):
    rows = V.priced(spark, d)
    return C.drop_outliers(rows, C.iqr_bounds(rows, multiplier=1.5)).select(
        "stock_code", "customer_id", "invoice_date", *V.nine("price"))


def _pulled(c: str) -> str:
    return f"least(greatest({c}, {c}_lo), {c}_hi)"


@query("f11_winsorize", sql("priced narrow", f"""
SELECT stock_code, customer_id, invoice_date, round({_pulled('price')}, 9) AS price, round({_pulled('quantity')}, 9) AS quantity,
       round({_pulled('quantity')} * {_pulled('price')}, 4) AS line_amount FROM priced, narrow"""))
def f11(spark, d):
    rows = V.priced(spark, d)
    out = C.winsorize(rows, C.iqr_bounds(rows, multiplier=1.5))
    return out.select("stock_code", "customer_id", "invoice_date", *V.nine("price", "quantity"),
                      F.round("line_amount", 4).alias("line_amount"))


part("by_item", "merged", "SELECT * FROM merged QUALIFY count(*) OVER (PARTITION BY stock_code) >= 20")
part("by_both", "by_item", "SELECT * FROM by_item QUALIFY count(*) OVER (PARTITION BY customer_id) >= 20")


@query("f12_rare_items", sql("by_item", "SELECT customer_id, stock_code, invoice_date FROM by_item"))
def f12(spark, d):
    return C.keep_frequent(V.merged(spark, d), "stock_code", 20).select("customer_id", "stock_code", "invoice_date")


@query("f13_rare_users", sql("by_both", "SELECT customer_id, stock_code, invoice_date FROM by_both"))
def f13(spark, d):
    rows = C.keep_frequent(V.merged(spark, d), "stock_code", 20)
    return C.keep_frequent(rows, "customer_id", 20).select("customer_id", "stock_code", "invoice_date")


@query("j2_frequent_members", sql("priced", """
SELECT stock_code, customer_id, quantity FROM priced
WHERE customer_id IN (SELECT customer_id FROM priced GROUP BY 1 HAVING count(*) >= 40)"""))
def j2(spark, d):
    return C.keep_frequent(V.priced(spark, d), "customer_id", 40).select("stock_code", "customer_id", "quantity")


INTERACTION = "customer_id, invoice_date, stock_code, description, round(quantity, 9) AS quantity, round(price, 9) AS price, round(line_amount, 4) AS line_amount, country, brand, category, vendor"


def _shown(rows):
    return rows.select("customer_id", "invoice_date", "stock_code", "description", *V.nine("quantity", "price"),
                       F.round("line_amount", 4).alias("line_amount"), "country", "brand", "category", "vendor")


@query("f14_clean_lines", sql("clean", f"SELECT {INTERACTION} FROM clean"))
def f14(spark, d):
    return _shown(V.clean(spark, d))


STRICT = C.CleaningRules(iqr_multiplier=1.5, min_events_per_user=15, min_purchases_per_item=15)
part("strict_bounds", "merged", bounds_of("merged", 1.5))
part("strict_kept", "merged strict_bounds", f"SELECT merged.* FROM merged, strict_bounds WHERE {INSIDE}")
part("strict_items", "strict_kept", "SELECT * FROM strict_kept QUALIFY count(*) OVER (PARTITION BY stock_code) >= 15")
part("strict_users", "strict_items", "SELECT * FROM strict_items QUALIFY count(*) OVER (PARTITION BY customer_id) >= 15")
part("sales", "priced", "SELECT * FROM priced WHERE NOT starts_with(unique_transaction, 'C')")
n = lambda name: f"(SELECT count(*) FROM {name})"


@query("f15_quality_counts", sql("priced sales valid products merged strict_kept strict_items strict_users", f"""
SELECT * FROM (VALUES
  (0::BIGINT, 'drop_missing_core', 0::BIGINT), (1, 'drop_returns', {n('priced')} - {n('sales')}),
  (2, 'drop_nonpositive_qty', 0), (3, 'drop_nonpositive_price', 0), (4, 'drop_duplicates', {n('sales')} - {n('valid')}),
  (5, 'drop_non_product_patterns', {n('valid')} - {n('products')}),
  (6, 'aggregated_duplicate_lines', {n('products')} - {n('merged')}), (7, 'drop_outliers', {n('merged')} - {n('strict_kept')}),
  (8, 'drop_rare_items', {n('strict_kept')} - {n('strict_items')}), (9, 'drop_rare_users', {n('strict_items')} - {n('strict_users')})
) t(ordinal, step, rows_removed)"""))
def f15(spark, d):
    return C.quality_counts(V.priced(spark, d), STRICT)


# Lines that fail every rule: no description, a returned, a negative or a free line, by their customer and item.
FAILING = {
    "description": ("customer_id % 37 = 0", "NULL"), "quantity": ("CAST(stock_code AS BIGINT) % 23 = 0", "-quantity"),
    "price": ("CAST(stock_code AS BIGINT) % 29 = 0", "0.0"),
}


def _failing(spark, d):
    rows = V.priced(spark, d)
    return rows.withColumns({c: F.expr(f"CASE WHEN {when} THEN {value} ELSE {c} END") for c, (when, value) in FAILING.items()})


part("rough", "priced", "SELECT * REPLACE (" + ", ".join(f"CASE WHEN {w} THEN {v} ELSE {c} END AS {c}" for c, (w, v) in FAILING.items()) + ") FROM priced")
part("rough_named", "rough", "SELECT * FROM rough WHERE description IS NOT NULL")
part("rough_sold", "rough_named", "SELECT * FROM rough_named WHERE NOT starts_with(unique_transaction, 'C')")
part("rough_some", "rough_sold", "SELECT * FROM rough_sold WHERE quantity > 0")
part("rough_paid", "rough_some", "SELECT * FROM rough_some WHERE price > 0")


@query("f15_failing_rules", sql("rough rough_named rough_sold rough_some rough_paid", f"""
SELECT * FROM (VALUES
  (0::BIGINT, 'drop_missing_core', (SELECT count(*) FROM priced WHERE customer_id % 37 = 0)), (1, 'drop_returns', {n('rough_named')} - {n('rough_sold')}),
  (2, 'drop_nonpositive_qty', {n('rough_sold')} - {n('rough_some')}), (3, 'drop_nonpositive_price', {n('rough_some')} - {n('rough_paid')}),
  (4, 'drop_duplicates', {n('rough_paid')} - (SELECT count(*) FROM (SELECT DISTINCT * FROM rough_paid)))
) t(ordinal, step, rows_removed)"""))
def f15_failing(spark, d):
    """The counters of the row rules over lines of which many fail, some of them several rules."""
    return C.quality_counts(_failing(spark, d)).where("ordinal <= 4")


@query("f16_size_checks", sql("clean", """
SELECT "check", actual, minimum, actual >= minimum AS ok FROM (
  SELECT 'interactions' AS "check", count(*) AS actual, 1000::BIGINT AS minimum FROM clean
  UNION ALL SELECT 'users', count(DISTINCT customer_id), 100 FROM clean
  UNION ALL SELECT 'items', count(DISTINCT stock_code), 100 FROM clean)"""))
def f16(spark, d):
    return C.size_checks(V.clean(spark, d))


# ---- display text -----------------------------------------------------------------------------


@query("f17_category_labels", f"""
SELECT p_partkey, CASE WHEN p_size % 4 IN (1, 2) THEN 'General'
  ELSE upper(p_type[1:1]) || lower(p_type[2:]) END AS category FROM part""")
def f17(spark, d):
    size = F.col("p_size") % 4
    text = (
        F.when(size == 0, F.concat(F.lit("IN"), F.col("p_size"), F.lit(" - "), F.col("p_type"))).when(size == 1, "nan")
        .when(size == 2, F.concat(F.lit("in0"), F.col("p_size"))).otherwise(F.concat(F.lit(" "), F.col("p_type")))
    )
    return table(spark, d, "part").select("p_partkey", category_label(text).alias("category"))


@query("f18_brand_labels", """
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'Generic' WHEN p_size % 4 = 1 THEN 'Non Branded'
  ELSE upper(p_brand[1:1]) || lower(p_brand[2:]) END AS brand FROM part""")
def f18(spark, d):
    size = F.col("p_size") % 4
    text = (
        F.when(size == 0, F.lit(None)).when(size == 1, "NonBranded")
        .when(size == 2, F.concat(F.col("p_brand"), F.lit(" - "), F.col("p_type"))).otherwise(F.col("p_brand"))
    )
    return table(spark, d, "part").select("p_partkey", brand_label(text).alias("brand"))


@query("f19_titles", """
SELECT doc_id, CASE WHEN length(text) > 50 THEN text[1:50] || '...' ELSE text END AS title FROM documents""")
def f19(spark, d):
    return table(spark, d, "documents").select("doc_id", short_title(F.col("text")).alias("title"))


# ---- clean tables -----------------------------------------------------------------------------
@query("a1_merged_lines", sql("merged", f"SELECT {INTERACTION} FROM merged"))
def a1(spark, d):
    return _shown(V.merged(spark, d))


@query("a2_item_catalog", sql("items", """
SELECT stock_code, description, round(price_median, 9) AS price_median, round(price_mean, 6) AS price_mean, popularity,
       brand, category, vendor FROM items"""))
def a2(spark, d):
    return T.item_catalog(V.clean(spark, d)).select(
        "stock_code", "description", *V.nine("price_median"), *V.six("price_mean"), "popularity", "brand", "category", "vendor")


@query("a3_customers", sql("clean", """
SELECT customer_id, min(invoice_date) AS first_date, max(invoice_date) AS last_date,
       count(DISTINCT invoice_date) AS n_events, count(*) AS n_lines,
       min(country) AS country_mode, round(sum(line_amount), 4) AS total_spent FROM clean GROUP BY 1"""))
def a3(spark, d):
    return T.customer_table(V.clean(spark, d)).withColumn("total_spent", F.round("total_spent", 4))


part("two_countries", "clean", "SELECT * REPLACE (CASE WHEN quantity > 20 THEN 'Elsewhere' ELSE country END AS country) FROM clean")


@query("a3_two_countries", sql("two_countries", """
SELECT customer_id, arg_min(country, (-n, country)) AS country_mode, count(*) AS countries
FROM (SELECT customer_id, country, count(*) AS n FROM two_countries GROUP BY ALL) GROUP BY 1"""))
def a3_countries(spark, d):
    """The usual country of customers who bought in two, some as often in both."""
    rows = V.clean(spark, d).withColumn("country", F.when(F.col("quantity") > 20, "Elsewhere").otherwise(F.col("country")))
    countries = rows.groupBy("customer_id").agg(F.countDistinct("country").alias("countries"))
    return T.customer_table(rows).select("customer_id", "country_mode").join(countries, "customer_id")


@query("a9_histograms", sql("clean", """
SELECT "column", bin, round(lo + bin * w, 9) AS low, round(lo + (bin + 1) * w, 9) AS high, count(*) AS n FROM (
  SELECT "column", lo, w, least(floor((value - lo) / w), 49)::BIGINT AS bin FROM (
    SELECT "column", value, min(value) OVER (PARTITION BY "column") AS lo,
           (max(value) OVER (PARTITION BY "column") - min(value) OVER (PARTITION BY "column")) / 50 AS w
    FROM (SELECT price, quantity, line_amount FROM clean) UNPIVOT (value FOR "column" IN (price, quantity, line_amount))))
GROUP BY "column", bin, lo, w"""))
def a9(spark, d):
    rows = T.histogram(V.clean(spark, d), ["price", "quantity", "line_amount"])
    return rows.select("column", "bin", *V.nine("low", "high"), "n")


@query("k1_sorted_interactions", sql("clean", "SELECT customer_id, invoice_date, stock_code FROM clean ORDER BY 1, 2, 3"))
def k1(spark, d):
    return T.sorted_for_export(V.clean(spark, d)).select("customer_id", "invoice_date", "stock_code")


@query("k1_items_by_popularity", sql("items", "SELECT stock_code, popularity FROM items ORDER BY popularity DESC, stock_code"))
def k1_items(spark, d):
    return T.by_popularity(T.item_catalog(V.clean(spark, d))).select("stock_code", "popularity")


@query("w4_item_ids", sql("item_map", "SELECT * FROM item_map"))
def w4_items(spark, d):
    return T.item_id_map(V.clean(spark, d))


@query("w4_customer_ids", sql("customer_map", "SELECT * FROM customer_map"))
def w4_customers(spark, d):
    return T.customer_id_map(V.clean(spark, d))


@query("j1_lines_with_ids", sql("clean item_map customer_map", """
SELECT user_idx, item_idx, invoice_date, round(quantity, 6) AS quantity
FROM clean JOIN item_map USING (stock_code) JOIN customer_map USING (customer_id)"""))
def j1(spark, d):
    rows = V.clean(spark, d)
    mapped = T.with_ids(rows, T.item_id_map(rows), T.customer_id_map(rows))
    return mapped.select("user_idx", "item_idx", "invoice_date", *V.six("quantity"))


@query("j10_codes_to_items", sql("item_map", """
SELECT p_partkey, item_idx FROM part JOIN item_map ON stock_code = CAST(p_partkey AS VARCHAR)"""))
def j10(spark, d):
    from basketflow.operators.serving import codes_to_items

    codes = table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("stock_code"))
    return codes_to_items(codes, T.item_id_map(V.clean(spark, d))).select("p_partkey", "item_idx")
