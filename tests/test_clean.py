import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketflow.operators import clean as C, ingest as I, tables as T
from basketflow.operators.quantiles import exact_quantiles, grouped_medians

DAY = dt.datetime(2024, 1, 1)
LINE = "stock_code string, description string, customer_id long, quantity double, line_amount double, invoice_date timestamp_ntz, country string, brand string, category string, vendor string, unique_transaction string"


def line(**over):
    base = dict(stock_code="a1", description="pen", customer_id=1, quantity=1.0, line_amount=2.0, invoice_date=DAY,
                country="X", brand="b", category="c", vendor="v", unique_transaction="1")
    return {**base, **over}


def lines(spark, rows):
    names = [part.split()[0] for part in LINE.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], LINE)


def test_prices(spark):
    rows = spark.createDataFrame([("10", "2"), ("10", "0"), ("a", "2"), (None, "1"), ("inf", "1")], "line_amount string, quantity string")
    assert [r["price"] for r in I.compute_prices(rows).collect()] == [5.0, None, None, None, None]


def test_missing_columns_are_skipped(spark):
    rows = spark.createDataFrame([(1, None), (2, "x")], "other long, description string")
    assert I.compute_prices(rows).columns == rows.columns
    assert I.parse_dates(rows).columns == rows.columns
    assert C.keep_valid_rows(rows).count() == 1
    assert C.merge_lines(rows).columns == rows.columns


def test_unparsable_dates_raise(spark):
    rows = I.parse_dates(spark.createDataFrame([("x",), (None,)], "invoice_date string"))
    assert I.date_success(rows).first()["valid_ratio"] == 0.0
    with pytest.raises(ValueError):
        I.require_dates(rows)


def test_returns(spark):
    rows = spark.createDataFrame([("C123",), ("123",), (None,), ("c1",)], "unique_transaction string")
    assert [r[0] for r in rows.where(C.is_sale(rows)).collect()] == ["123", None, "c1"]


def test_merge(spark):
    rows = I.compute_prices(lines(spark, [
        line(quantity=3.0, line_amount=3.0, brand=None), line(quantity=1.0, line_amount=3.0, brand="z"), line(customer_id=None)]))
    merged = C.merge_lines(rows).collect()
    assert len(merged) == 1
    assert (merged[0]["quantity"], merged[0]["line_amount"], merged[0]["price"], merged[0]["brand"]) == (4.0, 6.0, 1.5, "z")


def test_bounds_match_numpy(spark):
    values = [1.0, 2.0, 3.0, 10.0]
    rows = spark.createDataFrame([(v, v, v) for v in values], "price double, quantity double, line_amount double")
    q1, q3 = np.percentile(np.log(values), [25, 75])
    for parts in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = C.iqr_bounds(rows).first()
        assert math.isclose(got["price_lo"], math.exp(q1 - 3 * (q3 - q1)), rel_tol=1e-9)
        assert math.isclose(got["line_amount_hi"], math.exp(q3 + 3 * (q3 - q1)), rel_tol=1e-9)


def test_bounds_of_nothing(spark):
    rows = spark.createDataFrame([(None, 1.0, 1.0)], "price double, quantity double, line_amount double")
    for parts in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = C.iqr_bounds(rows).first()
        assert got["price_lo"] == 0.0 and got["price_hi"] == float("inf")


def test_winsorize_keeps_null(spark):
    rows = spark.createDataFrame([(None, 1.0, 1.0), (1.0, 1.0, 1.0), (2.0, 1.0, 2.0), (1e9, 1.0, 1e9)],
                                 "price double, quantity double, line_amount double")
    out = [r["price"] for r in C.winsorize(rows, C.iqr_bounds(rows, multiplier=0.5)).collect()]
    assert out[0] is None and max(v for v in out if v is not None) < 1e9


def test_rare_items_then_users_once(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1)], "stock_code string, customer_id long")
    kept = C.keep_frequent(C.keep_frequent(rows, "stock_code", 2), "customer_id", 2)
    assert [(r["stock_code"], r["customer_id"]) for r in kept.collect()] == [("a", 2), ("a", 2)]


def test_quality_counts_add_up(spark):
    raw = I.compute_prices(lines(spark, [
        line(), line(), line(description=None), line(unique_transaction="C9"), line(quantity=-1.0), line(line_amount=0.0),
        line(description="Bank charges", stock_code="z"), line(unique_transaction="2"), line(stock_code="b2")]))
    got = {r["step"]: r["rows_removed"] for r in C.quality_counts(raw).collect()}
    assert got == {
        "drop_missing_core": 1, "drop_returns": 1, "drop_nonpositive_qty": 1, "drop_nonpositive_price": 1,
        "drop_duplicates": 1, "drop_non_product_patterns": 1, "aggregated_duplicate_lines": 1, "drop_outliers": 0}
    assert raw.count() - sum(got.values()) == C.clean_lines(raw).count()
    loose = C.CleaningRules(drop_duplicates=False, winsorize=True, drop_returns=False)
    got = {r["step"]: r["rows_removed"] for r in C.quality_counts(raw, loose).collect()}
    assert got["drop_duplicates"] == got["drop_outliers"] == 0 and "drop_returns" not in got
    assert raw.count() - sum(got.values()) == C.clean_lines(raw, loose).count()


def test_mode_and_catalog(spark):
    rows = spark.createDataFrame([("i", v) for v in ["b", "a", "b", "a", None]], "stock_code string, brand string")
    assert T.modes(rows, "stock_code", ["brand"]).first()["brand"] == "a"
    nothing = spark.createDataFrame([("i", None, 1.0)], "stock_code string, brand string, price double")
    assert T.modes(nothing.union(nothing), "stock_code", ["brand"]).count() == 0


def test_histogram_counts_everything(spark):
    rows = spark.createDataFrame([(float(v),) for v in range(101)], "price double")
    out = T.histogram(rows, ["price"]).toPandas()
    assert out.n.sum() == 101 and out.bin.max() == 49
    expected, _ = np.histogram(np.arange(101.0), bins=50)
    assert (out.sort_values("bin").n.to_numpy() == expected).all()
    assert T.histogram(rows.where("price = 3"), ["price"]).first()["n"] == 1


def test_large_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 40, 999).astype(float)
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    probs = [0.0, 0.1, 0.25, 0.8, 0.9, 1.0]
    for parts in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = exact_quantiles(rows, {"q": F.col("v")}, probs).first()["q"]
        assert np.allclose(got, np.quantile(values, probs))


def test_medians_of_hot_and_usual_keys(spark):
    rng = np.random.default_rng(4)
    keys = np.where(rng.random(900) < 0.5, 0, rng.integers(1, 20, 900))
    values = rng.integers(0, 300, 900) / 4
    rows = spark.createDataFrame([(int(k), float(v)) for k, v in zip(keys, values)], "k long, v double")
    for parts in (1, 9):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["k"]: r["m"] for r in grouped_medians(rows, ["k"], "v", "m").collect()}
        assert all(math.isclose(got[k], np.median(values[keys == k])) for k in set(keys.tolist()))


@pytest.mark.parametrize("limit", [3, 40, 20_000])
def test_quantiles_by_narrowing(spark, monkeypatch, limit):
    """Several columns, hot values, infinities, nulls and NaN; brackets of a few rows as well as one of all."""
    from basketflow.operators import quantiles as Q

    monkeypatch.setattr(Q, "SORTED", limit)
    monkeypatch.setattr(Q, "SAMPLED", 30)
    draw = np.random.default_rng(6)
    a = np.where(draw.random(2000) < 0.4, 7.0, draw.normal(size=2000) * 100)
    b = draw.integers(0, 9, 2000).astype(float)
    c = np.where(draw.random(2000) < 0.05, np.inf, draw.random(2000))
    rows = [(float(x), float(y), float(z)) for x, y, z in zip(a, b, c, strict=True)] + [(None, math.nan, None)] * 9
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(3)
    probs = [0.0, 0.013, 0.25, 0.5, 0.8, 0.9, 1.0]
    got = exact_quantiles(df, {"x": F.col("a"), "y": F.col("b"), "z": F.col("c"), "none": F.lit(None).cast("double")}, probs).first()
    assert np.allclose(got["x"], np.quantile(a, probs)) and np.allclose(got["y"], np.quantile(b, probs))
    assert got["z"][:5] == pytest.approx(np.quantile(c, probs[:5]).tolist()) and got["z"][-1] == math.inf
    assert got["none"] is None


def test_quantiles_shuffle_little_of_a_large_table(spark, monkeypatch):
    """What leaves the tasks are samples, sums and the last bracket: far fewer rows than the table has."""
    from basketflow.operators import quantiles as Q

    monkeypatch.setattr(Q, "SORTED", 500)
    monkeypatch.setattr(Q, "SAMPLED", 300)
    listed = []
    whole = Q._listed
    monkeypatch.setattr(Q, "_listed", lambda *a: listed.append(whole(*a)) or listed[-1])
    rows = spark.range(200_000).select((F.col("id") * 37 % 200_000).cast("double").alias("v"))
    assert exact_quantiles(rows, {"v": F.col("v")}, [0.8, 0.9]).first()["v"] == pytest.approx([0.8 * 199_999, 0.9 * 199_999])
    assert sum(n for found in listed for values in found.values() for _, n in values) < 12_000


def test_distinct_and_merged_lines_share_one_exchange(spark):
    from basketflow.operators.clean import until_merged

    rows = [
        ("a1", "Red  Mug", 1, 2.0, 4.0, "2024-01-01", "DE", "x"), ("a1", "Red  Mug", 1, 2.0, 4.0, "2024-01-01", "DE", "x"),
        ("A1", "red mug", 1, 2.0, 4.0, "2024-01-01", "DE", "x"), ("A1", "red mug", 1, 1.0, 3.0, "2024-01-01", "AT", None),
        ("A1", "red mug", 1, 1.0, 3.0, "2024-01-02", "AT", "y"), ("B", "red mug", 2, 1.0, 3.0, "2024-01-01", "AT", "y"),
    ]
    lines = spark.createDataFrame(rows, "stock_code string, description string, customer_id long, quantity double, line_amount double, "
                                        "invoice_date string, country string, brand string").withColumn("price", F.col("line_amount") / F.col("quantity"))
    merged = until_merged(lines)
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.customer_id, r.stock_code, r.invoice_date): (r.quantity, r.line_amount, r.country, r.brand) for r in merged.collect()}
    # the copy counts once, lines that differ before they are normalised count each
    assert got == {(1, "A1", "2024-01-01"): (5.0, 11.0, "AT", "x"), (1, "A1", "2024-01-02"): (1.0, 3.0, "AT", "y"), (2, "B", "2024-01-01"): (1.0, 3.0, "AT", "y")}


def test_medians_of_hot_keys_need_no_join_by_key(spark):
    from basketflow.operators.quantiles import grouped_prices

    rows = [("hot", float(i % 101)) for i in range(2_000)] + [("rare", None), ("rare", 4.0), ("rare", 1.0), (None, 2.0), ("none", None)]
    found = grouped_prices(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", "median", "mean", "n")
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.k: (r.median, None if r.mean is None else round(r.mean, 9), r.n) for r in found.collect()}
    values = sorted(float(i % 101) for i in range(2_000))
    assert got == {"hot": ((values[999] + values[1000]) / 2, round(sum(values) / 2000, 9), 2000), "rare": (2.5, 2.5, 3), None: (2.0, 2.0, 1), "none": (None, None, 1)}
