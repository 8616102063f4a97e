import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from basketflow.functions import vectors as X
from basketflow.functions.dates import parse_sale_date
from basketflow.functions.mixing import PRIME, mix, mix_unit
from basketflow.functions.text import (
    brand_label, category_label, format_id_list, is_non_product, normalize_text, parse_id_list, short_title,
)


def column(spark, values, build, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    out = rows.select("i", build(F.col("v")).alias("o")).collect()
    return [r["o"] for r in sorted(out, key=lambda r: r["i"])]


def test_dates(spark):
    texts = ["45292", "Jan-1", "feb 20", "31/12/2024", "12/31/2024", "x", None, "Feb-30", "2024-03-04 05:06:07", " 3.4.2024 "]
    day = lambda *a: dt.datetime(*a)
    assert column(spark, texts, parse_sale_date) == [
        day(2024, 1, 1), day(2024, 1, 1), day(2024, 2, 20), day(2024, 12, 31), day(2024, 12, 31), None, None, None,
        day(2024, 3, 4, 5, 6, 7), day(2024, 4, 3)]


def test_dates_without_a_day_or_a_year(spark):
    texts = ["Mar 2024", "2024-03", "03/2023", "march 2022", "2021 Oct", "5 March", "March 5", "5-3", "13-2024", "2024-13", "Foo 2024", "31 Feb"]
    day = lambda *a: dt.datetime(*a)
    assert column(spark, texts, parse_sale_date) == [
        day(2024, 3, 1), day(2024, 3, 1), day(2023, 3, 1), day(2022, 3, 1), day(2021, 10, 1), day(2024, 3, 5), day(2024, 3, 5), None, None, None, None, None]


def test_dates_from_numbers(spark):
    from pyspark.sql import types as T

    assert column(spark, [45292.7, None], lambda c: parse_sale_date(c, T.DoubleType()), "double") == [dt.datetime(2024, 1, 1), None]


def test_normalized_text(spark):
    texts = ["  ﬁne   pen\t", None, "a\n\n b", "Ⅳ ｆｕｌｌ", ""]
    assert column(spark, texts, normalize_text) == ["FINE PEN", "", "A B", "IV FULL", ""]


def test_non_products(spark):
    assert column(spark, ["BANK CHARGES", "coffee mug", "PEN", None], is_non_product) == [True, True, False, False]


def test_labels(spark):
    assert column(spark, ["IN01 - office", "nan", None, "", "in7", "home decor"], category_label) == [
        "Office", "General", "General", "General", "General", "Home Decor"]
    assert column(spark, ["HP - Laser", "nonbranded", None, "No Brand", "acme co"], brand_label) == [
        "Hp", "Non Branded", "Generic", "Non Branded", "Acme Co"]
    assert column(spark, ["x" * 50, "y" * 51], short_title) == ["x" * 50, "y" * 50 + "..."]


def test_id_lists(spark):
    texts = ["1 2 3", "", None, "1 x 3", "  ", " 7\t8 ", "-1 +2"]
    assert column(spark, texts, parse_id_list) == [[1, 2, 3], [], [], [], [], [7, 8], [-1, 2]]
    assert column(spark, ["1 2"], lambda c: format_id_list(parse_id_list(c))) == ["1 2"]


def test_mixing(spark):
    rows = spark.range(20000).select(mix(7, F.col("id")).alias("m"), mix_unit(7, F.col("id")).alias("u")).toPandas()
    assert rows.m.between(0, PRIME - 1).all() and rows.u.between(0, 1).all()
    shares = np.histogram(rows.u, bins=10, range=(0, 1))[0] / len(rows)
    assert abs(shares - 0.1).max() < 0.02
    again = spark.range(20000).select(mix(7, F.col("id")).alias("m")).toPandas()
    assert (again.m == rows.m).all()


def test_vector_columns(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    out = rows.select(
        X.dot(F.col("a"), F.col("b")).alias("dot"), X.cosine(F.col("a"), F.col("b")).alias("cos"),
        X.distance(F.col("a"), F.col("b")).alias("far"),
        X.cosine_from_distance(X.squared_distance(X.unit(F.col("a")), X.unit(F.col("b")))).alias("back"),
    ).collect()
    assert math.isclose(out[0]["dot"], 24) and math.isclose(out[0]["cos"], 0.96) and math.isclose(out[0]["far"], math.sqrt(2))
    assert math.isclose(out[0]["back"], 0.96)
    assert out[1]["cos"] == 0.0
