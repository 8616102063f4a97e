"""Text rules: line descriptions, display labels, id lists kept as text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Description fragments that mark a line as not a product.
NON_PRODUCT_PATTERNS = (
    "POSTAGE", "SHIPPING", "CARRIAGE", "DELIVERY", "BANK CHARGES", "AMAZON", "DOTCOM", "PACKING",
    "ADJUST", "DISCOUNT", "SAMPLE", "SAMPLES", "CHECK", "TEST", "MANUAL", "FEE", "CHARGE",
)
# Spellings of a missing brand.
UNBRANDED = ("non branded", "nonbranded", "no brand")
# Fixed value: the code some category names start with.
CATEGORY_CODE = r"^(?i:in)\d+\s*[-:_]*\s*"

SPACE = r"[\s\x1c-\x1f]"


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_text(col: Column) -> Column:
    """NFKC, outer whitespace removed, inner whitespace collapsed, upper case; null becomes ''.

    Spark has no NFKC function, so text with non-ASCII characters passes
    through one Arrow function.  ASCII text is its own NFKC form: the function
    gets null for it, since it is called for every row.
    """
    text = F.coalesce(col.cast("string"), F.lit(""))
    nfkc = F.pandas_udf(_nfkc, "string")
    other = text.rlike(r"[^\x00-\x7F]")
    text = F.when(other, nfkc(F.when(other, text))).otherwise(text)
    text = F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")
    return F.upper(F.regexp_replace(text, rf"(?U){SPACE}+", " "))


def is_non_product(col: Column, patterns=NON_PRODUCT_PATTERNS) -> Column:
    """True where any fragment occurs anywhere in the text, in any case."""
    return F.coalesce(col.rlike("(?i)" + "|".join(patterns)), F.lit(False))


def _missing(col: Column) -> Column:
    return col.isNull() | (col == "") | (F.lower(col) == "nan")


def category_label(col: Column) -> Column:
    """Display name of a category: leading ``IN<digits>`` code removed, title case."""
    bare = F.trim(F.regexp_replace(F.trim(col), CATEGORY_CODE, ""))
    return F.when(_missing(col) | (bare == ""), "General").otherwise(F.initcap(bare))


def brand_label(col: Column) -> Column:
    """Display name of a brand: text before the first ' - ', title case."""
    bare = F.trim(col)
    return (
        F.when(_missing(col), "Generic")
        .when(F.lower(bare).isin(*UNBRANDED), "Non Branded")
        .otherwise(F.initcap(F.substring_index(bare, " - ", 1)))
    )


def short_title(col: Column, width: int = 50) -> Column:
    """At most ``width`` characters, marked with '...' where text was cut."""
    return F.when(F.length(col) > width, F.concat(F.substring(col, 1, width), F.lit("..."))).otherwise(col)


def parse_id_list(col: Column) -> Column:
    """Space-separated ids to an array; one bad token, blank or null gives an empty array."""
    clean = F.regexp_replace(col, r"^\s+|\s+$", "")
    ids = F.transform(F.split(clean, r"\s+"), lambda x: x.try_cast("bigint"))
    good = F.coalesce(clean.rlike(r"^[+-]?\d+(\s+[+-]?\d+)*$"), F.lit(False))
    return F.when(good, ids).otherwise(F.array().cast("array<bigint>"))


def format_id_list(col: Column) -> Column:
    return F.array_join(F.transform(col, lambda x: x.cast("string")), " ")
