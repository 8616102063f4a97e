"""Declared schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


LONG, DOUBLE, TEXT, TIME = T.LongType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()
ID_LIST, VECTOR = T.ArrayType(T.LongType()), T.ArrayType(T.FloatType())

RAW_LINES = _struct(
    stock_code=TEXT, description=TEXT, customer_id=LONG, quantity=DOUBLE, line_amount=DOUBLE,
    invoice_date=TIME, country=TEXT, brand=TEXT, category=TEXT, vendor=TEXT, model=TEXT,
    short_item_no=TEXT, sales_channel=TEXT, vat_status=TEXT, unique_transaction=TEXT,
    num_transactions=LONG,
)
# Columns of RAW_LINES a source may lack; every operator tests for them at plan time.
RAW_LINES_OPTIONAL = (
    "model", "short_item_no", "sales_channel", "vat_status", "unique_transaction", "num_transactions",
)
INTERACTIONS = _struct(
    customer_id=LONG, invoice_date=TIME, stock_code=TEXT, description=TEXT, quantity=DOUBLE,
    price=DOUBLE, line_amount=DOUBLE, country=TEXT, brand=TEXT, category=TEXT, vendor=TEXT,
)
ITEMS = _struct(
    stock_code=TEXT, description=TEXT, price_median=DOUBLE, price_mean=DOUBLE, popularity=LONG,
    brand=TEXT, category=TEXT, vendor=TEXT,
)
CUSTOMERS = _struct(
    customer_id=LONG, first_date=TIME, last_date=TIME, n_events=LONG, n_lines=LONG,
    country_mode=TEXT, total_spent=DOUBLE,
)
ITEM_MAP = _struct(stock_code=TEXT, item_idx=LONG)
CUSTOMER_MAP = _struct(customer_id=LONG, user_idx=LONG)
SEQUENCES = _struct(
    query_id=LONG, customer_id=LONG, user_idx=LONG, ts=TIME, history=ID_LIST, pos_item_idx=LONG,
    country=TEXT, split=TEXT,
)
VECTORS = _struct(idx=LONG, embedding=VECTOR)
CANDIDATES = _struct(query_id=LONG, history=ID_LIST, pos_item_idx=LONG, cands=ID_LIST, ts=TIME)
FEATURES = _struct(
    query_id=LONG, item_idx=LONG, dot_uv=DOUBLE, max_sim_recent=DOUBLE, pop=DOUBLE,
    hist_len=DOUBLE, price_z=DOUBLE, label=DOUBLE,
)
RANKED = _struct(query_id=LONG, rank=LONG, item_idx=LONG, score=DOUBLE)
METRICS = _struct(model=TEXT, split=TEXT, metric=TEXT, k=LONG, value=DOUBLE)
