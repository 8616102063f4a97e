"""Operators that carry all columns keep those that are named like their own."""

from collections import Counter

import pytest

from basketflow.llm.histogram_sort import shard_rows
from basketflow.llm.line_templates import drop_templates
from basketflow.llm.temperature_mix import temperature_mix

OWN = {
    "shards": ["_size", "_hash", "_id", "_row", "_part", "_offset", "_carried", "_draw", "place", "bytes"],
    "mix": ["_mix_key", "_mix_block", "_mix_times", "_mix_source", "_mix_weight", "_mix_quota", "_mix_passes", "_mix_row", "_mix_from", "_key", "_source", "tokens"],
    "templates": ["_text_key", "_dropped", "dropped", "dropped_", "_key", "key", "leaf", "line", "_row"],
}
RUN = {"shards": lambda d: shard_rows(d, 3), "mix": lambda d: temperature_mix(d, max_repeats=2.0, budget_share=None), "templates": drop_templates}


@pytest.mark.parametrize("name", list(OWN))
def test_columns_named_as_the_operators_own_are_kept(spark, name):
    own = OWN[name]
    rows = [(i, f"text number {i}\nthe same closing line of all", "ab"[i % 2], *[f"{c}{i}" for c in own]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in own))
    found = RUN[name](docs)
    assert [c for c in found.columns if c in docs.columns] == docs.columns
    got = {tuple(r[c] for c in ("doc_id", *own)) for r in found.collect()}
    assert got == {(r[0], *r[3:]) for r in rows}


ADDED = {"shards": ["size", "shard", "slot", "text_crc32"], "mix": ["mix_tokens", "mix_weight", "mix_quota", "mix_pass"], "templates": ["lines", "lines_dropped"]}


@pytest.mark.parametrize("name", list(ADDED))
def test_columns_named_as_the_added_ones_are_replaced(spark, name):
    docs = spark.createDataFrame([(i, f"w {i}", "a", *["old"] * len(ADDED[name])) for i in range(9)],
                                 "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in ADDED[name]))
    found = RUN[name](docs)
    assert Counter(found.columns) == Counter(set(docs.columns) | set(found.columns))
    assert all(r[c] != "old" for r in found.collect() for c in ADDED[name])
