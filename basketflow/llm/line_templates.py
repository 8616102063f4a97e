"""Line deduplication by a log-template tree of fixed depth.

A line goes down the tree by its number of tokens and its leading tokens
(tokens with digits count as ``<*>``).  In its leaf a token stays where enough
lines hold it at the same place, all others generalise to ``<*>``: that is the
line's template.  A template that occurs in enough different texts, and in
which enough tokens stayed, is boilerplate: its lines are dropped everywhere.

Supports are counts, so the templates do not depend on the order of lines, and
no leaf has to fit into a task.  The passes over the texts emit hashes; the
tokens themselves travel only for lines of leaves that enough texts reach,
which a bitmap of fixed size tells the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketflow.llm.bitmap import bitmap
from basketflow.session import Scratch, settle

LEADING = 3  # tokens that lead down the tree, after the number of tokens
MIN_TEXTS = 5  # different texts that make a template recurring, and lines that make a token stay
MIN_TOKENS = 3  # shorter lines are left alone
MIN_SHARE = 0.5  # of the tokens must stay
BITMAP_BITS = 23

_DIGIT = re.compile(rb"[0-9]")


def tokens_of(line: bytes) -> list[bytes]:
    tokens = line.split()
    return [b"<*>" if _DIGIT.search(t) else t for t in tokens] if _DIGIT.search(line) else tokens


def _signed(x: int) -> int:
    return x - (1 << 63)


def leaf_and_line(tokens: list[bytes]) -> tuple[int, int]:
    """Hashes of the leaf and of the whole masked line."""
    head = b" ".join([str(len(tokens)).encode(), *tokens[:LEADING]])
    return _signed(xxhash.xxh3_64_intdigest(head)), _signed(xxhash.xxh3_64_intdigest(b" ".join(tokens)))


def _lines(text: str | None) -> Iterator[list[bytes]]:
    for line in text.encode("utf-8", "replace").split(b"\n") if text else ():
        tokens = tokens_of(line)
        if len(tokens) >= MIN_TOKENS:
            yield tokens


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {(key, *leaf_and_line(t)) for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for t in _lines(text.as_py())}
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "leaf", "line"])


def _line_tokens(reached):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int], list[bytes]] = {}
            for text in batch.column(0):
                for tokens in _lines(text.as_py()):
                    place = leaf_and_line(tokens)
                    slot = place[0] & ((1 << BITMAP_BITS) - 1)
                    if place not in found and int(reached.value[slot >> 6]) >> (slot & 63) & 1:
                        found[place] = tokens
            leafs, lines = zip(*found, strict=True) if found else ((), ())
            texts = pa.array([[t.decode("utf-8", "replace") for t in tokens] for tokens in found.values()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(leafs, pa.int64()), pa.array(lines, pa.int64()), texts], names=["leaf", "line", "tokens"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, text): equal texts have one key, so copies of a document count once."""
    return docs.select(F.xxhash64(F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))


def line_templates(docs: DataFrame, scratch: Scratch, min_texts: int = MIN_TEXTS) -> tuple[DataFrame, DataFrame]:
    """The lines (leaf, line, template, texts) of recurring templates, and the (key, leaf, line) of all texts.

    template is the text of the template, texts in how many different texts it occurs.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs)
    held = scratch.settle(keyed.mapInArrow(_line_hashes, "key long, leaf long, line long").distinct())
    reached = held.groupBy("leaf").agg(F.countDistinct("key").alias("_texts")).where(F.col("_texts") >= min_texts).select("leaf")
    known = scratch.settle(held.join(reached, "leaf", "left_semi"))
    support = scratch.settle(known.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("weight")))
    marks = spark.sparkContext.broadcast(bitmap(support.select("leaf"), "leaf", BITMAP_BITS))
    texts = keyed.select("text").mapInArrow(_line_tokens(marks), "leaf long, line long, tokens array<string>")
    lines = support.join(texts.groupBy("leaf", "line").agg(F.first("tokens").alias("tokens")), ["leaf", "line"])
    lines = scratch.settle(lines)
    each = lines.select("leaf", "line", "weight", F.posexplode("tokens").alias("place", "token"))
    often = each.groupBy("leaf", "place", "token").agg(F.sum("weight").alias("_lines")).where(F.col("_lines") >= min_texts).drop("_lines")
    stays = each.join(often, ["leaf", "place", "token"]).groupBy("leaf", "line")
    stays = stays.agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("stays"))
    shaped = lines.join(stays, ["leaf", "line"]).where(F.size("stays") >= MIN_SHARE * F.size("tokens"))
    held_at = F.map_from_entries("stays")
    template = F.array_join(F.transform("tokens", lambda t, i: F.when(F.element_at(held_at, i).isNotNull(), t).otherwise("<*>")), " ")
    shaped = scratch.settle(shaped.select("leaf", "line", template.alias("template")))
    counted = known.join(shaped, ["leaf", "line"]).groupBy("template").agg(F.countDistinct("key").alias("texts")).where(F.col("texts") >= min_texts)
    return shaped.join(counted, "template"), held


def free_name(name: str, taken: list[str]) -> str:
    """``name``, longer where a column has it already."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def _without(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Replaces the text by its kept lines; the last column holds the hashes of the lines to drop."""
    for batch in batches:
        texts, counts, drops = [], [], []
        for text, dropped in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            lines = text.split("\n") if text is not None else []
            kept = lines
            if dropped:
                gone = set(dropped)
                kept = [x for x in lines if len(t := tokens_of(x.encode("utf-8", "replace"))) < MIN_TOKENS or leaf_and_line(t)[1] not in gone]
            texts.append("\n".join(kept) if text is not None else None)
            counts.append(len(lines))
            drops.append(len(lines) - len(kept))
        columns = list(batch.columns[:-1])
        columns[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32()), pa.array(drops, pa.int32())], names=[*batch.schema.names[:-1], "lines", "lines_dropped"])


def drop_templates(docs: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of the text, and columns lines and lines_dropped.

    Lines end at line feeds; those below MIN_TOKENS tokens and empty ones
    stay.  Texts count once however many rows repeat them.  A null text stays
    null and has no lines; an empty text has one empty line.  Columns named as
    the added ones are replaced, all others are kept.  The result is settled.
    """
    carried = [c for c in docs.columns if c not in ("lines", "lines_dropped")]
    at = carried.index("text")
    with Scratch(docs.sparkSession) as scratch:
        recurring, held = line_templates(docs, scratch, min_texts)
        dropped = held.join(recurring.select("leaf", "line"), ["leaf", "line"]).groupBy("key").agg(F.collect_set("line").alias("_dropped"))
        dropped = dropped.withColumnRenamed("key", "_key")
        # whatever their names, the caller's columns stay apart from those of the join
        rows = docs.select(F.struct(*carried).alias("_row"), F.xxhash64(F.col("text").cast("string")).alias("_text_key"))
        joined = rows.join(dropped, rows["_text_key"] == dropped["_key"], "left")
        gone = free_name("dropped", carried)
        joined = joined.select(*[F.col("_row")[c].alias(c) for c in carried], F.col("_dropped").alias(gone))
        added = [T.StructField(c, T.IntegerType()) for c in ("lines", "lines_dropped")]
        schema = T.StructType([*docs.select(*carried).schema.fields, *added])
        return settle(joined.mapInArrow(lambda batches: _without(batches, at), schema))
