"""Spelling variants: words one edit apart, found by walking a relational trie level by level.

Every word stands twice in one trie: as it is and reversed, below two roots.
The trie is an edge table (node, label, child, ends) in which a node is the
hash of its prefix, chains without a branch are one edge with a longer label,
and ``ends`` names the words that end at the child.  The frontier is a table of
states (word, rest, node): what of the word is still to be matched below a
node after its one edit.  Each round joins it with the edge table: labels that
begin the rest of a word lead one level down, others end the state.  A state
whose rest is empty at the end of a word has found a neighbor.  Edges know the
characters that begin the edges below them, so most states end without a join.

A word's own nodes are its states without an edit.  They open the walk where
at least half of the word is matched: an edge that leaves the word's own path
is an edit, either another character in place of the next one or a character
more.  If the common prefix of two neighbors is shorter than that half, their
common suffix is longer than the other half, and the reversed word finds the
pair.  So no walk begins near a root, where every word meets every letter.
Each pair is found from its shorter word, or from the one with the smaller
character; a last comparison of the two words makes the result exact whatever
the hashes.  Work grows with the words and the edges that their nodes have,
at most one per letter of the alphabet, never with pairs below a prefix.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basketflow.session import Scratch, settle

LEAST_LENGTH = 7
LEAST_COUNT = 2
TIMES = 10  # a form is so many times as frequent as its variant
DELETE_ONE_IN = 31
HELD_WORDS = 400_000  # different words that a task counts before it passes them on

_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so that powers of it are different
_FOLD = np.uint64(0xD6E8FEB86659FD93)
_SIDES = (np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179))


# ---- words ------------------------------------------------------------------------------------

def _word_counts(least: int):
    # a word may have lost one of its characters
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def words(doc: str, text: str) -> Iterator[tuple[str, int]]:
        # only A-Z in lower case, which bytes do
        for word, n in Counter(runs.findall(text.encode("utf-8").lower().decode("utf-8"))).items():
            h = zlib.crc32(f"{doc}:{word}".encode())
            if h % DELETE_ONE_IN == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
                if len(word) < least:
                    continue
            yield word, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                if text.is_valid:
                    for word, n in words(str(doc) if doc.is_valid else "", text.as_py()):
                        counts[word] += n
                if len(counts) >= HELD_WORDS:
                    yield out()
                    counts.clear()
        yield out()

    return run


def corpus_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)``: the words of all texts with their occurrences.

    A word is a maximal run of Latin letters (A-Z, a-z, U+00C0 to U+00FF) with
    A-Z in lower case.  In one of 31 (document, run), chosen by CRC-32 of
    ``<doc_id>:<run>``, the run loses the character that the hash names.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(_word_counts(least_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---- the trie ---------------------------------------------------------------------------------

def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word and side, each prefix that a walk may reach: its depth, its node and the next character."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        words = batch.column(1).to_pylist()
        for side, salt in enumerate(_SIDES):
            texts = words if side == 0 else [w[::-1] for w in words]
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
            # one place more per word: its end
            begin = np.cumsum(size) - size
            row = np.repeat(np.arange(len(texts)), size + 1)
            depth = np.arange(len(row)) - np.repeat(begin + np.arange(len(texts)), size + 1)
            powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(size.max(initial=0)) + 1, _STEP))])
            mixed = (letters + salt) * _FOLD
            mixed ^= mixed >> np.uint64(29)
            terms = np.zeros(len(row), np.uint64)
            inner = depth > 0
            terms[inner] = mixed * powers[depth[inner]]
            sums = np.cumsum(terms)
            first = (begin + np.arange(len(texts)))[row]
            node = sums - sums[first] + salt + powers[depth]
            node = (node ^ (node >> np.uint64(32))) * _FOLD
            following = np.full(len(row), -1, np.int64)
            last = depth == size[row]
            following[~last] = letters.astype(np.int64)
            keep = depth >= (size[row] - 1) // 2
            count = int(keep.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row[keep]]), pa.array(np.full(count, side, np.int32)), pa.array(depth[keep].astype(np.int32)),
                 pa.array(node[keep].view(np.int64)), pa.array(following[keep].astype(np.int32))],
                names=["id", "side", "depth", "node", "following"])


def _bit(code: str) -> str:
    """One of 64 bits for a character; characters that share one make no difference to the result."""
    return f"shiftleft(1L, {code} & 63)"


def trie_paths(words: DataFrame, scratch: Scratch) -> DataFrame:
    """The path of each word through the trie, from the first node that a walk may reach.

    Rows (id, side, rest, depth, size, node, branches, heads, label, child,
    ends, below): the rest of the word below the node, whether several edges
    leave the node, the bits of the characters they begin with, and the edge
    that the word takes from there, with the bits below its child; those are
    null at the word's end.  Nodes without a branch, where no word ends, are
    left out.
    """
    prefixes = scratch.settle(words.select("id", "word").mapInArrow(_prefixes, "id long, side int, depth int, node long, following int"))
    onward = F.col("following") >= 0
    kept = prefixes.groupBy("node").agg(
        F.min("following").alias("least"), F.max("following").alias("most"), F.min(F.when(onward, F.col("following"))).alias("first"),
        F.bit_or(F.when(onward, F.expr(_bit("following"))).otherwise(F.lit(0).cast("long"))).alias("heads"))
    kept = kept.where("least < most OR least = -1").select("node", (F.coalesce("first", F.lit(-1)) < F.col("most")).alias("branches"), "heads")
    nodes = prefixes.join(kept, "node").select("id", "side", "depth", "node", "branches", "heads")
    below = W.partitionBy("id", "side").orderBy("depth")
    nodes = nodes.withColumns({"to": F.lead("depth").over(below), "child": F.lead("node").over(below), "below": F.lead("heads").over(below)})
    text = F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word"))
    rows = nodes.join(words.select("id", "word"), "id").withColumn("text", text)
    paths = scratch.settle(rows.select(
        "id", "side", F.expr("substring(text, depth + 1)").alias("rest"), "depth", F.length("word").alias("size"), "node", "branches", "heads",
        F.expr("substring(text, depth + 1, to - depth)").alias("label"), "child",
        F.when(F.col("to") == F.length("word"), F.col("id")).alias("ends"), "below"))
    scratch.drop(prefixes)
    return paths


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """``(a, b)``: ids of pairs of different words of ``words`` (id, word), each once: all that are one edit apart.

    Two prefixes that share a hash may add pairs that are further apart, and
    lose none; the caller compares the words.
    """
    paths = trie_paths(words, scratch)
    # of two words that end at one node, whose hashes then are equal, both are named
    edges = paths.where("child IS NOT NULL").groupBy("node", "label", "child", "below").agg(F.min("ends").alias("ends"), F.max("ends").alias("last"))
    # the first character apart: a state with an edit takes only edges that begin with its next one
    edges = scratch.settle(edges.withColumn("head", F.expr("left(label, 1)")))
    start = F.when(F.col("side") == 0, F.floor(F.col("size") / 2)).otherwise(F.ceil(F.col("size") / 2))
    own = paths.where((F.col("depth") >= start) & (F.col("branches") | ((F.col("rest") == "") & (F.col("heads") != 0)))).select("id", "rest", "node")

    # A state goes on if an edge below may begin with its next character, or if it is at the end of a word.
    alive = F.expr(f"CASE WHEN rest = '' THEN ends IS NOT NULL ELSE below & {_bit('ascii(rest)')} <> 0 END")
    state = lambda rows: rows.where(alive).select("id", "rest", F.col("child").alias("node"), "ends", "last")

    # The first edit: an edge beside the word's own path.
    rest, tail = F.col("rest"), F.expr("substring(label, 2)")
    other = (rest != "") & (F.col("head") > F.expr("left(rest, 1)")) & F.expr("substring(rest, 2)").startswith(tail)
    more = (F.col("head") != F.expr("left(rest, 1)")) & rest.startswith(tail)
    options = F.array(F.when(other, F.expr("substring(rest, length(label) + 1)")), F.when(more, F.expr("substring(rest, length(label))")))
    opened = own.join(edges, "node").where(other | more)
    states = scratch.settle(state(opened.select("id", "child", "below", "ends", "last", F.explode(F.array_compact(options)).alias("rest"))))
    scratch.drop(paths)

    found = []
    while True:
        ended = states.where("rest = ''").select("id", F.explode(F.array("ends", "last")).alias("near"))
        found.append(scratch.settle(ended.select(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b")).where("a <> b").distinct()))
        going = states.where("rest <> ''").select("id", "rest", "node", F.expr("left(rest, 1)").alias("head"))
        if going.isEmpty():
            return reduce(DataFrame.union, found).distinct()
        met = going.join(edges, ["node", "head"]).where(rest.startswith(F.col("label")))
        following = state(met.select("id", "child", "below", "ends", "last", F.expr("substring(rest, length(label) + 1)").alias("rest")))
        following = scratch.settle(following)
        scratch.drop(states)
        states = following


# ---- forms ------------------------------------------------------------------------------------

def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, root)`` of the rows (id, form): each chain of forms to its end, in steps that double.

    A form is ten times as frequent as the word, so chains are short and have no circles.
    """
    current = scratch.settle(forms.select("id", F.col("form").alias("root")))
    while True:
        further = current.select(F.col("id").alias("root"), F.col("root").alias("next"))
        longer = current.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        longer = scratch.settle(longer)
        if longer.where("moved").isEmpty():
            return current
        current = longer.select("id", "root")


def spelling_groups(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n): every word with the form that it is a variant of.

    Words are those of ``corpus_words``.  Two are near if one inserted, deleted
    or replaced code point makes one the other.  The form of a word is its
    near word of largest n, the first in code-point order on a tie, if that n
    is at least ``times`` the word's own.  The root follows forms to the last;
    a word without a form is its own root.

    Null and empty texts hold no words; a null doc_id stands as an empty one
    in the hash.  Repeated rows count as often as they occur.  Very long words
    are walked whole.  An empty table gives an empty one.  Other columns are
    not read.  The result is settled.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        words = scratch.settle(corpus_words(docs, least_length, least_count))
        words = scratch.settle(words.withColumn("id", F.monotonically_increasing_id()))
        pairs = near_pairs(words, scratch)
        one = words.select(F.col("id").alias("a"), F.col("word").alias("word_a"), F.col("n").alias("n_a"))
        two = words.select(F.col("id").alias("b"), F.col("word").alias("word_b"), F.col("n").alias("n_b"))
        pairs = pairs.join(one, "a").join(two, "b").where(F.levenshtein("word_a", "word_b", 1) == 1)
        entry = lambda x, y: F.struct(
            F.col(x).alias("id"), F.col(f"n_{x}").alias("n"), F.struct((-F.col(f"n_{y}")).alias("less"), F.col(f"word_{y}").alias("word"), F.col(y).alias("id")).alias("near"))
        sides = pairs.select(F.inline(F.array(entry("a", "b"), entry("b", "a"))))
        best = sides.groupBy("id", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
        often = -F.col("near.less") >= F.lit(times) * F.col("n")
        best = scratch.settle(best.select(
            "id", "n_near", F.when(often, F.col("near.word")).alias("form"), F.when(often, -F.col("near.less")).alias("form_n"),
            F.when(often, F.col("near.id")).alias("form_id")))
        roots = _roots(best.where("form IS NOT NULL").select("id", F.col("form_id").alias("form")), scratch)
        names = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
        rows = words.join(best, "id", "left").join(roots.join(names, "root").select("id", "root_word"), "id", "left")
        return settle(rows.select(
            "word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
