"""Tokens of whole texts under a public piece vocabulary: overlapping chunks, spliced at boundaries proven stable.

A huge text is encoded in chunks that overlap; each chunk gives its tokens with
the offsets where they end.  Two neighboring chunks are spliced at an offset
inside their overlap that both have as a boundary and that is proven stable:
no piece of the vocabulary occurs in the text across it.  A token is always a
piece of the vocabulary (or the bytes of one character), and every merge on
the way to it makes one too, so nothing ever joins the two sides of such an
offset: the tokens left of it depend on the left text alone, those right of it
on the right text alone, in the chunks as in the whole text.  Where an overlap
has no such offset, it is widened to twice its length and encoded anew, at
worst up to the end of the text, which is then one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 16_384  # characters
OVERLAP = 256
LIMIT = 4096
SPACE = "▁"  # fixed value: how the vocabulary writes a space


@dataclass(frozen=True)
class Vocabulary:
    """A piece model with what the proof of a boundary needs."""

    model: object
    pieces: frozenset[str]
    pairs: frozenset[str]  # two characters that stand side by side in some piece
    longest: int  # characters of the longest piece
    widths: np.ndarray  # characters that each token covers; of the bytes of one character the first one covers it

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of ``text`` (spaces as SPACE), and the offset at which each one ends."""
        ids = np.asarray(self.model.encode(text), np.int64)
        # the model puts one space before every text
        return ids, np.cumsum(self.widths[ids]) - 1

    def stable(self, text: str, at: int) -> bool:
        """Whether no piece occurs in ``text`` across the offset ``at``."""
        if text[at - 1 : at + 1] not in self.pairs:
            return True
        for start in range(max(0, at - self.longest + 1), at):
            for end in range(at + 1, min(len(text), start + self.longest) + 1):
                if text[start:end] in self.pieces:
                    return False
        return True


def _first_byte(piece: str) -> int:
    """1 for the first byte of a character, 0 for those that follow it."""
    return int(int(piece[3:5], 16) & 0xC0 != 0x80)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Loads a piece model once per worker; it must keep texts as they are but for spaces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.encode("a  ａ", out_type=str)[0] != SPACE + "a" or model.decode(model.encode("a  ａ ")) != "a  ａ ":
        raise ValueError("the model must put one space in front and change nothing else")
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(len(names))]
    byte = [model.is_byte(i) for i in range(len(names))]
    pieces = frozenset(n for n, s, b in zip(names, special, byte, strict=True) if not s and not b)
    pairs = frozenset(p[i : i + 2] for p in pieces for i in range(len(p) - 1))
    widths = np.array([_first_byte(n) if b else len(n) for n, b in zip(names, byte, strict=True)], np.int64)
    return Vocabulary(model, pieces, pairs, max(map(len, pieces)), widths)


def _common(vocab: Vocabulary, text: str, ends: np.ndarray, others: np.ndarray, low: int, high: int) -> int | None:
    """A stable boundary of both chunks between ``low`` and ``high``, the one nearest to the middle."""
    both = np.intersect1d(ends, others)
    both = both[(both >= low) & (both <= high)]
    for at in both[np.argsort(np.abs(2 * both - low - high), kind="stable")].tolist():
        if vocab.stable(text, at):
            return at
    return None


def token_spans(vocab: Vocabulary, text: str | None, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens of a whole text, portion by portion, with the character offsets at which they end.

    The bytes of one character end where the character ends.  Memory is that
    of two chunks as long as overlaps hold a stable boundary.
    """
    text = (text or "").replace(" ", SPACE)
    start, stop, width = 0, min(len(text), chunk), overlap
    ids, ends = vocab.encode(text[:stop])
    done = 0  # the offset up to which tokens are given
    while stop < len(text):
        # tokens near the left end of a chunk may use the space put in front of it
        follow = max(done, stop - width)
        reach = min(len(text), follow + max(chunk, 2 * width))
        later, later_ends = vocab.encode(text[follow:reach])
        later_ends = later_ends + follow
        at = _common(vocab, text, ends, later_ends, follow + vocab.longest, stop - 1)
        if at is None:
            width *= 2
            stop = min(len(text), stop + width)
            ids, ends = vocab.encode(text[start:stop])
            ends = ends + start
        else:
            mine = (ends <= at) & ((ends > done) | (start == 0))
            yield ids[mine], ends[mine]
            done, start, stop, width, ids, ends = at, follow, reach, overlap, later, later_ends
    mine = (ends > done) | (start == 0)
    yield ids[mine], ends[mine]


def _counted(path: str, chunk: int, overlap: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = batch.column(1)
            counts = [sum(len(ids) for ids, _ in token_spans(vocab, text.as_py(), chunk, overlap)) for text in texts]
            size = [0 if not text.is_valid else text.as_buffer().size for text in texts]
            tokens = pa.array(counts, pa.int64())
            over = pa.array([n > limit for n in counts], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), tokens, over],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def _spans(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                before = 0
                for ids, ends in token_spans(vocab, text.as_py(), chunk, overlap):
                    starts = np.concatenate([[before], ends[:-1]]) if len(ends) else ends
                    before = int(ends[-1]) if len(ends) else before
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc.as_py()], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64())),
                         pa.array([starts.tolist()], pa.list_(pa.int64())), pa.array([ends.tolist()], pa.list_(pa.int64()))],
                        names=["doc_id", "ids", "starts", "ends"])

    return run


def _model_path(model: str | None) -> str:
    if model is not None:
        return model
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def token_counts(docs: DataFrame, model: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one per row of ``docs``, in one pass without a shuffle.

    ``model`` is the path of a piece model that every executor can read.
    Whole texts are counted, without begin, end or other added tokens; special
    strings in a text are ordinary text.  Null and empty texts have no bytes
    and no tokens.  Repeated rows give repeated rows; a null id stays null.
    Other columns are not read, whatever their names.  An empty table gives
    an empty one.
    """
    path = _model_path(model)
    return _texts(docs).mapInArrow(_counted(path, chunk, overlap, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def token_table(docs: DataFrame, model: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Rows (doc_id, ids, starts, ends): the tokens of each text in portions of about ``chunk`` characters.

    ``starts`` and ``ends`` are character offsets in the text; the bytes of
    one character lie at its end.  Null and empty texts have one portion
    without tokens.
    """
    kind = "doc_id long, ids array<long>, starts array<long>, ends array<long>"
    return _texts(docs).mapInArrow(_spans(_model_path(model), chunk, overlap), kind)
