"""Removing passages that stand earlier in the corpus: fixed-block anchors and rolling probes.

1. Every document is cut into non-overlapping blocks of `window // 2` words, which are the index. All rolling windows
   of that many words, of all documents, probe it. A passage of `window` words always holds a whole block of the
   document it stands in, so both places of a repeated passage have a block that is hit.
2. Where all blocks inside a `window`-word span are hit, the span is a candidate. Hits are extended there: spans are
   compared by their whole word sequence, and all but the first in corpus order are marked.
3. Marked spans that overlap join into maximal repeats, whose words go.

Texts move once (both joins read one exchange on doc_id); index, probes and marks move packed. Nothing is broadcast
or collected. A passage with very many copies is one entry for each batch (see anchors.py).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as an
from . import textarrays as ta

PIECE = 2_000_000
WORDS, SECOND = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def word_hashes(column: pa.Array):
    """Bytes, word starts and ends, words before each text, a hash for each word."""
    data, offsets = ta.text_bytes(column)
    starts, ends, bounds = ta.word_spans(data, offsets)
    return data, starts, ends, bounds, ta.span_hashes(ta.BYTE_VALUES[data], starts, ends, WORDS)


def rolling(words: np.ndarray, bounds: np.ndarray, size: int, base: int):
    """For all windows of size words inside one text: hash, text and start in the text."""
    n = np.maximum(np.diff(bounds) - size + 1, 0)
    text, at = np.repeat(np.arange(len(n)), n), ta.within(n)
    i = bounds[text] + at
    return ta.span_hashes(words, i, i + size, base), text, at


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts without the words that any repeated window covers.

    A window is `window` consecutive words `[^\\x20\\x09-\\x0D]+` of one document. It is a repeat if its word sequence
    also starts earlier: in a document with a smaller id, or sooner in the same one. All windows are judged on the
    input.

    Returns doc_id, text (kept words joined by one space), n_words, n_removed, spans (array of [first, last + 1) word
    spans that went). A null or blank text has no words and yields "". Rows with a null id are left out, as no result
    could name them; of several rows with one id, the smallest text stands for it. Other columns are not looked at.
    """
    block = window // 2
    if block < 1:
        raise ValueError("window must be at least 2")

    def blocks(batches):
        for piece in (p for b in batches for p in ta.pieces([b], PIECE)):
            _, _, _, bounds, words = word_hashes(piece.column("text"))
            hashes, text, at = rolling(words, bounds, block, WORDS)
            own = at % block == 0
            ids = piece.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            yield hashes, hashes[own], ids[text[own]], at[own] // block

    def candidates(batches):
        for piece in (p for b in batches for p in ta.pieces([b], PIECE)):
            _, _, _, bounds, words = word_hashes(piece.column("text"))
            row, first, last = an.mark_spans(piece.column("marks"))
            own = np.r_[0, np.cumsum(np.diff(bounds) // block + 2)]
            # hits of another row of the id may lie beyond this text; whole windows are compared below
            hit = ta.covered(*(np.minimum(own[row] + x, own[row + 1]) for x in (first, last)), int(own[-1]))
            n = np.maximum(np.diff(bounds) - window + 1, 0)
            text, at = np.repeat(np.arange(len(n)), n), ta.within(n)
            b = own[text] + -(-at // block)
            # the first whole block in the span, and what else fits behind it
            take = hit[b]
            for k in range(1, window // block):
                take &= hit[np.minimum(b + k, len(hit) - 1)] | (-(-at // block) * block + (k + 1) * block > at + window)
            text, at = text[take], at[take]
            i = bounds[text] + at
            ids = piece.column("doc_id").to_numpy().astype(np.int64)
            yield ta.span_hashes(words, i, i + window, WORDS), ta.span_hashes(words, i, i + window, SECOND), ids[text], at

    def cut(batches):
        for piece in (p for b in batches for p in ta.pieces([b], PIECE)):
            data, offsets = ta.text_bytes(piece.column("text"))
            starts, ends, bounds = ta.word_spans(data, offsets)
            row, first, last = an.mark_spans(piece.column("marks"))
            gone = ta.covered(bounds[row] + first, bounds[row] + last + window - 1, len(starts))
            stay = ~gone
            text = np.repeat(np.arange(len(piece)), np.diff(bounds))
            held = np.flatnonzero(ta.covered(starts[stay], ends[stay], len(data)))
            length = (ends - starts)[stay]
            # each kept word's bytes and a space behind it
            out = np.full(len(held) + len(length), 0x20, np.uint8)
            out[np.arange(len(held)) + np.repeat(np.arange(len(length)), length)] = data[held]
            to = np.cumsum(np.bincount(text[stay], length + 1, len(piece))).astype(np.int64)
            raw = out.tobytes()
            texts = [raw[a : b - 1] if b > a else b"" for a, b in zip(np.r_[0, to[:-1]].tolist(), to.tolist(), strict=True)]
            span_row, a, b = ta.runs(text[gone], np.flatnonzero(gone))
            spans = pa.ListArray.from_arrays(np.searchsorted(span_row, np.arange(len(piece) + 1)).astype(np.int32), pa.StructArray.from_arrays([pa.array((a - bounds[span_row]).astype(np.int32)), pa.array((b - bounds[span_row]).astype(np.int32))], ["first", "last"]))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(texts, pa.binary()), pa.array(np.diff(bounds)), pa.array(np.bincount(text[gone], minlength=len(piece)).astype(np.int64)), spans], ["doc_id", "text", "n_words", "n_removed", "spans"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    texts = an.one_text_each(docs, id_col, text_col)
    hits = an.by_document(an.repeated_references(plain, blocks))
    marks = an.by_document(an.repeated_spans(texts.join(hits, "doc_id"), candidates, earlier_stays=True))
    return texts.join(marks, "doc_id", "left").mapInArrow(cut, "doc_id long, text binary, n_words long, n_removed long, spans array<struct<first:int,last:int>>").withColumn("text", F.col("text").cast("string"))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for all documents, windows of 20 words."""
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
