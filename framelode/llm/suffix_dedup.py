"""Removing byte strings that stand more than once: shard Burrows-Wheeler orders merged by interleave refinement.

The alphabet is made of content-defined chunks: a byte starts a chunk if the hash of the GRAM bytes from there is the
smallest in any run of WINNOW places. Inside equal strings the same chunks start, but for WINNOW places at either end,
so a repeated string of `length` bytes holds at least three whole chunks that every copy of it has.

1. Chunks that stand only once in the corpus are found by counting; suffixes that need one of them are settled.
2. Each shard orders its remaining suffixes by their chunks and folds equal ones. With a suffix go its chunk labels, as
   far as every window around it must reach, and the hash of its surroundings (what a Burrows-Wheeler transform keeps of
   the text to the left, and the bytes to the right).
3. A bucket of first chunks merges the shards' orders. As in a transform merge, it holds an interleave of the shards
   and refines it, one chunk of prefix at a time, splitting blocks where prefixes part; suffixes are never sorted as a
   whole. The refinement ends when every block is one suffix or one repeated interval; its step is the common prefix.
4. In a repeated interval, suffixes with equal surroundings are copies: all windows at them go. Where surroundings
   differ, one suffix of each kind sends the hashes of its single windows, and equal ones are found by these. This
   settles the ends of repeats to the byte.

All windows are judged on the input. Texts move once; nothing is collected or broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as an
from . import textarrays as ta

GRAM, WINNOW = 8, 64
#: The shortest length for which three whole chunks are sure.
SHORTEST = 2 * (WINNOW - 1) + GRAM + 4 * WINNOW
PIECE = 1_500_000
FIRST, SECOND = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
CERTAIN, SEND = 1, 2
SHARD = 400_000
PACKED = ("first", "depth", "labels", "around", "many", "doc", "at", "run_doc", "run_at", "run_n")


def _slide(x: np.ndarray, op, width: int) -> np.ndarray:
    """op over x[i : i + width] for each i (shorter at the end); width is a power of two."""
    x = x.copy()
    k = 1
    while k < width:
        x[:-k] = op(x[:-k], x[k:])
        k *= 2
    return x


class Chunks:
    """Chunk starts of a batch of texts, and what their windows reach."""

    def __init__(self, column: pa.Array, length: int):
        self.data, self.offsets = ta.text_bytes(column)
        self.length, n = length, len(self.data)
        self.reach = length - GRAM - 2 * (WINNOW - 1)
        if n < length:
            self.starts = self.text = np.zeros(0, np.int64)
        else:
            raw = np.ascontiguousarray(self.data)
            grams = np.zeros(n, np.uint32)
            grams[: n - GRAM + 1] = (ta.mix(np.ndarray((n - GRAM + 1,), "<u8", raw, 0, (1,)).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            least = _slide(grams, np.minimum, WINNOW)
            # a run of places counts only if it and its grams lie within one text
            for to in self.offsets[1:].tolist():
                least[max(to - WINNOW - GRAM + 2, 0) : to] = 0
            most = _slide(least[::-1], np.maximum, WINNOW)[::-1]
            most_from = np.zeros(n, np.uint32)
            most_from[:] = most
            for at in self.offsets[1:-1].tolist():
                # places whose runs would start in the text before
                to = min(at + WINNOW, n)
                most_from[at:to] = np.maximum.accumulate(least[at:to])
            self.starts = np.flatnonzero(most_from == grams)
            self.text = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.spans = ta.Spans(self.data, (FIRST, SECOND))
        same = self.text[1:] == self.text[:-1]
        self.ends = np.r_[np.where(same, self.starts[1:], self.offsets[self.text[:-1] + 1]), self.offsets[self.text[-1:] + 1]]
        #: a text's last chunk is cut by its end, so it is never part of a prefix
        self.whole = np.r_[same, np.zeros(min(len(self.text), 1), bool)]
        self.number = np.arange(len(self.starts)) - np.searchsorted(self.text, self.text, "left")

    def depth(self) -> np.ndarray:
        """Whole chunks from each start that all its windows hold: those that end within reach of the earliest."""
        to = np.minimum(self.starts + self.reach - WINNOW, self.offsets[self.text + 1] - 1)
        return np.searchsorted(self.starts, to, "right") - 1 - np.arange(len(self.starts))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the windows whose first sure chunk start is this one; last < first if there are none."""
        before = np.r_[-(10**9), np.where(self.text[1:] == self.text[:-1], self.starts[:-1], -(10**9))][: len(self.starts)]
        low = np.maximum(np.maximum(self.starts - 2 * WINNOW + 2, before - WINNOW + 2), self.offsets[self.text])
        return low, np.minimum(self.starts - WINNOW + 1, self.offsets[self.text + 1] - self.length)


def _packed(rows: dict[str, np.ndarray], flat: np.ndarray, runs, buckets: int) -> pa.RecordBatch:
    """One row for each bucket: suffixes in order, columns packed, and the runs that the shard settled itself."""
    cells = {}
    at = np.r_[0, np.cumsum(rows["depth"] - 1)]
    for b, s in an._by_bucket(rows["bucket"]):
        cells[b] = {"first": an._packed_sorted(rows["first"][s]), "depth": ta.planes(rows["depth"][s].astype(np.uint16)), "labels": ta.planes(flat[at[s.start] : at[s.stop]]), "around": ta.planes(rows["around"][s]), "many": ta.planes(rows["many"][s].astype(np.uint8)), "doc": ta.planes(rows["doc"][s]), "at": ta.planes(rows["at"][s].astype(np.uint32))}
    doc, first, last = runs
    home = (doc % buckets).astype(np.int64)
    order = np.argsort(home, kind="stable")
    for b, s in an._by_bucket(home[order]):
        o = order[s]
        cells.setdefault(b, {}).update({"run_doc": ta.planes(doc[o]), "run_at": ta.planes(first[o].astype(np.uint32)), "run_n": ta.planes((last - first)[o].astype(np.uint32))})
    return pa.RecordBatch.from_pylist([{"bucket": b} | dict.fromkeys(PACKED, b"") | c for b, c in cells.items()], pa.schema([("bucket", pa.int32()), *((k, pa.binary()) for k in PACKED)]))


def refine(first: np.ndarray, depth: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges shard orders: (block, prefix) of each suffix, blocks being intervals of equal prefixes.

    first: first labels, shard after shard, each in order; labels: the further depth - 1 labels of each. The interleave
    starts from the first labels. Each step reads one more label of the suffixes in blocks that still hold several, and
    splits the blocks; a suffix that is alone leaves with the length of its common prefix.
    """
    at = np.r_[0, np.cumsum(depth - 1)][:-1]
    n = len(first)
    interleave = np.argsort(first, kind="stable")
    block = np.empty(n, np.int64)
    block[interleave] = np.cumsum(np.r_[True, np.diff(first[interleave]) != 0][:n])
    prefix, k = np.zeros(n, np.int64), 1
    live = interleave
    while len(live):
        i, size = ta.sorted_groups(block[live])
        several = np.repeat(size > 1, size)
        live = live[several]
        prefix[live] = np.minimum(k, depth[live])
        if not (depth[live] > k).any():
            break
        # 0 stands for a suffix whose labels end here
        label = np.where(depth[live] > k, labels[np.minimum(at[live] + k - 1, max(len(labels) - 1, 0))].astype(np.int64) + 1, 0)
        order = np.lexsort((label, block[live]))
        live, label = live[order], label[order]
        new = np.r_[True, (np.diff(block[live]) != 0) | (np.diff(label) != 0)][: len(live)]
        block[live] = n * (k + 1) + np.cumsum(new)
        k += 1
    return block, prefix


def _merge(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    parts = [an._unpacked_sorted(r["first"], np.uint64) for r in rows]
    first = np.concatenate(parts)
    depth, labels = ta.joined((r["depth"] for r in rows), np.uint16).astype(np.int64), ta.joined((r["labels"] for r in rows), np.uint32)
    around, many = ta.joined((r["around"] for r in rows), np.uint64), ta.joined((r["many"] for r in rows), np.uint8)
    doc, at = ta.joined((r["doc"] for r in rows), np.int64), ta.joined((r["at"] for r in rows), np.uint32)
    block, prefix = refine(first, depth, labels)
    keep = prefix >= depth
    alone = ~keep & (many > 0)  # folded copies that no other shard has: the shard has settled them
    keep &= ~alone
    block, around, many, doc, at = block[keep], around[keep], many[keep], doc[keep], at[keep]
    order = np.lexsort((at, doc, around, block))
    block, around, many, doc, at = block[order], around[order], many[order], doc[order], at[order]
    b, size = ta.sorted_groups(block)
    kinds = np.r_[True, (np.diff(block) != 0) | (np.diff(around.view(np.int64)) != 0)][: len(block)]
    k = np.flatnonzero(kinds)
    k_size = np.diff(np.r_[k, len(block)])
    copies = np.repeat((k_size > 1) | (np.maximum.reduceat(many, k) > 0 if len(k) else k_size > 1), k_size)
    differ = np.repeat(np.add.reduceat(kinds.astype(np.int64), b) > 1 if len(b) else size > 1, size)
    kind = CERTAIN * copies + SEND * (differ & kinds)
    told = kind > 0
    run_doc, run_at, run_n = ta.joined((r["run_doc"] for r in rows), np.int64), ta.joined((r["run_at"] for r in rows), np.uint32), ta.joined((r["run_n"] for r in rows), np.uint32)
    return pa.table({"doc_id": np.r_[doc[told], run_doc], "at": np.r_[at[told], run_at].astype(np.int32), "n": np.r_[np.ones(told.sum(), np.int32), run_n.astype(np.int32)], "kind": np.r_[kind[told], np.full(len(run_doc), CERTAIN)].astype(np.int32)})


def _told(column: pa.Array, chunks: Chunks) -> np.ndarray:
    """The kinds that a batch's marks column gives its chunk starts."""
    row, first, last = an.mark_spans(column)
    kind = column.flatten().field("kind").to_numpy(zero_copy_only=False).astype(np.int64)
    base = np.searchsorted(chunks.text, np.arange(len(column)))
    out = np.zeros(len(chunks.starts) + 1, np.int64)
    for bit in (CERTAIN, SEND):
        hit = (kind & bit) > 0
        out[:-1] |= bit * ta.covered(base[row][hit] + first[hit], base[row][hit] + last[hit], len(chunks.starts))
    return out[:-1]


def suffix_dedup(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts without the bytes that any string of `length` bytes covers which stands more than once.

    Texts are UTF-8 bytes; strings lie within one text, overlaps count, and the places of a repeat may be in one text
    or in several. All places go. Returns doc_id, data (the kept bytes), n_bytes, n_removed, spans (array of
    [first, last + 1) byte spans that went, maximal). A null text is empty. Rows with a null id are left out; of several
    rows with one id the smallest text stands for it. Other columns are not looked at. length is at least SHORTEST.
    """
    if length < SHORTEST:
        raise ValueError(f"length must be at least {SHORTEST}")

    def counted(batches):
        for piece in (p for b in batches for p in ta.pieces([b], PIECE)):
            c = Chunks(piece.column("text"), length)
            h = c.spans.hashes(c.starts, c.ends)[c.whole]
            ids = piece.column("doc_id").to_numpy().astype(np.int64)
            yield h, h, ids[c.text[c.whole]], c.number[c.whole]

    def order(batches, buckets):
        held = []

        def shard():
            parts = [np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True)]
            flat = np.concatenate([h[1] for h in held])
            held.clear()
            chunk, second, depth, whole, around, doc, at = parts
            bucket = (second % np.uint64(buckets)).astype(np.int32)
            start = np.r_[0, np.cumsum(depth - 1)][:-1]
            # the shard's own order; equal suffixes with equal surroundings fold
            o = np.lexsort((at, doc, around, whole, chunk, bucket))
            new = np.r_[True, (np.diff(bucket[o]) != 0) | (np.diff(chunk[o].view(np.int64)) != 0) | (np.diff(whole[o].view(np.int64)) != 0) | (np.diff(around[o].view(np.int64)) != 0)]
            i = np.flatnonzero(new)
            size = np.diff(np.r_[i, len(o)])
            copies = o[np.repeat(size > 1, size)]
            copies = copies[np.lexsort((at[copies], doc[copies]))]
            lead = o[i]
            n = depth[lead] - 1
            labels = flat[np.repeat(start[lead], n) + ta.within(n)]
            return _packed({"bucket": bucket[lead], "first": chunk[lead], "depth": depth[lead], "around": around[lead], "many": size > 1, "doc": doc[lead], "at": at[lead]}, labels, ta.runs(doc[copies], at[copies]), buckets)

        for piece in (p for b in batches for p in ta.pieces([b], PIECE)):
            c = Chunks(piece.column("text"), length)
            row, first, last = an.mark_spans(piece.column("marks"))
            base = np.searchsorted(c.text, np.arange(len(piece) + 1))
            # hits of another row of the id may lie beyond this text
            live = ta.covered(*(np.minimum(base[row] + x, base[row + 1]) for x in (first, last)), len(c.starts))
            depth, (low, high) = c.depth(), c.windows()
            dead = np.r_[0, np.cumsum(~live)]
            i = np.arange(len(c.starts))
            take = np.flatnonzero((low <= high) & (dead[i + np.maximum(depth, 0)] == dead[i]) & (depth > 0))
            depth = depth[take]
            labels = c.spans.hashes(c.starts, c.ends)
            flat = (labels[np.repeat(take + 1, depth - 1) + ta.within(depth - 1)] >> np.uint64(32)).astype(np.uint32)
            start, text = c.starts[take], c.text[take]
            a = np.maximum(start - 2 * WINNOW + 2, c.offsets[text])
            b = np.minimum(start - WINNOW + 1 + length, c.offsets[text + 1])
            around = ta.mix(c.spans.hashes(a, b) + (start - a).astype(np.uint64))
            ids = piece.column("doc_id").to_numpy().astype(np.int64)
            held.append(((labels[take], c.spans.hashes(start, c.ends[take], 1), depth, c.spans.hashes(start, c.starts[take + depth]), around, ids[text], c.number[take]), flat))
            if sum(len(h[0][0]) for h in held) >= SHARD:
                yield shard()
        if sum(len(h[0][0]) for h in held):
            yield shard()

    def single(batches):
        for piece in (p for b in batches for p in ta.pieces([b], PIECE)):
            c = Chunks(piece.column("text"), length)
            low, high = c.windows()
            n = np.where((_told(piece.column("marks"), c) & SEND) > 0, np.maximum(high - low + 1, 0), 0)
            s = np.repeat(low, n) + ta.within(n)
            text = np.repeat(c.text, n)
            ids = piece.column("doc_id").to_numpy().astype(np.int64)
            yield c.spans.hashes(s, s + length), c.spans.hashes(s, s + length, 1), ids[text], s - c.offsets[text]

    def cut(batches):
        for piece in (p for b in batches for p in ta.pieces([b], PIECE)):
            c = Chunks(piece.column("text"), length)
            low, high = c.windows()
            sure = (_told(piece.column("marks"), c) & CERTAIN) > 0
            row, first, last = an.mark_spans(piece.column("windows"))
            at = c.offsets[row]
            gone = ta.covered(np.r_[low[sure], at + first], np.r_[high[sure] + length, at + last - 1 + length], len(c.data))
            stay = np.r_[0, np.cumsum(~gone)][c.offsets]
            raw = c.data[~gone].tobytes()
            text = np.repeat(np.arange(len(piece)), np.diff(c.offsets))[gone]
            span_row, a, b = ta.runs(text, np.flatnonzero(gone))
            spans = pa.ListArray.from_arrays(np.searchsorted(span_row, np.arange(len(piece) + 1)).astype(np.int32), pa.StructArray.from_arrays([pa.array(a - c.offsets[span_row]), pa.array(b - c.offsets[span_row])], ["first", "last"]))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([raw[i:j] for i, j in zip(stay[:-1].tolist(), stay[1:].tolist(), strict=True)], pa.binary()), pa.array(np.diff(c.offsets)), pa.array(np.bincount(text, minlength=len(piece)).astype(np.int64)), spans], ["doc_id", "data", "n_bytes", "n_removed", "spans"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    buckets = an.bucket_count(docs)
    texts = an.one_text_each(docs, id_col, text_col)
    live = an.by_document(an.repeated_references(plain, counted))
    ordered = texts.join(live, "doc_id").mapInArrow(lambda batches: order(batches, buckets), "bucket int, " + ", ".join(f"{k} binary" for k in PACKED))
    merged = ordered.groupBy("bucket").applyInArrow(_merge, "doc_id long, at int, n int, kind int")
    marked = texts.join(merged.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", "kind")).alias("marks")), "doc_id", "left")
    sent = marked.where(f"exists(marks, m -> m.kind >= {SEND})")
    windows = an.by_document(an.repeated_spans(sent, single, earlier_stays=False)).withColumnRenamed("marks", "windows")
    return marked.join(windows, "doc_id", "left").mapInArrow(cut, "doc_id long, data binary, n_bytes long, n_removed long, spans array<struct<first:long,last:long>>")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for all documents, strings of 400 bytes."""
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("data", 256).alias("kept_sha256"))
