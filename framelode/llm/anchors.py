"""Finding equal spans across documents: hashes dealt into buckets, counted there, marks sent back by document.

A task hashes its documents' spans, folds the equal ones of its batch together and packs the rest, sorted, one row
for each bucket of the hash. So a span that a third of all documents share is one entry for each batch, not one for
each copy, and every bucket gets an even share of the hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta

#: Spans that a task gathers before it packs them.
FLUSH = 3_000_000
LOW = np.uint64(32)

MARKS = "doc_id long, at int, n int"


def bucket_count(df: DataFrame) -> int:
    """Hash buckets: four for each shuffle partition, so they grow with the cluster's own setting."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    at, n = ta.sorted_groups(bucket)
    for i, k in zip(at.tolist(), n.tolist(), strict=True):
        yield int(bucket[i]), slice(i, i + k)


def _packed_sorted(values: np.ndarray) -> bytes:
    return ta.planes(np.diff(values, prepend=values[:1] * 0))


def _unpacked_sorted(raw: bytes, dtype) -> np.ndarray:
    return np.cumsum(ta.unplanes(raw, dtype), dtype=dtype)


def _marks(doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.Table:
    return pa.table({"doc_id": doc.astype(np.int64), "at": at.astype(np.int32), "n": n.astype(np.int32)})


def repeated_references(df: DataFrame, hashed: Callable, buckets: int | None = None) -> DataFrame:
    """Reference spans whose content also stands elsewhere: (doc_id, at, n), runs of reference numbers.

    hashed(batches) yields (probes, references, doc, number): the 64-bit hashes of all rolling windows, those of the
    reference blocks (each also among the probes), and each block's doc_id and number in its document. A block is
    named if at least two windows have its hash. 32 bits of the hash and the bucket's number are compared, so a false
    hit is possible and a missed one is not; callers verify.
    """
    buckets = buckets or bucket_count(df)

    def deal(batches):
        held: list[tuple] = []

        def packed():
            probe, ref, doc, no = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            key = lambda h: ((h >> LOW) % np.uint64(buckets)) << LOW | h & np.uint64(0xFFFFFFFF)
            probe = key(probe)
            probe.sort()
            at, n = ta.sorted_groups(probe)
            probe, many = probe[at], (n > 1).astype(np.uint8)
            ref = key(ref)
            order = np.argsort(ref)
            ref, doc, no = ref[order], doc[order], no[order].astype(np.uint32)
            rank = np.searchsorted(probe, ref)
            cut = np.searchsorted(ref >> LOW, np.arange(buckets + 1, dtype=np.uint64))
            rows = [(b, _packed_sorted((probe[s] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), np.packbits(many[s]).tobytes(), _packed_sorted((rank[r := slice(cut[b], cut[b + 1])] - s.start).astype(np.uint32)), ta.planes(doc[r]), ta.planes(no[r])) for b, s in _by_bucket((probe >> LOW).astype(np.int64))]
            yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "probe", "many", "rank", "doc", "no"), r, strict=True)) for r in rows], schema)

        for x in hashed(batches):
            held.append(x)
            if sum(len(y[0]) for y in held) >= FLUSH:
                yield from packed()
        if sum(len(y[0]) for y in held):
            yield from packed()

    schema = pa.schema([("bucket", pa.int32()), *((k, pa.binary()) for k in ("probe", "many", "rank", "doc", "no"))])

    def probe(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [_unpacked_sorted(r["probe"], np.uint32) for r in rows]
        hashes = np.concatenate(parts)
        many = np.concatenate([np.unpackbits(np.frombuffer(r["many"], np.uint8), count=len(p)) for r, p in zip(rows, parts, strict=True)])
        ranks = np.concatenate([_unpacked_sorted(r["rank"], np.uint32).astype(np.int64) + base for r, base in zip(rows, np.cumsum([0, *map(len, parts)]), strict=False)])
        doc, no = ta.joined((r["doc"] for r in rows), np.int64), ta.joined((r["no"] for r in rows), np.uint32)
        order = np.argsort(hashes)
        ordered = hashes[order]
        at, n = ta.sorted_groups(ordered)
        twice = np.empty(len(hashes), bool)
        twice[order] = np.repeat((n > 1) | (np.maximum.reduceat(many[order], at) > 0), n)
        hit = twice[ranks]
        return _marks(doc[hit], no[hit], np.ones(hit.sum(), np.uint32))

    return df.mapInArrow(deal, "bucket int, probe binary, many binary, rank binary, doc binary, no binary").groupBy("bucket").applyInArrow(probe, MARKS)


def repeated_spans(df: DataFrame, hashed: Callable, earlier_stays: bool, buckets: int | None = None) -> DataFrame:
    """Spans whose content also stands elsewhere: (doc_id, at, n), runs of span starts.

    hashed(batches) yields (hash, second, doc, at) arrays: two independent 64-bit hashes of each span, its doc_id and
    start. The whole first hash and the bucket, taken from the second, are compared. earlier_stays: the span with the
    smallest (doc_id, start) isn't named; else all are.
    """
    buckets = buckets or bucket_count(df)
    fields = ("hash", "doc", "at", "many", "run_doc", "run_at", "run_n")
    schema = pa.schema([("bucket", pa.int32()), *((k, pa.binary()) for k in fields)])

    def deal(batches):
        held: list[tuple] = []

        def packed():
            h, second, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            b = (second % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((at, doc, h, b))
            h, doc, at, b = h[order], doc[order], at[order].astype(np.uint32), b[order]
            first = np.r_[True, (h[1:] != h[:-1]) | (b[1:] != b[:-1])]
            i = np.flatnonzero(first)
            many = (np.diff(np.r_[i, len(h)]) > 1).astype(np.uint8)
            known = ~first if earlier_stays else np.repeat(many > 0, np.diff(np.r_[i, len(h)]))
            o = np.lexsort((at[known], doc[known]))
            run_doc, run_at, run_to = ta.runs(doc[known][o], at[known][o].astype(np.int64))
            h, doc, at, b = h[first], doc[first], at[first], b[first]
            rows = {k: dict.fromkeys(fields, b"") | {"hash": _packed_sorted(h[s]), "doc": ta.planes(doc[s]), "at": ta.planes(at[s]), "many": np.packbits(many[s]).tobytes()} for k, s in _by_bucket(b)}
            home = (run_doc % buckets).astype(np.int32)
            o = np.argsort(home, kind="stable")
            for k, s in _by_bucket(home[o]):
                rows.setdefault(k, dict.fromkeys(fields, b"")).update({"run_doc": ta.planes(run_doc[o[s]]), "run_at": ta.planes(run_at[o[s]].astype(np.uint32)), "run_n": ta.planes((run_to - run_at)[o[s]].astype(np.uint32))})
            yield pa.RecordBatch.from_pylist([{"bucket": k, **r} for k, r in rows.items()], schema)

        for x in hashed(batches):
            held.append(x)
            if sum(len(y[0]) for y in held) >= FLUSH:
                yield from packed()
        if sum(len(y[0]) for y in held):
            yield from packed()

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [_unpacked_sorted(r["hash"], np.uint64) for r in rows]
        h = np.concatenate(parts)
        many = np.concatenate([np.unpackbits(np.frombuffer(r["many"], np.uint8), count=len(p)) for r, p in zip(rows, parts, strict=True)])
        doc, at = ta.joined((r["doc"] for r in rows), np.int64), ta.joined((r["at"] for r in rows), np.uint32)
        order = np.lexsort((at, doc, h))
        h, doc, at, many = h[order], doc[order], at[order], many[order]
        i, n = ta.sorted_groups(h)
        if earlier_stays:
            hit = np.ones(len(h), bool)
            hit[i] = False
        else:  # where one batch had it twice, that batch has named its own
            hit = np.repeat(n > 1, n) & (many == 0)
        run_doc, run_at, run_n = ta.joined((r["run_doc"] for r in rows), np.int64), ta.joined((r["run_at"] for r in rows), np.uint32), ta.joined((r["run_n"] for r in rows), np.uint32)
        return _marks(np.r_[doc[hit], run_doc], np.r_[at[hit], run_at], np.r_[np.ones(hit.sum(), np.uint32), run_n])

    return df.mapInArrow(deal, "bucket int, " + ", ".join(f"{k} binary" for k in fields)).groupBy("bucket").applyInArrow(meet, MARKS)


def by_document(marks: DataFrame) -> DataFrame:
    """One row for each document that has marks: doc_id, marks (an array of <at, n>)."""
    return marks.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("marks"))


def mark_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last + 1) of every run in a batch's marks column; rows without marks have none."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    at, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("at", "n"))
    return np.repeat(np.arange(len(column)), size), at, at + n


def one_text_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with one row for each id: of repeated ids the smallest text, null ids left out."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return ids.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text"))
