"""Document quality by nearest-neighbour voting in a latent semantic space.

Documents become weighted bags of hashed terms: words, the shapes of words (case, digits, marks), pairs of neighbouring
shapes and words that repeat the one before, weighted by how rare they are among all documents. A bounded sample of labelled documents is turned into a term matrix, and
its truncated singular value decomposition gives the latent space. The labelled vectors are broadcast (at most
2 x SAMPLE x DIMENSIONS floats); every document is compared with all of them in blocks, and its nearest ones vote,
weighted by their cosine and by how many labels of their class each of the sample stands for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta

#: Labelled documents of each class that are learned from, at most.
SAMPLE = 1500
WORD_TERMS, SHAPE_TERMS = 2048, 2048
DIMENSIONS = 48
NEIGHBOURS = 25
#: Bytes and rows of a piece; each row has a count for each term.
PIECE, ROWS = 1_500_000, 512
#: How much the natural share of label 1 counts beside the neighbours.
PRIOR_WEIGHT = 0.5
WORD, SHAPE, PAIR = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def _classes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("a") : ord("z") + 1] = ord("a")
    table[0x80:] = ord("a")
    table[ord("A") : ord("Z") + 1] = ord("A")
    table[ord("0") : ord("9") + 1] = ord("0")
    return table


CLASSES = _classes()


def term_counts(column: pa.Array) -> np.ndarray:
    """Logarithmic counts of the terms of each text: n x (WORD_TERMS + SHAPE_TERMS)."""
    data, offsets = ta.text_bytes(column)
    n = len(column)
    starts, ends, bounds = ta.word_spans(data, offsets)
    text = np.repeat(np.arange(n), np.diff(bounds))
    words = ta.span_hashes(ta.BYTE_VALUES[data], starts, ends, WORD)
    # a shape keeps one byte of each run of letters or digits, and up to three of a run of marks
    shape = CLASSES[data]
    same = np.r_[False, shape[1:] == shape[:-1]]
    third = np.r_[[False] * 3, same[3:] & same[2:-1] & same[1:-2]] if len(data) > 3 else np.zeros(len(data), bool)
    letters = (shape == ord("a")) | (shape == ord("A")) | (shape == ord("0"))
    keep = ~same | ~letters & ~third
    keep[starts] = True
    place = np.r_[0, np.cumsum(keep)]
    shapes = ta.span_hashes(ta.BYTE_VALUES[shape[keep]], place[starts], place[ends], SHAPE)
    inner = np.flatnonzero(np.diff(text) == 0)
    pairs = ta.mix(shapes[inner] * np.uint64(PAIR) + shapes[inner + 1])
    again = inner[words[inner] == words[inner + 1]]
    terms = lambda rows, h, size, at: np.bincount(rows * size + (h % np.uint64(size)).astype(np.int64), minlength=at * size)[: at * size].reshape(at, size)
    shaped = terms(text, shapes, SHAPE_TERMS - 1, n) + terms(text[inner], pairs, SHAPE_TERMS - 1, n)
    repeats = np.bincount(text[again], minlength=n)[:, None]
    return np.log1p(np.hstack([terms(text, words, WORD_TERMS, n), shaped, repeats]).astype(np.float32))


class LatentSpace:
    """Term weights, axes and labelled vectors, as fitted on a sample."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, prior: float, votes: np.ndarray, weights: np.ndarray):
        """votes: what a label 0 and a label 1 of the sample count, each for its class's share of all labels; weights: of terms.

        counts is overwritten.
        """
        self.prior, self.labels, self.votes = prior, labels.astype(np.float32), votes[labels.astype(np.int64)]
        self.weights = weights
        x = self.weighted(counts, counts)
        rng = np.random.default_rng(9)
        k = min(DIMENSIONS, *x.shape)
        # subspace iteration for the leading singular vectors
        start = rng.standard_normal((x.shape[1], min(k + 16, x.shape[1]))).astype(np.float32)
        basis = np.linalg.qr(x.T @ (x @ start))[0]
        for _ in range(4):
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        self.axes = (basis @ np.linalg.svd(x @ basis, full_matrices=False)[2].T[:, :k]).astype(np.float32)
        self.vectors = self.unit(x @ self.axes)

    def weighted(self, counts: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """tf-idf, words and shapes each of length one, so that neither drowns the other."""
        x = np.multiply(counts, self.weights, out=out)
        for part, share in ((slice(0, WORD_TERMS), 0.5), (slice(WORD_TERMS, None), 1.0)):
            for at in range(0, len(x), ROWS):
                strip = x[at : at + ROWS, part]
                strip[:] = share * self.unit(strip)
        return x

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among the nearest labelled vectors of each row."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        cosine = self.unit(self.weighted(counts) @ self.axes) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** 4 * self.votes[near]
        return (((weight * self.labels[near]).sum(1) + PRIOR_WEIGHT * self.prior) / (weight.sum(1) + PRIOR_WEIGHT)).clip(0, 1)


def held_out(doc_id="doc_id"):
    """Rows whose labels nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def term_weights(docs: DataFrame) -> np.ndarray:
    """The inverse document frequency of each term over all of docs: a row for each term and task is summed."""
    size = WORD_TERMS + SHAPE_TERMS

    def presence(batches):
        seen = np.zeros(size + 1, np.int64)
        for piece in (p for b in batches for p in ta.pieces([b], PIECE, rows=ROWS)):
            seen[:size] += (term_counts(piece.column("text")) > 0).sum(0)
            seen[size] += len(piece)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1, dtype=np.int32)), pa.array(seen)], ["term", "n"])

    total = np.zeros(size + 1, np.int64)
    for r in docs.select("text").mapInArrow(presence, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        total[r.term] = r.n
    return np.log((1 + total[size]) / (1 + total[:size])).astype(np.float32) + np.float32(0.1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LatentSpace:
    """Learns from up to sample labelled documents of each class, taken by a hash of their id.

    A class above the bound is thinned, so each of its votes counts as many times more: scores follow the natural mix of
    all labels, whether the bound is reached or not.

    docs: doc_id, text; labels: doc_id, quality (0 or 1; other values and nulls aren't used, of a repeated id the
    smallest label and the smallest text count). Only the terms of the sample reach the driver, those that a text has: at
    most 2 x sample rows, whatever rows share an id.
    """
    known = labels.where(~held_out()).where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    shares = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    picked = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def count(batches):
        for piece in (p for b in batches for p in ta.pieces([b], PIECE, rows=ROWS)):
            terms = term_counts(piece.column("text"))
            held = [np.flatnonzero(x) for x in terms]
            places, counts = [i.astype(np.int16).tobytes() for i in held], [x[i].tobytes() for x, i in zip(terms, held, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("quality"), pa.array(places, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "quality", "places", "terms"])

    rows = sorted(chosen.mapInArrow(count, "doc_id long, quality int, places binary, terms binary").collect(), key=lambda r: (r.doc_id, bytes(r.places), bytes(r.terms)))
    counts = np.zeros((len(rows), WORD_TERMS + SHAPE_TERMS), np.float32)
    for x, r in zip(counts, rows, strict=True):
        x[np.frombuffer(r.places, np.int16)] = np.frombuffer(r.terms, np.float32)
    total = sum(shares.values())
    # a class's share of all labels over its share of the sample
    drawn = {q: min(n, sample) for q, n in shares.items()}
    votes = np.array([shares[q] / drawn[q] * sum(drawn.values()) / total if drawn.get(q) else 1.0 for q in (0, 1)])
    return LatentSpace(counts, np.array([r.quality for r in rows]), shares.get(1, 0) / total if total else 0.5, votes, term_weights(docs))


def quality_scores(docs: DataFrame, model: LatentSpace) -> DataFrame:
    """(doc_id, ..., score) with docs's columns: how likely label 1 is, from the whole text alone.

    A null, empty or blank text has no terms and no direction: its score is the share of label 1 among the labels (0.5
    without any). Repeated rows are scored alike; a column score in docs is replaced.
    """
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        space = shared.value
        for batch in batches:
            found = [space.scores(term_counts(p.column("text"))) for p in ta.pieces([batch], PIECE, rows=ROWS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else np.zeros(0))], [*batch.schema.names, "score"])

    return docs.mapInArrow(score, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality_scores(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
