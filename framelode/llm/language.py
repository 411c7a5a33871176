"""Language of code-switched text: a linear-chain conditional random field over words.

A word's label potentials are sums of learned weights: hashed affixes (two and three bytes at either end), hashed
character n-grams (pairs and triples of bytes, with the word's edges) and a lexicon of frequent words. Transitions
between the labels of neighbouring words are learned with them, by gradient ascent on the conditional likelihood of a
bounded sample; spliced documents show the field where languages change. Forward-backward labels every word of every
document; a document's language is the one with the largest share of its words.

A text longer than a piece is read in pieces, twice: first each piece becomes a transfer matrix, then the messages that
these pass on enter and leave the pieces, so the whole text is one chain and no task holds more than a piece of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import crf
from . import textarrays as ta

#: Documents of each language that are learned from, at most, and the bytes after which no further one is taken.
SAMPLE, SAMPLE_BYTES = 200, 1 << 20
#: Languages at most (0.3 MB of weights each), and those that get the whole of SAMPLE_BYTES.
MOST_LANGS, SAMPLE_LANGS = 400, 16
FEATURES = 1 << 15
LEXICON = 1000
EPOCHS = 4
#: Bytes of text that a task labels at a time.
PIECE = 200_000
WORD = 0xD6E8FEB86659FD93
#: ASCII bytes that are no letters part words.
GAP = ta.byte_class(b for b in range(128) if not chr(b).isalpha())
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Words:
    """The words of a batch of texts, and the feature numbers of each different one."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = FOLD[data]
        starts, ends, self.bounds = ta.word_spans(data, offsets, GAP)
        self.starts = starts
        self.hashes, once, self.which = np.unique(ta.span_hashes(ta.BYTE_VALUES[data], starts, ends, WORD), return_index=True, return_inverse=True)
        starts, size = starts[once], (ends - starts)[once]
        # word bytes only, each word between two zero bytes
        first = np.cumsum(np.r_[0, size[:-1] + 2]) if len(size) else np.zeros(0, np.int64)
        self.flat = np.zeros(int(size.sum()) + 2 * len(size), np.int64)
        inside = ta.within(size)
        self.flat[np.repeat(first + 1, size) + inside] = data[np.repeat(starts, size) + inside]
        self.first, self.last = first, first + size + 1

    def bytes_features(self) -> list[np.ndarray]:
        """A feature for each byte and n-gram length; words are contiguous, from first on."""
        b = self.flat
        after = np.r_[b[1:], 0]
        two = b << 8 | after
        three = two << 8 | np.r_[after[1:], 0]
        # what stands behind a word's closing edge is no part of it
        two[self.last] = three[self.last] = 0
        return [self.hashed(two, 1), self.hashed(three, 2)]

    def word_features(self) -> list[np.ndarray]:
        """A feature for each different word and affix."""
        b, i, j = self.flat, self.first, self.last
        head = b[i + 1] << 8 | b[i + 2] if len(i) else i
        tail = b[j - 1] << 8 | b[j - 2] if len(i) else i
        third = (b[np.minimum(i + 3, j)], b[np.maximum(j - 3, i)]) if len(i) else (i, i)
        return [self.hashed(head, 3), self.hashed(head << 8 | third[0], 4), self.hashed(tail, 5), self.hashed(tail << 8 | third[1], 6)]

    @staticmethod
    def hashed(code: np.ndarray, kind: int) -> np.ndarray:
        return (ta.mix(code.astype(np.uint64) * np.uint64(16) + np.uint64(kind)) % np.uint64(FEATURES)).astype(np.int64)


class Field:
    """Weights of the features, the lexicon and the transitions."""

    def __init__(self, langs: list[str]):
        k = len(langs)
        self.langs, self.weights, self.transitions = langs, np.zeros((FEATURES, k), np.float32), np.zeros((k, k))
        self.lexicon, self.lexicon_weights = np.zeros(0, np.uint64), np.zeros((1, k), np.float32)

    def entry(self, words: Words) -> np.ndarray:
        """The lexicon entry of each different word; words outside it have the last, which stays zero."""
        at = np.searchsorted(self.lexicon, words.hashes)
        known = at < len(self.lexicon)
        known[known] = self.lexicon[at[known]] == words.hashes[known]
        return np.where(known, at, len(self.lexicon))

    def emissions(self, words: Words) -> np.ndarray:
        k = len(self.langs)
        if not len(words.first):
            return np.zeros((0, k))
        total = sum(self.weights[f] for f in words.bytes_features())
        out = np.add.reduceat(total, words.first, axis=0).astype(np.float64)
        for f in words.word_features():
            out += self.weights[f]
        return (out + self.lexicon_weights[self.entry(words)])[words.which]

    def learn(self, texts: list[bytes], labels: list[int]) -> Field:
        """Gradient ascent over a shuffled sample, steps scaled by past gradients."""
        k, rng = len(self.langs), np.random.default_rng(10)
        if k < 2 or not texts:
            return self
        rows = [w.hashes[w.which] for w in (Words(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts)]
        hashes, of = np.concatenate(rows), np.repeat(labels, [len(r) for r in rows])
        frequent = [h[np.argsort(-c, kind="stable")[:LEXICON]] for h, c in (np.unique(hashes[of == i], return_counts=True) for i in range(k))]
        self.lexicon = np.unique(np.concatenate(frequent))
        self.lexicon_weights = np.zeros((len(self.lexicon) + 1, k), np.float32)
        seen = [np.full_like(w, 1e-6, np.float64) for w in (self.weights, self.lexicon_weights, self.transitions)]
        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), 16):
                self._ascend(*self._spliced([texts[i] for i in order[at : at + 16]], [labels[i] for i in order[at : at + 16]], rng), seen)
        return self

    @staticmethod
    def _spliced(texts: list[bytes], labels: list[int], rng):
        """One sequence that takes turns with the texts, some words of each at a time, and each word's label."""
        parts, owner, i = [], [], 0
        cut = [t.split() for t in texts]
        places = [0] * len(cut)
        while any(p < len(c) for p, c in zip(places, cut, strict=True)):
            i = int(rng.integers(len(cut)))
            n = int(rng.geometric(1 / 20))
            take = cut[i][places[i] : places[i] + n]
            places[i] += n
            parts += take
            owner += [labels[i]] * len(take)
        return b" ".join(parts), np.array(owner), np.array([len(p) for p in parts])

    def _ascend(self, text: bytes, owner: np.ndarray, sizes: np.ndarray, seen: list[np.ndarray], rate: float = 0.3) -> None:
        words = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        if not len(words.first):
            return
        k = len(self.langs)
        # a whitespace token may hold several words, or none
        label = owner[np.searchsorted(np.cumsum(sizes + 1), words.starts, "right")]
        gamma, pairs = crf.posteriors(self.emissions(words), words.bounds, self.transitions)
        error = -gamma
        error[np.arange(len(label)), label] += 1
        error = np.stack([np.bincount(words.which, error[:, c], len(words.first)) for c in range(k)], 1)
        share = np.repeat(error, words.last - words.first + 1, axis=0)
        gradient = np.zeros((FEATURES, k))
        for c in range(k):
            for f in words.bytes_features():
                gradient[:, c] += np.bincount(f, share[:, c], FEATURES)
            for f in words.word_features():
                gradient[:, c] += np.bincount(f, error[:, c], FEATURES)
        entry = self.entry(words)
        lexicon = np.stack([np.bincount(entry, error[:, c], len(self.lexicon) + 1) for c in range(k)], 1)
        lexicon[-1] = 0
        steps = -pairs
        np.add.at(steps, (np.r_[label[0], label[:-1]], label), 1.0)
        for weight, g, past in ((self.weights, gradient, seen[0]), (self.lexicon_weights, lexicon, seen[1]), (self.transitions, steps, seen[2])):
            g = g - 0.01 * weight
            past += g * g
            weight += rate * g / np.sqrt(past)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and share of each text of a batch."""
        n, k = len(column), len(self.langs)
        if not k:
            return ["und"] * n, np.zeros(n)
        data, offsets = ta.text_bytes(column)
        if n == 1 and len(data) > PIECE:
            share = self.long_shares(data)[None]
        else:
            words = Words(data, offsets)
            texts = np.repeat(np.arange(n), np.diff(words.bounds))
            gamma, _ = crf.posteriors(self.emissions(words), words.bounds, self.transitions, counts=False)
            share = np.stack([np.bincount(texts, gamma[:, c], n) for c in range(k)], 1)
        total = share.sum(1)
        part = share / np.maximum(total, 1e-12)[:, None]
        # languages that are alike to nine digits tie, and the first by name is taken
        best, score = part.round(9).argmax(1), part.max(1)
        # texts without an ASCII letter may still be without any: digits, dashes, pictures
        letters = np.r_[0, np.cumsum((FOLD[data] >= 97) & (FOLD[data] <= 122), dtype=np.int32)]
        plain = letters[offsets[1:]] > letters[offsets[:-1]]
        fine = np.array([p or any(c.isalpha() for c in bytes(data[a:b]).decode("utf-8", "replace")) for p, a, b in zip(plain, offsets[:-1], offsets[1:], strict=True)], bool) & (total > 0)
        return [self.langs[b] if f else "und" for b, f in zip(best, fine, strict=True)], np.where(fine, score, 0.0).clip(0, 1)

    def long_shares(self, data: np.ndarray) -> np.ndarray:
        """The expected number of words of each language in one text, read in pieces that end between words."""
        k = len(self.langs)
        parts, at = [], 0
        while at < len(data):
            to = min(at + PIECE, len(data))
            gaps = np.flatnonzero(GAP[data[at:to]])
            # a word longer than a piece is cut
            to = at + int(gaps[-1]) + 1 if to < len(data) and len(gaps) else to
            parts.append(data[at:to])
            at = to
        steps = [crf.transfer(self.emissions(Words(p, np.array([0, len(p)]))), self.transitions) for p in parts]
        enter, leave = [np.full(k, 1 / k)], [np.ones(k)]
        for m in steps[:-1]:
            enter.append((x := enter[-1] @ m) / x.sum())
        for m in steps[:0:-1]:
            leave.append((x := m @ leave[-1]) / x.sum())
        share = np.zeros(k)
        for part, before, after in zip(parts, enter, leave[::-1], strict=True):
            words = Words(part, np.array([0, len(part)]))
            share += crf.posteriors(self.emissions(words), words.bounds, self.transitions, False, before[None], after[None])[0].sum(0)
        return share


def held_out():
    """Rows that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Field:
    """Learns from up to sample documents of each language (doc_id, text, lang), taken by a hash of their id.

    After the one that reaches sample_bytes no further document of a language is taken, and none that is larger than
    that by itself; with more than SAMPLE_LANGS languages each one's share of bytes is less. Rows with a null lang, id or
    text, and held-out rows, aren't used; of rows that share id and language the shortest text counts (the smallest of
    equally long ones). Every value of lang with such a document is learned, up to MOST_LANGS; more raise. Tasks limit
    each language to its sample before the shuffle; only the sample's texts go to the driver: at most 2 x sample_bytes a
    language, and never more than those of SAMPLE_LANGS.
    """
    named = docs.where(~held_out()).where("doc_id IS NOT NULL AND lang IS NOT NULL")
    known = named.where("text IS NOT NULL").select("doc_id", "lang", F.octet_length("text").alias("size"), "text")
    n = named.select("lang").distinct().limit(MOST_LANGS + 1).count()
    if n > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    sample_bytes = sample_bytes * min(n, SAMPLE_LANGS) // max(n, 1)
    short = known.where(F.col("size") <= sample_bytes)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = short.groupBy("doc_id", "lang").agg(F.min("size").alias("size")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)
    picked = picked.withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))).where(F.coalesce("before", F.lit(0)) < sample_bytes)
    ids = F.broadcast(picked.select("doc_id", "lang", "size"))  # sample x MOST_LANGS rows at most
    texts = short.join(ids, ["doc_id", "lang", "size"]).groupBy("doc_id", "lang").agg(F.min("text").cast("binary").alias("text"))
    rows = sorted(texts.collect(), key=lambda r: (r.doc_id, r.lang, bytes(r.text)))
    langs = sorted({r.lang for r in rows})
    rows = [r for r in rows if r.text]
    return Field(langs).learn([bytes(r.text) for r in rows], [langs.index(r.lang) for r in rows])


def languages(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs (doc_id, text), from the text alone.

    A null text, and one without a letter, is `und` with score 0; so is all if nothing was learned. Of tied languages
    the first by name is taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def label(batches):
        model = shared.value
        for batch in batches:
            for piece in ta.pieces([batch], PIECE):
                lang, score = model.predict(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(label, "doc_id long, lang_pred string, score double")


def op10_language(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return languages(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
