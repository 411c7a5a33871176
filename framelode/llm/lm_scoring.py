"""Scoring texts with a weighted backoff automaton whose counts cover the whole training corpus.

A state is a history of up to order - 1 tokens. An arc for a seen n-gram (h, w) carries its smoothed probability

    p(w | h) = (c(h, w) + s * p(w | shorter h)) / (c(h) + s)

and where no arc fits, the failure arc leads to the shorter history with the weight s / (c(h) + s); s is a strength
for each length of history. The empty history has (c(w) - discount) / N for the V known tokens and keeps what is
discounted, discount * V / N, for the one token "unknown". All distributions sum to one. Counts are those of the
training rows.

The automaton grows with the corpus, so no task holds it whole. Documents are dealt into shards of about SHARD_BYTES of
text, as many as the corpus needs. A shard sends the n-grams of its texts, folded and packed by hash bucket, with its
own training counts; a bucket adds the counts of all shards and answers each in its own order. With the answers a shard
builds the part of the automaton that its texts can visit: a table of states with their failure arcs, and one of arcs
by (state, token). One traversal reads all texts from left to right, a token of each at a step, and carries their
states: no arc means taking the failure arc and asking again. Long texts are read in runs of RUN tokens side by side; a
run first reads the order - 1 tokens before it, after which it is in the state that the run before has reached.

The packed cells are shards x buckets, so they grow with the square of the corpus in units of shard_bytes: raise that
with the executors' memory when the corpus has more than about 100,000 shards.

Texts move once: what the shards send and what they score is read from one exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .anchors import FLUSH

WORD = 0xD6E8FEB86659FD93
START, END = np.uint64(0x51A27), np.uint64(0xE2D)
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bits of a hash that are compared inside a bucket, with the one that marks single tokens; the bucket's number adds more
#: as the corpus grows.
BITS = np.uint64(44)
MASK = (np.uint64(1) << BITS) - np.uint64(1)
PIECE = 2_000_000
#: Text of a shard, and tokens that a run of a long text is read in.
SHARD_BYTES, RUN = 4_000_000, 512
#: How much a history of one token, of two and so on leans on the shorter one, in counts.
STRENGTHS = (256.0, 16.0)
#: What each known token gives to unknown ones, in counts.
DISCOUNT = 0.5
ROWS = "bucket int, shard int, grams binary, counts binary"


def tokens(column: pa.Array, size: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """For each text START, its word hashes and END; and where texts start (n + 1 values). Works size bytes at a time."""
    parts = [_tokens(p.column(0)) for p in ta.pieces([pa.RecordBatch.from_arrays([column], ["text"])], size)]
    ends = np.cumsum([0] + [len(s) for s, _ in parts])
    return np.concatenate([np.zeros(0, np.uint64), *(s for s, _ in parts)]), np.concatenate([*(at[:-1] + e for (_, at), e in zip(parts, ends, strict=False)), ends[-1:]])


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = ta.text_bytes(column)
    data = FOLD[data]
    starts, ends, bounds = ta.word_spans(data, offsets)
    words = ta.span_hashes(ta.BYTE_VALUES[data], starts, ends, WORD)
    n = np.diff(bounds)
    out = np.empty(len(words) + 2 * len(n), np.uint64)
    at = bounds + 2 * np.arange(len(n) + 1)
    out[at[:-1]], out[at[1:] - 1] = START, END
    out[np.repeat(at[:-1] + 1, n) + ta.within(n)] = words
    return out, at


def grams(sequence: np.ndarray, order: int) -> list[np.ndarray]:
    """Codes of the n-grams of 1 to order tokens that end at each place; the first places' longer ones are void."""
    out = [ta.mix(sequence + np.uint64(1))]
    for k in range(1, order):
        longer = np.zeros_like(sequence)
        longer[k:] = ta.mix(out[-1][k:] * np.uint64(0x9E3779B97F4A7C15) + sequence[:-k] + np.uint64(k + 1))
        out.append(longer)
    return out


def dealt(codes: np.ndarray, buckets: int, single: bool) -> np.ndarray:
    """Sortable keys: the bucket above BITS bits, of which the first says whether the n-gram is a single token, so that no
    longer one is ever taken for a token."""
    return ((codes >> BITS) % np.uint64(buckets)) << BITS | codes & (MASK >> np.uint64(1)) | np.uint64(0 if single else 1) << (BITS - np.uint64(1))


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and each key's number among them. (np.unique holds twice as much at its peak.)"""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(keys), np.int32)
    which[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    return ordered[first], which


def _cells(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts in sorted keys."""
    return np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << BITS)


def _deltas(keys: np.ndarray) -> bytes:
    low = keys & MASK
    return ta.planes(np.diff(low, prepend=low[:1] * 0))


class Shard:
    """The texts of a shard, their n-grams and each n-gram's number among the different ones, in bucket order."""

    def __init__(self, column: pa.Array, order: int, buckets: int):
        self.sequence, self.at = tokens(column)
        places = np.arange(len(self.sequence)) - np.repeat(self.at[:-1], np.diff(self.at))
        self.text = np.repeat(np.arange(len(column)), np.diff(self.at))
        codes = grams(self.sequence, order)
        # START is no token: it only stands in histories. An n-gram must lie within its text.
        self.fits = [places >= max(k, 1) for k in range(order)]
        keys = np.concatenate([dealt(c[f], buckets, not k) for k, (c, f) in enumerate(zip(codes, self.fits, strict=True))])
        del codes
        self.keys, which = numbered(keys)
        del keys
        self.which = []
        done = 0
        for f in self.fits:
            numbers = np.full(len(f), -1, np.int32)
            numbers[f] = which[done : done + f.sum()]
            done += int(f.sum())
            self.which.append(numbers)

    def counts(self, train: np.ndarray) -> np.ndarray:
        """How often each n-gram stands in the texts marked as training."""
        total = np.zeros(len(self.keys), np.int64)
        for f, w in zip(self.fits, self.which, strict=True):
            total += np.bincount(w[f & train[self.text]], minlength=len(self.keys))
        return total


class Automaton:
    """The states, failure arcs and arcs that the texts of a shard can visit.

    State 0 is the empty history, state 1 the start of a text; the others are the seen n-grams shorter than the order.
    fail and fail_weight (log10) give each state's failure arc. Arcs are sorted by key, state and token in one number;
    each has its log10 probability and the state that it leads to: the longest history that ends with its token.
    """

    def __init__(self, shard: Shard, seen: np.ndarray, total: int, kinds: int, texts: int, strengths: tuple[float, ...], discount: float):
        order = len(shard.which)
        state = np.full(len(seen), -1)
        n, fails, weights = 2, [0, 0], [0.0, _failing(strengths[0], np.array([texts]))[0] if strengths else 0.0]
        probability = np.zeros(len(seen))
        keys, grams_of = [], []
        history_count = np.r_[0, texts].astype(np.int64)
        for k in range(order):
            # one place of each seen n-gram of k + 1 tokens
            places = np.flatnonzero(shard.fits[k])
            g = shard.which[k][places]
            places, g = places[seen[g] > 0], g[seen[g] > 0]
            at = np.full(len(seen), -1)
            at[g] = places
            g = np.flatnonzero(at >= 0)
            at = at[g]
            if not k:
                origin = np.zeros(len(g), np.int64)
                probability[g] = (seen[g] - discount) / max(total, 1)
            else:
                before = shard.which[k - 1][at - 1] if k > 1 else np.where(shard.fits[0][at - 1], shard.which[0][at - 1], -1)
                origin = np.where(before < 0, 1, state[before])
                shorter = shard.which[k - 1][at]
                probability[g] = (seen[g] + strengths[k - 1] * probability[shorter]) / (history_count[origin] + strengths[k - 1])
            keys.append(origin << 32 | shard.which[0][at])
            grams_of.append(g)
            if k < order - 1:
                state[g] = n + np.arange(len(g))
                n += len(g)
                history_count = np.r_[history_count, seen[g]]
                fails = np.r_[fails, state[shard.which[k - 1][at]] if k else np.zeros(len(g), np.int64)]
                weights = np.r_[weights, _failing(strengths[k], seen[g])]
                leads = state[g]
            else:
                leads = state[shard.which[k - 1][at]] if k else np.zeros(len(g), np.int64)
            grams_of[-1] = np.stack([g, leads])
        keys, (arcs, leads) = np.concatenate(keys), np.concatenate(grams_of, 1)
        o = np.argsort(keys)
        self.keys, self.leads = keys[o], leads[o]
        self.weights = np.log10(probability[arcs[o]])
        self.fail, self.fail_weight = np.asarray(fails, np.int64), np.asarray(weights, float)
        # without any training token all are unknown and as likely as the add-one estimate has them
        self.unknown = np.log10(discount * kinds / total) if total else 0.0

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after reading a token each (-1: unknown), and the log10 probabilities of these steps."""
        score, state = np.zeros(len(state)), state.copy()
        rest = np.arange(len(state))
        while len(rest):
            key = state[rest] << 32 | token[rest].astype(np.int64) & 0xFFFFFFFF
            i = np.searchsorted(self.keys, key)
            hit = i < len(self.keys)
            hit[hit] = self.keys[i[hit]] == key[hit]
            taken = rest[hit]
            score[taken] += self.weights[i[hit]]
            state[taken] = self.leads[i[hit]]
            rest = rest[~hit]
            lost = state[rest] == 0
            score[rest[lost]] += self.unknown
            rest = rest[~lost]
            score[rest] += self.fail_weight[state[rest]]
            state[rest] = self.fail[state[rest]]
        return state, score

    def read(self, token: np.ndarray, at: np.ndarray, memory: int) -> np.ndarray:
        """The log10 probability of each text; at: where texts start in token (n + 1 values), START first."""
        length = np.diff(at) - 1
        runs = -(-length // RUN)
        text = np.repeat(np.arange(len(length)), runs)
        first = at[text] + 1 + RUN * ta.within(runs)
        last = np.minimum(first + RUN, at[text + 1])
        # a later run warms up on the tokens that its state depends on
        warm = np.where(first > at[text] + 1, memory, 0)
        o = np.argsort(-(last - first + warm), kind="stable")
        text, place, last, first = text[o], (first - warm)[o], last[o], first[o]
        state, total = (place == at[text] + 1).astype(np.int64), np.zeros(len(text))
        active = len(text)
        while active:
            state[:active], score = self.step(state[:active], token[place[:active]])
            total[:active] += np.where(place[:active] >= first[:active], score, 0.0)
            place[:active] += 1
            active = int(np.searchsorted(-(last - place)[:active], 0, "left"))
        return np.bincount(text, total, len(length))


def _failing(strength: float, count: np.ndarray) -> np.ndarray:
    return np.log10(strength / (count + strength))


def _stats(docs: DataFrame, buckets: int) -> tuple[int, int, int]:
    """Tokens, different tokens and texts of the training rows."""

    def deal(batches):
        held, n, texts = [], 0, 0
        for piece in (p for b in batches for p in ta.pieces([b], PIECE)):
            sequence, at = tokens(piece.column("text"))
            sequence = np.delete(sequence, at[:-1])
            held.append(np.unique(dealt(grams(sequence, 1)[0], buckets, True)))
            n, texts = n + len(sequence), texts + len(piece)
            if sum(map(len, held)) > FLUSH:
                yield packed(held, n, texts)
                held, n, texts = [], 0, 0
        if held:
            yield packed(held, n, texts)

    def packed(held, n, texts):
        keys = np.unique(np.concatenate(held))
        cut = _cells(keys, buckets)
        full = [b for b in range(buckets) if cut[b] < cut[b + 1]]
        first = np.arange(len(full)) == 0
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([_deltas(keys[cut[b] : cut[b + 1]]) for b in full], pa.binary()), pa.array(np.where(first, n, 0)), pa.array(np.where(first, texts, 0))], ["bucket", "grams", "tokens", "texts"])

    def add(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(ta.unplanes(x, np.uint64), dtype=np.uint64) for x in table.column("grams").to_pylist()])
        return pa.table({"tokens": [sum(table.column("tokens").to_pylist())], "kinds": [len(np.unique(keys))], "texts": [sum(table.column("texts").to_pylist())]})

    parts = docs.where("train").select("text").mapInArrow(deal, "bucket int, grams binary, tokens long, texts long")
    r = parts.groupBy("bucket").applyInArrow(add, "tokens long, kinds long, texts long").agg(F.sum("tokens"), F.sum("kinds"), F.sum("texts")).first()
    return tuple(x or 0 for x in r)


def lm_scores(docs: DataFrame, train: Column, strengths: tuple[float, ...] = STRENGTHS, discount: float = DISCOUNT, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Log10 probabilities of whole texts under a model of the rows where train is true.

    A text's tokens are its words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, and one end. Returns a row for each row:
    doc_id, trained (train, null counts as true), n_tokens, n_known (tokens that stand in the training rows),
    train_tokens, base_score (add-one unigrams), score (the automaton). A null text is empty and has its end only.
    Repeated rows count and are scored each; null ids are kept. Without training rows every token is unknown.
    """
    order = 1 + len(strengths)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // shard_bytes) or 1
    buckets = max(1, shards // 2)
    total, kinds, texts = _stats(rows, buckets)
    sharded = rows.withColumn("shard", F.expr(f"CAST(pmod(xxhash64(doc_id, text), {shards}) AS int)"))

    def send(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        shard = Shard(table.column("text").combine_chunks(), order, buckets)
        counts = shard.counts(table.column("train").to_numpy()).astype(np.uint32)
        cut = _cells(shard.keys, buckets)
        full = [b for b in range(buckets) if cut[b] < cut[b + 1]]
        cells = [slice(cut[b], cut[b + 1]) for b in full]
        return pa.table({"bucket": pa.array(full, pa.int32()), "shard": pa.array([table.column("shard")[0].as_py()] * len(full), pa.int32()), "grams": pa.array([_deltas(shard.keys[c]) for c in cells], pa.binary()), "counts": pa.array([ta.planes(counts[c]) for c in cells], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        # one row at a time, so that no more than the keys themselves is held beside the packed rows
        size = [len(ta.unplanes(x.as_py(), np.uint32)) for x in table.column("counts")]
        ends = np.cumsum([0, *size])
        keys, counts = np.empty(ends[-1], np.uint64), np.empty(ends[-1], np.uint32)
        for g, c, at, to in zip(table.column("grams"), table.column("counts"), ends, ends[1:], strict=False):
            np.cumsum(ta.unplanes(g.as_py(), np.uint64), out=keys[at:to])
            counts[at:to] = ta.unplanes(c.as_py(), np.uint32)
        keys, which = numbered(keys)
        total = np.bincount(which, counts, len(keys)).astype(np.uint32)
        del keys, counts
        return pa.table({"bucket": table.column("bucket"), "shard": table.column("shard"), "grams": pa.array([b""] * len(size), pa.binary()), "counts": pa.array([ta.planes(total[which[at:to]]) for at, to in zip(ends, ends[1:], strict=False)], pa.binary())})

    def traverse(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        answers = sorted(zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist(), strict=True))
        shard = Shard(left.column("text").combine_chunks(), order, buckets)
        seen = np.concatenate([np.zeros(0, np.int64), *(ta.unplanes(x, np.uint32).astype(np.int64) for _, x in answers)])
        token = shard.fits[0]
        count = np.where(token, seen[np.maximum(shard.which[0], 0)], 0)
        base = (count + 1) / (total + kinds + 1)
        add_up = lambda x: np.bincount(shard.text[token], x[token], n)
        n = left.num_rows
        n_tokens, n_known, base = add_up(token).astype(np.int64), add_up(count > 0).astype(np.int64), add_up(np.log10(base))
        score = Automaton(shard, seen, total, kinds, texts, strengths, discount).read(np.where(count > 0, shard.which[0], -1), shard.at, order - 1) if total else base
        return pa.table({"doc_id": left.column("doc_id"), "trained": left.column("train"), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": np.full(n, total), "base_score": base, "score": score})

    answers = sharded.groupBy("shard").applyInArrow(send, ROWS).groupBy("bucket").applyInArrow(add, ROWS)
    return sharded.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(traverse, "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for all documents."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    out = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held_out)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
