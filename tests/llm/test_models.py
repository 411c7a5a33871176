"""The quality classifier and the language field: held-out accuracy, exact inference, edge rows."""

import collections
import functools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelode.llm import crf, language, quality
from framelode.llm import textarrays as ta

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_documents(spark):
    got = quality.op9_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_scores_do_not_depend_on_other_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    a = {r.text: r.score for r in quality.quality_scores(docs.select("text", "doc_id"), model).collect()}
    b = {r.text: r.score for r in quality.quality_scores(docs.select("text", F.lit(1).alias("doc_id"), F.lit("xx").alias("lang")).repartition(3), model).collect()}
    assert a.keys() == b.keys() and all(abs(a[t] - b[t]) < 1e-5 for t in a)


def test_quality_edge_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, None), (None, 1), (4, 5)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "good text here"), (2, "another good text"), (3, None), (None, ""), (5, "x " * 60000), (5, "  \t"), (6, "7"), (7, "a!!!")], "doc_id long, text string").withColumn("score", F.lit(9))
    for model in (quality.fit(docs, labels), quality.fit(docs, labels.limit(0)), quality.fit(docs.limit(0), labels)):
        got = quality.quality_scores(docs, model).collect()
        assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
        assert quality.quality_scores(docs.limit(0), model).collect() == []


def test_quality_follows_the_mix_of_all_labels_below_and_above_the_sample_bound(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.concat(F.lit("w"), F.abs(F.xxhash64("doc_id", k)) % 50))
    docs = spark.range(2000).select(F.col("id").alias("doc_id")).select("doc_id", F.array_join(words, " ").alias("text"))
    labels = docs.select("doc_id", (F.abs(F.xxhash64("doc_id", F.lit(1))) % 100 >= 15).cast("int").alias("quality"))
    mean = lambda sample: quality.quality_scores(docs.where("doc_id < 400"), quality.fit(docs, labels, sample)).agg(F.avg("score")).first()[0]
    whole, thinned = mean(2000), mean(100)
    assert abs(whole - 0.85) < 0.05 and abs(thinned - whole) < 0.05


def test_term_weights_count_all_documents(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("common "), F.when(F.col("id") < 4, "seldom").otherwise("w")).alias("text"))
    labels = docs.where("doc_id < 8").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    counts = quality.term_counts(docs.select("text").toArrow().column("text").combine_chunks())
    assert np.allclose(quality.fit(docs.repartition(3), labels).weights, np.log(41 / (1 + (counts > 0).sum(0))) + 0.1)


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = language.op10_language(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_words_of_a_mixed_text_get_their_own_language():
    field = language.Field(["a", "b"]).learn([b"lorem ipsum dolor sit amet " * 8, b"quux zyzzyx wqq xyz " * 8], [0, 1])
    text = b"lorem dolor amet ipsum sit lorem quux wqq zyzzyx xyz quux wqq"
    words = language.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    gamma, _ = crf.posteriors(field.emissions(words), words.bounds, field.transitions)
    assert gamma.argmax(1).tolist() == [0] * 6 + [1] * 6


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    e, t = rng.normal(size=(300, 3)), rng.normal(size=(3, 3))
    bounds = np.array([0, 1, 1, 150, 215, 300])
    gamma, pairs = crf.posteriors(e, bounds, t)
    want, counts = [], np.zeros((3, 3))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        alpha, beta = [np.full(3, 1 / 3)], [np.ones(3)]
        for i in range(a, b):
            alpha.append((alpha[-1] @ np.exp(t)) * np.exp(e[i]))
        for i in range(b - 1, a, -1):
            beta.append(np.exp(t) @ (np.exp(e[i]) * beta[-1]))
        beta, z = beta[::-1], alpha[-1].sum()
        for i in range(a, b):
            want.append(alpha[i - a + 1] * beta[i - a] / z)
            counts += np.outer(alpha[i - a], np.exp(e[i]) * beta[i - a]) * np.exp(t) / z
    assert np.allclose(gamma, want) and np.allclose(pairs, counts)


def test_language_edge_rows(spark):
    rows = [(1, "der und die", "de"), (2, "the and of", "en"), (3, None, "en"), (None, "the the", "en"), (4, "12 — 34 🙂", None), (5, "", "de"), (6, "und " * 60000, None), (7, "...", None), (7, "été", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = language.languages(docs, language.fit(docs)).collect()
    by = {(r.doc_id, r.lang_pred) for r in got}
    assert len(got) == 9 and {(3, "und"), (4, "und"), (5, "und"), (7, "und")} <= by and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred in ("de", "en", "und") and math.isfinite(r.score) for r in got)
    none = language.languages(docs, language.fit(docs.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert language.languages(docs.limit(0), language.fit(docs.limit(0))).collect() == []


@functools.cache
def code_of(raw: bytes, base: int) -> int:
    """A word's hash, taken alone."""
    return int(ta.span_hashes(ta.BYTE_VALUES[np.frombuffer(raw, np.uint8)], np.array([0]), np.array([len(raw)]), base)[0])


@functools.cache
def slot(code: int, kind: int) -> int:
    return int(ta.mix(np.array([(code * 16 + kind) % 2**64], np.uint64))[0]) % language.FEATURES


def language_by_brute_force(field, text, known):
    """(language, share) of a whole text, word by word and step by step; known: words met before."""
    k, emissions = len(field.langs), []
    for w in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode()):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
        if w not in known:
            b = [0, *w, 0, 0]
            e = np.zeros(k)
            for i in range(len(w) + 1):
                e += field.weights[slot(b[i] << 8 | b[i + 1], 1)] + field.weights[slot(b[i] << 16 | b[i + 1] << 8 | b[i + 2], 2)]
            e += field.weights[slot(0, 1)] + field.weights[slot(0, 2)]
            head, tail = b[1] << 8 | b[2], w[-1] << 8 | b[len(w) - 1]
            e += field.weights[slot(head, 3)] + field.weights[slot(head << 8 | b[min(3, len(w) + 1)], 4)]
            e += field.weights[slot(tail, 5)] + field.weights[slot(tail << 8 | b[max(len(w) - 2, 0)], 6)]
            hit = np.flatnonzero(field.lexicon == np.uint64(code_of(w, language.WORD)))
            known[w] = e + (field.lexicon_weights[hit[0]] if len(hit) else 0)
        emissions.append(known[w])
    if not emissions:
        return "und", 0.0
    step, e = np.exp(field.transitions), np.exp(np.array(emissions) - np.max(emissions, axis=1, keepdims=True))
    alpha, beta = [np.full(k, 1 / k)], [np.ones(k)]
    for x in e:
        alpha.append((a := (alpha[-1] @ step) * x) / a.sum())
    for x in e[:0:-1]:
        beta.append((b := step @ (x * beta[-1])) / b.sum())
    gamma = np.array(alpha[1:]) * np.array(beta[::-1])
    share = (gamma / gamma.sum(1, keepdims=True)).sum(0)
    return field.langs[int(share.argmax())], float(share.max() / share.sum())


def test_language_query_equals_brute_force_over_whole_texts(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    field, known = language.fit(docs), {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in language.op10_language(spark, sf).collect()}
    assert got.keys() == texts.keys()
    monkeypatch.setattr(language, "PIECE", 2000)
    for d, text in texts.items():
        lang, share = language_by_brute_force(field, text, known)
        assert got[d].lang_pred == lang and abs(got[d].score - share) < 1e-6
        # the same text alone, in pieces
        ((one,), (score,)) = field.predict(pa.array([text], pa.string()))
        assert one == lang and abs(score - share) < 1e-6


def test_ties_between_languages_and_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language.Field, "learn", lambda self, texts, labels: self)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"), F.format_string("l%03d", "id").alias("lang"))
    field = language.fit(docs)
    assert len(field.langs) > 250 and field.langs == [r.lang for r in docs.where(~language.held_out()).sort("lang").collect()]
    # without any weights all languages are alike: the first by name is taken
    (got, score) = field.predict(pa.array(["some words here", None]))
    assert got == [field.langs[0], "und"] and abs(score[0] - 1 / len(field.langs)) < 1e-9


def test_the_sample_of_a_language_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "wort " * 1000, "de") for i in range(60)] + [(100 + i, "word " * 10, "en") for i in range(9)], "doc_id long, text string, lang string")
    taken = []
    learn = language.Field.learn
    try:
        language.Field.learn = lambda self, texts, labels: taken.extend(map(len, texts)) or self
        language.fit(docs, sample_bytes=20_000)
    finally:
        language.Field.learn = learn
    assert taken.count(5000) == 4


def votes_by_brute_force(model, text):
    """The share of label 1 among the nearest labelled vectors, one cosine after the other."""
    counts = collections.Counter()
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    shapes = []
    for w in words:
        kinds = bytes(ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c for c in w)
        shape = re.sub(rb"(.)\1\1\1+", rb"\1\1\1", re.sub(rb"([aA0])\1+", rb"\1", kinds), flags=re.S)
        shapes.append(code_of(shape, quality.SHAPE))
        counts[code_of(w, quality.WORD) % quality.WORD_TERMS] += 1
        counts[quality.WORD_TERMS + shapes[-1] % (quality.SHAPE_TERMS - 1)] += 1
    for i in range(len(words) - 1):
        pair = int(ta.mix(np.array([(shapes[i] * quality.PAIR + shapes[i + 1]) % 2**64], np.uint64))[0])
        counts[quality.WORD_TERMS + pair % (quality.SHAPE_TERMS - 1)] += 1
        counts[quality.WORD_TERMS + quality.SHAPE_TERMS - 1] += words[i] == words[i + 1]
    x = np.zeros(quality.WORD_TERMS + quality.SHAPE_TERMS)
    for term, n in counts.items():
        x[term] = math.log1p(n) * model.weights[term]
    unit = lambda v: v / max(math.sqrt(sum(v * v)), 1e-9)
    x = np.r_[0.5 * unit(x[: quality.WORD_TERMS]), unit(x[quality.WORD_TERMS :])]
    v = unit(x @ model.axes)
    near = sorted(((float(v @ y), int(label), float(n)) for y, label, n in zip(model.vectors, model.labels, model.votes, strict=True)), reverse=True)[: quality.NEIGHBOURS]
    weight = [(max(c, 0) ** 4 * n, label) for c, label, n in near]
    return (sum(w * label for w, label in weight) + quality.PRIOR_WEIGHT * model.prior) / (sum(w for w, _ in weight) + quality.PRIOR_WEIGHT)


def test_quality_query_equals_brute_force_votes(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in quality.op9_quality(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        assert abs(got[d].score - votes_by_brute_force(model, text)) < 1e-4 and got[d].predicted == (got[d].score >= 0.7)


def test_ties_among_neighbours_and_many_empty_texts(spark):
    docs = spark.createDataFrame([(i, "same words in all of them") for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("quality"))
    model = quality.fit(docs, labels)
    # all cosines are equal: whichever neighbours are taken, the score stays a share and repeated rows get the same
    assert len({r.score for r in quality.quality_scores(docs, model).collect()}) == 1
    empty = spark.range(10_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "").alias("text")).coalesce(1)
    scores = {r.score for r in quality.quality_scores(empty, model).collect()}
    assert len(scores) == 1 and abs(scores.pop() - model.prior) < 1e-6


def test_a_piece_has_few_rows():
    batch = pa.RecordBatch.from_pydict({"text": [""] * 10_000})
    assert max(p.num_rows for p in ta.pieces([batch], quality.PIECE, rows=quality.ROWS)) == quality.ROWS


def test_one_id_on_many_rows_is_one_document_of_the_sample(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    hot = spark.range(20_000).select(F.lit(ids[0]).cast("long").alias("doc_id"), F.format_string("some words %08d", F.col("id")).alias("text"))
    others = spark.createDataFrame([(i, f"other words of {i}") for i in ids[1:]], "doc_id long, text string")
    docs = hot.unionByName(others)
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(ids[0], ids[0] % 2)], "doc_id long, quality int")
    model = quality.fit(docs, labels, sample=5)
    assert len(model.labels) <= 10 and len(model.vectors) <= 10
    taken = []
    learn = language.Field.learn
    try:
        language.Field.learn = lambda self, texts, labels: taken.extend(texts) or self
        field = language.fit(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb")), sample=5)
    finally:
        language.Field.learn = learn
    assert len(taken) <= 10 and field.langs == ["aa", "bb"] and all(t != b"some words 00000001" for t in taken)


def test_languages_beyond_the_bound_raise_and_oversized_texts_are_not_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGS", 3)
    docs = spark.createDataFrame([(i, "ab " * (10 + 40 * (i % 2)), f"l{i % 3}") for i in range(40)], "doc_id long, text string, lang string")
    taken = []
    monkeypatch.setattr(language.Field, "learn", lambda self, texts, labels: taken.extend(map(len, texts)) or self)
    assert language.fit(docs, sample_bytes=100).langs == ["l0", "l1", "l2"] and set(taken) == {30}
    with pytest.raises(ValueError, match="more than 3 languages"):
        language.fit(docs.withColumn("lang", F.col("doc_id").cast("string")))
