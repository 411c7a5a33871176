import random
import re

import pytest
from framelode.llm import decontamination as dc
from tests.oracle import check

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(dc.UPPER, dc.LOWER)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_sql(spark, sf):
    check(spark, f"/root/testdata/{sf}", dc.op8_decontamination, dc.OP8_SQL)


def brute(docs, items, window=10):
    words = lambda t: WORDS.findall((t or "").translate(LOWER))
    parts = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - window + 1, min(len(w), 1))):
            parts.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for p, names in parts.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found |= names
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


def test_random_texts(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["a", "B", "ç", "d1"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([0, 1, 2, 3, 4, 5, 9, 10, 12, 30, 30])] + [(77, None)]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(100, "x " + items[9][1] + "! y"), (101, items[10][1].upper())]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for part in (items, items[6:], [(3, "Q q q q q q"), (4, "only here and nowhere else at all but once more")]):
        b = spark.createDataFrame(part, "item_id long, text string")
        got = sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in dc.decontamination(d, b).collect())
        assert got == sorted(brute(docs, part))


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "...", 1), (None, "a b", 1), (4, "a b " * 20000, 1), (4, "a b " * 20000, 1)], "doc_id long, text string, items int")
    bench = spark.createDataFrame([(None, "a b", 2), (9, None, 2), (8, "b a b a b a b a b a", 2)], "item_id long, text string, doc_id int")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in dc.decontamination(docs, bench).collect()}
    assert got == {1: (0, 0, []), 2: (0, 0, []), 3: (0, 0, []), 4: (40000, 39998, ["8"])}
    assert {r.n_hit for r in dc.decontamination(docs, bench.limit(0)).collect()} == {0}
    assert dc.decontamination(docs.limit(0), bench).collect() == []


def test_tokens_beyond_the_broadcast_bound_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_TOKENS", 0)
    check(spark, "/root/testdata/sf0.001", dc.op8_decontamination, dc.OP8_SQL)
