import collections
import random
import re

from framelode.llm import jaccard_join as jj
from framelode.llm import shared
from framelode.llm.components import components, contracted

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, threshold=0.8):
    sets = {}
    for d, t in rows:
        w = WORDS.findall((t or "").encode())
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}
    where = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    links = {}
    for d, s in sets.items():
        common = collections.Counter(e for x in s for e in where[x] if e != d)
        links[d] = [e for e, n in common.items() if n >= threshold * (len(s) + len(sets[e]) - n) - 1e-9]
    label, changed = {d: d for d in sets}, True
    while changed:
        changed = False
        for d in sets:
            low = min([label[d], *(label[e] for e in links[d])])
            changed |= low < label[d]
            label[d] = low
    return {d: (len(sets[d]), len(links[d]), label[d]) for d in sets}


def run(docs):
    return {r.doc_id: (r.n_shingles, r.n_links, r.class_id) for r in jj.jaccard_join(docs).collect()}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.n_links, r.class_id) for r in jj.op6_jaccard_join(spark, sf).collect()}
    assert got == brute(rows) and any(n for _, n, _ in got.values())


def test_groups_of_near_copies_larger_than_a_leaf(spark, monkeypatch):
    monkeypatch.setattr(jj, "LEAF", 8)
    monkeypatch.setattr(jj, "LEAF_BLOCK", 16)
    monkeypatch.setattr(jj, "BLOCK", 16)
    rng = random.Random(5)
    word = lambda: "w%d" % rng.randint(0, 5000)
    rows = []
    for size in (1, 2, 3, 70):
        base = [word() for _ in range(150)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randint(0, 149)] = word()
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + i, " ".join(word() for _ in range(80))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want, got = brute(rows), run(docs)
    assert sum(n for _, n, _ in got.values()) >= 0.99 * sum(n for _, n, _ in want.values())
    assert all(got[d][1] <= want[d][1] for d in want) and {d: g[2] for d, g in got.items()} == {d: w[2] for d, w in want.items()}


def test_recall_of_pairs_at_the_threshold_and_of_a_chain(spark, monkeypatch):
    monkeypatch.setattr(jj, "LEAF", 4)  # small leaves, so that paths are long
    rng = random.Random(6)
    rows, word = [], lambda: "w%d" % rng.randint(0, 10**6)
    for i in range(300):
        # shingles shared by both, then those of each alone: a Jaccard similarity of 0.80 to 0.85
        common = [word() for _ in range(104)]
        own = rng.randint(9, 12)
        rows += [(2 * i, " ".join(common + [word() for _ in range(own)])), (2 * i + 1, " ".join(common + [word() for _ in range(own)]))]
    chain = [word() for _ in range(1200)]
    rows += [(1000 + i, " ".join(chain[10 * i : 10 * i + 200])) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want, got = brute(rows), run(docs)
    pairs = [d for d in want if d < 1000 and want[d][1]]
    assert len(pairs) > 300 and sum(got[d][1] for d in pairs) >= 0.98 * sum(want[d][1] for d in pairs)
    assert all(got[d][1] <= want[d][1] for d in want)
    assert sum(got[d][1] for d in want) >= 0.98 * sum(want[d][1] for d in want)


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(20000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "a  b"), (6, "a b c"), (7, long), (8, long + " end"), (9, "a\nb")]
    docs = spark.createDataFrame([(*r, 1) for r in [*rows, (7, long), (None, "a b")]], "doc_id long, text string, n_links int")
    assert run(docs) == brute(rows)
    assert jj.jaccard_join(docs.limit(0)).collect() == []


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    for links in (df, contracted(df)):
        got = {r.node: r.component for r in components(links).collect()}
        assert got == {n: 0 if n < 100 else 100 if n < 200 else 200 for e in edges for n in e}
    assert components(df.limit(0)).collect() == []


def test_components_end_with_the_round_that_lowers_nothing_and_write_few_files(spark):
    """Before, two more shuffles and a table followed the last round, and each table had a file for each partition."""
    df = spark.createDataFrame([(10 * i, 10 * i + k) for i in range(500) for k in range(1, 4)], "a long, b long")
    held, kept = len(shared._held), {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.node: r.component for r in components(df).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert got == {10 * i + k: 10 * i for i in range(500) for k in range(4)}
    tables = [x for x in shared._held[held:] if "/labels-" in x]
    assert len(tables) == 2
    assert all(len(spark.read.parquet(x).inputFiles()) <= shared.LEAST_TASKS for x in tables)


def test_a_level_of_the_recursion_is_written_in_few_files_and_holds_a_set_once(spark):
    """Before, equal rows were looked for by a shuffle of each level, and each table had a file for each partition."""
    rng = random.Random(5)
    base = [rng.choice("abcdefgh") * 3 + str(rng.randrange(40)) for _ in range(60)]
    rows = [(d, " ".join(w if rng.random() > 0.01 else f"x{rng.randrange(9)}" for w in base)) for d in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held, kept = len(shared._held), {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        jj.jaccard_join(docs)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    levels = [x for x in shared._held[held:] if re.search(r"/(nodes|paths)[2-9]\d*-", x)]
    assert levels
    for x in levels:
        table = spark.read.parquet(x)
        assert len(table.inputFiles()) <= shared.LEAST_TASKS
        assert table.count() == table.select("node", "rep").distinct().count()


def test_work_on_a_chain_follows_its_links(spark):
    rng = random.Random(7)
    words = ["w%d" % rng.randint(0, 10**6) for _ in range(15 * 3000 + 180)]
    rows = [(i, " ".join(words[15 * i : 15 * i + 180])) for i in range(3000)]  # 0.84 alike with the next, 0.71 with the one after
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = []
    met = jj.met_blocks

    def watched(*args):
        seen.append(met(*args))
        return seen[0]

    jj.met_blocks = watched
    try:
        got = run(docs)
    finally:
        jj.met_blocks = met
    assert {g[2] for g in got.values()} == {0} and 0.99 * 2 * 2999 <= sum(g[1] for g in got.values()) <= 2 * 2999
    homes, pairs = seen[0]
    size = collections.Counter(r.home for r in homes.collect())
    assert max(size.values()) <= 2 * jj.BLOCK
    products = sum(size[r.i] * size[r.j] for r in pairs.collect())
    assert products < 20 * 2999  # all pairs are 4.5 million
