import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_vectors import components

from vellumspark.llm import minhash_dedup as M
from vellumspark.llm import queries


def sets(texts):
    """Shingles with their weights."""
    out = []
    for t in texts:
        w = (t or "").split()
        n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or Counter({tuple(w): 1} if w else {})
        out.append({k: 1 + math.log(v) for k, v in n.items()})
    return out


def similarity(x, y):
    """The greater of plain and probability Jaccard."""
    if not x or not y:
        return float(not x and not y)
    plain = len(x.keys() & y.keys()) / len(x.keys() | y.keys())
    if plain >= 0.8 or not x.keys() & y.keys() or set(x.values()) | set(y.values()) == {1}:
        return plain
    every = x.keys() | y.keys()
    return max(plain, sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in x.keys() & y.keys()))


def brute(rows):
    ids, s = [r[0] for r in rows], sets([r[1] for r in rows])
    links = [(ids[a], ids[b]) for a in range(len(s)) for b in range(a) if similarity(s[a], s[b]) >= 0.8]
    return components(ids, links)


def corpus(seed=1):
    """Copies, near copies of many degrees, a large family of near copies, a passage that many share, repeated lines."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 7)))
    out = []
    for _ in range(25):
        base = [word() for _ in range(r.randrange(20, 200))]
        out.append(base)
        for share in (0, 0.005, 0.01, 0.02, 0.03, 0.05):
            out.append([word() if r.random() < share else w for w in base])
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    for _ in range(150):
        out.append([word() if r.random() < 0.015 else w for w in base])
        out.append(passage + [word() for _ in range(r.randrange(10, 60))])
    line = [word() for _ in range(8)]
    out += [line * n for n in (1, 2, 30)] + [[word()], ["x", "y"], ["x", "y"]]
    return [(i * 3 + 1, " ".join(w)) for i, w in enumerate(out)]


def test_components_equal_brute_force(spark, monkeypatch):
    rows = corpus()
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in M.near_duplicates(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == want and all(r.kept == (r.component_id == i) for i, r in got.items())
    monkeypatch.setattr(M, "BLOCK", 8)  # buckets of many components, cut into blocks
    assert {r.doc_id: r.component_id for r in M.near_duplicates(df).collect()} == want


def test_odd_rows(spark, odd_docs, no_docs):
    got = M.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert by[1] == {(1, True)} and by[8] == {(1, False)}
    assert by[2] == {(2, True)} and by[3] == by[4] == by[5] == {(2, False)}
    assert by[None] == {(None, True), (2, False)}
    assert by[6] == {(6, True)} and by[7] == {(7, True)}
    assert M.near_duplicates(no_docs).count() == 0
    clash = odd_docs.select("doc_id", "text", F.lit(1).alias("component_id"), F.lit("x").alias("sig"), F.lit("y").alias("key"))
    assert M.near_duplicates(clash).columns == ["doc_id", "component_id", "kept"]


def test_signatures_estimate_probability_jaccard():
    r = np.random.default_rng(3)
    e = r.integers(0, 2**63, 300).astype(np.uint64)
    x, y = r.random(300) * 3, r.random(300) * 3
    x[:60] = 0
    y[200:] = 0
    a, b = x > 0, y > 0
    want = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(300)) for i in range(300) if x[i] > 0 and y[i] > 0)
    sig = M.signatures([(e[a], x[a]), (e[b], y[b])], 8192)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.02
    one = M.signatures([(e[:1], np.ones(1)), (e[:0], np.ones(0))], 64)
    assert (one[0] == e[0]).all() and (one[1] == 0).all()


def test_registered_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: r.component_id for r in queries.op3_probminhash_dedup(spark, sf).collect()} == brute(rows)


def test_repeated_passages_of_unequal_counts(spark):
    """A passage once and 60 times, in texts that share all else but three words: alike as sets, not by weight."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    rows = []
    for k in range(80):
        own, passage = [word() for _ in range(140)], [word() for _ in range(60)]
        near = list(own)
        for at in (20, 60, 100)[: k % 4]:
            near[at] = word()
        rows += [(2 * k, " ".join(own + passage)), (2 * k + 1, " ".join(near + passage * 60))]
    want = brute(rows)
    assert len(set(want.values())) == 80
    assert {x.doc_id: x.component_id for x in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_texts_alike_by_weight_only(spark):
    """A passage that both repeat 80 times outweighs what differs; as sets they are less than 0.8 similar."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    rows = []
    for k in range(40):
        passage = [word() for _ in range(60)]
        rows += [(2 * k + i, " ".join(passage * 80 + [word() for _ in range(20 + k)])) for i in (0, 1)]
    want, s = brute(rows), sets([t for _, t in rows])
    assert len(set(want.values())) < 60 and all(len(s[i].keys() & s[i + 1].keys()) < 0.8 * len(s[i].keys() | s[i + 1].keys()) for i in range(0, 80, 2))
    assert {x.doc_id: x.component_id for x in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_short_texts_that_repeat_a_line_unequally(spark):
    """200 pairs of 8 to 19 words and a line, twice in one text and 300 times in the other; all are 1.0 alike as sets but for the seam."""
    r = random.Random(10)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    rows = []
    for k in range(200):
        own, line = [word() for _ in range(r.randrange(8, 20))], [word() for _ in range(8)]
        rows += [(2 * k, " ".join(own + line * 2)), (2 * k + 1, " ".join(own + line * 300))]
    got = {x.doc_id: x.component_id for x in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k] == got[2 * k + 1] == 2 * k for k in range(200))


def test_probability_jaccard_is_its_formula():
    r = np.random.default_rng(5)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 60, 30)).astype(np.uint64) for _ in range(2))
        x, y = r.integers(1, 4, len(a)).astype(float), r.integers(1, 4, len(b)).astype(float)
        p, q = dict(zip(a.tolist(), x, strict=True)), dict(zip(b.tolist(), y, strict=True))
        every, both = p.keys() | q.keys(), p.keys() & q.keys()
        want = sum(1 / sum(max(p.get(j, 0) / p[i], q.get(j, 0) / q[i]) for j in every) for i in both)
        assert abs(M.probability_jaccard(a, x, b, y) - want) < 1e-12
        assert want <= min(sum(p[i] for i in both) / x.sum(), sum(q[i] for i in both) / y.sum()) + 1e-12


def test_two_partitionings_agree(spark):
    df = spark.createDataFrame(corpus(2), "doc_id long, text string")
    one, two = ({r.doc_id: r.component_id for r in M.near_duplicates(d).collect()} for d in (df.coalesce(1), df.repartition(7)))
    assert one == two
