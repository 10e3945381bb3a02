"""op4 against all pairs of small tables."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.cases import BASE, DOCS, ODD, docs, words_of

from shutterfold.llm import ngramjoin


def brute_join(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = words_of(t)
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def family(rng, size, length, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("rare,weight", [(32, 1 << 19), (4, 900)])
def test_ngram_join_against_brute_force(spark, monkeypatch, rare, weight):
    """The second setting sends most groups through stars and several blocks."""
    monkeypatch.setattr(ngramjoin, "RARE", rare)
    monkeypatch.setattr(ngramjoin, "STEPS", (rare, 512, 8192))
    monkeypatch.setattr(ngramjoin, "BLOCK_WEIGHT", weight)
    rng = random.Random(11)
    texts = family(rng, 60, 90, 4) + family(rng, 25, 40, 2) + family(rng, 8, 300, 12) + family(rng, 10, 6, 1) + ODD + [" ".join(BASE)] * 12 + [f"w{i} w{i + 1} w{i + 2} w{i + 3}" for i in range(20)]
    for n, percent in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.components(docs(spark, texts, extra=True), n, percent).collect()}
        assert got == brute_join(list(enumerate(texts)), n, percent)


def test_tree_links_hashed_bitmaps(monkeypatch):
    monkeypatch.setattr(ngramjoin, "LEAF_BITS", 128)
    rng = random.Random(3)
    texts = family(rng, 40, 120, 6) + family(rng, 30, 80, 3)
    sets = [np.unique(np.array([hash(tuple(words_of(t)[i : i + 3])) % (1 << 62) for i in range(len(words_of(t)) - 2)], np.uint64)) for t in texts]
    label = ngramjoin.tree_links(sets, 80)
    up = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            o = len(np.intersect1d(sets[a], sets[b]))
            if 180 * o >= 80 * (len(sets[a]) + len(sets[b])):
                x, y = up[a], up[b]
                up = [min(x, y) if u in (x, y) else u for u in up]
    assert [[x == y for y in label] for x in label] == [[x == y for y in up] for x in up]


def test_empty_null_and_repeated_ids(spark):
    near = [f"w{i}" for i in range(60)]
    other = " ".join(["x", *near[1:]])
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (9, "A B c d e"), (5, " ".join(near)), (5, "quite other words here"), (4, "quite other words here"), (None, other), (None, None), (8, "")]
    df = spark.createDataFrame(rows, DOCS)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.components(df).collect())
    assert got == Counter({(None, 2, None): 1, (3, 2, 3): 2, (9, 2, 3): 1, (5, 57, 5): 1, (5, 1, 4): 1, (4, 1, 4): 1, (None, 57, None): 1, (None, 0, None): 1, (8, 0, 8): 1})
    assert ngramjoin.components(df.where("false")).count() == 0


def test_null_id_ties_two_documents(spark):
    """The middle one of three links both others, which don't link each other."""
    words = [f"w{i}" for i in range(100)]
    left, right = ["x1", "x2", *words[2:]], [*words[:-6], *[f"y{i}" for i in range(6)]]
    df = spark.createDataFrame([(7, " ".join(left)), (None, " ".join(words)), (2, " ".join(right))], DOCS)
    got = {r.doc_id: r.component_id for r in ngramjoin.components(df, 4, 85).collect()}
    assert brute_join([(7, " ".join(left)), (2, " ".join(right))], 4, 85)[7][1] == 7
    assert got == {7: 2, None: None, 2: 2}


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (None, "g h i j k l"), (None, "g h i j k l"), (None, "G h i j k l"), (4, None), (6, ""), (7, "m n"), (8, "m n")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"root": F.lit(1), "rid": F.lit(2), "rank": F.lit(3)})
    got = ngramjoin.one_of_each(df)
    assert got.columns == df.columns
    assert Counter((r.doc_id, (r.text or "").lower()) for r in got.collect()) == Counter({(1, "a b c d e f"): 1, (None, "g h i j k l"): 1, (4, ""): 1, (6, ""): 1, (7, "m n"): 1})
    assert ngramjoin.one_of_each(df.where("false")).count() == 0
