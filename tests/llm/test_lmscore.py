"""op1 against a plain model of all words and bigrams."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.cases import ODD, docs, words_of

from shutterfold.llm import lmscore, lmscore_query, packed

END = object()


def counted(corpus):
    """Words, pairs (the end of a text is one of the seconds) and texts that hold a word."""
    one, two = Counter(), Counter()
    for w in filter(None, map(words_of, corpus)):
        one.update(w)
        two.update(zip(w, [*w[1:], END]))
    return one, two, sum(n for (_, x), n in two.items() if x is END)


def plain(target, background, texts):
    """(n_words, target loss, background loss, score) of each text, and the two conditional models."""
    models, vocabulary = [], set()
    for corpus in (target, background):
        models.append(counted(corpus))
        vocabulary |= set(models[-1][0])

    def model(one, two, ends):
        total = sum(one.values()) + ends + len(vocabulary) + 2

        def p(x, h=None):
            q = ((ends if x is END else one[x]) + 1) / total
            return q if h is None else (two[h, x] + lmscore.PRIOR * q) / (one[h] + lmscore.PRIOR)

        return p

    both = [model(*m) for m in models]
    rows = []
    for w in map(words_of, texts):
        loss = [-sum(np.log(p(x, h)) for h, x in zip([None, *w], w)) / max(1, len(w)) for p in both]
        rows.append((len(w), *loss, loss[0] - loss[1]))
    return rows, both, vocabulary


@pytest.mark.parametrize("bits", [0, 3])
def test_packed_lists_come_back(bits):
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    n = rng.integers(1, 1 << 40, len(keys))
    batch = packed.rows(keys, n, bits)
    assert np.array_equal(np.concatenate([packed.unpack_keys(x.as_py()) for x in batch["keys"]]), keys)
    assert np.array_equal(np.concatenate([packed.unpack(x.as_py()) for x in batch["n"]]), n.astype(np.uint64))
    assert packed.rows(keys[:0], n[:0], bits).num_rows == 0
    merged = packed.merged([keys, keys[:7]], [n, n[:7]])
    assert np.array_equal(merged[0], keys) and np.array_equal(merged[1][:8], n[:8] * np.array([2] * 7 + [1]))


def test_models_sum_to_one():
    target, background = ["a b a c", "b", ""], ["a a d", "c b a"]
    _, both, vocabulary = plain(target, background, [])
    for p in both:
        for h in [None, *vocabulary, "never seen"]:
            assert sum(p(x, h) for x in [*vocabulary, END, "unknown"]) == pytest.approx(1)


def test_query_counts_every_word_and_bigram(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(f"w{int(30_000 * rng.random() ** 3)}" for _ in range(1500)) for _ in range(200)] + ODD
    turns = [" ".join(rng.choices(texts[i].split(), k=30)) for i in range(50)] + ["rareword onlyhere", None, ""]
    docs(spark, texts).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs(spark, turns).select("text").write.parquet(f"{tmp_path}/conversations.parquet")
    want, _, _ = plain(turns, texts, texts)
    got = lmscore_query.op1_lm_cross_entropy_difference(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(len(texts)))
    assert np.allclose([tuple(r)[1:] for r in got], want, atol=1e-6)


def test_many_blocks_many_buckets_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(packed, "KEYS_A_BUCKET", 500)
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=200)) for _ in range(60)] + ODD
    turns = texts[:10] + ["w1 w2 w3"]
    df = docs(spark, texts, extra=True).withColumn("lm", F.lit(1))
    got = lmscore.difference(df, docs(spark, turns), block_bytes=1 << 12).orderBy("doc_id").collect()
    assert np.allclose([tuple(r.lm) for r in got], plain(turns, texts, texts)[0])
    assert got[0].ids == "x" and got[0].h == 4 and not hasattr(got[0], "text")


def test_documents_outside_the_background(spark):
    texts, target, background = ["a b zz", "zz a", None], ["a b", "b a b"], ["c b a"]
    got = lmscore.difference(docs(spark, texts), docs(spark, target), docs(spark, background)).orderBy("doc_id").collect()
    assert np.allclose([tuple(r.lm) for r in got], plain(target, background, texts)[0])


def test_empty_tables_and_repeated_rows(spark):
    none = docs(spark, []).where("false")
    assert lmscore.difference(none, none).count() == 0
    twice = docs(spark, ["a b", None, ""]).unionByName(docs(spark, ["a b"]))
    got = lmscore.difference(twice, none).collect()
    assert len(got) == 4 and len({r.lm for r in got if r.doc_id == 0 and r.lm.n_words}) == 1
    assert all(r.lm.score == 0 for r in got if r.lm.n_words == 0)
