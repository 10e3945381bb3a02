"""op11: sums over all segmentations by brute force, learning, and held-out accuracy."""

import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.cases import ODD

from shutterfold.llm import langid, langid_query

PATH = public_tokenizers.path(langid_query.MODEL)
PIECES = ["▁", "a", "b", "c", "ab", "bc", "▁a", "▁ab", "abc", "a▁b", "▁▁"]


def small():
    own = langid.Vocabulary({p: 256 + i for i, p in enumerate(PIECES)}, list(range(256)), 256 + len(PIECES))
    rng = np.random.default_rng(1)
    return own, np.log(rng.dirichlet(np.ones(own.size), size=3).T)


def segmentations(word):
    """All ways to cut a marked word into usable pieces; characters without a piece are their bytes."""
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in zip(at, at[1:])]
        if all((p in PIECES and "▁" not in p[1:]) or (len(p) == 1 and p not in PIECES) for p in parts):
            yield [n for p in parts for n in ([256 + PIECES.index(p)] if p in PIECES else list(p.encode()))]


def test_forward_and_expected_counts_equal_all_segmentations():
    own, log_p = small()
    words = ["▁" + "".join(w) for n in range(5) for w in itertools.product("abcé", repeat=n)]
    got = langid.word_scores(words, log_p, own)
    counts, n = np.zeros((own.size, 3)), np.arange(1, len(words) + 1)
    for w, row, times in zip(words, got, n):
        ways = list(segmentations(w))
        each = np.array([np.exp(log_p[way].sum(axis=0)) for way in ways])
        assert np.allclose(row, np.log(each.sum(axis=0)))
        for way, p in zip(ways, each / each.sum(axis=0)):
            np.add.at(counts, way, p * times)
    for i in range(3):
        assert np.allclose(langid.expected(words, n.astype(float), log_p[:, i], own), counts[:, i])


def test_small_lattices_give_the_same(monkeypatch):
    own, log_p = small()
    words = ["▁" + "".join(w) for w in itertools.product("abcé", repeat=3)] + ["▁" + "ab" * 50, "▁"]
    n = np.arange(len(words), dtype=float)
    want = langid.word_scores(words, log_p, own), langid.expected(words, n, log_p[:, 1], own)
    monkeypatch.setattr(langid, "LATTICE_CHARS", 9)
    assert np.allclose(langid.word_scores(words, log_p, own), want[0]) and np.allclose(langid.expected(words, n, log_p[:, 1], own), want[1])


def test_long_words_do_not_underflow():
    own, log_p = small()
    words = ["▁" + "ab" * 20_000, "▁a", "▁" + "é" * 3000]
    got = langid.word_scores(words, log_p, own)
    assert np.isfinite(got).all() and (got[0] < -10_000).all()
    assert np.allclose(got[1], langid.word_scores(["▁a"], log_p, own)[0])
    assert np.allclose(got[2], log_p[256] + 3000 * (log_p[0xC3] + log_p[0xA9]))
    assert langid.word_scores([], log_p, own).shape == (0, 3)


def test_words_are_letters_and_marks():
    texts = pa.array([None, "", " 12 ", "Ab-cD  e\n", "ÉCOLE’s", "café 99x", "漢字かな"], pa.large_string())
    want = [[], [], [], ["▁ab", "▁cd", "▁e"], ["▁école", "▁s"], ["▁café", "▁x"], ["▁漢字かな"]]
    assert langid.marked_words(texts).to_pylist() == want


def made(rng, syllables):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(3, 30)))


def table(spark, n=240):
    rng = random.Random(2)
    kinds = {"aa": ["ka", "to", "mi", "ra"], "bb": ["str", "ung", "er", "ach"], "zz": ["кот", "мир", "да"]}
    rows = [(i, made(rng, kinds[k]), k, i) for i in range(n) for k in [("aa", "aa", "bb", "zz")[i % 4]]]
    odd = ["word " * 5000 if len(t or "") > 50_000 else t for t in ODD]  # one very long word has a test of its own
    rows += [(n + i, t, "aa", 1) for i, t in enumerate(odd)] + [(5000 + i, "katomi tora", None, 1) for i in range(20)]
    rows += [(None, "katomi", "never", 1), (6000, "12 34", "digits", 1), (6001, "", "blank", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def test_held_out_documents(spark, tmp_path):
    rows, frame = table(spark)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = langid_query.op11_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    by, lang = {r.doc_id: r for r in got}, {r[0]: r[2] for r in rows}
    assert all(by[i].lang_pred == lang[i] and 0.5 < by[i].score <= 1 for i in range(240))
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (240, 241, 242, 243, 6000, 6001))
    assert {r.lang_pred for r in got} <= {"aa", "bb", "zz", "und"}  # labels without letters, or without an id, aren't learned
    assert by[248][2:] == by[249][2:]


def test_predictions_ignore_the_labels_of_held_out_rows(spark, tmp_path):
    _, frame = table(spark)
    held = langid_query.held_out()
    for name, one in (("a", frame), ("b", frame.withColumn("lang", F.when(~held, F.col("lang"))))):
        one.coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    a, b = (sorted(map(tuple, langid_query.op11_language_id(spark, f"{tmp_path}/{x}").select("doc_id", "lang_pred", F.round("score", 9)).collect()), key=str) for x in "ab")
    assert a == b


def test_learning_is_likelihood_that_rises(spark):
    rows, frame = table(spark)
    words = langid._counted(frame.where("lang = 'aa' and text is not null").select("lang", "text"), ["aa"]).collect()
    assert {(r.word, r.n) for r in words if r.word == "▁katomi"} <= {("▁katomi", r.n) for r in words}
    models = [langid.fit(frame.where("lang in ('aa', 'bb')"), PATH, rounds=n, smooth=1e-6) for n in (1, 2, 4)]
    like = [sum(r.n * langid.word_scores([r.word], m.log_p, langid.vocabulary(PATH))[0, 0] for r in words[:60]) for m in models]
    assert like[0] < like[1] < like[2]
    assert all(np.allclose(np.exp(m.log_p).sum(axis=0), 1) and math.isclose(np.exp(m.prior).sum(), 1) for m in models)


def test_sample_is_bounded_and_takes_every_language(spark):
    _, frame = table(spark)
    sample, rows = langid._sampled(frame.where("lang is not null").select("doc_id", "text", "lang"), 10)
    got = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert got["bb"] <= 10 and got["zz"] <= 10 and got["aa"] <= 10 and set(got) == set(rows) and rows["bb"] == 60
    with pytest.raises(ValueError):
        langid._sampled(spark.range(300).selectExpr("id AS doc_id", "'x' AS text", "string(id) AS lang"), 10)


def test_nothing_learned_and_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(empty, PATH)
    one = spark.createDataFrame([(1, "some text", "own")], "doc_id long, text string, lang_pred string")
    assert [tuple(r) for r in langid.identify(one, model).collect()] == [(1, "some text", "und", 0.0)]
    learned = langid.fit(table(spark)[1], PATH)
    assert langid.identify(empty, learned).collect() == []
    got = langid.identify(one.withColumn("score", F.lit("x")), learned).collect()[0]
    assert got["doc_id"] == 1 and isinstance(got["score"], float) and got["lang_pred"] in learned.languages


def test_kept_word_scores_change_nothing(spark, monkeypatch):
    _, frame = table(spark)
    model = langid.fit(frame, PATH)
    texts = pa.array([r[0] for r in frame.select("text").collect()], pa.large_string())
    want = langid.Scorer(model).logs(texts)
    monkeypatch.setattr(langid, "MEMO", 3)
    tiny = langid.Scorer(model)
    assert np.allclose(tiny.logs(texts), want) and np.allclose(np.vstack([tiny.logs(texts.slice(i, 1)) for i in range(len(texts))]), want)
