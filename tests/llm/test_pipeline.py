"""The five stages against plain Python, one after another, on whole small tables."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F
from tests.llm.cases import BASE
from tests.llm.test_ngramjoin import brute_join
from tests.llm.test_operators import brute_lines

import corpus_pipeline
from shutterfold.llm import bpe, decontaminate, quality

SF = "/root/testdata/sf0.001"


def tokens(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def leaks(text, items):
    number = {}
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in tokens(t)])
    d = code(text)
    for item in map(code, items):
        width = min(len(item), decontaminate.WINDOW)
        need = int(np.ceil(decontaminate.SHARE * width - 1e-9)) if len(item) >= decontaminate.WINDOW else width
        if len(item) < decontaminate.SHORTEST:
            continue
        for diagonal in range(-len(item) + width, len(d) - width + 1):
            lo, hi = max(0, -diagonal), min(len(item), len(d) - diagonal)
            same = d[lo + diagonal : hi + diagonal] == item[lo:hi]
            if len(same) >= width and np.convolve(same, np.ones(width, int), "valid").max() >= need:
                return True
    return False


def plain(rows, items, model):
    """``(doc_id, text)`` rows through the first four stages; ids are distinct or null."""
    texts = pa.array([t for _, t in rows], pa.string())
    scores = np.concatenate([model.score(x) for x in quality.features(texts)]) if rows else []
    rows = [r for r, s in zip(rows, scores) if s >= quality.CUT]
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    cleaned, gone = brute_lines([t for _, t in known])
    rows = [(d, t) for i, ((d, _), t) in enumerate(zip(known, cleaned)) if i not in gone or t.strip(" \n\t\r")] + [r for r in rows if r[0] is None]
    group = {i: g for i, (_, g) in brute_join(list(enumerate(t for _, t in rows)), 5, 80).items()}
    worded = [bool(re.search(r"[^\x20\x09-\x0D]", t or "")) for _, t in rows]
    first = {}
    for i, (d, _) in enumerate(rows):
        if worded[i]:
            first[group[i]] = min(first.get(group[i], (True, 0, i)), (d is None, d or 0, i))
    rows = [r for i, r in enumerate(rows) if not worded[i] or first[group[i]][2] == i]
    return [r for r in rows if not leaks(r[1], items)]


def test_pipeline_against_plain_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    line = " ".join(BASE * 2)
    odd = [(9001, None), (9002, ""), (9003, line), (9004, "x\n" + line), (9005, " \n\t"), (None, "quite alone here " + " ".join(BASE)), (None, None), (9006, "a" * 70_000), (9007, "Üben " * 30)]
    more = spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in odd], docs.schema)
    docs.unionByName(more).withColumns({c: F.lit(1) for c in ("runs", "doc", "rid", "root", "h")}).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    columns = docs.columns + ["runs", "doc", "rid", "root", "h"]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns[: len(columns)] == columns
    rows = got.collect()
    whole = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text")
    model = quality.trained(whole, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    items = pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist()
    want = plain([tuple(r) for r in whole.collect()], items, model)
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(want)
    assert 50 < len(rows) < whole.count()
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in rows:
        assert r.ids == library.encode(r.text or "", disallowed_special=()) and r.n_tokens == len(r.ids) and r.round_trip


def test_pipeline_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[1:4], ids=lambda s: s[0])
def test_middle_stages_take_repeated_ids_and_odd_rows(spark, stage):
    """Rows of one id with different texts are different documents; no stage loses a clean one or fails."""
    rows = [(1, "one clean text of its own"), (1, "another clean text of its own"), (None, "a text without an id"), (None, None), (2, None), (3, ""), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("runs", "th", "seed", "rid", "tokens", "id", "set_key")})
    got = stage[1](spark, df, SF)
    assert got.columns == df.columns and Counter((r.doc_id, r.text) for r in got.collect()) == Counter(rows)
