"""The dealt operators against brute force, libraries and hand-made cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import BASE, DOCS, ODD, docs, words_of

from shutterfold.llm import bpe, decontaminate, linededup, mpeg, pii, quality, textarrays, urlfilter, viterbi

SF = "/root/testdata/sf0.001"
# --- text arithmetic -------------------------------------------------------


def test_words_and_hashes_do_not_depend_on_place():
    import pyarrow as pa

    texts = ["alpha beta", None, "", "  BETA alpha  ", "alpha"]
    found = []
    for _, _, data, offsets in textarrays.chunks(pa.array(texts), most=8):
        words = textarrays.Words(data, offsets)
        h = words.hashes()
        found += [h[a:b].tolist() for a, b in zip(words.first[:-1], words.first[1:])]
    assert [len(x) for x in found] == [2, 0, 0, 2, 1]
    assert found[0] == found[3][::-1] and found[4] == found[0][:1]


# --- op2 -------------------------------------------------------------------


def brute_lines(texts, min_words=50):
    """All windows of whole lines, first occurrence kept."""
    seen, gone = {}, {}
    wins = []
    for d, t in enumerate(texts):
        if t is None:
            continue
        lines = [(i, x) for i, x in enumerate(t.split("\n"))]
        nw = [(i, x, 0 if not x.strip(" ") else len(x.strip(" ")) - len(x.strip(" ").replace(" ", "")) + 1) for i, x in lines]
        nw = [x for x in nw if x[2]]
        for side in "fb":
            for k in range(len(nw)):
                run, total, j = [], 0, k
                while 0 <= j < len(nw) and total < min_words:
                    run.append(nw[j])
                    total += nw[j][2]
                    j += 1 if side == "f" else -1
                if total >= min_words:
                    run = run if side == "f" else run[::-1]
                    wins.append(((side, tuple(x[1] for x in run)), (d, run[0][0]), run[-1][0]))
    for key, place, _ in wins:
        seen[key] = min(seen.get(key, place), place)
    for key, place, end in wins:
        if seen[key] != place:
            gone.setdefault(place[0], set()).update(range(place[1], end + 1))
    return ["\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) if d in gone else t for d, t in enumerate(texts)], gone


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choices(BASE, k=rng.randint(1, 30))) for _ in range(14)]
    texts = ["\n".join(rng.choices(pool + [""], k=rng.randint(0, 18))) for _ in range(60)] + ODD + ["\n".join(pool)] * 3
    got = linededup.dedup(docs(spark, texts, extra=True)).orderBy("doc_id").collect()
    want, gone = brute_lines(texts)
    assert [r.text for r in got] == want
    assert [r.lines_removed for r in got] == [len(gone.get(i, ())) for i in range(len(texts))]
    assert got[0].h == 4 and sum(map(len, gone.values())) > 50


def test_line_dedup_counts_words_between_any_blanks(spark):
    tabbed, spaced = "\t".join(f"c{i}" for i in range(60)), "   ".join(f"s{i}" for i in range(20))
    got = linededup.dedup(docs(spark, [tabbed, "x\n" + tabbed, spaced, "y\n" + spaced])).orderBy("doc_id").collect()
    assert [r.text for r in got] == [tabbed, "x", spaced, "y\n" + spaced]
    lines = ["", " ", "\t", " a ", "a b", "a  b", "a\tb c", "\x0b a\r"]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select("line", linededup._words(F.col("line")).alias("n"))
    assert {r.line: r.n for r in df.collect()} == {x: len(words_of(x)) for x in lines}


def test_line_dedup_repeated_rows_null_ids_and_empty(spark):
    line = " ".join(BASE * 2)
    df = spark.createDataFrame([(1, line), (1, line), (2, line), (None, line), (1, "other")], DOCS)
    df = df.withColumns({c: F.lit(7) for c in ("runs", "doc", "th", "pos", "island", "fp", "a", "b", "lines_removed")})
    assert set(linededup.dedup(df).columns) == set(df.columns)
    got = sorted((r.doc_id or 0, r.text, r.lines_removed) for r in linededup.dedup(df).collect())
    assert got == sorted([(1, line, 0), (1, line, 0), (2, "", 1), (0, line, 0), (1, "other", 0)])
    assert linededup.dedup(df.where("false")).count() == 0


def test_line_dedup_plan_is_native(spark):
    plan = linededup.dedup(docs(spark, ["x"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- op3 -------------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.score(d, quality.trained(d, labels)).join(labels, "doc_id").where(quality.held_out())
    rows = scored.select("score", "quality").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([np.mean(np.array(bad) < g) for g in good]) > 0.97
    assert np.mean([s >= quality.CUT for s in good]) > 0.95 and np.mean([s < quality.CUT for s in bad]) > 0.9


def test_quality_fit_minimises_the_pairwise_loss():
    """The slope of the plain loss over all pairs, one by one, is zero at the fitted weights."""
    rng = np.random.default_rng(1)
    rows = np.hstack([rng.normal(size=(60, 3)), np.zeros((60, quality.N_FEATURES - 3))])
    label = (rows[:, 0] - rows[:, 1] + rng.normal(size=60) > 0).astype(int)
    model = quality.fit_rows(rows, label, pairs=400, seed=5)
    good, bad, spread = rows[label == 1], rows[label == 0], np.maximum(rows.std(axis=0), 1e-3)
    pick = np.random.default_rng(5)
    i, j = pick.integers(len(good), size=400), pick.integers(len(bad), size=400)
    w = model.weights * spread
    slope = 1e-3 * w
    for a, b in zip(i, j):
        x = (good[a] - bad[b]) / spread
        slope = slope - x / (1 + np.exp(x @ w)) / 400
    assert np.abs(slope).max() < 1e-6 and w[0] > 0.3 and w[1] < -0.3 and np.abs(w[3:]).max() < 1e-9
    raw = np.concatenate([good, bad]) - model.centre
    right = np.array([model.score(rows) >= quality.CUT]).ravel() == (label == 1)
    assert right.mean() > 0.75 and len(raw) == 60


def test_quality_threshold_where_most_are_bad():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(400, quality.N_FEATURES)) * 0.1
    label = (np.arange(400) < 40).astype(int)
    rows[:40, 0] += 3
    model = quality.fit_rows(rows, label)
    assert ((model.score(rows) >= quality.CUT) == (label == 1)).all()


def test_quality_edge_rows(spark):
    model = quality.fit_rows(np.random.default_rng(0).random((40, quality.N_FEATURES)), np.arange(40) % 2)
    rows = quality.score(docs(spark, ODD, extra=True), model).orderBy("doc_id").collect()
    assert all(0 <= r.score <= 1 for r in rows) and rows[0].score == rows[1].score and rows[8].score == rows[9].score
    empty = docs(spark, []).where("false")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int").where("false")
    blank = quality.trained(empty, labels)
    assert quality.score(docs(spark, ["a"]), blank).first().score == pytest.approx(0.5)


def test_held_out_is_crc(spark):
    rows = docs(spark, ["x"] * 50).select("doc_id", quality.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


# --- op5 -------------------------------------------------------------------


def unigram_library(tmp_path):
    """The library's own unigram segmenter over the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        if piece.score <= viterbi.NEVER:
            piece.type, piece.score = 5, 0
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return sentencepiece.SentencePieceProcessor(model_file=str(path))


def test_viterbi_counts_equal_the_library(spark, tmp_path):
    library = unigram_library(tmp_path)
    texts = [t for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ["", "  a  b", "漢字é\n\n\tx 😀", "▁▁a", "<0x0A> <unk>"]
    got = viterbi.count_tokens(docs(spark, texts, extra=True), public_tokenizers.path("piece_bpe_32k.model")).orderBy("doc_id").collect()
    assert [r.counted.n_tokens for r in got] == [len(library.encode(t)) for t in texts]


def test_viterbi_ties_and_brute_force():
    pieces = {"▁a": -2.0, "b": -1.0, "▁ab": -3.0, "▁": -1.0, "a": -1.0, "aa": -2.0, "ba": -2.0}
    one = viterbi.Counter(pieces)
    across = viterbi.Counter(pieces | {"b▁a": -0.5})  # a piece that crosses words: the whole text is one segment
    assert across.count("b a") == complex(2, -1.5)
    assert one.count("ab") == complex(1, -3.0)  # one piece ties with two: the longest last piece stays

    def brute(s):
        best = {0: (0.0, 0)}
        for i in range(len(s)):
            if i in best:
                options = [(len(p), pieces[p], 1) for p in pieces if s.startswith(p, i)]
                if s[i] not in pieces:
                    options.append((1, one.unknown, len(s[i].encode())))
                for n, score, k in options:
                    if i + n not in best or best[i][0] + score > best[i + n][0]:
                        best[i + n] = (best[i][0] + score, best[i][1] + k)
        return complex(best[len(s)][1], best[len(s)][0])

    rng = random.Random(2)
    for _ in range(400):
        t = "".join(rng.choices("ab cé", k=rng.randint(1, 14)))
        assert one.count(t) == brute("▁" + t.replace(" ", "▁"))


def test_viterbi_edge_rows(spark):
    rows = viterbi.count_tokens(docs(spark, ODD), public_tokenizers.path("piece_bpe_32k.model")).orderBy("doc_id").collect()
    assert rows[0].counted.n_tokens == rows[1].counted.n_tokens == 0 and rows[8].counted == rows[9].counted


# --- op6 -------------------------------------------------------------------


def test_mpeg_round_trip():
    rng = random.Random(4)
    for n in (0, 1, 63, 64, 65, 936, 937, 938, 30_000):
        payload = rng.randbytes(n)
        media = mpeg.store(payload)
        found = mpeg.probe(media)
        assert found["payload"] == payload + bytes(-n % 64 or (0 if n else 64)) and found["n_bytes"] == n
        assert found["frames"] == found["table_frames"] == found["crc_good"] and not found["crc_bad"] and not found["skipped_bytes"]
        assert found["duration_us"] == found["frames"] * 1152 * 1_000_000 // 48000 and found["table_bytes"] == len(media) - found["offsets"][0] + 192


def test_mpeg_resynchronises_and_sees_damage():
    media = bytearray(mpeg.store(b"x" * 5000))
    offsets = mpeg.probe(bytes(media))["offsets"]
    hurt = bytes(media[: offsets[2] + 7] + b"\x01" + media[offsets[2] + 8 :])
    assert mpeg.probe(hurt)["crc_bad"] == 1
    junk = bytes(media[: offsets[1]]) + b"\xff\xe0junk" + bytes(media[offsets[1] :]) + b"TAG" + b"song".ljust(125, b"\0")
    found = mpeg.probe(junk)
    assert found["frames"] == len(offsets) and found["skipped_bytes"] == 6 and dict(found["tags"])["title"] == "song"
    assert mpeg.probe(b"")["frames"] == 0 and mpeg.probe(b"ID3")["payload"] == b""


def test_mpeg_header_kinds():
    assert mpeg.header(0xFFFB9000)[:6] == (10, 3, 44100, 2, 417, 1152)
    assert mpeg.header(0xFFF3_4000 | 0xC0)[:4] == (20, 3, 22050, 1)
    assert mpeg.header(0xFFFF_1000)[1] == 1 and mpeg.header(0xFFFBF000) is None and mpeg.header(0x12345678) is None


def test_mpeg_columns(spark):
    rows = mpeg.probe_column(mpeg.store_column(docs(spark, ODD, extra=True))).orderBy("doc_id").collect()
    for r, t in zip(rows, ODD):
        raw = (t or "").encode()
        assert r.info.n_bytes == len(raw) and bytes(r.info.payload)[: len(raw)] == raw and len(r.info.payload) % 64 == 0
    assert rows[8].media == rows[9].media and rows[0].media == rows[1].media


def test_mpeg_query_digests_of_whole_texts(spark, tmp_path):
    from shutterfold.llm import mpeg_query

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()} | {9000 + i: t for i, t in enumerate(ODD)}
    spark.createDataFrame(list(texts.items()), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = mpeg_query.op6_mpeg_audio(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        media = mpeg.store(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false").withColumn("info", F.lit(1))
    assert mpeg.probe_column(mpeg.store_column(empty)).count() == 0


# --- op7 -------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii_base_equals_plain_patterns():
    rng = random.Random(8)
    for _ in range(20_000):
        t = "".join(rng.choices("ab12 .@+-_9(", k=rng.randint(0, 32)))
        assert pii.find(t) == brute_pii(t)


@pytest.mark.parametrize(
    "text,kind,span",
    [
        ("mail john.doe [at] example (dot) com now", "email", "john.doe [at] example (dot) com"),
        ("to joe at example dot com!", "email", "joe at example dot com"),
        ("jоhn@exаmple.com x", "email", "jоhn@exаmple.com"),
        ("call plus one two three four five six seven eight nine zero", "phone", "plus one two three four five six seven eight nine zero"),
        ("pay four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
        ("at 10 dot 0 dot 0 dot 1 ok", "ip", "10 dot 0 dot 0 dot 1"),
        ("４" + "１" * 15, "card", "４" + "１" * 15),
        ("192​.168.0.1", "ip", "192​.168.0.1"),
        ("write john at example.com today", "email", "john at example.com"),
        ("jоhn at mail.example.org", "email", "jоhn at mail.example.org"),
        ("john at example dot\ncom", "email", "john at example dot\ncom"),
        ("192.168.one.7", "ip", "192.168.one.7"),
        ("+1 555 0100 two three four", "phone", "+1 555 0100 two three four"),
    ],
)
def test_pii_disguises(text, kind, span):
    assert (kind, span) in [(pii.KINDS[k], text[a:b]) for a, k, b, added in pii.spans(text) if added]


def test_pii_leaves_clean_text_alone():
    for t in ("look at the dot on it", "one two three, four five", "nine lives (at) last", "meet me at example.com", "look at example.org", "Üben für das Größte", "3.14 is pi", "1234 5678"):
        assert pii.spans(t) == []


@pytest.mark.parametrize(
    "text,kind",
    [
        ("Call plus 49 30 1234567", "phone"), ("4111 1111 1111 one one one 1", "card"), ("+1 202 555 01 nine nine", "phone"), ("joe at example dot\ncom", "email"),
        ("joe at example dot\tcom", "email"), ("on one.1.1.1 now", "ip"), ("4111-1111-1111-111-One", "card"), ("+1 202 555 01 \u017fix \u017f\u0130x", "phone"),
    ],
)
def test_pii_mixed_disguises(text, kind):
    assert kind in [pii.KINDS[k] for _, k, _, added in pii.spans(text) if added]


def plain_added(text):
    """Rewrites one disguise after another on a list of (character, start, end, changed) and searches again."""
    cells = [(pii.FOLD.get(ord(c), c), i, i + 1, ord(c) in pii.FOLD) for i, c in enumerate(text)]
    folded = "".join(c for c, *_ in cells)
    out, at = [], 0
    for m in pii._REWRITE.finditer(folded):
        new = pii.DIGIT_WORDS[m[0].casefold().replace("\u0307", "")] if m.lastgroup == "digit" else {"at": "@", "dot": ".", "plus": "+", "gap": ""}[m.lastgroup]
        out += cells[at : m.start()]
        if new:
            out.append((new, m.start(), m.end(), True))
        elif out:
            out[-1] = (*out[-1][:3], True)
        at = m.end()
    out += cells[at:]
    found = brute_pii("".join(c for c, *_ in out))
    return {(out[a][1], k, out[b - 1][2]) for a, k, b in found if any(x[3] for x in out[a:b])}


def test_pii_spans_equal_always_rewriting():
    rng = random.Random(8)
    digits = [*"0123456789", "41", "1111", "4111 1111", *pii.DIGIT_WORDS, "One", "NINE", "si\u0130x", "\u017feven"]
    words = ["joe", "example", "com", "at", "AT", "dot", "Dot", "plus", "Plus", "someone", "bone", "the", "[at]", "( dot )", "<.>", "@", "+", "a.b@c.de", "x@one.two", "\u200b", "\uff11", "\u0430"]
    added = 0
    for share in (0.95, 0.8, 0.5):
        for _ in range(10_000):
            t = "".join(rng.choice(digits if rng.random() < share else words) + rng.choice([" ", " ", " ", "-", ".", "", "  ", "\n", "\t", " (", ") "]) for _ in range(rng.randint(1, 22)))
            base = set(brute_pii(t))
            want = sorted([(*x, False) for x in base] + [(*x, True) for x in plain_added(t) - base])
            assert pii.spans(t) == want
            added += len(want) - len(base)
    assert added > 500


def test_pii_blank_runs_are_rewritten_in_linear_time():
    assert pii.rewritten("one two" + " " * 300_000 + "end")[0] == "1 2" + " " * 300_000 + "end"


def test_pii_is_linear():
    for t in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1 " * 100_000, "a@" * 100_000, "one " * 50_000):
        pii.spans(t)


def test_pii_column(spark):
    texts = [*ODD, "x a@b.cd +1 (555) 555-1234"]
    df = docs(spark, texts, extra=True).withColumn("spans", F.lit(1))
    rows = pii.detect(df).orderBy("doc_id").collect()
    assert [len(r.spans) for r in rows] == [0] * len(ODD) + [2] and rows[-1].spans[0].kind == "email" and rows[-1].n == 2
    assert pii.detect(df.where("false")).count() == 0


# --- op8 -------------------------------------------------------------------


def test_redirects_spread_blocks_and_allows_win(spark):
    html = lambda x: f'<html><link href="{x}" rel="canonical"></html>'
    go = '<META HTTP-EQUIV="refresh" content="0; URL=https://bad.com/en/1">'
    pages = spark.createDataFrame(
        [
            (1, "https://bad.com/en/1", ""), (2, "https://alias.info/x", html("https://bad.com/en/1")), (3, "http://hop.info/y", html("https://alias.info/x")),
            (4, "https://www.hop.info/y/?utm_source=a#top", None), (5, "https://free.info/", go), (6, "https://ok.net/de/1", html("https://free.info/")),
            (7, "no scheme", ""), (8, None, ""), (9, "HTTPS://BAD.COM/en/1?ref=z", ""), (10, "https://alias.info/x", ""),
        ],
        "page_id long, url string, html string",
    ).withColumn("rule", F.lit("clash"))
    rules = spark.createDataFrame([("com", "/en/", "block"), ("net", "/de/", "allow")], "host string, path string, action string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, rules, urlfilter.page_edges(pages, normal_forms=True)).collect()}
    assert got[1] == ("com/en/", "block") and got[6] == ("net/de/", "allow")
    assert {k: v[1] for k, v in got.items() if k in (2, 3, 4, 5, 10)} == dict.fromkeys((2, 3, 4, 5, 10), "allow")  # page 6's allow is in the same component
    assert got[7] == got[8] == (None, "allow") and got[9] == ("com/en/", "block")
    fewer = pages.where("page_id not in (5, 6)")
    got = {r.page_id: r.verdict for r in urlfilter.judge(fewer, rules, urlfilter.page_edges(fewer, normal_forms=True)).collect()}
    assert got[2] == got[3] == got[4] == got[10] == "block"
    got = {r.page_id: r.verdict for r in urlfilter.judge(fewer, rules, urlfilter.page_edges(fewer)).collect()}
    assert got[2] == got[3] == "block" and got[4] == "allow"
    assert urlfilter.judge(pages.where("false"), rules, urlfilter.page_edges(pages.where("false"))).count() == 0


def test_relative_targets_are_resolved_as_the_library_does(spark):
    from urllib.parse import urljoin

    bases = ["http://a.com/x/y/p.html?q=1", "https://A.com", "http://a.com/", "http://a.com/x/?r=http://z.de/w"]
    targets = ["/en/7", "//b.net/de/1", "?page=2", "#top", "q.html", "./q", "../q", "../../../q", "../", ".", "..", "/a/./b/../c", "q/?s=../t", "http://c.org/es", "/go?to=http://d.org/x", "q?to=http://d.org/x"]
    df = spark.createDataFrame([(b, t) for b in bases for t in targets], "b string, t string")
    for r in df.select("b", "t", urlfilter.resolved(F.col("t"), F.col("b")).alias("got")).collect():
        assert r.got in (want := urljoin(r.b, r.t), want.replace("//a.com", "//A.com")), (r.b, r.t)
    for b, t in [("http://a.com/x", "mailto:a@b.c"), ("http://a.com/x", ""), ("a.com/x", "/y")]:
        assert spark.createDataFrame([(b, t)], "b string, t string").select(urlfilter.resolved(F.col("t"), F.col("b")).alias("got")).first().got is None


def test_relative_and_repeated_tags_tie_aliases(spark):
    pages = [
        (1, "http://m.shop.com/x/a", '<link rel="canonical" href="/bad/1">'), (2, "http://o1.org/", '<meta http-equiv="refresh" content="0; url=//shop.com/bad/2">'),
        (3, "http://o2.org/", '<link rel=canonical href="http://o3.org/"><link rel=canonical href="http://shop.com/bad/3">'),
        (4, "http://o4.org/", '<meta http-equiv=refresh content="5"><meta http-equiv=refresh content="0;url=http://shop.com/bad/4">'), (5, "http://o5.org/p", '<link rel="canonical" href="?x=1">'), (6, "http://o6.org/", None),
    ]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    rules = spark.createDataFrame([("shop.com", "/bad", "block")], "host string, path string, action string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(df.select("page_id", "url"), rules, urlfilter.page_edges(df)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow"}


def test_redirect_chains_against_brute_force(spark, tmp_path):
    """Random chains, stars and loops of canonical links and redirects, by the registered query and its SQL."""
    import duckdb

    from shutterfold.llm import urlfilter_query

    rng = random.Random(4)
    hosts = ["shop.com", "example.com", "m.example.net", "example.net", "news.org", "free.info", "de.net"]
    paths = ["/en/1", "/en/7x", "/de/8", "/de/2", "/es/4", "/", "/fr/3"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}?n={i}" for i in range(160)]
    html, links = [], []
    for i, u in enumerate(urls):
        tags = ""
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            to = urls[max(0, i - rng.randint(1, 4))] if rng.random() < 0.9 else rng.choice(["mailto:x@y.z", "/es/9", "//shop.com/en/5"])
            full = {"/es/9": u.split("/", 3)[0] + "//" + u.split("/")[2] + "/es/9", "//shop.com/en/5": "http://shop.com/en/5"}.get(to, to)
            tags += f'<link rel="canonical" href="{to}">' if rng.random() < 0.5 else f'<meta http-equiv="refresh" content="0; url={to}">'
            if "://" in full:
                links.append((u, full))
        html.append(tags)

    def own(u):
        host, path = u.split("://")[1].split("/", 1)
        path = "/" + path.split("?")[0]
        fits = [(len(h + p), h + p, a) for h, p, a in urlfilter_query.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else None

    up = {u: u for pair in links for u in pair}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    said = {}
    for u in up:
        if o := own(u):
            said.setdefault(find(u), set()).add(o[1])
    want = {}
    for i, u in enumerate(urls):
        o = own(u)
        want[i] = (o[0] if o else None, o[1] if o else "block" if u in up and said.get(find(u)) == {"block"} else "allow")
    assert sum(v == (None, "block") for v in want.values()) >= 5
    pages = spark.createDataFrame(list(zip(range(len(urls)), urls, html)), "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: (r.rule, r.verdict) for r in urlfilter_query.op8_url_redirect_equivalence(spark, str(tmp_path)).collect()} == want
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert {r[0]: (r[3], r[4]) for r in con.execute(urlfilter_query.ORACLE).fetchall()} == want


def test_url_filter_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "")], "page_id long, url string, html string")
    assert not re.search("Python|Pandas|Arrow", urlfilter.page_edges(pages)._jdf.queryExecution().toString())


# --- op9 -------------------------------------------------------------------


def test_masks_hit_every_window():
    from itertools import combinations

    lost = decontaminate.WINDOW - int(np.ceil(decontaminate.SHARE * decontaminate.WINDOW))
    assert lost == 2
    for bad in combinations(range(decontaminate.WINDOW), lost):
        assert any(all(o + x not in bad for x in m) for m in decontaminate.MASKS for o in range(decontaminate.WINDOW - m[-1]))
    assert decontaminate.SHORT_MASK[-1] < decontaminate.SHORTEST


@pytest.mark.parametrize("kind", ["long", "int", "smallint", "string"])
def test_decontamination_takes_ids_of_any_integer_type(spark, kind):
    item = " ".join(f"w{i}" for i in range(20))
    df = docs(spark, ["x " + item, "nothing", item + " y"]).withColumn("doc_id", F.col("doc_id").cast(kind))
    bench = spark.createDataFrame([(5, item)], "item_id int, text string")
    if kind == "string":
        with pytest.raises(TypeError):
            decontaminate.overlaps(df, bench)
    else:
        assert {(r.doc_id, r.item_id, r.doc_start, r.matched) for r in decontaminate.overlaps(df, bench).collect()} == {(0, 5, 1, 20), (2, 5, 0, 20)}
        assert [r.doc_id for r in decontaminate.clean(df, bench).collect()] == [1]


def test_decontamination_repeated_and_null_ids_and_clashing_columns(spark):
    item = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, item), (1, "clean text"), (1, item), (None, item), (None, "other"), (3, None), (4, "")], DOCS)
    df = df.withColumns({c: F.lit(1) for c in ("rid", "id", "tokens", "seed", "pos", "words", "n", "item_id", "diagonal")})
    bench = spark.createDataFrame([(5, item), (None, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.overlaps(df, bench).collect()] == [(1, 5)]
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "other"), (1, "clean text"), (3, ""), (4, "")]
    assert decontaminate.clean(df, bench.where("false")).count() == 7 and decontaminate.clean(df.where("false"), bench).count() == 0


def test_decontamination_against_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(4000)]
    items = [rng.choices(vocab, k=k) for k in (40, 25, 13, 8, 5, 4, 30)] + [[]]
    texts = [rng.choices(vocab, k=60) for _ in range(20)]
    for n, item in enumerate(items):
        for errors in range(4):
            w = list(item)
            for at in rng.sample(range(len(w)), min(errors, len(w))):
                w[at] = "zz"
            texts.append(rng.choices(vocab, k=rng.randint(0, 30)) + w + rng.choices(vocab, k=rng.randint(0, 9)))
    joined = [", ".join(t).upper() if i % 3 == 0 else " ".join(t) for i, t in enumerate(texts)] + [None, ""]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(99, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.doc_start, r.doc_end, r.matched) for r in decontaminate.overlaps(docs(spark, joined, extra=True), bench).collect()}
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            width = min(len(item), decontaminate.WINDOW)
            need = int(np.ceil(decontaminate.SHARE * width)) if len(item) >= decontaminate.WINDOW else width
            if len(item) >= decontaminate.SHORTEST and any(sum(a == b for a, b in zip(t[x : x + width], item[y : y + width])) >= need for x in range(len(t) - width + 1) for y in range(len(item) - width + 1)):
                want.add((d, i))
    assert set(got) == want and len(want) >= 15
    kept = {r.doc_id for r in decontaminate.clean(docs(spark, joined), bench).collect()}
    assert kept == set(range(len(joined))) - {d for d, _ in want}
    assert decontaminate.overlaps(docs(spark, joined).where("false"), bench).count() == 0


# --- op10 ------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_equals_the_library(spark, reference):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = [t for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ODD + ["ab" * 5000, "\x00\x01", "   x \n\n y"]
    rows = bpe.decode(bpe.encode(docs(spark, texts, extra=True), path, pattern), path, pattern).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        assert r.ids == reference.encode_ordinary(t or "") and bytes(r.decoded) == (t or "").encode()
    null = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(null, path, pattern).collect()] == [b"", b""]


def test_bpe_random_strings(reference):
    one = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(9)
    for _ in range(3000):
        t = "".join(rng.choices("etaoin shrdlu  THE'sll12,.é漢\n", k=rng.randint(0, 40)))
        assert np.frombuffer(one.encode(t), "<i4").tolist() == reference.encode_ordinary(t)


# --- the registered queries ------------------------------------------------


def test_queries_keep_their_columns(spark):
    from shutterfold.llm import entries

    first = {
        "op3_": ["doc_id", "held_out", "score", "predicted"], "op4_": ["doc_id", "n_shingles", "component_id"],
        "op6_": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        "op7_": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op8_": ["page_id", "host", "path", "rule", "verdict"],
        "op10_": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    }
    assert sorted(int(k[2:].split("_")[0]) for k in entries.QUERIES) == list(range(1, 11))
    for prefix, columns in first.items():
        name = next(k for k in entries.QUERIES if k.startswith(prefix))
        found = entries.QUERIES[name](spark, SF)
        assert found.columns[: len(columns)] == columns
    row = entries.QUERIES["op10_byte_level_bpe"](spark, SF).orderBy("doc_id").first()
    text = spark.read.parquet(f"{SF}/documents.parquet").where(f"doc_id = {row.doc_id}").first().text
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
