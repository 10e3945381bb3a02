"""Decisions on hand-computed cases and against a plain model on random rows."""

import math
import random

from pyspark.sql import functions as F

from shutterfold.operators import culling as C
from shutterfold.operators import ranking, similar

ITEM = "part int, idx int, good boolean, rank float, aesthetic float, sharp float, dhash long, shot_time long, iso int, aperture float, shutter float, focal float, width int, height int, camera string, lens string"


def items(spark, rows):
    base = dict(part=0, good=True, rank=0.0, aesthetic=None, sharp=None, dhash=None, shot_time=None, iso=None, aperture=None, shutter=None, focal=None, width=None, height=None, camera=None, lens=None)
    names = [x.split()[0] for x in ITEM.split(", ")]
    full = [base | {"idx": i} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], ITEM)


def test_burst_groups(spark):
    df = items(spark, [{"shot_time": t} for t in (0, 1, 2, 12, 13, None)])
    got = [r.burst for r in C.burst_ids(df, ["part"], [F.col("idx")], 2).orderBy("idx").collect()]
    assert got == [1, 1, 1, 2, 2, 3]


def test_unknown_time_breaks_the_chain(spark):
    df = items(spark, [{"shot_time": t} for t in (0, None, 1)])
    assert [r.burst for r in C.burst_ids(df, ["part"], [F.col("idx")], 2).orderBy("idx").collect()] == [1, 2, 3]


def test_best_n(spark):
    df = items(spark, [{"rank": s, "iso": g} for s, g in ((0.2, 0), (0.9, 0), (0.5, 0), (0.7, 1), (0.1, 1))])
    for keep, want in ((1, {1, 3}), (2, {1, 2, 3, 4})):
        got = C.best_n(df, ["iso"], keep, F.lit(True), "g").where(~F.col("g_out"))
        assert {r.idx for r in got.collect()} == want


def test_meta_then_burst(spark):
    rows = [{"shot_time": t, "rank": r, "iso": i} for t, r, i in ((100, 0.3, 100), (101, 0.9, 100), (200, 0.5, 100), (201, 0.99, 12800))]
    got = C.decide(items(spark, rows), ["part"], C.MetaFilter(iso_max=6400), 2).orderBy("idx").collect()
    assert [(r.included, r.decided) for r in got] == [(True, False), (True, True), (True, True), (False, False)]


def test_bad_items_take_no_place(spark):
    rows = [{"good": g, "rank": r, "shot_time": 100 + i} for i, (g, r) in enumerate(((False, 0.95), (True, 0.6), (True, 0.4)))]
    got = C.decide(items(spark, rows), ["part"], None, 5).orderBy("idx").collect()
    assert [r.decided for r in got] == [False, True, False]
    assert [(r.burst_rank, r.burst_size) for r in got] == [(None, None), (1, 2), (2, 2)]


def test_dedup_after_burst(spark):
    rows = [{"rank": r, "shot_time": t, "dhash": 5} for r, t in ((0.9, 100), (0.8, 101), (0.7, 900))]
    df = similar.clusters(items(spark, rows), 6, "dhash", "idx")
    got = C.decide(df, ["part"], None, 5, 1, "cluster", 2).orderBy("idx").collect()
    assert [r.decided for r in got] == [True, False, True]
    assert got[1].dedup_rank is None and (got[2].dedup_rank, got[2].dedup_size) == (2, 2)


def test_nan_ranks_come_last(spark):
    rows = [{"rank": math.nan if i % 3 == 0 else float(i), "iso": 1} for i in range(30)]
    got = C.best_n(items(spark, rows), ["iso"], 1, F.lit(True), "g").orderBy("g_rank").collect()
    assert [r.idx for r in got] == [i for i in range(29, -1, -1) if i % 3] + [i for i in range(30) if i % 3 == 0]


def test_group_comparator(spark):
    def order(*pairs):
        df = items(spark, [{"aesthetic": a, "sharp": s, "iso": 1} for a, s in pairs])
        return [r.idx for r in C.best_n(df, ["iso"], 1, F.lit(True), "g").orderBy("g_rank").collect()]

    assert order((0.05, 0.0), (None, 0.99)) == [0, 1]
    assert order((0.4, 0.1), (0.4, 0.9)) == [1, 0]
    assert order((math.nan, 0.3), (None, 0.5), (math.inf, math.nan)) == [1, 0, 2]


def test_top_n(spark):
    rows = [(10, False, 0.4), (11, True, 0.9), (12, True, None), (13, True, 0.7), (14, False, 0.95)]
    df = items(spark, [{"idx": i, "aesthetic": a} for i, _, a in rows]).withColumn("sharpness", F.lit(1.0).cast("float"))
    got = C.verdicts(df, C.Criteria(focus=0.5, top_n=2)).where("good").collect()
    assert {r.idx for r in got} == {11, 14}


def test_check_grid(spark):
    grid = [(s, e, t, c, a) for s in (0.05, 0.2, 0.5, 0.9) for e in (0.05, 0.2, 0.5, 0.9) for t, c in ((0.5, 0.9), (8.0, 0.9), (8.0, 0.05), (-6.0, 0.5)) for a in (None, 0.2, 0.9)]
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(grid)], "idx int, sharpness float, exposure float, tilt float, tilt_confidence float, aesthetic float")
    limit = C.Criteria(focus=0.5, exposure=0.2, tilt=6.0, aesthetic=0.2)
    for r in C.verdicts(df, limit).collect():
        s, e, t, c, a = grid[r.idx]
        fails = {"focus": s < 0.5, "exposure": e < 0.2} | ({"tilt": abs(t) > 6} if c >= 0.2 else {}) | ({"aesthetic": a < 0.2} if a is not None else {})
        assert {x.kind: x.fail for x in r.checks} == fails and r.good == (not any(fails.values()))


def test_explanations(spark):
    rows = [{"rank": r, "shot_time": t, "iso": i} for r, t, i in ((0.3, 100, 100), (0.9, 101, 100), (0.5, 102, 100), (0.8, 5000, 100), (0.99, 103, 6400))]
    df = C.verdicts(items(spark, rows).drop("good").withColumn("sharpness", F.lit(1.0).cast("float")), C.Criteria(focus=0.5))
    got = C.explain(C.decide(df, ["part"], C.MetaFilter(iso_max=3200), 5)).orderBy("idx").collect()
    assert [r.outcome for r in got] == ["bad", "good", "bad", "good", "excluded"]
    assert (got[0].primary[0].kind, got[0].primary[0].rank, got[0].primary[0].size) == ("burst", 3, 3) and got[3].burst_rank is None
    assert [x.kind for x in got[1].secondary] == ["focus", "burst"] and not got[1].primary
    assert [r.label for r in C.write_axis(C.explain(C.decide(df, ["part"])).withColumn("label", F.lit("hold")), "label", "pick", "reject").select("label").distinct().collect()] == ["pick"]


def test_meta_filter_bounds(spark):
    rows = [{"iso": None, "camera": None}, {"iso": 100, "camera": "Alpha ONE", "width": 2, "height": 3}, {"iso": 101, "aperture": 2.8, "width": 3, "height": 2}]
    passes = lambda **k: [r.p for r in items(spark, rows).orderBy("idx").select(C.MetaFilter(**k).passes().alias("p")).collect()]
    assert passes(iso_max=100) == [True, True, False] and passes(camera="one") == [True, True, True] and passes(camera="two") == [True, False, True]
    assert passes(portrait=True) == [True, True, False] and passes(aperture_max=2.8) == [True] * 3
    assert C.MetaFilter.from_switches({"shutter_at_least": True, "camera": True}, {"shutter_at_least": 250, "camera": " "}) == C.MetaFilter(shutter_max=0.004)


def test_random_bursts_against_a_plain_model(spark):
    rng = random.Random(3)
    rows = [{"part": rng.randrange(3), "shot_time": rng.choice([None, *range(40)]), "rank": rng.choice([0.1, 0.5, 0.9, math.nan]), "good": rng.random() < 0.8} for _ in range(120)]
    got = {r.idx: (r.decided, r.burst_rank) for r in C.decide(items(spark, rows), ["part"], None, 2, 2).collect()}
    want = {}
    for p in range(3):
        mine = sorted((i for i, r in enumerate(rows) if r["part"] == p), key=lambda i: (rows[i]["shot_time"] is None, rows[i]["shot_time"] or 0, i))
        groups, last = [], None
        for i in mine:
            t = rows[i]["shot_time"]
            if groups and t is not None and last is not None and abs(t - last) <= 2:
                groups[-1].append(i)
            else:
                groups.append([i])
            last = t
        for g in groups:
            fit = sorted((i for i in g if rows[i]["good"]), key=lambda i: (-(rows[i]["rank"] if math.isfinite(rows[i]["rank"]) else -math.inf), i))
            for i in g:
                n = fit.index(i) + 1 if i in fit and len(fit) >= 2 else None
                want[i] = (rows[i]["good"] and (n is None or n <= 2), n)
    assert got == want


def test_similarity_against_brute_force(spark):
    rng = random.Random(1)
    seeds = [rng.getrandbits(63) for _ in range(6)]
    hashes = [None, None] + [s ^ sum(1 << rng.randrange(63) for _ in range(rng.randint(0, 3))) for s in seeds for _ in range(6)]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hashes)], "idx long, h long")
    got = {r.idx: r.cluster for r in similar.clusters(df, 4, "h", "idx").collect()}
    up = list(range(len(hashes)))
    for a in range(len(hashes)):
        for b in range(a):
            if hashes[a] is not None and hashes[b] is not None and bin(hashes[a] ^ hashes[b]).count("1") <= 4:
                x, y = up[a], up[b]
                up = [min(x, y) if u in (x, y) else u for u in up]
    assert got == {i: None if h is None else up[i] for i, h in enumerate(hashes)}


def test_numbering_is_global(spark):
    df = spark.range(1000).withColumn("v", (F.col("id") * 7919 % 1000)).withColumn("size", F.col("id") % 5)
    rows = sorted(ranking.numbered(df, [F.col("v")], "place", "size", "upto").collect(), key=lambda r: r.v)
    total = 0
    for i, r in enumerate(rows):
        total += r["size"]
        assert (r.place, r.upto) == (i + 1, total)
    assert ranking.numbered(df.where("false"), [F.col("v")], "place").count() == 0


def test_large_groups_give_the_same_rows(spark, monkeypatch):
    """Groups cut into ranges against windows, with one group of half of all rows and bursts that cross ranges."""
    rng = random.Random(8)
    rows = [{"part": 1 if i % 2 else rng.randint(2, 40), "shot_time": None if rng.random() < 0.1 else rng.randint(0, 900), "rank": rng.choice([0.5, rng.random()]), "good": rng.random() < 0.8, "iso": rng.choice([100, 200, None]),
             "sharp": rng.choice([None, 0.2, rng.random()]) if i % 3 else None, "aesthetic": rng.choice([None, 0.7, math.nan])} for i in range(600)]
    df = items(spark, rows).withColumn("cluster", F.when(F.col("idx") % 5 > 0, F.col("idx") % 3).cast("long"))
    chain = items(spark, [{"shot_time": i} for i in range(300)] + [{"part": 1, "shot_time": 5}])
    whole = lambda d: sorted(tuple(r) for r in d.collect())
    order = [F.col("shot_time").isNull(), F.col("shot_time"), F.col("idx")]

    def found():
        decided = C.decide(df, ["part"], C.MetaFilter(iso_max=150), 3, 2, "cluster", 1).select("idx", "included", "burst", "burst_rank", "burst_size", "dedup_rank", "dedup_size", "decided")
        return sorted(map(str, decided.collect())), whole(C.burst_ids(chain, ["part"], order, 2).select("part", "idx", "burst")), whole(C.burst_ids(df, [], order, 4).select("idx", "burst")), C.burst_ids(chain.limit(0), ["part"], order, 2).count()

    windows = found()
    monkeypatch.setattr(C, "GROUP_ROWS", -1)
    assert found() == windows


def test_facts_of_hard_filters_and_ranks(spark):
    df = items(spark, [{"aesthetic": a, "shot_time": 10 * i} for i, a in enumerate((0.9, 0.8, 0.1))]).withColumns({"sharpness": F.lit(0.2).cast("float"), "face": F.col("idx") > 0})
    judged = C.verdicts(df.drop("good"), C.Criteria(focus=0.5, top_n=2)).withColumn("good", F.col("good") & F.col("face"))
    hard = [("face_missing", None, None, ~F.col("face"), F.lit(True))]
    got = C.explain(C.decide(judged, ["part"]), top_n=2, hard=hard).orderBy("idx").collect()
    kinds = lambda facts: [f.kind for f in facts]
    assert [(r.outcome, kinds(r.primary), kinds(r.secondary)) for r in got] == [
        ("bad", ["face_missing"], ["top_n", "focus"]), ("good", [], ["top_n", "focus"]), ("bad", ["top_n"], ["focus"]),
    ]
