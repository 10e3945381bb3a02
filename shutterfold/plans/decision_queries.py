"""Settings, metadata, folders, names and histories as whole-table queries over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import choices as C
from ..functions import exif as E
from ..functions import geo as G
from ..functions import names as N
from ..operators import scoring, selection, transfer
from .collection_queries import ITEMS, _classified, _t


def run_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as the settings of a run: what is checked, decoded, needed and missing."""
    line = _t(spark, sf_dir, "lineitem")
    q, d, flag = F.col("l_quantity"), F.col("l_discount"), F.col("l_returnflag")
    focus, tilt, face, thing = q > 25, flag == "A", flag == "R", F.col("l_linestatus") == "O"
    sharp = d > 0.08
    enabled = C.any_of([focus, tilt, face, thing, sharp])
    needs = {"aesthetic": focus & tilt, "face": face, "objects": thing}
    present = {"aesthetic": d < 0.05, "face": d < 0.07, "objects": d < 0.09}
    why = C.blockers(enabled, F.col("l_linenumber") - 1, needs, present, flag != "N", thing)
    split = F.when(d > 0.06, "stars").otherwise("none")
    system = F.when(flag == "A", "macos").when(flag == "R", "windows").otherwise("linux")
    output = (q > 20, system, d > 0.04, F.when(d > 0.02, F.lit(10)), F.col("l_linestatus") == "O")
    return line.select(
        "l_orderkey", "l_linenumber", enabled.alias("enabled"), C.decode_edge(focus, tilt, face, sharp, thing).alias("edge"),
        C.needs_aesthetic(tilt, F.col("l_linenumber") - 3, focus).alias("aesthetic"), F.array_join(why, ",").alias("blockers"), C.dead_decode(F.col("l_linenumber")).alias("dead"),
        C.worker_count(q.cast("int"), F.when(d > 0.03, (F.lit(10_000_000_000) * d).cast("long"))).alias("workers"),
        C.split_mode(split, focus, tilt).alias("split"), C.output_colour(*output).alias("colour"), C.output_kind(*output).alias("kind"),
        C.filter_active(F.when(focus, "pick").otherwise("all"), F.when(tilt, "3").otherwise("any"), F.lit("any")).alias("filtered"),
        C.guide_style((q / 8).cast("float"), F.when(face, F.lit(float("nan"))).otherwise(d * 12).cast("float")).alias("guide"),
    ).select("*", F.round("guide.weight", 4).alias("weight"), F.round("guide.opacity", 4).alias("opacity")).drop("guide")


RUN_CHOICES = """WITH s AS (SELECT *, l_quantity > 25 AS focus, l_returnflag = 'A' AS tilt, l_returnflag = 'R' AS face, l_linestatus = 'O' AS thing, l_discount > 0.08 AS sharp,
  CASE WHEN l_discount > 0.03 THEN CAST(10000000000 * l_discount AS BIGINT) END AS model FROM lineitem),
c AS (SELECT *, CASE WHEN l_quantity <= 20 THEN 'srgb' WHEN l_returnflag = 'A' AND l_discount > 0.04 THEN 'display_p3' WHEN l_returnflag = 'R' AND l_linestatus <> 'O' AND l_discount > 0.02 THEN 'icc' ELSE 'srgb' END AS colour FROM s)
SELECT l_orderkey, l_linenumber, focus OR tilt OR face OR thing OR sharp AS enabled, CASE WHEN focus THEN 1024 WHEN face OR sharp OR thing THEN 640 WHEN tilt THEN 512 ELSE 256 END AS edge,
  tilt AND (l_linenumber > 3 OR focus) AS aesthetic,
  concat_ws(',', CASE WHEN NOT (focus OR tilt OR face OR thing OR sharp) THEN 'no check' END, CASE WHEN l_linenumber <= 1 THEN 'no items' END, CASE WHEN focus AND tilt AND l_discount >= 0.05 THEN 'aesthetic missing' END,
    CASE WHEN face AND l_discount >= 0.07 THEN 'face missing' END, CASE WHEN thing AND l_discount >= 0.09 THEN 'objects missing' END, CASE WHEN thing AND l_returnflag = 'N' THEN 'unknown class' END) AS blockers,
  l_linenumber >= 5 AS dead, CAST(greatest(1, least(CAST(trunc(l_quantity) AS BIGINT), CASE WHEN model IS NULL THEN 12 ELSE greatest(2000000000 // model, 1) END, 12)) AS INTEGER) AS workers,
  CASE WHEN l_discount > 0.06 THEN 'stars' WHEN focus THEN 'label' WHEN tilt THEN 'tag' ELSE 'none' END AS split, colour, CASE WHEN l_quantity > 20 AND colour = 'srgb' THEN 'srgb_fallback' ELSE colour END AS kind,
  focus OR tilt AS filtered, round(greatest(1, least(4, CAST(CAST(l_quantity / 8 AS FLOAT) AS DOUBLE))), 4) AS weight, round(greatest(0.2, least(1, CASE WHEN face THEN 0.8 ELSE CAST(CAST(l_discount * 12 AS FLOAT) AS DOUBLE) END)), 4) AS opacity
FROM c"""


def next_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the filter key leads from every order's label, and items per step."""
    o = _classified(spark, sf_dir)
    return o.groupBy(F.col("label"), C.next_filter(F.col("label")).alias("after")).agg(F.count("*").alias("n"))


def photo_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata texts of every line item to numbers, displayed size, colour of the input and turn of the header."""
    line = _t(spark, sf_dir, "lineitem")
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    some = F.col("l_returnflag") != "N"
    texts = {
        "iso": F.when(some, F.concat(F.lit("ISO "), (q * 100).cast("string"))), "aperture": F.when(some, F.concat(F.lit("f/"), n.cast("string"), F.lit(".8"))),
        "shutter": F.when(some, F.concat(F.lit("1/"), q.cast("string"), F.lit(" s"))), "focal": F.when(some, F.concat(q.cast("string"), F.lit(".0 mm"))),
        "datetime": F.when(some, F.date_format("l_shipdate", "yyyy:MM:dd HH:mm:ss")), "width": F.when(some, q * 10), "height": q * 7, "orientation": n + 1,
        "camera": F.when(some, F.concat(F.lit("Body "), n.cast("string"))), "lens": F.lit(None).cast("string"), "gps": F.lit(None).cast("string"),
    }
    meta = E.photo_meta(texts)
    found = line.select("l_orderkey", "l_linenumber", meta.alias("m"), E.is_empty(texts).alias("empty"), E.rotation_orientation(n * 90 - 90).alias("turn"),
        E.input_colour(F.when(n == 1, F.lit("abc")), F.when(n <= 4, 0xFFFF), F.when(n != 3, F.lit(" r03\0"))).alias("colour"))
    return found.select("l_orderkey", "l_linenumber", "m.iso", F.round(F.col("m.aperture").cast("double"), 3).alias("aperture"), F.round(F.col("m.shutter").cast("double"), 5).alias("shutter"), F.col("m.focal").cast("double").alias("focal"), "m.taken", "m.width", "m.height", "m.camera", "empty", "turn", "colour")


PHOTO_META = """WITH s AS (SELECT *, l_returnflag <> 'N' AS has, CAST(trunc(l_quantity) AS INTEGER) AS q FROM lineitem), z AS (SELECT *, CASE WHEN has THEN q * 10 END AS w, q * 7 AS h, l_linenumber + 1 BETWEEN 5 AND 8 AS turned FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN has THEN q * 100 END AS iso, CASE WHEN has THEN round(CAST(l_linenumber + 0.8 AS DOUBLE), 3) END AS aperture, CASE WHEN has THEN round(1.0::DOUBLE / q, 5) END AS shutter,
  CASE WHEN has THEN CAST(q AS DOUBLE) END AS focal, CASE WHEN has THEN CAST(epoch(date_trunc('second', l_shipdate)) AS BIGINT) END AS taken, CASE WHEN turned THEN h ELSE w END AS width, CASE WHEN turned THEN w ELSE h END AS height,
  CASE WHEN has THEN 'Body ' || l_linenumber END AS camera, NOT has AS empty, CASE l_linenumber WHEN 2 THEN 6 WHEN 3 THEN 3 WHEN 4 THEN 8 ELSE 1 END AS turn,
  CASE WHEN l_linenumber = 1 THEN 'icc' WHEN l_linenumber <= 4 AND l_linenumber <> 3 THEN 'adobe_rgb' ELSE 'srgb' END AS colour FROM z"""


def exif_dates_messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture dates as devices and people write them; what is no date is null."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderkey") % 9).alias("k"))
    day, time = F.date_format("o_orderdate", "yyyy:MM:dd"), F.date_format("o_orderdate", "HH:mm:ss")
    forms: list[Column] = [
        F.concat(day, F.lit(" "), time), F.concat(day, F.lit("T"), time), F.concat(day, F.lit(" "), time, F.lit(".50")), F.concat(day, F.lit(" "), time, F.lit(" x")),
        F.concat(F.translate(day, ":", "-"), F.lit(" "), time, F.lit(" ")), F.concat(day, F.lit(" "), F.date_format("o_orderdate", "HH:mm")), F.concat(day, F.lit("  "), time),
        F.concat(F.lit("2024:13:01 "), time), F.concat(F.lit(" "), day, F.lit(" "), time, F.lit(":7")),
    ]
    text = F.coalesce(*(F.when(F.col("k") == i, f) for i, f in enumerate(forms)))
    return o.select("o_orderkey", E.epoch_seconds(text).alias("seconds"), N.date_folder(text, F.lit(None).cast("timestamp")).alias("folder"))


EXIF_DATES_MESSY = """SELECT o_orderkey, CASE WHEN k IN (0, 4, 8) THEN CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT) WHEN k = 5 THEN CAST(epoch(date_trunc('minute', o_orderdate)) AS BIGINT) END AS seconds,
  CASE WHEN k = 7 THEN '2024-13-01' WHEN k IN (1, 4) THEN 'unknown-date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS folder FROM (SELECT *, o_orderkey % 9 AS k FROM orders)"""


def _camera_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as files with the metadata of their part and supplier."""
    line, part, supplier = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part"), _t(spark, sf_dir, "supplier")
    joined = line.join(part.select("p_partkey", "p_brand", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey")).join(supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    ext = F.when(F.col("l_linenumber") % 3 == 0, ".nef").when(F.col("l_linenumber") % 3 == 1, "..JPG").otherwise("")
    camera = F.when(F.col("p_size") > 40, F.concat(F.lit(" ."), "p_brand", F.lit("/X. "))).when(F.col("p_size") > 10, F.col("p_brand")).when(F.col("p_size") > 5, " . ")
    return joined.select(
        F.col("l_orderkey").alias("item_id"), F.col("l_orderkey").alias("pos"), F.concat(F.lit("/in/_DSC"), "l_orderkey", F.lit("_"), "l_linenumber", ext).alias("path"),
        F.when(F.col("l_returnflag") != "N", F.date_format("l_shipdate", "yyyy:MM:dd HH:mm:ss")).alias("exif_date"), F.lit(None).cast("timestamp").alias("modified"),
        camera.alias("camera"), F.when(F.col("l_returnflag") == "A", F.col("s_name")).alias("lens"), F.concat(F.col("p_size").cast("string"), F.lit(".5.1 mm")).alias("focal"),
    )


def organise_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per target folder by every key of organising."""
    files = _camera_files(spark, sf_dir)
    out = None
    for by in ("date", "camera", "lens", "focal", "extension"):
        planned = transfer.organise(files, "/out/", by)
        counted = planned.groupBy("folder").agg(F.count("*").alias("files")).withColumn("by", F.lit(by))
        out = counted if out is None else out.unionByName(counted)
    return out


ORGANISE_FOLDERS = """WITH f AS (SELECT l_linenumber, l_returnflag, l_shipdate, p_brand, p_size, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT '/out/' || CASE WHEN l_returnflag <> 'N' THEN strftime(l_shipdate, '%Y-%m-%d') ELSE 'unknown-date' END AS folder, count(*) AS files, 'date' AS by FROM f GROUP BY 1
UNION ALL SELECT '/out/' || CASE WHEN p_size > 40 THEN p_brand || '_X' WHEN p_size > 10 THEN p_brand ELSE 'unknown-camera' END, count(*), 'camera' FROM f GROUP BY 1
UNION ALL SELECT '/out/' || CASE WHEN l_returnflag = 'A' THEN s_name ELSE 'unknown-lens' END, count(*), 'lens' FROM f GROUP BY 1
UNION ALL SELECT '/out/unknown-focal', count(*), 'focal' FROM f HAVING count(*) > 0
UNION ALL SELECT '/out/' || CASE l_linenumber % 3 WHEN 0 THEN 'NEF' WHEN 1 THEN 'JPG' ELSE 'unknown-ext' END, count(*), 'extension' FROM f GROUP BY 1"""


def split_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-folders of all orders under the three ways to split, with star counts beyond five."""
    o = _classified(spark, sf_dir).withColumn("stars", F.col("stars") * 2)
    ways = F.array(*(F.struct(F.lit(by).alias("by"), N.split_folder(F.col("label"), F.col("stars"), F.col("tag"), by).alias("folder")) for by in ("label", "stars", "tag")))
    return o.select(F.inline(ways)).groupBy("by", "folder").agg(F.count("*").alias("items"))


SPLIT_FOLDERS = f"""WITH {ITEMS}, w AS (SELECT label, CASE WHEN stars >= 1 THEN least(stars * 2, 5) || 'star' ELSE 'unrated' END AS star, tag FROM items)
SELECT 'label' AS by, CASE WHEN label <> 'unrated' THEN label ELSE star END AS folder, count(*) AS items FROM w GROUP BY 2 UNION ALL SELECT 'stars', star, count(*) FROM w GROUP BY 2 UNION ALL SELECT 'tag', '@' || coalesce(tag, 'untagged'), count(*) FROM w GROUP BY 2"""


def reason_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value and limit of a failed check as text that shows which is less."""
    p = _t(spark, sf_dir, "part")
    value, limit = (F.col("p_retailprice") / 2500).cast("float"), (F.round(F.col("p_retailprice") / 2500, 2) + F.col("p_size") / 1e6).cast("float")
    shown = p.select("p_partkey", value.alias("v"), limit.alias("m")).where("v < m").select("p_partkey", C.compared_numbers(F.col("v"), F.col("m"), 2, True).alias("t"))
    return shown.select("p_partkey", "t.value", "t.limit")


REASON_NUMBERS = """WITH s AS (SELECT p_partkey, CAST(CAST(p_retailprice / 2500 AS FLOAT) AS DOUBLE) AS v, CAST(CAST(round(p_retailprice / 2500, 2) + p_size / 1e6 AS FLOAT) AS DOUBLE) AS m FROM part),
t AS (SELECT *, printf('%.2f', v) AS v2, printf('%.2f', m) AS m2, printf('%.3f', v) AS v3, printf('%.3f', m) AS m3, printf('%.4f', v) AS v4, printf('%.4f', m) AS m4 FROM s WHERE v < m)
SELECT p_partkey, CASE WHEN CAST(v2 AS DOUBLE) < CAST(m2 AS DOUBLE) THEN v2 WHEN CAST(v3 AS DOUBLE) < CAST(m3 AS DOUBLE) THEN v3 WHEN CAST(v4 AS DOUBLE) < CAST(m4 AS DOUBLE) THEN v4 ELSE printf('%.4f', floor(v * 10000) / 10000) END AS value,
  CASE WHEN CAST(v2 AS DOUBLE) < CAST(m2 AS DOUBLE) THEN m2 WHEN CAST(v3 AS DOUBLE) < CAST(m3 AS DOUBLE) THEN m3 WHEN CAST(v4 AS DOUBLE) < CAST(m4 AS DOUBLE) THEN m4 ELSE printf('%.4f', ceil(m * 10000) / 10000) END AS "limit" FROM t"""

KINDS = ["steel", "brass", "copper pipe", "tin", "nickel", "plated steel"]


def class_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class that each part type names: exactly, or by the first name that holds it or is held by it."""
    p = _t(spark, sf_dir, "part")
    word = F.when(F.col("p_size") > 30, F.element_at(F.split("p_type", " "), -1)).when(F.col("p_size") > 5, F.col("p_type")).otherwise(F.lit(" "))
    return p.select("p_partkey", scoring.class_number(word, KINDS).alias("class"))


CLASS_NUMBERS = f"""WITH w AS (SELECT p_partkey, lower(trim(CASE WHEN p_size > 30 THEN string_split(p_type, ' ')[-1] WHEN p_size > 5 THEN p_type ELSE ' ' END)) AS t FROM part), k AS (SELECT unnest({KINDS}) AS name, unnest(range({len(KINDS)})) AS i)
SELECT p_partkey, CAST(coalesce(min(CASE WHEN name = t THEN i END), min(CASE WHEN contains(name, t) OR contains(t, name) THEN i END)) AS INTEGER) AS class FROM w LEFT JOIN k ON t <> '' GROUP BY p_partkey"""


def history_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's label after half of all edits: later ones are undone, and redone by a later step."""
    e = _t(spark, sf_dir, "events")
    items = e.select(F.col("user_id").alias("item_id"), F.lit("unrated").alias("label")).distinct()
    log = e.select(F.col("event_id").alias("step"), F.col("user_id").alias("item_id"), F.lit("unrated").alias("old_label"), F.col("event_type").alias("label"))
    half = 500
    return selection.at_step(items, log, half)


HISTORY_STATES = "SELECT user_id AS item_id, coalesce(arg_max(event_type, event_id) FILTER (event_id <= 500), 'unrated') AS label FROM events GROUP BY user_id"


def edited_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history of all orders' edits after a new edit at step 1,000."""
    o = _classified(spark, sf_dir).select(F.col("item_id").alias("step"), "item_id", F.lit("unrated").alias("old_label"), "label")
    new = _t(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("item_id"), F.lit("unrated").alias("old_label"), F.lit("pick").alias("label"))
    return selection.edited(o, new, 1000).select("step", "item_id", "old_label", "label")


EDITED_LOG = f"WITH {ITEMS} SELECT item_id AS step, item_id, 'unrated' AS old_label, label FROM items WHERE item_id <= 1000 AND item_id > 701 UNION ALL SELECT 1001, r_regionkey, 'unrated', 'pick' FROM region"


def after_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the view goes after each order is rated, among the orders that its customer still shows."""
    o = _classified(spark, sf_dir).withColumn("shown", F.col("label") != "hold")
    shown = o.groupBy("o_custkey").agg(F.count_if("shown").alias("n"))
    return o.join(shown, "o_custkey").select("item_id", selection.place_after_rating(F.col("stars").cast("long"), F.col("shown"), F.col("n")).alias("place"))


AFTER_RATING = f"""WITH {ITEMS}, n AS (SELECT o_custkey, count(*) FILTER (label <> 'hold') AS n FROM items GROUP BY o_custkey)
SELECT item_id, CASE WHEN n > 0 THEN least(CASE WHEN label <> 'hold' THEN stars + 1 ELSE stars END, n - 1) END AS place FROM items JOIN n USING (o_custkey)"""


def visible_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected orders that the label filter shows, results of the current generation and the last touch of each user."""
    o, e = _classified(spark, sf_dir), _t(spark, sf_dir, "events")
    seen = selection.visible(o.where("stars >= 3"), o.where("label = 'pick'")).select(F.lit("visible").alias("what"), F.col("item_id").alias("id"))
    fresh = selection.of_generation(e.withColumn("generation", F.length("event_type")), 5).select(F.lit("fresh").alias("what"), F.col("event_id").alias("id"))
    touched = selection.last_touches(e, "user_id", "event_id").select(F.lit("touched").alias("what"), F.col("event_id").alias("id"))
    kept = selection.place_after_filter(o.where("label = 'pick'"), [F.col("item_id")], 77).select(F.lit("place").alias("what"), F.col("place").alias("id"))
    return seen.unionByName(fresh).unionByName(touched).unionByName(kept)


VISIBLE_SELECTION = f"""WITH {ITEMS} SELECT 'visible' AS what, item_id AS id FROM items WHERE stars >= 3 AND label = 'pick' UNION ALL SELECT 'fresh', event_id FROM events WHERE length(event_type) = 5
UNION ALL SELECT 'touched', max(event_id) FROM events GROUP BY user_id UNION ALL SELECT 'place', coalesce(min(i) FILTER (item_id = 77), 0) FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM items WHERE label = 'pick')"""


def focus_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Focus points in focus of every part, in display coordinates."""
    p = _t(spark, sf_dir, "part")
    x, y = F.col("p_size") / 64.0, F.col("p_partkey") % 8 / 8.0
    point = lambda a, b, ok: F.struct(a.cast("double").alias("cx"), b.cast("double").alias("cy"), F.lit(0.25).alias("w"), F.lit(0.125).alias("h"), ok.alias("in_focus"), F.lit(True).alias("selected"))
    regions = G.focus_regions(F.array(point(x, y, F.col("p_size") > 20), point(y, x, F.col("p_size") > 40)), (F.col("p_partkey") % 4 * 2 + 1).cast("int"))
    return p.select("p_partkey", F.posexplode(regions).alias("place", "r")).select("p_partkey", "place", "r.cx", "r.cy", "r.w", "r.h")


FOCUS_AREAS = """WITH s AS (SELECT p_partkey, p_size, p_size / 64.0::DOUBLE AS x, (p_partkey % 8) / 8.0::DOUBLE AS y, p_partkey % 4 * 2 + 1 AS o FROM part),
q AS (SELECT p_partkey, 0 AS place, x AS cx, y AS cy, o FROM s WHERE p_size > 20 UNION ALL SELECT p_partkey, 1, y, x, o FROM s WHERE p_size > 40)
SELECT p_partkey, CAST(place AS INTEGER) AS place, CASE o WHEN 3 THEN 1 - cx WHEN 5 THEN cy WHEN 7 THEN 1 - cy ELSE cx END AS cx, CASE o WHEN 3 THEN 1 - cy WHEN 5 THEN cx WHEN 7 THEN 1 - cx ELSE cy END AS cy,
  CASE WHEN o >= 5 THEN 0.125::DOUBLE ELSE 0.25::DOUBLE END AS w, CASE WHEN o >= 5 THEN 0.25::DOUBLE ELSE 0.125::DOUBLE END AS h FROM q"""


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, extension, stem and key of names with several dots, none, or a leading one."""
    d = _t(spark, sf_dir, "documents")
    k = F.col("doc_id") % 6
    name = F.coalesce(*(F.when(k == i, F.concat(*parts)) for i, parts in enumerate([
        (F.lit("_DSC"), F.col("doc_id"), F.lit(".NEF")), (F.lit("a"), F.col("doc_id"), F.lit("..jpg")), (F.lit(".hidden"), F.col("doc_id")), (F.lit("b.c"), F.col("doc_id"), F.lit(".d.HEIC")), (F.lit("plain"), F.col("doc_id")), (F.lit("e"), F.col("doc_id"), F.lit(".")),
    ])))
    path = F.concat(F.lit("/p\\q/"), name)
    ext = N.extension(path)
    return d.select("doc_id", ext.alias("ext"), N.stem(path).alias("stem"), N.kind(ext).alias("kind"), N.item_key(path, "/p").alias("key"))


FILE_NAMES = """SELECT doc_id, CASE k WHEN 0 THEN 'nef' WHEN 1 THEN 'jpg' WHEN 3 THEN 'heic' END AS ext,
  CASE k WHEN 0 THEN '_DSC' || doc_id WHEN 1 THEN 'a' || doc_id || '.' WHEN 2 THEN '.hidden' || doc_id WHEN 3 THEN 'b.c' || doc_id || '.d' WHEN 4 THEN 'plain' || doc_id ELSE 'e' || doc_id END AS stem,
  CASE k WHEN 0 THEN 'raw' WHEN 1 THEN 'image' WHEN 3 THEN 'image' END AS kind,
  'q/' || CASE k WHEN 0 THEN '_DSC' || doc_id WHEN 1 THEN 'a' || doc_id || '.' WHEN 2 THEN '.hidden' || doc_id WHEN 3 THEN 'b.c' || doc_id || '.d' WHEN 4 THEN 'plain' || doc_id ELSE 'e' || doc_id END AS key
FROM (SELECT doc_id, doc_id % 6 AS k FROM documents)"""


QUERIES = {
    f.__name__: f
    for f in (
        run_choices, next_filters, photo_meta, exif_dates_messy, organise_folders, split_folders, reason_numbers, class_numbers, history_states, edited_log, after_rating, visible_selection, focus_areas, file_names,
    )
}
ORACLES = {
    "run_choices": RUN_CHOICES,
    "next_filters": f"WITH {ITEMS} SELECT label, CASE label WHEN 'pick' THEN 'hold' WHEN 'hold' THEN 'reject' WHEN 'unrated' THEN 'all' END AS after, count(*) AS n FROM items GROUP BY label",
    "photo_meta": PHOTO_META, "exif_dates_messy": EXIF_DATES_MESSY, "organise_folders": ORGANISE_FOLDERS, "split_folders": SPLIT_FOLDERS, "reason_numbers": REASON_NUMBERS, "class_numbers": CLASS_NUMBERS,
    "history_states": HISTORY_STATES, "edited_log": EDITED_LOG, "after_rating": AFTER_RATING, "visible_selection": VISIBLE_SELECTION, "focus_areas": FOCUS_AREAS, "file_names": FILE_NAMES,
}
