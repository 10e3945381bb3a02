"""Names, captions, sizes, filters, reports and histories as whole-table queries over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import pixels as P
from ..operators import cache, culling, labels, pairing, ranking, selection, transfer
from .collection_queries import ITEMS, TRANSFER, _classified, _t, _transfer_items


def supported_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a card: which are media outside system folders."""
    d = _t(spark, sf_dir, "documents")
    folder = F.when(F.col("lang") == "de", F.lit("/$Recycle.Bin")).when(F.col("lang") == "fr", F.lit("/a/.TRASHES/b")).otherwise(F.lit("/a"))
    name = F.concat(F.when(F.col("doc_id") % 5 == 0, F.lit("._")).otherwise("_"), F.col("doc_id"), F.when(F.col("doc_id") % 3 == 0, F.lit(".txt")).otherwise(".ORF"))
    paths = d.select("doc_id", F.concat(F.lit("/root"), folder, F.lit("/"), name).alias("path"))
    return pairing.supported_files(paths, "path", "/root")


SUPPORTED_NAMES = "SELECT doc_id, '/root/a/_' || doc_id || '.ORF' AS path FROM documents WHERE lang NOT IN ('de', 'fr') AND doc_id % 5 <> 0 AND doc_id % 3 <> 0"


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, versions, colours and captions of all parts as the screens show them."""
    p = _t(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    bytes_ = (F.pow(F.lit(10.0), size / 5) * 7).cast("long")
    version = N.version(F.concat(F.when(k % 2 == 0, "v").otherwise(" "), size.cast("string"), F.when(k % 3 == 0, ".4").when(k % 3 == 1, ".0.7-rc1").otherwise(".x")))
    colour = N.hex_colour(F.concat(F.lit("#"), F.lpad(F.hex(k), 6, "0"), F.when(k % 7 == 0, "g").otherwise("")))
    lines = N.caption(F.col("p_brand"), F.when(k % 2 == 0, " ").otherwise(F.col("p_type")), F.lit("f/4"), size.cast("string"), F.when(k % 5 > 0, F.lit("200")), F.lit(None).cast("string"), F.lit("2031:04:05 06:07"))
    return p.select(
        "p_partkey", N.size_text(bytes_).alias("size"), F.concat_ws(".", version["major"], version["minor"], version["patch"]).alias("version"),
        N.colour_text(colour["r"], colour["g"], colour["b"]).alias("colour"), F.array_join(lines, "|").alias("caption"), N.grade(size % 7).alias("grade"),
        P.luma(size * 5, k % 256, F.lit(9)).alias("luma"), P.hash_luma(size * 5, k % 256, F.lit(9)).cast("long").alias("hash_luma"),
    )


TEXT_FORMS = """WITH s AS (SELECT *, CAST(trunc(pow(10.0::DOUBLE, p_size / 5.0) * 7) AS BIGINT) AS n FROM part)
SELECT p_partkey, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.0f KB', n / 1024.0::DOUBLE) ELSE n || ' B' END AS size,
  CASE p_partkey % 3 WHEN 0 THEN p_size || '.4.0' WHEN 1 THEN p_size || '.0.7' ELSE '' END AS version, CASE WHEN p_partkey % 7 > 0 THEN '#' || lpad(upper(to_hex(p_partkey)), 6, '0') END AS colour,
  p_brand || CASE WHEN p_partkey % 2 = 1 THEN '|' || p_type ELSE '' END || '|f/4  ' || p_size || 's' || CASE WHEN p_partkey % 5 > 0 THEN '  ISO 200' ELSE '' END || '|2031.04.05 06:07' AS caption,
  CASE p_size % 7 WHEN 1 THEN 'E' WHEN 2 THEN 'D' WHEN 3 THEN 'C' WHEN 4 THEN 'B' WHEN 5 THEN 'A' ELSE '' END AS grade, (54 * p_size * 5 + 183 * (p_partkey % 256) + 171) // 256 AS luma, (30 * p_size * 5 + 59 * (p_partkey % 256) + 99) // 100 AS hash_luma FROM s"""


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder, name, key and display rank of order files with both kinds of slashes."""
    o = _t(spark, sf_dir, "orders")
    ext = F.element_at(F.array(*map(F.lit, ("JPEG", "heif", "TIFF", "Dng", "webp"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    path = F.concat(F.lit("\\Shots\\"), F.substring("o_orderpriority", 3, 20), F.lit("/F"), F.col("o_orderkey"), F.lit("."), ext)
    e = N.extension(path)
    return o.select("o_orderkey", N.parent(path).alias("folder"), N.file_name(path).alias("name"), N.normal_key(N.item_key(path, "/Shots")).alias("key"), N.family(e).alias("family"), N.display_rank(e).alias("rank"))


PATH_PARTS = """SELECT o_orderkey, '/Shots/' || substr(o_orderpriority, 3, 20) AS folder, 'F' || o_orderkey || '.' || ['JPEG', 'heif', 'TIFF', 'Dng', 'webp'][o_orderkey % 5 + 1] AS name,
  translate(substr(o_orderpriority, 3, 20), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '/f' || o_orderkey AS key, ['jpg', 'heic', 'tif', 'dng', 'webp'][o_orderkey % 5 + 1] AS family, [1, 3, 6, 98, 7][o_orderkey % 5 + 1] AS rank FROM orders"""


def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose metadata fits bounds that come from switches; unknown values pass."""
    line = _t(spark, sf_dir, "lineitem")
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    known = F.col("l_returnflag") != "N"
    shots = line.select(
        "l_orderkey", "l_linenumber", F.when(known, q * 100).alias("iso"), F.when(known, n * 1.4).cast("float").alias("aperture"), F.when(known, 1.0 / q).cast("float").alias("shutter"), (q * 4.0).cast("float").alias("focal"),
        (q * 10).alias("width"), F.lit(250).alias("height"), F.concat(F.lit("Kin "), F.col("l_linestatus")).alias("camera"), F.lit(None).cast("string").alias("lens"),
    )
    switches = dict.fromkeys(("iso_max", "aperture_min", "shutter_at_least", "focal_max", "camera", "portrait", "lens"), True) | {"iso_min": False}
    limits = {"iso_max": 3200, "iso_min": 9999, "aperture_min": 2.8, "shutter_at_least": 10, "focal_max": 160, "camera": " kin o ", "portrait": False, "lens": "  "}
    return shots.where(culling.MetaFilter.from_switches(switches, limits).passes()).select("l_orderkey", "l_linenumber")


METADATA_FILTER = """WITH s AS (SELECT *, CAST(trunc(l_quantity) AS INTEGER) AS q, l_returnflag <> 'N' AS known FROM lineitem)
SELECT l_orderkey, l_linenumber FROM s WHERE (NOT known OR (q * 100 <= 3200 AND CAST(l_linenumber * 1.4 AS FLOAT) >= CAST(2.8 AS FLOAT) AND CAST(1.0::DOUBLE / q AS FLOAT) <= CAST(0.1 AS FLOAT))) AND q * 4 <= 160 AND q * 10 >= 250 AND l_linestatus = 'O'"""


def transfer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a transfer of all line items' files."""
    line = _t(spark, sf_dir, "lineitem")
    status = F.element_at(F.array(*map(F.lit, ("sent", "sent", "skipped", "in_place", "failed", "sent", "sent"))), F.col("l_linenumber"))
    path = F.concat(F.lit("/in/f"), F.col("l_orderkey"), F.when(F.col("l_returnflag") == "R", ".NEF").otherwise(".jpg"))
    final = F.when(F.col("l_linestatus") == "O", N.file_name(path)).otherwise(F.concat(F.lit("new"), N.file_name(path)))
    return transfer.report(line.select(path.alias("path"), final.alias("final_name"), status.alias("status"), F.col("l_suppkey").alias("size")))


TRANSFER_REPORT = """WITH s AS (SELECT *, l_linenumber IN (1, 2, 6, 7) AS sent FROM lineitem)
SELECT count(*) FILTER (sent AND l_returnflag = 'R') AS raw, count(*) FILTER (sent AND l_returnflag <> 'R') AS images, count(*) FILTER (sent) AS transferred, count(*) FILTER (l_linenumber = 3) AS skipped, count(*) FILTER (l_linenumber = 4) AS in_place,
  CAST(coalesce(sum(l_suppkey) FILTER (sent), 0) AS BIGINT) AS bytes, count(*) FILTER (l_linenumber = 5) AS failures, count(*) FILTER (sent AND l_linestatus <> 'O') AS renames FROM s"""


def decided_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of all orders put on their labels; excluded ones keep theirs."""
    o = _classified(spark, sf_dir).withColumn("outcome", F.when(F.col("stars") >= 3, "good").when(F.col("stars") >= 1, "bad").otherwise("excluded"))
    return culling.write_axis(o, "label", "pick", "reject").select("item_id", "label")


DECIDED_LABELS = f"WITH {ITEMS} SELECT item_id, CASE WHEN stars >= 3 THEN 'pick' WHEN stars >= 1 THEN 'reject' ELSE label END AS label FROM items"


def cluster_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best shots of every cluster of a user (here: whole values), bad and excluded ones aside."""
    e = _t(spark, sf_dir, "events")
    shots = e.select(
        "user_id", F.col("event_id").alias("idx"), (F.col("event_type") != "error").alias("good"), F.col("value").cast("float").alias("rank"), F.lit(None).cast("float").alias("aesthetic"), F.lit(None).cast("float").alias("sharp"),
        F.unix_timestamp("ts").alias("shot_time"), F.col("value").cast("int").alias("iso"), F.floor(F.col("value") / 10).cast("long").alias("cluster"),
    )
    found = culling.decide(shots, ["user_id"], culling.MetaFilter(iso_min=5), None, 1, "cluster", 2)
    return found.select("idx", "included", "decided", "dedup_rank", "dedup_size")


CLUSTER_BEST = """WITH s AS (SELECT user_id, event_id AS idx, event_type <> 'error' AS good, CAST(value AS REAL) AS rank, CAST(trunc(value) AS INTEGER) >= 5 AS included, CAST(floor(value / 10) AS BIGINT) AS cluster FROM events),
c AS (SELECT *, good AND included AS competes, sum(CASE WHEN good AND included THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, CASE WHEN included THEN cluster END, included) AS size,
  row_number() OVER (PARTITION BY user_id, CASE WHEN included THEN cluster END, included, good AND included ORDER BY rank DESC, idx) AS place FROM s)
SELECT idx, included, competes AND NOT (size >= 2 AND place > 2) AS decided, CASE WHEN competes AND size >= 2 THEN place END AS dedup_rank, CASE WHEN competes AND size >= 2 THEN size END AS dedup_size FROM c"""


def label_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bulk edit of all orders taken back, and the one order that a number jumps to."""
    o = _classified(spark, sf_dir).select("item_id", "label")
    edited = selection.relabel(o, F.col("item_id") % 3 == 0, "pick", toggle=True)
    back = selection.undo(edited.select("item_id", "label"), edited)
    jumped = selection.jump_to_number(o, [F.col("item_id").desc()], 7).select("item_id", F.lit("jump").alias("label"))
    return back.unionByName(jumped)


LABEL_UNDO = f"WITH {ITEMS} SELECT item_id, label FROM items UNION ALL SELECT item_id, 'jump' FROM (SELECT item_id, row_number() OVER (ORDER BY item_id DESC) AS n FROM items) WHERE n = 7"


def cache_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a cache of all documents, and its newest hundred."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), (F.col("doc_id") % 1000).alias("mtime"), F.col("n_chars").alias("size"))
    whole = cache.totals(d).select(F.lit("all").alias("what"), F.col("files").alias("a"), F.col("bytes").alias("b"))
    return whole.unionByName(cache.newest(d, 100).select(F.lit("newest").alias("what"), F.col("path").alias("a"), F.col("mtime").alias("b")))


CACHE_STATE = "SELECT 'all' AS what, count(*) AS a, CAST(sum(n_chars) AS BIGINT) AS b FROM documents UNION ALL SELECT * FROM (SELECT 'newest', doc_id, doc_id % 1000 FROM documents ORDER BY doc_id % 1000 DESC, doc_id LIMIT 100)"


def modified_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items, newest first, names in natural order within a day."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("modified"), F.concat(F.lit("/s/f"), F.col("o_orderkey"), F.lit(".jpg")).alias("display"))
    from ..sources.files import scan_order

    return ranking.numbered(o, scan_order("modified"), "place").select("o_orderkey", "place")


MODIFIED_ORDER = "SELECT o_orderkey, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS place FROM orders"


def job_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, files and outcomes of a job over all orders with line items."""
    o = _transfer_items(spark, sf_dir)
    outcome = F.when(F.col("label") == "pick", "good").when(F.col("label") == "hold", "bad").otherwise("skipped")
    return o.agg(F.count("*").alias("items"), F.sum(F.size("members")).alias("files"), *(F.count_if(outcome == k).alias(k) for k in ("good", "bad", "skipped")))


JOB_TOTALS = f"""WITH {TRANSFER}, m AS (SELECT item_id, any_value(label) AS label, count(*) AS n FROM items JOIN files ON item_id = l_orderkey GROUP BY item_id)
SELECT count(*) AS items, CAST(sum(n) AS BIGINT) AS files, count(*) FILTER (label = 'pick') AS good, count(*) FILTER (label = 'hold') AS bad, count(*) FILTER (label NOT IN ('pick', 'hold')) AS skipped FROM m"""


def rename_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty pairs of old and new names that a preview shows, over the whole scope."""
    planned = transfer.plan(_transfer_items(spark, sf_dir), transfer.selected(split=True), "raw")
    return transfer.renamed(planned, "{seq:04}-{orig}").orderBy("seq", "slot").limit(20).select("path", "new_name")


RENAME_FIRST = f"""WITH {TRANSFER}, raw AS (SELECT item_id, path, row_number() OVER (PARTITION BY item_id ORDER BY path) AS slot FROM items JOIN files ON item_id = l_orderkey WHERE path LIKE '%.NEF'),
n AS (SELECT *, dense_rank() OVER (ORDER BY item_id) AS seq FROM raw)
SELECT path, lpad(CAST(seq AS VARCHAR), 4, '0') || '-' || (SELECT regexp_extract(min(f.path), '([^/]*)\\.[A-Za-z]*$', 1) FROM files f WHERE f.l_orderkey = n.item_id) || '.NEF' AS new_name FROM n ORDER BY seq, slot LIMIT 20"""


def shown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all orders in one language, with the user's own name for one of them."""
    names = spark.createDataFrame([("en", "pick", "Keep"), ("en", "hold", "Later"), ("de", "pick", "Behalten"), ("de", "unrated", "Offen")], "lang string, value string, name string")
    custom = spark.createDataFrame([("hold", "Second look"), ("pick", " ")], "value string, own string")
    return labels.named(_classified(spark, sf_dir), names, "de", custom=custom).groupBy("label", "name").agg(F.count("*").alias("n"))


SHOWN_NAMES = f"WITH {ITEMS} SELECT label, CASE label WHEN 'pick' THEN 'Behalten' WHEN 'hold' THEN 'Second look' WHEN 'unrated' THEN 'Offen' ELSE label END AS name, count(*) AS n FROM items GROUP BY label"


def real_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all parts, listed with decomposed letters, found by composed names."""
    p = _t(spark, sf_dir, "part")
    tail = F.concat(F.col("p_partkey"), F.lit(".jpg"))
    there = p.where("p_size > 10").select(F.concat(F.when(F.col("p_size") > 30, "/a/Cafe\u0301-").otherwise("/a/Caf\u00e9-"), tail).alias("path"))
    wanted = p.select("p_partkey", F.concat(F.lit("/a/Caf\u00e9-"), tail).alias("path"))
    return labels.real_paths(wanted, there).select("p_partkey", "real")


REAL_PATHS = """WITH there AS (SELECT '/a/Caf' || CASE WHEN p_size > 30 THEN 'e' || chr(769) ELSE chr(233) END || '-' || p_partkey || '.jpg' AS path FROM part WHERE p_size > 10)
SELECT p_partkey, min(path) AS real FROM part LEFT JOIN there ON nfc_normalize(path) = nfc_normalize('/a/Caf' || chr(233) || '-' || p_partkey || '.jpg') GROUP BY p_partkey"""


QUERIES = {
    f.__name__: f
    for f in (supported_names, text_forms, path_parts, metadata_filter, transfer_report, decided_labels, cluster_best, label_undo, cache_state, modified_order, job_totals, rename_first, shown_names, real_paths)
}
ORACLES = {
    "supported_names": SUPPORTED_NAMES, "text_forms": TEXT_FORMS, "path_parts": PATH_PARTS, "metadata_filter": METADATA_FILTER, "transfer_report": TRANSFER_REPORT, "decided_labels": DECIDED_LABELS, "cluster_best": CLUSTER_BEST,
    "label_undo": LABEL_UNDO, "cache_state": CACHE_STATE, "modified_order": MODIFIED_ORDER, "job_totals": JOB_TOTALS, "rename_first": RENAME_FIRST, "shown_names": SHOWN_NAMES, "real_paths": REAL_PATHS,
}
