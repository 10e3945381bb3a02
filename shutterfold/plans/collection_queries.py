"""Filters, pairing, order, sessions, transfers and caches over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import cache, pairing, ranking, selection, sessions, similar, transfer


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items: status is the label, priority the stars, the customer's segment the tag."""
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    label = F.when(F.col("o_orderstatus") == "O", "pick").when(F.col("o_orderstatus") == "F", "hold").otherwise("unrated")
    tag = F.when(F.col("c_mktsegment") == "MACHINERY", "red").when(F.col("c_mktsegment") == "BUILDING", "blue")
    return o.join(c.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("item_id"), label.alias("label"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("stars"), tag.alias("tag"), "o_orderdate", "o_custkey"
    )


ITEMS = """items AS (SELECT o_orderkey AS item_id, CASE o_orderstatus WHEN 'O' THEN 'pick' WHEN 'F' THEN 'hold' ELSE 'unrated' END AS label, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS stars,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'red' WHEN 'BUILDING' THEN 'blue' END AS tag, o_orderdate, o_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""


def filter_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).where(selection.item_filter(label="pick", stars=4, tag="red")).select("item_id", "label", "stars", "tag")


def axis_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.axis_counts(_classified(spark, sf_dir))


def term_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = selection.search_terms("RED, widget;\tBolt ,red\n")
    p = _t(spark, sf_dir, "part")
    return p.where(selection.matches_terms(F.col("p_name"), terms)).select("p_partkey", "p_name")


def relabel_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, set a label on the matches, report what changed."""
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), "p_name", F.when(F.col("p_size") > 25, "pick").otherwise("unrated").alias("label"))
    return selection.relabel(p, selection.matches_terms(F.col("p_name"), ["ring"]), "pick").select("item_id", "label", "old_label", "changed")


def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as they come from cameras, with numbers of different lengths, in natural order."""
    p = _t(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("_"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "0a").otherwise("B")).alias("name"))
    return ranking.numbered(p, [N.natural_key(F.col("name")), F.col("p_partkey")], "place").select("p_partkey", "name", "place")


def capture_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time ascending, unknown times last, ties by name."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("t"))
    return ranking.numbered(o, [F.col("t").isNull(), F.col("t"), N.natural_key(F.col("o_orderkey").cast("string")), F.col("o_orderkey")], "place").select("o_orderkey", "place")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    ext = F.when(F.col("lang") == "en", "NEF").when(F.col("lang") == "fr", "jpg").when(F.col("lang") == "de", "JPEG").otherwise("heic")
    return d.select(F.concat(F.lit("/"), "source", F.lit("/IMG_"), F.floor(F.col("doc_id") / 8).cast("string"), F.lit("."), ext).alias("path")).distinct()


def pairing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairing.pair(pairing.supported_files(_paths(spark, sf_dir)))
    return found.select("item", "stem", F.array_join("members", ",").alias("members"), "display", "has_raw", "has_image")


def term_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search terms of every part name, with the type repeated in another case."""
    p = _t(spark, sf_dir, "part").select("p_partkey", F.concat_ws(", ", F.regexp_replace("p_name", " ", ";"), "p_type", F.lower("p_type")).alias("terms"))
    return selection.distinct_terms(p, "terms", "p_partkey")


def session_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are items; every order is a saved record found by customer name or, one step later, by its member path."""
    c, o = _t(spark, sf_dir, "customer"), _classified(spark, sf_dir)
    items = c.select(F.col("c_custkey").alias("item"), F.lit("unrated").alias("label"), F.lit(0).alias("stars"), F.lit(None).cast("string").alias("tag"))
    saved = o.select(F.concat(F.lit("rec/"), "item_id").alias("key"), "label", "stars", "tag", F.array(F.concat(F.lit("Shots\\CUST"), "o_custkey", F.lit(".NEF"))).alias("members"))
    own = c.select(F.col("c_custkey").alias("item"), F.lit(1).alias("prio"), F.concat(F.lit("shots/cust"), "c_custkey", F.lit(".nef")).alias("key"))
    first = c.select(F.col("c_custkey").alias("item"), F.lit(0).alias("prio"), F.concat(F.lit("REC/"), F.col("c_custkey") * 5).alias("key"))
    return sessions.restore(items, own.unionByName(first), saved)


SESSION_RESTORE = f"""WITH {ITEMS}, r AS (SELECT 'rec/' || item_id AS record, item_id, label, stars, tag, o_custkey FROM items
), m AS (SELECT item, record, min(prio) AS prio, any_value(label) AS label, any_value(stars) AS stars, any_value(tag) AS tag FROM (
  SELECT c_custkey AS item, record, 1 AS prio, label, stars, tag FROM customer JOIN r ON o_custkey = c_custkey UNION ALL
  SELECT c_custkey, record, 0, label, stars, tag FROM customer JOIN r ON r.item_id = c_custkey * 5) GROUP BY item, record
), g AS (SELECT item, arg_min(label, (prio, record)) FILTER (label <> 'unrated') AS label, arg_min(stars, (prio, record)) FILTER (stars > 0) AS stars, arg_min(tag, (prio, record)) FILTER (tag IS NOT NULL) AS tag FROM m GROUP BY item)
SELECT c_custkey AS item, coalesce(g.label, 'unrated') AS label, coalesce(g.stars, 0) AS stars, g.tag, g.item IS NOT NULL AS has_record FROM customer LEFT JOIN g ON g.item = c_custkey"""


def session_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat save of all orders that keeps records of sub-folders (two stars or more) which no tagged order reads."""
    o = _classified(spark, sf_dir)
    none = F.array().cast("array<string>")
    place = lambda inside: F.concat(F.when(inside, "sub/").otherwise(""), F.lit("p"), "item_id").alias("key")
    items = o.select(place(F.lit(False)), "label", "stars", "tag", none.alias("members"))
    saved = o.select(place(F.col("stars") >= 2), "label", "stars", "tag", none.alias("members"))
    candidates = o.select(F.col("item_id").alias("item"), F.lit(0).alias("prio"), place(F.col("tag").isNotNull()))
    return sessions.save(items, saved, sessions.claimed(candidates, saved), recursive=False).drop("members")


SESSION_SAVE = f"""WITH {ITEMS} SELECT 'p' || item_id AS key, label, stars, tag FROM items WHERE label <> 'unrated' OR stars > 0 OR tag IS NOT NULL
UNION ALL SELECT 'sub/p' || item_id, label, stars, tag FROM items WHERE stars >= 2 AND tag IS NULL"""


def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _classified(spark, sf_dir).select(F.concat(F.lit("k"), "item_id").alias("key"), "label", "stars", "tag")
    return sessions.summary(o)


SESSION_SUMMARY = f"""WITH {ITEMS}, s AS (SELECT unnest([CASE WHEN label IN ('pick', 'hold', 'reject') THEN label END, CASE WHEN stars BETWEEN 1 AND 5 THEN stars || 'star' END, '@' || tag]) AS section, 'k' || item_id AS key FROM items
), u AS (SELECT section, count(*) OVER (PARTITION BY section) AS n, row_number() OVER (PARTITION BY section ORDER BY key) AS place, key FROM s WHERE section IS NOT NULL)
SELECT * FROM u UNION ALL SELECT f, 0, NULL, NULL FROM (VALUES ('pick'), ('hold'), ('reject')) v(f) WHERE f NOT IN (SELECT section FROM u)"""


def _transfer_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their line items as member files: every second line is a RAW file."""
    line = _t(spark, sf_dir, "lineitem")
    ext = F.when(F.col("l_linenumber") % 2 == 0, ".NEF").otherwise(".jpg")
    files = line.select("l_orderkey", F.concat(F.lit("/shots/o"), "l_orderkey", F.lit("_"), "l_linenumber", ext).alias("path")).distinct()
    members = files.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("path")).alias("members"))
    return _classified(spark, sf_dir).join(members, F.col("item_id") == F.col("l_orderkey")).withColumn("pos", F.col("item_id"))


TRANSFER = f"""{ITEMS}, files AS (SELECT DISTINCT l_orderkey, '/shots/o' || l_orderkey || '_' || l_linenumber || CASE WHEN l_linenumber % 2 = 0 THEN '.NEF' ELSE '.jpg' END AS path FROM lineitem),
chosen AS (SELECT * FROM items WHERE label = 'pick' OR stars IN (3, 4)),
sent AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY path) - 1 AS slot FROM chosen JOIN files ON item_id = l_orderkey WHERE path LIKE '%.NEF'),
numbered AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS seq, row_number() OVER (PARTITION BY stars ORDER BY item_id) AS grade_seq FROM (SELECT DISTINCT item_id, stars FROM sent))"""


def transfer_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = transfer.plan(_transfer_items(spark, sf_dir), transfer.selected(("pick",), (3, 4)), "raw")
    return planned.select("item_id", F.col("slot").cast("long").alias("slot"), "path", "label", "stars", "seq", "grade_seq")


def rename_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = transfer.plan(_transfer_items(spark, sf_dir), transfer.selected(("pick",), (3, 4)), "raw")
    named = transfer.renamed(planned, "{label}-{seq:05}_{grade}{gradeseq:03}{nothing}:{orig}")
    folder = N.split_folder(F.col("label"), F.col("stars"), F.col("tag"), "label")
    return named.select("path", "new_name", folder.alias("folder"))


RENAME_PREVIEW = f"""WITH {TRANSFER} SELECT path, label || '-' || CASE WHEN seq < 100000 THEN lpad(CAST(seq AS VARCHAR), 5, '0') ELSE CAST(seq AS VARCHAR) END || '_' || CASE WHEN stars BETWEEN 1 AND 5 THEN substr('EDCBA', stars, 1) ELSE '' END
  || CASE WHEN stars BETWEEN 1 AND 5 THEN substr('EDCBA', stars, 1) ELSE '' END || CASE WHEN grade_seq < 1000 THEN lpad(CAST(grade_seq AS VARCHAR), 3, '0') ELSE CAST(grade_seq AS VARCHAR) END || '_' || (SELECT regexp_extract(min(f.path), '([^/]*)\\.[A-Za-z]*$', 1) FROM files f WHERE f.l_orderkey = sent.item_id) || '.NEF' AS new_name,
  CASE WHEN label <> 'unrated' THEN label WHEN stars > 0 THEN stars || 'star' ELSE 'unrated' END AS folder FROM sent JOIN numbered USING (item_id)"""


def collision_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as files of a brand folder in which some names exist already."""
    p = _t(spark, sf_dir, "part")
    planned = p.select(F.col("p_brand").alias("folder"), F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("item_id"), F.concat("p_name", F.lit(".jpg")).alias("name"))
    existing = p.where("p_size > 45").select(F.col("p_brand").alias("folder"), F.concat(F.upper("p_name"), F.lit(".JPG")).alias("name"))
    return transfer.resolve_collisions(planned, existing).select("folder", "item_id", "name", "final_name")


COLLISION_NAMES = """WITH e AS (SELECT DISTINCT p_brand, lower(p_name) AS n FROM part WHERE p_size > 45),
k AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) - 1 + CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.p_brand = part.p_brand AND e.n = part.p_name) THEN 1 ELSE 0 END AS i FROM part)
SELECT p_brand AS folder, p_partkey AS item_id, p_name || '.jpg' AS name, p_name || CASE WHEN i = 0 THEN '' ELSE '_' || lpad(CAST(i AS VARCHAR), 3, '0') END || '.jpg' AS final_name FROM k"""


def collision_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pairs of a RAW file and an image that keep one number together; some first and second names of either kind exist already."""
    p = _t(spark, sf_dir, "part")
    at = [F.col("p_brand").alias("folder"), F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("item_id")]
    planned = p.select(*at, F.explode(F.array(F.concat("p_name", F.lit(".nef")), F.concat("p_name", F.lit(".jpg")))).alias("name"))
    first = p.where("p_size > 45").select(F.col("p_brand").alias("folder"), F.concat(F.upper("p_name"), F.lit(".JPG")).alias("name"))
    second = p.where("p_size < 5").select(F.col("p_brand").alias("folder"), F.concat("p_name", F.lit("_001.nef")).alias("name"))
    return transfer.resolve_collisions(planned, first.unionByName(second)).select("folder", "item_id", "name", "final_name")


COLLISION_PAIRS = """WITH e AS (SELECT p_brand, p_name, bool_or(p_size > 45) AS e0, bool_or(p_size < 5) AS e1 FROM part GROUP BY ALL),
k AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n, e0, e1 FROM part JOIN e USING (p_brand, p_name)),
i AS (SELECT *, CASE WHEN e0 AND e1 THEN n + 1 WHEN e0 OR (e1 AND n > 1) THEN n ELSE n - 1 END AS i FROM k)
SELECT p_brand AS folder, p_partkey AS item_id, p_name || ext AS name, p_name || CASE WHEN i = 0 THEN '' ELSE '_' || lpad(CAST(i AS VARCHAR), 3, '0') END || ext AS final_name FROM i, (VALUES ('.nef'), ('.jpg')) AS kinds(ext)"""


def collision_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as single images, single RAW files and pairs that one template gives the same name in the folder of their type; pairs keep one number."""
    p, rest = _t(spark, sf_dir, "part"), F.col("p_size") % 3
    kinds = F.when(rest == 0, F.array(F.lit("shot.jpg"), F.lit("shot.nef"))).when(rest == 1, F.array(F.lit("shot.jpg"))).when(rest == 2, F.array(F.lit("shot.nef")))
    planned = p.select(F.col("p_type").alias("folder"), F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("item_id"), F.explode(kinds).alias("name"))
    existing = planned.select("folder", F.lit("shot_0001.jpg").alias("name"))  # no number that a name can get
    return transfer.resolve_collisions(planned, existing).select("folder", "item_id", "name", "final_name")


# A pair comes after all earlier pairs and the longer row of earlier single files; a single file fills the first place that no pair has.
COLLISION_MIXED = """WITH p AS (SELECT p_type AS folder, p_partkey AS item_id, p_size % 3 AS kind FROM part),
n AS (SELECT *, count(*) FILTER (kind = 0) OVER w AS pairs, count(*) FILTER (kind = 1) OVER w AS images, count(*) FILTER (kind = 2) OVER w AS raws FROM p
  WINDOW w AS (PARTITION BY folder ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT folder, item_id, kind, pairs, CASE kind WHEN 0 THEN greatest(images, raws) WHEN 1 THEN images ELSE raws END AS m FROM n),
low AS (SELECT folder, m, sum(count(*)) OVER (PARTITION BY folder ORDER BY m) AS below FROM k WHERE kind = 0 GROUP BY folder, m),
i AS (SELECT k.folder, item_id, kind, k.m + CASE WHEN kind = 0 THEN pairs ELSE coalesce(below, 0) END AS i FROM k ASOF LEFT JOIN low ON k.folder = low.folder AND k.m >= low.m)
SELECT folder, item_id, 'shot' || ext AS name, 'shot' || CASE WHEN i = 0 THEN '' WHEN i < 1000 THEN '_' || lpad(CAST(i AS VARCHAR), 3, '0') ELSE '_' || i END || ext AS final_name
FROM i JOIN (VALUES (0, '.jpg'), (0, '.nef'), (1, '.jpg'), (2, '.nef')) AS kinds(kind, ext) USING (kind)"""


def organize_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per date folder and per focal-length folder."""
    o, p = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "part")
    exif = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"))
    dates = transfer.folder_counts(o, N.date_folder(exif, F.col("o_orderdate"))).withColumn("by", F.lit("date"))
    focal = F.concat((F.col("p_size") - 1).cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".5 mm").otherwise(" mm"))
    return dates.unionByName(transfer.folder_counts(p, N.focal_folder(focal)).withColumn("by", F.lit("focal")))


ORGANIZE_PREVIEW = """SELECT strftime(o_orderdate, '%Y-%m-%d') AS folder, count(*) AS files, 'date' AS by FROM orders GROUP BY 1
UNION ALL SELECT CASE WHEN v > 0 THEN CAST(CAST(floor(v + 0.5) AS BIGINT) AS VARCHAR) || 'mm' ELSE 'unknown-focal' END, count(*), 'focal' FROM (SELECT p_size - 1 + CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 0 END AS v FROM part) GROUP BY 1"""


def cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("doc_id").alias("mtime"), F.col("n_chars").alias("size"))
    return cache.evict(d, 500_000).select("path", "evicted")


CACHE_EVICT = "SELECT doc_id AS path, sum(n_chars) OVER () - (sum(n_chars) OVER (ORDER BY doc_id) - n_chars) > 500000 AS evicted FROM documents"


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("mtime"), F.col("n_chars").alias("signature"))
    old = d.where("mtime % 3 <> 0").select("path", "mtime", F.when(F.col("mtime") % 5 == 0, -1).otherwise(F.col("signature")).alias("signature"), F.when(F.col("mtime") % 7 > 0, F.col("mtime")).alias("dhash"), F.lit(1.0).alias("aesthetic"))
    hits, misses = cache.lookup(d, old, ok=cache.usable(True, True))
    return hits.select("path", "mtime", F.lit("hit").alias("found")).unionByName(misses.select("path", "mtime", F.lit("miss").alias("found")))


CACHE_LOOKUP = "SELECT source AS path, doc_id AS mtime, CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 > 0 THEN 'hit' ELSE 'miss' END AS found FROM documents"


def distinct_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.distinct_names(_t(spark, sf_dir, "events"), "event_type")


def score_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count_if(F.col("value") >= 50).alias("good"), F.count_if(F.col("value") < 50).alias("bad"))


def jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First part that matches, the number of matches, and the rows around the 40th."""
    p = _t(spark, sf_dir, "part")
    named = selection.jump_to_name(p, [F.col("p_partkey")], "p_name", "bolt").select(F.lit("name").alias("how"), "p_partkey", F.col("matches").alias("n"))
    near = selection.position_window(p, [F.col("p_partkey")], 40, 16, 80).select(F.lit("near").alias("how"), "p_partkey", F.col("pos").alias("n"))
    return named.unionByName(near)


JUMP = """SELECT 'name' AS how, min(p_partkey) AS p_partkey, count(*) AS n FROM part WHERE contains(p_name, 'bolt') HAVING count(*) > 0 UNION ALL
SELECT 'near', p_partkey, pos FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS pos FROM part) WHERE pos BETWEEN 24 AND 120"""


def mru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.recent(_t(spark, sf_dir, "events"), "user_id", "event_id", 12)


def lane_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.lane_latest(_t(spark, sf_dir, "events"), "event_type", "event_id", 32).select("event_type", "event_id", "place")


DISTANCE = 6


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", "n_chars", similar.text_hash(F.col("text")).alias("h"))


HASHED = f"""hashed AS (SELECT doc_id, n_chars, list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(range(0, 64), lambda i: CAST(CASE WHEN ascii(substr(text, CAST(floor(i * length(text) / 65) AS BIGINT) + 1, 1)) < ascii(substr(text, CAST(floor((i + 1) * length(text) / 65) AS BIGINT) + 1, 1)) THEN 1 ELSE 0 END AS HUGEINT) << CAST(i AS INTEGER))), lambda a, b: a + b) AS h FROM documents),
pairs AS (SELECT DISTINCT a.h AS x, b.h AS y FROM (SELECT DISTINCT h FROM hashed) a JOIN (SELECT DISTINCT h FROM hashed) b ON a.h <> b.h AND bit_count(xor(a.h, b.h)) <= {DISTANCE}),
reach AS (SELECT h AS x, h AS y FROM hashed UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
clustered AS (SELECT d.doc_id, d.n_chars, min(o.doc_id) AS cluster FROM hashed d JOIN reach r ON d.h = r.x JOIN hashed o ON o.h = r.y GROUP BY ALL)"""


def near_dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.clusters(_hashed(spark, sf_dir), DISTANCE, "h", "doc_id").select("doc_id", "cluster")


def dedup_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest text of every cluster."""
    found = similar.clusters(_hashed(spark, sf_dir), DISTANCE, "h", "doc_id")
    best = found.groupBy("cluster").agg(F.min(F.struct(-F.col("n_chars"), "doc_id")).alias("b"))  # combines before the shuffle, however large a cluster
    return best.select("b.doc_id", "cluster")


PAIRING_SQL = """WITH paths AS (SELECT DISTINCT source AS folder, 'img_' || (doc_id // 8) AS key, '/' || source || '/IMG_' || (doc_id // 8) || CASE lang WHEN 'en' THEN '.NEF' WHEN 'fr' THEN '.jpg' WHEN 'de' THEN '.JPEG' ELSE '.heic' END AS path,
  lang = 'en' AS raw, CASE WHEN lang IN ('fr', 'de') THEN 'jpg' WHEN lang <> 'en' THEN 'heic' END AS family, CASE lang WHEN 'en' THEN 98 WHEN 'fr' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS rank FROM documents),
sets AS (SELECT key, folder, bool_or(raw) AS r, bool_or(NOT raw) AS i, count(DISTINCT family) AS nf FROM paths GROUP BY ALL),
stems AS (SELECT key, count(*) AS n, count(*) FILTER (r AND NOT i) AS ro, count(*) FILTER (i AND NOT r) AS io, count(*) FILTER (r AND i) AS mx, sum(nf) AS fs, (SELECT count(DISTINCT family) FROM paths p WHERE p.key = sets.key) AS fa FROM sets GROUP BY key),
placed AS (SELECT p.*, CASE WHEN n > 1 AND ro = 1 AND io >= 1 AND mx = 0 AND fs = fa THEN '' ELSE folder END AS place FROM paths p JOIN stems USING (key))
SELECT min(path) AS item, regexp_extract(min(path), '([^/]*)\\.[^.]*$', 1) AS stem, string_agg(path, ',' ORDER BY path) AS members, arg_min(path, (rank, path)) AS display, bool_or(raw) AS has_raw, bool_or(NOT raw) AS has_image FROM placed GROUP BY key, place"""

QUERIES = {
    f.__name__: f
    for f in (
        filter_and, axis_counts, term_match, term_distinct, relabel_matches, natural_order, capture_order, pairing_items, session_restore, session_save, session_summary, transfer_plan,
        rename_preview, collision_names, collision_pairs, collision_mixed, organize_preview, cache_evict, cache_lookup, distinct_attrs, score_range, jump, mru, lane_latest, near_dup_clusters, dedup_best,
    )
}
ORACLES = {
    "filter_and": f"WITH {ITEMS} SELECT item_id, label, stars, tag FROM items WHERE label = 'pick' AND stars = 4 AND tag = 'red'",
    "axis_counts": f"WITH {ITEMS} SELECT 'label' AS axis, label AS value, count(*) AS n FROM items GROUP BY label UNION ALL SELECT 'stars', CAST(least(stars, 5) AS VARCHAR), count(*) FROM items GROUP BY 2 UNION ALL SELECT 'tag', tag, count(*) FROM items WHERE tag IS NOT NULL GROUP BY tag",
    "term_match": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'widget') OR contains(lower(p_name), 'bolt')",
    "term_distinct": "WITH t AS (SELECT p_partkey, unnest(string_split(replace(p_name, ' ', ';') || ';' || p_type || ';' || lower(p_type), ';')) AS term, generate_subscripts(string_split(replace(p_name, ' ', ';') || ';' || p_type || ';' || lower(p_type), ';'), 1) AS nth FROM part), f AS (SELECT p_partkey, min(nth) AS nth, arg_min(trim(term), nth) AS term FROM t WHERE trim(term) <> '' GROUP BY p_partkey, lower(trim(term))) SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY nth) AS place, term FROM f",
    "relabel_matches": "SELECT p_partkey AS item_id, CASE WHEN contains(p_name, 'ring') THEN 'pick' ELSE o END AS label, o AS old_label, contains(p_name, 'ring') AND o <> 'pick' AS changed FROM (SELECT *, CASE WHEN p_size > 25 THEN 'pick' ELSE 'unrated' END AS o FROM part)",
    "natural_order": "WITH n AS (SELECT p_partkey, p_name, p_size, p_name || '_' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '0a' ELSE 'B' END AS name, CAST(p_size || CASE WHEN p_partkey % 3 = 0 THEN '0' ELSE '' END AS BIGINT) AS v, CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE 'b' END AS tail FROM part) SELECT p_partkey, name, row_number() OVER (ORDER BY p_name || '_', v, tail, p_partkey) AS place FROM n",
    "capture_order": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus = 'P', CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END, o_orderkey) AS place FROM orders",
    "pairing_items": PAIRING_SQL, "session_restore": SESSION_RESTORE, "session_save": SESSION_SAVE, "session_summary": SESSION_SUMMARY,
    "transfer_plan": f"WITH {TRANSFER} SELECT item_id, slot, path, label, stars, seq, grade_seq FROM sent JOIN numbered USING (item_id)",
    "rename_preview": RENAME_PREVIEW, "collision_names": COLLISION_NAMES, "collision_pairs": COLLISION_PAIRS, "collision_mixed": COLLISION_MIXED, "organize_preview": ORGANIZE_PREVIEW, "cache_evict": CACHE_EVICT, "cache_lookup": CACHE_LOOKUP,
    "distinct_attrs": "SELECT DISTINCT trim(event_type) AS event_type FROM events WHERE trim(event_type) <> ''",
    "score_range": "SELECT min(value) AS low, max(value) AS high, count(*) FILTER (value >= 50) AS good, count(*) FILTER (value < 50) AS bad FROM events",
    "jump": JUMP,
    "mru": "SELECT user_id, row_number() OVER (ORDER BY m DESC, user_id) AS place FROM (SELECT user_id, max(event_id) AS m FROM events GROUP BY user_id ORDER BY m DESC, user_id LIMIT 12)",
    "lane_latest": "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS place FROM events QUALIFY place <= 32",
    "near_dup_clusters": f"WITH RECURSIVE {HASHED} SELECT doc_id, cluster FROM clustered",
    "dedup_best": f"WITH RECURSIVE {HASHED} SELECT doc_id, cluster FROM clustered QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n_chars DESC, doc_id) = 1",
}
