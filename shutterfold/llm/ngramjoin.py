"""N-gram Jaccard join of all documents by signature trees.

A document is its set of word n-gram hashes.  Documents link when
``100 * intersection >= percent * union``; components of links are returned.

1. Equal sets are one class; from here on there is one row per class.
2. A set keeps the shingles that a partner must share one of (its prefix in a
   global order: shingles that many rows hold last, by exact counts, then by
   hash).  At most ``RARE`` classes share a rare prefix shingle; their pairs of
   compatible sizes stay if they share enough prefix shingles to reach the
   threshold.  Classes that share a common one are tied by star edges, one
   star for each shingle and range of sizes.
3. The components of those edges are the forests.  All forests are laid in one
   order and cut into blocks of bounded weight.  A signature tree joins each
   forest of a block: nodes hold OR-combined bitmaps of the shared shingles and
   size ranges, and a dual traversal prunes node pairs whose largest possible
   overlap is too small or that lie in one component already.  Leaves are
   compared exactly.
4. A forest that lies in one block is then done.  A larger one is cut a second
   time, by other minima of its sets, so that near copies meet; if it still has
   several groups, its blocks are joined pair by pair, sets of one group left
   out of the comparison.
5. Only a spanning forest of the links leaves a task.  The smallest document of
   every group names it.

All bounds are exact, so no link between different sets is lost.  Null texts
and texts without words have an empty set and link with nothing; fewer words
than ``n`` are one shingle.  Repeated rows fall in one class.  One id with
several texts is several nodes, one row each.  Rows with a null id are nodes
like others, but give no name: they get a null component.  Very long texts are
read whole, each in one task.  An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.lineage import stored
from ..operators.ranking import numbered
from . import packed, textarrays
from .keyfilter import KeyFilter

RARE = 32
STEPS = (RARE, 512, 8192)  # rows with a shingle: each step puts it later in the global order
SET_WEIGHT = 64  # of a set beside its shingles: its share of bitmaps and objects
BLOCK_WEIGHT = 1 << 19  # shingles of 8 bytes: 4 MB
BITMAP_BYTES = 1 << 24  # of all leaves of a tree
FANOUT = 16
LEAF_BITS = 1 << 15


def _sets(texts, n: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in textarrays.chunks(texts):
        yield from textarrays.shingle_sets(textarrays.Words(data, offsets), n)


def common_shingles(docs: DataFrame, n: int, text: str = "text") -> list[KeyFilter]:
    """One filter for each of ``STEPS``: the shingles that more rows hold.

    Counts are exact and over all rows; a filter that takes in another shingle
    only moves it in an order that is the same for all sets.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    bits = packed.bucket_bits(size // 6)

    def shingles(texts: pa.Array) -> Iterator[np.ndarray]:
        for _, _, data, offsets in textarrays.chunks(texts):
            yield np.concatenate(list(textarrays.shingle_sets(textarrays.Words(data, offsets), n)))

    def summed(table: pa.Table) -> pa.Table:
        keys, rows = packed.merged([packed.unpack_keys(x.as_py()) for x in table["keys"]], [packed.unpack(x.as_py()).view(np.int64) for x in table["n"]])
        common = rows > STEPS[0]
        return pa.table({"token": keys[common].view(np.int64), "n": rows[common]})

    counted = docs.select(text).mapInArrow(packed.mapper(text, shingles, bits), packed.SCHEMA)
    common = stored(counted.groupBy("bucket").applyInArrow(summed, "token long, n long"))
    return [KeyFilter(common.where(F.col("n") > least), "token") for least in STEPS]


def prefix_length(n, percent: int):
    """How many shingles of a set of n hold one of every partner's."""
    return n - (percent * n + 99) // 100 + 1


def _text_id(doc_key: str, text: str):
    """Tells one document from another, also where an id repeats or is null."""
    return F.xxhash64(F.col(doc_key), F.col(text))


def prefix_rows(docs: DataFrame, common: list[KeyFilter], n: int, percent: int, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, rid, n, set_key, rare array<long>, common array<long>``: prefix shingles below and above ``RARE`` rows; an empty set has a null key."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # bounded filters

    def lists(parts: list[np.ndarray]) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        for batch in batches:
            sizes, keys, rare, more = [], [], [], []
            for s in _sets(batch["text"], n):
                sizes.append(len(s))
                keys.append(int(textarrays.mix(np.array([s.sum(dtype=np.uint64) ^ np.uint64(len(s))]))[0].view(np.int64)) if len(s) else None)
                step = sum(x(s).astype(np.uint8) for x in steps)
                first = np.argsort(step, kind="stable")[: prefix_length(len(s), percent) if len(s) else 0]
                rare.append(s[first[step[first] == 0]])
                more.append(s[first[step[first] > 0]])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["rid"], pa.array(sizes, pa.int32()), pa.array(keys, pa.int64()), lists(rare), lists(more)], ["doc_id", "rid", "n", "set_key", "rare", "common"]
            )

    chosen = docs.select(F.col(doc_key).cast("long").alias("doc_id"), _text_id(doc_key, text).alias("rid"), F.col(text).alias("text"))
    return chosen.mapInArrow(rows, "doc_id long, rid long, n int, set_key long, rare array<long>, common array<long>")


def _pairs(percent: int):
    """Rows sorted by (token, n, key), at most ``RARE`` a token: pairs of compatible sizes."""

    def pairs(token: np.ndarray, n: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(1, RARE):
            same = token[k:] == token[:-k]
            if not same.any():
                return
            ok = same & (100 * n[:-k].astype(np.int64) >= percent * n[k:].astype(np.int64))
            a, b, na, nb = key[:-k][ok], key[k:][ok], n[:-k][ok], n[k:][ok]
            swap = a > b
            yield pa.RecordBatch.from_arrays([pa.array(np.where(swap, y, x)) for x, y in ((a, b), (b, a), (na, nb), (nb, na))], ["a", "b", "na", "nb"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)]
        for batch in batches:
            held = [np.concatenate([a, batch[c].to_numpy()]) for a, c in zip(held, ("token", "n", "key"), strict=True)]
            if batch.num_rows:
                done = np.searchsorted(held[0], held[0][-1])  # the last token may go on
                yield from pairs(*(x[:done] for x in held))
                held = [x[done:] for x in held]
        yield from pairs(*held)

    return rows


def candidate_edges(classes: DataFrame, percent: int) -> DataFrame:
    """``a, b``: class pairs that may link by rare shingles, and the stars of the common ones."""
    tokens = classes.select(F.explode("rare").alias("token"), "n", F.col("set_key").alias("key"))
    ordered = tokens.repartition("token").sortWithinPartitions("token", "n", "key")
    found = ordered.mapInArrow(_pairs(percent), "a long, b long, na int, nb int")
    counted = found.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    need = F.ceil(percent * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    rest = F.greatest(*(F.floor((percent * F.col(x) + 99) / F.lit(100)) - 1 for x in ("na", "nb")))
    near = counted.where(F.col("c") >= need - rest - F.lit(1e-9)).select("a", "b")
    # compatible sizes lie in one range or in neighbouring ones; a set stands in its own range and the next
    band = F.floor(F.log("n") / F.lit(1.0001 * math.log(100 / percent)))
    placed = classes.select(F.explode("common").alias("token"), F.col("set_key").alias("key"), band.alias("band"))
    placed = placed.select("token", "key", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    hubs = placed.groupBy("token", "band").agg(F.min("key").alias("hub"))
    stars = placed.join(hubs, ["token", "band"]).where("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b"))
    return near.unionByName(stars).distinct()


def _settle(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Merges the labels of linked places, in place; a label is the smallest place of its component."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return
        x, y = x[apart], y[apart]
        lo, hi = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(label, hi, lo)
        while (label[label] != label).any():
            label[:] = label[label]


def tree_links(sets: list[np.ndarray], percent: int, start: np.ndarray | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """Component label of every set, joined by a dual traversal.

    Sets of one ``start`` number are joined already; with ``side``, only sets of different sides are compared.
    """
    count = len(sets)
    order = np.lexsort((np.array([s[0] if len(s) else 0 for s in sets], np.uint64), np.array([len(s) for s in sets])))
    n = np.array([len(sets[i]) for i in order], np.int64)
    flat = np.concatenate([sets[i] for i in order])
    of = np.repeat(np.arange(count), n)
    _, place, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = df > 1
    number = np.cumsum(shared) - 1
    mine = shared[place]
    bits = 64
    while bits < min(LEAF_BITS, int(shared.sum())) and bits * count < 4 * BITMAP_BYTES:
        bits *= 2
    exact = int(shared.sum()) <= bits
    column = number[place[mine]] % bits
    maps = np.zeros((count, bits // 64), np.uint64)
    np.bitwise_or.at(maps, (of[mine], column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    held = np.bincount(of[mine], minlength=count)
    excess = held - np.bitwise_count(maps).sum(axis=1)
    levels = [(maps, n, n, excess)]
    while len(levels[-1][0]) > FANOUT:
        m, lo, hi, ex = levels[-1]
        at = np.arange(0, len(m), FANOUT)
        levels.append((np.bitwise_or.reduceat(m, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at)))
    label = np.arange(count)
    if start is not None:
        begins = np.full(start.max() + 1, count)
        np.minimum.at(begins, start[order], label)
        label = begins[start[order]]
    sides = side[order] if side is not None else None
    tokens = [sets[i] for i in order]

    def possible(level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        m, lo, hi, ex = levels[level]
        ok = (100 * hi[i] >= percent * lo[j]) & (100 * hi[j] >= percent * lo[i])
        i2, j2 = i[ok], j[ok]
        most = np.concatenate([np.bitwise_count(m[i2[k : k + 1024]] & m[j2[k : k + 1024]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i2), 1024)]) if len(i2) else np.empty(0, np.int64)
        most = np.minimum(most + np.minimum(ex[i2], ex[j2]), np.minimum(hi[i2], hi[j2]))
        ok[ok] = (100 + percent) * most >= percent * (lo[i2] + lo[j2])
        return ok

    def children(level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = len(levels[level - 1][0])
        a = (i[:, None] * FANOUT + np.repeat(np.arange(FANOUT), FANOUT)).ravel()
        b = (j[:, None] * FANOUT + np.tile(np.arange(FANOUT), FANOUT)).ravel()
        keep = (a < width) & (b < width) & (a <= b)
        return a[keep], b[keep]

    top = len(levels) - 1
    i, j = np.triu_indices(len(levels[top][0]))
    stack = [(top, i, j)]
    while stack:
        level, i, j = stack.pop()
        if level:
            one = np.minimum.reduceat(label, np.arange(0, count, FANOUT**level)), np.maximum.reduceat(label, np.arange(0, count, FANOUT**level))
            joined = (one[0][i] == one[1][i]) & (one[0][j] == one[1][j]) & (one[0][i] == one[0][j])
            i, j = i[~joined], j[~joined]
            ok = possible(level, i, j)
            i, j = children(level, i[ok], j[ok])
            far = np.argsort(j - i, kind="stable")[::-1]  # near pairs last: they come off the stack first
            i, j = i[far], j[far]
            stack += [(level - 1, i[k : k + 1024], j[k : k + 1024]) for k in range(0, len(i), 1024)]
            continue
        ok = (i != j) & (label[i] != label[j])
        if sides is not None:
            ok &= sides[i] != sides[j]
        i, j = i[ok], j[ok]
        ok = possible(0, i, j)
        i, j = i[ok], j[ok]
        if not exact and len(i):
            o = np.array([len(np.intersect1d(tokens[a], tokens[b], assume_unique=True)) for a, b in zip(i, j, strict=True)])
            ok = (100 + percent) * o >= percent * (n[i] + n[j])
            i, j = i[ok], j[ok]
        _settle(label, i, j)
    out = np.empty(count, np.int64)
    out[order] = order[label]
    return out


def _cut_rows(table: pa.Table, start: str | None, side: str | None, percent: int) -> pa.Table:
    """Links that the trees of the table's forests find: ``node, root``."""
    keys, component = table["set_key"].to_numpy(), table["component"].to_numpy()
    order = np.argsort(component, kind="stable")
    found = []
    for of in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
        if len(of) > 1:
            sets = [np.frombuffer(table["shingles"][int(i)].as_py(), np.uint64) for i in of]
            begins = np.unique(table[start].to_numpy()[of], return_inverse=True)[1] if start else None
            sides = table[side].to_numpy()[of] if side else None
            label = tree_links(sets, percent, begins, sides if sides is not None and (sides != sides[0]).any() else None)
            moved = np.flatnonzero(label != np.arange(len(label)))
            found.append((keys[of[moved]], keys[of[label[moved]]]))
    node, root = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), ())))
    return pa.table({"node": node, "root": root})


def shingle_rows(docs: DataFrame, wanted: KeyFilter, n: int, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """``rid, shingles binary`` of the documents that are wanted, each once."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)  # a bounded filter

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(shared.value(batch["rid"].to_numpy())))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch["rid"], pa.array([s.tobytes() for s in _sets(batch["text"], n)], pa.binary())], ["rid", "shingles"])

    chosen = docs.select(_text_id(doc_key, text).alias("rid"), F.col(text).alias("text"))
    return chosen.mapInArrow(rows, "rid long, shingles binary").groupBy("rid").agg(F.first("shingles").alias("shingles"))


def _blocks(placed: DataFrame, salt: int) -> DataFrame:
    """Adds ``block``: forests one after another, in each the sets by a minimum of their hashed shingles, cut by weight."""
    least = F.array_min(F.transform("signs", lambda x: F.xxhash64(F.lit(salt), x)))
    ranked = numbered(
        placed.select("component", "set_key", least.alias("least"), (F.col("n") + SET_WEIGHT).cast("long").alias("w")), [F.col("component"), F.col("least"), F.col("set_key")], running="w"
    )
    return placed.drop("signs").join(ranked.select("set_key", F.floor(F.col("running") / F.lit(BLOCK_WEIGHT)).alias("block")), "set_key")


def _joined(sets: DataFrame, by: list[str], percent: int, start: str | None = None, side: str | None = None) -> DataFrame:
    return stored(sets.groupBy(*by).applyInArrow(lambda table: _cut_rows(table, start, side, percent), "node long, root long"))


def forest_links(placed: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """``node, component`` of every set that links: ``placed`` has ``component, set_key, n, rid, signs``."""
    first = stored(_blocks(placed, 1))
    links = _joined(first.join(shingles, "rid"), ["block"], percent)
    large = first.groupBy("component").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo < hi").select("component")
    large = stored(first.join(large, "component", "left_semi"))
    if large.isEmpty():
        return connected_components(links, "node", "root")
    again = _blocks(placed.join(large.select("component").distinct(), "component", "left_semi"), 2)
    links = links.unionByName(_joined(again.join(shingles, "rid"), ["block"], percent))
    groups = connected_components(links, "node", "root").withColumnsRenamed({"node": "set_key", "component": "root"})
    labelled = large.join(groups, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    several = labelled.groupBy("component").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.sort_array(F.collect_set("block")).alias("blocks")).where("lo < hi")
    apart = labelled.join(several.select("component", "blocks"), "component").withColumn("other", F.explode("blocks"))
    pairs = apart.select("component", "set_key", "rid", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).where("i < j")
    last = _joined(pairs.join(shingles, "rid"), ["component", "i", "j"], percent, "root", "block")
    return connected_components(links.unionByName(last), "node", "root")


def members(docs: DataFrame, n: int = 4, percent: int = 85, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, rid, n, root`` for every row: documents of one root are a group; an empty set has a null root."""
    rows = stored(prefix_rows(docs, common_shingles(docs, n, text), n, percent, doc_key, text))
    classes = rows.where("set_key is not null").groupBy("set_key")
    classes = stored(classes.agg(F.min("rid").alias("rid"), *(F.first(c).alias(c) for c in ("n", "rare", "common"))))
    forests = connected_components(candidate_edges(classes, percent), "a", "b").withColumnRenamed("node", "set_key")
    signs = F.concat("rare", "common").alias("signs")
    placed = stored(forests.join(classes.select("set_key", "n", "rid", signs), "set_key"))
    shingles = shingle_rows(docs, KeyFilter(placed.select("rid"), "rid"), n, doc_key, text)
    groups = forest_links(placed, shingles, percent).select(F.col("node").alias("set_key"), F.col("component").alias("root"))
    return rows.select("doc_id", "rid", "n", "set_key").join(groups, "set_key", "left").select("doc_id", "rid", "n", F.coalesce("root", "set_key").alias("root"))


def components(docs: DataFrame, n: int = 4, percent: int = 85, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row."""
    rows = stored(members(docs, n, percent, doc_key, text))
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component"))
    return rows.join(least, "root", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, then text hash; a row whose text has no words stays.

    Rows that repeat one id with one text are one document and become one row.
    """
    rows = stored(members(docs, n, percent, doc_key, text).select("rid", "root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid").alias("rank")))
    kept = rows.where("root is not null").groupBy("root").agg(F.min("rank").alias("rank")).select("rank.rid")
    kept = kept.unionByName(rows.where("root is null").select("rid").distinct())
    keyed = docs.withColumn("__rid", _text_id(doc_key, text)).join(kept.withColumnRenamed("rid", "__rid"), "__rid", "left_semi")
    return keyed.dropDuplicates(["__rid"]).select(*docs.columns)
