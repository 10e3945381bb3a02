"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A window is the shortest run of lines, from a line on (forward) or up to a
line (backward), that holds at least ``MIN_WORDS`` words.  Its fingerprint is
the smallest line hash in it: equal windows have equal fingerprints, so a
repeated run that long is guaranteed to share one.  Only windows whose
fingerprint stands at several positions go on; they join on their whole
content, and all but the first occurrence (by document, then line) are
deleted.  Matches are extended both ways by windows, not line by line against
one partner: forward windows extend from the left end, backward windows from
the right end, so their union is the maximal repeated run, also where its head
and its tail stand earlier in different documents.  One partner would lose
such tails, and all partners are quadratic in the copies of a passage.

Blank lines carry no words: they never match, and go with a run around them.
A null or empty text stays as it is.  Rows with one id and one text are one
document and get the same result; rows with one id and different texts are
different documents, ordered by a hash of the text.  Rows with a null id pass
unchanged.  Ties can't occur: places are distinct.  Empty tables give empty
results, very long texts are read whole.  Other columns pass through, whatever
their names; one named like ``removed`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_WORDS = 50


def _words(line: Column) -> Column:
    """Runs of characters outside ``\\x20\\x09-\\x0D``; where single spaces are the only blanks, spaces plus one."""
    trimmed = F.trim(line)
    other = line.rlike(r"  |[\x09-\x0D]")
    return F.when(other, F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))).when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1)


def line_rows(docs: DataFrame, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, th, pos, h, nw``: the lines with words; th tells texts of one id apart."""
    lines = docs.where(F.col(doc_key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_key).alias("doc"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")
    )
    hashed = lines.select("doc", "th", "pos", F.xxhash64("line").alias("h"), _words(F.col("line")).alias("nw")).where("nw > 0")
    return hashed.repartition("doc", "th").dropDuplicates(["doc", "th", "pos"])


def windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc, th, side, a, b, fp, fp_pos, k1, k2``: every window with its fingerprint and a 128-bit content key."""
    by_doc = Window.partitionBy("doc", "th")
    before = F.sum("nw").over(by_doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = lines.withColumn("e", before).withColumn("s", F.col("e") - F.col("nw"))
    frames = {
        "f": by_doc.orderBy("s").rangeBetween(Window.currentRow, min_words - 1),
        "b": by_doc.orderBy("e").rangeBetween(-(min_words - 1), Window.currentRow),
    }
    sides = []
    for side, frame in frames.items():
        at = placed
        for name, value in {
            "content": F.collect_list("h").over(frame),
            "low": F.min(F.struct("h", "pos")).over(frame),
            "a": F.min("pos").over(frame),
            "b": F.max("pos").over(frame),
            "held": F.max("e").over(frame) - F.min("s").over(frame),
        }.items():
            at = at.withColumn(name, value)
        sides.append(
            at.where(F.col("held") >= min_words).select(
                "doc", "th", F.lit(side).alias("side"), "a", "b",
                F.col("low.h").alias("fp"), F.col("low.pos").alias("fp_pos"),
                F.xxhash64("content").alias("k1"), F.xxhash64(F.lit(1), "content").alias("k2"),
            )
        )
    return sides[0].unionByName(sides[1])


def repeated_runs(docs: DataFrame, doc_key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc, th, runs array<struct<a,b>>``: maximal line ranges that repeat something earlier, ascending."""
    found = windows(line_rows(docs, doc_key, text), min_words)
    place = F.struct("doc", "th", "fp_pos")
    several = found.groupBy("fp").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("fp")
    candidates = found.join(several, "fp", "left_semi")
    here = F.struct("doc", "th", "a")
    first = candidates.groupBy("side", "k1", "k2").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("first <> last")
    later = candidates.join(first.drop("last"), ["side", "k1", "k2"]).where(here != F.col("first")).select("doc", "th", "a", "b")
    ordered = Window.partitionBy("doc", "th").orderBy("a", "b")
    reach = F.max("b").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opened = later.withColumn("opens", F.when(reach.isNull() | (F.col("a") > reach + 1), 1).otherwise(0))
    islands = opened.withColumn("island", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = islands.groupBy("doc", "th", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return runs.groupBy("doc", "th").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))


def _without(lines: Column, runs: Column) -> Column:
    """The lines outside the runs, joined again."""

    def piece(i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.get(runs, i - 1)["b"] + 1)
        stop = F.when(i == F.size(runs), F.size(lines)).otherwise(F.get(runs, i)["a"])
        return F.slice(lines, start + 1, F.greatest(stop - start, F.lit(0)))

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), piece)), "\n")


def dedup(docs: DataFrame, doc_key: str = "doc_id", text: str = "text", removed: str = "lines_removed", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with later repeated runs deleted from ``text``, and ``removed``: how many lines went."""
    runs = repeated_runs(docs, doc_key, text, min_words).withColumnsRenamed({"doc": "__doc", "th": "__run_th", "runs": "__runs"})
    keyed = docs.withColumn("__th", F.xxhash64(text))
    joined = keyed.join(runs, (F.col(doc_key) == F.col("__doc")) & (F.col("__th") == F.col("__run_th")), "left")
    count = F.coalesce(F.aggregate("__runs", F.lit(0), lambda n, r: n + r["b"] - r["a"] + 1), F.lit(0))
    cleaned = F.when(F.col("__runs").isNull(), F.col(text)).otherwise(_without(F.split(text, "\n", -1), F.col("__runs")))
    kept = [F.col(c) if c != text else cleaned.alias(text) for c in docs.columns if c != removed]
    return joined.select(*kept, count.cast("long").alias(removed))
