"""Planning copies, moves and folders: selection, numbering, new names, collisions, and a sink that never overwrites."""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import reduce
from itertools import groupby
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import choices
from ..functions import names as N
from .components import connected_components
from .lineage import stored
from .ranking import largest, numbered, numbered_within

TURN_ROWS = 500_000  # rows of one family of names that a task numbers at a time


def selected(labels: tuple[str, ...] = (), stars: tuple[int, ...] = (), tags: tuple[str, ...] = (), split: bool = False) -> Column:
    """Any chosen label, star count (1 or more) or tag; splitting into folders takes everything in scope."""
    if split:
        return F.lit(True)
    out = F.lit(False)
    if labels:
        out |= F.col("label").isin(*labels)
    if stars:
        out |= (F.col("stars") >= 1) & F.col("stars").isin(*stars)
    if tags:
        out |= F.coalesce(F.col("tag").isin(*tags), F.lit(False))
    return out


def companions(members: Column, which: str) -> Column:
    """All members, only RAW ones or only images."""
    return members if which == "both" else F.filter(members, lambda m: F.coalesce(N.kind(N.extension(m)) == which, F.lit(False)))


def plan(items: DataFrame, chosen: Column, which: str = "both", order: str = "pos") -> DataFrame:
    """One row per file to send: ``item_id, pos, path, slot, stem, label, stars, tag, seq, grade_seq``.

    ``seq`` counts the selected items that have a matching member, in order;
    ``grade_seq`` does so within a star count.  ``stem`` is the item's, of its
    first member where it has none.
    """
    first = N.stem(F.col("members").getItem(0))
    items = items.where(chosen).withColumn("stem", F.coalesce(F.col("stem"), first) if "stem" in items.columns else first)
    items = items.withColumn("members", companions(F.col("members"), which)).where(F.size("members") > 0)
    items = stored(items.select("item_id", order, "members", "stem", "label", "stars", F.col("tag").cast("string").alias("tag")))  # ranking reads them several times
    places = numbered(items.select("item_id", F.least("stars", F.lit(5)).alias("grade"), F.col(order).alias("__at")), [F.col("__at"), F.col("item_id")], "seq")  # keys only are ranked
    places = numbered_within(places, ["grade"], [F.col("__at"), F.col("item_id")], "grade_seq")
    graded = items.join(places.select("item_id", "seq", "grade_seq"), "item_id")
    return graded.select("item_id", order, F.posexplode("members").alias("slot", "path"), "stem", "label", "stars", "tag", "seq", "grade_seq")


def renamed(planned: DataFrame, template: str | None, by_grade: bool = False) -> DataFrame:
    """Adds ``new_name``: all files of an item share the stem that the template makes; the extension stays.

    ``by_grade`` counts ``{seq}`` within the grade and leaves items without
    stars at their names, as no template does for all.
    """
    name = N.file_name(F.col("path"))
    if template is None:
        return planned.withColumn("new_name", name)
    grade = N.grade(F.least("stars", F.lit(5)))
    values = {
        "seq": F.col("grade_seq" if by_grade else "seq"), "order": F.col("seq"), "grade": grade, "gradeseq": F.col("grade_seq"), "stars": F.col("stars"),
        "label": F.col("label"), "tag": F.coalesce("tag", F.lit("untagged")), "orig": F.col("stem"),
    }
    suffix = F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    made = F.concat(N.templated(template, values, F.col("stem"), {"gradeseq": grade}), suffix)
    # a choice by place, not by case: Spark shares what repeats inside a name only where it is always computed
    return planned.withColumn("new_name", F.get(F.array(made, name), F.when(F.col("stars") == 0, 1).otherwise(0)) if by_grade else made)


def in_place(by_folder: bool = False) -> Column:
    """Planned files that are already where and what they shall be; ``by_folder``: whatever their names.  They are not sent and meet no collision."""
    here = choices.same_folder(N.parent(F.col("path")), F.col("folder"))
    return here if by_folder else here & (N.file_name(F.col("path")) == F.col("name"))


def _suffixed(name: str, n: int) -> str:
    stem, ext = os.path.splitext(name)
    return f"{stem}_{n:03d}{ext}" if n else name


def _parts(name: Column) -> tuple[Column, Column]:
    """Stem and extension with its dot; leading dots belong to the stem."""
    ext = F.regexp_extract(name, r"(?s)[^.].*?(\.[^.]*)$", 1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(ext)), ext


def _family(folder: Column, low: Column) -> Column:
    """What all suffixed forms of a folded name share."""
    stem, ext = _parts(low)
    return F.concat_ws("/", folder, F.concat(F.regexp_replace(stem, "(_[0-9]{3,})+$", ""), ext))


def _counted_names(planned: DataFrame, taken: DataFrame, skip: bool) -> DataFrame:
    """``final_name`` where all slot groups of tied families want the same ``__wide`` names: the k-th group takes the k-th number free for all of them.

    The j-th smallest taken number has ``number - (j - 1)`` free ones before
    it, so the k-th free number is k plus the taken ones with k of those or
    fewer.  All of it is ranking and running counts over the whole table, so a
    name of any number of copies is no single task.
    """
    stem, ext = _parts(F.col("__low"))
    wanted = planned.select("__tied", F.col("__low").alias("__wanted"), stem.alias("__stem"), ext.alias("__ext")).distinct()
    inside = F.col("__low").startswith(F.col("__stem")) & F.col("__low").endswith(F.col("__ext"))
    middle = F.substring(F.col("__low"), F.length("__stem") + 1, F.length("__low") - F.length("__stem") - F.length("__ext"))
    number = F.when(F.col("__low") == F.col("__wanted"), 0).when(inside & middle.rlike("^_(?!000$)([0-9]{3}|[1-9][0-9]{3,})$"), F.substring(middle, 2, 20).try_cast("long"))
    numbers = taken.join(wanted, "__tied").select("__tied", number.alias("__number")).where("__number is not null").distinct()
    before = numbered_within(numbers, ["__tied"], [F.col("__number")], "__j").select("__tied", (F.col("__number") - F.col("__j") + 1).alias("__at"), F.lit(1).alias("__taken"))
    copies = numbered_within(planned, ["__tied"], [F.col("pos"), F.col("item_id"), F.col("__k")], "__copy").withColumn("__at", F.floor((F.col("__copy") - 1) / F.col("__wide")))
    both = copies.withColumn("__taken", F.lit(0)).unionByName(before, allowMissingColumns=True)
    order = [F.col("__tied"), F.col("__at"), F.col("__taken").desc(), F.col("__copy")]
    placed = numbered(both, order, "__row", "__taken", "__upto")
    start = placed.groupBy("__tied").agg(F.min(F.col("__upto") - F.col("__taken")).alias("__start"))
    n = F.col("__at") + F.col("__upto") - F.col("__start")
    stem, ext = _parts(F.col("name"))
    suffix = F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))
    final = F.when(n == 0, F.col("name")).otherwise(F.lit(None).cast("string") if skip else F.concat(stem, F.lit("_"), suffix, ext))
    return placed.where("__taken = 0").join(start, "__tied").withColumn("final_name", final).select(*(c for c in planned.columns if c != "__wide"), "final_name")


def _numbered_form(low: Column) -> tuple[Column, Column]:
    """(base, number) of a folded name, which no other name has: ``a_002.jpg`` is number 2 of ``a/.jpg``, ``a.jpg`` number 0."""
    stem, ext = _parts(low)
    form = r"(?s)^(.*)_([0-9]{3}|[1-9][0-9]{3,17})$"
    number = F.coalesce(F.regexp_extract(stem, form, 2).try_cast("long"), F.lit(0))
    return F.concat(F.when(number > 0, F.regexp_extract(stem, form, 1)).otherwise(stem), F.lit("/"), ext), number


def _used_numbers(names: DataFrame) -> DataFrame:
    """Numbers in use as bits, one row for 64 numbers of a base: ``__tied, __base, __word, __bits``; ``names(__tied, __low)``."""
    base, number = _numbered_form(F.col("__low"))
    bit = F.expr("shiftleft(1L, cast(__number % 64 as int))")
    return names.select("__tied", base.alias("__base"), number.alias("__number")).groupBy("__tied", "__base", F.floor(F.col("__number") / 64).alias("__word")).agg(F.bit_or(bit).alias("__bits"))


def _take_numbers(skip: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Gives slot groups their names, one after the other; all names of a group take the first number that none of them has used."""

    def resolve(plans: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        every = (1 << 64) - 1
        used = {(b, w): bits & every for b, w, bits in zip(words["__base"], words["__word"], words["__bits"], strict=True)}
        plans = plans.sort_values(["pos", "item_id", "__k"], kind="stable")
        final: list[str | None] = []
        first_open: dict[tuple, int] = {}  # words are only ever filled
        columns = (plans[c] for c in ("pos", "item_id", "__k", "__low", "name", "__base", "__number", "__form"))
        for _, files in groupby(zip(*columns, strict=True), key=lambda r: r[:3]):
            *_, lows, names, bases, numbers, forms = zip(*files, strict=True)
            if len(set(lows)) < len(lows):
                raise ValueError(f"one slot group plans a name twice: {lows}")
            places, n = [(b, m // 64, 1 << m % 64) for b, m in zip(bases, numbers, strict=True)], 0
            if any(used.get((b, w), 0) & bit for b, w, bit in places):
                if skip:
                    final += [None] * len(names)
                    continue
                key = tuple(sorted(lows))
                word = first_open.get(key, 0)
                while not (free := every & ~reduce(or_, (used.get((f, word), 0) for f in forms), int(word == 0))):
                    word += 1
                first_open[key] = word
                bit = free & -free
                n = word * 64 + bit.bit_length() - 1
                places = [(f, word, bit) for f in forms]
            for b, w, bit in places:
                used[b, w] = used.get((b, w), 0) | bit
            final += [_suffixed(x, n) for x in names]
        return plans.assign(final_name=pd.Series(final, dtype=object, index=plans.index)).drop(columns=["__base", "__number", "__form"])

    return resolve


def _in_turn(hard: DataFrame, taken: DataFrame, skip: bool) -> DataFrame:
    """``final_name`` where slot groups of tied families want different names that meet.

    Each group's number depends on those of all groups before it, so a tied
    family goes in order: in turns of ``TURN_ROWS`` rows, a task for each family
    in each turn.  From turn to turn only the numbers in use go on, as bits, and
    a task reads those of the bases that its rows want.
    """
    base, number = _numbered_form(F.col("__low"))
    stem, ext = _parts(F.col("__low"))
    schema = hard.withColumn("final_name", F.lit(None).cast("string")).schema
    rows, turns = hard.withColumn("__turn", F.lit(0).cast("long")), 1
    if largest(hard, ["__tied"]) > TURN_ROWS:
        rows = numbered_within(hard, ["__tied"], [F.col("pos"), F.col("item_id"), F.col("__k"), F.col("__low")], "__row")
        last = F.max("__row").over(Window.partitionBy("__tied", "pos", "item_id", "__k"))  # an item's few files stay together
        rows = rows.withColumn("__turn", F.floor((last - 1) / TURN_ROWS)).drop("__row")
        rows = stored(rows.repartitionByRange("__turn", "__tied").sortWithinPartitions("__turn"))  # so that a turn reads its own rows
        turns = rows.agg(F.max("__turn")).first()[0] + 1
    rows = rows.withColumns({"__base": base, "__number": number, "__form": F.concat(stem, F.lit("/"), ext)})
    used = _used_numbers(taken.join(rows.select("__tied").distinct(), "__tied", "left_semi"))
    done = []
    for turn in range(turns):
        now = rows.where(F.col("__turn") == turn).drop("__turn")
        wanted = now.select("__tied", F.explode(F.array("__base", "__form")).alias("__base")).distinct()
        known = used.join(wanted, ["__tied", "__base"], "left_semi")
        done.append(now.groupBy("__tied").cogroup(known.groupBy("__tied")).applyInPandas(_take_numbers(skip), schema))
        if turn + 1 < turns:
            done[-1] = stored(done[-1])
            new = _used_numbers(done[-1].where("final_name is not null").select("__tied", F.lower("final_name").alias("__low")))
            used = stored(used.unionByName(new).groupBy("__tied", "__base", "__word").agg(F.bit_or("__bits").alias("__bits")))
    return reduce(DataFrame.unionByName, done)


def resolve_collisions(planned: DataFrame, existing: DataFrame, skip: bool = False) -> DataFrame:
    """Adds ``final_name``: conflict-free names in every target folder.

    ``planned(folder, pos, item_id, name)``, ``existing(folder, name)``.  Items
    come in order; the k-th file of one folded name in an item belongs to the
    item's k-th slot group, and a whole group moves to ``_001`` and so on
    together when any of its names is taken; ``skip`` gives null instead.
    Names meet only within a family (one folder, stem without number suffixes
    and extension), families only through a group that has files in several.
    Where a family holds a name that is wanted twice or taken, its copies are
    counted when all slot groups of it, and of the families tied to it, want the
    same names, one in each family.  The others, whose groups want different
    names that meet, go in order, a bounded number of rows at a time.  All other
    files keep their names.
    """
    planned = planned.withColumns({"__low": F.lower("name"), "__family": _family(F.col("folder"), F.lower("name"))})
    planned = planned.withColumn("__k", F.row_number().over(Window.partitionBy("folder", "item_id", "__low").orderBy("pos")) - 1)
    taken = existing.select("folder", F.lower("name").alias("__low")).distinct().withColumn("__family", _family(F.col("folder"), F.col("__low")))
    rivals = planned.groupBy("folder", "__low").agg(F.count("*").alias("n")).where("n > 1").select("folder", "__low")
    groups = planned.groupBy("folder", "pos", "item_id", "__k").agg(F.collect_set("__family").alias("all")).where("size(all) > 1")
    edges = groups.select(F.array_min("all").alias("src"), F.explode("all").alias("dst")).distinct()
    several = not edges.isEmpty()
    if not several:
        planned, taken = (df.withColumn("__tied", F.col("__family")) for df in (planned, taken))
    else:
        tied = connected_components(edges).select(F.col("node").alias("__family"), F.col("component").alias("__tied"))
        planned, taken = (df.join(tied, "__family", "left").withColumn("__tied", F.coalesce("__tied", "__family")) for df in (planned, taken))
    contested = planned.join(taken.select("folder", "__low").unionByName(rivals).distinct(), ["folder", "__low"], "left_semi").select("__tied").distinct()
    free = planned.join(contested, "__tied", "left_anti").withColumn("final_name", F.col("name"))
    disputed = stored(planned.join(contested, "__tied", "left_semi"))  # read for its families, its copies and what is left
    wide, wants = F.lit(1), disputed.select("__tied", F.col("__low").alias("__names"))
    if several:  # the names that each slot group wants, which are an item's few files
        names, families = F.collect_set("__low"), F.size(F.collect_set("__family"))
        wants = disputed.groupBy("__tied", "pos", "item_id", "__k").agg(
            F.when(F.size(names) == families, F.array_join(F.sort_array(names), "/")).alias("__names"), families.alias("__families")
        )
        wide = F.max("__families")
    alike = (F.min("__names") == F.max("__names")) & (F.count("__names") == F.count("*"))
    even = wants.groupBy("__tied").agg(wide.alias("__wide"), alike.alias("__alike")).where("__alike").select("__tied", "__wide")
    counted = _counted_names(disputed.join(even, "__tied"), taken.join(even.select("__tied"), "__tied", "left_semi"), skip)
    hard = disputed.join(even, "__tied", "left_anti")
    solved = _in_turn(hard, taken, skip)
    return free.unionByName(counted).unionByName(solved).drop("__k", "__low", "__family", "__tied")


def folder_counts(files: DataFrame, folder: Column) -> DataFrame:
    """Files per target folder."""
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"))


def report(results: DataFrame) -> DataFrame:
    """Totals of a transfer: ``status`` is sent, skipped, in_place or failed."""
    ext = N.kind(N.extension(F.col("path")))
    sent = F.col("status") == "sent"
    return results.agg(
        F.count_if(sent & (ext == "raw")).alias("raw"), F.count_if(sent & (ext == "image")).alias("images"), F.count_if(sent).alias("transferred"),
        F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "in_place").alias("in_place"),
        F.coalesce(F.sum(F.when(sent, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(F.col("status") == "failed").alias("failures"),
        F.count_if(sent & (N.file_name(F.col("path")) != F.col("final_name"))).alias("renames"),
        *([F.count_if(sent & F.col("left")).alias("remove_failed")] if "left" in results.columns else []),
    )


def _noted(mark: str) -> tuple[int, float] | None:
    """Size and time that a mark holds; None without one, or where its writer was lost half-way."""
    try:
        with open(mark) as file:
            size, modified, end = file.read().split(" ")
        return (int(size), float(modified)) if end == "." else None
    except (OSError, ValueError):
        return None


def _fill(source: str, target: str, part: str, move: bool) -> None:
    """Replaces ``target`` by the source itself or by a copy of it, made as ``part``."""
    if move and not os.path.islink(source):
        try:
            return os.replace(source, target)
        except OSError:  # another file system, or a source that can't be taken away
            pass
    try:
        shutil.copyfile(source, part)
        shutil.copystat(source, part)
        os.replace(part, target)
    except OSError:
        with suppress(OSError):
            os.unlink(part)
        raise


def deliver(source: str, target: str, mark: str, move: bool = False) -> tuple[int, bool]:
    """Puts ``source`` at ``target``, which must be free or ``mark``'s own: its size, and whether a moved source is left.

    The mark is written first; then the name is taken by an empty file that is
    replaced as a whole.  After a lost worker the next attempt finds the mark:
    what is complete stays, an empty file is filled, and another's file is an
    error as for everyone.
    """
    own = _noted(mark)
    again = own is not None
    if not again:
        if os.path.lexists(target):
            raise FileExistsError(target)
        stat = os.stat(source)
        own = stat.st_size, stat.st_mtime
        with open(mark, "w") as file:
            file.write(f"{own[0]} {own[1]!r} .")
    try:
        try:
            os.close(os.open(target, os.O_WRONLY | os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            if not again:
                raise
        there, gone = os.stat(target), not os.path.lexists(source)
        complete = there.st_size == own[0] and (gone or (own[0] > 0 and abs(there.st_mtime - own[1]) <= 2))  # some file systems keep time in steps of 2 s
        if not complete and there.st_size:
            raise FileExistsError(target)
        if not complete:
            try:
                _fill(source, target, f"{mark}.{uuid.uuid4().hex}", move)
            except OSError:
                os.unlink(target)
                raise
    except OSError:
        with suppress(OSError):
            os.unlink(mark)
        raise
    left = False
    if move and os.path.lexists(source):
        try:
            os.unlink(source)
        except OSError:
            left = True
    return own[0], left


def execute(planned: DataFrame, move: bool = False, run: str | None = None) -> DataFrame:
    """Copies or moves ``path`` to ``folder/final_name`` on a file system that all workers mount.

    A target that exists is never overwritten; a failed copy leaves nothing
    behind; a moved file whose source can't be removed still counts as sent, and
    is ``left``.  Marks beside the targets, hidden from scans, let a task that is
    run again after a lost executor finish what the lost one began.  With a name
    of the ``run`` they stay until ``tidy``, so that what the lost one had sent
    is known too; without, a mark goes with its file, and such files fail, as
    their names are taken.  Two attempts of one task at the same time
    (speculative execution) are not provided for.
    """
    prefix = f"._{run or uuid.uuid4().hex}-"

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for r in frame.itertuples():
                target = None if r.final_name is None else os.path.join(r.folder, r.final_name)
                status, size, left = "sent", 0, False
                if target is None:
                    status = "skipped"
                elif os.path.abspath(target) == os.path.abspath(r.path):
                    status = "in_place"
                else:
                    mark = os.path.join(r.folder, prefix + hashlib.sha256(os.fsencode(f"{r.path}\0{r.final_name}")).hexdigest())
                    try:
                        os.makedirs(r.folder, exist_ok=True)
                        size, left = deliver(r.path, target, mark, move)
                        if run is None:
                            os.unlink(mark)
                    except OSError:
                        status = "failed"
                rows.append((r.path, r.folder, r.final_name, status, size, left))
            yield pd.DataFrame(rows, columns=["path", "folder", "final_name", "status", "size", "left"])

    return planned.select("path", "folder", "final_name").mapInPandas(send, "path string, folder string, final_name string, status string, size long, left boolean")


def tidy(results: DataFrame, run: str) -> None:
    """Removes the marks of a run whose results are stored."""

    def clear(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for folder in frame["folder"]:
                with suppress(OSError), os.scandir(folder) as found:
                    for e in found:
                        if e.name.startswith(f"._{run}-"):
                            with suppress(OSError):
                                os.unlink(e.path)
            yield frame

    folders = results.where("status in ('sent', 'failed')").select("folder").distinct()
    folders.mapInPandas(clear, "folder string").write.format("noop").mode("overwrite").save()


def send(planned: DataFrame, move: bool = False) -> DataFrame:
    """``execute`` as one run, at once: each file is sent once, whatever executors are lost, and the results are stored."""
    run = uuid.uuid4().hex
    done = stored(execute(planned, move, run))
    tidy(done, run)
    return done


def organise(files: DataFrame, target: str, by: str) -> DataFrame:
    """``folder, pos, item_id, name, path`` to resolve and send: one row per member of ``files`` (with ``item_id, pos, path, exif_date, modified, camera, lens, focal``)."""
    folder = N.organise_folder(by, *(F.col(c) for c in ("path", "exif_date", "modified", "camera", "lens", "focal")))
    return files.select(F.concat(F.lit(target.rstrip("/") + "/"), folder).alias("folder"), "pos", "item_id", N.file_name(F.col("path")).alias("name"), "path")
