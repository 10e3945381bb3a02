"""Sending after lost attempts, and numbers for files that stay together."""

import os
import random
import shutil
from itertools import count

import pytest

from shutterfold.operators import transfer


class Lost(BaseException):
    """An executor that goes away: nothing after it runs, not even cleaning."""


def _attempt(monkeypatch, step, source, target, mark, move, foreign_system):
    """Runs ``deliver`` until its ``step``-th call to the system; True when it came to its end."""
    calls = count()

    def counted(real):
        def call(*args, **kwargs):
            if next(calls) == step:
                raise Lost
            if foreign_system and real is os_replace and args[0] == source:
                raise OSError("other file system")
            return real(*args, **kwargs)

        return call

    os_replace = os.replace
    with monkeypatch.context() as m:
        for place, name in ((os, "open"), (os, "replace"), (os, "unlink"), (os, "stat"), (shutil, "copyfile"), (shutil, "copystat")):
            m.setattr(place, name, counted(getattr(place, name)))
        try:
            return transfer.deliver(source, target, mark, move)
        except Lost:
            return None


@pytest.mark.parametrize("text", ["content", ""])
@pytest.mark.parametrize("move, foreign_system", [(False, False), (True, False), (True, True)])
def test_another_attempt_finishes_what_a_lost_one_began(monkeypatch, tmp_path, text, move, foreign_system):
    for step in range(40):
        folder = tmp_path / str(step)
        folder.mkdir()
        source, target, mark = (str(folder / n) for n in ("a.jpg", "b.jpg", "._mark"))
        with open(source, "w") as file:
            file.write(text)
        os.utime(source, (1_000_000, 1_000_000))
        first = _attempt(monkeypatch, step, source, target, mark, move, foreign_system)
        again = transfer.deliver(source, target, mark, move)  # the task as a whole runs again, even after a complete file
        assert again == (len(text), False), step
        with open(target) as file:
            assert file.read() == text
        assert os.path.exists(source) != move
        if first is not None:
            return
    raise AssertionError("no attempt came to its end")


def test_files_of_others_stay(tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("a.jpg", "b.jpg", "._mark"))
    for path, text in ((source, "new"), (target, "old one"), (mark, "3 5.0 .")):
        with open(path, "w") as file:
            file.write(text)
    for _ in range(2):  # with a mark of a lost attempt, and without
        with pytest.raises(FileExistsError):
            transfer.deliver(source, target, mark, True)
        assert not os.path.exists(mark) and os.path.exists(source)
    os.unlink(source)
    os.unlink(target)
    with pytest.raises(FileNotFoundError):
        transfer.deliver(source, target, mark)
    assert not os.listdir(tmp_path)


SENT = "path string, folder string, final_name string"


def test_a_transfer_leaves_no_marks(spark, tmp_path):
    for n in range(5):
        (tmp_path / f"{n}.jpg").write_text(str(n))
    rows = [(str(tmp_path / f"{n}.jpg"), str(tmp_path / "out"), f"{n // 2}.jpg") for n in range(6)]
    done = transfer.send(spark.createDataFrame(rows, SENT).coalesce(1), move=True)
    for _ in range(2):  # results are stored; reading them again sends nothing
        assert sorted(r.status for r in done.collect()) == ["failed"] * 3 + ["sent"] * 3
    assert sorted(os.listdir(tmp_path / "out")) == ["0.jpg", "1.jpg", "2.jpg"]
    assert sorted(n for n in os.listdir(tmp_path) if n != "out") == ["1.jpg", "3.jpg"]
    assert transfer.send(spark.createDataFrame([], SENT)).count() == 0
    transfer.execute(spark.createDataFrame([(str(tmp_path / "1.jpg"), str(tmp_path / "out"), "one.jpg")], SENT)).collect()
    assert sorted(os.listdir(tmp_path / "out")) == ["0.jpg", "1.jpg", "2.jpg", "one.jpg"]


@pytest.mark.parametrize("move", [False, True])
def test_tasks_that_run_again_report_what_they_sent(spark, tmp_path, move):
    for n in range(4):
        (tmp_path / f"{n}.jpg").write_text(str(n))
    rows = [(str(tmp_path / f"{n}.jpg"), str(tmp_path / "out"), f"{n}.jpg") for n in range(4)]
    results = transfer.execute(spark.createDataFrame(rows, SENT), move, "r1")
    for _ in range(2):  # evaluated twice, as tasks of a lost executor are
        assert [(r.status, r.size, r.left) for r in results.collect()] == [("sent", 1, False)] * 4
    transfer.tidy(results, "r1")
    assert sorted(os.listdir(tmp_path / "out")) == [f"{n}.jpg" for n in range(4)] and [(tmp_path / f"{n}.jpg").exists() for n in range(4)] == [not move] * 4


def _greedy(planned, there, skip):
    """One slot group after the other takes the first number that is free for all its names."""
    used = {(f, n.lower()) for f, n in there}
    slots, seen = {}, {}
    for folder, pos, item, name in planned:
        k = seen[folder, item, name.lower()] = seen.get((folder, item, name.lower()), -1) + 1
        slots.setdefault((folder, pos, item, k), []).append(name)
    out = []
    for (folder, _, item, _), names in sorted(slots.items()):
        for n in count():
            new = [transfer._suffixed(x, n) for x in names]
            if not any((folder, x.lower()) in used for x in new):
                break
        if skip and n:
            new = [None] * len(names)
        else:
            used |= {(folder, x.lower()) for x in new}
        out += [(folder, item, x, y) for x, y in zip(names, new)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, turn_rows", [(0, 500_000), (1, 500_000), (2, 25), (3, 40)])
def test_pairs_keep_one_number(spark, monkeypatch, seed, turn_rows):
    monkeypatch.setattr(transfer, "TURN_ROWS", turn_rows)
    r = random.Random(seed)
    planned, there = [], []
    for item in range(60):
        stem = r.choice(["a", "B", "c_001", "d"])
        kinds = ["jpg", "nef"] if stem in "aB" or r.random() < 0.5 else [r.choice(["jpg", "nef"])]
        planned += [(r.choice("xy") if stem == "d" else "x", item, item, f"{stem}.{kind}") for kind in kinds]
    for stem in ("a", "b", "c", "d"):
        there += [("x", f"{stem}{s}.{kind}") for s in ("", "_001", "_002", "_0003", "_007", "_000", "_001_002", "_1234567890123456789012") for kind in ("JPG", "nef", "png") if r.random() < 0.4]
    df = spark.createDataFrame(planned, "folder string, pos int, item_id int, name string")
    existing = spark.createDataFrame(there, "folder string, name string")
    for skip in (False, True):
        got = transfer.resolve_collisions(df, existing, skip).collect()
        assert sorted(((x.folder, x.item_id, x.name, x.final_name) for x in got), key=str) == _greedy(planned, there, skip)
