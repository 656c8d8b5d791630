"""State generations: many saves, broken saves, two writers."""

import os
import uuid

import pytest

from tickloom.sources import journals

SCHEMA = "book string, updated_ms long, equity double"


def frame(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def state(spark, path):
    return sorted(tuple(r) for r in journals.load_state(spark, path, SCHEMA).collect())


def test_many_saves_leave_two_generations(spark, tmp_path):
    path = str(tmp_path / "state")
    assert state(spark, path) == []
    for k in range(12):
        journals.save_state(frame(spark, ("a", k, float(k)), (f"b{k % 3}", k, -1.0)), path)
    assert state(spark, path) == [("a", 11, 11.0), ("b0", 9, -1.0), ("b1", 10, -1.0), ("b2", 11, -1.0)]
    names = [n for n in os.listdir(path) if not n.startswith(".")]
    assert sum(n.startswith("gen") for n in names) == 2 and sum(n.startswith("current-") for n in names) == 2
    assert len({r.f.rsplit("/", 2)[1] for r in journals.load_state(spark, path, SCHEMA).selectExpr("_metadata.file_path as f").collect()}) == 1


def test_a_late_snapshot_does_not_win(spark, tmp_path):
    path = str(tmp_path / "state")
    journals.save_state(frame(spark, ("a", 5, 5.0)), path)
    journals.save_state(frame(spark, ("a", 3, 3.0), ("c", 1, 1.0)), path)
    assert state(spark, path) == [("a", 5, 5.0), ("c", 1, 1.0)]


def test_a_broken_save_leaves_the_old_generation(spark, tmp_path):
    path = str(tmp_path / "state")
    journals.save_state(frame(spark, ("a", 1, 1.0)), path)
    frame(spark, ("a", 9, 9.0)).write.json(f"{path}/gen0000000002_{uuid.uuid4().hex}")  # ended before its pointer
    assert state(spark, path) == [("a", 1, 1.0)]
    (tmp_path / "state" / "current-0000000002").write_text("")  # ended while its pointer was made
    assert state(spark, path) == [("a", 1, 1.0)]
    journals.save_state(frame(spark, ("a", 2, 2.0)), path)
    journals.save_state(frame(spark, ("a", 3, 3.0)), path)
    assert state(spark, path) == [("a", 3, 3.0)]
    assert sum(n.startswith("gen") for n in os.listdir(path)) == 2


def test_of_two_writers_the_later_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "state")
    journals.save_state(frame(spark, ("a", 1, 1.0)), path)
    seen = journals._current(spark, path)
    journals.save_state(frame(spark, ("a", 2, 2.0)), path)
    monkeypatch.setattr(journals, "_current", lambda *_: seen)
    with pytest.raises(RuntimeError):
        journals.save_state(frame(spark, ("a", 3, 3.0)), path)
    monkeypatch.undo()
    assert state(spark, path) == [("a", 2, 2.0)]
