"""Stored tables by key: only buckets that change are written, killed and repeated writes, ties, nulls and new columns."""

import glob
import random

import pytest

from corvane.sources import keyed, load

KEYS = ["id"]


def frame(spark, rows, schema="id long, text string, version long"):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_only_changed_buckets_get_new_files(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.upsert(frame(spark, [(i, f"t{i}", 0) for i in range(200)]), path, KEYS, "version", buckets=8)
    before = {p.bucket: p.folder for p in keyed.manifest(spark, path)[1]}
    touched = keyed.upsert(frame(spark, [(5, "new", 1), (6, "late", -1), (7, "t7", 0)]), path, KEYS, "version")
    after = {p.bucket: p.folder for p in keyed.manifest(spark, path)[1]}
    assert len(touched) == 1 and {b for b in after if after[b] != before[b]} == set(touched)
    want = [(i, "new" if i == 5 else f"t{i}", int(i == 5)) for i in range(200)]
    assert rows(keyed.read(spark, path)) == rows(frame(spark, want))
    # the same update again, and one that loses, write nothing and make no manifest
    version = keyed.manifest(spark, path)[0]
    assert keyed.upsert(frame(spark, [(5, "new", 1), (5, "old", 0)]), path, KEYS, "version") == []
    assert keyed.manifest(spark, path)[0] == version
    some = keyed.read(spark, path, frame(spark, [(5,), (999,)], "id int"), KEYS)
    assert rows(some) == [(5, "new", 1)] and {f.split("/__bucket=")[1].split("/")[0] for f in some.inputFiles()} <= {str(b) for b in after}
    assert len({f.split("/__bucket=")[1].split("/")[0] for f in some.inputFiles()}) <= 2


def test_killed_write_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    keyed.upsert(frame(spark, [(1, "a", 0), (2, "b", 0)]), path, KEYS, "version", buckets=2)
    reader = keyed.read(spark, path)

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(keyed, "publish", killed)
        with pytest.raises(RuntimeError):
            keyed.upsert(frame(spark, [(1, "c", 1)]), path, KEYS, "version")
    assert rows(keyed.read(spark, path)) == [(1, "a", 0), (2, "b", 0)]
    assert len(glob.glob(f"{path}/data/*")) == 2
    keyed.upsert(frame(spark, [(1, "c", 1)]), path, KEYS, "version")
    assert rows(keyed.read(spark, path)) == [(1, "c", 1), (2, "b", 0)]
    assert rows(reader) == [(1, "a", 0), (2, "b", 0)]  # its files are still there
    assert len(keyed.vacuum(spark, path)) >= 1
    assert rows(keyed.read(spark, path)) == [(1, "c", 1), (2, "b", 0)]


def test_agrees_with_the_upsert_of_frames(spark, tmp_path):
    rng = random.Random(2)
    path = str(tmp_path / "t")
    draw = lambda n: [(rng.choice([None, *range(15)]), rng.choice([None, "x", "y", "z"]), rng.choice([None, 0, 1, 2])) for _ in range(n)]
    whole = frame(spark, [])
    for size in (0, 20, 20, 0):
        part = frame(spark, draw(size))
        keyed.upsert(part, path, KEYS, "version", buckets=4)
        whole = load.upsert(whole, part, KEYS, "version")
        assert size == 0 and not keyed.manifest(spark, path)[1] or rows(keyed.read(spark, path)) == rows(whole)


def test_new_and_missing_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.upsert(frame(spark, [(1, "a", 0), (2, "b", 0)]), path, KEYS, "version", buckets=4)
    keyed.upsert(frame(spark, [(2, 5, 1.5), (3, 1, 2.5)], "id int, version int, score double"), path, KEYS, "version")
    assert rows(keyed.read(spark, path)) == [(1, "a", 0, None), (2, None, 5, 1.5), (3, None, 1, 2.5)]
    with pytest.raises(ValueError):
        keyed.read(spark, str(tmp_path / "none"))
