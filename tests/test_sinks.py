"""Full refresh: the target holds exactly the last write."""

import os
import uuid

import pytest

from hubflow.sources import sinks
from hubflow.sources.sinks import full_refresh, materialize, read_refreshed, recover, release, shared_dir
from hubflow.sources.tables import read_source


def test_full_refresh_replaces_everything(spark):
    target = f"{shared_dir(spark)}/hubflow-tests/{uuid.uuid4().hex}"
    first = full_refresh(spark.range(10).toDF("x"), target)
    assert first.count() == 10
    second = full_refresh(spark.range(3).toDF("x"), target)
    assert sorted(r.x for r in second.collect()) == [0, 1, 2]


def test_full_refresh_of_a_folder_may_read_it_and_leaves_nothing_beside(spark, tmp_path):
    target = str(tmp_path / "report")
    full_refresh(spark.range(5).toDF("x"), target)
    again = full_refresh(spark.read.parquet(target).filter("x > 1"), target)
    assert sorted(r.x for r in again.collect()) == [2, 3, 4]
    assert [p.name for p in tmp_path.iterdir()] == ["report"]


def test_a_failed_refresh_keeps_the_old_rows(spark, tmp_path):
    target = str(tmp_path / "report")
    full_refresh(spark.range(5).toDF("x"), target)
    with pytest.raises(Exception):
        full_refresh(spark.range(5).selectExpr("raise_error('no')"), target)
    assert spark.read.parquet(target).count() == 5


def test_full_refresh_of_a_table(spark):
    name = f"refresh_{uuid.uuid4().hex}"
    try:
        full_refresh(spark.range(10).toDF("x"), name)
        assert sorted(r.x for r in full_refresh(spark.range(3).toDF("x"), name).collect()) == [0, 1, 2]
        assert spark.table(name).count() == 3
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


class Died(BaseException):
    """The job is gone: nothing of it runs any more."""


def _failing(kind, at, how):
    """A store whose ``at``-th rename fails in the way ``how``, and for a dead
    job all later ones."""
    calls = iter(range(1, 100))

    def rename(self, a, b):
        n = next(calls)
        if how == "false" and n == at:
            return False
        if how == "raises" and n == at:
            raise OSError("no")
        if how == "dies" and n >= at:
            raise Died
        if how == "half" and n == at:  # says yes, does nothing
            return True
        return kind.plain_rename(self, a, b)

    return rename


@pytest.mark.parametrize("how", ["false", "raises", "half", "dies"])
@pytest.mark.parametrize("at", [1, 2])
@pytest.mark.parametrize("kind", ["_Folder", "_Table"])
def test_rows_survive_every_failing_rename(spark, tmp_path, monkeypatch, kind, at, how):
    cls = getattr(sinks, kind)
    target = str(tmp_path / "report") if kind == "_Folder" else f"refresh_{uuid.uuid4().hex}"
    try:
        full_refresh(spark.range(5).toDF("x"), target)
        monkeypatch.setattr(cls, "plain_rename", cls.rename, raising=False)
        monkeypatch.setattr(cls, "rename", _failing(cls, at, how))
        with pytest.raises((sinks.RefreshError, OSError, Died)):
            full_refresh(spark.range(3).toDF("x"), target)
        monkeypatch.undo()
        if (how, at) == ("dies", 2):
            assert recover(spark, target)
        assert read_refreshed(spark, target).count() == 5
        assert not recover(spark, target)
        # and the next one goes through
        assert full_refresh(spark.range(2).toDF("x"), target).count() == 2
    finally:
        if kind == "_Table":
            for t in spark.catalog.listTables():
                if t.name.startswith(target):
                    spark.sql(f"DROP TABLE {t.name}")


def test_a_rename_that_cannot_be_undone_leaves_old_and_new_rows(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "report")
    full_refresh(spark.range(5).toDF("x"), target)
    plain = sinks._Folder.rename
    monkeypatch.setattr(sinks._Folder, "rename", lambda self, a, b: plain(self, a, b) if ".old-" in b else False)
    with pytest.raises(sinks.RefreshError):
        full_refresh(spark.range(3).toDF("x"), target)
    monkeypatch.undo()
    left = {p.name.split("-")[0]: spark.read.parquet(str(p)).count() for p in tmp_path.iterdir()}
    assert left == {"report.new": 3, "report.old": 5}
    assert read_refreshed(spark, target).count() == 5


def test_old_rows_of_a_job_that_died_late_are_deleted(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "report")
    full_refresh(spark.range(5).toDF("x"), target)

    def die(self, name):
        raise Died

    monkeypatch.setattr(sinks._Folder, "delete", die)
    with pytest.raises(Died):
        full_refresh(spark.range(3).toDF("x"), target)
    monkeypatch.undo()
    assert spark.read.parquet(target).count() == 3
    assert not recover(spark, target) and [p.name for p in tmp_path.iterdir()] == ["report"]


def test_a_table_may_be_refreshed_from_itself(spark):
    name = f"refresh_{uuid.uuid4().hex}"
    try:
        full_refresh(spark.range(5).toDF("x"), name)
        assert full_refresh(spark.table(name).filter("x > 2"), name).count() == 2
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_release_deletes_the_checkpoint(spark):
    df = materialize(spark.range(10))
    path = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
    folder = path.removeprefix("file:")
    assert os.path.isdir(folder) and df.count() == 10
    release(df)
    assert not os.path.exists(folder)


def test_shift_job_with_target_writes_and_releases(spark, inputs):
    from hubflow.plans.shift import shift_productivity
    from hubflow.sources.testdata import AS_OF

    target = f"{shared_dir(spark)}/hubflow-tests/{uuid.uuid4().hex}"
    stored = shift_productivity(inputs, AS_OF, target=target)
    assert stored.count() == shift_productivity(inputs, AS_OF).count()
    assert len(stored.columns) == 39


def test_read_source_prunes_columns(spark):
    df = read_source(spark, "/root/testdata/sf0.001/events.parquet", ["event_id", "ts"])
    assert df.columns == ["event_id", "ts"]
