"""Sinks."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session without the setting gets a fresh temporary folder;
    on a cluster the setting is required, since a machine-local folder would
    not survive the loss of the machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="hubflow-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


class RefreshError(RuntimeError):
    """A refresh that could not put the new rows in place; the old ones stay."""


class _Folder:
    """A target that is a folder of files."""

    def __init__(self, spark: SparkSession, target: str, fmt: str):
        self.spark, self.target, self.fmt = spark, target.rstrip("/"), fmt
        self.fs, _, self.path = _fs(spark, self.target)

    def beside(self, kind: str, run: str) -> str:
        return f"{self.target}.{kind}-{run}"

    def write(self, df: DataFrame, name: str) -> None:
        df.write.format(self.fmt).save(name)

    def read(self) -> DataFrame:
        return self.spark.read.format(self.fmt).load(self.target)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def rename(self, a: str, b: str) -> bool:
        return self.fs.rename(self.path(a), self.path(b))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def left(self, kind: str) -> list[str]:
        parent, _, name = self.target.rpartition("/")
        found = self.fs.globStatus(self.path(f"{parent}/{name}.{kind}-*")) or []
        return sorted(f"{parent}/{x.getPath().getName()}" for x in found)


class _Table:
    """A target that is a table of the catalog."""

    def __init__(self, spark: SparkSession, target: str, fmt: str):
        self.spark, self.target, self.fmt = spark, target, fmt

    def beside(self, kind: str, run: str) -> str:
        return f"{self.target}__{kind}_{run}"

    def write(self, df: DataFrame, name: str) -> None:
        df.write.format(self.fmt).saveAsTable(name)

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.target)
        return self.spark.table(self.target)

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def rename(self, a: str, b: str) -> bool:
        self.spark.sql(f"ALTER TABLE {a} RENAME TO {b}")
        return True

    def delete(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def left(self, kind: str) -> list[str]:
        db, _, name = self.target.rpartition(".")
        found = [t.name for t in self.spark.catalog.listTables(db or None)]
        return sorted(f"{db}.{t}" if db else t for t in found if t.startswith(f"{name}__{kind}_"))


def _store(spark: SparkSession, target: str, fmt: str) -> _Folder | _Table:
    return (_Folder if "/" in target else _Table)(spark, target, fmt)


def _move(store: _Folder | _Table, a: str, b: str) -> None:
    """Rename, and make sure of it: many file systems return false, or put the
    folder inside one that is already there, instead of raising."""
    if store.exists(b):
        raise RefreshError(f"{b} is already there")
    if not store.rename(a, b) or store.exists(a) or not store.exists(b):
        raise RefreshError(f"{a} could not be renamed to {b}")


def full_refresh(df: DataFrame, target: str, fmt: str = "parquet") -> DataFrame:
    """Replace everything in ``target`` with ``df`` and return the stored rows.

    ``target`` is a catalog table name or a folder path. The new rows are written
    beside it in full, then the target is renamed away, the new rows take its
    place, and only then the old ones are deleted. Each rename is checked. If
    one fails, the old rows are put back and the error is raised; if the job dies
    between the renames, the next ``full_refresh`` or ``read_refreshed`` puts
    them back. So at any time the old or the new rows are there in full; for the
    moment between the renames readers need ``read_refreshed``. ``df`` may read
    the target. One refresh of a target runs at a time. Row order is not kept."""
    spark = df.sparkSession
    store = _store(spark, target, fmt)
    recover(spark, target, fmt)
    run = f"{time.time_ns():020d}_{uuid.uuid4().hex}"  # later runs sort after earlier ones
    fresh, old = store.beside("new", run), store.beside("old", run)
    try:
        store.write(df, fresh)
        had_rows = store.exists(store.target)
        if had_rows:
            _move(store, store.target, old)
        try:
            _move(store, fresh, store.target)
        except Exception:
            if had_rows:
                _move(store, old, store.target)
            raise
    except Exception:
        if store.exists(store.target):  # else the new rows may be all there is
            store.delete(fresh)
        raise
    store.delete(old)
    return store.read()


def recover(spark: SparkSession, target: str, fmt: str = "parquet") -> bool:
    """Finish what a dead refresh left: without a target, its old rows are put
    back (True); with one, old rows beside it are deleted."""
    store = _store(spark, target, fmt)
    left = store.left("old")
    restored = bool(left) and not store.exists(store.target)
    if restored:
        _move(store, left.pop(), store.target)
    for name in left:
        store.delete(name)
    return restored


def read_refreshed(spark: SparkSession, target: str, fmt: str = "parquet") -> DataFrame:
    """The rows of a refreshed target, after ``recover``. Not while a refresh
    of the same target runs."""
    recover(spark, target, fmt)
    return _store(spark, target, fmt).read()


def _fs(spark: SparkSession, target: str):
    """The file system of ``target``, its path, and how to make other paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    path = make(target)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path, make


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder and continue from there:
    a reliable checkpoint (it survives the loss of an executor) that cuts the
    lineage, so later plans stay small. The frame's partitioning is kept."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Delete the checkpoint files of a materialised frame that no later plan
    reads. (Else Spark's cleaner removes them with the frame, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.)"""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        fs, path, _ = _fs(df.sparkSession, file.get())
        fs.delete(path, True)
