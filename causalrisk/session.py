"""Session settings and the shared folder for tables that several steps read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app_name: str = "causalrisk", **conf: str) -> SparkSession:
    """A session with the settings the operators assume; `conf` wins over them.

    Shuffle partition count and memory are left to the cluster unless given.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the one runtime setting that changes results: time is read in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local master may fall back to a folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="causalrisk-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Paths of stored tables by owner, and the owners of the blocks that are open now.
_TABLES: dict[str, list[str]] = {"session": []}
_OPEN: list[list[str]] = [_TABLES["session"]]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and return a reader over the files.

    Unlike a cached frame the files outlive executors, so values that Spark
    would assign anew on a retry (partition numbers) stay as first written.
    The table belongs to the innermost `scratch` or `owner` block, else to the
    session; `release` deletes what an owner has.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _OPEN[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block whose stored tables go when it ends, but for those stored by the function it yields.

    What leaves the block may only read tables of the second kind.
    """
    own: list[str] = []
    kept: list[str] = []
    _OPEN.append(own)

    def keep(df: DataFrame, label: str) -> DataFrame:
        out = materialise(df, label)
        own.remove(out._stored_at)
        kept.append(out._stored_at)
        return out

    try:
        yield keep
    finally:
        _OPEN.pop()
        _OPEN[-1].extend(kept)
        _delete(spark, own)


@contextmanager
def owner(name: str) -> Iterator[None]:
    """A block whose stored tables stay until `release(spark, name)`."""
    _OPEN.append(_TABLES.setdefault(name, []))
    try:
        yield
    finally:
        _OPEN.pop()


def release(spark: SparkSession, name: str = "session") -> None:
    """Delete the stored tables of an owner; results that read them can't be read any more."""
    paths = _TABLES.setdefault(name, [])
    _delete(spark, paths)
    paths.clear()


def discard(df: DataFrame) -> None:
    """Delete one table that `materialise` returned."""
    for paths in (*_TABLES.values(), *_OPEN):
        if df._stored_at in paths:
            paths.remove(df._stored_at)
    _delete(df.sparkSession, [df._stored_at])
