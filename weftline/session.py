"""A session with the settings that results depend on, and the tables that operators keep for a while."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open = threading.local()  # paths that each scope open in this thread has to delete, outermost first


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. In local mode, where all is one machine, a
    temporary one takes its place; on a cluster ValueError is raised, as a folder of one machine would lose rows."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _new(spark: SparkSession, name: str) -> str:
    at = f"{shared_folder(spark)}/weftline-{name}-{uuid.uuid4().hex[:12]}"
    path, files = _path(spark, at)
    files.deleteOnExit(path)  # whatever happens, nothing outlives the driver
    return at


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    df.write.parquet(at := _new(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(at), at


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet; what is written there is deleted as tables of kept() are."""
    at = _new(spark, name)
    if scopes := _scopes():
        scopes[-1].append(at)
    return at


def _scopes() -> list[list[str]]:
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    return _open.scopes


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, cut from its lineage: a Parquet table in the shared folder, which outlives any executor. It is deleted at the end of the
    scope that is open, or else when the driver ends."""
    out, at = _stored(df, name)
    if scopes := _scopes():
        scopes[-1].append(at)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """A scope: tables of kept() that are made within are deleted when it ends, also by an error."""
    scopes = _scopes()
    scopes.append(made := [])
    try:
        yield made
    finally:
        scopes.pop()
        for at in made:
            path, files = _path(spark, at)
            files.delete(path, True)


def tidied(f):
    """For a function that returns a DataFrame: its result is stored, and every other table that it kept is deleted. A result for
    which nothing was kept is returned as it is."""

    @functools.wraps(f)
    def run(*args, **named):
        with scratch(SparkSession.active()) as made:
            out = f(*args, **named)
            if not made:
                return out
            out, at = _stored(out, f.__name__)
        if scopes := _scopes():
            scopes[-1].append(at)
        return out

    return run


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of all tables of kept() that these read, when nothing needs them any more. A result that reads such tables
    can be given too, once it has been stored or used up."""
    for df in tables:
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/weftline-" in parent:
                path, files = _path(df.sparkSession, parent)
                files.delete(path, True)


def session(name: str = "weftline", **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; all else is left to the cluster or to conf."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
