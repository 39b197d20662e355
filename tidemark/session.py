"""Session, table access and durable intermediate results."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def session(app: str = "tidemark", master: str | None = None) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; settings given by
    the cluster are kept."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, which a cluster
    has to set. Only a local master may do without; it gets a folder of its
    own."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    d = os.path.join(tempfile.gettempdir(), f"tidemark-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", f"file://{d}")
    return f"file://{d}"


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder, removed with the session."""
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage,
    survives lost executors, and is read by column. The table goes with
    discard(), at the end of a scope(), or with the session."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tm_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended already
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def discard(*tables: DataFrame) -> None:
    """Remove tables of materialise() that nothing reads any more, as the last
    round's in a loop. Other frames are left alone."""
    for t in tables:
        path = getattr(t, "tm_path", None)
        for k, (spark, known) in enumerate(_written):
            if known == path:
                _remove(spark, path)
                del _written[k]
                break


@contextlib.contextmanager
def scope():
    """Tables written within go when the block ends, so results have to be
    consumed in it: with scope(): query(spark, d).write..."""
    before = len(_written)
    kept = _written[:before]
    try:
        yield
    finally:
        for entry in [x for x in _written if x not in kept]:
            _written.remove(entry)
            _remove(*entry)


def release() -> None:
    """Remove all tables that materialise() wrote."""
    while _written:
        _remove(*_written.pop())


atexit.register(release)
