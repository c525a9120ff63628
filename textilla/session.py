"""Session helpers: table loading and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a warehouse directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``). Where it is unset a local one is made in local mode, as in tests; a cluster needs one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not folder and not (sc.master.startswith("local[") or sc.master == "local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="textilla-"))
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of what runs go as soon as it is over."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


#: The frames that ``cut`` made within each open ``released``.
_OPEN: list[list[DataFrame]] = []


@contextmanager
def released() -> Iterator[None]:
    """The checkpoint files of all frames that ``cut`` makes within it go at its end: nothing lazy may leave it."""
    _OPEN.append([])
    try:
        yield
    finally:
        uncut(*_OPEN.pop())


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, with its lineage cut there; its shuffle files go as soon as it is written."""
    shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        out = df.select("*").checkpoint(eager=True)
    for frames in _OPEN[-1:]:
        frames.append(out)
    return out


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder: columns there take less than the rows of ``cut``."""
    path = new_path(df.sparkSession)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession) -> str:
    """A place for a table in the shared folder."""
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


def uncut(*frames: DataFrame) -> None:
    """Removes the checkpoint files of frames that ``cut`` made, once nothing that is still to be computed reads them."""
    for df in frames:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sent(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` with the hint to send it to every task if it has ``most`` rows or fewer; else as it is, for a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
