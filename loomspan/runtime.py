"""Session helpers shared by all operators: input tables, shared storage, cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of an input directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    Read from ``spark.checkpoint.dir`` (or the directory already set on the context); only where
    both are unset, as in local tests, a temporary folder of this process is used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    option = spark.sparkContext._jsc.sc().getCheckpointDir()
    if option.isDefined():
        return option.get()
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="loomspan-")
        atexit.register(shutil.rmtree, _OWN_DIR[app], ignore_errors=True)
    return f"file://{_OWN_DIR[app]}"


class Scratch:
    """A path of its own in the shared folder, for files that are to go when nothing reads them any more."""

    def __init__(self, spark: SparkSession, label: str = "scratch"):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _LEFT.append(self)

    def drop(self) -> None:
        """Delete the files; call when nothing reads them any more."""
        if self in _LEFT:
            _LEFT.remove(self)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Stored(Scratch):
    """A DataFrame written once to the shared folder, so that later readers depend on no earlier stage."""

    def __init__(self, df: DataFrame, label: str = "stage"):
        super().__init__(df.sparkSession, label)
        schema = df.schema
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)


_LEFT: list[Scratch] = []


@contextmanager
def stored_scope() -> Iterator[None]:
    """Intermediate tables written within the block are deleted when it ends, and not only when the
    process does: for long sessions. Results that read them must be consumed or written inside."""
    before = list(_LEFT)
    try:
        yield
    finally:
        for stored in [x for x in _LEFT if not any(x is y for y in before)]:
            stored.drop()


def _drop_left() -> None:
    for stored in list(_LEFT):
        try:
            stored.drop()
        except Exception:  # the session has ended already
            if stored.path.startswith("file://"):
                shutil.rmtree(stored.path[7:], ignore_errors=True)


atexit.register(_drop_left)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
