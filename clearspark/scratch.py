"""Tables written to cut lineage, in a folder that driver and executors share; and names that no column has."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what setCheckpointDir() was given.

    Only a session on one machine may do without: it gets a temporary folder. On a cluster a local folder
    would scatter the tables over the executors' disks, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if sc.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.gettempdir()


class Scratch:
    """A folder of this run under shared_folder(); lineage is cut by writing a table there.

    What is written stays until drop(), the end of the scope() it was made in, or the driver's end.
    """

    _open: list[list[Scratch]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/clearspark-{uuid.uuid4().hex}"
        atexit.register(self.drop)
        if Scratch._open:
            Scratch._open[-1].append(self)

    @classmethod
    @contextmanager
    def scope(cls) -> Iterator[None]:
        """Folders made inside go when it ends: for callers that write an operator's result within."""
        cls._open.append([])
        try:
            yield
        finally:
            for scratch in cls._open.pop():
                scratch.drop()
                atexit.unregister(scratch.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            for path in [self.path(n) for n in names] or [self.root]:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended; a cluster's cleaner takes the rest
            if names:
                raise


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it as long as df has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
