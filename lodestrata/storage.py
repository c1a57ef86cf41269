"""Cutting lineage and keeping intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where the setting is absent (as in local tests)."""
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set(CHECKPOINT_CONF, path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str = "t") -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "t", dictionary: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder once and return a DataFrame that reads it, so that no lineage is left.

    The table goes when the application ends. Without ``dictionary`` values are not looked up for repetition: cheaper where nearly all are different.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    _on_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """An equi-join of tables that grow with the input: by a shuffle, never by a broadcast.

    Spark takes a table that was written for as large as its compressed files, cut by the width that it expects of the columns
    read; texts in memory are many times that, and a broadcast of them ends the driver.
    """
    return left.join(right.hint("merge"), on, how)


def _folder(spark: SparkSession, path: str) -> tuple:
    """A folder and its file system, as Hadoop objects."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(context._jsc.hadoopConfiguration())


def _on_exit(spark: SparkSession, path: str) -> None:
    folder, files = _folder(spark, path)
    files.deleteOnExit(folder)


def temporary_path(spark: SparkSession, name: str = "t") -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = new_path(spark, name)
    _on_exit(spark, path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system that Hadoop knows."""
    folder, files = _folder(spark, path)
    files.delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and that nothing lazy needs any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/lodestrata/" in folder:
                delete_path(df.sparkSession, folder)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds."""
    folder, files = _folder(spark, path)
    return [s.getPath().getName() for s in files.listStatus(folder)]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file to any file system that Hadoop knows."""
    file, files = _folder(spark, path)
    out = files.create(file, True)
    out.write(bytearray(text.encode()))
    out.close()


class Shared:
    """A broadcast object of any class; executors need not be able to import that class.

    ``most`` bounds its pickled size: what is broadcast must not grow with the data beyond it.
    """

    def __init__(self, spark: SparkSession, value: object, most: int = 256 << 20):
        data = cloudpickle.dumps(value)
        if len(data) > most:
            raise ValueError(f"{len(data)} bytes are too many to broadcast; the bound is {most}")
        self._data = spark.sparkContext.broadcast(data)
        self._value: object = None

    def __getstate__(self) -> dict:
        return {"_data": self._data, "_value": None}

    @property
    def value(self) -> object:
        if self._value is None:
            self._value = cloudpickle.loads(self._data.value)
        return self._value
