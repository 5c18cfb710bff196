"""Reading tables and cutting lineage, the same way in tests and on a cluster."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir.

    Where none is set, a folder of this machine does only if the executors are threads of
    the driver; elsewhere they would write to their own disks, so that is refused.
    """
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="codeweft-checkpoint-"))


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that a lost executor costs no lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables of one run below the shared one; it goes when the application ends."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = _file_system(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that no later step reads."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if it isn't there."""
    fs, p = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a table at a path of the shared folder, where later steps read only the columns they need."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_table(path: str):
    """A table of the shared folder as a pyarrow dataset, read by a task without Spark."""
    import pyarrow.dataset as ds  # not in the driver
    from pyarrow.fs import FileSystem

    fs, own = FileSystem.from_uri(path.replace("file:/", "/", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return ds.dataset(own, filesystem=fs, format="parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        root = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="codeweft-"), "codeweft.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        p = os.path.join(folder, n)
                        z.write(p, os.path.join("codeweft", os.path.relpath(p, root)))
        spark.sparkContext.addPyFile(archive)
