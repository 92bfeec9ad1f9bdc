"""Session helpers: the shared folder of the cluster, lineage cuts, table readers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle: int = 8) -> SparkSession:
    """The session of tests and of bench.py; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rankweave")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Gives the package to all executors, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_rankweave_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="rankweave-")) / "rankweave.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"rankweave/{f.relative_to(root)}")
    sc.addPyFile(str(archive))
    sc._rankweave_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset (tests in one JVM) a temporary folder is set once per session.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    have = sc.getCheckpointDir()
    if have:
        return have.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="rankweave-")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table of a fresh name in the shared folder and reads it back.

    A column pruned, compressed cut of the lineage; the order of rows is not kept. The table is
    deleted when the application ends, or earlier by ``release``.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, which goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, where = _file_system(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    spark.sparkContext.__dict__.setdefault("_rankweave_tables", []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes the tables of ``fresh_path`` and ``written``; results that still read them must be stored before."""
    paths = spark.sparkContext.__dict__.pop("_rankweave_tables", [])
    for path in paths:
        files, where = _file_system(spark, path)
        files.delete(where, True)
    return len(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder (a file or a folder of files)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
