"""Session defaults and the shared folder that work tables are written to."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(app: str = "linemend", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library is tuned for; `conf` keys use `__` for `.`."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "128m")
        .config("spark.scheduler.mode", "FAIR")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings that hold while a frame is put together and resolved; `__` stands for a dot."""
    wanted = {key.replace("__", "."): value for key, value in conf.items()}
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def code_pages(spark: SparkSession, lossy: bool = False):
    """While this holds, `decode_codepage` and `encode_codepage` resolve to the code pages of the JVM.

    Bytes that are no text are an error when the query runs, or with `lossy` U+FFFD.
    """
    return settings(spark, spark__sql__legacy__javaCharsets="true", spark__sql__legacy__codingErrorAction=str(lossy).lower())


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, which know the driver's import path only where they share it."""
    context = spark.sparkContext
    if getattr(context, "_linemend_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="linemend-package-")) / "linemend.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._linemend_shipped = True


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder all executors share.

    The folder is the one the cluster names in `spark.checkpoint.dir`. A folder of
    this machine is used only where that is unset and everything runs in one JVM.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@cache
def _own_folder() -> str:
    """One folder of this machine per driver process."""
    return tempfile.mkdtemp(prefix="linemend-")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) handles for driver-side metadata calls."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def drop_work_dir(spark: SparkSession, path: str) -> None:
    """Remove a folder that `work_dir` handed out, once nothing reads it any more."""
    fs, jvm_path = hadoop_path(spark, path)
    fs.delete(jvm_path, True)
