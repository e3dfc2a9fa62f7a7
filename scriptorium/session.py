"""Session, table reading and materialisation helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def build_session(cores: int | str = "*", app: str = "scriptorium") -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    n = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SCRIPTORIUM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, so that they need no install."""
    context = spark.sparkContext
    if getattr(context, "_scriptorium_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="scriptorium-"), "scriptorium_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("scriptorium", os.path.relpath(path, root)))
    context.addPyFile(target)
    context._scriptorium_shipped = True


def map_batches(df: DataFrame, function: Callable, schema: StructType | str) -> DataFrame:
    """mapInArrow by a function of this package, which the workers get with it."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def map_frames(df: DataFrame, function: Callable, schema: StructType | str) -> DataFrame:
    """mapInPandas by a function of this package, which the workers get with it."""
    ship_package(df.sparkSession)
    return df.mapInPandas(function, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session may go without the setting; it then gets a temporary folder of its own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def written_root(spark: SparkSession) -> str:
    """The folder of all that this application writes on the way."""
    return f"{shared_dir(spark)}/scriptorium/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of files, not a recomputation. What nothing reads any more is
    deleted by `discard`, the rest by `clean_up`.
    """
    path = f"{written_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scriptorium_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete what `materialise` wrote for these tables; nothing may read them afterwards."""
    for df in tables:
        _delete(df.sparkSession, df._scriptorium_path)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application wrote on the way, once its results are stored."""
    _delete(spark, written_root(spark))
