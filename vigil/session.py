"""Sessions, the shared folder, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def local_session(cores: str | int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vigil")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that
    functions which run there can import it. Spark's own file server carries
    the archive; executors need no shared folder for it."""
    context = spark.sparkContext
    if getattr(context, "_vigil_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="vigil-"), "vigil_package.zip")
    parent = os.path.dirname(_PACKAGE)
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(_PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, parent))
    context.addPyFile(target)
    context._vigil_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver can reach: the session's
    ``spark.checkpoint.dir``. Only where that is unset, as in tests on one
    machine, a temporary folder is made; on a cluster that is an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = context._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="vigil-shared-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/vigil-{name}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back. Cuts the
    lineage, so a lost executor costs only the tasks it was running."""
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
