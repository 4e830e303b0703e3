"""Session set-up, the package on the workers, and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator relies on (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run there are pickled by name, so workers that start in another folder
    have to be able to import it.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = Path(SparkFiles.getRootDirectory(), "shipped")
    folder.mkdir(exist_ok=True)
    target = folder / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, os.fspath(path.relative_to(package.parent)))
    context.addPyFile(os.fspath(target))
    _shipped.add(context.applicationId)


_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; without that setting one in the warehouse."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and current.isDefined():
        return current.get()
    if configured is None:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidewright-scratch"
    if current.isEmpty():
        context.setCheckpointDir(configured)
    return configured


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = (),
                spread: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    Cuts the lineage, survives the loss of executors and keeps column pruning
    for the readers, which a row-wise checkpoint would not. ``spread`` names a
    column by whose hash the rows are dealt to files of the size the session advises,
    for plans that end in few or uneven partitions.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if spread:
        df = df.hint("rebalance", spread)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written.append(path)
    return spark.read.schema(schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for loops that refine one frame round after round."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def drop_materialized(spark: SparkSession, first: int = 0) -> None:
    """Delete the tables this process wrote with ``materialize``, from the given one on, once nothing reads them any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while len(_written) > first:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was written within: for plans whose result is complete by then."""
    first = len(_written)
    try:
        yield
    finally:
        drop_materialized(spark, first)
