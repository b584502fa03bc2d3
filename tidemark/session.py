"""Session builder and the shared-folder checkpoint used to cut lineage."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "tidemark", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` overrides (dots written as ``__``)."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where it is neither installed nor on PYTHONPATH.

    Spark itself copies the archive from the driver to every executor.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    _shipped.add(application)
    package = Path(__file__).resolve().parent
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *(p for p in sys.path if p.endswith("site-packages"))]
    if str(package.parent) in known:
        return
    archive = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / "tidemark_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in package.rglob("*.py"):
            z.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a folder of this machine will do for a local master (tests); on a cluster
    executors would each write to their own disks, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        if chosen.isDefined():
            return chosen.get()
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, whose files go when the application ends."""
    path = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: short lineage that survives lost executors.

    A Parquet table is preferred to ``DataFrame.checkpoint`` because it is compressed and its
    columns can be pruned by the readers. The files go when the application ends, or with
    :func:`drop_materialized`.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, key: str | None = None) -> DataFrame:
    """A scan of fewer partitions than the session has cores, dealt out to all of them, by ``key`` if given.

    By a key that later steps group on, their shuffles are spared.

    For tables of few row groups whose rows are costly to work on; larger scans stay as they are,
    without a shuffle. ``scan`` must be a plain read with projections and filters.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() * 2 > cores:
        return scan
    return scan.repartition(cores, key) if key else scan.repartition(cores)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`materialize` that nothing will read again."""
    spark = df.sparkSession
    jvm = spark._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tidemark-" not in name:
            continue
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
