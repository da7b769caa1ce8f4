"""Session defaults, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "placewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for; on a cluster the submitter's master holds."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WRITTEN: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's shared one named by ``spark.checkpoint.dir``. Only a local session that
    names none gets a temporary folder; on a cluster a folder of one machine would be lost with it, so that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not (spark.conf.get("spark.master", "") or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), "placewright-checkpoints")
    return f"{shared.rstrip('/')}/placewright-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, *used: DataFrame) -> DataFrame:
    """Write ``df`` once as a compressed table in the shared folder and read it from there: what follows neither depends on how it
    was made nor on executors that made it.

    ``used``: earlier results of :func:`cut` that nothing after this one reads; they are deleted. The folder goes when the
    application's driver ends. Shuffle files of the write are deleted with its end, not whenever the driver collects its garbage.
    """
    spark = df.sparkSession
    folder = _folder(spark)
    if folder not in _WRITTEN:
        _WRITTEN.append(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    for old in used:
        _remove(spark, old.cut_path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def once(udf):
    """A UDF that the optimiser neither repeats nor moves: a filter on its result is else pushed below it, which runs it twice."""
    return udf.asNondeterministic()


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone already: its folder is left to whoever owns the shared one
        pass
