"""What every operator needs from the session: input tables and a shared place for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where none is named, a folder of our own, but only in local mode (tests, one
    machine): on a cluster every executor would write to a disk of its own, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="matchloom-")
    return f"file://{own}"


_RUN = uuid.uuid4().hex
_folders: dict[str, SparkSession] = {}


@atexit.register
def _clean() -> None:
    """Removes this run's tables: local ones by their path, others through the session while it is still there."""
    for path, spark in _folders.items():
        local = path.removeprefix("file://")
        if local.startswith("/"):
            shutil.rmtree(local, ignore_errors=True)
            continue
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: the cluster's own cleaning is left
            pass


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in this run's part of the shared folder."""
    folder = f"{shared_dir(spark)}/matchloom/{_RUN}"
    _folders[folder] = spark
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    Cuts the lineage, survives lost executors (unlike a local checkpoint) and gives the optimizer true sizes.
    """
    path = new_path(df.sparkSession, name)
    if keys:
        df = df.repartition(*keys)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes kept tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_kept_at", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
