"""Session helper and the one way this package cuts lineage: a staged table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "crestline", **conf: str) -> SparkSession:
    """Session with adaptive execution on.  Keyword names use ``__`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        settings["spark.sql.shuffle.partitions"] = "8"
        settings["spark.driver.memory"] = "12g"
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def staging_root(spark: SparkSession) -> str:
    """Shared folder the session names in ``spark.checkpoint.dir``.

    A machine-local folder is chosen only for a local master that has none set;
    on a cluster it would be invisible to the other hosts, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    existing = context._jsc.sc().getCheckpointDir()
    if existing.isDefined():
        return existing.get()
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="crestline-"))
    return context._jsc.sc().getCheckpointDir().get()


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as parquet under the shared folder and read it back.

    Used where a table feeds several later steps: it is computed once, survives
    the loss of executors, and keeps column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.staged_path = path
    return read


def staged_as(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df``, a view of the staged ``source``, so that ``discard`` finds its table."""
    df.staged_path = getattr(source, "staged_path", None)
    return df


def discard(df: DataFrame) -> None:
    """Remove the table behind a staged frame that nothing reads any more."""
    path = getattr(df, "staged_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
