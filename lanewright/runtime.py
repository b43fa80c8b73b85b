"""Session settings and the two ways this library cuts lineage.

Both ways put their files into the shared folder that the cluster names in
``spark.checkpoint.dir``; only where that setting is missing in a local session
(tests) is a temporary folder chosen.  ``localCheckpoint`` is never used, so the loss of
an executor costs a recomputed task and never the result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lanewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.parquet.compression.codec": "zstd",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where it is unset, a local session gets a temporary
    folder; on a cluster, whose machines share none, that is an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if folder is None:
        if current.isDefined():
            return current.get()
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lanewright-")
    if not current.isDefined():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed now and read back from a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tables stored so far, by session, that ``forget`` deletes.
_kept: dict[str, list[str]] = {}


def kept_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which ``forget`` deletes."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _kept.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again.

    Columnar and compressed, so a table that several passes read costs less
    disk than a checkpoint of its rows, and each pass reads only its columns.
    The caller of a query deletes what it stored with ``forget`` once its result is read.
    """
    spark = df.sparkSession
    path = kept_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Deletes the tables that this session stored; results that still read them are void. The number deleted."""
    paths = _kept.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    return len(paths)
