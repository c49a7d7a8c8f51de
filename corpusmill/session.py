"""Session, table access and the one place that knows about checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def get_spark(app: str = "corpusmill", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings that the operators assume: UTC, AQE and Arrow. Cluster settings win over these."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of the directory; Catalyst prunes columns and pushes filters into this scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the cluster's `spark.checkpoint.dir`; only where that is unset and none was set in code (tests,
    single machine) a temporary one is made and removed at exit.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getConf().get("spark.checkpoint.dir") is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="corpusmill-ckpt-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        sc.setCheckpointDir(d)
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """Name of a new folder that all executors share; the caller removes it, or else the end of the process."""
    folder = f"{_shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended before
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """`df` for row-wise work that is dear: spread over all cores where the scan gave fewer partitions than there are.

    Tables of real size have more splits than cores and pass as they are, without a shuffle; this only keeps a table of
    one small file from being worked on by one core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """`df` marked for broadcast if it has at most `most` rows, else as it is, so that the join is shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
