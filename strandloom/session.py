"""Session helpers: recommended settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every operator is written for.  Adaptive execution splits skewed
#: join partitions and coalesces small ones.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS to a session; every one of them is a runtime setting."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "strandloom", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset and no
    folder was given to the context, a temporary one is created for a local
    master (tests, a laptop); on a cluster that is an error, as no executor
    could read it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        current = current or tempfile.mkdtemp(prefix="strandloom-")
        context.setCheckpointDir(current)
    return current


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder, and read from there.

    The plan behind it is forgotten, so a lost executor repeats no more than the
    stage it worked on.  Tables are columnar and compressed; a reader fetches
    only the columns it needs.  :func:`discard` removes one.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/strandloom-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    done = spark.read.schema(df.schema).parquet(folder)
    done._strandloom_table = folder
    return done


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that :func:`cut` returned; nothing may read it later."""
    folder = getattr(df, "_strandloom_table", None)
    if folder:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan that has fewer partitions than the cluster has cores, dealt out to all of them.

    For work that is heavy for each row.  Large tables have more partitions than
    cores and are left alone; only pass scans, not results of joins.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
