"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", memory: str | None = None, **settings) -> SparkSession:
    """A local session with the settings the library is tested with."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wardframe")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if memory is not None:
        builder = builder.config("spark.driver.memory", memory)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The application's scratch folder on storage that all executors share.

    It lies below the session's checkpoint folder, or below the warehouse
    where none is set, and goes when the application's JVM ends.  On a cluster
    a warehouse on the driver's own disk will not do.
    """
    sc = spark.sparkContext
    given = spark.conf.get(CHECKPOINT_DIR, None) or sc.getCheckpointDir()
    base = given or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{base.rstrip('/')}/wardframe-{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not given and not sc.master.startswith("local") and files.getUri().getScheme() == "file":
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later steps read the same rows whatever happens to an executor, the plan
    starts afresh, and unused columns are not read again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

