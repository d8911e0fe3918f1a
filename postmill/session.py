"""Session settings and the shared folder for written intermediates."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(app="postmill", master=None, shuffle_partitions=None, **conf):
    """A session with run-time re-planning, skew splitting and UTC; the cluster's own settings stay untouched otherwise."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark):
    """The folder named in spark.checkpoint.dir; a local master without one gets a temporary folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="postmill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark, label):
    """A fresh path under the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so later readers see one fixed set of rows and partitions."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label) -> DataFrame:
    """Materialise df as a parquet table in the shared folder and read it back."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
