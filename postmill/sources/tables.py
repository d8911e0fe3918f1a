"""Scans, appends and snapshots of the six tables."""

from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from postmill import constants as K, model
from postmill.functions.keys import bucket
from postmill.operators.intake import KEY
from postmill.operators.lookups import fences
from postmill.operators.spread import attach

BUCKETED = ("mailing_entries", "dead_letters")


def read_table(spark: SparkSession, path, name) -> DataFrame:
    """A table under its fixed schema. The two tall tables also carry the folder column `bucket`."""
    schema = model.TABLES[name]
    if name in BUCKETED:
        schema = model.T.StructType([*schema.fields, model.T.StructField("bucket", model.T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def of_mailing(table: DataFrame, mailing_id) -> DataFrame:
    """Rows of one mailing; the folder filter prunes the scan."""
    return table.where((F.col("bucket") == bucket(F.lit(mailing_id))) & (F.col("mailing_id") == mailing_id))


def matching(spark: SparkSession, pattern) -> list:
    """Paths that fit a pattern, asked of the store that the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return [str(f.getPath()) for f in found or ()]


def exists(spark: SparkSession, pattern) -> bool:
    return bool(matching(spark, pattern))


def _fitted(df, name):
    """The table's columns; missing ones are null, and a column that the table does not have is an error."""
    unknown = [c for c in df.columns if c not in model.TABLES[name].names and c != "bucket"]
    if unknown:
        raise ValueError(f"{name} has no column {', '.join(unknown)}")
    kept = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
            else F.lit(None).cast(f.dataType).alias(f.name) for f in model.TABLES[name].fields]
    return df.select(*kept)


def _placed(df, name):
    """The table's columns, with the folder if the table has one."""
    out = _fitted(df, name)
    return out.withColumn("bucket", bucket(F.col("mailing_id"))) if name in BUCKETED else out


def _writer(df, name, mode):
    """Rows gathered by folder into files of even size; run-time re-planning splits a folder that one mailing fills."""
    if name not in BUCKETED:
        return df.write.mode(mode)
    return df.hint("rebalance", "bucket").write.mode(mode).partitionBy("bucket")


def append(df: DataFrame, path, name):
    """Add rows."""
    _writer(_placed(df, name), name, "append").parquet(f"{path}/{name}")


def buckets_of(df: DataFrame, mailing_ids=None) -> list:
    """Folders of the mailings of df, or of the given ones: at most BUCKETS numbers."""
    if mailing_ids is not None:
        df = df.sparkSession.createDataFrame([(m,) for m in mailing_ids], "mailing_id string")
    return [r["bucket"] for r in df.select(bucket(F.col(_key(df))).alias("bucket")).distinct().collect()]


@contextmanager
def _observing(spark):
    """Keep observed counts of parts whose result turns out to be empty: such parts would be cut out of the running plan."""
    name, rule = "spark.sql.adaptive.optimizer.excludedRules", "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"
    old = spark.conf.get(name, None)
    spark.conf.set(name, f"{old},{rule}" if old else rule)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


def append_new_entries(candidates: DataFrame, path, mailing_ids=None):
    """Append entries whose key is not stored; returns the counts (inserted, duplicates).

    Only the stored folders of the load's mailings are read, and the join goes by folder too. The counts are observed while
    the rows are written, once. Running the same load again adds nothing.
    """
    spark = candidates.sparkSession
    given, added = Observation(), Observation()
    load = _placed(candidates, "mailing_entries").observe(given, F.count(F.lit(1)).alias("rows"))
    fresh = load.dropDuplicates(["bucket", *KEY])
    if exists(spark, f"{path}/mailing_entries"):
        stored = read_table(spark, path, "mailing_entries").where(F.col("bucket").isin(buckets_of(candidates, mailing_ids)))
        fresh = fresh.join(stored.select("bucket", *KEY), ["bucket", *KEY], "left_anti")
    columns = [*model.TABLES["mailing_entries"].names, "bucket"]
    fresh = fresh.select(*columns).observe(added, F.count(F.lit(1)).alias("rows"))
    with _observing(spark):
        fresh.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/mailing_entries")
    inserted = added.get.get("rows", 0)
    return {"inserted": inserted, "duplicates": given.get.get("rows", 0) - inserted}


def write_snapshot(df: DataFrame, path, name, version):
    """A full next state under its own version folder; readers switch by version, so a failed write is never seen."""
    _writer(_placed(df, name), name, "errorifexists").parquet(f"{path}/{name}/v{version}")


def write_fences(entries: DataFrame, path, every=K.FENCE_ROWS):
    """Marks of every n-th row of each mailing beside the stored entries, in folders of the same buckets."""
    marks = fences(entries, "mailing_id", every=every)
    marks.withColumn("bucket", bucket(F.col("mailing_id"))).hint("rebalance", "bucket").write.mode("overwrite").partitionBy(
        "bucket").parquet(f"{path}/mailing_entries_fences")


def read_fences(spark: SparkSession, path) -> DataFrame:
    schema = "mailing_id string, created_at timestamp_ntz, id string, slot bigint, bucket int"
    return spark.read.schema(schema).parquet(f"{path}/mailing_entries_fences")


# --- tables that change folder by folder -------------------------------------------------------------------------------
#
# path/name/run=<run>/bucket=<n>/   rows of one folder as one change left them
# path/name/_versions/<number>      which run holds each folder; the highest finished number counts


def _key(df):
    return "mailing_id" if "mailing_id" in df.columns else "id"


def _version(spark, path, name):
    """(number, {bucket: run}): the highest number in use, and the run of each folder by the last finished version."""
    folder = f"{path}/{name}/_versions"
    used = max((int(f.rsplit("/", 1)[1]) for f in matching(spark, f"{folder}/*")), default=0)
    done = max((int(f.rsplit("/", 2)[1]) for f in matching(spark, f"{folder}/*/_SUCCESS")), default=0)
    if not done:
        return used, {}
    rows = spark.read.schema("bucket int, run string").json(f"{folder}/{done:010d}").collect()  # one row per folder
    return used, {r["bucket"]: r["run"] for r in rows}


def _folders(spark, path, name, runs):
    schema = model.T.StructType([*model.TABLES[name].fields, model.T.StructField("run", model.T.StringType()),
                                 model.T.StructField("bucket", model.T.IntegerType())])
    if not runs:
        return spark.createDataFrame([], schema)
    places = [f"{path}/{name}/run={run}/bucket={n}" for n, run in sorted(runs.items())]
    return spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(*places)


def current(spark: SparkSession, path, name, mailing_ids=None) -> DataFrame:
    """The present rows of a table kept by `change`; with mailing_ids only the folders of these mailings are opened."""
    _, runs = _version(spark, path, name)
    if mailing_ids is None:
        return _folders(spark, path, name, runs).drop("run")
    wanted = set(buckets_of(spark.range(0), mailing_ids))
    rows = _folders(spark, path, name, {n: run for n, run in runs.items() if n in wanted}).drop("run")
    return rows.where(F.col(_key(rows)).isin(list(mailing_ids)))


def change(changes: DataFrame, path, name, step, run):
    """Replace the rows of the mailings that `changes` names by step(their rows, changes).

    Only the folders of these mailings are read and written, as a new run, whose name must be new; folders that are not
    touched stay where they are. The version that leads readers to the run is written last, so a failed write stays unseen,
    and of two changes at the same time the second fails. Returns the numbers of the folders touched.
    """
    spark = changes.sparkSession
    number, runs = _version(spark, path, name)
    touched = buckets_of(changes)
    rows = _folders(spark, path, name, {n: runs[n] for n in touched if n in runs}).drop("run", "bucket")
    after = step(rows, changes)
    after = _fitted(after, name).withColumn("bucket", bucket(F.col(_key(after))))
    place = f"{path}/{name}/run={run}"
    after.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)
    written_ = {int(f.rsplit("bucket=", 1)[1]) for f in matching(spark, f"{place}/bucket=*")}
    if not written_ <= set(touched):
        raise ValueError("a step gave rows of mailings that were not asked for")
    now = {n: r for n, r in runs.items() if n not in touched} | {n: str(run) for n in written_}
    marker = spark.createDataFrame(sorted(now.items()), "bucket int, run string").coalesce(1)
    marker.write.mode("errorifexists").json(f"{path}/{name}/_versions/{number + 1:010d}")
    return sorted(touched)


# --- several tables in one commit ----------------------------------------------------------------------------------------


def commit(path, run, **tables):
    """Write rows for several tables as one run: readers see all of them or, when a write failed, none.

    Each table gets its own folder of the run; the marker that makes the run visible is written last. Writing the same
    run again replaces its folders.
    """
    for name, df in tables.items():
        _placed(df, name).write.mode("overwrite").parquet(f"{path}/{name}/run={run}")
    spark = next(iter(tables.values())).sparkSession
    marker = spark.range(1).select(F.lit(run).cast("string").alias("run"))
    marker.write.mode("overwrite").json(f"{path}/commits/{run}")


def read_committed(spark: SparkSession, path, name) -> DataFrame:
    """Rows of the finished runs of a table written by `commit`."""
    schema = model.T.StructType([*model.TABLES[name].fields, model.T.StructField("run", model.T.StringType())])
    if name in BUCKETED:
        schema = schema.add(model.T.StructField("bucket", model.T.IntegerType()))
    if not exists(spark, f"{path}/commits/*"):
        return spark.createDataFrame([], schema)
    done = spark.read.schema("run string").json(f"{path}/commits/*").distinct()
    return attach(spark.read.schema(schema).parquet(f"{path}/{name}"), done, ["run"], "left_semi")


def archive_raw(rows: DataFrame, path):
    """Raw rows of uploads, in one folder per mailing with the name of their source file.

    rows: mailing_id, source_file, raw_email, line_no.
    """
    base = F.concat_ws("_", "mailing_id", F.element_at(F.split("source_file", "/"), -1))
    rows.withColumn("archived_as", base).write.mode("append").partitionBy("mailing_id").parquet(path)
