"""Sources and sinks shared by the streaming jobs."""

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def files(spark: SparkSession, path, schema, kind="parquet", per_trigger=None, **options) -> DataFrame:
    """A stream over the files of a folder (or of a path pattern), optionally a few files per micro-batch."""
    reader = spark.readStream.schema(schema).options(**options)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.format(kind).load(path)


def folder(spark: SparkSession, path):
    """The path, made if it is not there yet: a stream may start before its folder has files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    return path


def with_rocksdb(spark: SparkSession):
    """Keyed timers need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


@contextmanager
def _state_partitions(spark):
    """One state partition per core unless the session says otherwise: each one is committed in every micro-batch.

    A query keeps the number of its first start, whatever the session says later.
    """
    name = "spark.sql.shuffle.partitions"
    current = spark.conf.get(name)
    if current != "200" or spark.sparkContext.getConf().contains(name):
        yield
        return
    spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, current)


def _start(stream, writer, checkpoint, trigger, path=None):
    writer = writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    with _state_partitions(stream.sparkSession):
        return writer.start(path) if path else writer.start()


def to_files(stream: DataFrame, out, checkpoint, trigger=None):
    """Append the stream to a parquet folder; the sink's log makes a repeated micro-batch harmless."""
    return _start(stream, stream.writeStream.format("parquet").outputMode("append"), checkpoint, trigger, out)


def run_of(batch: DataFrame) -> str:
    """The id of the streaming query that a micro-batch belongs to; it lives in the checkpoint and survives restarts."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def for_each(stream: DataFrame, checkpoint, store, mode="append", trigger=None):
    """Hand every micro-batch to store(batch, batch_id)."""
    return _start(stream, stream.writeStream.foreachBatch(store).outputMode(mode), checkpoint, trigger)


def to_batches(stream: DataFrame, out, checkpoint, work=None, mode="append", trigger=None, by=None):
    """Write work(batch, batch_id) of every micro-batch to a folder of its own, out/run=<query>/batch=<id>, and in it by the
    folder column `by`, if any.

    A micro-batch that runs again after a failure overwrites its own folder, so nothing is stored twice. A query with a
    new checkpoint is a new run, so it never replaces what an earlier one has stored.
    """

    def store(batch, batch_id):
        result = batch if work is None else work(batch, batch_id)
        writer = result.hint("rebalance", by).write.partitionBy(by) if by else result.write
        writer.mode("overwrite").parquet(f"{out}/run={run_of(batch)}/batch={batch_id}")

    return for_each(stream, checkpoint, store, mode, trigger)


def finish(query):
    """Wait for a run over the available input; a failed run raises."""
    query.awaitTermination()
    return query


def stored(spark: SparkSession, out, schema=None) -> DataFrame:
    """What the batches have written so far."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("basePath", out).parquet(f"{out}/run=*/batch=*")


def anything_stored(spark: SparkSession, out) -> bool:
    """Whether some batch has written into the folder."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/run=*/batch=*")
    return bool(pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern))


def combine_last(stream: DataFrame, keys, order, clock=None) -> DataFrame:
    """Keep only the last row per key of each Arrow batch before the rows are shuffled by key.

    For a hot key this sends one row per Arrow batch to the task that owns its state instead of every row. With `clock`, a new
    column of that name is null in these rows, so that a watermark on it finds none of them late, and the last row of the
    batch comes once more as a tick that carries its time (the first column of `order`) there.
    """
    keys, order = list(keys), list(order)

    def last_rows(batches):
        for rows in batches:
            rows = rows.sort_values(order, kind="stable")
            kept = rows.drop_duplicates(keys, keep="last")
            if clock is None:
                yield kept
            else:
                times = kept[order[0]]
                yield kept.assign(**{clock: times.where(times.isna())})
                tick = rows.tail(1)
                yield tick.assign(**{clock: tick[order[0]]})

    fields = list(stream.schema.fields)
    if clock is not None:
        fields.append(StructField(clock, stream.schema[order[0]].dataType))
    return stream.mapInPandas(last_rows, StructType(fields))
