"""Joins and ordered numbering that hold when one key owns a large share of the rows."""

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from postmill.session import cut

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SPREAD = 64
GROUP_ROWS = 2_000_000
#: Input of at most this size is numbered without counting its keys.
GROUP_BYTES = 128 << 20
#: Counters of the sketch that looks for frequent keys.
TRACKED_KEYS = 10_000
#: Equal rows of a frequent key that go to one task.
EQUAL_ROWS = 1000


def fits(df: DataFrame, rows=BROADCAST_ROWS, size=BROADCAST_BYTES) -> bool:
    """True when df is proven to hold at most this many rows and bytes of text. Reads at most rows+1 rows per task."""
    width = reduce(
        lambda a, b: a + b, [F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in df.columns], F.lit(8)
    )
    seen = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(width).alias("b")).first()
    return seen["n"] <= rows and (seen["b"] or 0) <= size


def frequent(df: DataFrame, keys, share=SPREAD, tracked=TRACKED_KEYS) -> list:
    """Hashes of the keys that hold more than one in `share` of the rows: at most `share` numbers.

    A mergeable sketch of the most frequent values is filled per task; with `tracked` counters its error is far below the
    limit, so no such key is missed.
    """
    key = F.xxhash64(*keys)
    seen = df.select(key.alias("h")).agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k(h, {share}, {tracked})").alias("top")).first()
    return [t["item"] for t in seen["top"] or [] if t["count"] * share > seen["n"] and t["count"] > 1]


def attach(many: DataFrame, one: DataFrame, on, how="left", rows=BROADCAST_ROWS, spread=SPREAD) -> DataFrame:
    """Join rows to a table with at most one row per key, whatever share of the rows one key holds.

    A table proven small is broadcast. Otherwise only the keys that hold more than one in `spread` rows are treated apart:
    their few rows of `one` are copied to `spread` slots, equal rows of theirs are counted first, and each (or each
    EQUAL_ROWS equal ones) picks a slot by a hash of its other columns. All other rows meet in a plain join.

    On a stream, whose keys cannot be counted beforehand, all of `one` is copied.
    """
    on = list(on)
    if fits(one, rows):
        return many.join(F.broadcast(one), on, how)
    others = [c for c in many.columns if c not in on]
    if many.isStreaming:
        slot = F.pmod(F.xxhash64(*others), F.lit(spread)).cast("int") if others else F.lit(0)
        copies = one.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        return many.withColumn("_slot", slot).join(copies, [*on, "_slot"], how).drop("_slot")
    hot = frequent(many, on, spread)
    if not hot:
        return many.join(one, on, how)
    is_hot = F.xxhash64(*on).isin(hot)
    copies = one.where(is_hot).withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    packs = many.where(is_hot).groupBy(*many.columns).agg(F.count("*").alias("_n")).withColumn(
        "_pack", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / EQUAL_ROWS))))
    packs = packs.withColumn("_slot", F.pmod(F.xxhash64(*others, "_pack"), F.lit(spread)).cast("int"))
    met = packs.join(copies, [*on, "_slot"], how)
    left = F.least(F.lit(EQUAL_ROWS).cast("bigint"), F.col("_n") - F.col("_pack") * EQUAL_ROWS)
    met = met.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), left))).drop("_slot", "_n", "_pack", "_copy")
    plain = many.where(~is_hot).join(one.where(~is_hot), on, how)
    return plain.unionByName(met.select(*plain.columns))


def _partitions(df):
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def global_index(df: DataFrame, order, name="idx") -> DataFrame:
    """Number all rows 0, 1, 2, ... in the given total order without gathering them in one task.

    Range-sorted partitions are written once; each partition then only needs the number of rows before it.
    """
    local = F.monotonically_increasing_id()
    row_bits = (1 << 33) - 1
    placed = cut(
        df.repartitionByRange(_partitions(df), *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", local)
    )
    block = F.shiftright("_at", 33)
    inside = F.col("_at").bitwiseAND(F.lit(row_bits))
    # One row per partition: its size is the partition count, not the data.
    sizes = placed.groupBy(block.alias("_block")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        placed.withColumn("_block", block)
        .join(F.broadcast(starts), "_block")
        .withColumn(name, F.col("_start") + inside)
        .drop("_at", "_block", "_start")
    )


def _local_columns(keys, order, number, total, previous):
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {}
    if number:
        out[number] = F.row_number().over(w).cast("bigint")
    for name, value in (total or {}).items():
        out[name] = F.sum(value).over(upto)
    for name, source in (previous or {}).items():
        out[name] = F.lag(source).over(w)
    return out


def input_bytes(df: DataFrame):
    """Bytes of the tables that df reads, by the planner's knowledge and without a job; None when one is not known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes) if max(sizes, default=0) < 1 << 60 else None


def running(df: DataFrame, keys, order, number=None, total=None, previous=None, group_rows=GROUP_ROWS) -> DataFrame:
    """Row numbers, running sums and previous values per key, in a total order of each key's rows.

    number: name of the row-number column; total: {name: Column} summed up to the row; previous: {name: column} taken
    from the row before. Keys with more than `group_rows` rows are cut into range-sorted blocks that are worked on
    separately; the state carried into a block is one small row per block that a key continues in. Input that one task can
    sort as a whole has no such key, so nothing is counted beforehand.
    """
    keys = list(keys)
    size = input_bytes(df)
    if group_rows == GROUP_ROWS and size is not None and size <= GROUP_BYTES:
        return df.withColumns(_local_columns(keys, order, number, total, previous))
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    # At most rows/group_rows keys.
    hot = cut(sizes.where(F.col("_n") > group_rows).select(*keys))
    if not hot.take(1):
        return df.withColumns(_local_columns(keys, order, number, total, previous))
    small = fits(hot)
    side = F.broadcast(hot) if small else hot
    cold = df.join(side, keys, "left_anti").withColumns(_local_columns(keys, order, number, total, previous))
    blocks = _blockwise(df.join(side, keys, "left_semi"), keys, order, number, total or {}, previous or {})
    return cold.unionByName(blocks.select(*cold.columns))


def _blockwise(df, keys, order, number, total, previous):
    placed = cut(
        df.withColumns({f"_v_{name}": value for name, value in total.items()})
        .repartitionByRange(_partitions(df), *keys, *order)
        .withColumn("_block", F.spark_partition_id())
    )
    parts = [*keys, "_block"]
    inner = Window.partitionBy(*parts).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed.withColumn("_local", F.row_number().over(inner).cast("bigint"))
    for name in total:
        rows = rows.withColumn(name, F.sum(f"_v_{name}").over(upto))
    for name, source in previous.items():
        rows = rows.withColumn(name, F.lag(source).over(inner))

    last = F.struct(*[F.col(c) for c in order]) if previous else None
    summary = placed.groupBy(*parts).agg(
        F.count("*").alias("_n"),
        *[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in total],
        *[F.max_by(F.struct(F.col(source).alias("v")), last).alias(f"_l_{name}") for name, source in previous.items()],
    )
    # A key spans few blocks, and only the first key of a block can have started earlier: at most one row per block.
    steps = Window.partitionBy(*keys).orderBy("_block")
    before = steps.rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *parts,
        F.sum("_n").over(before).alias("_n"),
        *[F.sum(f"_s_{name}").over(before).alias(f"_s_{name}") for name in total],
        *[F.lag(f"_l_{name}").over(steps).alias(f"_l_{name}") for name in previous],
    ).where(F.col("_n").isNotNull())
    rows = rows.join(F.broadcast(carry), parts, "left")
    if number:
        rows = rows.withColumn(number, F.col("_local") + F.coalesce("_n", F.lit(0)))
    for name in total:
        rows = rows.withColumn(
            name, F.when(F.col(f"_s_{name}").isNull(), F.col(name)).otherwise(
                F.col(f"_s_{name}") + F.coalesce(F.col(name), F.lit(0)))
        )
    for name in previous:
        rows = rows.withColumn(
            name, F.when(F.col("_local") == 1, F.col(f"_l_{name}.v")).otherwise(F.col(name))
        )
    return rows


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """The first row of each key in a total order; partial results combine before the shuffle, so no key is too hot."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def last_per_key(df: DataFrame, keys, order, *extra) -> DataFrame:
    """The last row of each key in a total order, with further aggregates of the key's rows."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"), *extra)
    added = [c for c in picked.columns if c not in keys and c != "_r"]
    return picked.select(*keys, "_r.*", *added)
