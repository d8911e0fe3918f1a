"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `points` places on a 64-bit ring. A key goes to the first place clockwise of its hash; if that shard is
full, it travels on clockwise to the next place whose shard has room. With slack 0 the capacities are the floor and the
ceiling of rows / shards, so loads differ by one row at most; with slack a, no shard takes more than (1 + a) times the
mean, and a new shard moves few rows.

Rows are counted per arc (the stretch up to a place); there are shards * points arcs, so this table is bounded whatever
the data. The clockwise walk runs over these counts and yields, for each arc, which of its rows, by rank, go to which shard.
Rows get their rank inside an arc from a distributed sort by their place on the ring.

Defined cases: a null text has no bytes and checksum 0; rows with a null or a repeated doc_id are placed like others; an empty table
gives no rows; other columns of the input are dropped.
"""

import hashlib
from collections import deque
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from postmill.llm.registry import query, table
from postmill.operators.spread import global_index
from postmill.session import written

SHARDS = 40
POINTS = 100


def ring(shards, points=POINTS):
    """Places of all shards in ring order: (place, shard). A shard's places do not depend on the number of shards."""
    return sorted(
        (int.from_bytes(hashlib.blake2b(f"{s}/{p}".encode(), digest_size=8).digest(), "big", signed=True), s)
        for s in range(shards) for p in range(points))


def capacities(rows, shards, slack=0.0):
    """Room of each shard; with slack 0 it adds up to exactly `rows`."""
    if slack:
        return [max(-(-rows // shards), int(rows * (1 + slack) / shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(demand, owners, room):
    """Segments (arc, first rank, end rank, shard, first slot) of the clockwise walk.

    demand: rows per arc; owners: shard per arc; room: capacity per shard. At a place, rows of its own arc come before
    rows that travelled there, and those come in the order of their travel.
    """
    room, used, out = list(room), [0] * len(room), []
    travelling = deque()
    for lap in range(len(owners) and 2):
        for arc, shard in enumerate(owners):
            queue = deque([(arc, 0, demand[arc])] if lap == 0 and demand[arc] else [])
            queue.extend(travelling)
            while queue and room[shard]:
                source, low, high = queue.popleft()
                taken = min(high - low, room[shard])
                out.append((source, low, low + taken, shard, used[shard]))
                room[shard] -= taken
                used[shard] += taken
                if low + taken < high:
                    queue.appendleft((source, low + taken, high))
            travelling = queue
    assert not travelling, "the shards have less room than rows"
    return out


def assign(df: DataFrame, shards=SHARDS, points=POINTS, slack=0.0) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard and slot (0, 1, ... inside the shard)."""
    spark, places = df.sparkSession, ring(shards, points)
    borders = np.array([place for place, _ in places], dtype=np.int64)

    @F.pandas_udf("int")
    def arc_of(hashes: pd.Series) -> pd.Series:
        # Beyond the last place the ring starts anew.
        return pd.Series(np.searchsorted(borders, hashes.to_numpy()) % len(borders)).astype("int32")

    text = F.coalesce("text", F.lit(""))
    keys = df.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col("doc_id").cast("long")).alias("hash"), F.monotonically_increasing_id().alias("at"))
    # Written once, so that counts and ranks see the same rows and the texts are read once.
    rows = written(keys.select("*", arc_of("hash").alias("arc")), "ring")
    # Ranks follow the ring; only rows that agree in all else are told apart by their place in the table. The sort is
    # distributed, so that an arc, or a key with most of the rows, is no task's alone.
    placed = global_index(rows, ["arc", "hash", "doc_id", "text_crc32", "size", "at"], "index")
    demand = [0] * len(places)
    for row in rows.groupBy("arc").agg(F.count("*").alias("n")).collect():  # shards * points rows at most
        demand[row["arc"]] = row["n"]
    firsts = spark.createDataFrame(list(enumerate(accumulate([0, *demand[:-1]]))), "arc int, before long")
    segments = walk(demand, [shard for _, shard in places], capacities(sum(demand), shards, slack))
    segments = spark.createDataFrame(segments, "arc int, low long, high long, shard int, first long")
    ranked = placed.join(F.broadcast(firsts), "arc").select(
        "doc_id", "size", "text_crc32", "arc", (F.col("index") - F.col("before")).alias("rank"))
    return ranked.join(F.broadcast(segments), (ranked["arc"] == segments["arc"]) & F.col("rank").between(
        F.col("low"), F.col("high") - 1)).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - F.col("low")).alias("slot"))


@query("op3_sharding")
def op3(spark, sf_dir):
    """Places all documents in 40 shards with capacities that differ by one row at most."""
    return assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
