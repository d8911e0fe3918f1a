"""From members of shared keys to groups of alike items: comparisons, exact confirmation and union, without all pairs.

An item has an id and a set of 64-bit shingles (`own`). `sets_of(ids)` returns the sets (id, own) of the items named in
column id, one row per id (several rows stand for several sets of one item), and may return sets of others too. Two items are linked when
100 * common >= percent * union.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from postmill.llm.graph import components
from postmill.session import written


#: Bits of the filter that names wanted items to tasks: 4 MB, whatever the data. More items only make it less selective.
FILTER_BITS = 1 << 25
#: Members of a key that are all compared with each other.
FEW = 32
#: Shingles that are remembered beside each one of a prefix, so that rows grow in proportion to the prefixes.
BEFORE = 16


class Wanted:
    """Tells of an array of ids which may be among the ids it was made from; never misses one."""

    def __init__(self, ids):
        at = F.pmod(F.col("id"), F.lit(FILTER_BITS)) + 1
        pieces = ids.select(F.bitmap_bucket_number(at).alias("piece"), F.bitmap_bit_position(at).alias("bit")).groupBy(
            "piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
        bits = np.zeros((FILTER_BITS // (1 << 15), 1 << 12), np.uint8)
        for row in pieces.collect():  # FILTER_BITS / 32768 rows of 4 KB at most
            bits[row["piece"] - 1] = np.frombuffer(row["bits"], np.uint8)
        self.bits = ids.sparkSession.sparkContext.broadcast(bits.ravel())

    def __call__(self, ids):
        at = ids % FILTER_BITS
        return (self.bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def parted(df, ids):
    """(rows whose doc_id is surely not among `ids` (id), rows whose doc_id may be); rows without one are in the former.

    The first part, most rows as a rule, needs no join to be told apart, so that its texts are not shuffled.
    """
    wanted = Wanted(ids)

    @F.arrow_udf(BooleanType())
    def among(own: pa.Array) -> pa.Array:
        return pa.array(wanted(own.to_numpy(zero_copy_only=False)))

    maybe = F.coalesce(F.col("doc_id").isNotNull() & among(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))), F.lit(False))
    return df.where(~maybe), df.where(maybe)


def without(df, ids):
    """The rows of df whose doc_id is not among `ids` (id); rows without a doc_id stay."""
    others, maybe = parted(df, ids)
    return others.unionByName(maybe.join(ids, maybe["doc_id"].cast("long") == ids["id"], "left_anti"))


def confirmed(pairs, sets_of, percent):
    """Pairs (a, b) whose full sets overlap enough."""
    sets = sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("own").alias("_xa")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("own").alias("_xb")), "b")
    common = F.size(F.array_intersect("_xa", "_xb"))
    return both.where(100 * common >= percent * (F.size("_xa") + F.size("_xb") - common)).select("a", "b")


def sharing_rare(left, sets_of, percent):
    """Pairs (a, b) of different groups among `left` (id, group) that pass the prefix and positional filters.

    With both sets in one order, rarest shingle first, the first common shingle of a pair that overlaps enough must stand
    early enough to leave room for that overlap. The filters are exact. A pair is made at that shingle, and again only at one
    that stands more than BEFORE others behind.
    """
    sets = sets_of(left.select("id").distinct())
    tokens = sets.select("id", F.size("own").alias("size"), F.explode("own").alias("token"))
    known = tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    ranked = tokens.join(known, "token", "left").groupBy("id", "size").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "token"))).alias("all"))
    length = (F.col("size") - F.ceil(F.col("size") * F.lit(percent) / 100) + 1).cast("int")
    prefix = ranked.join(left, "id").select("id", "group", "size", F.slice("all", 1, length).alias("all"))
    # Shingles of one item alone stand first; they take places, but meet nothing.
    alone = F.size(F.filter("all", lambda t: t["often"] == 1))
    shared = F.transform(F.filter("all", lambda t: t["often"] > 1), lambda t: t["token"])
    prefix = prefix.select("id", "group", "size", alone.alias("alone"), shared.alias("shared"))
    entries = F.transform("shared", lambda token, place: F.struct(
        (F.col("alone") + place).alias("at"), token.alias("token"),
        F.slice("shared", F.greatest(place - (BEFORE - 1), F.lit(1)), F.least(place, F.lit(BEFORE))).alias("before")))
    prefix = prefix.select("id", "group", "size", F.explode(entries).alias("entry")).select("id", "group", "size", "entry.*")
    prefix = written(prefix, "pairs-prefixes")
    # Every pair of two groups has a side outside the token's most common group, so a large group never meets itself.
    common = prefix.groupBy("token", "group").agg(F.count("*").alias("n")).groupBy("token").agg(
        F.max_by("group", F.struct("n", "group")).alias("main"))
    sided = prefix.join(common, "token").withColumn("inside", F.col("group") == F.col("main")).drop("main")
    outside = sided.where("NOT inside").drop("inside")
    other = sided.select("token", F.col("id").alias("b"), F.col("group").alias("_group"), F.col("size").alias("_size"),
                         F.col("at").alias("_at"), "inside", F.col("before").alias("_before"))
    # Two items outside it meet from one side, and any two not again soon after a common shingle.
    side, first = F.col("inside") | (F.col("a") < F.col("b")), ~F.arrays_overlap("before", "_before")
    room = F.least(F.col("size") - F.col("at"), F.col("_size") - F.col("_at"))
    enough = (100 + percent) * room >= percent * (F.col("size") + F.col("_size"))
    return outside.withColumnRenamed("id", "a").join(other, "token").where((F.col("group") != F.col("_group")) & side & enough & first).select(
        "a", "b")


def ordered(pairs):
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def united(members, sets_of, percent, near=lambda pairs: pairs, confirm=None):
    """(node, component) of the items linked with another one, from members (key, id, n) of keys that n items share.

    Members of a key are first compared with its hub: the member with the most company over all its keys, which in a group
    of copies is their common original, if it is there. `near` may drop pairs that cannot be alike; `confirm` may tell linked
    pairs in another way than by the sets. What is left are keys whose other members are not all united. Where these are FEW
    at most, each is compared with each, without their sets; those of larger keys go through `sharing_rare`.
    """
    confirm = confirm or (lambda pairs: confirmed(pairs, sets_of, percent))
    central = members.groupBy("id").agg(F.sum("n").alias("company"))
    hubs = members.join(central, "id").groupBy("key").agg(F.max_by("id", F.struct("company", "id")).alias("hub"))
    starred = written(members.join(hubs, "key").where("id <> hub").select("key", "id", "hub"), "pairs-hubs")
    tried = written(near(ordered(starred.select(F.col("id").alias("a"), F.col("hub").alias("b")))), "pairs-tried")
    found = written(confirm(tried), "pairs-links")
    # The hub has met every member; what is left are keys whose other members are not all united.
    placed = starred.join(components(found).withColumnRenamed("node", "id"), "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("group"))
    mixed = placed.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("n")).where(
        "low < high")
    rest = written(placed.join(mixed.select("key", "n"), "key"), "pairs-rest")
    few, many = rest.where(F.col("n") <= FEW), rest.where(F.col("n") > FEW)
    pairs = few.select("key", F.col("id").alias("a"), F.col("group").alias("_a")).join(
        few.select("key", F.col("id").alias("b"), F.col("group").alias("_b")), "key").where("a < b AND _a <> _b").select("a", "b")
    if not many.isEmpty():
        pairs = pairs.union(sharing_rare(many.select("id", "group").distinct(), sets_of, percent))
    more = written(near(ordered(pairs).join(tried, ["a", "b"], "left_anti")), "pairs-tried")
    return components(found.union(confirm(more)))
