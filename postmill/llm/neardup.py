"""Near-duplicate documents: a multi-index Hamming join of b-bit MinHash signatures, confirmed on full shingle sets.

1. Every document becomes its set of word shingles, a signature of `VALUES` MinHash values of 16 bits each, and a
   fingerprint of the set. Documents with equal sets form a class; only classes go on.
2. Signatures are split into chunks. If two signatures differ in at most MAX_DIFFERENT values, then by the pigeonhole
   principle some chunk differs in no more values than it is allowed. Each chunk's allowed errors are enumerated by leaving
   out every choice of so many values, so every such pair shares a key. Two sets at the threshold differ in more than
   MAX_DIFFERENT of 64 values with a probability of about one in a million, and less above it.
3. Members of shared keys are compared and united as in `pairs.united`: pairs within MAX_DIFFERENT are confirmed on the full
   sets, and no link between different sets is lost.

Defined cases: null and empty texts have no shingles and are linked with nothing; shorter texts than a shingle are one
shingle as a whole; rows that repeat a doc_id are one document for linking; rows without a doc_id follow the documents with
an equal set, and otherwise keep a null component and are kept; an empty table gives no rows; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from postmill.llm.pairs import Wanted, united, without
from postmill.llm.registry import query, table
from postmill.session import written

WORDS = 5
PERCENT = 80
VALUES = 64
MAX_DIFFERENT = 24
#: (first value, number of values, allowed differences) of each chunk; the sum of (allowed + 1) exceeds MAX_DIFFERENT.
CHUNKS = tuple((5 * i, 5, 1) for i in range(12)) + ((60, 4, 0),)
#: Hashes of words kept by one task.
KEPT_WORDS = 1_000_000
SKETCH = "doc_id long, n_shingles long, fingerprint binary, signature binary"
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x):
    x = (x ^ (x >> np.uint64(31))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(32))


def shingles(text, n, hashes):
    """Sorted distinct 64-bit hashes of the n-word shingles of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    total = each[: len(each) - n + 1].copy()
    for i in range(1, n):
        total = _mixed(total) + each[i: len(each) - n + 1 + i]
    return np.unique(_mixed(total))


def _permutations(values):
    rng = np.random.default_rng(20_240)
    return (rng.integers(1 << 63, dtype=np.uint64, size=values) * np.uint64(2) + np.uint64(1),
            rng.integers(1 << 63, dtype=np.uint64, size=values) * np.uint64(2))


def signature(own, factors, offsets):
    """MinHash values of a set, 16 bits each."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 2048):  # a block fits in the cache, however long the text
        np.minimum(least, (own[at: at + 2048, None] * factors + offsets).min(axis=0), out=least)
    return _mixed(least).astype(np.uint16)


def sketch(df: DataFrame, words=WORDS) -> DataFrame:
    """doc_id, n_shingles, fingerprint and signature per document; the latter two are null without shingles."""

    def sketch_part(batches):
        hashes, (factors, offsets) = _Hashes(), _permutations(VALUES)
        for batch in batches:
            counts, prints, signs = [], [], []
            for text in batch.column("text"):
                own = shingles(text.as_py(), words, hashes)
                counts.append(len(own))
                prints.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                signs.append(signature(own, factors, offsets).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()),
                 pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "fingerprint", "signature"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketch_part, SKETCH)


def _keys(signs):
    """All keys of signatures (a matrix, one row each): one 64-bit key per chunk and choice of left-out values."""
    out = []
    for first, width, allowed in CHUNKS:
        chunk = signs[:, first: first + width].astype(np.uint64)
        for left_out in range(width) if allowed else [None]:
            key = np.full(len(signs), len(out) + 1, np.uint64)
            for i in range(width):
                if i != left_out:
                    key = _mixed(key) + chunk[:, i]
            out.append(_mixed(key))
    return np.stack(out, axis=1)


def _index(classes):
    """(key, id) for every class and each of its keys."""

    def index_part(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, VALUES)
            keys = _keys(signs)
            for at in range(0, len(keys), 2000):
                part = keys[at: at + 2000]
                ids = batch.column("id").to_numpy()[at: at + 2000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.ravel().view(np.int64)), pa.array(np.repeat(ids, part.shape[1]))], ["key", "id"])

    return classes.mapInArrow(index_part, "key long, id long")


@F.arrow_udf(LongType())
def _different(a: pa.Array, b: pa.Array) -> pa.Array:
    """Number of differing values of two signatures."""
    a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, VALUES) for x in (a, b))
    return pa.array((a != b).sum(axis=1).astype(np.int64))


def _near(pairs, signatures):
    """Pairs (a, b) whose signatures differ in at most MAX_DIFFERENT values."""
    left = signatures.select(F.col("id").alias("a"), F.col("signature").alias("_sa"))
    right = signatures.select(F.col("id").alias("b"), F.col("signature").alias("_sb"))
    return pairs.join(left, "a").join(right, "b").where(_different("_sa", "_sb") <= MAX_DIFFERENT).select("a", "b")


def _sets_of(df, words):
    """A function from documents (id) to their full shingle sets (id, own)."""

    def sets_of(ids):
        wanted = Wanted(ids)

        def sets_part(batches):
            hashes = _Hashes()
            for batch in batches:
                batch = batch.filter(pa.array(wanted(batch.column("doc_id").to_numpy())))
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    sets = [shingles(t.as_py(), words, hashes).view(np.int64) for t in part.column("text")]
                    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.ListArray.from_arrays(ends, np.concatenate(sets))], ["id", "own"])

        # Sets are made where the texts are read, so that no texts are shuffled.
        rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
        return written(rows.mapInArrow(sets_part, "id long, own array<long>"), "neardup-sets")

    return sets_of


def links(df: DataFrame, sketches: DataFrame, words, percent) -> DataFrame:
    """(node, component) for the classes that are linked with another one; a class is named by its smallest doc_id."""
    classes = sketches.where("n_shingles > 0").groupBy("fingerprint").agg(
        F.min("doc_id").alias("id"), F.min("signature").alias("signature")).where("id IS NOT NULL")
    classes = written(classes.select("id", "signature"), "neardup-classes")
    index = _index(classes)
    # Only members of shared keys go on; most documents have none.
    shared = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(index.join(shared, "key"), "neardup-keys")
    return united(members, _sets_of(df, words), percent, lambda pairs: _near(pairs, classes))


def near_duplicates(df: DataFrame, words=WORDS, percent=PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links lead to) and kept per document."""
    sketches = written(sketch(df, words), "neardup-sketches")
    linked = links(df, sketches, words, percent)
    ids = sketches.where("n_shingles > 0").groupBy("fingerprint").agg(F.min("doc_id").alias("id"))
    named = ids.join(linked.withColumnRenamed("node", "id"), "id", "left").select(
        "fingerprint", F.coalesce("component", "id").alias("_component"))
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("_component"))
    return sketches.select("doc_id", "n_shingles", "fingerprint").join(named, "fingerprint", "left").select(
        "doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_copies(df: DataFrame, words=WORDS, percent=PERCENT) -> DataFrame:
    """The documents without those that are linked to one with a smaller doc_id; rows without a doc_id stay."""
    judged = near_duplicates(df, words, percent).where(~F.col("kept") & F.col("doc_id").isNotNull())
    return without(df, written(judged.select(F.col("doc_id").alias("id")).distinct(), "neardup-dropped"))


@query("op4_near_dedup")
def op4(spark, sf_dir):
    """Links all documents by shingles of three words with a similarity of 85 percent or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
