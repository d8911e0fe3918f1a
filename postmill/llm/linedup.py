"""Fuzzy line de-duplication: of all lines that are alike, over all documents, the first one stays.

Lines are compared with A-Z in lower case, runs of white space as one space, and none at the ends. Equal lines are one item.
Items are alike when their sets of shingles (SHINGLE code points each; a shorter line is one shingle) have a
Jaccard similarity of `percent` or more, which is checked on the full sets. Candidates come from MinHash signatures and
banding: lines at a similarity of 0.8 share a band with a probability of about 0.9998. Lines with fewer than SHORT shingles
have BANDS * ROWS independent MinHash functions, longer ones the minima of one hash in as many bins (empty bins borrow from
the next full one, which few bins of a short line would spoil). Lines so little longer that they may be like a short one
have both. Alike lines are united over chains of links.

Defined cases: blank lines are never dropped; a null text has no lines; lines of any length count; the first line is the one
with the smallest (doc_id, line number), null ids first, and then that of the row with the smallest hash of its text. Rows
are told apart by doc_id and a 64-bit hash of the whole text, so rows with a null doc_id, or a repeated one with another text,
are documents of their own; rows that repeat both are one document and judged alike. An empty table gives no rows. Items are
named by 64-bit hashes of their text.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType

from postmill.llm.pairs import Wanted, parted, united
from postmill.llm.registry import query, table
from postmill.session import written

SHINGLE = 8
PERCENT = 80
BANDS, ROWS = 16, 4
BINS = BANDS * ROWS
#: Lines with fewer different shingles have independent functions.
SHORT = 100
#: Items that a task remembers, so that a repeated line enters the candidate search once per task.
KEPT_LINES = 200_000
BLOCK_BYTES = 128 << 10
LINES = "doc_id long, row long, line_no int, item long, line binary"


def normal(line):
    return b" ".join(line.lower().split())


def _mixed(x):
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


def _places(lengths, counts):
    """Start of every window of lines that stand one behind the other."""
    first = np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(counts) - counts), counts)
    return first + np.arange(counts.sum())


def _ascii_shingles(lines):
    """Shingles of lines of plain ASCII, as the numbers that their eight bytes are, and how many each line has."""
    padded = [line.ljust(SHINGLE, b"\0") for line in lines]
    lengths = np.array([len(x) for x in padded], np.int64)
    counts = lengths - (SHINGLE - 1)
    data = b"".join(padded)
    return np.ndarray((len(data) - SHINGLE + 1,), "<u8", data, strides=(1,))[_places(lengths, counts)], counts


def _wide_shingles(lines):
    """The same of any lines: eight code points; windows that are all ASCII have the numbers of _ascii_shingles."""
    padded = [line.decode().ljust(SHINGLE, "\0") for line in lines]
    lengths = np.array([len(x) for x in padded], np.int64)
    counts = lengths - (SHINGLE - 1)
    points = np.frombuffer("".join(padded).encode("utf-32-le"), "<u4")
    at, shape = _places(lengths, counts), (len(points) - SHINGLE + 1,)
    # Eight neighbours at once: their low bits as bytes, and whether any of them is beyond ASCII.
    packed = np.ndarray(shape, "<u8", (points & 127).astype(np.uint8).tobytes(), strides=(1,))[at]
    narrow = np.ndarray(shape, "<u8", (points > 127).tobytes(), strides=(1,))[at] == 0
    # Hashes of two, four and eight neighbours, each from those of its halves.
    hashed = points.astype(np.uint64)
    for width in (1, 2, 4):
        hashed = _mixed((hashed[:-width] + np.uint64(width)) * np.uint64(0x9FB21C651E98DF25) + hashed[width:])
    hashed = hashed[at]
    return np.where(narrow, packed, hashed), counts


def _shingles(lines):
    """All shingles of lines (UTF-8) as 64-bit numbers, and how many each line has."""
    plain = np.array([line.isascii() for line in lines], bool)
    if plain.all():
        return _ascii_shingles(lines)
    wide, wide_counts = _wide_shingles([line for line, yes in zip(lines, plain) if not yes])
    counts = np.empty(len(lines), np.int64)
    counts[~plain] = wide_counts
    if not plain.any():
        return wide, counts
    narrow, counts[plain] = _ascii_shingles([line for line, yes in zip(lines, plain) if yes])
    out = np.empty(counts.sum(), np.uint64)
    of_plain = np.repeat(plain, counts)
    out[of_plain], out[~of_plain] = narrow, wide
    return out, counts


def _functions():
    """Factors and offsets of the independent MinHash functions."""
    rng = np.random.default_rng(20_241)
    return [(np.uint64(a) | np.uint64(1), np.uint64(b)) for a, b in rng.integers(1 << 63, dtype=np.uint64, size=(BINS, 2)) * np.uint64(2)]


def _different(hashes, counts, enough):
    """How many different shingles each line has, or a number above `enough` for lines with more than these; lines with
    fewer than SHORT in all are not looked at more closely."""
    out = counts.copy()
    # Most long lines fill more than `enough` of some slots, and so have more different shingles than that.
    long = np.flatnonzero(counts > 2 * enough)
    if len(long):
        slots = np.zeros(len(long) << 10, bool)
        own = hashes[np.repeat(counts > 2 * enough, counts)] & np.uint64(1023)
        slots[np.repeat(np.arange(len(long)) << 10, counts[long]) + own.astype(np.int64)] = True
        out[long] = slots.reshape(-1, 1024).sum(axis=1)
    unsure = (counts >= SHORT) & (out <= enough) | (counts >= SHORT) & (counts <= 2 * enough)
    if unsure.any():
        # One sort for all lines; so few bits of two shingles of a line are hardly ever equal by chance.
        line = np.repeat(np.arange(unsure.sum(), dtype=np.uint64), counts[unsure])
        bits = np.uint64(max(int(unsure.sum()), 2).bit_length())
        keys = np.sort((line << (np.uint64(64) - bits)) | (hashes[np.repeat(unsure, counts)] >> bits))
        first = np.append(True, keys[1:] != keys[:-1])
        out[unsure] = np.bincount((keys[first] >> (np.uint64(64) - bits)).astype(np.int64), minlength=unsure.sum())
    return out


def band_keys(lines, percent=PERCENT):
    """(number of a line, key) for each band of each line, as arrays."""
    hashes, counts = _shingles(lines)
    hashes = _mixed(hashes)
    # A line like one with fewer than SHORT shingles has fewer than SHORT * 100 / percent; some more for equal bits.
    enough = SHORT * 100 // max(percent, 1) + 5
    different = _different(hashes, counts, enough)
    few, many = different <= enough, different >= SHORT
    out = []
    for mine, keys_of in ((few, _independent_keys), (many, _sketch_keys)):
        if mine.any():
            keys = keys_of(hashes[np.repeat(mine, counts)], counts[mine])
            out.append((np.repeat(np.flatnonzero(mine), BANDS), keys.ravel()))
    return tuple(np.concatenate(x) for x in zip(*out))


def _independent_keys(hashes, counts):
    """One key per band for each line, from independent functions: a matrix of BANDS columns."""
    functions, ends = _functions(), np.cumsum(counts)
    out = np.empty((len(counts), BANDS), np.int64)
    for at in range(0, len(counts), 256):  # so many lines fit in the cache
        upto = min(at + 256, len(counts))
        low = ends[at] - counts[at]
        own, starts = hashes[low:ends[upto - 1]], ends[at:upto] - counts[at:upto] - low
        for band in range(BANDS):
            key = np.full(upto - at, BANDS + 1 + band, np.uint64)
            for factor, offset in functions[band * ROWS:(band + 1) * ROWS]:
                key = _mixed(key) + np.minimum.reduceat(own * factor + offset, starts)
            out[at:upto, band] = _mixed(key).view(np.int64)
    return out


def _sketch_keys(hashes, counts):
    """One key per band for each line, from the minima of one hash in bins: a matrix of BANDS columns."""
    empty = np.uint32(0xFFFFFFFF)
    least = np.full(len(counts) * BINS, empty, np.uint32)
    at = np.repeat(np.arange(len(counts)) * BINS, counts) + (hashes >> np.uint64(58)).astype(np.int64)
    np.minimum.at(least, at, (hashes >> np.uint64(20)).astype(np.uint32) & np.uint32(0xFFFFFFFE))
    least = least.reshape(-1, BINS)
    place = np.where(least == empty, 4 * BINS, np.arange(BINS))
    place = np.concatenate([place, place + BINS], axis=1)[:, ::-1]
    full = np.minimum.accumulate(place, axis=1)[:, ::-1][:, :BINS]
    values = np.take_along_axis(least, full % BINS, axis=1).astype(np.uint64) + (
        (full - np.arange(BINS)).astype(np.uint64) << np.uint64(32))
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(counts), BANDS))
    for row in range(ROWS):
        # Bins far apart, since neighbours may have borrowed from the same one.
        keys = _mixed(keys) + values[:, row * BANDS:(row + 1) * BANDS]
    return _mixed(keys).view(np.int64)


def _items(text):
    """(line number, item, line in normal form) of the lines of a text that are not blank."""
    for number, line in enumerate((text or "").encode().lower().split(b"\n")):
        if line := b" ".join(line.split()):  # normal(), all lines in lower case at once
            yield number, xxhash.xxh3_64_intdigest(line) - (1 << 63), line


def _row():
    """Column that tells rows of one doc_id apart: a hash of the text."""
    return F.xxhash64("text")


def lines_of(df: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, row, line_no (from 0), item and line of every line that is not blank; `row` tells rows of a doc_id apart.

    `line` is the line in normal form where its item is among `ids` (id), once per task while the task remembers it; other
    lines may have it too, and else it is null.
    """
    names, wanted = ["doc_id", "row", "line_no", "item", "line"], Wanted(ids)

    def lines_part(batches):
        seen = set()
        for batch in batches:
            places, numbers, items, lines, held = [], [], [], [], 0
            for place, text in enumerate(batch.column("text")):
                for number, item, line in _items(text.as_py()):
                    places.append(place)
                    numbers.append(number)
                    items.append(item)
                    lines.append(line)
                    held += len(line)
                if held > BLOCK_BYTES or place + 1 == batch.num_rows:
                    own = np.array(items, np.int64)
                    told = [None] * len(lines)
                    for at in np.flatnonzero(wanted(own)).tolist():
                        if items[at] not in seen:
                            told[at] = lines[at]
                            if len(seen) < KEPT_LINES:
                                seen.add(items[at])
                    at = pa.array(places, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(at), batch.column("row").take(at), pa.array(numbers, pa.int32()),
                         pa.array(own), pa.array(told, pa.binary())], names)
                    places, numbers, items, lines, held = [], [], [], [], 0

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), _row().alias("row"), "text").mapInArrow(lines_part, LINES)


def index_of(df: DataFrame, percent=PERCENT) -> DataFrame:
    """(id, key) for every item and each of its bands; at least once, and once per task while the task remembers it."""

    def block_of(fresh):
        which, keys = band_keys(list(fresh.values()), percent)
        return pa.RecordBatch.from_arrays([pa.array(np.array(list(fresh), np.int64)[which]), pa.array(keys)], ["id", "key"])

    def index_part(batches):
        seen, fresh, held = set(), {}, 0
        for batch in batches:
            for text in batch.column("text"):
                for _, item, line in _items(text.as_py()):
                    if item in seen:
                        continue
                    if len(seen) >= KEPT_LINES:
                        seen.clear()
                    seen.add(item)
                    fresh[item] = line
                    held += len(line)
                    if held > BLOCK_BYTES:
                        yield block_of(fresh)
                        fresh, held = {}, 0
        if fresh:
            yield block_of(fresh)

    return df.select("text").mapInArrow(index_part, "id long, key long")


def _sets_of(lines):
    """A function from items (id) to their shingle sets (id, own), from lines (id, line)."""

    def sets_part(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                hashes, counts = _shingles(part.column("line").to_pylist())
                own = [np.unique(x).view(np.int64) for x in np.split(hashes, np.cumsum(counts)[:-1])]
                ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.ListArray.from_arrays(ends, np.concatenate(own))], ["id", "own"])

    return lambda ids: written(
        lines.join(ids, "id", "left_semi").mapInArrow(sets_part, "id long, own array<long>"), "lines-sets")


def _alike(left, right, percent):
    """Whether the lines of two lists are alike, pair by pair; an array.

    All pairs are sorted at once, the number of the pair before at least 56 bits of each mixed shingle.
    """
    bits = np.uint64(max(len(left) - 1, 1).bit_length())
    low = np.uint64(64) - bits
    sides = []
    for lines in (left, right):
        hashes, counts = _shingles(lines)
        pair = np.repeat(np.arange(len(lines), dtype=np.uint64), counts)
        keys = np.sort((pair << low) | (_mixed(hashes) >> bits))
        sides.append(keys[np.append(True, keys[1:] != keys[:-1])])
    both = np.sort(np.concatenate(sides))
    of = lambda keys: np.bincount((keys >> low).astype(np.int64), minlength=len(left))
    common = of(both[1:][both[1:] == both[:-1]])
    return 100 * common >= percent * (of(both) - common)


def _confirm(lines, percent):
    """A function from pairs (a, b) to those that are alike. Lines travel to their pairs, being far smaller than their sets."""

    @F.arrow_udf(BooleanType())
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        out, held, start = [], 0, 0
        size = pa.compute.add(pa.compute.binary_length(left), pa.compute.binary_length(right)).to_pylist()
        for at in range(len(left)):
            held += size[at]
            if held > BLOCK_BYTES or at + 1 - start == 256 or at + 1 == len(left):
                out.append(_alike(left[start:at + 1].to_pylist(), right[start:at + 1].to_pylist(), percent))
                held, start = 0, at + 1
        return pa.array(np.concatenate(out) if out else [], pa.bool_())

    def confirm(pairs):
        return pairs.join(lines.select(F.col("id").alias("a"), F.col("line").alias("_la")), "a").join(
            lines.select(F.col("id").alias("b"), F.col("line").alias("_lb")), "b").where(alike("_la", "_lb")).select("a", "b")

    return confirm


def duplicate_lines(df: DataFrame, percent=PERCENT) -> DataFrame:
    """doc_id, line_no, first_doc_id, first_line_no and kept for every line that is not blank.

    first_* name the line that stands for all lines alike; `kept` marks it.
    """
    return _judged(df, percent).drop("row")


def _judged(df, percent):
    """The columns of duplicate_lines, and row."""
    index = index_of(df, percent)
    # One shuffle: rows of a key meet once, distinct items of one key are few unless they are alike.
    inside = Window.partitionBy("key")
    members = index.withColumns({"low": F.min("id").over(inside), "high": F.max("id").over(inside)}).where("low < high").select(
        "key", "id").distinct()
    members = written(members.withColumn("n", F.lit(1)), "lines-keys")
    lines = written(lines_of(df, members.select("id")), "lines")
    texts = lines.where("line IS NOT NULL").select(F.col("item").alias("id"), "line").join(
        members.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("line").alias("line"))
    texts = written(texts, "lines-texts")
    groups = united(members, _sets_of(texts), percent, confirm=_confirm(texts, percent))
    named = lines.drop("line").join(groups.withColumnRenamed("node", "item"), "item", "left").select(
        "doc_id", "row", "line_no", F.coalesce("component", "item").alias("group"))
    named = written(named, "lines-groups")
    first = named.groupBy("group").agg(F.min(F.struct("doc_id", "line_no", "row")).alias("first"), F.count("*").alias("n")).where(
        "n > 1").select("group", "first")
    own = F.struct("doc_id", "line_no", "row")
    return named.join(first, "group", "left").withColumn("first", F.coalesce("first", own)).select(
        "doc_id", "row", "line_no", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"),
        F.col("first").eqNullSafe(own).alias("kept"))


def without_duplicates(df: DataFrame, percent=PERCENT, **columns) -> DataFrame:
    """The documents without their dropped lines; a document that loses its last line that is not blank is dropped.

    `columns`: further columns to set from the new text, as {name: function of the text column}.
    """
    judged = _judged(df, percent)
    dropped = judged.groupBy("doc_id", "row").agg(
        F.collect_set(F.when(~F.col("kept"), F.col("line_no"))).alias("_dropped"), F.count_if("kept").alias("_left")).where(
        F.size("_dropped") > 0)
    dropped = written(dropped.withColumnRenamed("doc_id", "id"), "lines-dropped")
    others, maybe = parted(df, dropped.where("id IS NOT NULL").select("id"))
    nulls = others.where("doc_id IS NULL").unionByName(maybe)
    # Names that no column of the documents has.
    own = "_own"
    while any(c.lower().startswith(own) for c in df.columns):
        own += "_"
    dropped = dropped.select(*[F.col(c).alias(f"{own}{c}") for c in ("id", "row", "_dropped", "_left")])
    gone, left = F.col(f"{own}_dropped"), F.col(f"{own}_left")
    # By the hash of the text first, so that rows without a doc_id are not gathered in one task.
    joined = nulls.join(
        dropped, (_row() == F.col(f"{own}row")) & F.col("doc_id").cast("long").eqNullSafe(F.col(f"{own}id")), "left")
    lines = F.filter(F.split("text", "\n"), lambda line, at: ~F.array_contains(gone, at))
    text = F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    out = joined.where(left.isNull() | (left > 0)).withColumn("text", text)
    changed = {name: F.when(gone.isNull(), F.col(name)).otherwise(make(F.col("text"))) for name, make in columns.items()}
    return others.where("doc_id IS NOT NULL").unionByName(out.withColumns(changed).select(*df.columns))


@query("op9_line_dedup")
def op9(spark, sf_dir):
    """Judges every line of all documents."""
    return duplicate_lines(table(spark, sf_dir, "documents"))
