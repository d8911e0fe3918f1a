"""Packing of tokenised documents into windows by minimum bin slack.

A document's ids are cut into whole windows and a remainder. What has to be packed is the multiset of remaining lengths,
at most capacity - 1 counts whatever the number of documents. For the longest length left, a subset-sum dynamic programme over
the other lengths (a bitset of reachable sums, longest lengths first, each up to its count) finds the sum that fills the window
closest to capacity; backtracking through the bitsets gives the counts of each length. The found window is used as often as
the counts allow, so the number of different windows is bounded by lengths, not by documents, and the driver plans them all.

Where no multiset fills the window, one whose total is a power of two will do, since such sequences are not padded. Where there
is none either, a quarter (at least one) of the pieces of that length are cut into lengths that are powers of two, which
are packed like other lengths; so nearly all documents keep their remainder whole, and no sequence is padded.

Pieces are numbered within their length in a distributed sort by (length, document, start, checksum); equal rows may change
places, but no task holds a length as a whole. A window plan says which numbers of a length go to which sequence and offset.

Defined cases: a null or empty text is the end id alone; documents with a null or repeated doc_id are packed each by itself;
texts of any length are read whole; the sequences and offsets do not depend on the partitions of the input; an empty table
gives no rows; other columns of the input are ignored.
"""

import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postmill.llm.bpe import RANKS, load_ranks
from postmill.llm.registry import Sent, query, table
from postmill.operators.spread import global_index
from postmill.session import written

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 1024
END = 0
#: Code points of a text that are handled together.
BLOCK_CHARS = 1 << 20
#: Between a letter and a space that begins a word: no token of a byte-level vocabulary goes across.
GAP = re.compile("[A-Za-z](?= [A-Za-z])")
#: Longer runs without a change between text and white space go to the tokenizer itself, whose merging is n log n.
RUN = 2000
BLANK = re.compile(r"\s{%d}" % RUN)


class Coder:
    """Ids as the tokenizer file gives them, without special tokens added.

    `ranks` are the tokenizer's merges as ranks of byte strings. With them, texts are encoded by the rank encoder, which
    gives the same ids several times faster; texts with a special token's string or a very long run go to the tokenizer.
    """

    def __init__(self, tokenizer, ranks, pattern=public_tokenizers.PATTERN):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_str(tokenizer)
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]

    def ids(self, text):
        """The ids of a text (None: empty), read in blocks of bounded size."""
        parts = [self._block(block) for block in cut(text or "")]
        return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, "<u4"), *parts])

    def _block(self, text):
        odd = len(text) >= RUN and (max(map(len, text.split()), default=0) >= RUN or BLANK.search(text))
        if odd or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


def cut(text):
    """The text in pieces of about BLOCK_CHARS that can be tokenised by themselves."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + BLOCK_CHARS) if len(text) - at > BLOCK_CHARS else None
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


def halves(length):
    """Descending powers of two that add up to length."""
    return [1 << bit for bit in range(length.bit_length() - 1, -1, -1) if length >> bit & 1]


def pieces_of(ids, capacity=CAPACITY):
    """(start, length, checksum, checksums of the powers of two that make up the length) of a document's pieces."""
    raw = ids.tobytes()
    for start in range(0, len(ids), capacity):
        piece = raw[4 * start:4 * (start + capacity)]
        length, at, parts = len(piece) // 4, 0, []
        if length < capacity:
            for size in halves(length):
                parts.append(zlib.crc32(piece[4 * at:4 * (at + size)]))
                at += size
        yield start, length, zlib.crc32(piece), parts


def pieces(df: DataFrame, tokenizer, ranks, key="doc_id", text="text", capacity=CAPACITY, end=END) -> DataFrame:
    """(key, doc_tokens, start, length, crc, parts) of all documents; tokenizer, ranks: as in Coder."""
    schema = "key long, doc_tokens long, start long, length int, crc long, parts array<long>"
    sent = df.sparkSession.sparkContext.broadcast((tokenizer, ranks))  # the vocabulary, whose size is fixed

    def part(batches):
        coder = Coder(*sent.value)
        for batch in batches:
            out = []
            for name, value in zip(batch.column(0), batch.column(1)):
                ids = np.append(coder.ids(value.as_py()), np.uint32(end))
                out.extend((name.as_py(), len(ids), *piece) for piece in pieces_of(ids, capacity))
                if len(out) > 20_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return df.select(F.col(key).cast("long"), text).mapInArrow(part, schema)


def _batch(rows):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, ["key", "doc_tokens", "start", "length", "crc", "parts"])


@dataclass
class Slot:
    """Pieces of one kind, by number within their length, that go to a run of sequences: `each` per sequence.

    part: -1 for whole pieces, else which of the powers of two of the length.
    """

    length: int
    part: int
    low: int
    high: int
    first: int
    each: int
    offset: int


def best_fill(counts, room, exact=None):
    """(sum, {length: count}) of the multiset of lengths whose sum is closest to `room` from below.

    counts: {length: how many}. With `exact`, the first of these sums that can be reached, or None when none can be.
    Lengths are tried from the longest, and as few as possible of the shorter ones are taken.
    """
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    goals = [room] if exact is None else [g for g in exact if 0 <= g <= room]
    if not goals:
        return None
    for length in sorted((x for x in counts if counts[x] and x <= room), reverse=True):
        steps.append((length, reach))
        left, chunk = min(counts[length], room // length), 1
        while left:  # doubling: any number of copies up to the count
            take = min(chunk, left)
            reach |= reach << take * length & mask
            left, chunk = left - take, 2 * chunk
        if reach >> goals[0] & 1:
            break
    if exact is not None:
        total = next((g for g in goals if reach >> g & 1), None)
        if total is None:
            return None
    else:
        total = reach.bit_length() - 1
    taken, at = {}, total
    for length, before in reversed(steps):
        n = 0
        while not before >> at & 1:
            at -= length
            n += 1
        if n:
            taken[length] = n
    return total, taken


class _Stock:
    """What is left of each length: whole pieces from a running number on, and runs of cut pieces."""

    def __init__(self, whole):
        self.next = {length: 0 for length in whole}
        self.whole = dict(whole)
        self.cut = {}  # length: list of [source length, part, low, high]
        self.count = dict(whole)

    def take(self, length, each, times, first, offset, out):
        """Take each * times pieces of this length: `each` per sequence, the sequences counting up from `first`."""
        self.count[length] -= each * times
        done = 0  # pieces taken so far of this slot
        while done < each * times:
            if self.cut.get(length):
                run = self.cut[length][0]
                source, part, low, high = run
            else:
                source, part, low, high = length, -1, self.next[length], self.whole[length]
            n = min(high - low, each * times - done)
            # A run that starts inside a sequence is given out one sequence at a time until it is level again.
            inside = done % each
            if inside:
                n = min(n, each - inside)
                slot = Slot(source, part, low, low + n, first + done // each, n, offset + inside * length)
            elif n >= each:
                n -= n % each
                slot = Slot(source, part, low, low + n, first + done // each, each, offset)
            else:
                slot = Slot(source, part, low, low + n, first + done // each, n, offset)
            out.append(slot)
            done += n
            if part < 0:
                self.next[length] = low + n
            else:
                run[2] = low + n
                if run[2] == run[3]:
                    self.cut[length].pop(0)

    def split(self, length, n):
        """Cut n whole pieces of this length into powers of two."""
        high = self.whole[length]
        self.whole[length] = low = high - n
        self.count[length] -= n
        for part, size in enumerate(halves(length)):
            self.cut.setdefault(size, []).append([length, part, low, high])
            self.next.setdefault(size, 0)
            self.whole.setdefault(size, 0)
            self.count[size] = self.count.get(size, 0) + n

    def whole_left(self, length):
        return self.whole.get(length, 0) - self.next.get(length, 0)


def plan(whole, capacity=CAPACITY):
    """(slots, number of sequences) for {length: number of pieces}: minimum bin slack, longest length first."""
    stock, out, sequences = _Stock(whole), [], 0
    powers = [1 << bit for bit in range((capacity - 1).bit_length() - 1, -1, -1)]
    while True:
        longest = max((length for length, n in stock.count.items() if n), default=None)
        if longest is None:
            return out, sequences
        others = dict(stock.count)
        others[longest] -= 1
        total, taken = best_fill(others, capacity - longest)
        if total < capacity - longest:
            fill = best_fill(others, capacity - longest, [p - longest for p in powers if p >= longest])
            if fill is not None:
                taken = fill[1]
            elif stock.whole_left(longest):
                stock.split(longest, max(1, stock.whole_left(longest) // 4))
                continue
        taken = {**taken, longest: taken.get(longest, 0) + 1}
        times = min(stock.count[length] // n for length, n in taken.items())
        offset = 0
        for length in sorted(taken, reverse=True):
            stock.take(length, taken[length], times, sequences, offset, out)
            offset += taken[length] * length
        sequences += times


def pack(df: DataFrame, tokenizer, ranks, key="doc_id", text="text", capacity=CAPACITY, end=END) -> DataFrame:
    """One row per piece: key, start, length, crc (of its ids), doc_tokens, sequence, offset; see the module's head."""
    spark = df.sparkSession
    found = written(pieces(df, tokenizer, ranks, key, text, capacity, end), "pieces")
    order = ["length", "key", "start", "doc_tokens", "crc"]
    placed = global_index(found.withColumn("_tie", F.monotonically_increasing_id()), [*order, "_tie"], "at").drop("_tie")
    whole = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    slots, _ = plan(whole, capacity)
    firsts, before = {}, 0
    for length in sorted(whole):
        firsts[length], before = before, before + whole[length]
    sent = Sent(spark, _Table(slots, firsts))
    schema = "key long, start long, length long, crc long, doc_tokens long, sequence long, offset long"

    def part(batches):
        places = sent.get()
        for batch in batches:
            yield places.placed(batch)

    return placed.select("key", "start", "length", "crc", "doc_tokens", "parts", "at").mapInArrow(part, schema)


class _Table:
    """The slots by length and part, sorted by number; their count depends on the capacity and hardly on the rows."""

    def __init__(self, slots, firsts):
        self.firsts, groups = firsts, {}
        for s in sorted(slots, key=lambda s: (s.length, s.part, s.low)):
            groups.setdefault((s.length, s.part), []).append((s.low, s.high, s.first, s.each, s.offset))
        self.groups = {key: np.array(rows, np.int64) for key, rows in groups.items()}

    def find(self, length, part, numbers):
        """(sequence, offset) arrays of numbered pieces, -1 where the number has no slot of this kind."""
        rows = self.groups.get((length, part))
        if rows is None:
            return np.full(len(numbers), -1), np.full(len(numbers), -1)
        at = np.searchsorted(rows[:, 0], numbers, "right") - 1
        row = rows[np.maximum(at, 0)]
        known = (at >= 0) & (numbers < row[:, 1])
        rank = numbers - row[:, 0]
        size = length if part < 0 else halves(length)[part]
        sequence, offset = row[:, 2] + rank // row[:, 3], row[:, 4] + rank % row[:, 3] * size
        return np.where(known, sequence, -1), np.where(known, offset, -1)

    def placed(self, batch):
        """The rows of whole and cut pieces of a batch."""
        lengths = batch.column("length").to_numpy()
        numbers = batch.column("at").to_numpy()
        parts = batch.column("parts")
        offsets, checks = parts.offsets.to_numpy(), parts.values.to_numpy(zero_copy_only=False)
        out = []
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            ranks = numbers[rows] - self.firsts[int(length)]
            shift = 0
            kinds = [-1, *range(len(halves(int(length))))]
            for part in kinds:
                size = int(length) if part < 0 else halves(int(length))[part]
                sequence, offset = self.find(int(length), part, ranks)
                hit = np.flatnonzero(sequence >= 0)
                picked = rows[hit]
                crc = batch.column("crc").to_numpy()[picked] if part < 0 else checks[offsets[picked] + part]
                out.append((picked, np.full(len(hit), shift), np.full(len(hit), size), crc, sequence[hit], offset[hit]))
                if part >= 0:
                    shift += size
        if out:
            picked, shift, size, crc, sequence, offset = (np.concatenate(c) for c in zip(*out))
        else:
            picked, shift, size, crc, sequence, offset = (np.empty(0, np.int64) for _ in range(6))
        take = pa.array(picked)
        return pa.RecordBatch.from_arrays(
            [batch.column("key").take(take), pa.array(batch.column("start").to_numpy()[picked] + shift),
             pa.array(size.astype(np.int64)), pa.array(crc.astype(np.int64)), batch.column("doc_tokens").take(take),
             pa.array(sequence), pa.array(offset)],
            ["key", "start", "length", "crc", "doc_tokens", "sequence", "offset"])


def padding(packed: DataFrame, capacity=CAPACITY) -> DataFrame:
    """One row: sequences, tokens, padding; a sequence is padded to capacity unless its length is a power of two."""
    sums = packed.groupBy("sequence").agg(F.sum("length").alias("n"))
    power = F.bit_count("n") == 1
    return sums.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"),
                    F.sum(F.when(power, 0).otherwise(capacity - F.col("n"))).alias("padding"))


def vocabulary(name=TOKENIZER, ranks=RANKS):
    """(text of the tokenizer file, ranks by token bytes) of one of the public vocabularies."""
    with open(public_tokenizers.path(name)) as file:
        return file.read(), load_ranks(public_tokenizers.path(ranks))


@query("op11_packing")
def op11(spark, sf_dir):
    """Packs all documents into sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), *vocabulary()).select(
        F.col("key").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens",
        F.col("sequence").alias("sequence_id"), "offset")
