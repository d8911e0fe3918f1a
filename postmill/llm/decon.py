"""Benchmark passages in documents, found by the q-gram lemma and confirmed by banded alignment.

Texts are compared as UTF-8 bytes with A-Z in lower case and every white-space byte as a space. An item of m bytes is
found where a stretch of a document is within e = floor(RATE * m) edits of it. Such a stretch shares at least
m - q + 1 - q * e q-grams with the item, all on diagonals (place in the document minus place in the item) that lie within
e of each other. So shared q-grams are counted in overlapping bands of diagonals; bands that reach the bound are kept and
verified by an alignment over the band's diagonals. q is 8, or less for short items so that the bound is at least 1.

The benchmark is sent to the tasks in blocks of at most BLOCK_BYTES of text each, however large it is.

Defined cases: null or empty items and null or empty texts match nothing; rows of the benchmark that repeat an item_id are
items of that id; regions of one id that overlap are reported as the one with the fewest edits, the earliest of equals;
repeated documents are searched each; documents of any length are searched whole, long ones in overlapping pieces; an
empty table gives no rows; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postmill.llm.pairs import without
from postmill.llm.registry import Sent, query, table
from postmill.session import written

RATE = 0.1
GRAM = 8
#: Bytes of benchmark text searched for in one pass over the documents.
BLOCK_BYTES = 4 << 20
#: Bytes of documents that a task looks at together, and the longest piece of one document.
TEXT_BYTES = 1 << 20
SLOTS = 22
MATCHES = "doc_id long, item_id long, start long, end long, edits int"
SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def plain(text):
    return (text or "").encode().lower().translate(SPACES)


def _windows(data, q):
    """The q-gram at each place as a number; places too near the end hold fewer bytes and are left out by the caller."""
    padded = data + b"\0" * 8
    return np.ndarray((len(data),), "<u8", padded, strides=(1,)) & np.uint64((1 << 8 * q) - 1)


class Items:
    """The q-grams of benchmark items, grouped by q."""

    def __init__(self, items, rate=RATE):
        items = sorted({(i, x) for i, text in items if (x := plain(text))}, key=lambda x: (x[0] is not None, x))
        self.ids, self.texts = [i for i, _ in items], [x for _, x in items]
        self.sizes = np.array([len(x) for x in self.texts], np.int64)
        self.budgets = (self.sizes * rate + 1e-9).astype(np.int64)
        self.grams = []
        if not items:
            return
        each = np.minimum(GRAM, self.sizes // (self.budgets + 1))
        for q in sorted(set(each.tolist())):
            members = np.flatnonzero(each == q)
            values, owners, places = [], [], []
            for k in members:
                own = _windows(self.texts[k], q)[: self.sizes[k] - q + 1]
                values.append(own)
                owners.append(np.full(len(own), k))
                places.append(np.arange(len(own)))
            values, owners, places = map(np.concatenate, (values, owners, places))
            order = np.argsort(values, kind="stable")
            unique, first, counts = np.unique(values[order], return_index=True, return_counts=True)
            flags = np.zeros(1 << SLOTS, bool)
            flags[self._slot(unique)] = True
            self.grams.append((q, unique, first, counts, owners[order], places[order], flags))
        self.least = self.sizes - each + 1 - each * self.budgets

    @staticmethod
    def _slot(values, bits=SLOTS):
        return ((values * FACTOR) >> np.uint64(64 - bits)).astype(np.int64)

    def bands(self, data):
        """(item, first diagonal, last diagonal) of the bands of `data` that share enough q-grams."""
        out = []
        for q, unique, first, counts, owners, places, flags in self.grams:
            seen = _windows(data, q)
            at = np.flatnonzero(flags[self._slot(seen)])
            found = np.minimum(np.searchsorted(unique, seen[at]), len(unique) - 1)
            same = unique[found] == seen[at]
            at, found = at[same], found[same]
            many = counts[found]
            entry = np.repeat(first[found] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            item, diagonal = owners[entry], np.repeat(at, many) - places[entry] + (1 << 40)
            # Bands start every `step` diagonals and are `step + budget` wide, so any stretch of `budget` lies in one.
            step = np.maximum(self.budgets[item], 16)
            band = diagonal // step
            below = diagonal - band * step < self.budgets[item]
            keys = (item.astype(np.uint64) << np.uint64(42)) | band.astype(np.uint64)
            keys = np.concatenate([keys, (keys - np.uint64(1))[below]])
            # A rough count first, which can only be too high, spares most of the sorting.
            cell = self._slot(keys, min(SLOTS, len(keys).bit_length() + 2))
            keys = keys[np.bincount(cell, minlength=1)[cell] >= self.least[(keys >> np.uint64(42)).astype(np.int64)]]
            keys, many = np.unique(keys, return_counts=True)
            item = (keys >> np.uint64(42)).astype(np.int64)
            kept = many >= self.least[item]
            item, band = item[kept], (keys[kept] & np.uint64((1 << 42) - 1)).astype(np.int64)
            step = np.maximum(self.budgets[item], 16)
            low = band * step - (1 << 40)
            out += zip(item.tolist(), low.tolist(), (low + step + self.budgets[item]).tolist())
        return out


def align(item, text, budget):
    """(edits, end) of the best stretch of text for the item, the earliest end of equals; (None, None) beyond the budget.

    Rows are the item's bytes, columns the text's; a stretch may begin anywhere. The text is a band wide plus the item long,
    so the table is banded by its size.
    """
    letters, places = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, byte in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (letters != byte), row[1:] + 1)
        row = np.minimum.accumulate(new - places) + places
    end = int(row.argmin())
    return (int(row[end]), end) if row[end] <= budget else (None, None)


def regions_of(wanted, part, budget):
    """(edits, start, end) of all regions of part that match within the budget, none overlapping another: the best one (exact
    ones first, then fewest edits, earliest end), and then those beside it."""
    left = [(0, len(part))]
    while left:
        low, high = left.pop()
        if high - low < len(wanted) - budget:
            continue
        piece = part[low:high]
        if (start := piece.find(wanted)) >= 0:
            edits, end = 0, start + len(wanted)
        else:
            edits, end = align(wanted, piece, budget)
            if edits is None:
                continue
            start = end - align(wanted[::-1], piece[:end][::-1], budget)[1]
        yield edits, low + start, low + end
        if end > start:
            left += [(low, low + start), (low + end, high)]


def matches(items, texts):
    """(index of text, item, start, end, edits) for texts in plain bytes; overlapping regions of an id are merged."""
    joint, starts = b"\0".join(texts), np.cumsum([0, *(len(x) + 1 for x in texts)])
    found = {}
    for item, low, high in items.bands(joint):
        size, budget, wanted = int(items.sizes[item]), int(items.budgets[item]), items.texts[item]
        begin, stop = low - budget, high + size + budget
        for k in range(max(0, int(np.searchsorted(starts, begin, "right")) - 1), min(len(texts), int(np.searchsorted(starts, stop)))):
            left, right = max(begin, starts[k]) - starts[k], min(stop - starts[k], len(texts[k]))
            part = texts[k][left:right]
            for edits, start, end in regions_of(wanted, part, budget):
                found.setdefault((k, items.ids[item]), set()).add((edits, int(left + start), int(left + end)))
    out = []
    for (k, item), regions in found.items():
        kept = []
        for edits, start, end in sorted(regions):
            if all(end <= s or start >= e for _, s, e in kept):
                kept.append((edits, start, end))
        out += [(k, item, start, end, edits) for edits, start, end in kept]
    return out


def _pieces(text, overlap):
    """(offset, bytes) of overlapping pieces of one document."""
    step = max(TEXT_BYTES, 2 * overlap)
    return [(at, text[at: at + step + overlap]) for at in range(0, max(1, len(text) - overlap), step)]


def _in_document(items, text):
    """Matches of one long document, piece by piece; what two pieces find is merged."""
    overlap, found = int((items.sizes + 2 * items.budgets).max()) + 1, {}
    for at, piece in _pieces(text, overlap):
        for _, item, start, end, edits in matches(items, [piece]):
            found.setdefault(item, set()).add((edits, at + start, at + end))
    for item, regions in found.items():
        kept = []
        for edits, start, end in sorted(regions):
            if all(end <= s or start >= e for _, s, e in kept):
                kept.append((edits, start, end))
                yield item, start, end, edits


def _blocks(benchmark):
    """The benchmark as lists of (item_id, text) of about BLOCK_BYTES."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for k in range(blocks):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield [(r.item_id, r.text) for r in mine.collect()]


def contamination(documents: DataFrame, benchmark: DataFrame, rate=RATE) -> DataFrame:
    """doc_id, item_id, start, end (characters) and edits for every benchmark item found in a document."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], MATCHES)
    for block in _blocks(benchmark):
        sent = Sent(spark, Items(block, rate))  # at most a block of the benchmark

        def search_part(batches, sent=sent):
            items = sent.get()
            for batch in batches:
                ids, texts, rows = batch.column("doc_id").to_pylist(), batch.column("text"), []
                joint, owners, held = [], [], 0

                def search(joint, owners):
                    for k, item, start, end, edits in matches(items, joint):
                        rows.append((ids[owners[k]], item, len(joint[k][:start].decode("utf-8", "ignore")),
                                     len(joint[k][:end].decode("utf-8", "ignore")), edits))

                for i in range(len(ids) if len(items.sizes) else 0):
                    text = plain(texts[i].as_py())
                    if len(text) > TEXT_BYTES:
                        for item, start, end, edits in _in_document(items, text):
                            rows.append((ids[i], item, len(text[:start].decode("utf-8", "ignore")),
                                         len(text[:end].decode("utf-8", "ignore")), edits))
                        continue
                    joint.append(text)
                    owners.append(i)
                    held += len(text)
                    if held > TEXT_BYTES:
                        search(joint, owners)
                        joint, owners, held = [], [], 0
                if joint:
                    search(joint, owners)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*rows), (*[pa.int64()] * 4, pa.int32()))],
                        ["doc_id", "item_id", "start", "end", "edits"])

        out = out.unionByName(docs.mapInArrow(search_part, MATCHES))
    return out


def clean(documents: DataFrame, benchmark: DataFrame, rate=RATE) -> DataFrame:
    """The documents in which no benchmark item is found. Rows without a doc_id are judged by no id and stay."""
    found = contamination(documents, benchmark, rate).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct()
    return without(documents, written(found, "decontamination"))


@query("op6_decontamination")
def op6(spark, sf_dir):
    """Searches all documents for all benchmark items."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
