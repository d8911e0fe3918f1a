"""Byte-level BPE with the ranks of a given vocabulary: texts to token ids and back.

A text is cut into words by the vocabulary's pattern, and each word is encoded by itself. Every task gathers the distinct
words of a block of texts and replays the merges over all of them at once. Words of one length stand in a matrix with the ranks
of their pairs: each round finds the position of the lowest rank of every word, merges there and looks up only the pairs beside
it. Words longer than SHORT bytes go through an inverted index that leads from a rank to the positions whose pair of neighbours
merges to it; the lowest rank comes next. Encoded words are kept for the task's next blocks, up to a bounded number. Distinct words are not shuffled between tasks:
a table of all words joined back to all word positions would move several times the size of the texts.

Defined cases: null and empty texts have no tokens; a word of any length is merged in n log n steps; ids are those of an
encoder that knows no special tokens, so their strings are ordinary text; rows are independent, so repeated rows and other
columns come through unchanged (columns named like the results are replaced); an empty table gives no rows; decoding null
gives empty bytes, and an id outside the vocabulary is an error.
"""

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from postmill.llm.registry import query, table

RANKS = "byte_bpe_50k.tiktoken"
#: Encoded words kept by one task.
KEPT_WORDS = 200_000
#: Words whose merges are replayed together.
BLOCK_WORDS = 20_000
#: Characters of text that one call handles together.
BLOCK_CHARS = 1 << 20
#: Bytes of a word up to which its merges are replayed in a matrix, whose steps grow with the square of the length.
SHORT = 64


def load_ranks(path):
    """Ranks by token bytes from a file of lines 'base64 rank'."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def replay(words, ranks):
    """Token ids of each word (bytes): all merges over all words, lowest rank first, leftmost first.

    Tokens stand in one long list, linked to their neighbours inside their word. `index` leads from a rank to the
    positions of left halves; a position is stale if its pair has changed since.
    """
    text, starts = b"".join(words), [0]
    for word in words:
        starts.append(starts[-1] + len(word))
    size = len(text)
    token = [text[i:i + 1] for i in range(size)]
    after = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    for start, end in zip(starts, starts[1:]):
        if end > start:
            after[end - 1], before[start] = -1, -1
    index = {}
    for i in range(size):
        if after[i] >= 0 and (rank := ranks.get(token[i] + token[after[i]])) is not None:
            index.setdefault(rank, []).append(i)
    queue = list(index)
    heapify(queue)
    while queue:
        rank = heappop(queue)
        places = index.pop(rank, ())
        places = sorted(places) if len(places) > 1 else places
        for done, i in enumerate(places):
            right = after[i]
            if token[i] is None or right < 0:
                continue
            merged = token[i] + token[right]
            if ranks.get(merged) != rank:
                continue
            token[i], token[right] = merged, None
            after[i] = following = after[right]
            lower = False
            if following >= 0:
                before[following] = i
                if (new := ranks.get(merged + token[following])) is not None:
                    if new not in index:
                        index[new] = []
                        heappush(queue, new)
                    index[new].append(i)
                    lower = new < rank
            if (left := before[i]) >= 0 and (new := ranks.get(token[left] + merged)) is not None:
                if new not in index:
                    index[new] = []
                    heappush(queue, new)
                index[new].append(left)
                lower |= new < rank
            if lower:
                # A pair of lower rank arose, which its word must merge first; the rest of this rank comes later.
                rest = places[done + 1:]
                if rest:
                    if rank not in index:
                        index[rank] = []
                        heappush(queue, rank)
                    index[rank].extend(rest)
                break
    out = []
    for start, end in zip(starts, starts[1:]):
        ids, i = [], start if end > start else -1
        while i >= 0:
            ids.append(ranks[token[i]])
            i = after[i]
        out.append(ids)
    return out


class Pairs:
    """Ranks of pairs of tokens (given by their ranks) as sorted arrays; NONE where a pair does not merge."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, ranks):
        self.base = max(ranks.values(), default=0) + 1
        found = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    found[left * self.base + right] = rank
        self.keys = np.fromiter(found, np.int64, len(found))
        order = np.argsort(self.keys)
        # A last key above all others, so that every search ends at a key.
        self.keys = np.append(self.keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.fromiter(found.values(), np.int32, len(found))[order], np.int32(self.NONE))
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)

    def of(self, left, right):
        keys = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], np.int32(self.NONE))


def replay_alike(words, pairs):
    """Token ids of each word, as bytes of little-endian 32-bit numbers; the words (bytes) have one length, at least 1."""
    out = [b""] * len(words)
    size = len(words[0])
    tokens = pairs.byte[np.frombuffer(b"".join(words), np.uint8).reshape(-1, size)]
    if (tokens < 0).any():
        raise KeyError("a byte without a rank")
    ranks = pairs.of(tokens[:, :-1], tokens[:, 1:])
    numbers = np.arange(len(words))
    while len(numbers):
        # Position of the lowest rank of every word, the leftmost of equal ones.
        at = ranks.argmin(axis=1) if size > 1 else np.zeros(len(numbers), np.int64)
        lowest = ranks[np.arange(len(numbers)), at] if size > 1 else np.full(len(numbers), pairs.NONE)
        going = lowest < pairs.NONE
        if not going.all():
            done, raw = numbers[~going].tolist(), tokens[~going].astype("<u4").tobytes()
            for i, number in enumerate(done):
                out[number] = raw[4 * size * i:4 * size * (i + 1)]
            tokens, ranks, numbers, at, lowest = tokens[going], ranks[going], numbers[going], at[going], lowest[going]
        if not len(numbers):
            break
        # Every word loses the token right of its merge and the pair merged.
        places = np.arange(size)
        tokens[np.arange(len(at)), at] = lowest
        tokens = tokens[places != at[:, None] + 1].reshape(len(at), size - 1)
        ranks = ranks[places[:-1] != at[:, None]].reshape(len(at), size - 2)
        size -= 1
        left, right = np.flatnonzero(at > 0), np.flatnonzero(at < size - 1)
        ranks[left, at[left] - 1] = pairs.of(tokens[left, at[left] - 1], lowest[left])
        ranks[right, at[right]] = pairs.of(lowest[right], tokens[right, at[right] + 1])
    return out


class Encoder:
    """Texts to packed ids; keeps what it has learnt about words."""

    def __init__(self, ranks, pattern):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.whole = {token: np.array([rank], "<u4").tobytes() for token, rank in ranks.items()}
        self.pairs = Pairs(ranks)
        self.known = {}

    def encode(self, texts):
        """Ids of each text as little-endian 32-bit numbers in bytes."""
        lists = [self.split(text) if text else [] for text in texts]
        fresh = set().union(*lists).difference(self.known)
        if len(self.known) + len(fresh) > KEPT_WORDS:
            self.known = {}
            fresh = set().union(*lists)
        alike, long = {}, []
        for word in fresh:
            raw = word.encode()
            if (whole := self.whole.get(raw)) is not None:
                self.known[word] = whole
            elif len(raw) <= SHORT:
                alike.setdefault(len(raw), []).append((word, raw))
            else:
                long.append((word, raw))
        for own in alike.values():
            for at in range(0, len(own), BLOCK_WORDS):
                block = own[at:at + BLOCK_WORDS]
                self.known.update(zip([word for word, _ in block], replay_alike([raw for _, raw in block], self.pairs)))
        for at in range(0, len(long), BLOCK_WORDS):
            block = long[at:at + BLOCK_WORDS]
            for (word, _), ids in zip(block, replay([raw for _, raw in block], self.ranks)):
                self.known[word] = np.array(ids, "<u4").tobytes()
        known = self.known.__getitem__
        return [b"".join(map(known, words)) for words in lists]


def _blocks(texts):
    """Slices of a column of texts with about BLOCK_CHARS each."""
    block, held = [], 0
    for value in texts:
        block.append(value.as_py())
        held += len(block[-1] or "")
        if held > BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def encode(df: DataFrame, path, pattern=public_tokenizers.PATTERN, text="text", keep=None) -> DataFrame:
    """The columns `keep` (default: all) with `ids` (array of int) and `n_tokens`; `path` names the rank file."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("ids", "n_tokens")]
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(path))  # the vocabulary, whose size is fixed
    schema = StructType([df.schema[c] for c in keep] + [
        StructField("ids", ArrayType(IntegerType(), False)), StructField("n_tokens", LongType())])

    def encode_part(batches):
        encoder = Encoder(ranks.value, pattern)
        for batch in batches:
            at = 0
            for block in _blocks(batch.column("_text")):
                packed = encoder.encode(block)
                counts = np.array([len(x) // 4 for x in packed], np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(packed), "<i4"))
                own = batch.slice(at, len(block))
                at += len(block)
                yield pa.RecordBatch.from_arrays([own.column(c) for c in keep] + [ids, pa.array(counts)], [*keep, "ids", "n_tokens"])

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(encode_part, schema)


def _rows(lists):
    """The numbers of each row of an Arrow list column."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def decoded(ids, spark, path):
    """Column of the bytes that a column of ids stands for."""
    tokens = {rank: token for token, rank in load_ranks(path).items()}
    tokens = spark.sparkContext.broadcast(tokens)

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        token = tokens.value.__getitem__
        return pa.array([b"".join(map(token, row.tolist())) for row in _rows(lists)], pa.binary())

    return decode(F.coalesce(ids, F.array().cast("array<int>")))


@F.arrow_udf(StringType())
def ids_sha256(lists: pa.Array) -> pa.Array:
    """SHA-256 of ids as little-endian unsigned 32-bit numbers."""
    return pa.array([hashlib.sha256(row.astype("<u4").tobytes()).hexdigest() for row in _rows(lists)], pa.string())


@query("op2_bpe")
def op2(spark, sf_dir):
    """Encodes and decodes all documents."""
    path = public_tokenizers.path(RANKS)
    tokens = encode(table(spark, sf_dir, "documents"), path, keep=["doc_id"])
    return tokens.select("doc_id", "n_tokens", ids_sha256("ids").alias("ids_sha256"), decoded(F.col("ids"), spark, path).alias(
        "decoded")).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
