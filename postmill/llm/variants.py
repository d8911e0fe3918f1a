"""Spelling variants: words one edit apart are grouped under their more frequent form, by a scan of the sorted vocabulary.

Words are counted per task first and summed by word. Two words that differ by one edit, the shorter with m code points, share
their first m // 2 code points or, reversed, their first m // 2. So the vocabulary is sorted twice, forwards and reversed,
under these heads, and the words of a head stand side by side. A word is compared with all later words of its head in one
scan: the edit matrix between it and the word at hand has a row of three cells per code point (the band of one edit); the
next word keeps the rows of the prefix it shares with the one before, and once all three cells of a row exceed one edit, the
scan skips to the first word that does not share that prefix. A pair is taken under one head only: with m // 2 code points,
forwards if the words share it there.

A head with more than `group_words` words is cut by what a word becomes without one of the code points after the head (and
the word itself): words one edit apart have exactly one such result in common. Such a result belongs to a bounded number
of words (letters of the alphabet times places), so no task gets an unbounded group, and no pair is lost.

Forms lead to roots by doubling steps: a form has at least `ratio` times the occurrences, so chains are short.

Defined cases: a null text has no words; a null doc_id counts as empty in `<doc_id>:<word>`; repeated rows count again; texts
of any length are read whole; ties between forms go to the smaller word in code-point order; a word without near words has
n_near 0, no form and itself as root; an empty table gives no rows; other columns of the input are ignored.
"""

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postmill.llm.registry import query, table
from postmill.operators.spread import attach
from postmill.session import written

#: Every so many-th checksum takes a code point out of a word.
CHANGED = 97
LENGTH = 5
OCCURRENCES = 3
RATIO = 2
GROUP_WORDS = 5_000
#: Distinct words that a task counts before it hands them on.
KEPT_WORDS = 300_000
BLOCK_BYTES = 4 << 20

#: A run of letters A-Z, a-z and U+00C0 to U+00FF, in the UTF-8 of a text whose A-Z are lower-cased.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
#: A byte that no run and no character of several bytes holds.
BREAK = re.compile(rb"[^a-z\x80-\xff]")


def runs(raw):
    """Counter of the lower-cased runs of a text in UTF-8, which is read in blocks that end between runs."""
    raw, out, at = raw.lower(), Counter(), 0
    while at < len(raw):
        stop = BREAK.search(raw, at + BLOCK_BYTES)
        end = stop.start() if stop else len(raw)
        out.update(RUN.findall(raw, at, end))
        at = end
    return out


def word_counts(key, raw, changed=CHANGED):
    """(word as text, occurrences) of one document; the checksum of `key:run` decides whether a code point is left out."""
    start = zlib.crc32(f"{key}:".encode())
    for run, n in runs(raw).items():
        word, check = run.decode(), zlib.crc32(run, start)
        if check % changed == 0:
            place = check % len(word)
            word = word[:place] + word[place + 1:]
        yield word, n


def vocabulary(df: DataFrame, key="doc_id", text="text", length=LENGTH, occurrences=OCCURRENCES, changed=CHANGED) -> DataFrame:
    """(word, n) of all words with at least `length` code points and `occurrences` occurrences."""
    def batch_of(counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def part(batches):
        counts = {}
        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1)):
                for word, n in word_counts(name.as_py(), raw.as_py(), changed):
                    if len(word) >= length:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) > KEPT_WORDS:
                    yield batch_of(counts)
                    counts = {}
        if counts:
            yield batch_of(counts)

    rows = df.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).cast("binary").alias("raw"))
    return rows.mapInArrow(part, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= occurrences)


def headed(words: DataFrame, group_words=GROUP_WORDS) -> DataFrame:
    """(group, side, k, word, n): every word under its heads of k code points, forwards (side 0) and reversed (side 1)."""
    size = F.length("w")
    heads = F.array_distinct(F.array((size / 2).cast("int"), ((size - 1) / 2).cast("int")))
    sides = words.select("n", F.posexplode(F.array("word", F.reverse("word"))).alias("side", "w"))
    rows = sides.select("side", "w", "n", F.explode(heads).alias("k")).select(
        "side", "w", "n", "k", F.substr("w", F.lit(1), F.col("k")).alias("head"))
    # One row per head with more than group_words words: at most 3 * words / group_words.
    full = rows.groupBy("side", "head").agg(F.count("*").alias("_n")).where(F.col("_n") > group_words).select(
        "side", "head", F.lit(True).alias("full"))
    places = F.sequence(F.col("k") + 1, size)
    without = F.transform(places, lambda i: F.concat(F.substr("w", F.lit(1), i - 1), F.substr("w", i + 1)))
    cuts = F.when(F.col("full"), F.array_distinct(F.concat(F.array("w"), without))).otherwise(F.array(F.lit("")))
    return attach(rows, full, ["side", "head"]).select("side", "k", "w", "n", "head", F.explode(cuts).alias("cut")).select(
        F.concat_ws(" ", "side", "head", "cut").alias("group"), "side", "k", F.col("w").alias("word"), "n")


def shared(a, b):
    """Length of the common prefix."""
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def near_pairs(words):
    """(i, j), i < j, of the words one edit apart in a sorted list of distinct words."""
    size = len(words)
    lcp = [0] + [shared(a, b) for a, b in zip(words, words[1:])]
    # beyond[j]: the next place whose shared prefix is shorter than that of j.
    beyond, stack = [size] * size, []
    for j in range(size):
        while stack and lcp[stack[-1]] > lcp[j]:
            beyond[stack.pop()] = j
        stack.append(j)
    longest = max(map(len, words), default=0) + 2
    rows = [None] * longest
    for i in range(size - 1):
        word = words[i]
        width = len(word)
        j = i + 1
        depth = lcp[j]
        # Cells of the columns d - 1, d, d + 1 of row d, while the prefixes are equal.
        for d in range(depth + 1):
            rows[d] = (1, 0, 1 if d < width else 2)
        while j < size:
            other = words[j]
            a, b, c = rows[depth]
            dead = False
            for d in range(depth + 1, len(other) + 1):
                letter = other[d - 1]
                x = 2 if d > width + 1 else min(a + (d < 2 or letter != word[d - 2]), b + 1)
                y = 2 if d > width else min(b + (letter != word[d - 1]), c + 1, x + 1)
                z = 2 if d + 1 > width else min(c + (letter != word[d]), y + 1)
                if x > 1 and y > 1 and z > 1:
                    dead = True
                    break
                rows[d] = (a, b, c) = (x, y, z)
            if dead:
                j += 1
                while j < size and lcp[j] >= d:
                    j = beyond[j]
            else:
                off = width - len(other) + 1
                if 0 <= off <= 2 and rows[len(other)][off] == 1:
                    yield i, j
                j += 1
            if j < size:
                depth = lcp[j]


def near_of_group(side, k, words):
    """Pairs of `near_pairs` that belong to this head: m // 2 = k, and reversed words only if they differ in what is
    their first k code points when read forwards."""
    for i, j in near_pairs(words):
        if min(len(words[i]), len(words[j])) // 2 == k and (side == 0 or words[i][-k:] != words[j][-k:]):
            yield i, j


def near(words: DataFrame, group_words=GROUP_WORDS) -> DataFrame:
    """(word, other, other_n): every pair of words one edit apart, both ways, each once; words: (word, n), distinct."""
    def pairs(group, side, k, held):
        names, numbers = [w for w, _ in held], [n for _, n in held]
        for i, j in near_of_group(side, k, names):
            a, b = (names[i], names[j]) if side == 0 else (names[i][::-1], names[j][::-1])
            yield a, b, numbers[j]
            yield b, a, numbers[i]

    def part(batches):
        now, held, out = None, [], []

        def rows():
            block = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()),
                 pa.array([r[2] for r in out], pa.int64())], ["word", "other", "other_n"])
            out.clear()
            return block

        for batch in batches:
            for group, side, k, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or group != now[0]:
                    if len(held) > 1:
                        out.extend(pairs(*now, held))
                        if len(out) > 50_000:
                            yield rows()
                    now, held = (group, side, k), []
                held.append((word, n))
        if len(held) > 1:
            out.extend(pairs(*now, held))
        if out:
            yield rows()

    placed = headed(words, group_words).repartition("group").sortWithinPartitions("group", "word")
    return placed.mapInArrow(part, "word string, other string, other_n long")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form), one per word and without circles: the last word that forms lead to."""
    reach = written(links.select("word", F.col("form").alias("to"), F.lit(False).alias("done")), "variant-links")
    while not reach.where("NOT done").isEmpty():
        following = reach.select(F.col("word").alias("to"), F.col("to").alias("further"), F.col("done").alias("ends"))
        step = reach.where("NOT done").select("word", "to").join(following, "to", "left").select(
            "word", F.coalesce("further", "to").alias("to"), F.coalesce("ends", F.lit(True)).alias("done"))
        reach = written(reach.where("done").unionByName(step), "variant-links")
    return reach.select("word", F.col("to").alias("root"))


def variants(words: DataFrame, ratio=RATIO, group_words=GROUP_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n of each of the distinct words (word, n)."""
    words = written(words.select("word", "n"), "variant-words")
    rows = near(words, group_words).select("word", F.lit(None).cast("long").alias("n"), "other", "other_n").unionByName(
        words.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("other_n")))
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))))
    found = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), best.alias("best"))
    enough = -F.col("best.n") >= ratio * F.col("n")
    found = written(found.select("word", F.when(enough, F.col("best.word")).alias("form"), "n", "n_near",
                                 F.when(enough, -F.col("best.n")).alias("form_n")), "variant-forms")
    ends = roots(found.where(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op12_spelling_variants")
def op12(spark, sf_dir):
    """Groups the spelling variants of the vocabulary of all documents."""
    return variants(vocabulary(table(spark, sf_dir, "documents")))
