"""Packing against the tokenizer run by itself, exhaustive fills and gapless sequences."""

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from postmill.llm import packing
from postmill.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path(packing.TOKENIZER)
NAMES = ["doc_id", "start", "length", "crc", "doc_tokens", "sequence", "offset"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def padded(lengths, capacity=1024):
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in lengths)


def checked(rows, docs, tokenizer, capacity=1024):
    """Rows (doc_id, start, length, crc, doc_tokens, sequence, offset) hold every id once, gapless; returns the padding."""
    want, have, sequences = Counter(), defaultdict(list), defaultdict(list)
    ids = {}
    for key, text in docs:
        ids[key, len(ids)] = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
    by_key = defaultdict(list)
    for (key, _), x in ids.items():
        by_key[key].append(x)
    for key, start, length, crc, total, sequence, offset in rows:
        assert length > 0 and any(
            len(x) == total and zlib.crc32(x[start:start + length].tobytes()) == crc for x in by_key[key])
        have[key].append((start, length, crc, total))
        sequences[sequence].append((offset, length))
    for key, texts in by_key.items():
        assert sum(n for _, n, _, _ in have[key]) == sum(map(len, texts))
        if len(texts) == 1:
            spans = sorted((s, n) for s, n, _, _ in have[key])
            assert [s for s, _ in spans] == [0, *itertools.accumulate(n for _, n in spans)][:-1]
    assert set(have) == set(by_key)
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1]
        assert sum(n for _, n in parts) <= capacity
    return padded([sum(n for _, n in parts) for parts in sequences.values()], capacity)


def test_query_holds_every_id_once(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = QUERIES["op11_packing"](spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = [tuple(r) for r in out.collect()]
    assert checked(rows, docs, tokenizer) == 0
    whole = Counter(r[0] for r in rows)
    assert sum(n > -(-r[4] // 1024) for r in rows for n in [whole[r[0]]]) < 0.25 * len(rows)  # most remainders stay whole


def fills(counts, room):
    """All sums of sub-multisets up to room."""
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
    return sums


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(0, 5), max_size=6), st.integers(0, 40))
def test_fill_is_the_closest(counts, room):
    total, taken = packing.best_fill(counts, room)
    assert total == max(fills(counts, room)) == sum(k * n for k, n in taken.items())
    assert all(n <= counts[k] for k, n in taken.items())
    goals = [room - 3, room - 5, 2]
    got = packing.best_fill(counts, room, goals)
    reachable = [g for g in goals if 0 <= g <= room and g in fills(counts, room)]
    assert (got is None) == (not reachable) and (not got or got[0] == reachable[0] == sum(k * n for k, n in got[1].items()))


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 60), max_size=8))
def test_plan_uses_every_piece_once_without_padding(whole):
    slots, sequences = packing.plan(whole, 32)
    ids, spans = Counter(), defaultdict(list)
    for s in slots:
        size = s.length if s.part < 0 else packing.halves(s.length)[s.part]
        for k in range(s.high - s.low):
            ids[s.length, s.part, s.low + k] += 1
            spans[s.first + k // s.each].append((s.offset + k % s.each * size, size))
    assert set(ids.values()) <= {1} and set(spans) == set(range(sequences))
    for length, n in whole.items():
        for rank in range(n):
            cut = [ids[length, part, rank] for part in range(len(packing.halves(length)))]
            assert (ids[length, -1, rank], cut) in [(1, [0] * len(cut)), (0, [1] * len(cut))]
    lengths = []
    for parts in spans.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1]
        lengths.append(sum(n for _, n in parts))
    assert max(lengths, default=0) <= 32 and padded(lengths, 32) == 0


def test_a_hot_length_is_cut_seldom_and_planned_by_counts():
    slots, sequences = packing.plan({700: 10 ** 9, 1024: 10 ** 6, 3: 1}, 1024)
    assert len(slots) < 3000
    cut = sum(s.high - s.low for s in slots if s.part == 0)
    assert cut < 0.7 * 10 ** 9 and sequences >= (700 * 10 ** 9) // 1024 + 10 ** 6
    natural = {n: 1000 + n * 7 % 13 for n in range(1, 1024)}
    slots, _ = packing.plan(natural, 1024)
    assert sum(s.high - s.low for s in slots if s.part == 0) < 0.001 * sum(natural.values()) and len(slots) < 20_000


def test_odd_and_repeated_documents(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_CHARS", 500)
    docs = [(None, "no key " * 400), (1, None), (2, ""), (3, "word " * 5000), (4, "<|endoftext|> special"), (5, "a" * 9000),
            (6, "中文" * 700), (7, "mixed  spaces \n\n and 'tis it's " * 300), (8, "tail ")] + [(9, "same text " * 70)] * 60
    df = spark.createDataFrame([(k, t, "x", 1, None) for k, t in docs], "doc_id long, text string, length string, at int, crc long")
    layouts = []
    for parts in (1, 7):
        rows = [tuple(r) for r in packing.pack(df.repartition(parts), *packing.vocabulary()).collect()]
        assert checked(rows, docs, tokenizer) == 0
        layouts.append(sorted(rows, key=repr))
    assert layouts[0] == layouts[1]
    packed = spark.createDataFrame(layouts[0], "key long, start long, length long, crc long, n long, sequence long, offset long")
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in docs)
    found = packing.padding(packed).first()
    assert (found.tokens, found.padding) == (total, 0)


def test_ids_equal_the_tokenizer(tokenizer, monkeypatch):
    coder = packing.Coder(*packing.vocabulary())
    points = [*range(0, 0xD800, 23), *range(0xE000, 0x20000, 41), 0x1F600, 0xE0001]
    texts = ["", None, "'s 'll\r\n \t x", " " * 5000 + "x", "a" * 5000, "b" * 1999 + " c", "x<|endoftext|>y", "<|endoftext|>",
             "1234 " * 900, "中文" * 3000]
    texts += [f"a{chr(c)}b {chr(c)} 1{chr(c)}2{chr(c) * 2} \n{chr(c)}'s{chr(c)}  x" for c in points]
    for size in (1 << 20, 300):
        monkeypatch.setattr(packing, "BLOCK_CHARS", size)
        for text in texts + [" ".join(t or "" for t in texts[:40])]:
            assert coder.ids(text).tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), *packing.vocabulary()).collect() == []
