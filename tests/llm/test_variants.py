"""Spelling variants against all pairs of words and a word-by-word count."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from postmill.llm import variants
from postmill.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    """Whether b comes from a by one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def around(word, letters):
    """All texts one edit away."""
    out = {word[:i] + word[i + 1:] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in letters}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return out - {word}


def brute_words(docs):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(words):
    letters = set("".join(words))
    form, out = {}, {}
    for word, n in words.items():
        others = [v for v in around(word, letters) if v in words]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[word] = best if best is not None and words[best] >= 2 * n else None
        out[word] = len(others)
    rows = set()
    for word, n in words.items():
        root = word
        while form[root] is not None:
            root = form[root]
        rows.add((word, form[word], root, n, out[word], words.get(form[word])))
    return rows


def result(df):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    want = brute(brute_words(docs))
    assert result(QUERIES["op12_spelling_variants"](spark, f"/root/testdata/{sf}")) == want
    assert any(r[1] and r[1] != r[2] for r in want) or sf == "sf0.001"


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abÀ", min_size=0, max_size=7), max_size=30))
def test_scan_equals_all_pairs(words):
    words = sorted(words)
    want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])}
    got = list(variants.near_pairs(words))
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("group_words", [0, 3, 5000])
def test_heads_of_any_size_give_each_pair_once(spark, group_words):
    base = ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "babababa", "abababa", "Éclair", "éclair"]
    letters = "abcé"
    words = sorted({v for w in base for v in around(w, letters) if len(v) >= 5} | set(base))
    counted = {w: 1 + zlib.crc32(w.encode()) % 50 for w in words}
    df = spark.createDataFrame(list(counted.items()), "word string, n long").repartition(5)
    pairs = [(r.word, r.other, r.other_n) for r in variants.near(df, group_words).collect()]
    want = {(w, v, counted[v]) for w in words for v in around(w, set("".join(words))) if v in counted}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert result(variants.variants(df, group_words=group_words)) == brute(counted)


def test_long_chains_lead_to_the_last_form(spark):
    words = {"a" * (5 + i): 3 * 2 ** i for i in range(20)}
    assert {r[2] for r in result(variants.variants(spark.createDataFrame(list(words.items()), "word string, n long")))} == {
        "a" * 24}


def test_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK_BYTES", 64)
    docs = [(None, "Straße straße STRASSE "), (None, None), (1, ""), (2, "x×y÷zab Ünder ünder " * 40),
            (2, "x×y÷zab Ünder ünder " * 40), (3, "中文 mixed 中文text " * 20), (4, "a" * 3000), (5, "a" * 3000),
            (6, "a" * 2999 + "b"), (7, "a" * 3000 + " 😀smile smile-smiles"), (8, "Straße STRASSE straße smile smiles smiles smiles")]
    rows = [(k, t, "x", 1, None) for k, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int, other string").repartition(3)
    assert {(r.word, r.n) for r in variants.vocabulary(df).collect()} == set(brute_words(docs).items())
    assert result(variants.variants(variants.vocabulary(df))) == brute(brute_words(docs))
    assert Counter(dict(variants.word_counts(8, docs[-1][1].encode(), 10 ** 9))) == Counter(
        {"straße": 2, "strasse": 1, "smile": 1, "smiles": 3})


def test_empty_table(spark):
    assert variants.variants(variants.vocabulary(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_changed_words_are_cut_by_code_points():
    words = [(k, "ñandúes") for k in range(400)]
    got = {w for k, t in words for w, _ in variants.word_counts(k, t.encode())}
    assert got - {"ñandúes"} and all(one_edit(w, "ñandúes") for w in got - {"ñandúes"})
