import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from postmill.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)
RANKS = bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_replay_equals_the_library_word_by_word(library):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéßñ 日本🙂", k=rng.randint(1, 40))) for _ in range(3000)]
    words += ["a", "the" * 500, "ab" * 700, "aaaaaaaaaaaaaaaa", " " * 100, "x" * 5000]
    want = [library._encode_single_piece(w.encode()) for w in words]
    got = bpe.Encoder(RANKS, r"(?s).+").encode(words)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def test_texts_equal_the_library(spark, library):
    texts = [None, "", " ", "\n\n \t x", "It's we'll  THEY'RE 123 456.78 <|endoftext|>", "日本語 🙂‍↔️ \u0000 é é", "long " * 40_000,
             "x" * 20_000, "1" * 3000, "same", "same"]
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts += [r.text for r in documents.collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    tokens = bpe.encode(df, PATH)
    out = tokens.select("doc_id", "text", "ids", "n_tokens", bpe.ids_sha256("ids").alias("sha"), bpe.decoded(
        F.col("ids"), spark, PATH).alias("decoded")).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(texts)))
    for row in out:
        want = library.encode_ordinary(texts[row.doc_id] or "")
        assert row.ids == want and row.n_tokens == len(want) and row.text == texts[row.doc_id]
        assert bytes(row.decoded).decode() == (texts[row.doc_id] or "")
        assert row.sha == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()


def test_forgetting_words_changes_nothing(monkeypatch):
    texts = [f"word{i} other{i % 3}" for i in range(50)]
    want = bpe.Encoder(RANKS, public_tokenizers.PATTERN).encode(texts)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    small = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    assert [x for t in texts for x in small.encode([t])] == want


def test_empty_table_and_null_ids(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    df = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [bytes(r[0]) for r in df.select(bpe.decoded(F.col("ids"), spark, PATH)).collect()] == [b"", b""]


def test_words_of_one_length_are_merged_together(library):
    rng = random.Random(9)
    pairs = bpe.Pairs(RANKS)
    for size in (1, 2, 3, 8, 17, bpe.SHORT):
        words = [bytes(rng.choices(b"  aaabeehinorstt\xc3\xa9\xff0", k=size)) for _ in range(400)] + [b"a" * size, b"ab" * size]
        words = [word[:size] for word in words]
        got = bpe.replay_alike(words, pairs)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library._encode_single_piece(w) for w in words]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == bpe.replay(words, RANKS)
    # Short words take no step of Python per merge: rounds, not words, are counted.
    calls, of = [], pairs.of
    pairs.of = lambda left, right: calls.append(len(left)) or of(left, right)
    bpe.replay_alike([bytes(rng.choices(b"aehinorst", k=12)) for _ in range(5000)], pairs)
    assert len(calls) <= 1 + 2 * 12
