import itertools
import math
import random

import numpy as np
import pytest

from postmill.llm import crf, toxic

SCHEMA = "doc_id long, text string, score string, spans int, toxic string"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    lengths, trans = [3, 1, 6, 2, 5], np.exp(rng.normal(size=(2, 2)))
    unary = rng.normal(size=sum(lengths))
    chains = crf.Chains(lengths)
    got, pairs = chains.marginals(unary, trans), chains.pairs(*chains.forward_backward(unary, trans), trans)
    want, links, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        total, ones, cell = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=n):
            weight = math.exp(sum(u for u, s in zip(unary[at:at + n], path) if s))
            for a, b in zip(path, path[1:]):
                weight *= trans[a][b]
            total += weight
            ones += weight * np.array(path)
            for a, b in zip(path, path[1:]):
                cell[a][b] += weight
        want += list(ones / total)
        links += cell / total
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, links)


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5, 9):
        unary, trans = rng.normal(size=n), np.exp(rng.normal(size=(2, 2)))
        paths = itertools.product((0, 1), repeat=n)
        weight = lambda p: sum(u for u, s in zip(unary, p) if s) + sum(math.log(trans[a][b]) for a, b in zip(p, p[1:]))
        assert crf.viterbi(unary, trans) == list(max(paths, key=weight))


def made(n, seed=0):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]
    bad = ["zorkan", "zorkel", "vilqu", "krrt"]
    for _ in range(n):
        words, mark = [rng.choice(plain) for _ in range(rng.randint(20, 60))], int(rng.random() < 0.4)
        for _ in range(rng.randint(2, 4) * mark):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        yield "Some line\n" + " ".join(words), mark


@pytest.fixture(scope="module")
def model():
    return toxic.fit(list(made(300)))


def test_learns_words_and_beginnings(model):
    wrong = sum((model.score(m) >= 0.5) != t for (text, t), m in ((d, model.tag([d[0]])[0]) for d in made(200, 9)))
    assert wrong <= 4
    unseen = model.tag(["some zorkix words and more of them"])[0]
    assert unseen[1] > 2 * np.delete(unseen, 1).max()


def test_scores_spans_and_odd_rows(spark, model):
    rows = [(1, "Clean words\nin two lines", "", 1, ""), (2, "É\n\nyou Zorkan zorkel, VILQU x", "", 1, ""), (3, None, None, None, None),
            (4, "", "", 1, ""), (None, "--- !!!", "", 1, ""), (5, "abc zorkan " * 30_000, "", 1, ""), (1, "Clean words\nin two lines", "", 1, "")]
    out = toxic.score(spark.createDataFrame(rows, SCHEMA), model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 7 and all(0 <= r.score <= 1 for r in out)
    assert by[2].score > 0.5 > by[1].score and by[5].score > 0.5 > by[3].score == by[4].score == by[None].score
    assert [rows[1][1][s.start:s.end] for s in by[2].spans] == ["Zorkan zorkel, VILQU"]
    assert by[1].spans == [] and len(by[5].spans) > 1000


def test_nothing_to_learn_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x", "", 1, "")], SCHEMA)
    for marks in ([], [(1, 1)], [(1, None), (None, 0)]):
        labels = spark.createDataFrame(marks, "doc_id long, toxic int")
        assert [tuple(r)[:4] for r in toxic.toxicity(df, labels).collect()] == [(1, r_held(1), 0.0, 0)]
    assert toxic.score(df.limit(0), None).count() == 0


def r_held(doc):
    import zlib
    return zlib.crc32(str(doc).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    labels = read("labels")
    sample = toxic.training_sample(read("documents"), labels)
    drawn = labels.where(~toxic.held_out(labels["doc_id"])).count()
    assert 0.95 * drawn <= len(sample) <= drawn  # very long documents are not drawn
    out = toxic.toxicity(read("documents"), labels)
    assert out.count() == 1000
    held = out.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in held) >= 0.93 * len(held)
    assert sum(r.predicted and not r.toxic for r in held) <= 1


def test_a_task_holds_little_whatever_the_table(monkeypatch):
    import pyarrow as pa

    model = toxic.Model({}, -4.0, np.ones((2, 2)), np.zeros(4))
    texts = [None, "", *(" ".join(f"w{i}x{j}" for j in range(200)) for i in range(2000))]
    blocks = list(toxic._blocks(pa.array(texts)))
    assert sum(blocks, []) == texts and max(sum(map(len, filter(None, b))) for b in blocks) <= 530_000
    got, most = [], 0
    for block in blocks:
        got += model.tag(block)
        most = max(most, len(model.known))
    assert most <= 100_000
    monkeypatch.setattr(toxic, "KEPT_WORDS", 10)
    small = toxic.Model({}, -4.0, np.ones((2, 2)), np.zeros(4))
    assert all(np.array_equal(a, b) for a, b in zip(got, small.tag(texts)))
