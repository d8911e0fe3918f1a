import random

import pytest

from postmill.llm import decon

SCHEMA = "doc_id long, text string, item_id string, start int, edits string"


def distance(item, text):
    """Fewest edits between the item and any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(text)), rng.randrange(3)
        text[at:at + 1] = [[], [text[at], rng.choice("abc")], [rng.choice("xyz")]][kind]
    return "".join(text)


@pytest.mark.parametrize("seed", range(6))
def test_finds_what_brute_force_finds(seed):
    rng = random.Random(seed)
    words = ["the", "of", "tion", "heri", "anon", "ble", "sh", "reed", "inth", "ou"]
    sentence = lambda n: " ".join("".join(rng.choices(words, k=rng.randint(1, 2))) for _ in range(n))
    items = [(i, sentence(rng.choice([1, 2, 4, 8, 20]))) for i in range(12)]
    texts = []
    for _ in range(30):
        _, item = rng.choice(items)
        texts.append(sentence(rng.randrange(12)) + " " + edited(rng, item, rng.randrange(2 + len(item) // 7)) + sentence(rng.randrange(12)))
    known = decon.Items(items)
    got = {(k, i) for k, i, *_ in decon.matches(known, [decon.plain(t) for t in texts])}
    want = {(k, i) for k, t in enumerate(texts) for i, item in items if distance(item, t) <= int(len(item) * 0.1 + 1e-9)}
    assert got == want


def test_regions_offsets_and_odd_rows(spark):
    item = "An item of the benchmark, which has been copied into documents as it stands, é included."
    moved = item.replace("has been", "had been").replace("é", "e")
    rows = [(1, f"ééé {item} and more {item}", "", 1, ""), (2, f"x\n{moved.upper()}", "", 1, ""), (3, None, None, None, None), (4, "", "", 1, ""),
            (None, item, "", 1, ""), (5, "clean text " * 300_000 + item + "y" * 10, "", 1, ""), (6, item[:60], "", 1, ""), (6, item, "", 1, ""),
            (7, item.replace(" ", "\t\n"), "", 1, "")]
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (None, "some other passage that is nowhere to be found")],
                                  "item_id long, text string")
    out = decon.contamination(spark.createDataFrame(rows, SCHEMA), bench).collect()
    got = sorted((r.doc_id or 0, r.item_id, r.start, r.edits) for r in out)
    n = len(item)
    assert [g for g in got if g[0] in (0, 1, 5, 6)] == [(0, 7, 0, 0), (1, 7, 4, 0), (1, 7, 4 + n + 10, 0), (5, 7, 3_300_000, 0), (6, 7, 0, 0)]
    assert {r.end - r.start for r in out if r.doc_id == 1} == {n}
    assert [g[0] for g in got if g[0] == 2] == [2] and not [g for g in got if g[0] == 7]  # 14 more bytes than the budget
    kept = decon.clean(spark.createDataFrame(rows, SCHEMA), bench).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 3, 4, 7]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a text", "", 1, "")], SCHEMA)
    assert decon.contamination(docs, bench).count() == decon.contamination(one, bench).count() == 0
    assert decon.clean(one, bench).count() == 1


def test_every_planted_passage(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    items = [(r.item_id, r.text) for r in read("benchmark").collect()]
    want = {(d.doc_id, i) for d in read("documents").collect() for i, t in items if t in d.text}
    got = {(r.doc_id, r.item_id) for r in decon.contamination(read("documents"), read("benchmark")).collect() if r.edits == 0}
    assert want and want == got


def test_blocks_give_the_same(spark, monkeypatch):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    want = sorted(map(tuple, decon.contamination(read("documents"), read("benchmark")).collect()))
    monkeypatch.setattr(decon, "BLOCK_BYTES", 5000)
    assert sorted(map(tuple, decon.contamination(read("documents"), read("benchmark")).collect())) == want
