import random

import corpus_pipeline
from postmill.llm import pairs


def overlap(a, b, percent):
    return 100 * len(a & b) >= percent * len(a | b)


def table(spark, sets):
    return spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "id long, own array<long>")


def near_copies(rng, many):
    base = list(range(1000, 1040))
    sets = {}
    for i in range(many):
        own = list(base)
        for _ in range(rng.randrange(1, 7)):
            own[rng.randrange(len(own))] = rng.randrange(60)
        sets[i] = set(own)
    return sets


def test_rare_shingles_make_every_pair_once(spark):
    sets = near_copies(random.Random(3), 150)
    left = spark.createDataFrame([(i, i // 4) for i in sets], "id long, group long")
    got = [tuple(sorted(r)) for r in pairs.sharing_rare(left, lambda ids: table(spark, sets), 80).collect()]
    want = {(a, b) for a in sets for b in sets if a < b and a // 4 != b // 4 and overlap(sets[a], sets[b], 80)}
    assert len(got) == len(set(got)) and want <= set(got) and len(want) > 100
    assert all(a // 4 != b // 4 for a, b in got)


def test_long_prefixes_make_rows_in_proportion(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(pairs, "written", lambda df, label: kept.setdefault(label, df))
    base = set(range(3000))
    sets = {0: base, 1: base | {5000}, 2: base | {5001}}
    left = spark.createDataFrame([(i, i) for i in sets], "id long, group long")
    got = pairs.ordered(pairs.sharing_rare(left, lambda ids: table(spark, sets), 80)).collect()
    assert sorted(map(tuple, got)) == [(0, 1), (0, 2), (1, 2)]
    assert kept["pairs-prefixes"].agg({"size": "count"}).first()[0] > 1700
    assert kept["pairs-prefixes"].selectExpr("max(size(before))").first()[0] == pairs.BEFORE


def grouped(sets, percent):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and overlap(sets[a], sets[b], percent):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    groups = {i: root(i) for i in sets}
    return {i: g for i, g in groups.items() if sum(x == g for x in groups.values()) > 1}


def test_small_keys_need_no_exploded_sets(spark, monkeypatch):
    sets = near_copies(random.Random(4), 20)
    members = spark.createDataFrame([(7, i, 1) for i in sets], "key long, id long, n int")
    monkeypatch.setattr(pairs, "sharing_rare", None)
    got = {r.node: r.component for r in pairs.united(members, lambda ids: table(spark, sets), 80).collect()}
    assert got == grouped(sets, 80) and len(got) > 2


def test_large_keys_lose_no_link(spark):
    sets = near_copies(random.Random(5), 90)
    members = spark.createDataFrame([(7, i, 1) for i in sets], "key long, id long, n int")
    got = {r.node: r.component for r in pairs.united(members, lambda ids: table(spark, sets), 80).collect()}
    assert got == grouped(sets, 80) and len(got) > 20


def test_whole_texts_go_to_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    try:
        docs = spark.createDataFrame([(1, "a line\nanother line", 19)], "doc_id long, text string, n_chars int")
        spark.conf.set(name, "10000")
        assert corpus_pipeline.dedupe_lines(spark, docs, None).count() == 1
        assert spark.conf.get(name) == str(corpus_pipeline.BATCH_ROWS)
        spark.conf.set(name, "10")
        corpus_pipeline.small_batches(spark)
        assert spark.conf.get(name) == "10"
    finally:
        spark.conf.set(name, old)
