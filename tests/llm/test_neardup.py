import random

from postmill.llm import neardup
from postmill.llm.graph import components

SCHEMA = "doc_id long, text string, signature string, key int, component string"


def brute(rows, words, percent):
    sets, parent = {}, {}
    for i, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {b" ".join(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def found(spark, rows, words=3, percent=85):
    out = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), words, percent).collect()
    assert len(out) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}


def test_equals_brute_force_on_documents(spark):
    rows = [(r.doc_id, r.text, "", 1, "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert found(spark, rows) == brute(rows, 3, 85)


def test_group_of_near_copies_and_odd_rows(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(120)]
    rows = [(i, " ".join(word() if rng.random() < rng.choice([0, .02, .06]) else w for w in base), None, None, None)
            for i in range(150)]
    rows += [(200, None, "", 1, ""), (201, "", "", 1, ""), (202, " \n\t", "", 1, ""), (203, "One", "", 1, ""),
             (204, "one  ", "", 1, ""), (205, "one two", "", 1, ""), (206, "É one two", "", 1, ""), (207, "é one two", "", 1, ""),
             (208, "x " * 100_000, "", 1, ""), (209, " ".join(base + base), "", 1, "")]
    got = found(spark, rows)
    assert got == brute(rows, 3, 85)
    assert got[204] == (1, 203, False) and got[207][2] and got[200] == (0, 200, True)


def test_rows_without_or_with_the_same_id(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text, "", 1, ""), (5, text, "", 1, ""), (5, text, "", 1, ""), (None, "other", "", 1, ""), (None, None, "", 1, "")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out), key=str)
    assert got == sorted([(None, 46, 5, False), (5, 46, 5, True), (5, 46, 5, True), (None, 1, None, True),
                          (None, 0, None, True)], key=str)


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_pair_within_the_distance_shares_a_key():
    rng = random.Random(1)
    assert sum(allowed + 1 for _, _, allowed in neardup.CHUNKS) > neardup.MAX_DIFFERENT
    for _ in range(200):
        a = neardup.np.array([rng.randrange(1 << 16) for _ in range(64)], neardup.np.uint16)
        b = a.copy()
        b[rng.sample(range(64), neardup.MAX_DIFFERENT)] ^= 1
        x, y = neardup._keys(neardup.np.stack([a, b]))
        assert (x == y).any()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100), (None, 3), (50, 60), (60, 55), (70, 61), (70, 55), (50, 60)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 50 for i in (50, 55, 60, 61, 70)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
