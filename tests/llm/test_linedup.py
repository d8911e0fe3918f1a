import random

from postmill.llm import linedup

SCHEMA = "doc_id long, text string, n_chars long, item long, keys string, first string"


def brute(rows, percent=80):
    lines, sets, parent = [], {}, {}
    for doc, text, *_ in rows:
        for number, line in enumerate((text or "").encode().split(b"\n")):
            if line := linedup.normal(line):
                lines.append((doc, number, line))
                padded = line.ljust(8, b"\0")
                sets[line] = {padded[i:i + 8] for i in range(len(padded) - 7)}
                parent[line] = line

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = list(sets)
    for i, a in enumerate(items):
        for b in items[:i]:
            if min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])):
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    parent[root(a)] = root(b)
    first = {}
    for doc, number, line in lines:
        key, at = root(line), (doc is not None, doc, number)
        first[key] = min(first.get(key, at), at)
    return sorted(((d, n, first[root(x)][1], first[root(x)][2], (d, n) == first[root(x)][1:]) for d, n, x in lines), key=str)


def found(spark, rows):
    out = linedup.duplicate_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted((tuple(r) for r in out), key=str)


def test_equals_brute_force_on_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(r.doc_id, r.text, 0, 0, "", "") for r in documents]
    assert found(spark, rows) == brute(rows)


def test_fuzzy_lines_and_odd_rows(spark):
    rng = random.Random(2)
    base = "this work may be copied only with the written permission of every one of its authors and their heirs"
    rows = []
    for i in range(120):
        words = base.split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(["a", "copied", "xy", "their"])
        rows.append((i, f"Own line number {i * i}\n" + "  ".join(words) + "\n\nAnd so on.", 0, 0, None, None))
    rows += [(200, None, None, None, None, None), (201, "", 0, 0, "", ""), (202, " \n\t\n", 0, 0, "", ""), (203, "é", 0, 0, "", ""),
             (204, "É\né\nx", 0, 0, "", ""), (205, "word " * 50_000, 0, 0, "", ""), (None, "AND  so on. ", 0, 0, "", "")]
    assert found(spark, rows) == brute(rows)


def share_a_band(pairs):
    """How many of the pairs of lines share a band."""
    number, keys = linedup.band_keys([line for pair in pairs for line in pair])
    own = [set() for _ in range(2 * len(pairs))]
    for i, key in zip(number.tolist(), keys.tolist()):
        own[i].add(key)
    return sum(bool(a & b) for a, b in zip(own[::2], own[1::2]))


def test_short_lines_that_differ_at_their_ends(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    lines = [" ".join(word() for _ in range(rng.randrange(3, 5))) for _ in range(400)]
    rows = [(i, line, 0, 0, "", "") for i, line in enumerate(lines)]
    rows += [(1000 + i, line + "." if i % 2 else "a" + line, 0, 0, "", "") for i, line in enumerate(lines)]
    assert found(spark, rows) == brute(rows)


def test_alike_lines_of_every_length_share_a_band():
    rng = random.Random(6)
    pairs = []
    for size in [5, 9, 15, 20, 40, 80, 92, 99, 100, 105, 124, 125, 126, 200]:
        # size shingles are in common and an eighth more is cut from both sides, so the similarity is 0.8 or just above.
        for _ in range(400):
            line = bytes(rng.randrange(97, 123) for _ in range(size + 7 + 2 * (size // 8)))
            pairs.append((line[size // 8:], line[:len(line) - size // 8]))
        line = bytes(rng.randrange(97, 123) for _ in range(size + 7 + size // 4))
        pairs.append((line, line[:size + 7]))
    repeated = [(b"abcdefghij" * 30 + bytes([97 + i % 26, 98 + i // 26]) + b"x", b"abcdefghij" * 30 + bytes([97 + i % 26, 98 + i // 26]))
                for i in range(300)]
    assert share_a_band(pairs) >= len(pairs) - 8  # 0.0002 of 5600 pairs is about one
    assert share_a_band(repeated) >= len(repeated) - 2


def test_documents_without_their_duplicate_lines(spark):
    rows = [(1, "A first line of some length\n\nand another one", 5, 1, "k", "f"), (2, "a FIRST line of some length\nthe end", 5, 1, "k", "f"),
            (3, "and another one\n\n", 5, 1, "k", "f"), (4, None, None, None, None, None), (5, "", 0, 1, "k", "f"), (6, "kept", 5, 1, "k", "f")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = linedup.without_duplicates(df, n_chars=linedup.F.length)
    assert out.columns == df.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: (rows[0][1], 5), 2: ("the end", 7), 4: (None, None), 5: ("", 0), 6: ("kept", 5)}


def test_rows_of_one_id_are_judged_by_themselves(spark):
    line = "a line that every one of these documents has"
    texts = {None: [f"{line}\nfirst own text\nthis is only here", f"another own text\n{line}\nand that is only there", line,
                    "nothing in common\nwith any other row"],
             7: [f"own beginning\n{line}", "quite another text\nof the same id", line], 8: [f"{line}\nthe tail"] * 2}
    rows = [(doc, text, 0, 0, "", "") for doc, own in texts.items() for text in own]
    got = [(r.doc_id, r.text) for r in linedup.without_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    for doc, own in texts.items():
        for text in own:
            left = "\n".join(x for x in text.split("\n") if x != line)
            assert not left or (doc, left) in got or (doc is None and (doc, text) in got), (doc, text, got)
    # The line itself stays once, in a row without an id, which come first.
    assert [doc for doc, text in got if line in text.split("\n")] == [None]
    assert sorted(str(doc) for doc, _ in got) in (["7"] * 2 + ["8"] * 2 + ["None"] * n for n in (3, 4))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert linedup.duplicate_lines(empty).count() == 0 and linedup.without_duplicates(empty).count() == 0
