import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from postmill.llm import urltree


def judged(spark, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, good long")
    return {r.page_id: r for r in urltree.judge(pages, **options).collect()}


def test_host_path_and_rules(spark):
    urls = {1: ("http://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
            2: ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
            3: ("http://blog.example.com/en/1", "blog.example.com", "/en/1", "example.com/en/", "block"),
            4: ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
            5: ("x://net/es/1", "net", "/es/1", "net/es/", "block"),
            6: ("x://a.net/fr/", "a.net", "/fr/", "net/fr/", "block"),
            7: ("x://a.net/fr", "a.net", "/fr", None, "allow"),
            8: ("x://a.com?x", "a.com", "", None, "allow"),
            9: (None, "", "", None, "allow"), 10: ("", "", "", None, "allow"), 11: ("a.com/x", "", "", None, "allow"),
            12: ("a://É.COM/é#://b", "É.com", "/é", "com/", "allow")}
    got = judged(spark, [(k, v[0], None) for k, v in urls.items()])
    assert {k: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()} == {k: v[1:] for k, v in urls.items()}


def test_templates_generalise_and_bad_ones_are_rejected(spark):
    rows = [(i, f"http://h.org/{'good' if i % 2 else 'bad'}/{i}.html", i % 2) for i in range(200)]
    rows += [(1000 + i, f"http://h.org/tag/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}/view", 1) for i in range(100)]
    got = judged(spark, rows)
    assert got[2].template == "/bad/*" and got[3].template == "/good/*"
    assert {r.template for k, r in got.items() if k >= 1000} == {"/tag/*/view"}
    assert {r.verdict for k, r in got.items() if k < 1000 and k % 2} == {"allow"}
    assert {r.verdict for k, r in got.items() if k < 1000 and not k % 2} == {"block"}


def test_two_variable_levels_and_repeated_pages(spark):
    rows = [(100 * i + j, f"http://h.org/u/{chr(97 + i)}name/{chr(97 + j)}{chr(97 + i)}post", 1) for i in range(10) for j in range(3)]
    rows += [(5000 + i, f"http://h.org/x/{chr(97 + i)}word", 1) for i in range(10)]
    rows += [(6000 + i, f"http://h.org/fixed/{'ab'[i % 2]}/{i}", 1) for i in range(40)]
    want = {"/u/*/*", "/x/*", "/fixed/a/*", "/fixed/b/*"}
    for times in (1, 4):
        assert {r.template for r in judged(spark, rows * times).values()} == want
    again = judged(spark, [(k, f"http://{h}.net/p/q{k % 9}", 1) for k in range(9) for h in "ab"])
    assert {r.template for r in again.values()} == {"/p/*"}


def test_levels_equal_a_walk_of_the_tree(spark):
    rng = random.Random(4)
    paths = sorted({"/" + "/".join(rng.choice(["a", "b", "c", f"w{rng.randint(0, 30)}x", str(rng.randint(0, 9)), ""])
                                   for _ in range(rng.randint(0, 5))) for _ in range(400)})
    shapes = {p: [w if not re.fullmatch(r"\d+", w) else "*" for w in p.split("/")] for p in paths}
    known = {p: () for p in paths}
    for at in range(max(map(len, shapes.values()))):
        groups = defaultdict(list)
        for p in paths:
            if len(shapes[p]) > at and shapes[p][at] not in ("", "*"):
                groups[known[p]].append(shapes[p][at])
        varied = {t for t, words in groups.items() if len(set(words)) >= 8 and len(words) < 4 * len(set(words))}
        known = {p: (*t, "*" if t in varied and shapes[p][at] else shapes[p][at]) if len(shapes[p]) > at else t
                 for p, t in known.items()}
    df = spark.createDataFrame([("h", p) for p in paths], "host string, path string")
    got = {r.path: (r.template, r.parent) for r in urltree.templates(df).collect()}
    assert {p: t for p, (t, _) in got.items()} == {p: "/".join(t) for p, t in known.items()}
    for p, (_, parent) in got.items():
        literal = [i for i, w in enumerate(known[p]) if w not in ("", "*")]
        assert parent == "/".join("+" if literal and i == literal[-1] else w for i, w in enumerate(known[p]))


def test_similar_branches_share_their_counts(spark):
    # One bad label in a small branch among good ones says nothing on its own.
    rows = [(i, f"http://h.org/{'abc'[i % 3]}/{i}", 0 if i == 1 else 1) for i in range(9)]
    assert {r.verdict for r in judged(spark, rows, strength=1.0).values()} == {"allow"}


def test_empty_repeated_and_long(spark):
    assert judged(spark, []) == {}
    long = "http://h.org/" + "a/" * 20_000
    pages = spark.createDataFrame([(1, "u://h.org/a", None), (1, "u://h.org/a", None), (None, None, None), (2, long, 0)],
                                  "page_id long, url string, good long")
    assert sorted((r.page_id or 0, len(r.path)) for r in urltree.judge(pages).collect()) == [
        (0, 0), (1, 2), (1, 2), (2, 40_001)]


def test_labels_come_from_the_named_document(spark):
    pages = spark.createDataFrame([(1, "http://h/en/7.html?x", 3, "h"), (2, "http://h/en/8/", 3, "h"), (3, "http://h/en", 3, None),
                                   (4, None, 1, "")], "page_id long, url string, good int, host string")
    labels = spark.createDataFrame([(7, 1), (7, None), (8, 0), (None, 1)], "doc_id long, quality int")
    got = {r.page_id: r.good for r in urltree.labelled_pages(pages, labels).collect()}
    assert got == {1: 1, 2: 0, 3: None, 4: None}


def test_native_only(spark):
    plan = urltree.judge(spark.createDataFrame([(1, "u://h/a", 1)], "page_id long, url string, good long"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text and "Cartesian" not in text


def test_odd_urls(spark):
    host, path = urltree.host_and_path(F.col("url"))
    urls = ["http://", "://", "://?", "http:///x", "http://h//x//1"]
    for row in spark.createDataFrame([(u,) for u in urls], "url string").select("url", host.alias("h"), path.alias("p")).collect():
        rest = row.url.partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        assert (row.h, row.p) == (rest[:cut], rest[cut:].split("?")[0].split("#")[0])
