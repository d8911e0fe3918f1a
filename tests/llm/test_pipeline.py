import hashlib
from pathlib import Path

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from postmill.llm import bpe, decon, toxic
from test_linedup import brute as brute_lines
from test_neardup import brute as brute_groups

SF = "/root/testdata/sf0.001"


def staged(spark, sf_dir, docs):
    """Rows after each stage."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        out.append(docs.collect())
        assert name == "bpe" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return out


def test_equals_brute_force_stage_by_stage(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    clean, lines, groups, tests, tokens = staged(spark, SF, docs)
    rejected = {r.doc_id for r in toxic.toxicity(docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in clean} == {r.doc_id for r in docs.collect()} - rejected

    kept = {(d, n) for d, n, *_, own in brute_lines([(r.doc_id, r.text) for r in clean]) if own}
    want = {}
    for r in clean:
        left = [x for n, x in enumerate(r.text.split("\n")) if not x.split() or (r.doc_id, n) in kept]
        if any(x.split() for x in left) or not r.text.split():
            want[r.doc_id] = "\n".join(left)
    assert {r.doc_id: r.text for r in lines} == want
    assert all(r.n_chars == len(r.text) for r in lines)

    alone = {i for i, (_, _, own) in brute_groups([(r.doc_id, r.text) for r in lines], 5, 80).items() if own}
    assert {r.doc_id for r in groups} == alone

    items = decon.Items([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert {r.doc_id for r in tests} == {r.doc_id for r in groups if not decon.matches(items, [decon.plain(r.text)])}

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.RANKS)))
    by = {r.doc_id: r for r in tests}
    assert {r.doc_id for r in tokens} == set(by)
    for r in tokens:
        assert r.ids == library.encode_ordinary(by[r.doc_id].text)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(by[r.doc_id].text.encode()).hexdigest()


def test_odd_rows_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a text without an id", "en", "s", 20), (3, "x", "en", "s", 1),
            (3, "x", "en", "s", 1), (4, "word " * 30_000, "en", "s", 150_000)]
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = staged(spark, str(tmp_path), spark.createDataFrame(rows, schema))
    assert [sorted(str(r.doc_id) for r in stage) for stage in out] == [["1", "2", "3", "3", "4", "None"]] * 5
    assert [len(stage) for stage in staged(spark, str(tmp_path), spark.createDataFrame([], schema))] == [0] * 5


def test_stages_are_declared():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None and Path(corpus_pipeline.__file__).name == "corpus_pipeline.py"
