"""A corpus from documents to token ids: toxic documents out, alike lines once, one document of each group of near copies,
no benchmark passages, and byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. `run`
writes each stage's result to the shared folder and reads it again for the next one.

Defined cases: null texts stay null until they are encoded as empty; rows without a doc_id pass the stages that judge by id;
repeated rows are judged alike; a document that loses all its lines to earlier ones goes; an empty table gives no rows.
"""

import public_tokenizers
from pyspark.sql import functions as F

from postmill.llm import bpe, decon, linedup, neardup, toxic
from postmill.llm.registry import table
from postmill.session import written

#: Rows of documents that go to Python at once.
BATCH_ROWS = 1000


def small_batches(spark):
    """Fewer whole texts at a time on their way to Python: a batch stands several times in an executor's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def drop_toxic(spark, docs, sf_dir):
    """Documents whose score of a model fitted on the labelled ones among them is under 0.5."""
    small_batches(spark)
    return toxic.without_toxic(docs, toxic.fit(toxic.training_sample(docs, table(spark, sf_dir, "labels"))))


def dedupe_lines(spark, docs, sf_dir):
    """Documents without lines that are like an earlier line; n_chars is that of the new text."""
    small_batches(spark)
    return linedup.without_duplicates(docs, n_chars=F.length)


def dedupe_documents(spark, docs, sf_dir):
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more."""
    return neardup.without_copies(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents that hold no item of the benchmark."""
    return decon.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark, docs, sf_dir):
    """doc_id, lang, source, n_tokens, the ids, their digest and the digest of the decoded bytes."""
    path = public_tokenizers.path(bpe.RANKS)
    tokens = bpe.encode(docs, path, keep=["doc_id", "lang", "source"])
    out = tokens.select("*", bpe.ids_sha256("ids").alias("ids_sha256"), bpe.decoded(F.col("ids"), spark, path).alias("decoded"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedupe_lines), ("near_dedup", dedupe_documents),
          ("decontamination", decontaminate), ("bpe", tokenize)]

#: No SQL expresses a fitted field or merges in rank order; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
