"""Toxic spans and document scores from a linear-chain conditional random field.

Labels mark documents, so tokens are labelled first: a word, or a beginning of a word, that the toxic documents of a bounded
training sample use far more often than the clean ones marks its tokens in toxic documents. The field has two states; its
features are the word, its beginnings of three to six letters and its ending, and the states of neighbours (each line
is a chain). It is fitted by gradient steps on the exact likelihood. Forward-backward gives each token's probability of
being toxic; the expected number of toxic tokens, their share and the largest probability of a document give its score by a
logistic model fitted on documents that the field was not fitted on.

The sample is bounded by TRAIN_DOCS documents per label and TRAIN_CHARS characters per document (longer ones are not drawn);
it is drawn by a hash of doc_id. Every document is scored over its whole text.

Defined cases: null and empty texts have no tokens and get the score of no evidence; a null doc_id counts as held out;
labels that are null are not learnt from, several labels of a document count as toxic if one is; without labels of both
kinds every score is 0; repeated rows are scored alike; an empty table gives no rows; other columns are ignored.
"""

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from postmill.llm import crf
from postmill.llm.registry import Sent, query, table

TRAIN_DOCS = 1000
TRAIN_CHARS = 20_000
#: A smaller sample is not split in two.
SMALL_SAMPLE = 300
#: Training tokens: all lines with a labelled token, and clean lines up to as many tokens.
TRAIN_TOKENS = 150_000
#: A word or beginning marks tokens from this log ratio of document shares and this log-likelihood ratio (G) on.
LEAST_RATIO = 3.0
LEAST_G = 16.0
#: Beginnings of words as features, in letters, and the ending.
BEGINNINGS = (3, 4, 5, 6)
ENDING = 3
SPAN = 0.5
#: Weight of clean documents, which are the rule, against toxic ones in the document score.
CLEAN_WEIGHT = 8.0
#: Characters of texts that are tagged together and words that a task remembers: they bound its memory, not its results.
BLOCK_CHARS = 512 << 10
KEPT_WORDS = 100_000
WORD = re.compile(r"\w+")
SCORED = "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>"


def features(word):
    word = word.lower()
    return [("w", word), *((n, word[:n]) for n in BEGINNINGS if len(word) > n), ("e", word[-ENDING:])]


def labelled_features(docs):
    """Words and beginnings that mark toxic tokens, from [(set of features, toxic)]."""
    sizes, seen = [0, 0], ({}, {})
    for own, toxic in docs:
        sizes[toxic] += 1
        for f in own:
            seen[toxic][f] = seen[toxic].get(f, 0) + 1
    clean, toxic = sizes

    def marks(f, n):
        other = seen[0].get(f, 0)
        if f[0] not in ("w", 4, 5, 6) or math.log((n + 0.5) / (toxic + 1) * (clean + 1) / (other + 0.5)) < LEAST_RATIO:
            return False
        share = (n + other) / (toxic + clean)
        surprise = n * math.log(n / (toxic * share)) + (other * math.log(other / (clean * share)) if other else 0)
        return 2 * surprise >= LEAST_G

    return {f for f, n in seen[1].items() if marks(f, n)}


class Model:
    """Weights of the field and of the document score; `score` needs no labels."""

    def __init__(self, weights, bias, trans, document):
        self.weights, self.bias, self.trans, self.document = weights, bias, trans, document
        self.known = {}

    def unary(self, words):
        fresh = set(words).difference(self.known)
        if len(self.known) + len(fresh) > KEPT_WORDS:
            self.known, fresh = {}, set(words)
        get = self.weights.get
        for word in fresh:
            self.known[word] = self.bias + sum(get(f, 0.0) for f in features(word))
        return np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))

    def tag(self, texts):
        """Marginals of the tokens of each text."""
        words, lengths, sizes = [], [], []
        for text in texts:
            before = len(words)
            for line in (text or "").split("\n"):
                own = WORD.findall(line)
                if own:
                    words += own
                    lengths.append(len(own))
            sizes.append(len(words) - before)
        if not words:
            return [np.zeros(0) for _ in texts]
        return np.split(crf.Chains(lengths).marginals(self.unary(words), self.trans), np.cumsum(sizes)[:-1])

    def score(self, marginals):
        return float(1 / (1 + np.exp(-np.clip(_evidence(marginals) @ self.document, -30, 30))))


def _evidence(marginals):
    """What the document score looks at."""
    n, total = len(marginals), float(marginals.sum())
    return np.array([1.0, math.log1p(total), 10 * total / max(n, 20), float(marginals.max()) if n else 0.0])


def _logistic(rows, marks, ridge=1e-3, steps=40):
    """Newton steps, halved until the loss falls, for a logistic model in which clean rows weigh CLEAN_WEIGHT times toxic ones."""
    x, y, w = np.array(rows), np.array(marks, float), np.zeros(len(rows[0]))
    weight = np.where(y == 1, 1 / max(y.sum(), 1), CLEAN_WEIGHT / max(len(y) - y.sum(), 1)) / (1 + CLEAN_WEIGHT)

    def loss(w):
        z = x @ w
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * w @ w

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * w
        move = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        while loss(w + move) > loss(w) and np.abs(move).max() > 1e-9:
            move = move / 2
        w = w + move
    return w


def fit(docs):
    """A model from [(text, toxic)], or None without both labels. The last third of the documents fits the score, all of a small sample."""
    if len({toxic for _, toxic in docs}) < 2:
        return None
    words = [[WORD.findall(line) for line in text.split("\n")] for text, _ in docs]
    of = {w: features(w) for lines in words for line in lines for w in line}
    marked = labelled_features([({f for line in lines for w in line for f in of[w]}, toxic) for lines, (_, toxic) in zip(words, docs)])
    hit = {w: any(f in marked for f in own) for w, own in of.items()}
    chains, clean, held = [], [], 0
    for lines, (_, toxic) in list(zip(words, docs))[: len(docs) if len(docs) < SMALL_SAMPLE else 2 * len(docs) // 3]:
        for line in lines:
            if toxic and any(hit[w] for w in line):
                chains.append((line, [hit[w] for w in line]))
                held += len(line)
            elif line and not toxic:
                clean.append((line, [False] * len(line)))
    room = max(held, 20_000)
    for line, marks in clean:
        if held >= TRAIN_TOKENS or room <= 0:
            break
        chains.append((line, marks))
        held, room = held + len(line), room - len(line)
    weights, bias, trans = crf.fit([([of[w] for w in line], marks) for line, marks in chains], bias=-4.0)
    model = Model(weights, bias, trans, np.zeros(4))
    rest = docs if len(docs) < SMALL_SAMPLE else docs[2 * len(docs) // 3:]
    model.document = _logistic([_evidence(m) for m in model.tag([text for text, _ in rest])], [toxic for _, toxic in rest])
    model.known = {}
    return model


def _blocks(texts):
    """The texts of an Arrow column in lists of about BLOCK_CHARS."""
    block, held = [], 0
    for text in texts:
        block.append(text.as_py())
        held += len(block[-1] or "")
        if held > BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def held_out(doc_id):
    """Column: true for documents that are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(documents: DataFrame, labels: DataFrame, docs=TRAIN_DOCS, chars=TRAIN_CHARS):
    """[(text, toxic)] in the order of a hash of doc_id; at most 2 * docs rows of `chars` characters reach the driver."""
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    order = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    drawn = [marks.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(docs) for k in (0, 1)]
    ids = F.broadcast(drawn[0].union(drawn[1]))  # 2 * docs rows at most
    # Another hash than the one that drew them, so that every stretch of the sample has both labels in proportion.
    place = F.xxhash64(F.col("doc_id"), F.lit("place"))
    # Of rows that repeat a doc_id the text with the smallest hash, whatever the order of the table.
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= chars).join(
        ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    rows = texts.select(place.alias("at"), "text", "toxic").collect()
    return [(r.text, int(r.toxic)) for r in sorted(rows, key=lambda r: (r.at, r.text))]


def score(df: DataFrame, model) -> DataFrame:
    """doc_id, score and spans (character offsets of runs of toxic tokens, with their largest probability)."""
    sent = Sent(df.sparkSession, model)  # bounded by the training sample

    def spans_of(text, marginals):
        out, at = [], 0
        for line in re.finditer(r"[^\n]+", text):
            run = None
            for word in WORD.finditer(line[0]):
                p = marginals[at]
                at += 1
                if p < SPAN:
                    run = None
                elif run:
                    run["end"], run["p"] = line.start() + word.end(), max(run["p"], float(p))
                else:
                    run = {"start": line.start() + word.start(), "end": line.start() + word.end(), "p": float(p)}
                    out.append(run)
        return out

    def score_part(batches):
        model = sent.get()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            scores, spans = [], []
            for block in _blocks(batch.column("text")):
                tagged = model.tag(block) if model else [np.zeros(0) for _ in block]
                for text, m in zip(block, tagged):
                    scores.append(model.score(m) if model else 0.0)
                    spans.append(spans_of(text, m) if len(m) and m.max() >= SPAN else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score_part, SCORED)


def without_toxic(df: DataFrame, model, least=0.5) -> DataFrame:
    """The rows of df whose text scores under `least`, with all their columns."""
    sent = Sent(df.sparkSession, model)

    @F.arrow_udf(DoubleType())
    def scores(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.get()
        for texts in parts:
            out = []
            for block in _blocks(texts):
                out += [model.score(m) for m in model.tag(block)] if model else [0.0] * len(block)
            yield pa.array(out, pa.float64())

    # Texts alone go to Python; the other columns wait in the JVM.
    return df.where(scores("text") < least)


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and spans per document."""
    scored = score(documents, fit(training_sample(documents, labels)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


@query("op1_toxicity")
def op1(spark, sf_dir):
    """Scores all documents with a model fitted on a sample of their labels."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
