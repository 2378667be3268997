"""Toxicity by multiple-instance learning: labels of documents train a model of sentences.

A document is toxic if any of its sentences is: 1 - product(1 - p(sentence)), the noisy-or. The likelihood of the
document labels is maximised over the weights of sentence features, and the trained sentence scores then
show where the offence is.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarium.llm.common import column, fold, free_names
from scholarium.llm.sampling import bounded

SENTENCE = re.compile(r"[.!?\n]+")
WORD = re.compile(r"\w+")
#: Word beginnings that are features of their own, in characters.
PREFIXES = (4, 5, 6)
#: Labelled documents that the model is fitted on, at most.
SAMPLE_DOCS = 16_000
#: Features that are kept, those with the strongest association; a bound of the model's size.
MAX_FEATURES = 20_000
MIN_DOCS = 2
#: Words whose weight a worker remembers.
CACHE_WORDS = 200_000


def features(word: str) -> list[str]:
    return [f"={word}", *[f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n]]


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence; sentences without words are left out."""
    found = (WORD.findall(s) for s in SENTENCE.split((text or "").lower()))
    return [s for s in found if s]


def _vocabulary(rows: DataFrame) -> list[str]:
    """Features by how much more often they occur in documents of one label, from counts that every task pre-adds."""

    def count(batches):
        n: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                n[y].update({f for w in set(WORD.findall((text or "").lower())) for f in features(w)})
        keys = list(n[0].keys() | n[1].keys())
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array([n[0][f] for f in part], pa.int64()), pa.array([n[1][f] for f in part], pa.int64())],
                names=["feature", "clean", "toxic"],
            )

    totals = rows.groupBy("y").count().collect()
    docs = {r["y"]: r["count"] for r in totals}
    n0, n1 = docs.get(0, 0), docs.get(1, 0)
    if not n0 or not n1:
        return []
    counted = rows.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature")
    counted = counted.agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b")).where(F.col("a") + F.col("b") >= MIN_DOCS)
    # Log-likelihood ratio of presence against the share expected from both labels together.
    share = (F.col("a") + F.col("b")) / (n0 + n1)
    gain = F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (n1 * share))).otherwise(0.0) + F.when(
        F.col("a") > 0, F.col("a") * F.log(F.col("a") / (n0 * share))
    ).otherwise(0.0)
    best = counted.orderBy(gain.desc(), "feature").limit(MAX_FEATURES)
    return [r.feature for r in best.select("feature").collect()]


def packed_sentences(sents: list[list[int]]) -> bytes:
    """Features of sentences that have some, as big-endian numbers, 0 behind each sentence: bytes sort as the lists do."""
    return np.array([x for s in sents for x in (*(f + 1 for f in s), 0)], ">u4").tobytes()


def _fit(docs: list[tuple[int, int, bytes]], n_features: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, sentences without features, packed features of the other sentences), by Adam steps.

    Numbers stay in arrays: as Python objects those of the sample would fill several hundred MB of a worker.
    """
    docs.sort()
    y = np.array([d[0] for d in docs], float)
    plain = np.array([d[1] for d in docs], float)
    codes = np.frombuffer(b"".join([d[2] for d in docs]), ">u4")
    ends = codes == 0
    sizes = np.array([len(d[2]) // 4 for d in docs])
    docs.clear()
    s_doc = np.repeat(np.arange(len(sizes)), sizes)[ends]
    f_sent = np.cumsum(ends)[~ends]
    f_id = codes[~ends].astype(np.int64) - 1
    del codes, ends
    # Both labels weigh the same, so that 0.5 is a fair threshold where one of them is rare.
    share = y.mean()
    cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    theta = np.zeros(n_features + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step_no in range(1, rounds + 1):
        w, b = theta[:-1], theta[-1]
        z = b + np.bincount(f_sent, w[f_id], len(s_doc))
        p, p0 = 1 / (1 + np.exp(-np.clip(z, -40, 40))), 1 / (1 + np.exp(-b))
        soft, soft0 = np.logaddexp(0, z), np.logaddexp(0, b)
        total = np.bincount(s_doc, soft, len(y)) + plain * soft0
        by_total = np.where(y == 1, -1 / np.expm1(np.clip(total, 1e-9, 40)), 1.0) * cost / len(y)
        g_z = by_total[s_doc] * p
        grad = np.append(np.bincount(f_id, g_z[f_sent], n_features) + 2e-5 * w, g_z.sum() + (by_total * plain).sum() * p0)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        theta -= 0.15 * (m / (1 - 0.9**step_no)) / (np.sqrt(v / (1 - 0.99**step_no)) + 1e-9)
    return theta[:-1], float(theta[-1])


class Model:
    """Sentence scores from word weights; words that were seen recently are remembered."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def word(self, w: str) -> float:
        x = self.known[w] = sum(self.weights.get(f, 0.0) for f in features(w))
        return x

    def sentence_scores(self, text: str | None) -> np.ndarray:
        """Probability of each sentence with words."""
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        z = [sum([known[w] if w in known else self.word(w) for w in set(s)]) for s in sentences(text)]
        return 1 / (1 + np.exp(-np.clip(np.array(z, float) + self.bias, -40, 40)))

    def score(self, text: str | None) -> float:
        p = self.sentence_scores(text)
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on at most about ``limit`` labelled documents whose crc32(id as text) mod 5 is not 0.

    Rows without id or label take no part; an id that is labelled more than once counts as toxic if any row says so.
    Without both labels the model scores everything 0.
    """
    marks = labels.select(column(labels, key).alias("id"), column(labels, label).cast("int").alias("y"))
    marks = marks.where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y")).where(fold("id", 5) != 0)
    # The sample is bounded, so it may be broadcast.
    marks = bounded(marks, limit, "id").select("id", F.when(F.col("y") > 0, 1).otherwise(0).alias("y"))
    rows = docs.select(column(docs, key).alias("id"), column(docs, text).alias("text")).join(F.broadcast(marks), "id").select("text", "y")
    vocabulary = _vocabulary(rows)
    if not vocabulary:
        return Model({}, -40.0)
    number = rows.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(vocabulary)})

    def encode(batches):
        ids = number.value
        for batch in batches:
            plain, kept = [], []
            for text_ in batch.column("text").to_pylist():
                sents = [sorted({ids[f] for w in s for f in features(w) if f in ids}) for s in sentences(text_)]
                some = [s for s in sents if s]
                kept.append(packed_sentences(some))
                plain.append(len(sents) - len(some))
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.array(plain, pa.int32()), pa.array(kept, pa.binary())],
                names=["y", "plain", "sents"],
            )

    encoded = rows.mapInArrow(encode, "y int, plain int, sents binary")
    n = len(vocabulary)

    def fit(group: pa.Table) -> pa.Table:
        docs_ = list(zip(group.column("y").to_pylist(), group.column("plain").to_pylist(), group.column("sents").to_pylist(), strict=True))
        w, b = _fit(docs_, n)
        return pa.table({"w": pa.array([w.tolist()], pa.list_(pa.float64())), "b": pa.array([b])})

    # One task fits the bounded sample; it reads numbers of features, not texts.
    one = encoded.withColumn("one", F.lit(0)).groupBy("one")
    fitted = one.applyInArrow(fit, "w array<double>, b double").first()
    weights = {f: w for f, w in zip(vocabulary, fitted.w, strict=True) if abs(w) > 1e-4}
    return Model(weights, fitted.b)


def score_udf(spark, model: Model):
    shared = spark.sparkContext.broadcast((model.weights, model.bias))
    own: list[Model] = []

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not own:
            own.append(Model(*shared.value))
        return pa.array([own[0].score(t) for t in texts.to_pylist()], pa.float64())

    return score


def toxic_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row; null and empty texts score 0."""
    score = score_udf(docs.sparkSession, train(docs, labels, key=key, text=text))
    rows = docs.select(column(docs, key).alias(key), (fold(key, 5) == 0).alias("held_out"), score(column(docs, text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose score is below 0.5, with their columns unchanged."""
    (name,) = free_names(docs, "score")
    score = score_udf(docs.sparkSession, train(docs, labels, key=key, text=text))
    return docs.withColumn(name, score(column(docs, text))).where(F.col(name) < 0.5).select(*docs.columns)


def offending_sentences(docs: DataFrame, model: Model, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence, score) of the sentences that alone reach ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    rows = docs.select(column(docs, key).alias(key), column(docs, text).alias("text"))
    schema = T.StructType([rows.schema[0], T.StructField("sentence", T.StringType()), T.StructField("score", T.DoubleType())])

    def find(batches):
        own = Model(*shared.value)
        for batch in batches:
            at, what, scores = [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                for s in SENTENCE.split(t or ""):
                    p = own.score(s)
                    if p >= threshold:
                        at.append(i)
                        what.append(s.strip())
                        scores.append(p)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(what, pa.string()), pa.array(scores, pa.float64())],
                names=schema.names,
            )

    return rows.mapInArrow(find, schema)
