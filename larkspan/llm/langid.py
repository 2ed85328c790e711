"""Language identification by sparse multinomial logistic regression.

Features are the TF-IDF weights of hashed character 1- to 4-grams within words, scaled to
length one. Follow-the-regularised-leader with an elastic-net penalty trains the weights,
most of which stay zero; then one temperature, fitted on texts kept out of the training,
calibrates the probabilities.

Document frequencies come from all training texts; the weights from a bounded number of
texts for each language.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is
every text if nothing could be learned; rows with a null id, text or language are not
learned from; repeated rows each count; an empty table gives no row. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import bounded_ids
from larkspan.llm.ngrams import LETTERS, text_ngrams

LOW, HIGH, BITS = 1, 4, 13
SIZE = 1 << BITS
UNKNOWN = "und"
ALL = -1  # the bucket under which texts are counted


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # SIZE x languages
    bias: np.ndarray
    temperature: float


def _counts(texts: list) -> Iterator[np.ndarray]:
    """How often each bucket occurs in each text."""
    total, last = np.zeros(SIZE, np.int64), 0
    for i, buckets in text_ngrams(texts, LOW, HIGH, BITS, distinct=False):
        if i != last:
            yield total
            total, last = np.zeros(SIZE, np.int64), i
        total += np.bincount(buckets, minlength=SIZE)
    if len(texts):
        yield total


def document_frequencies(texts: DataFrame) -> DataFrame:
    """``bucket, n``: in how many texts; each task adds up its own. Bucket -1 has all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for counts in _counts(batch.column(0).to_pylist()):
                found += counts > 0
                seen += 1
        buckets = np.append(np.flatnonzero(found), ALL).astype(np.int32)
        values = np.append(found[found > 0], seen)
        yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(values)], ["bucket", "n"])

    parts = texts.select("text").mapInArrow(count, "bucket int, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def _weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vector = np.log1p(counts) * idf
    norm = np.sqrt(vector @ vector)
    return vector / norm if norm else vector


def _vectors(text: Column, idf: np.ndarray) -> Column:
    """The non-zero buckets and their weights."""

    @F.arrow_udf("struct<at:array<int>,value:array<float>>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            at, value = [], []
            for counts in _counts(texts.to_pylist()):
                at.append(np.flatnonzero(counts).astype(np.int32))
                value.append(_weighed(counts, idf)[at[-1]].astype(np.float32))
            yield pa.StructArray.from_arrays(
                [pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))],
                ["at", "value"],
            )

    return vectors(text)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader (McMahan et al. 2013) for the softmax loss.

    ``l1`` and ``l2`` are the elastic-net penalties; a weight whose sum of gradients
    stays within ``l1`` is zero. The last row is the intercept.
    """

    def __init__(self, size: int, classes: int, alpha=0.5, beta=1.0, l1=0.1, l2=0.1):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        pull = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / pull)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = _softmax(value @ w)
        p[label] -= 1
        g = value[:, None] * p
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section.

    The targets are smoothed by one text for each class (as in Platt scaling), so that
    texts without an error do not ask for certainty.
    """
    n, classes = logits.shape
    target = np.full((n, classes), 1 / (n + classes))
    target[np.arange(n), labels] = (n + 1) / (n + classes)

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))
        return -(target * np.log(np.maximum(p, 1e-12))).sum(axis=1).mean()

    low, high, ratio = np.log(0.02), np.log(20), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _train(examples: list, classes: int, epochs: int = 3) -> tuple[np.ndarray, float]:
    """Weights and temperature from (id hash, label, at, value) of the sample."""
    examples = sorted(examples, key=lambda x: x[0])
    held = examples[::5] if len(examples) >= 20 else []
    fitted = [x for i, x in enumerate(examples) if i % 5] if held else examples
    model = Ftrl(SIZE + 1, classes)
    for _ in range(epochs):
        for _, label, at, value in fitted:
            model.learn(np.append(at, SIZE), np.append(value, 1.0), label)
    w = model.weights()
    if not held:
        return w, 1.0
    logits = np.array([value @ w[at] + w[SIZE] for _, _, at, value in held])
    return w, temperature(logits, np.array([x[1] for x in held]))


def fit(train: DataFrame, per_lang: int = 1000) -> Model:
    """A model from ``train`` (``doc_id, text, lang``), from no other column.

    At most ``per_lang`` texts of each language, chosen by hashed id, train the weights
    in one task. The list of languages (as many as ``lang`` has
    values: it should be clean), the document frequencies (a fixed number) and the
    weights come to the driver.
    """
    known = train.select("doc_id", "text", "lang").dropna()
    ids = known.select("doc_id", "lang")
    langs = sorted(r.lang for r in ids.select("lang").distinct().collect())
    empty = np.zeros((SIZE, 0))
    if not langs:
        return Model([], np.zeros(SIZE), empty, np.zeros(0), 1.0)
    frequency = np.zeros(SIZE)
    texts = 0
    for r in document_frequencies(known).collect():
        if r.bucket == ALL:
            texts = r.n
        else:
            frequency[r.bucket] = r.n
    idf = np.where(frequency > 0, np.log((1 + texts) / (1 + frequency)) + 1, 0.0)
    chosen = bounded_ids(ids.distinct(), "lang", per_lang)
    sample = known.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {lang: i for i, lang in enumerate(langs)}
        examples = []
        for batch in batches:
            for key, lang, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if x["at"]:
                    at, value = np.array(x["at"]), np.array(x["value"], np.float32)
                    examples.append((key, number[lang], at, value))
        w, t = _train(examples, len(langs))
        yield pa.RecordBatch.from_pydict({"w": [w.ravel().tolist()], "t": [t]})

    fitted = (
        sample.select(F.xxhash64("doc_id").alias("key"), "lang", _vectors(F.col("text"), idf).alias("x"))
        .repartition(1)
        .mapInArrow(learn, "w array<double>, t double")
        .first()
    )
    w = np.array(fitted.w).reshape(SIZE + 1, len(langs))
    return Model(langs, idf, w[:SIZE], w[SIZE], fitted.t)


def predict(text: Column, model: Model) -> Column:
    """``struct<lang, score>`` of each text: the likeliest language, its probability."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            texts = texts.to_pylist()
            found, scores = [], []
            for text, counts in zip(texts, _counts(texts), strict=True):
                if not model.langs or not text or not LETTERS.search(text):
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                logits = _weighed(counts, model.idf) @ model.weights + model.bias
                p = _softmax(logits / model.temperature)
                found.append(model.langs[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.StructArray.from_arrays(
                [pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"]
            )

    return predicted(text)
