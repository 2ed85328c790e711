"""Toxicity by a linear classifier on character n-grams, scaled by naive Bayes ratios.

Features are the hashed 4- to 9-grams within a text's words, each present or not. Their
naive Bayes log-count ratios r come from all labelled texts. A logistic regression on the
features scaled by r is then fitted on a bounded sample. It takes the n-grams that tell the
labels apart significantly (chi-squared): at a level at which ``by_chance`` of all n-grams
would do so if none had to do with the labels, for as many texts as the regression sees. So
their number follows the data, and does not grow without end with the count of texts. The
penalty is chosen from ``PENALTIES`` by how a third of the sample is predicted from the rest.

Defined cases: a null or empty text has no feature and scores by the intercept; a null
label or id is not learned from; of several labels for an id the highest counts;
repeated documents each count; without labels, or with one label only, the score is the
share of label 1 (0 without labels), and so is it where no n-gram is significant; an empty
table gives no row. Other columns are ignored by the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import bounded_ids, portions, possibly_among, stored
from larkspan.llm.ngrams import text_ngrams

LOW, HIGH, BITS = 4, 9, 18
PENALTIES = (0.3, 1.0, 3.0)
STEPS, MEMORY, TOGETHER = 100, 8, 1 << 20
ALL = -1  # the bucket under which texts are counted


@dataclass
class Model:
    """The logistic score is ``bias`` plus the ``weights`` of the buckets that a text has."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def _sets(texts: list, keep: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The distinct buckets of each text, in order."""
    parts: list[np.ndarray] = []
    last = 0
    marks = np.zeros(1 << BITS, bool)

    def distinct() -> np.ndarray:
        buckets = np.concatenate(parts)
        if len(buckets) < 500:
            return np.unique(buckets)
        marks[buckets] = True
        found = np.flatnonzero(marks).astype(np.int32)
        marks[found] = False
        return found

    for i, buckets in text_ngrams(texts, LOW, HIGH, BITS, distinct=True, keep=keep):
        if i != last:
            yield distinct()
            parts, last = [], i
        parts.append(buckets)
    if parts:
        yield distinct()


def ngram_counts(labelled: DataFrame) -> DataFrame:
    """``bucket, pos, neg``: in how many texts of label 1 and 0; bucket -1 has all texts.

    Every task adds up its own counts, so it sends a row for each bucket at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        texts = np.zeros(2, np.int64)
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for label, buckets in zip(labels, _sets(batch.column(0).to_pylist()), strict=True):
                counts[label, buckets] += 1
                texts[label] += 1
        found = np.flatnonzero(counts.sum(axis=0)).astype(np.int32)
        for rows, values in ((found, counts[:, found]), (np.array([ALL], np.int32), texts[:, None])):
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(values[1]), pa.array(values[0])], ["bucket", "pos", "neg"]
            )

    parts = labelled.select("text", F.col("label").cast("int")).mapInArrow(
        count, "bucket int, pos bigint, neg bigint"
    )
    return parts.groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def significance_limit(by_chance: float, features: int) -> float:
    """The chi-squared value that ``by_chance`` of so many unrelated features exceed."""
    return NormalDist().inv_cdf(1 - min(1.0, by_chance / max(1, features)) / 2) ** 2


def select_features(
    counts: DataFrame, pos: int, neg: int, per_label: int, by_chance: float
) -> DataFrame:
    """``bucket`` and ``ratio`` r = log(p/|p|) - log(q/|q|) of the significant ones."""
    a, b = F.col("pos"), F.col("neg")
    n, seen = float(pos + neg), a + b
    share = min(1.0, (min(pos, per_label) + min(neg, per_label)) / n)
    chi = share * n * F.pow(a * neg - b * pos, 2.0) / (seen * (n - seen) * float(pos) * float(neg))
    found = counts.filter(F.col("bucket") != ALL)
    p, q, features = found.agg(F.sum(a + 1), F.sum(b + 1), F.count("*")).first()
    limit = significance_limit(by_chance, features)
    return found.filter((seen < n) & (chi > limit)).select(
        "bucket", F.log((a + 1) / (p or 1) * (q or 1) / (b + 1)).alias("ratio")
    )


class _Sample:
    """Texts as lists of feature numbers, in portions of about ``TOGETHER`` numbers."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray):
        self.labels, self.weights = labels, weights
        self.parts = []
        for some in portions(np.array([len(r) for r in rows], np.int64), TOGETHER):
            lengths = [len(r) for r in rows[some]]
            row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            self.parts.append((some, row, np.concatenate(rows[some]).astype(np.int32)))

    def sums(self, theta: np.ndarray) -> np.ndarray:
        """The sum of ``theta`` over each text's features."""
        out = np.zeros(len(self.labels))
        for some, row, col in self.parts:
            out[some] = np.bincount(row, theta[col], minlength=some.stop - some.start)
        return out

    def spread(self, errors: np.ndarray, features: int) -> np.ndarray:
        """The sum of ``errors`` over the texts that have each feature."""
        out = np.zeros(features)
        for some, row, col in self.parts:
            out += np.bincount(col, errors[some][row], minlength=features)
        return out


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(sample: _Sample, ratios: np.ndarray, penalty: float, start: np.ndarray | None = None) -> np.ndarray:
    """Weights by ratio, and last the bias, of a weighted logistic regression with an L2 penalty.

    By limited-memory BFGS (Nocedal 1980) from ``start`` on: the latest ``MEMORY`` moves and
    changes of the gradient stand for the curvature, and a move is halved until the loss falls
    enough. The loss is a mean, so the penalty falls with the number of texts.
    """
    penalty /= max(1, len(sample.labels))
    weights = sample.weights / sample.weights.sum()

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = x[-1] + sample.sums(x[:-1] * ratios)
        error = weights * (_probability(z) - sample.labels)
        grad = np.append(sample.spread(error, len(ratios)) * ratios + penalty * x[:-1], error.sum())
        # log(1 + e^z) - y z
        fit = weights @ (np.logaddexp(0, z) - sample.labels * z)
        return fit + penalty * (x[:-1] @ x[:-1]) / 2, grad

    x = np.zeros(len(ratios) + 1) if start is None else start
    value, grad = loss(x)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(STEPS):
        if np.abs(grad).max() < 1e-6:
            break
        way, taken = -grad, []
        for move, change, scale in reversed(moves):
            taken.append(scale * (move @ way))
            way = way - taken[-1] * change
        if moves:
            move, change, _ = moves[-1]
            way = way * (move @ change) / (change @ change)
        for (move, change, scale), back in zip(moves, reversed(taken), strict=True):
            way = way + (back - scale * (change @ way)) * move
        size = 1.0 if moves else min(1.0, 1 / np.abs(grad).sum())
        for _ in range(30):
            new_value, new_grad = loss(x + size * way)
            if new_value <= value + 1e-4 * size * (grad @ way):
                break
            size /= 2
        else:
            break
        move, change = size * way, new_grad - grad
        if move @ change > 1e-12:
            moves = [*moves[1 - MEMORY :], (move, change, 1 / (move @ change))]
        x, value, grad = x + move, new_value, new_grad
    return x


def _weights(x: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    return x[:-1] * ratios, float(x[-1])


def _losses(sample: _Sample, weights: np.ndarray, bias: float) -> np.ndarray:
    z = bias + sample.sums(weights)
    return sample.weights * (np.logaddexp(0, z) - sample.labels * z)


def best_penalty(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, ratios: np.ndarray) -> float:
    """The penalty by which a fit on two thirds of the texts predicts the others.

    It is the highest whose loss is within a standard error of the lowest: n-grams are chosen
    from all texts, which lets low penalties look better than they are.
    """
    third = np.arange(len(rows)) % 3 == 0
    if len(set(labels[~third].tolist())) < 2 or not third.any():
        return PENALTIES[len(PENALTIES) // 2]
    pick = lambda which: _Sample([rows[i] for i in np.flatnonzero(which)], labels[which], weights[which])
    learned, other = pick(~third), pick(third)
    losses, x = {}, None
    for penalty in sorted(PENALTIES, reverse=True):
        x = _fit(learned, ratios, penalty, x)
        losses[penalty] = _losses(other, *_weights(x, ratios))
    lowest = min(losses.values(), key=np.sum)
    most = lowest.sum() + lowest.std() * len(lowest) ** 0.5
    return max(penalty for penalty, x in losses.items() if x.sum() <= most)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    per_label: int = 10_000,
    by_chance: float = 1.0,
) -> Model:
    """A model from the rows of ``docs`` (``doc_id, text``) that ``labels`` marks.

    The ratios are of all these rows; the regression takes at most ``per_label`` of each
    label, chosen by hashed id and weighted to the share that the label has in all. What
    comes to the driver is at most a number for each of the 2^``BITS`` buckets. Texts whose id
    cannot have a label are left where they are: the labelled ids' bits are tested first.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    texts = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    texts = possibly_among(texts, known, "doc_id")
    # Labels grow with the documents, so texts and labels meet by sorting at any size.
    counts = stored(ngram_counts(texts.join(known.hint("merge"), "doc_id")), "ngrams")
    total = counts.filter(F.col("bucket") == ALL).groupBy().sum("pos", "neg").first()
    pos, neg = total[0] or 0, total[1] or 0
    if not pos or not neg:
        return Model(np.zeros(0, np.int32), np.zeros(0), np.inf if pos else -np.inf)
    best = select_features(counts, pos, neg, per_label, by_chance).collect()
    if not best:
        return Model(np.zeros(0, np.int32), np.zeros(0), float(np.log(pos / neg)))
    buckets = np.array([r.bucket for r in best], np.int32)
    order = np.argsort(buckets)
    buckets = buckets[order]
    ratios = np.array([r.ratio for r in best])[order]
    chosen = bounded_ids(texts.select("doc_id").join(known, "doc_id").distinct(), "label", per_label)
    sample = texts.join(F.broadcast(chosen), "doc_id")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            numbers = [np.array(x, np.int32) for x in batch.column(1).to_pylist()]
            found += zip(batch.column(0).to_pylist(), numbers, batch.column(2).to_pylist(), strict=True)
        # In the order of ids, so that a repeated task gives the same model.
        found.sort(key=lambda x: (x[0], x[1].tobytes()))
        rows, marks = [x[1] for x in found], np.array([x[2] for x in found])
        each = np.where(marks == 1, pos / max(1, (marks == 1).sum()), neg / max(1, (marks == 0).sum()))
        penalty = best_penalty(rows, marks, each, ratios)
        weights, bias = _weights(_fit(_Sample(rows, marks, each), ratios, penalty), ratios)
        yield pa.RecordBatch.from_pydict({"weights": [weights.tolist()], "bias": [float(bias)]})

    # One task fits, on the chosen features of a bounded number of texts; they are found in
    # parallel before.
    fitted = (
        sample.select("doc_id", _features(F.col("text"), buckets).alias("x"), "label")
        .repartition(1)
        .mapInArrow(learn, "weights array<double>, bias double")
        .first()
    )
    return Model(buckets, np.array(fitted.weights), fitted.bias)


def _keep(buckets: np.ndarray) -> np.ndarray:
    keep = np.zeros(1 << BITS, bool)
    keep[buckets] = True
    return keep


def _features(text: Column, buckets: np.ndarray) -> Column:
    """Which of the sorted ``buckets`` a text has, as their numbers."""

    @F.arrow_udf("array<int>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keep = _keep(buckets)
        for texts in batches:
            sets = _sets(texts.to_pylist(), keep)
            numbers = [np.searchsorted(buckets, s).astype(np.int32) for s in sets]
            yield pa.array(numbers, pa.list_(pa.int32()))

    return features(text)


def score(text: Column, model: Model) -> Column:
    """The probability of label 1 for each text."""

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keep = _keep(model.buckets)
        weight = np.zeros(1 << BITS)
        weight[model.buckets] = model.weights
        for texts in batches:
            z = [model.bias + weight[s].sum() for s in _sets(texts.to_pylist(), keep)]
            with np.errstate(over="ignore"):
                yield pa.array(1 / (1 + np.exp(-np.array(z, float))))

    return probability(text)
