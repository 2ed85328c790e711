"""Importance resampling towards a target, by bit-sliced sums.

The features of a text are its runs of 1 to ``longest`` words, repeats counted, hashed into
``BUCKETS`` buckets. A bucket's gain says how much more frequent it is in the target than
in the raw documents, and a document's weight is the sum of the gains of its features.
The sum is made in bits: a document's bucket counts are planes of ``BUCKETS`` bits (plane j
holds bit j of each count), the gains are signed planes likewise, and for each two planes
the set bits of their AND are counted and stand for a power of two. So weights are exact
whole numbers. The documents with the highest weights plus Gumbel noise, which depends on the
id alone, are drawn: a sample without replacement in proportion to the exponentiated weights.

Words are runs of ASCII digits and letters, A-Z in lower case, and of all characters beyond
ASCII. Defined cases: a null or empty text has no feature and weight 0; a null id is the
empty text in the noise and comes after all others of its score; repeated rows each count
and each may be drawn (their order among themselves is open, as they are equal); without
target texts all gains follow from the raw counts alone; an empty table gives no row. Other
columns are ignored. The counts of all features are at most ``BUCKETS`` numbers, whatever
the data, and are the only thing that comes to the driver; a text is held whole.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.common import stored

BUCKETS = 10_000
# Texts whose planes are held at once, and word sequences whose buckets are remembered.
TOGETHER, KEPT = 32, 500_000
WIDTH = -(-BUCKETS // 64) * 64
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
TO_WORDS = bytes.maketrans(
    SEPARATORS + bytes(range(ord("A"), ord("Z") + 1)),
    b" " * len(SEPARATORS) + bytes(range(ord("a"), ord("z") + 1)),
)
SCORED = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TO_WORDS).split()


class _Buckets(dict):
    """The bucket of each word sequence, remembered up to a bound."""

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature) % BUCKETS
        return bucket


def buckets_of(words: list[bytes], longest: int, known: _Buckets) -> np.ndarray:
    """The buckets of all runs of 1 to ``longest`` words."""
    found = list(map(known.__getitem__, words))
    for n in range(2, longest + 1):
        found += [known[b" ".join(words[i : i + n])] for i in range(len(words) - n + 1)]
    return np.array(found, np.int64)


def bucket_counts(texts: DataFrame, longest: int = 1) -> np.ndarray:
    """How many features of all ``text`` fall in each bucket; every task adds up its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(BUCKETS, np.int64), _Buckets()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                found = buckets_of(words_of(text), longest, known)
                total += np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(total).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    parts = texts.select("text").mapInArrow(count, "bucket int, n bigint")
    counts = np.zeros(BUCKETS, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each bucket, in doubles."""
    all_raw, all_target = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * all_raw / ((s + 1.0) * all_target)))
            for s, t in zip(raw.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def planes(numbers: np.ndarray) -> np.ndarray:
    """The bits of each row of ``numbers`` (not negative): a row of 64-bit words for each bit.

    The result has a first axis for the bits, as many as the largest number has.
    """
    wide = np.zeros((len(numbers), WIDTH), np.int64)
    wide[:, :BUCKETS] = numbers
    bits = int(wide.max(initial=0)).bit_length()
    if not bits:
        return np.zeros((0, len(numbers), WIDTH // 64), np.uint64)
    return np.stack(
        [np.packbits((wide >> j & 1).astype(np.uint8), axis=1).view(np.uint64) for j in range(bits)]
    )


class GainPlanes:
    """Signed bit planes of the gains."""

    def __init__(self, gains: np.ndarray):
        self.planes, powers = [], []
        for sign in (1, -1):
            found = planes(np.maximum(sign * gains, 0)[None, :])[:, 0]
            self.planes += list(found)
            powers += [sign << k for k in range(len(found))]
        self.powers = np.array(powers, np.int64)

    def weights(self, counts: np.ndarray) -> np.ndarray:
        """The sum of the gains of each row of bucket ``counts``."""
        total = np.zeros(len(counts), np.int64)
        for j, plane in enumerate(planes(counts)):
            # Few documents have a count so high that it has bit j.
            rows = np.flatnonzero(plane.any(axis=1))
            for gain, power in zip(self.planes, self.powers, strict=True):
                set_bits = np.bitwise_count(plane[rows] & gain).sum(axis=1, dtype=np.int64)
                total[rows] += set_bits * (power << j)
        return total


@lru_cache(maxsize=2)
def _gain_planes(raw: bytes) -> GainPlanes:
    return GainPlanes(np.frombuffer(raw, np.int64))


def noise(doc_id: int | None, seed: str) -> int:
    """floor(-1000 ln(-ln u)), u in (0, 1) by the SHA-256 of ``seed:doc_id``."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    u = (int(hashlib.sha256(name.encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
    return math.floor(-1000 * math.log(-math.log(u)))


def scored(docs: DataFrame, gains: np.ndarray, seed: str, longest: int = 1) -> DataFrame:
    """``SCORED`` of every row of ``docs`` (``doc_id, text``)."""
    raw = gains.astype(np.int64).tobytes()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, known = _gain_planes(raw), _Buckets()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            n_words, n_features, weights = [], [], []
            for at in range(0, len(texts), TOGETHER):
                found = []
                for text in texts[at : at + TOGETHER]:
                    words = words_of(text)
                    n_words.append(len(words))
                    found.append(buckets_of(words, longest, known))
                sizes = [len(x) for x in found]
                row = np.repeat(np.arange(len(found)) * BUCKETS, sizes)
                counts = np.bincount(row + np.concatenate(found), minlength=len(found) * BUCKETS)
                n_features += sizes
                weights += gain.weights(counts.reshape(len(found), BUCKETS)).tolist()
            scores = [w + noise(i, seed) for i, w in zip(ids, weights, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (ids, n_words, n_features, weights, scores)],
                ["doc_id", "n_words", "n_features", "weight", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, SCORED)


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the order of ``order``.

    The rows are dealt out by ranges and sorted in each; what the ranges before hold is added
    to the place in the own one. Only a number for each range is brought together.
    """
    placed = stored(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "ranges",
    )
    # The upper bits of a place are the number of the range, the lower 33 count in it.
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        placed.withColumn("_of", part)
        .join(F.broadcast(starts), F.col("_of") == F.col("_part"))
        .withColumn("rank", F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        .select(*rows.columns, "rank")
    )


def importance_resampling(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    min_words: int = 20,
    longest: int = 1,
    seed: str = "2024",
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``.

    ``rank`` numbers the documents drawn, ``percent`` of those with ``min_words`` words or
    more, and is null for all others. ``docs`` is read twice: for the counts of its buckets
    and for the weights. What is ranked are five numbers for each document.
    """
    gains = bucket_gains(bucket_counts(docs, longest), bucket_counts(target, longest))
    found = stored(scored(docs, gains, seed, longest), "weights")
    enough = found.filter(F.col("n_words") >= min_words)
    drawn = enough.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    kept = ["doc_id", "n_features", "weight", "score"]
    in_order = ranked(enough.select(kept), order)
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    others = found.filter(F.col("n_words") < min_words).select(*kept, F.lit(None).cast("long").alias("rank"))
    return in_order.select(*kept, rank.alias("rank")).unionByName(others)


# The same in DuckDB for runs of one word, from the contract.
RESAMPLING_SQL = r"""
WITH polynomial AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
           CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT)) AS t),
words AS (
  SELECT true AS raw, row_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM (SELECT row_number() OVER () AS row_id, translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
  UNION ALL
  SELECT false, 0, unnest(regexp_extract_all(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))
  FROM benchmark),
per_doc AS (SELECT raw, row_id, word, count(*) AS n FROM words GROUP BY ALL),
hashed AS (
  SELECT word, xor(4294967295, list_reduce(list_transform(range(1, strlen(word) + 1), lambda i:
           ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::BIGINT), lambda c, b:
           xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT)) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM per_doc), polynomial),
counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (raw), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT raw), 0)::DOUBLE AS t
  FROM per_doc JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT sum(s) + 10000 AS s_all, sum(t) + 10000 AS t_all FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * s_all / ((s + 1) * t_all)))::BIGINT AS gain FROM counts, totals),
weighed AS (
  SELECT row_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
  FROM per_doc JOIN hashed USING (word) JOIN gains USING (bucket) WHERE raw GROUP BY row_id),
noisy AS (
  SELECT row_id, doc_id,
         (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
           / 4294967296::DOUBLE AS u
  FROM (SELECT row_number() OVER () AS row_id, doc_id FROM documents)),
scores AS (
  SELECT row_id, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln(u)))::BIGINT AS score
  FROM noisy LEFT JOIN weighed USING (row_id)),
ranks AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
         count(*) FILTER (n_features >= 20) OVER () AS enough
  FROM scores)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= enough * 10 // 100 THEN place END AS rank
FROM ranks
"""
