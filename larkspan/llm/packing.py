"""Best-fit packing of token pieces by exact-complement hashing.

Texts become token ids; a longer one is cut into pieces of ``CAPACITY``. Packing needs
only how many pieces have each length, at most ``CAPACITY`` numbers whatever the data, so
it is planned on the driver: the longest length left opens a sequence, and its gap is
looked up in the indexed sums of one, two and three lengths, under the counts still
available. A combination that fills the gap exactly is used as often as the counts allow;
where there is none the longest fitting length goes in and the rest of the gap is looked
up again. The plan is a list of slots (length, ranks, sequence, offset), of a size set by
``CAPACITY``. Spark numbers the pieces of each length, and every piece finds its slot.

Defined cases: a null text is empty and has the end id alone; repeated rows are packed
each; a null id is packed like any other; an empty table gives no row. Other columns
are ignored.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspan.llm.common import stored

CAPACITY, END = 4096, 1
KEPT_WORDS, WORDS_AT_ONCE, BYTES_OUT = 500_000, 20_000, 4 << 20
BYTES_AT_ONCE, PER_BUCKET = 6 << 20, 1000

# ASCII punctuation, and letters up to U+00FF, which no normal form changes.
PUNCTUATION = string.punctuation
PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
TAIL = r"(?P<tail>[!-/:-@\[-`{-~]+)$"
LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
# Lengths that may be used up before the index of sums is made anew.
REFRESH = 24
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


class WordTokenizer:
    """Ids of texts by a ``tokenizers`` vocabulary in which white space ends a word.

    A word has the same ids wherever it stands, so the distinct words of some texts are
    encoded and put together by their numbers. Letters and the punctuation after them count
    as two words. Words of letters are encoded many at a time, all others alone; what is
    found is kept from one call to the next, up to a bound.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        parts = json.loads(spec)
        model, split = parts["model"], parts["pre_tokenizer"]["pretokenizers"][0]
        if model.get("end_of_word_suffix") != "</w>" or not (
            split["behavior"] == "Removed"
            and split["invert"]
            and r"[^\s\p{L}\p{N}]+" in split["pattern"]["Regex"]
        ):
            raise ValueError("this needs a vocabulary with word ends that drops white space")
        self.encode = Tokenizer.from_str(spec).encode_batch_fast
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for token, i in model["vocab"].items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def _alone(self, words: list[bytes]) -> list[bytes]:
        found = self.encode([w.decode() for w in words], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _learn(self, words: list[bytes]) -> None:
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = words[at : at + WORDS_AT_ONCE]
            found = self.encode([b" ".join(part).decode()], add_special_tokens=False)
            ids = np.array(found[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the vocabulary does not end each word once")
            raw, start = ids.tobytes(), 0
            for word, end in zip(part, (ends * 4).tolist(), strict=True):
                self.known[word] = raw[start:end]
                start = end

    def _lookup(self, keys: list[bytes]) -> list[bytes]:
        """The ids of words of which plain ones are in lower case, without punctuation."""
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        known = self.known
        new = [k for k in keys if k not in known]
        plain = [k for k in new if k.isalpha() or LATIN.fullmatch(k)]
        others = list(set(new).difference(plain))
        self._learn(plain)
        known.update(zip(others, self._alone(others), strict=True))
        return [known[k] for k in keys]

    def ids(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (a string array); a null text has none.

        Words are split, told apart, trimmed and lower-cased by Arrow; only the distinct
        results become Python objects.
        """
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.values.dictionary_encode()
        vocabulary = words.dictionary
        cores = pc.ascii_rtrim(vocabulary, PUNCTUATION)
        plain = pc.match_substring_regex(cores, PLAIN)
        keys = pc.if_else(plain, pc.utf8_lower(cores), vocabulary).dictionary_encode()
        cut = pc.and_(plain, pc.less(pc.binary_length(cores), pc.binary_length(vocabulary)))
        tails = pc.struct_field(pc.extract_regex(vocabulary.filter(cut), TAIL), "tail").dictionary_encode()
        heads = _distinct(keys)
        ends = [b"", *_distinct(tails)]
        found = self._lookup(heads) + [b"", *self._lookup(ends[1:])]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(lengths) - lengths
        tokens = np.frombuffer(b"".join(found), "<u4")
        # Each word is two parts: its letters (or all of it) and its punctuation (or nothing).
        tail_of = np.full(len(vocabulary), len(heads))
        tail_of[cut.to_numpy(zero_copy_only=False)] = len(heads) + 1 + tails.indices.to_numpy()
        at = words.indices.to_numpy()
        part = np.stack([keys.indices.to_numpy()[at], tail_of[at]], axis=1).ravel()
        n = lengths[part]
        before = np.concatenate([[0], np.cumsum(n)])
        placed = tokens[np.repeat(starts[part] - before[:-1], n) + np.arange(before[-1])]
        bounds = before[2 * split.offsets.to_numpy()].tolist()
        return [placed[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]


def _distinct(encoded: pa.DictionaryArray) -> list[bytes]:
    """The dictionary of words without blanks, joined and split: faster than one by one."""
    words = encoded.dictionary
    if not len(words):
        return []
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")
    return joined[0].as_py().encode().split(b" ")


def token_pieces(docs: DataFrame, tokenizer: str | Path, capacity: int = CAPACITY) -> DataFrame:
    """``PIECES`` of every document; ``ids`` are unsigned little-endian 32-bit numbers.

    ``tokenizer`` is the path of the vocabulary on the driver, which sends it to the tasks.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())
    end = np.array([END], "<u4").tobytes()
    size = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokenizer(spec.value)
        rows, waiting = [], 0

        def batch_of(rows):
            ids, numbers, starts, lengths, raw = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(numbers, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(raw, pa.binary()),
                ],
                ["doc_id", "piece", "start", "length", "ids"],
            )

        def portions(texts: pa.Array) -> Iterator[slice]:
            """Rows of ``texts`` that hold about ``BYTES_AT_ONCE``, or one longer text."""
            ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
            low = 0
            while low < len(ends):
                before = ends[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(ends, before + BYTES_AT_ONCE, side="right")))
                yield slice(low, high)
                low = high

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for some in portions(texts):
                for doc_id, raw in zip(doc_ids[some], tokens.ids(texts[some]), strict=True):
                    raw += end
                    for number, at in enumerate(range(0, len(raw), size)):
                        part = raw[at : at + size]
                        rows.append((doc_id, number, at // 4, len(part) // 4, part))
                        waiting += len(part)
                    if waiting > BYTES_OUT:
                        yield batch_of(rows)
                        rows, waiting = [], 0
        if rows:
            yield batch_of(rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


@dataclass
class Slot:
    """``times`` pieces of ``length`` side by side from ``offset``, in each of ``sequences``
    sequences from ``sequence``; they take the ranks from ``rank`` on."""

    length: int
    times: int
    sequences: int
    rank: int
    sequence: int
    offset: int


class _Sums:
    """Which totals one, two and three of the available lengths reach.

    Totals are bits of a number. The counts only fall, so an old index has every total
    that can be reached now; what it finds is checked against the counts.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.capacity = len(counts) - 1
        self.used_up = 0
        self.refresh()

    def refresh(self) -> None:
        self.used_up = 0
        self.lengths = np.flatnonzero(self.counts)
        limit = (1 << (self.capacity + 1)) - 1
        ones = sum(1 << int(n) for n in self.lengths)
        pairs = triples = 0
        for n in self.lengths.tolist():
            pairs |= (ones << n) & limit
        for n in self.lengths.tolist():
            triples |= (pairs << n) & limit
        self.reached = (ones, pairs, triples)

    def pair(self, total: int, held: int = 0) -> tuple[int, ...] | None:
        """The most even two available lengths of that sum; one of ``held`` is already taken."""
        a = self.lengths[: np.searchsorted(self.lengths, total // 2, side="right")][::-1]
        b = total - a
        free_a, free_b = self.counts[a] - (a == held), self.counts[b] - (b == held)
        fits = np.flatnonzero((free_a > 0) & (free_b > 0) & ((a != b) | (free_a > 1)))
        return (int(a[fits[0]]), int(b[fits[0]])) if len(fits) else None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        if self.counts[gap] > 0:
            return (gap,)
        ones, pairs, triples = self.reached
        if pairs >> gap & 1 and (found := self.pair(gap)):
            return found
        if triples >> gap & 1:
            upper = self.lengths[: np.searchsorted(self.lengths, gap - 2, side="right")]
            for a in sorted(upper.tolist(), key=lambda n: abs(3 * n - gap)):
                if self.counts[a] > 0 and pairs >> (gap - a) & 1 and (found := self.pair(gap - a, a)):
                    return (a, *found)
            if self.used_up:
                self.refresh()
        return None

    def longest(self, gap: int) -> int | None:
        at = np.searchsorted(self.lengths, gap, side="right")
        below = self.lengths[:at]
        below = below[self.counts[below] > 0]
        return int(below[-1]) if len(below) else None


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Slot]:
    """Slots for as many pieces of each length as ``histogram`` says."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    sums = _Sums(counts)
    used: Counter[int] = Counter()
    slots: list[Slot] = []
    sequence = 0
    while (first := sums.longest(capacity)) is not None:
        items: Counter[int] = Counter()
        gap, more = capacity, first
        while more is not None:
            items[more] += 1
            counts[more] -= 1
            gap -= more
            fill = sums.exact(gap) if gap else None
            if fill:
                for n in fill:
                    items[n] += 1
                    counts[n] -= 1
                gap = 0
            more = sums.longest(gap) if gap else None
        # The same sequence again, as often as the counts allow.
        again = min(int(counts[n]) // k for n, k in items.items())
        offset = 0
        for n, k in sorted(items.items(), reverse=True):
            counts[n] -= again * k
            slots.append(Slot(n, k, again + 1, used[n], sequence, offset))
            used[n] += (again + 1) * k
            offset += n * k
        sequence += again + 1
        sums.used_up += sum(counts[n] == 0 for n in items)
        if sums.used_up >= REFRESH:
            sums.refresh()
    return slots


def _ranked(pieces: DataFrame, histogram: dict[int, int], order: list[str]) -> DataFrame:
    """``pieces`` with ``rank``: the number of each among those of its length, from 0.

    The pieces of a length are spread over buckets of about ``PER_BUCKET``, numbered in
    each bucket, and moved on by what the buckets before hold. Pieces that are equal in all
    of ``order`` share a bucket.
    """
    buckets = [1] * (max(histogram) + 1)
    for length, n in histogram.items():
        buckets[length] = -(-n // PER_BUCKET)
    spread = pieces.withColumn(
        "bucket",
        F.pmod(F.xxhash64(*order), F.element_at(F.lit(buckets), (F.col("length") + 1).cast("int"))),
    )
    before = Window.partitionBy("of_length").orderBy("of_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = (
        spread.groupBy(F.col("length").alias("of_length"), F.col("bucket").alias("of_bucket"))
        .agg(F.count("*").alias("n"))
        .select("of_length", "of_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    within = Window.partitionBy("length", "bucket").orderBy(*order)
    return (
        spread.withColumn("in_bucket", F.row_number().over(within))
        .join(bases, (F.col("length") == F.col("of_length")) & (F.col("bucket") == F.col("of_bucket")))
        .withColumn("rank", F.col("base") + F.col("in_bucket") - 1)
        .drop("bucket", "of_length", "of_bucket", "base", "in_bucket")
    )


def pack_pieces(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; all but ``length`` is passed on.

    ``pieces`` has ``length`` (1 to ``capacity``) and is read more than once, so it should
    be stored; ``order`` names the columns that number pieces of equal length.
    """
    found = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    histogram = {r.length: r.n for r in found}
    if not histogram:
        return pieces.withColumns(
            {"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")}
        )
    slots = sorted(packing_plan(histogram, capacity), key=lambda s: (s.length, s.rank))
    columns = {
        name: np.array([getattr(s, name) for s in slots], np.int64)
        for name in ("length", "times", "rank", "sequence", "offset")
    }
    # A key that sorts by length, then rank: the ranks of a length start anew.
    firsts = {}
    for i, s in enumerate(slots):
        firsts.setdefault(s.length, i)
    starts = {n: (a, b) for n, a, b in zip(firsts, firsts.values(), [*firsts.values()][1:] + [len(slots)], strict=True)}

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        at = np.zeros(len(lengths), np.int64)
        for n in np.unique(lengths):
            a, b = starts[int(n)]
            mine = lengths == n
            at[mine] = a + np.searchsorted(columns["rank"][a:b], ranks[mine], side="right") - 1
        row, times = ranks - columns["rank"][at], columns["times"][at]
        return pa.StructArray.from_arrays(
            [
                pa.array(columns["sequence"][at] + row // times),
                pa.array(columns["offset"][at] + row % times * lengths),
            ],
            ["sequence_id", "offset"],
        )

    ranked = _ranked(pieces, histogram, order).withColumn("x", place("length", "rank"))
    return ranked.select(*pieces.columns, "x.sequence_id", "x.offset")


def packed_documents(docs: DataFrame, tokenizer: str | Path, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each piece and its place.

    The ids themselves are not shuffled: ``token_pieces`` gives them again, under the same
    ``doc_id`` and ``piece``.
    """
    pieces = token_pieces(docs, tokenizer, capacity).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    order = ["doc_id", "piece", "start", "ids_crc32"]
    return pack_pieces(stored(pieces, "pieces"), order, capacity)
