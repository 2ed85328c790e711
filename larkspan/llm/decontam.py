"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared as words (runs of letters, digits and ``_`` in lower
case; where a script has no blanks, each code point is a word). An item of m words may
occur with k = floor(m / 5) word edits. Split into k + 1 pieces, at least one piece of any
such occurrence is untouched, so all exact hits of pieces are looked up with one automaton,
and around each hit the item is verified by Myers' bit-parallel edit distance. An item of
under five words is one piece and is found word for word.

The items are a stated query set. They are sent to the tasks in blocks of at most
``block_bytes`` of text; further blocks are further passes over the documents.

Defined cases: a null item or id, and an item without words, are left out; a null or empty
text has no match; repeated rows and repeated items each give their matches; of several places of an item in a text the
nearest, then the first, is given; no items or no documents give no match. Other
columns are ignored or, in ``without_contaminated``, kept.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import stored

WORD = re.compile(r"\w+")
# Thai and Lao, Myanmar, Khmer, kana, Bopomofo and Han: scripts that set no blanks between words.
UNSPACED = (
    "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff"
    "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
)
HAS_UNSPACED = re.compile(f"[{UNSPACED}]")
MIXED_WORD = re.compile(rf"[^\W{UNSPACED}]+|(?=\w)[{UNSPACED}]")
EDITS_IN = 5
MATCHES = "array<struct<item_id:bigint,distance:int,words:int,start:bigint,end:bigint>>"
_MATCHES = pa.list_(
    pa.struct(
        [
            ("item_id", pa.int64()),
            ("distance", pa.int32()),
            ("words", pa.int32()),
            ("start", pa.int64()),
            ("end", pa.int64()),
        ]
    )
)


def words_of(text: str | None) -> list[str]:
    lower = (text or "").lower()
    return (MIXED_WORD if HAS_UNSPACED.search(lower) else WORD).findall(lower)


def pieces(words: list[str], edits: int) -> list[tuple[int, list[str]]]:
    """(start, words) of ``edits + 1`` pieces whose lengths differ by one at most."""
    n, parts = len(words), edits + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """(distance, end) of the nearest occurrence of ``pattern`` in ``text``, the first of these.

    Each number holds a column of the edit-distance matrix, a bit for each pattern word.
    """
    m = len(pattern)
    where: dict[str, int] = {}
    for i, word in enumerate(pattern):
        where[word] = where.get(word, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    best, end = m, 0
    for j, word in enumerate(text):
        equal = where.get(word, 0)
        vertical = equal | down
        diagonal = (((equal & up) + up) ^ up) | equal
        right = down | ~(diagonal | up) & full
        left = up & diagonal
        if right & last:
            distance += 1
        elif left & last:
            distance -= 1
        right, left = right << 1, left << 1
        up = (left | ~(vertical | right)) & full
        down = right & vertical & full
        if distance < best:
            best, end = distance, j + 1
    return best, end


class Matcher:
    """Finds the items in texts; ``items`` are (item_id, words)."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items = items
        found: dict[str, list[tuple[int, int]]] = {}
        for number, (_, words) in enumerate(items):
            for start, piece in pieces(words, len(words) // EDITS_IN):
                found.setdefault(f" {' '.join(piece)} ", []).append((number, start))
        self.automaton = ahocorasick.Automaton()
        for key, places in found.items():
            self.automaton.add_word(key, (len(key), places))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def matches(self, text: str | None) -> list[dict]:
        if self.empty or not text:
            return []
        words = words_of(text)
        joined = f" {' '.join(words)} "
        hits = list(self.automaton.iter(joined))
        if not hits:
            return []
        starts = list(accumulate((len(w) + 1 for w in words), initial=1))
        tried: set[tuple[int, int]] = set()
        best: dict[int, tuple[int, int, int]] = {}
        for end, (length, places) in hits:
            at = bisect_right(starts, end - length + 2) - 1
            for number, offset in places:
                if (number, at - offset) not in tried:
                    tried.add((number, at - offset))
                    self._verify(words, number, at - offset, best)
        return [
            {
                "item_id": self.items[number][0],
                "distance": distance,
                "words": len(self.items[number][1]),
                "start": start,
                "end": end,
            }
            for number, (distance, start, end) in sorted(best.items())
        ]

    def _verify(self, words, number, start, best) -> None:
        item = self.items[number][1]
        edits = len(item) // EDITS_IN
        low = max(0, start - edits)
        if number in best and best[number][0] == 0 and best[number][1] <= low:
            return  # found exactly, and no later
        around = words[low : start + len(item) + edits]
        distance, end = myers(item, around)
        if distance > edits:
            return
        _, back = myers(item[::-1], around[:end][::-1])
        found = (distance, low + end - back, low + end)
        if number not in best or found < best[number]:
            best[number] = found


def item_blocks(benchmark: DataFrame, block_bytes: int, min_words: int = 1) -> list[list[tuple[int, list[str]]]]:
    """The items in blocks of at most ``block_bytes`` characters (or one longer item).

    ``min_words`` leaves out shorter items: one or two words stand in most documents by chance.

    The items are a set of queries that fits the driver; each block goes to the tasks with
    the function that looks for it.
    """
    blocks, size = [[]], 0
    rows = benchmark.select("item_id", "text").dropna().orderBy("item_id", "text")
    for item_id, text in rows.toLocalIterator():
        words = words_of(text)
        if len(words) < max(1, min_words):
            continue
        if blocks[-1] and size + len(text) > block_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append((item_id, words))
        size += len(text)
    return blocks


def _matches(text: Column, items: list[tuple[int, list[str]]]) -> Column:
    @F.arrow_udf(MATCHES)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(items)
        for texts in batches:
            yield pa.array([matcher.matches(t) for t in texts.to_pylist()], _MATCHES)

    return find(text)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, block_bytes: int = 8 << 20, min_words: int = 1
) -> DataFrame:
    """``doc_id`` and the match, for each document and item that match: a pass for each block."""
    found = [
        docs.select("doc_id", F.explode(_matches(F.col("text"), block)).alias("m"))
        for block in item_blocks(benchmark, block_bytes, min_words)
    ]
    return reduce(DataFrame.union, found).select("doc_id", "m.*")


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, block_bytes: int = 8 << 20, min_words: int = 1
) -> DataFrame:
    """The rows of ``docs`` that match no item; what one block leaves is stored for the next."""
    blocks = item_blocks(benchmark, block_bytes, min_words)
    for number, block in enumerate(blocks):
        docs = docs.filter(F.size(_matches(F.col("text"), block)) == 0)
        if number < len(blocks) - 1:
            docs = stored(docs, "decontaminated")
    return docs
