"""Character n-grams of words, hashed into buckets on numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import regex

LETTERS = regex.compile(r"\p{L}+")
WORDS_AT_ONCE = 100_000

# Odd multipliers of the hash (64 bits of the golden ratio and of sqrt 3).
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBB67AE8584CAA73B)


def word_ngrams(words: list[str], low: int, high: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts, buckets``: those of word i are ``buckets[starts[i]:starts[i + 1]]``.

    A word gets a blank on either side; n-grams of ``low`` to ``high`` code points do not
    cross words. Equal n-grams have equal buckets on every machine.
    """
    if not words:
        return np.zeros(1, np.int64), np.zeros(0, np.int32)
    chars = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64) + 2
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    counts = [np.maximum(lengths - n + 1, 0) for n in range(low, high + 1)]
    starts = np.concatenate([[0], np.cumsum(np.sum(counts, axis=0))])
    buckets = np.empty(starts[-1], np.int32)
    rolling = np.zeros(len(chars), np.uint64)
    taken = starts[:-1].copy()
    for n in range(1, min(high, len(chars)) + 1):
        rolling = rolling[: len(chars) - n + 1] * STEP + chars[n - 1 :]
        if n < low:
            continue
        inside = rolling[owner[: len(rolling)] == owner[n - 1 :]]
        hashed = (inside ^ (inside >> np.uint64(29))) * MIX + np.uint64(n)
        hashed = (hashed ^ (hashed >> np.uint64(32))) * STEP
        # The n-grams found are in the order of the words: those of word i go to its range.
        count = counts[n - low]
        first = np.cumsum(count) - count
        at = np.arange(len(inside)) + np.repeat(taken - first, count)
        buckets[at] = (hashed >> np.uint64(64 - bits)).astype(np.int32)
        taken += count
    return starts, buckets


def _portions(texts: list[str | None], distinct: bool) -> Iterator[list[tuple[int, list[str]]]]:
    """(text number, words) in portions of bounded size; a long text is spread over several."""
    portion, size = [], 0
    for i, text in enumerate(texts):
        words = LETTERS.findall((text or "").lower())
        if distinct:
            words = list(dict.fromkeys(words))
        for at in range(0, max(1, len(words)), WORDS_AT_ONCE):
            portion.append((i, words[at : at + WORDS_AT_ONCE]))
            size += len(portion[-1][1])
            if size >= WORDS_AT_ONCE:
                yield portion
                portion, size = [], 0
    if portion:
        yield portion


def text_ngrams(
    texts: list[str | None],
    low: int,
    high: int,
    bits: int,
    distinct: bool,
    keep: np.ndarray | None = None,
) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, buckets) in order; a long text comes in several parts.

    Words are runs of letters in lower case; ``distinct`` takes each word of a text once.
    ``keep`` marks the buckets that are wanted.
    """
    for portion in _portions(texts, distinct):
        numbers: dict[str, int] = {}
        lists = [[numbers.setdefault(w, len(numbers)) for w in words] for _, words in portion]
        starts, buckets = word_ngrams(list(numbers), low, high, bits)
        if keep is not None:
            wanted = keep[buckets]
            starts = np.concatenate([[0], np.cumsum(wanted)])[starts]
            buckets = buckets[wanted]
        lengths = np.diff(starts)
        for (i, _), words in zip(portion, lists, strict=True):
            words = np.array(words, np.int64)
            n = lengths[words]
            n, words = n[n > 0], words[n > 0]
            at = np.repeat(starts[words] - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield i, buckets[at]
