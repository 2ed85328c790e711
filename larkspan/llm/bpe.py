"""Byte-pair encoding and decoding with forced boundaries.

Two neighbouring bytes that occur side by side inside no token of the vocabulary can never
be merged, nor can anything that holds them: between them is a certain cut. A word (what
the tokenizer's own splitting gives) is cut at all such places, the fragments are encoded
independently, and their ids are put together. The last byte of a word is a symbol of its
own where the vocabulary marks word ends, so a pair there is looked up among the pairs
that end such tokens. Fragments are short and few, and are remembered up to a bound.

Texts, ids and ends of words are those of the ``tokenizers`` library without added special
tokens; special tokens that stand in a text are found as the library finds them.

Defined cases: a null text is empty and has no id, as the empty text; repeated rows are
encoded each; an empty table gives no row; other columns are ignored. A text of any length
is encoded whole; a fragment (letters without a blank or a cut) takes some hundred times its
own size while it is merged. A null list of ids decodes to null, ids
that the vocabulary lacks are left out, as the library does.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import count
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspan.llm.common import portions

# Chunks without white space that are remembered, and the longest of them, in bytes.
KEPT, KEPT_BYTES = 150_000, 256
# Bytes of texts that are encoded together, and ids that are decoded together.
TOGETHER, IDS_TOGETHER = 2 << 20, 1 << 20
# Fixed value: the words of the vocabulary's own splitting.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Fragments of up to so many bytes are merged many at a time.
SHORT = 32

# ASCII, and letters up to U+00FF: no normal form changes these.
PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
PLAIN_WORDS = re.compile(
    rb"'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-/:-`{-~]+"
)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes of Latin-1 stand for themselves, the others for U+0100 onwards.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = count(0x100)
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Merges:
    """The merges of a vocabulary, by pairs of ids."""

    def __init__(self, pairs: list[tuple[int, int]], merged: list[int], size: int):
        self.size = size
        self.merged = np.array(merged, np.int64)
        keys = np.array([a * size + b for a, b in pairs], np.int64)
        self._order = np.argsort(keys)
        self._keys = keys[self._order]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.none = len(pairs)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``none`` where it is not merged."""
        if not len(self._keys):
            return np.full(len(left), self.none)
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._order[at], self.none)

    def one(self, symbols: list[int]) -> list[int]:
        """Merge the pair of lowest rank, the leftmost of these, until none is left.

        The pairs wait in a heap, so n symbols take n log n steps.
        """
        ranks, merged = self.ranks, self.merged
        after = [*range(1, len(symbols)), -1]
        before = list(range(-1, len(symbols) - 1))
        heap = [
            (ranks[pair], i, pair)
            for i, pair in enumerate(zip(symbols, symbols[1:], strict=False))
            if pair in ranks
        ]
        heapify(heap)
        while heap:
            rank, i, pair = heappop(heap)
            j = after[i]
            if j < 0 or (symbols[i], symbols[j]) != pair:
                continue
            symbols[i], symbols[j] = int(merged[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0:
                    new = symbols[left], symbols[right]
                    if new in ranks:
                        heappush(heap, (ranks[new], left, new))
        return [x for x in symbols if x >= 0]

    def many(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for many short fragments: a merge in each of them at a time.

        ``owner`` numbers the fragment of each symbol, from left to right.
        """
        done = []
        rank = self._beside(symbols, owner, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            # Of equal ranks the leftmost: the position is the lower part of the number.
            lowest = np.minimum.reduceat((rank << 32) + np.arange(len(symbols)), starts)
            going = lowest >> 32 < self.none
            keep = np.repeat(going, np.diff(starts, append=len(symbols)))
            done.append((symbols[~keep], owner[~keep]))
            at = (np.cumsum(keep) - 1)[lowest[going] & 0xFFFFFFFF]
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            at -= np.arange(len(at))
            changed = np.concatenate([at, at[at > 0] - 1])
            rank[changed] = self._beside(symbols, owner, changed)
        if not done:
            return symbols, owner
        symbols, owner = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return symbols[order], owner[order]

    def _beside(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the pairs that start at ``at``; a fragment's last symbol starts none."""
        following = np.minimum(at + 1, len(symbols) - 1)
        inside = (at + 1 < len(symbols)) & (owner[at] == owner[following])
        return np.where(inside, self.rank(symbols[at], symbols[following]), self.none)


class ForcedBoundaryEncoder:
    """Ids of texts by the vocabulary ``spec``, a ``tokenizers`` file as text.

    The vocabulary has to be a byte-level BPE whose words hold no white space, so that a
    text may be taken apart at ASCII white space before it is normalised.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        parts = json.loads(spec)
        model = parts["model"]
        split = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
        normal = (parts["normalizer"] or {}).get("normalizers", [])
        if (
            [x["type"] for x in split] != ["Split", "ByteLevel"]
            or (split[0]["behavior"], split[0]["invert"]) != ("Removed", True)
            or split[0]["pattern"]["Regex"] != SPLIT
            or [x["type"] for x in normal] != ["NFC", "Replace", "Lowercase"]
            or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "ignore_merges", "unk_token"))
            or any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in parts["added_tokens"])
        ):
            raise ValueError("this needs a byte-level BPE that drops white space")
        library = Tokenizer.from_str(spec)
        self._normalize = library.normalizer.normalize_str
        self._split = library.pre_tokenizer.pre_tokenize_str
        self.special = {x["content"].encode(): x["id"] for x in parts["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self._special = re.compile(b"(" + b"|".join(map(re.escape, longest_first)) + b")")
        vocabulary: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(x if isinstance(x, list) else x.split(" ")) for x in model["merges"]]
        self.merges = Merges(
            [(vocabulary[a], vocabulary[b]) for a, b in pairs],
            [vocabulary[a + b] for a, b in pairs],
            max(vocabulary.values()) + 1,
        )
        letters = byte_letters()
        self._byte = {letter: i for i, letter in enumerate(letters)}
        self.symbol = np.array([vocabulary[x] for x in letters], np.int64)
        self.last_symbol = np.array([vocabulary[x + end] for x in letters], np.int64)
        self.inner, self.final = self._pairs_inside(vocabulary, end)
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def _pairs_inside(self, vocabulary: dict[str, int], end: str) -> tuple[np.ndarray, np.ndarray]:
        """Which bytes are neighbours inside tokens: within a word, and at its end."""
        inner, final = np.zeros((2, 256, 256), bool)
        for token in vocabulary:
            ends = bool(end) and token.endswith(end) and token != end
            body = self._bytes(token.removesuffix(end) if ends else token)
            for i in range(1, len(body)):
                (final if ends and i == len(body) - 1 else inner)[body[i - 1], body[i]] = True
        return inner, final if end else inner

    def _bytes(self, letters: str) -> bytes:
        return bytes(map(self._byte.__getitem__, letters))

    def fragments(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all ``words`` and the number of the fragment of each.

        A fragment starts with each word and at each pair of bytes that no token holds.
        """
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) - 1
        symbols = self.symbol[raw]
        symbols[ends] = self.last_symbol[raw[ends]]
        cut = np.ones(len(raw), bool)
        cut[1:] = ~self.inner[raw[:-1], raw[1:]]
        starts, ends = ends[:-1] + 1, ends[ends > 0]
        cut[ends] = ~self.final[raw[ends - 1], raw[ends]]
        cut[starts] = True
        return symbols, np.cumsum(cut) - 1

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of ``words`` (not empty), of its fragments one after the other."""
        if not words:
            return []
        symbols, owner = self.fragments(words)
        sizes = np.bincount(owner)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        last_of = owner[ends - 1]
        is_long = sizes > SHORT
        long = is_long[owner]
        parts = [self.merges.many(symbols[~long], owner[~long])]
        for number in np.flatnonzero(is_long):
            a = int(np.searchsorted(owner, number))
            found = np.array(self.merges.one(symbols[a : a + sizes[number]].tolist()), np.int64)
            parts.append((found, np.full(len(found), number)))
        ids, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(parts) > 1:
            order = np.argsort(owner, kind="stable")
            ids, owner = ids[order], owner[order]
        counts = np.bincount(owner, minlength=len(sizes))
        raw = ids.astype("<u4").tobytes()
        ends = (np.cumsum(counts)[last_of] * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _words(self, chunk: bytes) -> list[bytes]:
        """The words of a run of bytes without white space.

        The library normalises and splits it, but for letters that are their own normal
        form and have one lower case.
        """
        if PLAIN.fullmatch(chunk):
            return PLAIN_WORDS.findall(chunk.decode().lower().encode())
        return [self._bytes(w) for w, _ in self._split(self._normalize(chunk.decode()))]

    def _learn(self, chunks: set[bytes]) -> None:
        """Find the ids of ``chunks``; those of equal words are found once."""
        older = self._older
        new = []
        for chunk in chunks:
            found = older.get(chunk)
            if found is None:
                new.append(chunk)
            else:
                self._known[chunk] = found
        split = [self._words(chunk) for chunk in new]
        words = list({w: None for parts in split for w in parts})
        ids = dict(zip(words, self.encode_words(words), strict=True))
        for chunk, parts in zip(new, split, strict=True):
            self._known[chunk] = b"".join([ids[w] for w in parts])

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of texts in UTF-8, as unsigned little-endian 32-bit numbers."""
        out: list[bytes] = []
        for some in portions(np.array([len(t or b"") for t in texts], np.int64), TOGETHER):
            out += self._some([t or b"" for t in texts[some]])
        return out

    def _some(self, texts: list[bytes]) -> list[bytes]:
        if len(self._known) > KEPT:
            self._known, self._older = {}, self._known
        split = []
        for text in texts:
            parts = self._special.split(text)
            chunks = parts[0].split()
            for mark, part in zip(parts[1::2], parts[2::2], strict=True):
                self._known[mark] = np.array([self.special[mark]], "<u4").tobytes()
                chunks += [mark, *part.split()]
            split.append(chunks)
        wanted = set().union(*split)
        self._learn(wanted.difference(self._known))
        known = self._known
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in split]
        for chunk in wanted:
            if len(chunk) > KEPT_BYTES:
                del known[chunk]
        return out


@lru_cache(maxsize=2)
def _encoder(spec: str) -> ForcedBoundaryEncoder:
    """One encoder for each worker, kept from task to task."""
    return ForcedBoundaryEncoder(spec)


@lru_cache(maxsize=2)
def tokens_by_id(spec: str) -> pa.Array:
    """The token of each id; null where there is none."""
    parts = json.loads(spec)
    found = {i: t for t, i in parts["model"]["vocab"].items()}
    found |= {x["id"]: x["content"] for x in parts["added_tokens"]}
    return pa.array([found.get(i) for i in range(max(found, default=-1) + 1)], pa.string())


def decoded(ids: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """The text of each list of ids: its tokens joined by a blank."""
    sizes = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
    parts = [_decoded(ids[some], sizes[some], tokens) for some in portions(sizes, IDS_TOGETHER)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def _decoded(ids: pa.ListArray, sizes: np.ndarray, tokens: pa.Array) -> pa.Array:
    flat = ids.flatten()
    valid = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens)))
    found = tokens.take(pc.if_else(valid, flat, pa.scalar(None, flat.type)))
    # An id that the vocabulary lacks is left out, so ends are counted among the others.
    kept = np.concatenate([[0], np.cumsum(found.is_valid().to_numpy(zero_copy_only=False))])
    ends = kept[np.concatenate([[0], np.cumsum(sizes)])]
    lists = pa.LargeListArray.from_arrays(ends, found.drop_null().cast(pa.large_string()))
    texts = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
    return pc.if_else(ids.is_valid(), texts, None).cast(pa.string())


def _spec(tokenizer: str | Path):
    """The vocabulary file, read on the driver and sent to the executors once."""
    return SparkSession.getActiveSession().sparkContext.broadcast(Path(tokenizer).read_text())


def _lists(texts: pa.Array, encoder: ForcedBoundaryEncoder) -> pa.ListArray:
    """The ids of each text of an array, a portion at a time."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    ends, values = [np.zeros(1, np.int64)], []
    for some in portions(sizes, TOGETHER):
        raw = encoder.ids(texts[some].cast(pa.binary()).to_pylist())
        ends.append(ends[-1][-1] + np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))) // 4)
        values.append(pa.array(np.frombuffer(b"".join(raw), "<i4")))
    flat = pa.concat_arrays(values) if values else pa.array([], pa.int32())
    return pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), flat)


def encode(text: Column, tokenizer: str | Path) -> Column:
    """``array<int>``: the ids of each text by the vocabulary at the path ``tokenizer``."""
    spec = _spec(tokenizer)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(spec.value)
        for texts in batches:
            yield _lists(texts, encoder)

    return ids(text)


def decode(ids: Column, tokenizer: str | Path) -> Column:
    """The text of each ``array<int>`` of ids, special tokens included."""
    spec = _spec(tokenizer)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = tokens_by_id(spec.value)
        for lists in batches:
            yield decoded(lists, tokens)

    return text(ids)


def round_trip(text: Column, tokenizer: str | Path) -> Column:
    """``struct<ids, text>``: what ``encode`` gives for each text, and ``decode`` for that.

    One Python process does both, where two would each hold a batch.
    """
    spec = _spec(tokenizer)

    @F.arrow_udf("struct<ids:array<int>,text:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, tokens = _encoder(spec.value), tokens_by_id(spec.value)
        for texts in batches:
            lists = _lists(texts, encoder)
            yield pa.StructArray.from_arrays([lists, decoded(lists, tokens)], ["ids", "text"])

    return both(text)
