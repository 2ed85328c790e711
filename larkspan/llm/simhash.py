"""Near duplicates by SimHash and a self-join of binary tries.

The distinct fingerprints form a binary trie. Pairs of its nodes are traversed together
from the root, the bits in which they differ are added up, and a pair is dropped when
they exceed the budget. Three bits split over two halves leave one half with at most
one, so the join is done twice, once for each half first, with a budget of one bit
within that half and of three in all; that keeps the number of node pairs near the
number of fingerprints.

The upper levels are Spark's: every fingerprint is dealt to the pairs of prefixes that
are within the budget, and a pair of prefixes with more than ``MOST`` fingerprints is
dealt anew by longer ones until none is left. The lower levels run in tasks on numpy
arrays. A task returns a spanning forest of its links, never all pairs of a group.

Defined cases: a text of one or two words is one shingle; a null or wordless text has
fingerprint zero and links like any other; repeated rows share their fingerprint; a
null ``doc_id`` takes part and gets the smallest id of its component (null if it has
none); an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import stored
from larkspan.llm.components import connected_components

SHINGLE, SEED, BITS, HALF = 3, 42, 64, 32
BUDGET, HALF_BUDGET = 3, 1
# Fingerprints of a prefix that are aimed at, and the most that one task takes as a group.
AIM, MOST = 1 << 13, 1 << 17
CHUNK = 1 << 17


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    majority = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(majority.view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` of each row; ``fp`` as a bigint."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = pa.array([fingerprint(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        compute, "doc_id bigint, fp bigint"
    )


def fingerprint_of(text: Column) -> Column:
    """The fingerprint of each text, as a bigint."""

    @F.arrow_udf("bigint")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fingerprint(t) for t in texts.cast(pa.binary()).to_pylist()], pa.int64())

    return compute(text)


class _Forest:
    """Components of nodes 0..n-1 under links that come in portions."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


class _Trie:
    """The trie of a sorted array: a node is a range of it."""

    def __init__(self, values: np.ndarray):
        self.values, self._ones = values, {}

    def middles(self, depth: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the second child of each node begins."""
        ones = self._ones.get(depth)
        if ones is None:
            bit = (self.values >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            ones = self._ones[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        return high - (ones[high] - ones[low])


def trie_links(
    left: np.ndarray, right: np.ndarray | None, depth: int, differ: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Portions of index pairs that are within the budget, ``right`` None for a self-join.

    Both arrays are sorted and distinct; each has one prefix of ``depth`` bits, and the
    prefixes differ in ``differ`` bits. Portions bound the memory: the rest waits.
    """
    self_join = right is None
    a = _Trie(left)
    b = a if self_join else _Trie(right)
    one = np.array
    waiting = [(depth, one([0]), one([len(a.values)]), one([0]), one([len(b.values)]), one([differ]))]
    while waiting:
        depth, alo, ahi, blo, bhi, diff = waiting.pop()
        if len(alo) > CHUNK:
            waiting.append((depth, *(x[CHUNK:] for x in (alo, ahi, blo, bhi, diff))))
            alo, ahi, blo, bhi, diff = (x[:CHUNK] for x in (alo, ahi, blo, bhi, diff))
        na, nb = ahi - alo, bhi - blo
        small = na * nb <= 16
        if small.any():
            n = (na * nb)[small]
            at = np.repeat(np.arange(len(n)), n)
            off = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            width = nb[small][at]
            i, j = alo[small][at] + off // width, blo[small][at] + off % width
            near = np.bitwise_count(a.values[i] ^ b.values[j]) <= BUDGET
            if self_join:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        alo, ahi, blo, bhi, diff = (x[~small] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        amid, bmid = a.middles(depth, alo, ahi), b.middles(depth, blo, bhi)
        again = self_join & (alo == blo)  # a node with itself: one of the crossed pairs is enough
        every = np.ones(len(alo), bool)
        most = HALF_BUDGET if depth + 1 <= HALF else BUDGET
        children = [
            (alo, amid, blo, bmid, diff, every),
            (amid, ahi, bmid, bhi, diff, every),
            (alo, amid, bmid, bhi, diff + 1, every),
            (amid, ahi, blo, bmid, diff + 1, ~again),
        ]
        parts = []
        for al, ah, bl, bh, d, of in children:
            keep = of & (d <= most) & (al < ah) & (bl < bh)
            parts.append([x[keep] for x in (al, ah, bl, bh, d)])
        waiting.append((depth + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))


def forest_of(values: np.ndarray, depth: int, differ: int, split: int) -> list[tuple[int, int]]:
    """Spanning edges of the links within ``values``: before and after ``split`` are two
    nodes of the trie, or one if ``split`` is the length."""
    forest = _Forest(len(values))
    two = split < len(values)
    for i, j in trie_links(values[:split], values[split:] if two else None, depth, differ):
        forest.add(i, j + split if two else j)
    child = np.flatnonzero(forest.root != np.arange(len(values)))
    return values[child], values[forest.root[child]]


def _masks(bits: int) -> list[tuple[int, int]]:
    """(mask, set bits) of all masks of ``bits`` bits that the budget allows."""
    return [
        (sum(1 << i for i in chosen), n)
        for n in range(BUDGET + 1)
        for chosen in combinations(range(bits), n)
    ]


def _prefix(depth: int) -> Column:
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned("x", BITS - depth)


def deal(rows: DataFrame, depth: int, deeper: int) -> DataFrame:
    """``rows`` (``half, u, v, x``: x lies below node u or v) dealt to pairs of children."""
    most = HALF_BUDGET if deeper <= HALF else BUDGET
    masks = F.array(
        *(
            F.struct(F.lit(m).cast("long").alias("mask"), F.lit(n).alias("n"))
            for m, n in _masks(deeper - depth)
            if n <= most
        )
    )
    bits = deeper - depth
    other = F.when(_prefix(depth) == F.col("u"), F.col("v")).otherwise(F.col("u"))
    child = _prefix(deeper).bitwiseAND(F.lit((1 << bits) - 1))
    spread = rows.withColumn("m", F.explode(masks)).filter(
        F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) + F.col("m.n") <= most
    )
    mine = _prefix(deeper)
    theirs = F.shiftleft(other, bits).bitwiseOR(child.bitwiseXOR(F.col("m.mask")))
    return spread.select(
        "half", F.least(mine, theirs).alias("u"), F.greatest(mine, theirs).alias("v"), "x"
    )


def _halves_swapped(x: Column) -> Column:
    return F.shiftleft(x, HALF).bitwiseOR(F.shiftrightunsigned(x, HALF))


def _join(depth: int):
    def join(key, table):
        half, u, v = (k.as_py() for k in key)
        values = np.sort(table.column("x").to_numpy().view(np.uint64))
        split = len(values)
        if u != v:
            split = int(np.searchsorted(values >> np.uint64(BITS - depth), np.uint64(v)))
        a, b = forest_of(values, depth, (u ^ v).bit_count(), split) if 0 < split else ([], [])
        a, b = (np.asarray(x, np.uint64).view(np.int64) for x in (a, b))
        halves = pa.array(np.full(len(a), half, np.int32))
        return pa.table({"half": halves, "a": a, "b": b})

    return join


def hamming_links(distinct: DataFrame, aim: int = AIM, most: int = MOST) -> DataFrame:
    """``a, b``: edges that connect all fingerprints ``fp`` within the budget.

    ``distinct`` holds each fingerprint once. Prefixes get longer as it grows, so the
    groups stay as large; what a fingerprint is copied to grows with the prefix's bits.
    """
    count = distinct.count()
    depth = min(24, max(0, ceil(log2(max(1, count) / aim))))
    zero = F.lit(0).cast("long")
    rows = distinct.select(F.lit(0).alias("half"), zero.alias("u"), zero.alias("v"), F.col("fp").alias("x"))
    rows = rows.union(rows.select(F.lit(1), "u", "v", _halves_swapped(F.col("x"))))
    rows = deal(rows, 0, depth) if depth else rows
    found = []
    while True:
        sizes = rows.groupBy("half", "u", "v").agg(F.count("*").alias("n")).filter(F.col("n") > most)
        heavy = stored(sizes.select("half", "u", "v"), "heavy") if depth < BITS else None
        hot = heavy is not None and not heavy.isEmpty()
        light = rows.join(heavy, ["half", "u", "v"], "left_anti") if hot else rows
        found.append(
            light.groupBy("half", "u", "v").applyInArrow(_join(depth), "half int, a bigint, b bigint")
        )
        if not hot:
            break
        deeper = min(HALF, depth + 8) if depth < HALF else depth + 4
        rows = deal(rows.join(heavy, ["half", "u", "v"], "left_semi"), depth, deeper)
        depth = deeper
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    back = lambda c: F.when(F.col("half") == 1, _halves_swapped(F.col(c))).otherwise(F.col(c))
    return edges.select(back("a").alias("a"), back("b").alias("b"))


def _components(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` of each row of ``docs``, and ``root``, a fingerprint of its component.

    A fingerprint that very many copies share is met once by the join of tries, which
    sees distinct fingerprints only, and is the hot key of a plain join at the end.
    """
    marked = stored(fingerprints(docs), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = stored(connected_components(hamming_links(distinct)), "roots")
    linked = distinct.join(roots, F.col("fp") == F.col("node"))
    lowest = linked.groupBy("root").agg(F.min("first").alias("lowest"))
    of_linked = roots.join(lowest, "root").select("node", "lowest", "root")
    classes = stored(
        distinct.join(of_linked, F.col("fp") == F.col("node"), "left").select(
            F.col("fp").alias("of"),
            F.coalesce("lowest", "first").alias("component_id"),
            F.coalesce("root", "fp").alias("root"),
        ),
        "classes",
    )
    return marked.join(classes, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` of each row of ``docs``."""
    return _components(docs).drop("root")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest id, or of the null id if it has no other.

    Where the id alone does not name that row, since it is null or other rows have it too,
    the row's fingerprint does. Only if there are such rows are fingerprints computed anew,
    for these rows, and documents shuffled.
    """
    found = stored(_components(docs), "components")
    name = "_chosen"
    while any(column.lower().startswith(name) for column in docs.columns):
        name += "_"
    own_fp, chosen_fp = f"{name}_own_fp", f"{name}_fp"
    of_chosen = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = stored(
        of_chosen.groupBy("root", F.col("doc_id").alias(name)).agg(F.min("fp").alias(chosen_fp)).drop("root"),
        "chosen",
    )
    times = found.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    unclear = stored(times.filter("n > 1 or id is null").select("id"), "unclear")
    if unclear.isEmpty():
        return docs.join(chosen, F.col("doc_id") == F.col(name), "left_semi")
    single = chosen.join(unclear, F.col(name).eqNullSafe(F.col("id")), "left_anti")
    kept = docs.join(single, F.col("doc_id") == F.col(name), "left_semi")
    others = docs.alias("d").join(unclear.alias("u"), F.col("d.doc_id").eqNullSafe(F.col("u.id")), "left_semi")
    others = others.withColumn(own_fp, fingerprint_of(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col(name)) & (F.col(own_fp) == F.col(chosen_fp))
    others = others.join(chosen, same, "left_semi").dropDuplicates(["doc_id", own_fp])
    return kept.union(others.select(docs.columns))
