"""Source divergence audit by one-hot level products.

A group is a language and a source. A term's count in a group is its level there; levels
have prices (smoothed shares in parts of 10^9), so how far two groups lie apart follows
from how many terms have level l in the one and level m in the other. For a block of terms,
each (group, level) that occurs is an indicator column with a one for every term of that
level, and the product of these columns with their transpose holds the joint tables of all
pairs of groups at once. Blocks are cut so that at most ``COLUMNS`` columns occur (or one
term has more), columns are multiplied in tiles of so many, and a product counts at most
``ROWS`` terms, which single precision holds exactly.

Level 0 is no column: of the terms at level l in one group, those that the other group lacks
are all of that level less those in the joint table. So a cell (l, m) is priced at
f(l, m) - f(l, 0) - f(0, m) + f(0, 0), and f(l, 0), f(0, m) and f(0, 0) are added for whole
levels and groups. The work grows with the terms that groups really have. Only sums for
pairs of groups leave a task.

f(p, q) = (p - q)^2 div q is a whole number, and all sums are exact: 64 bits hold any sum
over the terms of a language, as the p of a group add up to 10^9 and its terms at most.

Defined cases: null text, language and source are read as empty text; repeated rows each
count; a group whose texts hold no kept term has count 0 for each; a language without kept
terms has pairs of value 0 and no term rows; an empty table gives no row. Other columns are
ignored. A text is held whole; a task holds the counts of ``ENTRIES`` terms of groups at
most before it passes them on.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.common import stored

UNIT = 1_000_000_000
ENTRIES, ROWS, COLUMNS = 400_000, 4096, 512
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalpha())
TO_TERMS = bytes.maketrans(
    SEPARATORS + bytes(range(ord("A"), ord("Z") + 1)),
    b" " * len(SEPARATORS) + bytes(range(ord("a"), ord("z") + 1)),
)
COUNTS = "lang string, source string, term string, n bigint, docs bigint"
PRICES = "lang string, source string, item string, value bigint"


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, A-Z in lower case, and of all characters beyond ASCII."""
    return (text or b"").translate(TO_TERMS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """``COUNTS``: occurrences of each term in each group, and the documents that have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs_with) in found.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                same = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in (lang, source)]
                counts = [pa.array(x, pa.int64()) for x in (list(n.values()), [docs_with[t] for t in n])]
                names = ["lang", "source", "term", "n", "docs"]
                yield pa.RecordBatch.from_arrays([*same, terms, *counts], names)
            found.clear()

        held = 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for group, text in zip(zip(langs, sources, strict=True), texts, strict=True):
                terms = terms_of(text)
                n, docs_with = found[group]
                held -= len(n)
                n.update(terms)
                docs_with.update(set(terms))
                held += len(n)
                if held >= ENTRIES:
                    yield from rows()
                    held = 0
        yield from rows()

    empty = F.lit("")
    parts = docs.select(
        F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), "text"
    ).mapInArrow(count, COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int = 3) -> DataFrame:
    """The ``counts`` of terms in at least ``min_docs`` documents of their language.

    ``lang_n`` is the term's count in the language; ``first`` marks one row of each term.
    A term has a row for each source, so no window is longer than there are sources.
    """
    term = Window.partitionBy("lang", "term")
    return (
        counts.withColumns(
            {
                "lang_docs": F.sum("docs").over(term),
                "lang_n": F.sum("n").over(term),
                "first": F.row_number().over(term.orderBy("source")) == 1,
            }
        )
        .filter(F.col("lang_docs") >= min_docs)
        .select("lang", "source", "term", "n", "lang_n", "first")
    )


def price(n: Column, total: Column) -> Column:
    """1 + floor(10^9 (n + 1) / total), exactly; null for an empty total."""
    share = F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    return F.when(total > 0, 1 + F.call_function("div", share, total.cast("decimal(19,0)")))


def gap(p: Column, q: Column) -> Column:
    """f(p, q) = floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, source`` of every group, ``total`` = N + V, its terms, ``lang_terms`` = V,
    ``lang_total`` and ``p0``, the price of level 0. A row for each group."""
    empty = F.lit("")
    groups = docs.select(
        F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source")
    ).distinct()
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("terms"))
    of_lang = kept.filter("first").groupBy("lang").agg(
        F.count("*").alias("lang_terms"), F.sum("lang_n").alias("lang_n")
    )
    zero = F.lit(0)
    return (
        groups.join(of_group, ["lang", "source"], "left")
        .join(of_lang, "lang", "left")
        .select(
            "lang",
            "source",
            F.coalesce("terms", zero).alias("terms"),
            F.coalesce("lang_terms", zero).alias("lang_terms"),
            (F.coalesce("n", zero) + F.coalesce("lang_terms", zero)).alias("total"),
            (F.coalesce("lang_n", zero) + F.coalesce("lang_terms", zero)).alias("lang_total"),
        )
        .withColumn("p0", price(F.lit(0), F.col("total")))
    )


def joint_tables(rows: np.ndarray, columns: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(column, column, terms that have both), for the ones of an indicator matrix.

    A one is at each of ``rows`` and ``columns``. The matrix is multiplied with its own
    transpose, tile by tile; only products that are not zero are given.
    """
    height = int(rows.max(initial=-1)) + 1
    tiles = []
    for low in range(0, width, COLUMNS):
        mine = (columns >= low) & (columns < low + COLUMNS)
        tile = np.zeros((height, min(COLUMNS, width - low)), np.float32)
        tile[rows[mine], columns[mine] - low] = 1
        tiles.append((low, tile))
    for low_a, a in tiles:
        for low_b, b in tiles:
            product = a.T @ b
            left, right = np.nonzero(product)
            yield left + low_a, right + low_b, product[left, right].astype(np.int64)


def _blocks(sizes: np.ndarray, columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of terms, each of at most ``ROWS`` and of at most ``COLUMNS`` distinct columns."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    low, seen = 0, set()
    for row in range(len(sizes)):
        mine = set(columns[starts[row] : starts[row + 1]].tolist())
        if row > low and (row - low >= ROWS or len(seen | mine) > COLUMNS):
            yield low, row
            low, seen = row, set()
        seen |= mine
    if low < len(sizes):
        yield low, len(sizes)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _added_up(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct key and the sum of its values."""
    distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, of, np.concatenate(values))
    return distinct, total


def pair_prices(sources: np.ndarray, n: np.ndarray, p: np.ndarray, p0: np.ndarray, sizes: np.ndarray):
    """(source, source, price of all cells of their joint table), for terms of one language.

    The entries (``sources`` as numbers, level ``n``, prices) are those of one term after
    the other, ``sizes`` of each. Terms of like frequency come together, as they have few
    columns. Given are sources that have a term in common.
    """
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(np.add.reduceat(n, starts), kind="stable") if len(sizes) else starts
    sizes, moved = sizes[order], np.repeat(starts[order], sizes[order])
    moved += np.arange(len(moved)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    sources, n, p, p0 = sources[moved].astype(np.int64), n[moved], p[moved], p0[moved]
    columns, of_entry = np.unique(np.stack([sources, n]), axis=1, return_inverse=True)
    of_entry = of_entry.ravel()
    price_of, zero_of = np.zeros((2, columns.shape[1]), np.int64)
    price_of[of_entry], zero_of[of_entry] = p, p0
    width = int(sources.max(initial=-1)) + 1
    keys, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    held = 0
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for low, high in _blocks(sizes, of_entry):
        own = slice(starts[low], starts[high])
        used, local = np.unique(of_entry[own], return_inverse=True)
        rows = np.repeat(np.arange(high - low), sizes[low:high])
        for a, b, terms in joint_tables(rows, local, len(used)):
            a, b = used[a], used[b]
            left, right, zero_left, zero_right = price_of[a], price_of[b], zero_of[a], zero_of[b]
            cell = _gap(left, right) - _gap(left, zero_right) - _gap(zero_left, right) + _gap(zero_left, zero_right)
            found = _added_up([columns[0, a] * width + columns[0, b]], [terms * cell])
            keys.append(found[0])
            values.append(found[1])
            held += len(found[0])
            if held > ENTRIES:
                keys, values = ([x] for x in _added_up(keys, values))
                held = len(keys[0])
    pairs, total = _added_up(keys, values)
    return pairs // max(1, width), pairs % max(1, width), total


def _joint_sums(priced: DataFrame) -> DataFrame:
    """``PRICES`` of what the joint tables of levels above 0 say, added up per task and block."""
    entry = F.struct("source", "n", "p", "p0")
    terms = priced.groupBy("lang", "term").agg(F.sort_array(F.collect_list(entry)).alias("entries"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for number, lang in enumerate(langs.dictionary.to_pylist()):
                lists = batch.column(1).filter(pc.equal(langs.indices, number))
                flat = lists.flatten()
                named = flat.field("source").dictionary_encode()
                names = named.dictionary.to_pylist()
                whole = lambda name: flat.field(name).to_numpy()  # noqa: B023, E731
                a, b, total = pair_prices(
                    named.indices.to_numpy(),
                    *map(whole, ("n", "p", "p0")),
                    pc.list_value_length(lists).to_numpy(),
                )
                other = a != b
                a, b, total = a[other], b[other], total[other]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(pa.scalar(lang, pa.string()), len(a)),
                        pa.array([names[i] for i in a], pa.string()),
                        pa.array([names[i] for i in b], pa.string()),
                        pa.array(total),
                    ],
                    ["lang", "source", "item", "value"],
                )

    return terms.select("lang", "entries").mapInArrow(multiply, PRICES)


def _rank(within: list[str]) -> Column:
    order = Window.partitionBy("lang", "source", *within).orderBy(F.desc("value"), "item")
    return F.row_number().over(order)


def divergence_of_pairs(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """``PRICES`` of each group and each other source of its language."""
    other = groups.select(
        F.col("lang").alias("o_lang"), F.col("source").alias("item"), F.col("terms").alias("o_terms"),
        F.col("p0").alias("o_p0"),
    )
    beside = lambda rows: rows.join(other, (F.col("lang") == F.col("o_lang")) & (F.col("source") != F.col("item")))
    value = lambda x: F.sum(x).alias("value")
    levels = priced.groupBy("lang", "source", "n", "p", "p0").agg(F.count("*").alias("terms"))
    by_pair = beside(levels).groupBy("lang", "source", "item").agg(
        F.sum(F.col("terms") * gap(F.col("p"), F.col("o_p0"))).alias("there"),
        F.sum(F.col("terms") * gap(F.col("o_p0"), F.col("p"))).alias("here"),
    )
    lacking = F.col("lang_terms") - F.col("terms") - F.col("o_terms")
    none = beside(groups).select(
        "lang", "source", "item", F.coalesce(lacking * gap(F.col("p0"), F.col("o_p0")), F.lit(0)).alias("value")
    )
    parts = (
        none.unionByName(_joint_sums(priced))
        .unionByName(by_pair.select("lang", "source", "item", F.col("there").alias("value")))
        .unionByName(
            by_pair.select(
                "lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("here").alias("value")
            )
        )
    )
    return parts.groupBy("lang", "source", "item").agg(value("value"))


def source_divergence(docs: DataFrame, min_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each group is from each other source
    of its language (part ``pair``), and by which terms it exceeds its language (part ``term``,
    the ``top_terms`` highest)."""
    kept = stored(kept_terms(term_counts(docs), min_docs), "terms")
    groups = stored(group_totals(docs, kept), "groups")
    of_group = groups.select(
        F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "total", "lang_total", "p0"
    )
    priced = kept.join(
        of_group, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source"))
    ).select("lang", "source", "term", "n", price(F.col("n"), F.col("total")).alias("p"), "p0",
             price(F.col("lang_n"), F.col("lang_total")).alias("q"))
    terms = (
        priced.filter(F.col("p") > F.col("q"))
        .select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", _rank([]))
        .filter(F.col("rank") <= top_terms)
    )
    pairs = divergence_of_pairs(priced, groups).withColumn("rank", _rank([]))
    columns = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(terms, "term"))


# The same in DuckDB, by the definition: a row for each group, other source and kept term.
DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
found AS (
  SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM found GROUP BY ALL HAVING count(DISTINCT row_id) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM found GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
whole AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n::HUGEINT AS lang_n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
priced AS (
  SELECT w.lang, w.source, w.term, w.n,
         1 + (1000000000 * (w.n + 1)) // (sum(w.n) OVER (PARTITION BY w.lang, w.source) + v.v) AS p,
         1 + (1000000000 * (w.lang_n + 1)) // (v.n + v.v) AS q
  FROM whole w JOIN v USING (lang)),
pairs AS (
  SELECT g.lang, g.source, o.source AS item, coalesce(x.value, 0) AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
             FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
             GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.item = o.source),
terms AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM priced WHERE n > 0 AND p > q),
both_parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM both_parts)
WHERE part = 'pair' OR rank <= 200
"""
