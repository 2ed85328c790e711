"""Quality rules whose limits follow the data of each language and source.

Four measures of a text are gathered into mergeable quantile sketches, one for each
language, source and measure, and every document is joined to the limits that the sketches
of its own language and source give. Fixed cut-offs are only those of the base rules.

Word length has fences on both sides, ``fence`` times the distance of the quartiles from
them. Symbols, repeated lines and repeated words are zero in most texts and bad only when
high: their limit lies ``tail`` times the distance of the upper quartile and the 95th
percentile above the latter, and there is none below. No constant takes part in a limit:
where 95 in 100 texts of a source repeat no line, one that does is out, and where a
twentieth holds many symbols, they are usual there.

The sketch is a histogram of logarithmic buckets, each split into 128: value v falls in
the bucket of its 8 leading bits, so a quantile is off by less than 1/128 of itself, and
values are compared with limits by their buckets. Merging is adding counts, which does not
depend on the order, so a lost and repeated task gives the same limits. A sketch holds one
entry for each distinct text (by 64-bit hash) that passes the base rules, so neither junk
that is out anyway nor a large group of copies moves the limits. Each sketch is mixed with
its language's, which counts as ``prior`` further texts, and that one likewise with the
sketch of all: a source with few texts is judged by its language, one with many by itself,
and there is no size at which the one turns into the other.

Defined cases: a null text has no words; a null language or source is a group of its
own; repeated rows are each judged; a text without words has measures of zero and fails the
base rules; a group whose texts all fail them has no limits and keeps none; an empty table
gives no row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.common import SPACES, stored

# The base rules.
SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20

MEASURES = ("word_length", "symbols", "dup_lines", "repeats")
FENCED, TAILED = MEASURES[:1], MEASURES[1:]


def _neighbours_equal(items: Column, key: str) -> Column:
    """``at`` of those elements of the sorted ``items`` whose ``key`` a neighbour has too."""
    size = F.size(items)
    before = F.concat(F.array(F.lit(None)), F.slice(items, 1, size - 1))
    after = F.concat(F.slice(items, 2, size - 1), F.array(F.lit(None)))
    with_before = F.zip_with(
        items,
        before,
        lambda x, p: F.struct(
            x["at"].alias("at"), x[key].alias("key"), (x[key] == p[key]).alias("same")
        ),
    )
    marked = F.zip_with(
        with_before,
        after,
        lambda x, n: F.when(
            F.coalesce(x["same"], F.lit(False)) | F.coalesce(x["key"] == n[key], F.lit(False)),
            x["at"],
        ),
    )
    return F.filter(marked, lambda at: at.isNotNull())


def text_measures(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` with the counts of the base rules, ``n_lines`` and ``text_key``.

    Windows of five words are compared as 64-bit hashes first. Only in texts where a
    hash repeats are the windows themselves sorted and compared, so the count is exact.
    Each step is read twice by the next, which keeps Catalyst from merging the steps and
    computing the arrays anew for every element.
    """
    no_ints = F.array().cast("array<int>")
    text = F.coalesce(F.col("text"), F.lit(""))
    spaced = F.translate(text, SPACES[1:], " " * (len(SPACES) - 1))
    lines = F.filter(F.split("text_", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    start = docs.select(
        "doc_id",
        "lang",
        "source",
        F.xxhash64(text).alias("text_key"),
        text.alias("text_"),
        F.array_remove(F.split(spaced, " "), "").alias("words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        F.length(text).alias("chars"),
        F.length(F.translate(text, SYMBOLS, "")).alias("plain_chars"),
    )
    split = start.select(
        "doc_id",
        "lang",
        "source",
        "text_key",
        "words",
        "word_chars",
        (F.col("chars") - F.col("plain_chars")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.size("words").cast("long").alias("n_words"),
    )
    windows = F.when(
        F.size("words") >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)),
            lambda at: F.xxhash64(F.slice("words", at, WINDOW)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = split.select(
        "doc_id",
        "lang",
        "source",
        "text_key",
        "words",
        "word_chars",
        "n_symbols",
        "n_words",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("hashes"),
    )
    by_hash = F.sort_array(
        F.transform("hashes", lambda h, at: F.struct(h.alias("hash"), (at + 1).alias("at")))
    )
    kept = ["doc_id", "lang", "source", "text_key", "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines"]
    sorted_ = hashed.select(
        *kept,
        "words",
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), by_hash)
        .otherwise(F.array().cast("array<struct<hash:bigint,at:int>>"))
        .alias("by_hash"),
    )
    likely = sorted_.select(
        *kept,
        "words",
        F.when(F.size("by_hash") > 0, _neighbours_equal(F.col("by_hash"), "hash"))
        .otherwise(no_ints)
        .alias("likely"),
    )
    by_window = F.sort_array(
        F.transform(
            "likely",
            lambda at: F.struct(
                F.array_join(F.slice("words", at, WINDOW), " ").alias("window"), at.alias("at")
            ),
        )
    )
    exact = likely.select(
        *kept,
        F.when((F.size("words") > 0) & (F.size("likely") > 0), by_window)
        .otherwise(F.array().cast("array<struct<window:string,at:int>>"))
        .alias("by_window"),
    )
    found = exact.select(
        *kept,
        F.when(
            F.size("by_window") > 0,
            F.sort_array(_neighbours_equal(F.col("by_window"), "window")),
        )
        .otherwise(no_ints)
        .alias("found"),
    )
    steps = F.zip_with(
        F.slice("found", 1, F.size("found") - 1),
        F.slice("found", 2, F.size("found") - 1),
        lambda a, b: F.least(F.lit(WINDOW), b - a),
    )
    covered = F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda s, x: s + x)
    return found.select(
        *kept,
        F.when(F.size("found") > 0, covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def with_base_rules(measured: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return measured.withColumn("base_failed", failed)


def _per_thousand(column: str, of: str) -> Column:
    return F.expr(f"{column} * 1000 div greatest({of}, 1)")


def _bucket(value: Column) -> Column:
    """Values under 256 as they are; above, the lowest value with the same 8 leading bits."""
    drop = F.greatest(F.length(F.bin(value)) - 8, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def quantile_sketches(measured: DataFrame) -> DataFrame:
    """``lang, source, measure, bucket, n``: one sketch for each of the first three.

    Each task drops the copies it sees before the distinct texts are dealt out.
    """
    distinct = measured.filter("not base_failed").select("lang", "source", "text_key", *MEASURES).distinct()
    entries = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES))
    return (
        distinct.select("lang", "source", F.explode(entries).alias("x"))
        .select("lang", "source", "x.measure", _bucket(F.col("x.value")).alias("bucket"))
        .groupBy("lang", "source", "measure", "bucket")
        .agg(F.count("*").alias("n"))
    )


def mixed_quantiles(sketches: DataFrame, prior: int) -> DataFrame:
    """``lang, source, measure`` with ``q25, q75, q95`` of each sketch mixed with its language's.

    With the counts n of a bucket in the sketch, l in its language's and a in all, and their
    totals N, L and A, the bucket's mass is n A (L + prior) + prior (l A + prior a), which is a
    whole number; all masses are A (L + prior) (N + prior). Each sketch is laid out over all
    buckets of its measure; the logarithm bounds these to some thousands.
    """
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    own_total = sketches.groupBy("lang", "source", "measure").agg(F.sum("n").alias("own_total"))
    by_lang = sketches.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("lang_n"))
    lang_total = sketches.groupBy("lang", "measure").agg(F.sum("n").alias("lang_total"))
    of_all = sketches.groupBy("measure", "bucket").agg(F.sum("n").alias("all_n"))
    all_total = sketches.groupBy("measure").agg(F.sum("n").alias("all_total"))
    same = lambda row, other, *keys: [F.col(k).eqNullSafe(F.col(f"{other}_{k}")) for k in keys]
    named = lambda df, as_, *keys: df.withColumnsRenamed({k: f"{as_}_{k}" for k in keys})
    grid = (
        own_total.join(named(lang_total, "t", "lang", "measure"), same("", "t", "lang", "measure"))
        .drop("t_lang", "t_measure")
        .join(F.broadcast(of_all.join(all_total, "measure")), "measure")
    )
    masses = (
        grid.join(
            named(sketches, "s", "lang", "source", "measure", "bucket"),
            same("", "s", "lang", "source", "measure", "bucket"),
            "left",
        )
        .join(
            named(by_lang, "l", "lang", "measure", "bucket"), same("", "l", "lang", "measure", "bucket"), "left"
        )
        .select(
            "lang",
            "source",
            "measure",
            "bucket",
            (
                F.coalesce(whole("n"), F.lit(0)) * whole("all_total") * (whole("lang_total") + prior)
                + prior * (F.coalesce(whole("lang_n"), F.lit(0)) * whole("all_total") + prior * whole("all_n"))
            ).cast("decimal(38,0)").alias("mass"),
            (whole("all_total") * (whole("lang_total") + prior) * (whole("own_total") + prior))
            .cast("decimal(38,0)")
            .alias("total"),
        )
    )
    by = Window.partitionBy("lang", "source", "measure").orderBy("bucket")
    below = masses.withColumn("below", F.sum("mass").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    reached = lambda q: F.min(F.when(100 * F.col("below") >= q * F.col("total"), F.col("bucket")))
    return below.groupBy("lang", "source", "measure").agg(
        reached(25).alias("q25"), reached(75).alias("q75"), reached(95).alias("q95")
    )


def adaptive_limits(sketches: DataFrame, prior: int = 20, fence: int = 5, tail: int = 1) -> DataFrame:
    """``lang, source`` with ``max_`` of each measure, and ``min_`` of those with two fences.

    The rows grow with the pairs of language and source, not with the documents.
    """
    spread = F.col("q75") - F.col("q25")
    low = F.col("q25") - fence * spread
    high = F.when(F.col("measure").isin(*FENCED), F.col("q75") + fence * spread).otherwise(
        F.col("q95") + tail * (F.col("q95") - F.col("q75"))
    )
    limits = mixed_quantiles(sketches, prior).select(
        "lang", "source", "measure", low.alias("low"), high.alias("high")
    )
    one = lambda side, m: F.max(F.when(F.col("measure") == m, F.col(side)))
    return limits.groupBy("lang", "source").agg(
        *(one("low", m).alias(f"min_{m}") for m in FENCED),
        *(one("high", m).alias(f"max_{m}") for m in MEASURES),
    )


def quality_rules(docs: DataFrame, prior: int = 20, fence: int = 5, tail: int = 1) -> DataFrame:
    """The counts, ``base_failed`` and ``kept`` of every document, with its measures.

    The texts are read once: their counts are stored without them, and both the
    sketches and the join start from there. The sketches are stored as well, as they are
    added up by language and in all.
    """
    measured = with_base_rules(text_measures(docs)).withColumns(
        {
            "word_length": _per_thousand("word_chars", "n_words"),
            "symbols": _per_thousand("n_symbols", "n_words"),
            "dup_lines": _per_thousand("n_dup_lines", "n_lines"),
            "repeats": _per_thousand("n_repeat_words", "n_words"),
        }
    )
    measured = stored(measured, "quality")
    sketches = stored(quantile_sketches(measured), "sketches")
    limits = adaptive_limits(sketches, prior, fence, tail).withColumnsRenamed(
        {"lang": "of_lang", "source": "of_source"}
    )
    within = F.lit(True)
    for m in MEASURES:
        within = within & (_bucket(F.col(m)) <= F.col(f"max_{m}"))
    for m in FENCED:
        within = within & (_bucket(F.col(m)) >= F.col(f"min_{m}"))
    return measured.join(
        limits,
        F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")),
        "left",
    ).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"),
        *MEASURES,
    )


# The same in DuckDB, from the contract and the rules above; {prior}, {fence} and {tail} as there.
QUALITY_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, lang, source, coalesce(text, '') AS text
  FROM documents),
words AS (
  SELECT row_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM docs),
numbered AS (SELECT row_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM words),
windows AS (
  SELECT row_id, k, word || ' ' || lead(word, 1) OVER t || ' ' || lead(word, 2) OVER t || ' '
         || lead(word, 3) OVER t || ' ' || lead(word, 4) OVER t AS win
  FROM numbered WINDOW t AS (PARTITION BY row_id ORDER BY k)),
repeated AS (
  SELECT row_id, k FROM (
    SELECT row_id, k, count(*) OVER (PARTITION BY row_id, win) AS n FROM windows WHERE win IS NOT NULL) WHERE n > 1),
covered AS (
  SELECT row_id, count(DISTINCT pos) AS n
  FROM (SELECT row_id, unnest([k, k+1, k+2, k+3, k+4]) AS pos FROM repeated) GROUP BY row_id),
counted AS (
  SELECT d.doc_id, d.lang, d.source, d.text, len(w.w)::BIGINT AS n_words,
         coalesce(length(array_to_string(w.w, '')), 0)::BIGINT AS word_chars,
         (length(d.text) - length(translate(d.text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(w.l) - len(list_distinct(w.l)))::BIGINT AS n_dup_lines,
         len(w.l)::BIGINT AS n_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM docs d JOIN words w USING (row_id) LEFT JOIN covered c USING (row_id)),
measured AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         word_chars * 1000 // greatest(n_words, 1) AS word_length,
         n_symbols * 1000 // greatest(n_words, 1) AS symbols,
         n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines,
         n_repeat_words * 1000 // greatest(n_words, 1) AS repeats
  FROM counted),
bucketed AS (
  SELECT *, (word_length >> greatest(length(bin(word_length)) - 8, 0)) << greatest(length(bin(word_length)) - 8, 0) AS b1,
         (symbols >> greatest(length(bin(symbols)) - 8, 0)) << greatest(length(bin(symbols)) - 8, 0) AS b2,
         (dup_lines >> greatest(length(bin(dup_lines)) - 8, 0)) << greatest(length(bin(dup_lines)) - 8, 0) AS b3,
         (repeats >> greatest(length(bin(repeats)) - 8, 0)) << greatest(length(bin(repeats)) - 8, 0) AS b4
  FROM measured),
sketch AS (
  SELECT lang, source, x.m AS measure, x.b AS bucket, count(*)::HUGEINT AS n
  FROM (SELECT lang, source, unnest([{{'m': 1, 'b': b1}}, {{'m': 2, 'b': b2}}, {{'m': 3, 'b': b3}},
               {{'m': 4, 'b': b4}}]) AS x
        FROM (SELECT DISTINCT lang, source, text, b1, b2, b3, b4 FROM bucketed WHERE NOT base_failed))
  GROUP BY ALL),
own AS (SELECT lang, source, measure, sum(n) AS own_total FROM sketch GROUP BY ALL),
by_lang AS (SELECT lang, measure, bucket, sum(n) AS lang_n FROM sketch GROUP BY ALL),
by_all AS (SELECT measure, bucket, sum(n) AS all_n FROM sketch GROUP BY ALL),
lang_totals AS (SELECT lang, measure, sum(n) AS lang_total FROM sketch GROUP BY ALL),
all_totals AS (SELECT measure, sum(n) AS all_total FROM sketch GROUP BY ALL),
masses AS (
  SELECT o.lang, o.source, o.measure, a.bucket,
         coalesce(s.n, 0) * t.all_total * (v.lang_total + {prior})
           + {prior} * (coalesce(l.lang_n, 0) * t.all_total + {prior} * a.all_n) AS mass,
         t.all_total * (v.lang_total + {prior}) * (o.own_total + {prior}) AS total
  FROM own o JOIN by_all a USING (measure) JOIN all_totals t USING (measure)
  JOIN lang_totals v ON v.lang IS NOT DISTINCT FROM o.lang AND v.measure = o.measure
  LEFT JOIN sketch s ON s.lang IS NOT DISTINCT FROM o.lang AND s.source IS NOT DISTINCT FROM o.source
    AND s.measure = o.measure AND s.bucket = a.bucket
  LEFT JOIN by_lang l ON l.lang IS NOT DISTINCT FROM o.lang AND l.measure = o.measure AND l.bucket = a.bucket),
below AS (
  SELECT *, sum(mass) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS below FROM masses),
quantiles AS (
  SELECT lang, source, measure, min(bucket) FILTER (100 * below >= 25 * total) AS q25,
         min(bucket) FILTER (100 * below >= 75 * total) AS q75, min(bucket) FILTER (100 * below >= 95 * total) AS q95
  FROM below GROUP BY ALL),
limits AS (
  SELECT lang, source, max(q25 - {fence} * (q75 - q25)) FILTER (measure = 1) AS lo1,
         max(q75 + {fence} * (q75 - q25)) FILTER (measure = 1) AS hi1,
         max(q95 + {tail} * (q95 - q75)) FILTER (measure = 2) AS hi2,
         max(q95 + {tail} * (q95 - q75)) FILTER (measure = 3) AS hi3,
         max(q95 + {tail} * (q95 - q75)) FILTER (measure = 4) AS hi4
  FROM quantiles GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(b1 BETWEEN lo1 AND hi1 AND b2 <= hi2 AND b3 <= hi3 AND b4 <= hi4, false) AS kept,
       word_length, symbols, dup_lines, repeats
FROM bucketed m LEFT JOIN limits t
  ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source
"""
