"""Odd rows that every operator has to take, and references to compare with."""

from __future__ import annotations

from pyspark.sql import Row

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Extra columns with names that operators use themselves.
EXTRA = ", score double, fp bigint, words array<string>, length int, label string, bucket int, x string"

LONG = " ".join(f"w{i % 977}{'abcdefg'[i % 7]}" for i in range(60_000))
ODD_TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "one two",
    "one\x1cone\x85one two　two",
    "Ünïcode ñandú 日本語 テスト 🙂🙂 ß İ ΣΑΣ x​y",
    "same words here again\nsame words here again\n\nsame words here again",
    "a b c d e a b c d e a b c d e f",
    "#$%& ||| *** <> #$%& ||| *** <> #$%&",
    "repeat " * 200,
    LONG,
]


def odd_rows():
    rows = [
        Row(doc_id=i, text=t, lang=None if i % 3 == 0 else "en", source=None if i % 4 == 0 else "s", n_chars=None)
        for i, t in enumerate(ODD_TEXTS)
    ]
    rows += [rows[4], rows[4], Row(doc_id=None, text="one two", lang="en", source="s", n_chars=7)]
    return rows


def odd_docs(spark, extra=True):
    """The odd rows; repeated ones, a null id and extra columns are among them."""
    docs = spark.createDataFrame(odd_rows(), DOCS)
    if extra:
        docs = docs.selectExpr(
            "*", "0.5 as score", "1L as fp", "array('a') as words", "1 as length", "'l' as label",
            "1 as bucket", "'x' as x",
        )
    return docs.repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def write_tables(spark, folder, **tables):
    """Write data frames as the tables of ``folder``."""
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
