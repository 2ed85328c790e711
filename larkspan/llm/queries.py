"""One query for each operator, over its whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path as tokenizer_path

from larkspan.llm import (
    bpe,
    chat,
    decontam,
    divergence,
    langid,
    licenses,
    packing,
    quality,
    resampling,
    secret_scan,
    simhash,
    toxicity,
    warc,
)
from larkspan.llm.common import new_folder, with_package
from larkspan.sources import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def fold(of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(fold(5) != 0))
    found = langid.predict(F.col("text"), model)
    return docs.select("doc_id", found.alias("x"), F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out")).select(
        "doc_id", "held_out", F.col("x.lang").alias("lang_pred"), "x.score"
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.packed_documents(docs, tokenizer_path("word_bpe_49k.json"))


def _joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select(
        "doc_id", secret_scan.secrets_of(F.col("text")).alias("found")
    )
    of_kind = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"] != "literal")
    return found.select(
        "doc_id",
        *(of_kind(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(_joined_spans(base), 256).alias("base_sha256"),
        _joined_spans(F.col("found")).alias("spans"),
    )


def op5_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select(
        "doc_id", licenses.license_scan(F.col("text")).alias("x")
    )
    return found.select(
        "doc_id",
        "x.n_words",
        F.size("x.places").cast("long").alias("n_base"),
        F.array_min("x.places").alias("first_word"),
        F.array_max("x.places").alias("last_word"),
        F.array_join("x.base_labels", ",").alias("base_labels"),
        F.array_join("x.labels", ",").alias("labels"),
        "x.score",
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs.filter(fold(4) != 2), table(spark, sf_dir, "labels"))
    scored = docs.select(
        "doc_id",
        F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"),
        toxicity.score(F.col("text"), model).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds, and for no other."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered dialogues, their masks as ``start:end`` joined by commas."""
    spans = F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"]))
    return chat.rotated_dialogues(table(spark, sf_dir, "conversations")).withColumn(
        "mask", F.array_join(spans, ",")
    )


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to bundles in the shared folder and read back from them."""
    folder = new_folder(spark, "warc")
    records = warc.with_record_types(table(spark, sf_dir, "pages"))
    manifest = warc.write_bundles(records, folder)
    return warc.read_bundles(manifest, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, and the ids decoded."""
    found = table(spark, sf_dir, "documents").select(
        "doc_id", bpe.round_trip(F.col("text"), tokenizer_path("word_bpe_49k.json")).alias("x")
    )
    digits = F.array_join(F.col("x.ids").cast("array<string>"), " ")
    return found.select(
        "doc_id",
        F.size("x.ids").cast("long").alias("n_tokens"),
        F.sha2(digits, 256).alias("ids_sha256"),
        F.sha2("x.text", 256).alias("decoded_sha256"),
    )


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resampling.importance_resampling(docs, target)


CHAT_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role,
         replace(coalesce(text, ''), '<|', '< |') AS body, coalesce(text, '') AS text
  FROM conversations),
views AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'),
heads AS (
  SELECT t.*, v.perspective,
         CASE WHEN t.role = 'system' THEN '<|im_start|>system' || chr(10)
              WHEN t.role = v.perspective THEN '<|im_start|>assistant' || chr(10)
              ELSE '<|im_start|>user name=' || replace(t.role, '<|', '< |') || chr(10) END AS head
  FROM turns t JOIN views v ON t.conv_id IS NOT DISTINCT FROM v.conv_id),
segments AS (
  SELECT *, head || body || '<|im_end|>' || chr(10) AS segment,
         row_number() OVER w AS seq,
         sum(length(head) + length(body) + 11) OVER w AS e
  FROM heads WINDOW w AS (PARTITION BY conv_id, perspective
    ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
parts AS (
  SELECT *, e - length(segment) AS s, (e - length(segment)) // 1048576 AS part FROM segments),
firsts AS (SELECT *, min(s) OVER (PARTITION BY conv_id, perspective, part) AS f FROM parts)
SELECT conv_id, perspective, part::BIGINT AS part, count(*)::BIGINT AS n_turns,
       string_agg(segment, '' ORDER BY seq) AS text,
       coalesce(string_agg((s + length(head) - f)::BIGINT || ':' || (e - f)::BIGINT, ',' ORDER BY seq)
                FILTER (role = perspective), '') AS mask
FROM firsts GROUP BY conv_id, perspective, part
"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex,
             max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)),
         '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

OPERATORS = (
    op1_quality_rules,
    op2_language_id,
    op3_best_fit_packing,
    op4_secret_scan,
    op5_simhash_trie,
    op6_chat_rotation,
    op7_warc_bundles,
    op8_license_scan,
    op9_toxicity,
    op10_decontamination,
    op11_source_divergence,
    op12_bpe_round_trip,
    op13_importance_resampling,
)

QUERIES = {query.__name__: with_package(query) for query in OPERATORS}

ORACLES = {
    "op1_quality_rules": quality.QUALITY_SQL.format(prior=20, fence=5, tail=1),
    "op6_chat_rotation": CHAT_SQL,
    "op7_warc_bundles": WARC_SQL,
    "op11_source_divergence": divergence.DIVERGENCE_SQL,
    "op13_importance_resampling": resampling.RESAMPLING_SQL,
}
