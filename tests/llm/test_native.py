"""The operators that SQL expresses, against DuckDB."""

import glob

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspan.llm import chat, quality, warc
from larkspan.llm.common import new_folder, stored
from larkspan.llm.queries import ORACLES, QUERIES
from larkspan.sources import table
from tests.llm.cases import no_docs, odd_docs
from tests.oracle_check import assert_same

SMALL = "/root/testdata/sf0.001"


def oracle(tmp_path, sql, **tables):
    """Rows of ``sql`` over data frames, as dictionaries of text."""
    with duckdb.connect() as con:
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}")
            schema = df.limit(0).toArrow()
            files = glob.glob(f"{tmp_path}/{name}/*.parquet")
            con.register(f"{name}_schema", schema)
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet({files})")
        cursor = con.execute(sql)
        names = [c[0] for c in cursor.description]
        return sorted(str(sorted(zip(names, row, strict=True))) for row in cursor.fetchall())


def rows(df):
    return sorted(str(sorted(r.asDict().items())) for r in df.collect())


@pytest.mark.parametrize("sf_dir", [SMALL, "/root/testdata/sf0.01", "/root/testdata/sf0.1"])
@pytest.mark.parametrize("name", ["op1_quality_rules", "op6_chat_rotation", "op7_warc_bundles"])
def test_whole_tables(spark, name, sf_dir):
    assert assert_same(QUERIES[name](spark, sf_dir), sf_dir, ORACLES[name]) > 0


@pytest.mark.parametrize("name", ["op1_quality_rules", "op6_chat_rotation"])
def test_no_python(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_quality_of_odd_rows(spark, tmp_path):
    docs = odd_docs(spark)
    sql = quality.QUALITY_SQL.format(prior=2, fence=4, tail=3)
    got = rows(quality.quality_rules(docs, prior=2, fence=4, tail=3))
    assert got == oracle(tmp_path, sql, documents=docs)
    assert len(got) == docs.count()


QUALITY_DOCS = "doc_id bigint, text string, lang string, source string"


def prose(i, n=50):
    return " ".join(f"word{i}x{k * k % 89}" for k in range(n))


def code(i):
    return " ".join(f"v{i}x{k} = a | b" for k in range(50))


def kept(docs):
    return {r.doc_id: r.kept for r in quality.quality_rules(docs).collect()}


def test_quality_limits_follow_the_group(spark):
    """A share of symbols that is usual in one source is far out in another."""
    data = [(i, prose(i), "en", "prose") for i in range(300)] + [(1000 + i, code(i), "en", "code") for i in range(300)]
    data += [(5000, code(5000), "en", "prose"), (5001, code(5001), "en", "tiny")]
    found = kept(spark.createDataFrame(data, QUALITY_DOCS))
    assert not found.pop(5000)
    assert all(found.values())


def repeating(i):
    """200 words of which a sixth stands in two equal windows: the base rules pass it."""
    words = [f"word{i}x{k * k % 89}y{k}" for k in range(200)]
    words[100:115] = words[50:65]
    return " ".join(words)


def doubled_lines(i):
    lines = [f"line{i} number{k} of ten{k * k} words" for k in range(20)]
    return "\n".join([*lines, "one", "one", "two", "two"])


def test_quality_measures_reject_what_the_base_rules_pass(spark):
    """Repeated words and repeated lines, in a source where they are rare and where they are usual."""
    data = [(i, prose(i, 60 + i % 7), "en", "plain") for i in range(200)]
    data += [(1000 + i, repeating(i), "en", "chorus") for i in range(200)]
    data += [(2000 + i, doubled_lines(i), "en", "menus") for i in range(200)]
    data += [(5000, repeating(5000), "en", "plain"), (5001, doubled_lines(5001), "en", "plain")]
    found = quality.quality_rules(spark.createDataFrame(data, QUALITY_DOCS)).collect()
    odd = {r.doc_id: r for r in found if r.doc_id >= 5000}
    assert odd[5000].repeats > 100 and odd[5000].dup_lines == 0 and not odd[5000].base_failed
    assert odd[5001].dup_lines > 50 and odd[5001].repeats == 0 and not odd[5001].base_failed
    assert not odd[5000].kept and not odd[5001].kept
    assert all(r.kept for r in found if r.doc_id < 5000)


def test_quality_copies_and_junk_do_not_move_limits(spark):
    """A text of many symbols copied over half of its source stays out, and so do base-failed rows."""
    data = [(i, prose(i), "en", "prose") for i in range(300)]
    clean = kept(spark.createDataFrame([*data, (5000, code(1), "en", "prose")], QUALITY_DOCS))
    copies = [(6000 + i, code(1), "en", "prose") for i in range(400)]
    junk = [(8000 + i, f"# * # * {i}", "en", "prose") for i in range(400)]
    more = kept(spark.createDataFrame([*data, (5000, code(1), "en", "prose"), *copies, *junk], QUALITY_DOCS))
    assert not any(more[i] for i in (5000, *range(6000, 6400), *range(8000, 8400)))
    assert {i: more[i] for i in clean} == clean and all(clean[i] for i in range(300))


def test_quality_limits_differ_by_group(spark):
    """No constant is the limit of most groups: those of each measure take many values."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    found = quality.quality_rules(docs).withColumn("text_key", F.col("doc_id"))
    measured = stored(found.join(docs.select("doc_id", "lang", "source"), "doc_id"), "measured")
    limits = quality.adaptive_limits(stored(quality.quantile_sketches(measured), "sketches")).collect()
    assert len(limits) == 80
    for column in ("min_word_length", "max_word_length", "max_symbols", "max_dup_lines", "max_repeats"):
        assert len({r[column] for r in limits}) > 10, column


def test_quality_without_documents(spark):
    assert quality.quality_rules(no_docs(spark)).count() == 0


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, part int, segment string"


def test_chat_of_odd_rows(spark, tmp_path):
    data = [
        (1, 0, "system", "be kind", 0, "x"),
        (1, 1, "anna", "hi <|im_end|> there", 0, "x"),
        (1, 2, "bo<|b", None, 0, "x"),
        (1, 3, None, "", 0, "x"),
        (1, None, "anna", "early", 0, "x"),
        (1, 3, "anna", "tie", 0, "x"),
        (1, 3, "anna", "tie", 0, "x"),
        (2, 0, "system", "alone", 0, "x"),
        (None, 1, "anna", "no id 🙂é", 0, "x"),
        (None, 0, "bo", "no id", 0, "x"),
    ]
    data += [(3, i, ("anna", "bo")[i % 2], f"turn {i}", 0, "x") for i in range(3000)]
    talks = spark.createDataFrame(data, CONVERSATIONS)
    spans = F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"]))
    got = chat.rotated_dialogues(talks).withColumn("mask", F.array_join(spans, ","))
    assert rows(got) == oracle(tmp_path, ORACLES["op6_chat_rotation"], conversations=talks)
    assert chat.rotated_dialogues(talks.limit(0)).count() == 0


def test_chat_masks_what_the_assistant_says(spark):
    talks = spark.createDataFrame(
        [(1, 0, "anna", "hello"), (1, 1, "bo", "hi"), (1, 2, "anna", "bye")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    found = {r.perspective: r for r in chat.rotated_dialogues(talks).collect()}
    said = lambda r: [r.text[m.start : m.end] for m in r["mask"]]
    assert said(found["anna"]) == ["hello<|im_end|>\n", "bye<|im_end|>\n"]
    assert said(found["bo"]) == ["hi<|im_end|>\n"]
    assert "user name=bo\nhi" in found["anna"].text


def test_chat_parts_join_to_the_whole(spark):
    talks = spark.createDataFrame(
        [(1, i, ("a", "b")[i % 2], "x" * (i % 50)) for i in range(200)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    whole = {r.perspective: r.text for r in chat.rotated_dialogues(talks).collect()}
    parts = chat.rotated_dialogues(talks, part_chars=300).orderBy("perspective", "part").collect()
    assert len(parts) > 10
    for view in ("a", "b"):
        assert "".join(r.text for r in parts if r.perspective == view) == whole[view]
    for r in parts:
        assert all(r.text[m.start : m.end].endswith("<|im_end|>\n") for m in r["mask"])


PAGES = "page_id bigint, url string, html string, payload string, bundle string"


def odd_pages(spark):
    data = [
        (1, "http://a/", "<p>x</p>", "p", "b"),
        (2, "http://b/ c\r\nd", "<p>x</p>", "p", "b"),
        (3, None, None, "p", "b"),
        (4, "http://d", "", "p", "b"),
        (5, "http://e", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "p", "b"),
        (6, "http://f", "é🙂" * 50_000, "p", "b"),
        (None, "http://g", "alone", "p", "b"),
    ]
    return spark.createDataFrame(data, PAGES).repartition(3)


def read_back(spark, pages, **options):
    folder = new_folder(spark, "warc")
    manifest = warc.write_bundles(warc.with_record_types(pages), folder, **options)
    return manifest, warc.read_bundles(manifest, folder), folder


def test_warc_of_odd_rows(spark, tmp_path):
    pages = odd_pages(spark)
    _, got, _ = read_back(spark, pages, frame_bytes=64, bundle_bytes=256)
    got = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    expected = oracle(tmp_path, ORACLES["op7_warc_bundles"], pages=pages.filter("page_id is not null"))
    assert rows(got.filter("page_id is not null")) == expected
    assert got.filter("page_id is null").first().record_type == "response"


def test_warc_of_repeated_rows(spark):
    """One of rows that repeat id and payload is the response."""
    pages = spark.createDataFrame(
        [(1, "u", "same"), (7, "u", "same"), (7, "u", "same"), (7, "v", "same")],
        "page_id bigint, url string, html string",
    )
    _, got, _ = read_back(spark, pages)
    found = sorted((r.record_type, r.page_id, r.refers_to) for r in got.collect())
    assert found == [("response", 7, None), ("revisit", 1, 7), ("revisit", 7, 7), ("revisit", 7, 7)]


def test_warc_below_the_least_bytes_is_no_revisit(spark):
    pages = spark.createDataFrame(
        [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")],
        "page_id bigint, url string, html string",
    )
    found = {r.page_id: r.record_type for r in warc.with_record_types(pages, min_bytes=3).collect()}
    assert found == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_warc_fetches_a_record_by_its_frame(spark):
    pages = odd_pages(spark)
    manifest, _, folder = read_back(spark, pages, frame_bytes=64)
    got = warc.fetch_records(manifest.filter("page_id = 6"), folder).collect()
    assert [r.page_id for r in got] == [6]
    assert bytes(got[0].payload).decode() == "é🙂" * 50_000
    revisit = warc.fetch_records(manifest.filter("page_id = 1"), folder).first()
    assert (revisit.record_type, revisit.refers_to, revisit.url) == ("revisit", 2, "http://a/")


def test_warc_bundles_are_plain_zstandard(spark):
    """Any decoder reads a bundle as one stream, past the seek table."""
    import io

    import zstandard

    pages = odd_pages(spark)
    manifest, _, folder = read_back(spark, pages, frame_bytes=64)
    seen = 0
    for r in manifest.select("bundle").distinct().collect():
        path = f"{folder.removeprefix('file://')}/bundles/{r.bundle}"
        with open(path, "rb") as file:
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(file.read()), read_across_frames=True).read()
        seen += sum(1 for _ in warc.parse_records(raw))
    assert seen == pages.count()


def test_warc_without_pages(spark):
    _, got, _ = read_back(spark, odd_pages(spark).limit(0))
    assert got.count() == 0


def test_warc_addresses():
    assert warc.bundle_address("/a/b") == "file:///a/b" == warc.bundle_address("file:/a/b")
    assert warc.bundle_address("s3a://bucket/x") == "s3://bucket/x" == warc.bundle_address("S3N://bucket/x")
    assert warc.bundle_address("hdfs://host:8020/x") == "hdfs://host:8020/x"
    with pytest.raises(ValueError, match="wasb"):
        warc.write_bundles(None, "wasb://x/y")


def test_warc_opens_object_stores():
    """The address of a bucket is one that the tasks can open; nothing is read."""
    found, path = warc._filesystem("s3a://bucket/folder?region=eu-west-1")
    assert found.type_name == "s3" and path == "bucket/folder"
