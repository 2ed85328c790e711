"""Language ID, toxicity, packing and the pipeline: held-out accuracy, round trips, odd rows."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from larkspan.llm import decontam, langid, packing, secret_scan, simhash, toxicity
from larkspan.llm.common import bounded_ids, possibly_among, shared_dir
from larkspan.llm.ngrams import text_ngrams, word_ngrams
from larkspan.llm.queries import QUERIES
from larkspan.sources import table
from tests.llm.cases import ODD_TEXTS, no_docs, odd_docs, write_tables

MEDIUM = "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LABELS = "doc_id bigint, quality int, toxic int"


def crc(doc_id, of):
    return zlib.crc32(str(doc_id).encode()) % of


def test_ngrams_stay_within_words_and_add_up():
    grams = lambda word: Counter(word_ngrams([word], 1, 4, 13)[1].tolist())
    starts, buckets = word_ngrams(["ab", "é🙂x", "ab"], 1, 4, 13)
    parts = [Counter(buckets[a:b].tolist()) for a, b in zip(starts, starts[1:], strict=False)]
    assert parts == [grams("ab"), grams("é🙂x"), grams("ab")]
    assert parts[0].total() == 4 + 3 + 2 + 1
    texts = ["ab Ab x", None, "", "12 34", "é🙂x"]
    found = defaultdict(Counter)
    for i, b in text_ngrams(texts, 1, 4, 13, distinct=False):
        found[i].update(b.tolist())
    assert sorted(found) == [0, 1, 2, 3, 4]
    assert found[0] == grams("ab") + grams("ab") + grams("x")
    assert not found[1] and not found[2] and not found[3]


def test_bounded_ids_are_those_hashed_lowest(spark):
    ids = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "b").otherwise("a").alias("lang")
    )
    got = bounded_ids(ids, "lang", 80).collect()
    counts = Counter(r.lang for r in got)
    assert counts == {"a": 80, "b": 50}
    order = ids.filter("lang = 'a'").orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 1)).limit(80)
    assert {r.doc_id for r in order.collect()} == {r.doc_id for r in got if r.lang == "a"}
    assert bounded_ids(ids.limit(0), "lang", 80).count() == 0


# --- language ID -----------------------------------------------------------------------


def test_language_of_held_out_texts(spark):
    rows = QUERIES["op2_language_id"](spark, MEDIUM).collect()
    docs = {r.doc_id: r for r in table(spark, MEDIUM, "documents").collect()}
    assert len(rows) == len(docs)
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held) > 100


def test_language_learns_from_its_fold_only(spark, tmp_path):
    """Held-out rows, and columns other than text and lang, don't change the result."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = docs.select(
        "doc_id",
        "text",
        F.when(held, "xx").otherwise(F.col("lang")).alias("lang"),
        F.lit("other").alias("source"),
        F.lit(0).cast("long").alias("n_chars"),
    )
    folder = write_tables(spark, tmp_path, documents=other)
    pick = lambda f: sorted(map(tuple, QUERIES["op2_language_id"](spark, f).collect()))
    assert pick(folder) == pick("/root/testdata/sf0.001")


def test_language_of_odd_rows(spark):
    docs = odd_docs(spark)
    text = F.col("text")
    model = langid.fit(docs)
    got = docs.select("doc_id", "text", langid.predict(text, model).alias("p")).collect()
    assert len(got) == docs.count() and model.langs == ["en"]
    for r in got:
        unknown = not r.text or not any(c.isalpha() for c in r.text)
        assert (r.p.lang, r.p.score) == ("und", 0.0) if unknown else r.p.lang == "en"
    nothing = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.p.lang for r in docs.select(langid.predict(text, nothing).alias("p")).collect()} == {"und"}
    assert no_docs(spark).select(langid.predict(text, langid.fit(no_docs(spark)))).count() == 0


def grams_by_definition(text):
    """How often each bucket of a text's 1- to 4-grams occurs, word by word."""
    found = Counter()
    for word in regex.findall(r"\p{L}+", (text or "").lower()):
        found.update(word_ngrams([word], langid.LOW, langid.HIGH, langid.BITS)[1].tolist())
    return found


def ftrl_by_definition(examples, classes, epochs=3, alpha=0.5, beta=1.0, l1=0.1, l2=0.1):
    """Weights by (bucket, class), a number at a time; examples: (label, {bucket: value})."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(key):
        if abs(z[key]) <= l1:
            return 0.0
        return (np.sign(z[key]) * l1 - z[key]) / ((beta + np.sqrt(n[key])) / alpha + l2)

    for _ in range(epochs):
        for label, vector in examples:
            w = {(b, c): weight((b, c)) for b in vector for c in range(classes)}
            logits = [sum(x * w[b, c] for b, x in vector.items()) for c in range(classes)]
            top = max(logits)
            e = [np.exp(x - top) for x in logits]
            for c in range(classes):
                error = e[c] / sum(e) - (c == label)
                for b, x in vector.items():
                    g, key = x * error, (b, c)
                    z[key] += g - (np.sqrt(n[key] + g * g) - np.sqrt(n[key])) / alpha * w[key]
                    n[key] += g * g
    return {key: weight(key) for key in list(z)}


def test_language_by_definition(spark):
    """Frequencies, weights and predictions against dictionaries and single numbers."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = langid.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    grams = {i: grams_by_definition(t) for i, t in texts.items()}
    seen = Counter(b for g in grams.values() for b in g)
    for bucket in range(langid.SIZE):
        want = np.log((1 + len(texts)) / (1 + seen[bucket])) + 1 if seen[bucket] else 0.0
        assert abs(model.idf[bucket] - want) < 1e-12

    def vector(doc_id):
        raw = {b: np.log1p(k) * model.idf[b] for b, k in grams[doc_id].items()}
        norm = np.sqrt(sum(x * x for x in raw.values()))
        return {b: x / norm for b, x in raw.items()}

    got = docs.select("doc_id", langid.predict(F.col("text"), model).alias("p")).collect()
    for r in got:
        if grams[r.doc_id]:
            x = vector(r.doc_id)
            logits = np.array([model.bias[c] + sum(v * model.weights[b, c] for b, v in x.items()) for c in range(4)])
            p = np.exp((logits - logits.max()) / model.temperature)
            p /= p.sum()
            assert r.p.lang == model.langs[p.argmax()] and abs(r.p.score - p.max()) < 1e-9

    some = [i for i in sorted(texts) if 5 < len(grams[i]) < 500][:19]
    labels = [k % 3 for k in range(len(some))]
    examples = []
    for key, (i, label) in enumerate(zip(some, labels, strict=True)):
        x = vector(i)
        at = np.array(sorted(x))
        examples.append((key, label, at, np.array([x[b] for b in at])))
    weights, t = langid._train(examples[::-1], 3)
    want = ftrl_by_definition(
        [(label, dict(zip(at.tolist(), value.tolist(), strict=True)) | {langid.SIZE: 1.0}) for _, label, at, value in examples], 3
    )
    assert t == 1.0 and len(want) > 1000
    for (bucket, c), w in want.items():
        assert abs(weights[bucket, c] - w) < 1e-7
    assert np.count_nonzero(weights) == sum(w != 0 for w in want.values())


def test_ftrl_is_sparse_and_temperature_cools():
    rng = np.random.default_rng(1)
    model = langid.Ftrl(50, 2, l1=1.0)
    for _ in range(300):
        label = int(rng.integers(2))
        model.learn(np.array([label, *rng.choice(np.arange(2, 50), 5, replace=False)]), np.full(6, 0.4), label)
    w = model.weights()
    assert np.all(w[0] != 0) and np.all(w[1] != 0)
    assert (w[2:] == 0).mean() > 0.5
    labels = rng.integers(0, 2, 500)
    wrong = rng.random(500) < 0.2
    logits = np.where(np.eye(2)[labels ^ wrong] > 0, 8.0, 0.0)
    t = langid.temperature(logits, labels)
    p = langid._softmax(logits / t).max(axis=1)
    assert abs(p.mean() - 0.8) < 0.03


# --- toxicity --------------------------------------------------------------------------


def test_toxicity_of_held_out_texts(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    assert all(r.held_out == (crc(i, 4) == 2) and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    held = [(labels[i], r.predicted) for i, r in rows.items() if r.held_out and i in labels]
    both = Counter(held)
    assert both[1, 1] / (both[1, 1] + both[1, 0]) > 0.87
    assert both[0, 1] / (both[0, 1] + both[0, 0]) < 0.02


def test_toxicity_learns_from_its_fold_only(spark, tmp_path):
    """Labels of the held-out fold, and columns other than the text, don't change a score."""
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other_labels = labels.select(
        "doc_id", F.lit(0).alias("quality"), F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic")
    )
    other_docs = docs.select(
        "doc_id", "text", F.lit("xx").alias("lang"), F.lit("o").alias("source"), F.lit(0).cast("long").alias("n_chars")
    )
    folder = write_tables(spark, tmp_path, documents=other_docs, labels=other_labels)
    pick = lambda f: sorted(map(tuple, QUERIES["op9_toxicity"](spark, f).collect()))
    assert pick(folder) == pick(sf)


def test_toxicity_features_by_definition(spark):
    """Counts, significance and ratios against sets of n-grams written out."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    marks = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    labelled = spark.createDataFrame([(texts[i], m) for i, m in marks.items()], "text string, label int")
    counts = toxicity.ngram_counts(labelled.repartition(3))
    per = {0: Counter(), 1: Counter()}
    for i, m in marks.items():
        grams = set()
        for word in regex.findall(r"\p{L}+", texts[i].lower()):
            for n in range(toxicity.LOW, toxicity.HIGH + 1):
                padded = f" {word} "
                grams.update(padded[k : k + n] for k in range(len(padded) - n + 1))
        buckets = set()
        for _, found in text_ngrams([texts[i]], toxicity.LOW, toxicity.HIGH, toxicity.BITS, distinct=True):
            buckets.update(found.tolist())
        assert len(buckets) <= len(grams) and len(buckets) > 0.9 * len(grams)
        per[m].update(buckets)
    got = {r.bucket: (r.pos, r.neg) for r in counts.collect()}
    pos, neg = sum(marks.values()), len(marks) - sum(marks.values())
    assert got.pop(toxicity.ALL) == (pos, neg)
    assert got == {b: (per[1][b], per[0][b]) for b in per[0] | per[1]}
    n, limit = pos + neg, toxicity.significance_limit(5.0, len(got))
    p, q = (sum(x[k] + 1 for x in got.values()) for k in (0, 1))
    want = {}
    for bucket, (a, b) in got.items():
        if a + b < n:
            expected = [(t * s / n) for s in (a + b, n - a - b) for t in (pos, neg)]
            seen = [a, b, pos - a, neg - b]
            chi = sum((x - e) ** 2 / e for x, e in zip(seen, expected, strict=True))
            assert abs(chi - limit) > 1e-6
            if chi > limit:
                want[bucket] = np.log((a + 1) / p) - np.log((b + 1) / q)
    chosen = {r.bucket: r.ratio for r in toxicity.select_features(counts, pos, neg, 10_000, 5.0).collect()}
    assert chosen.keys() == want.keys() and want
    assert all(abs(chosen[b] - want[b]) < 1e-9 for b in want)


def test_significance_limit_is_what_chance_exceeds():
    rng = np.random.default_rng(3)
    chi = rng.standard_normal(400_000) ** 2
    assert 20 < (chi > toxicity.significance_limit(40, 400_000)).sum() < 65
    assert toxicity.significance_limit(1, 0) == toxicity.significance_limit(5, 5) == 0


def test_toxicity_fit_is_at_its_minimum():
    """No small move of weights or bias lowers the penalised loss by much; portions don't matter."""
    rng = np.random.default_rng(5)
    rows = [np.flatnonzero(rng.random(12) < 0.4).astype(np.int32) for _ in range(300)]
    labels = np.array([int(rng.random() < 1 / (1 + np.exp(2 - (3 in r) * 4))) for r in rows])
    weights, ratios = np.ones(300), np.ones(12)
    sample = toxicity._Sample(rows, labels, weights)
    theta, bias = toxicity._weights(toxicity._fit(sample, ratios, 1.0), ratios)
    loss = lambda t, b: toxicity._losses(sample, t, b).sum() / 300 + 1.0 / 300 * (t @ t) / 2
    best = loss(theta, bias)
    for k in range(12):
        for move in (0.05, -0.05):
            assert loss(theta + move * np.eye(12)[k], bias) > best
    assert loss(theta, bias + 0.05) > best and theta.argmax() == 3
    assert toxicity.best_penalty(rows, labels, weights, ratios) in toxicity.PENALTIES


def test_possibly_among_drops_no_listed_row(spark):
    rows = spark.range(3000).select((F.col("id") - 1500).alias("doc_id"), F.lit("t").alias("_word"))
    rows = rows.unionByName(spark.createDataFrame([(None, "t"), (7, "u")], "doc_id bigint, _word string"))
    ids = spark.range(0, 400, 4).select(F.col("id").alias("doc_id"))
    got = possibly_among(rows, ids, "doc_id")
    assert got.columns == rows.columns
    found = Counter(r.doc_id for r in got.collect())
    assert all(found[i] == 1 for i in range(0, 400, 4)) and None not in found
    assert len(found) < 110
    few = {r.doc_id for r in possibly_among(rows, ids, "doc_id", words=1).collect()}
    assert set(range(0, 400, 4)) <= few and len(few) > 1000
    assert possibly_among(rows, ids.limit(0), "doc_id").count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Context:
        applicationId = "a"

        def __init__(self, master):
            self.master = master

        def getCheckpointDir(self):
            return None

    class Session:
        def __init__(self, master, path=None):
            self.sparkContext, self.path = Context(master), path
            self.conf = self

        def get(self, key, default):
            return self.path or default

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://https://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(Session(master))
        assert shared_dir(Session(master, "s3a://bucket/x/")) == "s3a://bucket/x"


def test_toxicity_of_odd_rows(spark):
    docs = odd_docs(spark)
    scores = lambda model: [r[0] for r in docs.select(toxicity.score(F.col("text"), model)).collect()]
    label = lambda rows: toxicity.fit(docs, spark.createDataFrame(rows, LABELS))
    some = label([(3, 1, 1), (4, 1, 0), (11, 1, 0), (5, 1, 1), (5, 1, 0), (6, None, None), (None, 1, 1), (99, 1, 1)])
    assert len(scores(some)) == docs.count() and all(0 <= s <= 1 for s in scores(some))
    assert set(scores(label([]))) == {0.0} and set(scores(label([(3, 1, 0)]))) == {0.0}
    assert set(scores(label([(3, 1, 1)]))) == {1.0}
    assert no_docs(spark).select(toxicity.score(F.col("text"), some)).count() == 0


def test_toxicity_weighs_the_words_that_differ(spark):
    rng = np.random.default_rng(2)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lm", "rt", "st")]
    text = lambda bad: " ".join([*rng.choice(words, 30), *(["zqxvile"] if bad else [])])
    docs = spark.createDataFrame([(i, text(i % 4 == 0)) for i in range(400)], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], LABELS)
    model = toxicity.fit(docs, marks)
    got = docs.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()
    assert all((r.s >= 0.3) == (r.doc_id % 4 == 0) for r in got)


# --- packing ---------------------------------------------------------------------------


def check_packing(rows, capacity=packing.CAPACITY):
    """Pieces lie side by side from 0 in each sequence; returns the number of sequences."""
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length >= 1
            at += length
        assert at <= capacity
    return len(places)


def check_pieces(rows, texts):
    """Each document's pieces hold what the tokenizer gives; rows may repeat."""
    direct = Tokenizer.from_file(VOCABULARY)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids = [*direct.encode(texts[doc_id] or "", add_special_tokens=False).ids, packing.END]
        want = []
        for piece, start in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = ids[start : start + packing.CAPACITY]
            want.append((piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
        assert set(pieces) == set(want), doc_id


def test_packing_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = QUERIES["op3_best_fit_packing"](spark, sf).collect()
    check_pieces(rows, texts)
    total = sum(r.length for r in rows)
    assert check_packing(rows) <= -(-total // packing.CAPACITY) + 1


def test_packing_of_odd_rows(spark):
    rows = packing.packed_documents(odd_docs(spark), VOCABULARY).collect()
    texts = dict(enumerate(ODD_TEXTS)) | {None: "one two"}
    check_pieces(rows, texts)
    check_packing(rows)
    assert sum(r.doc_id == 4 and r.piece == 0 for r in rows) == 3
    assert packing.packed_documents(no_docs(spark), VOCABULARY).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        "Don't stop-it, I'LL go!! it's 12345 o'clock",
        "a <|endoftext|> b x<|startoftext|>y",
        "café Ångström Å ẞ İstanbul ﬁne ΣΑΣ ñandú!!! ÉCOLE?",
        "a b c　d\x1ce\x85f\x0bg\x0ch",
        "日本語 テスト。 한국어 🙂🙂 x​y ﻿z",
        "word's 'saw (it) \"so\" wait... #$%& a_b",
    ],
)
def test_word_ids_are_those_of_the_tokenizer(text):
    tokens = packing.WordTokenizer(open(VOCABULARY).read())
    direct = Tokenizer.from_file(VOCABULARY)
    for _ in range(2):
        none, ids, empty = tokens.ids(pa.array([None, text, " "]))
        assert np.frombuffer(ids, "<u4").tolist() == direct.encode(text, add_special_tokens=False).ids
        assert none == empty == b""


@pytest.mark.parametrize(
    ("histogram", "capacity", "sequences"),
    [
        ({4096: 5}, 4096, 5),
        ({6: 3, 4: 3}, 10, 3),
        ({5: 2, 3: 2, 2: 2}, 10, 2),
        ({7: 4, 1: 12}, 10, 4),
        ({6: 1, 2: 2}, 10, 1),
        ({6: 4, 3: 4}, 10, 4),
        ({1: 25}, 10, 3),
        ({9: 3}, 10, 3),
    ],
)
def test_plans(histogram, capacity, sequences):
    slots = packing.packing_plan(histogram, capacity)
    assert max(s.sequence + s.sequences for s in slots) == sequences
    used, filled = Counter(), Counter()
    for s in sorted(slots, key=lambda s: s.rank):
        assert s.rank == used[s.length]
        used[s.length] += s.times * s.sequences
        for n in range(s.sequence, s.sequence + s.sequences):
            filled[n] += s.times * s.length
    assert used == histogram and max(filled.values()) <= capacity


def test_a_hot_length_is_spread(spark):
    lengths = [7] * 5000 + [3] * 400 + list(range(1, 10)) * 10
    pieces = spark.createDataFrame(list(enumerate(lengths)), "id bigint, length bigint")
    rows = packing.pack_pieces(pieces, ["id"], capacity=10).collect()
    assert sorted(r.id for r in rows) == list(range(len(lengths)))
    check_packing(rows, 10)


# --- pipeline --------------------------------------------------------------------------


def test_each_stage_takes_effect(spark):
    sf, docs = MEDIUM, table(spark, MEDIUM, "documents").cache()
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "simhash_near_dedup", "decontamination", "secret_scan", "packing"]

    clean = stage["toxicity"](spark, docs, sf)
    assert clean.columns == columns
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    kept = {r.doc_id for r in clean.select("doc_id").collect()}
    marked = [i for i, x in labels.items() if x]
    assert sum(i in kept for i in marked) < 0.2 * len(marked)
    assert sum(i in kept for i, x in labels.items() if not x) > 0.97 * (len(labels) - len(marked))

    single = stage["simhash_near_dedup"](spark, docs, sf)
    assert single.columns == columns
    groups = simhash.near_duplicates(docs)
    want = {r.component_id for r in groups.collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(want)

    free = stage["decontamination"](spark, docs, sf)
    found = {r.doc_id for r in decontam.contaminated(docs, table(spark, sf, "benchmark")).collect()}
    assert free.columns == columns and found
    assert {r.doc_id for r in free.collect()} == {r.doc_id for r in docs.collect()} - found

    bare = stage["secret_scan"](spark, docs, sf)
    assert bare.columns == columns
    before, after = ({r.doc_id: r for r in df.collect()} for df in (docs, bare))
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert r.text == secret_scan.redact(before[i].text) and r.n_chars == len(r.text)
    assert any(before[i].text != r.text for i, r in after.items())


def test_pipeline_is_its_stages(spark, tmp_path):
    """``run`` against the stages one by one, each read from a file."""
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    rows = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    got = corpus_pipeline.run(spark, sf)
    assert rows(got) == rows(docs)
    check_packing(got.collect())


def test_pipeline_of_odd_rows(spark, tmp_path):
    docs = odd_docs(spark)
    empty = spark.createDataFrame([], LABELS)
    bench = spark.createDataFrame([], "item_id bigint, text string")
    folder = write_tables(spark, tmp_path, documents=docs, labels=empty, benchmark=bench)
    for rows in (docs, docs.limit(0)):
        out = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, folder)
            assert out.columns == docs.columns
            assert name != "toxicity" or out.count() == rows.count()
        ids = [r.doc_id for r in out.collect()]
        assert len(ids) == len(set(ids))
        packed = corpus_pipeline.STAGES[-1][1](spark, out, folder).collect()
        assert {r.doc_id for r in packed} == set(ids)
