"""Source divergence, BPE and importance resampling, against DuckDB, the library and brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspan.llm import bpe, divergence, resampling
from larkspan.llm.queries import ORACLES, QUERIES
from larkspan.sources import table
from tests.llm.cases import ODD_TEXTS, no_docs, odd_docs, write_tables
from tests.llm.test_native import oracle, rows
from tests.oracle_check import assert_same

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("sf_dir", [SMALL, MEDIUM, "/root/testdata/sf0.1"])
@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_importance_resampling"])
def test_whole_tables(spark, name, sf_dir):
    assert assert_same(QUERIES[name](spark, sf_dir), sf_dir, ORACLES[name]) > 0


# --- source divergence -----------------------------------------------------------------


def divergence_by_definition(docs, min_docs=3, top=200):
    """docs: (text, lang, source); the rows as a set, in Python integers."""
    counts, docs_with, groups = Counter(), Counter(), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in terms).split(" ")
        terms = [t for t in terms if t]
        groups.add((lang, source))
        counts.update((lang, source, t) for t in terms)
        docs_with.update({(lang, t) for t in terms})
    out = set()
    for lang in {g[0] for g in groups}:
        sources = sorted(s for x, s in groups if x == lang)
        kept = [t for x, t in docs_with if x == lang and docs_with[x, t] >= min_docs]

        def prices(of, kept=kept):
            total = sum(map(of, kept)) + len(kept)
            return {t: 1 + 10**9 * (of(t) + 1) // total for t in kept}

        group = {s: prices(lambda t, s=s: counts[lang, s, t]) for s in sources}
        whole = prices(lambda t: sum(counts[lang, s, t] for s in sources))
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(sum(f(group[s][t], group[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [
                (f(group[s][t], whole[t]), t) for t in kept if counts[lang, s, t] and group[s][t] > whole[t]
            ]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, i) for i, (v, item) in enumerate(items[:most], 1)}
    return out


def found(df):
    got = [(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def random_docs(rng, n):
    words = [f"{a}{b}" for a in "abcdeéß" for b in "xyzüш"]
    for _ in range(n):
        text = " ".join(rng.choices(words, [1 / (i + 1) ** 2 for i in range(len(words))], k=rng.randint(0, 30)))
        yield text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "", None, "é"])


@pytest.mark.parametrize("columns", [3, 7, 512])
def test_divergence_in_blocks_by_definition(spark, monkeypatch, columns):
    """Blocks of few columns, and terms whose columns fill several tiles."""
    rng = random.Random(columns)
    docs = [*random_docs(rng, 150), ("once Twice", "fr", "a"), ("...", "fr", "b"), ("x x", "it", "a")]
    entries = Counter()
    for text, lang, source in docs:
        entries.update((lang or "", source or "", t) for t in text.lower().replace(".", "").split())
    kept = sorted({t for lang, _, t in entries if lang == "en"})
    sources = sorted({s for lang, s, _ in entries if lang == "en"})
    per_term = [[(i, entries["en", s, t]) for i, s in enumerate(sources) if entries["en", s, t]] for t in kept]
    flat = np.array([x for cells in per_term for x in cells], np.int64)
    price = lambda n: 1 + 1000 * (n + 1)
    monkeypatch.setattr(divergence, "COLUMNS", columns)
    monkeypatch.setattr(divergence, "ENTRIES", 20)
    a, b, total = divergence.pair_prices(
        flat[:, 0], flat[:, 1], price(flat[:, 1]), price(0 * flat[:, 1]), np.array(list(map(len, per_term)))
    )
    want, got = np.zeros((2, len(sources), len(sources)), np.int64)
    got[a, b] = total
    f = lambda p, q: (p - q) ** 2 // q
    for cells in per_term:
        for a, n in cells:
            for b, m in cells:
                p, q, z = price(n), price(m), price(0)
                want[a, b] += f(p, q) - f(p, z) - f(z, q) + f(z, z)
    assert (got == want).all()
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(4)
    assert found(divergence.source_divergence(df)) == divergence_by_definition(docs)


def test_joint_tables_by_definition():
    rng = np.random.default_rng(4)
    ones = rng.random((50, 30)) < 0.2
    at, columns = np.nonzero(ones)
    got = np.zeros((30, 30), np.int64)
    for a, b, n in divergence.joint_tables(at, columns, 30):
        got[a, b] = n
    assert (got == ones.astype(int).T @ ones.astype(int)).all()


def test_divergence_of_odd_rows(spark, tmp_path):
    docs = odd_docs(spark)
    got = divergence.source_divergence(docs)
    want = divergence_by_definition([(r.text, r.lang, r.source) for r in docs.collect()])
    assert found(got) == want
    assert rows(got) == oracle(tmp_path, ORACLES["op11_source_divergence"], documents=docs)
    assert divergence.source_divergence(no_docs(spark)).count() == 0
    plain = divergence.source_divergence(docs.filter("doc_id in (5, 8)")).collect()
    assert plain and all(r.part == "pair" and r.value == 0 for r in plain)


def test_divergence_keeps_the_top_terms_only(spark):
    """More terms than the limit, many of equal value, in one hot group."""
    text = " ".join(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300))
    docs = [(text, "en", "hot")] * 3 + [("other words here", "en", "cold")] * 3
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    got = found(divergence.source_divergence(df))
    assert got == divergence_by_definition(docs)
    assert sum(part == "term" and source == "hot" for _, source, part, *_ in got) == 200


def test_prices_beyond_64_bits(spark):
    """10^9 times a count of over 9.2 thousand millions is exact."""
    n, total = 123_456_789_012_345, 987_654_321_098_765
    got = spark.range(1).select(divergence.price(F.lit(n), F.lit(total)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 1) // total


def test_term_counts_are_passed_on_when_many(spark, monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", 5)
    docs = spark.createDataFrame(list(random_docs(random.Random(1), 60)), "text string, lang string, source string")
    want = divergence_by_definition([tuple(r) for r in docs.collect()])
    assert found(divergence.source_divergence(docs)) == want


# --- BPE -------------------------------------------------------------------------------

ALPHABET = "abcdefgh  ÀÉéß×÷ÿÞ日本テスト🙂'’́ͅ\x1c\x85　\xa0ﬁİΣς0१२-_<|>\n\tAZ"
HARD = [
    "a <|endoftext|>x<|startoftext|><|endoftext|> y",
    "<|endoftext",
    "<|endoftext|>" * 3,
    "a" * 5000,
    "日本" * 3000,
    "ab1" * 2000,
    "don't I'LL 'S ''s '''ll",
    "é é ́ Å Å",
    "x" * 40 + "y",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    return bpe.ForcedBoundaryEncoder(open(VOCABULARY).read())


def numbers(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_ids_and_texts_are_the_librarys(library, encoder):
    rng = random.Random(1)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(5000)]
    texts += [*HARD, *(t or "" for t in ODD_TEXTS)]
    tokens = bpe.tokens_by_id(open(VOCABULARY).read())
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [numbers(x) for x in encoder.ids([t.encode() for t in texts])] == want
    lists = pa.array(want, pa.list_(pa.int32()))
    texts = bpe.decoded(lists, tokens).to_pylist()
    assert texts == [library.decode(x, skip_special_tokens=False) for x in want]


def test_decoding_of_odd_ids(library):
    tokens = bpe.tokens_by_id(open(VOCABULARY).read())
    lists = [None, [], [1, -5, 99_999_999, None, 49_407, 2], [-1]]
    got = bpe.decoded(pa.array(lists, pa.list_(pa.int32())), tokens).to_pylist()
    assert got == [None, "", library.decode([1, 49_407, 2], skip_special_tokens=False), ""]


def test_no_token_holds_a_cut(encoder, library):
    """Fragments put together are the word, and each cut is between bytes that no token joins."""
    rng = random.Random(2)
    words = ["".join(rng.choices("abcxyzéq7$", k=rng.randint(1, 12))).encode() for _ in range(3000)]
    _, owner = encoder.fragments(words)
    assert len(owner) == sum(map(len, words))
    inside = {False: set(), True: set()}
    for token in library.get_vocab(with_added_tokens=False):
        ends = token.endswith("</w>") and token != "</w>"
        body = bytes(encoder._byte[c] for c in (token.removesuffix("</w>") if ends else token))
        for i in range(1, len(body)):
            inside[ends and i == len(body) - 1].add(body[i - 1 : i + 1])
    at, cuts = 0, 0
    for word in words:
        assert at == 0 or owner[at] > owner[at - 1]
        for i in range(1, len(word)):
            joined = word[i - 1 : i + 1] in inside[i == len(word) - 1]
            assert (owner[at + i] == owner[at + i - 1]) == joined
            cuts += not joined
        at += len(word)
    assert cuts > 1000


def test_words_are_encoded_alike_in_any_order(encoder):
    """Words of one byte, first and last among them: each has its own ids beside any other."""
    words = [b"t", b"h", b"he", b"t", "×".encode(), b"a", b"the", b"\x1c", b"x" * 40, b"n", "é".encode()]
    alone = [encoder.encode_words([w])[0] for w in words]
    rng = random.Random(4)
    for _ in range(200):
        order = rng.sample(range(len(words)), rng.randint(1, len(words)))
        assert encoder.encode_words([words[i] for i in order]) == [alone[i] for i in order]


def test_merging_many_is_merging_one(encoder):
    rng = random.Random(3)
    words = ["".join(rng.choices("the ing ation"[: rng.randint(3, 13)], k=rng.randint(1, 30))) for _ in range(2000)]
    words = [w.replace(" ", "e").encode() for w in words]
    symbols = [encoder.symbol[list(w)] for w in words]
    owner = np.repeat(np.arange(len(words)), list(map(len, words)))
    ids, of = encoder.merges.many(np.concatenate(symbols), owner)
    for i, s in enumerate(symbols):
        assert ids[of == i].tolist() == encoder.merges.one(s.tolist())
    assert encoder.merges.many(np.zeros(0, np.int64), np.zeros(0, np.int64))[0].size == 0


def test_what_is_remembered_stays_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    monkeypatch.setattr(bpe, "TOGETHER", 200)
    small = bpe.ForcedBoundaryEncoder(open(VOCABULARY).read())
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcd", k=4)) for _ in range(20)) for _ in range(300)]
    texts.append("long" * 500)
    got = [numbers(x) for x in small.ids([t.encode() for t in texts])]
    assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert len(small._known) < 200 and len(small._older) < 200


def test_another_kind_of_vocabulary_is_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.ForcedBoundaryEncoder(open(public_tokenizers.path("byte_bpe_50k.json")).read())


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("sf_dir", [SMALL, MEDIUM])
def test_bpe_whole_table(spark, library, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    got = QUERIES["op12_bpe_round_trip"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(library, texts[r.doc_id])


def test_bpe_of_odd_rows(spark, library, tmp_path):
    folder = write_tables(spark, tmp_path, documents=odd_docs(spark))
    got = QUERIES["op12_bpe_round_trip"](spark, folder).collect()
    texts = dict(enumerate(ODD_TEXTS)) | {None: "one two"}
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd_docs(spark).collect())
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(library, texts[r.doc_id])
    one = bpe.decode(bpe.encode(F.col("text"), VOCABULARY), VOCABULARY)
    both = bpe.round_trip(F.col("text"), VOCABULARY)["text"]
    assert odd_docs(spark).filter(~one.eqNullSafe(both)).count() == 0
    assert no_docs(spark).select(one, both).count() == 0


def test_each_text_is_encoded_once(spark):
    plan = QUERIES["op12_bpe_round_trip"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("both(text") == 1 and plan.count("ArrowEvalPython") == 1


def test_texts_are_encoded_in_portions(spark, library, monkeypatch):
    """Batches cut into portions of few bytes and ids, one text longer than any."""
    monkeypatch.setattr(bpe, "TOGETHER", 300)
    monkeypatch.setattr(bpe, "IDS_TOGETHER", 50)
    texts = [None, "", "one two three " * 40, *(f"text {i}, é日本 {i * i}" for i in range(200)), None]
    encoder = bpe.ForcedBoundaryEncoder(open(VOCABULARY).read())
    lists = bpe._lists(pa.array(texts), encoder)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert lists.to_pylist() == want
    tokens = bpe.tokens_by_id(open(VOCABULARY).read())
    got = bpe.decoded(lists, tokens).to_pylist()
    assert got == [library.decode(x, skip_special_tokens=False) for x in want]
    sliced = bpe.decoded(lists[3:9], tokens).to_pylist()
    assert sliced == got[3:9]
    assert bpe._lists(pa.array([], pa.string()), encoder).to_pylist() == []


# --- importance resampling -------------------------------------------------------------


def test_planes_give_the_sum_of_gains():
    rng = np.random.default_rng(1)
    gains = rng.integers(-9000, 9000, resampling.BUCKETS)
    gains[:3] = (0, -(1 << 40), 1 << 40)
    counts = rng.poisson(0.05, (40, resampling.BUCKETS)) * rng.integers(1, 3000, (40, 1))
    counts[0], counts[1, 1:] = 0, 0
    got = resampling.GainPlanes(gains).weights(counts)
    assert (got == counts @ gains).all()
    assert (resampling.GainPlanes(0 * gains).weights(counts) == 0).all()


def test_words_and_runs_of_words():
    text = "One two, TWO_x é2 - one".encode()
    assert resampling.words_of(text) == [b"one", b"two", b"two", b"x", "é2".encode(), b"one"]
    known = resampling._Buckets()
    runs = resampling.buckets_of([b"a", b"b", b"c"], 2, known).tolist()
    assert runs == [known[x] for x in (b"a", b"b", b"c", b"a b", b"b c")]
    assert resampling.buckets_of([], 3, known).size == 0


def test_resampling_of_odd_rows(spark, tmp_path):
    docs = odd_docs(spark)
    target = spark.createDataFrame(
        [(1, "one two"), (2, None), (3, ""), (None, "same words here"), (1, "one two")], "item_id bigint, text string"
    )
    got = resampling.importance_resampling(docs, target)
    want = oracle(tmp_path, ORACLES["op13_importance_resampling"], documents=docs, benchmark=target)
    assert rows(got) == want
    assert resampling.importance_resampling(no_docs(spark), target).count() == 0
    alone = resampling.importance_resampling(docs, target.limit(0))
    assert alone.count() == docs.count()


def test_ranks_over_many_ranges_and_ties(spark, conf):
    """A score that most rows share is still ranked by id, over several ranges."""
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    data = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 11).alias("score")
    )
    got = resampling.ranked(data.repartition(5), [F.desc("score"), F.asc("doc_id")]).collect()
    order = sorted(got, key=lambda r: (-r.score, r.doc_id))
    assert [r["rank"] for r in order] == list(range(1, 5001))


def test_draws_prefer_the_target(spark):
    rng = random.Random(9)
    near, far = [f"n{i}" for i in range(200)], [f"f{i}" for i in range(200)]
    text = lambda words: " ".join(rng.choices(words, k=40))
    docs = spark.createDataFrame(
        [(i, text(near if i % 10 == 0 else far)) for i in range(1000)], "doc_id bigint, text string"
    )
    target = spark.createDataFrame([(i, text(near)) for i in range(50)], "item_id bigint, text string")
    drawn = resampling.importance_resampling(docs, target).filter("rank is not null").collect()
    assert sorted(r["rank"] for r in drawn) == list(range(1, 101))
    assert all(r.doc_id % 10 == 0 for r in drawn)
