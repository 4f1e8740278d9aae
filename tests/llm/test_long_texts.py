"""Texts beyond an Arrow slice, beside short ones and nulls, through every operator."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from kmerloom.llm import common, decontaminate, langid, linecrf, linededup, packing, puquality, sharding, simhash, tokencount, warc
from kmerloom.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = [f"{rng.choice(['wä', 'the', 'on', 'x'])}{i}" for i in range(5000)]
    long = "\n".join(" ".join(rng.choice(words) for _ in range(12)) + "." for _ in range(33_000))
    assert len(long.encode()) > common.SLICE_BYTES
    return {0: None, 1: "short text", 2: long, 3: "", 4: long.replace("on7 ", "edited ", 40) + "\nend", 5: "another short text of a few words"}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)


def test_rules(docs, texts):
    for r in linecrf.apply_rules(docs).collect():
        text = (texts[r.doc_id] or "").encode()
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == linecrf.base_statistics(text, text.split())


def test_lines_and_near_duplicates(docs, texts):
    kept = {r.doc_id: r.text for r in linededup.drop_recurring_lines(docs, min_docs=2).collect()}
    assert kept[2] == texts[2] and kept[4] == "end"  # an edited line shares its other spans
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == {0, 1, 2, 5}


def test_language_and_quality(spark, docs, texts):
    got = {r.doc_id: r for r in langid.identify(docs.selectExpr("*", "if(doc_id = 5, 'en', 'xx') AS lang")).collect()}
    assert got[2].lang_pred in ("en", "xx") and got[0].lang_pred == got[3].lang_pred == "und" and 0 < got[2].score <= 1
    model = puquality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    marks = spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int")
    own = puquality.train(docs, marks)
    want = puquality.scores(own, [None if t is None else t.encode() for t in texts.values()])
    assert [r.score for r in puquality.score_documents(docs, marks).orderBy("doc_id").collect()] == want.tolist()
    assert 0 <= puquality.scores(model, [texts[2].encode()])[0] <= 1


def test_fingerprint_is_of_the_whole_text(docs, texts):
    words = texts[2].encode().lower().split()
    h = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)], np.uint64)
    bits = [int(2 * int(((h >> np.uint64(j)) & np.uint64(1)).sum()) > len(h)) for j in range(64)]
    got = {r.doc_id: r.fingerprint for r in simhash.simhash_components(docs).collect()}
    assert int(got[2], 16) == sum(b << j for j, b in enumerate(bits)) and got[0] == got[3] == "0" * 16


def test_item_at_the_end(spark, docs, texts):
    items = spark.createDataFrame([(7, " ".join(texts[2].split()[-40:]))], "item_id long, text string")
    got = decontaminate.benchmark_matches(docs, items).collect()
    assert {(r.doc_id, r.similarity) for r in got if r.doc_id == 2} == {(2, 1.0)}
    assert all(r.start == len(texts[2].split()) - 40 for r in got if r.doc_id == 2)


def test_packing_and_counts(docs, texts):
    encode = packing.encoder(PATH)
    pieces = sorted(((r.start, r.length, r.ids_crc32) for r in packing.pack(docs, PATH).where("doc_id = 2").collect()))
    ids = np.append(encode(texts[2]), np.uint32(0)).astype("<u4")
    assert sum(n for _, n, _ in pieces) == len(ids)
    assert all(zlib.crc32(ids[a : a + n].tobytes()) == crc for a, n, crc in pieces)
    memory = tokencount.Memory(tokencount.suffix_tree(tokencount.unigram_scores(PATH)), 1 << 30)
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs, PATH).collect()}
    assert [got[i] for i in texts] == memory.count([(t or "").encode().split() for t in texts.values()])


def test_shards_and_archives(spark, docs, texts):
    got = {r.doc_id: (r.size, r.text_crc32) for r in sharding.shard(docs, 3).collect()}
    assert got == {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts.items()}
    pages = docs.selectExpr("doc_id AS page_id", "'u' AS url", "text AS html")
    digests = {r.page_id: r.payload_digest for r in warc.round_trip(pages).collect()}
    assert digests == {i: hashlib.sha1((t or "").encode()).hexdigest() for i, t in texts.items()}
