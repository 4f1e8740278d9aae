import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kmerloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, length string"


def brute_first_fit(sizes, capacity):
    bins, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        for b, used in enumerate(bins):
            if used + sizes[i] <= capacity:
                break
        else:
            b = len(bins)
            bins.append(0)
        out[i] = (b, bins[b])
        bins[b] += sizes[i]
    return [out[i] for i in range(len(sizes))]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_tournament_is_first_fit_decreasing(sizes):
    bins, offsets = packing.first_fit_decreasing(np.array(sizes, np.int64), 100)
    assert list(zip(bins.tolist(), offsets.tolist())) == brute_first_fit(sizes, 100)


@settings(deadline=None, max_examples=200)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t 'srelv1é")), max_size=80))
def test_encoder_equals_tokenizers(text):
    assert packing.encoder(PATH)(text).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_encoder_on_added_tokens():
    text = "a <|endoftext|> b"
    assert packing.encoder(PATH)(text).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def check(rows, out, size):
    tokenizer = Tokenizer.from_file(PATH)
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t, _ in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids[i])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(by_sequence), sum(map(len, ids.values()))


def test_pack_round_trip(spark):
    rng = random.Random(4)
    rows = [(0, None, "x"), (1, "", "x"), (2, "word " * 5000, "x")]
    rows += [(i, " ".join(rng.choice(["the", "wälder", "x1"]) for _ in range(rng.randrange(1, 900))), "x") for i in range(3, 150)]
    for group in (20_000, 40):
        out = packing.pack(spark.createDataFrame(rows, SCHEMA), PATH, group_pieces=group).collect()
        sequences, tokens = check(rows, out, 1024)
        if group == 20_000:
            assert sequences <= tokens / 1024 * 1.05 + 1


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(5, "a b", "x"), (5, "a b", "x"), (None, "c", "x")], SCHEMA)
    out = packing.pack(df, PATH).collect()
    assert sorted((r.doc_id or -1, r.length) for r in out) == [(-1, 2), (5, 3), (5, 3)]
    assert len({(r.sequence_id, r.offset) for r in out}) == 3
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_equal_pieces_fall_in_different_groups(spark):
    """A third of all rows have no id and one text."""
    rows = [(None, "the same text of a row without an id", "x")] * 400 + [(i, f"text {i} " * (i % 9 + 1), "x") for i in range(800)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, extra string"), PATH, 64, 100).collect()
    alone = [r for r in got if r.doc_id is None]
    assert len(alone) == 400 and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert len({r.sequence_id >> 32 for r in alone}) >= 8
    used = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 64
