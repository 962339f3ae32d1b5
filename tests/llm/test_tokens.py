"""op1, op2, op8: encoding, token files, packing, length histogram."""

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute_llm import crc, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hostloom.llm import packing, token_counts, token_files
from hostloom.llm.queries import TOKENIZER
from hostloom.llm.text import utf8
from hostloom.llm.tokens import encoder


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    return lambda texts: [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


PARTS = [" ", "  ", "\n", "\r\n", "\t", "'s", "'", "a", "Bc", "é", "1", " ", "　", "\u0085", "!", "?!", "漢", "😀", "\x1c", "<|endoftext|>"]


def test_special_strings_are_what_the_tokenizer_says():
    texts = ["a <|endoftext|> b", "<|endof", "text|>", "x<|endoftext|><|endoftext|>", "<|endof<|endoftext|>text|>", "a<|endoftext|"]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    data, offsets = utf8(pa.array(texts))
    ids, bounds = encoder(TOKENIZER).encode(data, offsets)
    got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in got[0] and 50256 not in got[1] + got[2] + got[5]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=20))
def test_pieces_encode_like_whole_texts(texts):
    tokenizer = encoder(TOKENIZER)
    data, offsets = utf8(pa.array(texts, pa.string()))
    ids, bounds = tokenizer.encode(data, offsets)
    want = [e.ids for e in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    assert tokenizer.counts(data, offsets).tolist() == [len(w) for w in want]


def test_encoder_survives_forgetting(monkeypatch, plain):
    import hostloom.llm.tokens as tokens

    monkeypatch.setattr(tokens, "CACHED_PIECES", 3)
    fresh = tokens.Encoder(TOKENIZER)
    for texts in (["a b c d e f"], ["f e d c b a", "x"], ["a b c"]):
        data, offsets = utf8(pa.array(texts))
        ids, bounds = fresh.encode(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == plain(texts)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))


@pytest.mark.parametrize("table", ["small", "odd"])
def test_token_files_round_trip(request, plain, table):
    docs = request.getfixturevalue(table)
    rows = ordered(rows_of(docs))
    read = token_files.read_token_files(token_files.write_token_files(docs, TOKENIZER)).collect()
    read.sort(key=lambda r: r["start"])
    start = 0
    for (doc_id, _), ids, got in zip(rows, plain(t for _, t in rows), read, strict=True):
        assert (got["doc_id"], got["start"], got["n_tokens"]) == (doc_id, start, len(ids) + 1)
        assert np.frombuffer(got["ids"], "<u4").tolist() == [*ids, 0]
        start += len(ids) + 1


def test_sequences_are_views_and_masks_mark_the_padding(small, plain):
    shards = token_files.write_token_files(small, TOKENIZER, length=256).orderBy("shard").collect()
    ids = [i for x in plain(t for _, t in ordered(rows_of(small))) for i in [*x, 0]]
    at = 0
    for shard in shards:
        file = token_files.TokenFile(shard["tokens"])
        assert len(file) == shard["n_sequences"] == math.ceil(shard["n_tokens"] / 256)
        got = []
        for k in range(len(file)):
            sequence, mask = file.sequence(k), file.mask(k)
            assert not sequence.flags.owndata and len(sequence) == len(mask) == 256
            got += sequence[np.array(mask)].tolist()
            assert mask.true_count == 256 or k == len(file) - 1
        assert got == ids[at : at + shard["n_tokens"]]
        at += shard["n_tokens"]
    assert at == len(ids)


def test_token_files_of_an_empty_table(empty):
    shards = token_files.write_token_files(empty, TOKENIZER)
    assert shards.count() == 0 and token_files.read_token_files(shards).count() == 0


@pytest.mark.parametrize("table", ["small", "odd"])
def test_packing_covers_every_document(request, plain, table):
    docs = request.getfixturevalue(table)
    packed = packing.digests(packing.packed(packing.pieces(docs, TOKENIZER))).collect()
    assert_packed(packed, [(d, [*i, 2]) for (d, _), i in zip(rows_of(docs), plain(t for _, t in rows_of(docs)))])


def assert_packed(packed, documents, slack=1.01):
    want, have, sequences = defaultdict(int), defaultdict(int), defaultdict(list)
    for d, ids in documents:
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, k, a, b - a, crc(ids[a:b])] += 1
    for r in packed:
        have[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert have == want
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    least = math.ceil(sum(len(i) for _, i in documents) / 1024)
    assert len(sequences) <= max(least * slack, least + 1)


def test_packing_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 64)
    rng = np.random.default_rng(3)
    lengths = [int(n) for n in rng.integers(1, 1024, 700)]
    items = spark.createDataFrame(list(enumerate(lengths)), "uid bigint, length bigint")
    places = packing.pack(items).collect()
    assert sorted(r["uid"] for r in places) == list(range(700))
    bins = defaultdict(list)
    for r in places:
        bins[r["sequence_id"]].append((r["offset"], lengths[r["uid"]]))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(bins) <= math.ceil(sum(lengths) / 1024) * 1.05


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 63), min_size=1, max_size=60), st.integers(0, 9))
def test_crossover_keeps_every_item_once(lengths, seed):
    lengths = sorted(lengths, reverse=True)
    first, second = (packing.as_bins(a) for a in packing.evolve(lengths, [], 64, seed)[:2])
    child = packing.cross(first, second, lengths, 64, random.Random(seed))
    assert sorted(i for held in child for i in held) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in held) <= 64 for held in child)


def test_lengths_that_seldom_fill_a_bin_are_pooled_too(spark, monkeypatch):
    """Three of 300 to 330 leave 3 % and more of a bin empty: only the last bins of the blocks can be pooled."""
    monkeypatch.setattr(packing, "BLOCK_PIECES", 64)
    rng = random.Random(4)
    lengths = [rng.randint(300, 330) for _ in range(1000)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "uid bigint, length bigint")).collect()
    assert sorted(r["uid"] for r in rows) == list(range(1000))
    # One part-filled bin in all, not one in each of 16 blocks.
    assert len({r["sequence_id"] for r in rows}) == -(-1000 // 3)


def test_packing_of_an_empty_table(empty):
    assert packing.packed(packing.pieces(empty, TOKENIZER)).count() == 0


@pytest.mark.parametrize("table", ["small", "odd"])
def test_length_histogram(request, plain, table):
    docs = request.getfixturevalue(table)
    lengths = [len(i) for i in plain(t for _, t in rows_of(docs))]
    histogram = token_counts.length_histogram(docs, TOKENIZER)
    limits = token_counts.context_limits(histogram)
    rows = {r["context_limit"]: r for r in limits.collect()}
    assert sorted(rows) == sorted(set(lengths))
    for limit, r in rows.items():
        kept = sum(min(n, limit) for n in lengths)
        assert r["n_docs"] == lengths.count(limit)
        assert r["docs_within"] == sum(n <= limit for n in lengths) == len(lengths) - r["docs_beyond"]
        assert r["tokens_within"] == sum(n for n in lengths if n <= limit)
        assert (r["kept_tokens"], r["lost_tokens"]) == (kept, sum(lengths) - kept)
    for r in token_counts.answers(histogram, [0, 10, 10**6]).collect():
        assert r["kept_tokens"] == sum(min(n, r["context_limit"]) for n in lengths)
        assert r["docs_within"] == sum(n <= r["context_limit"] for n in lengths)
    for r in token_counts.quantiles(limits, [0.1, 0.5, 1.0]).collect():
        assert r["n_tokens"] == sorted(lengths)[math.ceil(r["share"] * len(lengths)) - 1]


def test_length_histogram_of_an_empty_table(empty):
    assert token_counts.context_limits(token_counts.length_histogram(empty, TOKENIZER)).count() == 0
