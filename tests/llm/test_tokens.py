"""Token counts, chunk encoding and coded files against the tokenizers library."""

import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelloom.llm import rans, token_cache
from labelloom.llm.common import new_folder
from labelloom.llm.tokenizing import ChunkEncoder, letters_model, library_tokenizer

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
HARD = ["", " ", "a  b", "a \n b\n\nc", "tab\tx", "it's  we'll", "<|endoftext|>", "a  <|endoftext|> b", "ñandú  ÉTÉ",
        "é ́x", "nbsp x  　y", "\x1c x", "  y", "Σ ΑΣ ΑΣ.", "漢字 かな", "😀 👩‍👩‍👧", "12,345.67 %", "\x85z",
        " lead", "trail ", "a\r\nb", "\x0b\x0c"]


def library(path, text):
    return library_tokenizer(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path,spaces", [(BYTES, True), (WORDS, False)])
def test_chunks_give_the_library_s_ids(path, spaces):
    ids, sizes = ChunkEncoder(path, spaces).encode(HARD)
    want = [library(path, t) for t in HARD]
    assert [len(w) for w in want] == sizes.tolist()
    assert [i for w in want for i in w] == ids.tolist()
    assert ChunkEncoder(path, spaces).counts(HARD).tolist() == sizes.tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'<|>aébZ1. ́"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text(text):
    for path, spaces in ((BYTES, True), (WORDS, False)):
        encoder = ChunkEncoder(path, spaces, max_chunks=5)
        assert encoder.encode([text, text])[0].tolist() == library(path, text) * 2


@given(st.text(alphabet=" \n\t\x0b<|>endoftxÉa", max_size=30))
@settings(max_examples=60, deadline=None)
def test_normalisation_keeps_the_count(text):
    normal = " ".join(x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text) if x)
    assert len(library(WORDS, normal)) == len(library(WORDS, text))


def test_cache_encodes_only_what_it_lacks(llm, documents):
    folder = new_folder(llm, "cache")
    first = documents((1, "one two"), (2, "one  two"), (3, None), (None, "x y"), (1, "other"), (1, "one two"))
    rows = token_cache.token_counts(first, folder, WORDS).collect()
    want = sorted([(1, 7, 2), (2, 8, 2), (3, 0, 0), (-1, 3, 2), (1, 5, 1), (1, 7, 2)])
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in rows) == want
    assert llm.read.parquet(folder).count() == 4
    again = documents((9, " one two "), (10, "new"))
    assert sorted((r.doc_id, r.n_tokens) for r in token_cache.token_counts(again, folder, WORDS).collect()) == [(9, 2), (10, 1)]
    assert llm.read.parquet(folder).count() == 5
    assert token_cache.token_counts(documents((1, "x")).limit(0), new_folder(llm, "cache"), WORDS).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 70000), min_size=1, max_size=400), st.integers(1, 90))
def test_round_trip(ids, times):
    ids = np.array(ids * times, np.uint32)
    coded = rans.encode_segment(ids)
    assert coded[1].sum() == 1 << rans.SCALE_BITS and coded[1].min() >= 1
    assert (rans.decode_segment(*coded) == ids).all()


def test_blocks_decode_alone_and_are_checked():
    ids = np.random.default_rng(0).zipf(1.3, 5 * rans.BLOCK).clip(0, 60000).astype(np.uint32)
    table, freqs, payload, marks = rans.encode_segment(ids)
    assert len(payload) < 2 * len(ids)
    part = rans.decode_segment(table, freqs, payload, marks, first=2, count=2)
    assert (part == ids[2 * rans.BLOCK:4 * rans.BLOCK]).all()
    broken = payload[:marks[1]["offset"] + 9] + bytes([payload[marks[1]["offset"] + 9] ^ 1]) + payload[marks[1]["offset"] + 10:]
    with pytest.raises(ValueError):
        rans.decode_segment(table, freqs, broken, marks)


def test_more_ids_than_the_scale_divides_well():
    counts = np.ones(50257, np.int64)
    counts[7] = 10 ** 9
    freqs = rans.frequency_table(counts)
    assert freqs.sum() == 1 << rans.SCALE_BITS and freqs.min() == 1


def test_more_ids_than_a_table_holds():
    with pytest.raises(ValueError):
        rans.frequency_table(np.ones(65_537, np.int64))
    assert rans.frequency_table(np.ones(65_536, np.int64)).tolist() == [1] * 65_536
    ids = np.random.default_rng(2).permutation(np.arange(90_000, dtype=np.uint32) * 3)
    symbols, halves = rans.as_symbols(ids)
    assert halves and (rans.as_ids(rans.decode_segment(*rans.encode_segment(symbols)), halves) == ids).all()
    same, halves = rans.as_symbols(ids[:65_536])
    assert not halves and (rans.as_ids(rans.decode_segment(*rans.encode_segment(same)), halves) == ids[:65_536]).all()


def test_rows_without_id_or_of_one_id_share_no_task(llm, documents):
    rows = [(None if i % 3 else 7, f"text number {i}") for i in range(600)] + [(9, "z")] * 50
    folder, key = new_folder(llm, "rans"), "spark.sql.adaptive.coalescePartitions.enabled"
    before = llm.conf.get(key)
    try:
        llm.conf.set(key, "false")
        rans.write_tokens(documents(*rows).repartition(5), folder, BYTES, segment_tokens=1000)
    finally:
        llm.conf.set(key, before)
    files = llm.read.parquet(folder).select("part", F.explode("docs").alias("d"))
    parts = {r.doc_id: r.n for r in files.groupBy("d.doc_id").agg(F.count_distinct("part").alias("n")).collect()}
    assert parts[None] > 1 and parts[7] > 1
    found = rans.read_tokens(llm, folder).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None] * 400 + [7] * 200 + [9] * 50
    assert all(a.start + a.n_tokens == b.start for a, b in zip(found, found[1:]))


def test_files_hold_all_documents_in_order(llm, documents):
    long = "word " * 3000
    rows = [(5, "b"), (2, None), (3, ""), (1, long), (3, "twice"), (None, "no id")]
    folder = new_folder(llm, "rans")
    rans.write_tokens(documents(*rows), folder, BYTES, segment_tokens=1000)
    found = sorted(rans.read_tokens(llm, folder).collect(), key=lambda r: r.start)
    hashes = {r.text: r.h for r in documents(*rows).select("text", F.xxhash64("text").alias("h")).collect()}
    start = 0
    for row, (key, text) in zip(found, sorted(rows, key=lambda r: (r[0] or -1, hashes[r[1]]))):
        ids = np.array(library(BYTES, text or "") + [rans.END_ID], "<u4")
        assert tuple(row) == (key, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    empty = new_folder(llm, "rans")
    rans.write_tokens(documents((1, "x")).limit(0), empty, BYTES)
    assert rans.read_tokens(llm, empty).count() == 0
