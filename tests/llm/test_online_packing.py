"""Online packing against the tokenizer and its own rules."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgersight.llm import QUERIES, online_packing
from tests.conftest import BASE

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30) | st.text(alphabet="aZé' .\n\t\x1c\x85 ́İΣσ1<|>", max_size=30)
                | st.text(alphabet="aZ'sé÷ßÿÀ×²ª..1", max_size=30) | st.just("a <|endoftext|> b<|startoftext|>c") | st.text(alphabet="ab", min_size=50, max_size=60), max_size=4))
def test_chunks_have_the_library_s_ids(tokenizer, texts):
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [online_packing.chunk_ids(PATH).text(t) for t in texts] == want


def test_bounded_memory_changes_nothing(tokenizer, monkeypatch):
    texts = [f"word{i} again again{i % 3} {'long' * 20}" for i in range(40)]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    monkeypatch.setattr(online_packing, "CACHE", 5)
    ids = online_packing.ChunkIds(PATH)
    assert [ids.text(t) for t in texts * 2] == want * 2 and len(ids) <= 5


def check(rows, want, capacity):
    """Pieces hold each document's ids once, in windows without gaps or padding."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sum(len(v) for v in want.values()) == sum(r.length for r in rows)
    for doc, ids in want.items():
        at = 0
        for r in sorted(docs[doc], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    lengths = []
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        lengths.append(at)
    assert max(lengths, default=0) <= capacity
    assert all(n & (n - 1) == 0 for n in lengths)          # the capacity or a smaller power of two: no padding
    assert sum(n < capacity for n in lengths) < capacity.bit_length()
    return lengths


def test_query_holds_every_id_once(spark, tokenizer):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{BASE}/documents.parquet").collect()}
    want = {d: tokenizer.encode(t, add_special_tokens=False).ids + [1] for d, t in texts.items()}
    rows = QUERIES["op12_online_packing"](spark, BASE).collect()
    lengths = check(rows, want, 2048)
    uncut = sum(len(v) <= 2048 for v in want.values())
    cut = sum(1 for d in want if len(want[d]) <= 2048 and sum(r.doc_id == d for r in rows) > 1)
    assert cut < uncut / 2 and len(lengths) < sum(map(len, want.values())) / 2048 + 12


@pytest.mark.parametrize("windows, fan", [(1, 2), (3, 2), (8, 32)])
def test_many_partitions_are_merged_in_rounds(spark, tokenizer, windows, fan):
    rows = [(i, " ".join(["ab"] * (i * 7 % 90))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(13)
    want = {d: tokenizer.encode(t, add_special_tokens=False).ids + [1] for d, t in rows}
    check(online_packing.pack_online(docs, capacity=64, windows=windows, fan=fan).collect(), want, 64)


def test_best_fit_and_fullest():
    w = online_packing.Windows(10, 2)
    part = lambda d, n: [(d, 0, n, bytes(4 * n))]
    put = lambda d, n: [[(p[0], p[1], len(p[3]) // 4) for p in full] for full in w.put(part(d, n))]
    assert put("a", 7) == [] and put("b", 6) == []          # rooms 3 and 4
    assert put("c", 4) == [[("b", 0, 6), ("c", 0, 4)]]      # the room it fits best
    # none takes 6: the fullest is filled up, and the rest goes on
    assert put("d", 8) == [] and put("e", 6) == [[("d", 0, 8), ("e", 0, 2)]]
    assert sorted(room for room, _ in w.open) == [3, 6]
    assert put("f", 25)[:2] == [[("f", 0, 10)], [("f", 10, 10)]]


def test_odd_rows(spark, tokenizer):
    rows = [(1, None), (2, ""), (3, " \n \n"), (4, "Same text"), (5, "same <|endoftext|> text"), (6, "1" * 3_000), (7, "wörd " * 4_000)]
    schema = "doc_id bigint, text string, part int, ids string, length int, sequence_id string"
    docs = spark.createDataFrame([(d, t, 1, "x", 2, "y") for d, t in rows], schema)
    want = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for d, t in rows}
    check(online_packing.pack_online(docs).collect(), want, 2048)
    twice = online_packing.pack_online(docs.unionByName(docs).where("doc_id = 4 or doc_id is null")).collect()
    assert sorted((r.sequence_id, r.offset) for r in twice) == sorted({(r.sequence_id, r.offset) for r in twice})
    assert {r.doc_id for r in twice} == {4} and sum(r.length for r in twice) == 6       # two documents of three tokens
    nobody = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id bigint, text string")
    assert [r.doc_id for r in online_packing.pack_online(nobody).collect()].count(None) >= 2
    assert online_packing.pack_online(docs.limit(0)).count() == 0
