from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from edulake.llm import packing, queries
from edulake.llm.textops import slices

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ADDED = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pieces_hold_every_id_once_and_in_order(edges, tokenizer):
    texts = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in edges.collect())
    found = packing.pack(edges, RANKS, public_tokenizers.PATTERN, window=128, added=ADDED).collect()
    whole, start = [], 0
    rows = sorted(found, key=lambda r: (r.sequence_id, r.offset))
    fill = 0
    for before, r in zip([None, *rows], rows):
        fill = fill if before is not None and before.sequence_id == r.sequence_id else 0
        assert r.offset == fill and r.length == len(r.ids) // 4
        fill += r.length
        assert fill <= 128
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r.doc_id is None, r.doc_id or 0].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    want = defaultdict(list)
    for absent, id, text in texts:
        want[absent, id].append([*tokenizer.encode(text, add_special_tokens=False).ids, 0])
    for key, own in by_doc.items():
        total = sum(len(ids) for _, ids, _ in own)
        assert total == sum(map(len, want[key]))
        if len(want[key]) == 1:
            joined = [i for _, ids, _ in sorted(own) for i in ids]
            assert joined == want[key][0] and {n for *_, n in own} == {len(joined)}
            assert [s for s, *_ in sorted(own)] == list(range(0, len(joined), 128))
    assert set(by_doc) == set(want) and whole == [] and start == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab é　中😀 \n\t.'1<|>sS ", "<|endoftext|>", "  "]), max_size=40).map("".join), max_size=4))
def test_segments_give_the_ids_of_the_whole_text(texts):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.Segments(RANKS, public_tokenizers.PATTERN, ADDED)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, type=pa.string())], ["text"])
    found = []
    for part in slices(batch, most=16):
        ids, counts = encoder.encode(part)
        found += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert found == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_have_their_ids(spark, monkeypatch):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = ["a <|endoftext|> b", end, end * 2, f"x{end}y", f"two  {end}  b\n\n{end}\n", f" {end[:-1]} {end}é's", "a <|endoftext |>"]
    choose = random.Random(7)
    texts += ["".join(choose.choices([end, " ", "  ", "a", "é", "'s", "\n", "12", "<|"], k=12)) for _ in range(300)]
    want = {k: [*own.encode(t, add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 275, 0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(queries, "table", lambda *args: docs)
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in queries.packed(spark, "").collect()}
    for r in corpus_pipeline.pack_sequences(spark, docs, "").collect():
        assert r.start == 0 and np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id], texts[r.doc_id]
        assert digests[r.doc_id, 0] == zlib.crc32(r.ids) and r.doc_tokens == len(want[r.doc_id])
    assert len(digests) == len(texts)


def test_remembered_segments_give_the_same_ids(tokenizer, monkeypatch):
    """Small generations, which fill up and go again and again; every text comes several times."""
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 4000)
    encoder = packing.Segments(RANKS, public_tokenizers.PATTERN, ADDED)
    choose = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("ab", "é", "Z", "12") for b in ("", "x", "'s") for c in ("ing", "<|endoftext|>", "o")]
    texts = [" ".join(choose.choices(words, k=choose.randint(0, 60))) + choose.choice(["", " ", "\n\n"]) for _ in range(60)]
    texts = texts * 3
    batch = pa.RecordBatch.from_arrays([pa.array(texts, type=pa.string())], ["text"])
    found = []
    for part in slices(batch, most=700):
        ids, counts = encoder.encode(part)
        found += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert encoder.newer.size() + encoder.newest.size() < 4000 + 2000 + 60_000
    assert found == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_tightest_window_is_found():
    choose = random.Random(3)
    tree, held = packing.OpenWindows(100), []
    for step in range(3000):
        if held and choose.random() < 0.5:
            length = choose.randint(1, 100)
            found = tree.tightest(length)
            fits = [c for c, _ in held if c >= length]
            assert (found is None) == (not fits)
            if found:
                assert found[0] == min(fits)
                held.remove(found)
        else:
            own = (choose.randint(1, 99), step)
            tree.add(*own)
            held.append(own)


def test_query_digest_and_empty_table(spark, documents, nothing):
    from edulake.llm.queries import QUERIES
    from tests.llm.conftest import FOLDER

    rows = QUERIES["op6_packing"](spark, FOLDER).collect()
    pieces = packing.pack(documents, RANKS, public_tokenizers.PATTERN).collect()
    assert {(r.doc_id, r.start, r.ids_crc32) for r in rows} == {(r.doc_id, r.start, zlib.crc32(r.ids)) for r in pieces}
    used = sum(r.length for r in rows)
    assert used > 0.97 * 1024 * len({r.sequence_id for r in rows})
    assert packing.pack(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
