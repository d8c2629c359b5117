from __future__ import annotations

import json
import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelmill.llm import harmonic_packing
from pixelmill.llm.harmonic_packing import END_ID, pack, reciprocal_cuts, sequences, stretches
from pixelmill.llm.queries import op12_packing
from tests.llm.fixtures import awkward, documents
from tests.llm.test_tokens import JSON, LIBRARY


def tokens(text: str | None) -> list[int]:
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, END_ID]


def check(pieces: list, expected: list[list[int]], capacity: int) -> None:
    """Every token in one piece, every sequence full without a gap, and no padding."""
    by_sequence = defaultdict(list)
    for doc_id, start, length, crc, doc_tokens, sequence_id, offset in pieces:
        by_sequence[sequence_id].append((offset, length))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for inside in by_sequence.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    assert sum(p[2] for p in pieces) == sum(map(len, expected))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 50_000), st.sampled_from([8, 64, 2048]))
def test_cuts_are_reciprocals(n, capacity):
    cuts = reciprocal_cuts(n, capacity)
    assert sum(cuts) == n and all(capacity % c == 0 for c in cuts) and cuts == sorted(cuts, reverse=True)
    assert max([cuts.count(c) for c in set(cuts) if c < capacity], default=0) <= 1


def test_stretches_are_encoded_alike():
    text = " ".join(["naïve  x", "don't", "\n y", "12", "a", "<|endoftext|>", "é"] * 60)
    for size in (1, 7, 50):
        parts = stretches(text, size)
        assert "".join(parts) == text and len(parts) > 3
        assert [i for p in parts for i in LIBRARY.encode(p, add_special_tokens=False).ids] == tokens(text)[:-1]
    assert stretches("x" * 500, 10) == ["x" * 500]


def test_encoder_equals_the_library():
    encode = harmonic_packing.encoder(JSON.read_bytes()).encode
    rng = random.Random(4)
    alphabet = [" ", "  ", "\n", "\t", "\x85", "\xa0", "\u2028", "\u3000", "\x1c", "a", "the", "'s", "é", "中", "½", "$%", "<|endoftext|>", "\x00", "\r\n"]
    for text in ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(500)] + [" " * 1_000_000, "\n" * 400_000 + "a", "x" * 100_000]:
        assert encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_vocabulary_of_another_order():
    """Numbers that do not tell the turn of the merges: the library itself encodes."""
    vocabulary = {"a": 0, "b": 1, "c": 2, "bc": 3, "ab": 4}
    content = json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocabulary, "merges": ["a b", "b c"]}})
    own = harmonic_packing.Encoder(content.encode())
    assert own.ranks is None and own.encode("abc").tolist() == [4, 2]


def test_packing_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(harmonic_packing, "STRETCH", 300)
    rows = [*awkward(), (None, "again"), (95, "long " * 3000)]
    for capacity in (64, 2048):
        packed = pack(documents(spark, rows).repartition(3), str(JSON), capacity=capacity)
        got = packed.collect()
        check([(r.doc_id, r.start, r.length, 0, r.doc_tokens, r.sequence_id, r.offset) for r in got], [tokens(t) for _, t in rows], capacity)
        of_id = defaultdict(list)
        for i, t in rows:
            of_id[i].append(tokens(t))
        for i, texts in of_id.items():
            mine = [r for r in got if r.doc_id == i]
            for ids in texts:  # each row of an id finds pieces that cover it
                at = 0
                for length in reciprocal_cuts(len(ids), capacity):
                    want = np.array(ids[at : at + length], "<u4").tobytes()
                    mine.remove(next(r for r in mine if (r.start, r.length, r.doc_tokens, bytes(r.ids)) == (at, length, len(ids), want)))
                    at += length
            assert not mine
        whole = sequences(packed).collect()
        assert sum(r.n_tokens for r in whole) == sum(len(tokens(t)) for _, t in rows) and all(len(r.ids) == 4 * r.n_tokens for r in whole)
    assert pack(documents(spark, []), str(JSON)).collect() == []


def test_query_on_tables(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: tokens(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [tuple(r) for r in op12_packing(spark, sf).collect()]
    check(got, list(texts.values()), 2048)
    covered = defaultdict(list)
    for doc_id, start, length, crc, doc_tokens, _, _ in got:
        ids = texts[doc_id]
        assert doc_tokens == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
        covered[doc_id] += range(start, start + length)
    assert {i: sorted(x) for i, x in covered.items()} == {i: list(range(len(ids))) for i, ids in texts.items()}
