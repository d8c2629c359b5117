from __future__ import annotations

import bisect
import hashlib
import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path as tokenizer_file

from pixelmill.llm import bpe_automaton, token_lengths
from tests.llm.fixtures import awkward, documents

JSON, RANKS = Path(tokenizer_file("byte_bpe_50k.json")), tokenizer_file("byte_bpe_50k.tiktoken")
tokenizers = pytest.importorskip("tokenizers")
LIBRARY = tokenizers.Tokenizer.from_file(str(JSON))
OWN = bpe_automaton.Tokenizer(JSON.read_bytes())


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_encoded_as_the_library_does(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_awkward_strings():
    rng = random.Random(2)
    alphabet = [" ", "  ", "\n", "\t", "\xa0", "　", "a", "the", "'s", "don't", "é", "中", "🙂", "12", "½", "$%", "<|endoftext|>", "\x00", "\r\n"]
    for text in ["".join(rng.choices(alphabet, k=rng.randint(1, 14))) for _ in range(800)] + ["a" * 5000, "zq" * 3000, " " * 999]:
        assert OWN.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_round_trip_table(spark):
    rows = awkward()
    got = {}
    for r in bpe_automaton.round_trip(documents(spark, rows), str(JSON)).collect():
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_sha256, r.decoded_sha256))
    expected = {}
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False))]
        expected.setdefault(i, []).append((len(ids), *sha))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}


def test_encode_then_decode_documents(spark):
    rows = [(i, t) for i, t in awkward() if i is not None and i != 73 and i != 74]
    encoded = bpe_automaton.encode_documents(documents(spark, rows), str(JSON))
    assert {r.doc_id: r.text for r in bpe_automaton.decode_documents(encoded, str(JSON)).collect()} == {i: t or "" for i, t in rows}


def test_length_histogram_matches_brute_force(spark):
    rows = [*awkward(), (300, "a <|endoftext|> b"), (301, "<|endoftext|><|endoftext|>"), (302, "x<|endoftext|")]
    lengths = token_lengths.token_lengths(documents(spark, rows), RANKS)
    n = sorted(r.n_tokens for r in lengths.collect())
    assert n == sorted(len(LIBRARY.encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    histogram = token_lengths.length_histogram(lengths, block=16).cache()
    for r in histogram.collect():
        x = r.n_tokens
        longer = [k for k in n if k >= x]
        assert (r.n_docs, r.tokens, r.docs_from, r.tokens_from) == (n.count(x), x * n.count(x), len(longer), sum(longer))
        assert r.truncated_tokens == sum(min(k, x) for k in n) and r.overflow_tokens == sum(n) - r.truncated_tokens
        assert r.quantile == pytest.approx(bisect.bisect_right(n, x) / len(n))
    for limit in (0, 1, 7, 100, 10**6):
        assert token_lengths.total_at(histogram, limit).first()[0] == sum(min(k, limit) for k in n)
    assert token_lengths.length_at(histogram, 0.5).first()[0] == n[-(-len(n) // 2) - 1]
    assert token_lengths.length_histogram(lengths.limit(0)).count() == 0
