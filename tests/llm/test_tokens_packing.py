"""Token counts and packing against the tokenizer library."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from webquarry.llm.bpe import MergeCounter
from webquarry.llm.packing import Capacity, _Ids, best_fit, pack_documents
from webquarry.llm.token_counts import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ROWS = [(1, "Hello, world!", 9), (2, None, 9), (3, "", 9), (4, "héllo ΣΑΣ <|endoftext|> x", 9), (4, "héllo ΣΑΣ <|endoftext|> x", 9), (None, "a b", 9), (7, "x" * 30_000, 9), (8, "word " * 5000, 9)]
SCHEMA = "doc_id long, text string, n_tokens int"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.characters(min_codepoint=1, max_codepoint=0x2FF), st.sampled_from("ΣςİÅ'sS <|>🙂\u3000\u0301\x1c"), st.just("<|endoftext|>")), max_size=30))
def test_equals_library(parts):
    text = "".join(parts)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert COUNTER(text) == len(want)
    assert IDS([text])[0] == np.array(want, dtype="<u4").tobytes()


COUNTER, IDS = MergeCounter(PATH), _Ids(PATH, cache_size=50)


def test_merges_are_symbols_minus_tokens():
    assert COUNTER.merges("") == (0, 0)
    symbols, merges = COUNTER.merges("hello")
    assert symbols == 5 and symbols - merges == len(LIBRARY.encode("hello", add_special_tokens=False).ids)


def test_token_counts(spark):
    got = token_counts(spark.createDataFrame(ROWS, SCHEMA), PATH).collect()
    want = [(i, len((t or "").encode()), len(LIBRARY.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ROWS]
    assert sorted(map(str, [tuple(r)[:3] for r in got])) == sorted(map(str, want))
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_packing_is_a_round_trip(spark):
    rows = pack_documents(spark.createDataFrame(ROWS, SCHEMA), PATH).collect()
    want = []
    for i, t, _ in ROWS:
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], dtype="<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted(map(str, [tuple(r)[:5] for r in rows])) == sorted(map(str, want))
    places: dict = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=120), st.sampled_from(["norm", "dot"]))
def test_best_fit_keeps_all_constraints(lengths, rule):
    capacity = Capacity(64, 5, 64 * 64 // 2 + 2048)
    bins, offsets = best_fit(np.array(lengths, dtype=float), capacity, rule=rule)
    for b in set(bins.tolist()):
        inside = [(o, n) for o, n, x in zip(offsets, lengths, bins, strict=True) if x == b]
        assert sum(n for _, n in inside) <= 64 and len(inside) <= 5 and sum(n * n for _, n in inside) <= capacity.attention
        assert sorted(o for o, _ in inside) == [sum(n for p, n in inside if p < o) for o in sorted(o for o, _ in inside)]


def test_best_fit_refuses_what_never_fits():
    with pytest.raises(ValueError):
        best_fit(np.array([65.0]), Capacity(64, 5, 4096))
