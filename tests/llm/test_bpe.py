import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prismgrid.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    import base64

    import public_tokenizers as P

    path = bpe.vocabulary_path()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return bpe.Encoder(path), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(encoder, texts):
    ids, ends = encoder.encode(texts)
    return [ids[ends[i] : ends[i + 1]].tolist() for i in range(len(texts))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=80), min_size=1, max_size=6))
def test_same_ids_as_the_library(both, texts):
    assert encoded(both[0], texts) == [both[1].encode_ordinary(t) for t in texts]
    assert both[0].count(texts) == [len(both[1].encode_ordinary(t)) for t in texts]


def test_long_and_odd_texts(both):
    rng = random.Random(1)
    texts = ["x" * 5000, "aab" * 3000, "".join(rng.choices("abcdefg", k=6000)), "日本語" * 500, "<|endoftext|>", "  \n\t  x", "", None]
    assert encoded(both[0], texts) == [both[1].encode_ordinary(t or "") for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcdeé日'-_0=", max_size=60), min_size=1, max_size=4))
def test_heap_and_rounds_give_the_same(both, texts):
    words = [w.encode() for w in texts if w]
    ids, sizes = both[0].merge(words)
    assert [both[0].merge_long(w) for w in words] == [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])][: len(words)]


def test_a_word_of_a_megabyte(both):
    rng = random.Random(2)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=1_000_000))
    began = time.time()
    (got,) = encoded(both[0], [word])
    assert time.time() - began < 60
    assert got == both[1].encode_ordinary(word)
    both[0].forget()


def test_memory_is_bounded(both, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    for text in ("one two three four five", "six seven", "one two"):
        assert encoded(both[0], [text]) == [both[1].encode_ordinary(text)]


def test_round_trip_of_documents(frame, both):
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(["Hello world", "", None, "Grüße 🙂"])] + [{"doc_id": 0, "text": "Hello world"}, {"doc_id": None, "text": "x"}]
    out = bpe.encode_documents(frame("documents", rows, ", ids string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, both[1].decode(r.ids)) for r in out) == [
        (False, 0, "Hello world"), (False, 0, "Hello world"), (False, 1, ""), (False, 2, ""), (False, 3, "Grüße 🙂"), (True, 0, "x"),
    ]
    assert bpe.encode_documents(frame("documents", [])).count() == 0
