import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from alertweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
REFERENCE = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
)
MODEL = bpe.Bpe(RANKS)
ENCODER = bpe.TextEncoder(MODEL, public_tokenizers.PATTERN)


def ids(text):
    return bpe.np.frombuffer(ENCODER.encode(text), "<i4").tolist()


def test_rank_file_is_read_as_written():
    with open(PATH, "rb") as f:
        first = f.readline().split()
    assert RANKS[base64.b64decode(first[0])] == int(first[1])


@pytest.mark.parametrize("text", [
    "", " ", "  ", "a  b", "a   b", "\n \nx", "foo \nbar", "foo\n bar", "it's we'll 'tis", "x y",
    "1²½ 3Ⅷ _a_ __ b_1", "\x1c \x1fa \x85b", "İÉé Σ", "<|endoftext|> x",
    "á \U0001f600\U0001f600 中文", "!!!??? ...,,, ", "0" * 500 + "a" * 500,
])
def test_encodes_like_the_library(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(" \n\t'.,aestEÉñß19²中_\x1c"), max_size=60))
def test_encodes_random_text_like_the_library(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40), st.text(max_size=40), st.data())
def test_append_and_edit_equal_a_new_encoding(first, more, data):
    a, b = first.encode(), more.encode()
    state = MODEL.append(MODEL.append(bpe.Prefixes(), a), b)
    assert state.last == MODEL.append(bpe.Prefixes(), a + b).last
    start = data.draw(st.integers(0, len(a + b)))
    end = data.draw(st.integers(start, len(a + b)))
    edited = MODEL.edit(state, start, end, b"the new ")
    whole = MODEL.append(bpe.Prefixes(), edited.data)
    assert edited.data == (a + b)[:start] + b"the new " + (a + b)[end:] and edited.last == whole.last
    assert MODEL.tokens(edited) == MODEL.merged(edited.data)


def test_an_edit_leaves_what_lies_far_behind_it():
    random.seed(1)
    text = "".join(random.choice("etaoin shrdlu") for _ in range(3000)).encode()
    state = MODEL.append(bpe.Prefixes(), text)
    calls = []
    original = MODEL._last_token
    MODEL._last_token = lambda *a: calls.append(1) or original(*a)
    try:
        edited = MODEL.edit(state, 100, 103, b"xyz!")
    finally:
        MODEL._last_token = original
    assert edited.last == MODEL.append(bpe.Prefixes(), edited.data).last and len(calls) < 300


def test_frame_handles_null_empty_long_repeated_and_clashing(docs):
    long = "word " * 50_000 + "end"
    rows = [(1, None), (2, ""), (3, long), (4, "It's É."), (4, "It's É."), (None, "x")]
    df = bpe.decode(bpe.encode(docs(rows, clash=("ids", "decoded"))))
    got = {(r.doc_id, r.text): r for r in df.collect()}
    assert df.count() == 6 and got[1, None].ids == [] and bytes(got[2, ""].decoded) == b""
    for (_, text), r in got.items():
        assert r.ids == REFERENCE.encode_ordinary(text or "") and bytes(r.decoded) == (text or "").encode()
    digests = {r.doc_id: r for r in bpe.digests(docs(rows)).collect()}
    want = ",".join(map(str, REFERENCE.encode_ordinary("It's É.")))
    assert digests[4].ids_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert digests[1].n_tokens == 0 and bpe.digests(docs([])).count() == 0


def test_round_trip_in_one_pass_and_small_stores(docs, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    random.seed(3)
    texts = [" ".join(random.choices(["abcdefgh", "xyzzyq", "Éàù", "it's", "12345", "q" * 40], k=60)) for _ in range(20)]
    rows = list(enumerate([*texts, None, ""]))
    df = bpe.round_trip(docs(rows, clash=("n_tokens", "ids")), ids="ids")
    assert str(df._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1
    for r in df.collect():
        want = REFERENCE.encode_ordinary(r.text or "")
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_stores_keep_to_their_bounds(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    model = bpe.Bpe(RANKS)
    encoder = bpe.TextEncoder(model, public_tokenizers.PATTERN)
    random.seed(4)
    for _ in range(30):
        text = " ".join("".join(random.choices("abcdefghijklmnopqr", k=9)) for _ in range(30))
        assert bpe.np.frombuffer(encoder.encode(text), "<i4").tolist() == REFERENCE.encode_ordinary(text)
    assert len(model._pairs) <= 50 and len(model.known) <= 100
    assert len(encoder.after_space) <= 25 and len(encoder.after_space.old) <= 25


def test_texts_are_encoded_in_slices(docs, monkeypatch):
    texts = [None if i % 7 == 0 else f"a text no. {i}" for i in range(600)]
    rows = docs(list(enumerate(texts))).coalesce(1)
    sizes = []
    monkeypatch.setattr(bpe, "add_columns", lambda df, make, new, rows=0: sizes.append(rows))
    bpe.round_trip(rows)
    assert 0 < sizes[0] < 600
    monkeypatch.undo()
    found = bpe.round_trip(rows, ids="ids").collect()
    plain = {r.doc_id: r.ids for r in bpe.encode(rows).collect()}
    assert [r.text for r in found] == texts and all(r.ids == plain[r.doc_id] for r in found)
