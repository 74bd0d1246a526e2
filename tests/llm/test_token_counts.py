import uuid

import public_tokenizers
from tokenizers import Tokenizer

from alertweave.llm import token_counts
from alertweave.llm.common import shared_folder

with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
    BYTES = f.read()
with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
    WORDS = f.read()
TEXTS = ["", " ", "a  b", "a\n b", "It's É ñ.", "x <|endoftext|> y", "<|endoftext|>", "one two  three\n\n", "w " * 9000,
         "1² 中文 \x1c", "foo \nbar"]


def cache_of(spark):
    return f"{shared_folder(spark)}/test-cache-{uuid.uuid4().hex}"


def test_counts_are_the_librarys(docs, corpus):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(90, None), (0, ""), (None, "a  b")]
    for definition in (BYTES, WORDS):
        library = Tokenizer.from_str(definition)
        got = token_counts.count_tokens(docs(rows, clash=("n_tokens",)), cache_of(corpus), definition).collect()
        assert len(got) == len(rows)
        by_id = {r.doc_id: r for r in got if r.doc_id is not None}
        for i, t in enumerate(TEXTS):
            assert by_id[i].n_tokens == len(library.encode(t, add_special_tokens=False).ids), t
            assert by_id[i].n_bytes == len(t.encode())
        assert by_id[90].n_tokens == 0 and by_id[90].n_bytes == 0


def test_only_misses_are_encoded_and_appended(docs, corpus):
    cache = cache_of(corpus)
    token_counts.count_tokens(docs([(1, "a b"), (2, "a b"), (3, "c")]), cache, BYTES).collect()
    assert token_counts.read_cache(corpus, cache).count() == 2
    # A stored count is trusted: no text that the cache knows is encoded again.
    known = token_counts.read_cache(corpus, cache).selectExpr(
        "content_digest", "tokenizer_digest", "n_tokens + 100 as n_tokens"
    )
    second = cache_of(corpus)
    known.write.parquet(second)
    got = token_counts.count_tokens(docs([(1, "a b"), (4, "new text")]), second, BYTES).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {1: 102, 4: 2}
    assert token_counts.read_cache(corpus, second).count() == 3
    # Another tokenizer has its own counts.
    token_counts.count_tokens(docs([(1, "a b")]), second, WORDS).collect()
    assert token_counts.read_cache(corpus, second).count() == 4


def test_many_misses_are_not_broadcast(docs, corpus, monkeypatch):
    rows = [(i, f"text {i % 7}") for i in range(40)]
    want = sorted(token_counts.count_tokens(docs(rows), cache_of(corpus), BYTES).collect())
    monkeypatch.setattr(token_counts, "SHARED_ROWS", 3)
    cache = cache_of(corpus)
    assert sorted(token_counts.count_tokens(docs(rows), cache, BYTES).collect()) == want
    assert token_counts.read_cache(corpus, cache).count() == 7


def test_a_tokenizer_that_cuts_and_pads_counts_whole_texts(docs, corpus):
    tokenizer = Tokenizer.from_str(BYTES)
    tokenizer.enable_truncation(4)
    tokenizer.enable_padding(length=50)
    got = token_counts.count_tokens(docs([(1, "a b c d e f g h"), (2, "a")]), cache_of(corpus), tokenizer.to_str())
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {1: 8, 2: 1}


def test_empty_table(docs, corpus):
    assert token_counts.document_counts(docs([]), cache_of(corpus)).count() == 0
