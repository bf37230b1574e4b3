import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import text_kernel as K
from weftgraph.llm import tokens

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="abAB \n\t.é0<|'", max_size=30)), max_size=8)


def plain_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(1, 5), st.sampled_from([3, 8, 1 << 20]))
def test_shingles_are_those_of_the_words(texts, size, block):
    old, K.BLOCK = K.BLOCK, block
    seen = {}
    try:
        for i, _, buf, offsets in K.chunks(pa.array(texts, pa.string()), 40):
            h, ptr = K.shingles(K.words(buf, offsets), size)
            for r in range(len(offsets) - 1):
                w = plain_words(texts[i + r])
                want = [tuple(w)] if 0 < len(w) < size else [tuple(w[j : j + size]) for j in range(len(w) - size + 1)]
                got = h[ptr[r] : ptr[r + 1]].tolist()
                assert len(got) == len(want)
                for x, y in zip(got, want, strict=True):
                    assert seen.setdefault(y, x) == x
    finally:
        K.BLOCK = old
    assert len(set(seen.values())) == len(seen)


SPECIAL = [
    "It's İstanbul's <|endoftext|> x<|startoftext|>y ÀÉ ñ_ñ 12ab3 ½ x y \u0085 Σίσυφος ΣΑΣ ẞ àb\x1c d'll 'S 'LL ''s 're", "", "   ",
    "日本語 text ǅ ſ K ŉ ΐ", "a" * 200 + " b", "<|ENDOFTEXT|> <|endoftext|>", "a×b÷c Ⱥx é  x", "é ́x",
]


def test_encoder_equals_the_tokenizer():
    encode = tokens.TextEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for i, _, buf, offsets in K.chunks(pa.array(SPECIAL), 64):
        ids, ptr = encode(buf, offsets)
        for r in range(len(offsets) - 1):
            assert ids[ptr[r] : ptr[r + 1]].tolist() == encode.tokenizer.encode(SPECIAL[i + r], add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=25))
def test_encoder_equals_the_tokenizer_on_any_text(text):
    encode = tokens.TextEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for _, _, buf, offsets in K.chunks(pa.array([text])):
        assert encode(buf, offsets)[0].tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.UnigramVocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def brute_tokens(word, vocabulary):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[end - 1][0] + vocabulary.unknown, best[end - 1][1] + 1)]
        for k in range(1, min(end, vocabulary.longest) + 1):
            if word[end - k : end] in vocabulary.scores:
                options.append((best[end - k][0] + vocabulary.scores[word[end - k : end]], best[end - k][1] + 1))
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    return best[-1][1]


def test_trie_counts_equal_one_programme_a_word(vocabulary):
    words = [b"the", b"then", b"thenceforth", b"international", "écriture".encode(), "日本".encode(), b"zzzzqx", b"a", b"int"]
    buf, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    starts = np.append(0, ends)[:-1]
    for few in (0, 3, 256):
        assert tokens.trie_counts(buf, starts, ends, vocabulary, few).tolist() == [brute_tokens(w, vocabulary) for w in words]


def test_long_words_take_linear_time(vocabulary):
    word = np.random.default_rng(1).integers(97, 123, 100_000).astype(np.uint8)
    begin = time.perf_counter()
    assert tokens.trie_counts(word, np.array([0]), np.array([len(word)]), vocabulary)[0] == brute_tokens(word.tobytes(), vocabulary)
    assert time.perf_counter() - begin < 20  # brute force included


def test_words_are_known_across_chunks(vocabulary, monkeypatch):
    met = []
    plain = tokens.trie_counts
    monkeypatch.setattr(tokens, "trie_counts", lambda buf, start, *rest: met.append(len(start)) or plain(buf, start, *rest))
    vocabulary.known, vocabulary.known_counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for texts, new in (("the then the", 2), ("then thence the", 1), ("the", 0), ("one two three", 3), ("the then", 2)):
        buf = np.frombuffer(texts.encode(), np.uint8)
        w = K.words(buf, np.array([0, len(buf)]))
        met.clear()
        got = tokens.word_counts(buf, w, vocabulary, cached=4)
        assert got.tolist() == [brute_tokens(x.encode(), vocabulary) for x in texts.split()] and sum(met) == new


def test_token_counts_of_odd_texts(spark, vocabulary):
    rows = [(1, "The then\nthe"), (2, None), (3, ""), (4, " \n"), (5, "x" * 3000), (5, "x" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as n_words")
    got = [(r["doc_id"], r["n_words"], r["n_tokens"]) for r in tokens.count_tokens(df, public_tokenizers.path("piece_bpe_32k.model")).collect()]
    t = lambda s: sum(brute_tokens(w.encode(), vocabulary) for w in plain_words(s))
    assert sorted(got) == sorted((i, len(plain_words(x)), t(x)) for i, x in rows)
    assert tokens.count_tokens(df.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0
