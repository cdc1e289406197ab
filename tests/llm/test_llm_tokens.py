import hashlib
import random

import numpy as np
import pytest

from hydromelt.llm import bpe_codec, token_counts, wordbpe

NAME = "word_bpe_49k.json"
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public.path(NAME))


@pytest.fixture(scope="module")
def texts():
    chance = random.Random(5)
    made = ["".join(chance.choice("abcdehinorst'.,éü1 \n") for _ in range(300)) for _ in range(300)]
    made += ["".join(chance.choice("ahint") for _ in range(40)) for _ in range(500)]
    made += [" ".join(f"a{chr(c)}b" for c in range(s, s + 1500) if not 0xD800 <= c < 0xE000) for s in range(1, 0x30000, 1500)]
    return made + ["", " ", "aaaaaaa aaa", "don't I'LL", "<|endoftext|> a<|startoftext|>b", "ΣΑΣ Σ.", "İ", "é ́", "a" * 40_000, "<|x|>"]


def test_counts_equal_the_library(library, texts):
    counter = token_counts.Counter(wordbpe.load(NAME))
    assert counter.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_settled_letter_is_cut_like_the_library(library):
    """Also capitals whose small letters are beyond the settled ones, in texts and in parts between special strings."""
    bpe = wordbpe.load(NAME)
    texts = [text for c in map(chr, range(wordbpe.SETTLED + 1)) for text in (c, f"a{c}b {c}{c}", f"x{c}<|endoftext|>{c}y")]
    encoder = bpe_codec.Encoder(bpe)
    ids = [np.frombuffer(found, "<u4").tolist() for found, _ in encoder.encode(texts)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, ids, want, strict=True) if a != b] == []
    assert token_counts.Counter(bpe).count(texts) == list(map(len, want))


def test_small_memory_changes_nothing(library, texts, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 50)
    monkeypatch.setattr(bpe_codec, "KEPT_WORDS", 50)
    monkeypatch.setattr(bpe_codec, "KEPT_PAIRS", 50)
    counter, encoder = token_counts.Counter(wordbpe.load(NAME)), bpe_codec.Encoder(wordbpe.load(NAME))
    for text in texts[:120]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert counter.count([text]) == [len(ids)]
        assert next(encoder.encode([text]))[0] == np.array(ids, "<u4").tobytes()


def test_unordered_merges_take_the_leftmost_place(library, texts):
    bpe = wordbpe.WordBPE(public.path(NAME))
    bpe.ordered = False
    some = texts[:200]
    assert token_counts.Counter(bpe).count(some) == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]


def test_ids_and_text_equal_the_library(library, texts):
    encoder = bpe_codec.Encoder(wordbpe.load(NAME))
    for text, (ids, back) in zip(texts, encoder.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert back == library.decode(want, skip_special_tokens=False)


def test_verification_alone_decides(library):
    """Proposals that pass equal exact merging; some words do fail."""
    bpe = wordbpe.load(NAME)
    chance = random.Random(3)
    words = sorted({"".join(chance.choice("ehinorst") for _ in range(chance.randint(1, 12))).encode() for _ in range(4000)})
    counts, symbols = token_counts.merge_all(bpe, words)
    exact = [x.tolist() for x in np.split(symbols, np.cumsum(counts)[:-1])]
    encoder = bpe_codec.Encoder(bpe)
    proposals = [bpe_codec.propose(bpe, w + wordbpe.END) for w in words]
    encoder.verify(proposals)
    passed = [p is not None and all(encoder.fine[bpe.pair(a, b)] for a, b in zip(p, p[1:], strict=False)) for p in proposals]
    assert [p == e for p, e in zip(proposals, exact, strict=True)] == passed
    assert 0 < sum(passed) < len(words)


def test_query_shapes(spark, odd_docs, no_docs, library):
    texts = [r["text"] or "" for r in odd_docs.select("text").collect()]
    want = sorted(len(library.encode(t, add_special_tokens=False).ids) for t in texts)
    counted = token_counts.count_tokens(odd_docs, limit=100).collect()
    assert sorted(r["n_tokens"] for r in counted) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in counted)
    assert sorted(r["n_bytes"] for r in counted) == sorted(len(t.encode()) for t in texts)
    coded = bpe_codec.code(odd_docs, outputs=("ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert sorted(r["n_tokens"] for r in coded) == want
    for r in coded:
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert token_counts.count_tokens(no_docs).count() == bpe_codec.code(no_docs).count() == 0


def test_queries_over_documents(spark, sf_dir, sf_docs, library):
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in sf_docs}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.op2_rank_synchronous(spark, sf_dir).collect()} == {
        i: len(ids) for i, ids in want.items()}
    assert {r["doc_id"]: r["ids_sha256"] for r in bpe_codec.op8_speculate_verify(spark, sf_dir).collect()} == {
        i: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() for i, ids in want.items()}
