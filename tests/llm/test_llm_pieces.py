import hashlib
import random

import numpy as np
import pytest
from hydromelt.llm import piece_codec

NAME = "piece_bpe_32k.model"
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    return piece_codec.load(NAME)


def whole(library, text):
    ids = library.encode(text, add_bos=True, add_eos=True)
    return ids, library.decode(ids)


@pytest.fixture(scope="module")
def texts():
    chance = random.Random(7)
    made = ["".join(chance.choice("abcdehinorst'.,éü1 \n\t▁") for _ in range(300)) for _ in range(300)]
    made += ["".join(chance.choice("a ▁<s>/") for _ in range(30)) for _ in range(500)]
    made += [" ".join(f"a{chr(c)}b" for c in range(s, s + 1500) if not 0xD800 <= c < 0xE000) for s in range(0, 0x30000, 1500)]
    return made + ["", " ", "  ", " " * 50, "▁", "▁▁ a", "a ", " a", "a  b ", "<s>x</s> <unk>", "<0x0A>", "x\x00y", "a" * 40_000, "\n \n", "東京 👍🏽"]


def test_equals_the_library(library, texts):
    held = piece_codec.ChunkTable(library)
    assert not held.whole
    for text, (ids, back) in zip(texts, held.code(texts), strict=True):
        assert (np.frombuffer(ids, "<u4").tolist(), back) == whole(library, text)


def test_small_table_changes_nothing(library, texts, monkeypatch):
    monkeypatch.setattr(piece_codec, "KEPT_CHUNKS", 40)
    held = piece_codec.ChunkTable(library)
    for text in texts[:80]:
        ids, back = next(held.code([text]))
        assert (np.frombuffer(ids, "<u4").tolist(), back) == whole(library, text)


def test_crossing_pieces_mean_whole_texts(library, texts, monkeypatch):
    monkeypatch.setattr(piece_codec, "separable", lambda model: False)
    for text, (ids, back) in zip(texts[:50], piece_codec.ChunkTable(library).code(texts[:50]), strict=True):
        assert (np.frombuffer(ids, "<u4").tolist(), back) == whole(library, text)


def test_each_distinct_chunk_is_segmented_once(library, monkeypatch):
    held, seen = piece_codec.ChunkTable(library), []
    monkeypatch.setattr(held, "learn", lambda chunks, learn=held.learn: (seen.extend(chunks), learn(chunks)))
    for text in ("one two one", "two three  one", "one"):
        list(held.code([text]))
    assert sorted(seen) == sorted([" one", " two", " three", "  one"])


def test_shapes(spark, odd_docs, no_docs, library):
    texts = [r["text"] or "" for r in odd_docs.select("text").collect()]
    rows = piece_codec.code(odd_docs, outputs=("ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(whole(library, t)[0]) for t in texts)
    assert sorted(r["decoded"] for r in rows) == sorted(whole(library, t)[1] for t in texts)
    for r in rows:
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert piece_codec.code(no_docs).count() == 0


def test_query_over_documents(spark, sf_dir, sf_docs, library):
    found = {r["doc_id"]: r for r in piece_codec.op13_distinct_chunks(spark, sf_dir).collect()}
    assert len(found) == len(sf_docs)
    for i, text in sf_docs:
        ids, back = whole(library, text or "")
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
