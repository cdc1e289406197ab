import hashlib
import random
import re

import numpy as np
import pytest

from hydromelt.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, edge):
    """doc_id, n_words, n_removed, digest of the kept words; one per row."""
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, words in split:
        for k in range(len(words) - edge + 1 if i is not None else 0):
            run = tuple(words[k:k + edge])
            first[run] = min(i, first.get(run, i))
    found = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - edge + 1 if i is not None else 0):
            if first[tuple(words[k:k + edge])] < i:
                gone.update(range(k, k + edge))
        kept = [w for k, w in enumerate(words) if k not in gone]
        found.append((i, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(found, key=str)


def got(df, edge, seed):
    rows = substrings.remove_repeats(df, edge, seed, outputs=("kept_sha256",)).collect()
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_short_edges_on_tangled_texts(make_docs, seed):
    """Few words and short k-mers make a graph full of forks and repeats inside documents."""
    chance = random.Random(seed)
    parts = [[chance.choice("abcdefgh") for _ in range(chance.randint(3, 25))] for _ in range(12)]
    rows = []
    for i in range(80):
        words = [w for _ in range(chance.randint(1, 5)) for w in (
            chance.choice(parts) if chance.random() < 0.6 else [chance.choice("abcdefghij") for _ in range(chance.randint(1, 9))])]
        rows.append((chance.randint(0, 60), " ".join(words)))
    assert got(make_docs(rows), 6, 3) == brute(rows, 6)


def test_odd_rows(odd_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert got(odd_docs, 50, 8) == brute(rows, 50)


def test_documents(spark, sf_dir, sf_docs):
    rows = sorted((tuple(r) for r in substrings.op5_de_bruijn(spark, sf_dir).collect()), key=str)
    assert rows == brute(sf_docs, 50)


def test_rows_keep_their_columns(make_docs):
    shared = " ".join(f"s{i}" for i in range(60))
    df = make_docs([shared, "own  words\n" + shared + " end", "un  changed", None])
    rows = {r["doc_id"]: r for r in substrings.drop_repeats(df).collect()}
    assert substrings.drop_repeats(df).columns == df.columns
    assert [rows[i]["text"] for i in range(4)] == [shared, "own words end", "un  changed", None]
    spans = {r["doc_id"]: r["spans"] for r in substrings.remove_repeats(df).collect()}
    assert {(s["start"], s["source"]) for s in spans[1]} >= {(2, 0)} and all(2 <= s["start"] < s["end"] <= 62 for s in spans[1])


def test_no_documents(no_docs):
    assert substrings.remove_repeats(no_docs).count() == substrings.drop_repeats(no_docs).count() == 0


def test_pieces_cover_every_edge_once():
    hashes = np.random.default_rng(1).integers(0, 50, 400).astype(np.uint64)
    starts, counts, _, contents = substrings.pieces_of(hashes, 50, 8)
    assert starts[0] == 0 and (np.diff(starts) == counts[:-1]).all() and starts[-1] + counts[-1] == 351
    again = substrings.pieces_of(np.concatenate([hashes[:7], hashes]), 50, 8)
    assert set(contents[1:].tolist()) <= set(again[3].tolist())
