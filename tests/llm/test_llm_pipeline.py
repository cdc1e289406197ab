import hashlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from hydromelt.llm import contamination, substrings, toxicity
from hydromelt.llm.common import table
from test_llm_near_dups import brute as near_groups
from test_llm_substrings import WORD


def unrepeated(rows, edge=50):
    """Texts without the windows that start in a smaller document too."""
    split = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(split):
        for k in range(len(split[i]) - edge + 1):
            first.setdefault(tuple(split[i][k:k + edge]), i)
    out = []
    for i, t in rows:
        words = split[i]
        gone = {k + j for k in range(len(words) - edge + 1) if first[tuple(words[k:k + edge])] < i for j in range(edge)}
        out.append((i, " ".join(w for k, w in enumerate(words) if k not in gone) if gone else t))
    return out


def test_pipeline_equals_brute_force(spark, sf_dir, sf_docs):
    pytest.importorskip("public_tokenizers")
    import public_tokenizers
    from tokenizers import Tokenizer
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = [r for r in sf_docs if model.score([r[1] or ""])[0] < toxicity.THRESHOLD]
    assert 0 < len(rows) < len(sf_docs)
    kept = {g[0] for g in near_groups(rows) if g[3]}
    rows = unrepeated([r for r in rows if r[0] in kept])
    items = [" ".join(contamination.terms(r["text"].encode())) for r in table(spark, sf_dir, "benchmark").collect()]
    rows = [r for r in rows if not any(i in " ".join(contamination.terms((r[1] or "").encode())) for i in items)]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: hashlib.sha256(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for i, t in rows}
    got = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"]: r["ids_sha256"] for r in got.collect()} == want


def test_stages_return_the_columns_of_documents(spark, odd_docs, sf_dir):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs.where("false"), sf_dir).count() == 0
    assert substrings.EDGE == 50


def test_the_chain_over_odd_rows(spark, odd_docs, sf_dir, tmp_path):
    """Nulls, empty and very long texts, copies, repeated and shared ids and clashing columns, each stage fed with the last one's rows."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs, folder = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder)
        assert docs.columns == odd_docs.columns, name
        held = {(r["doc_id"], r["n_chars"]) for r in before.where("text IS NULL OR text = ''").collect()}
        assert {(r["doc_id"], r["n_chars"]) for r in docs.where("text IS NULL OR text = ''").collect()} >= held, name
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert rows[0]["n_tokens"] == rows[1]["n_tokens"] == rows[2]["n_tokens"] == 0
    assert rows[3]["n_tokens"] > 30_000 and 4 in rows and 5 not in rows and 13 not in rows and None in rows


def test_the_chain_over_no_rows(spark, odd_docs, sf_dir, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    odd_docs.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_batches_for_python_are_bounded_by_bytes(spark, tmp_path):
    spark.range(40).selectExpr("id AS doc_id", "repeat('x', 1000000) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "held": [sum(map(len, batch.column("text").to_pylist()))]})

    found = table(spark, str(tmp_path), "documents").coalesce(1).mapInArrow(sizes, "n long, held long").collect()
    assert sum(r["n"] for r in found) == 40
    assert max(r["held"] for r in found) <= 8_000_000
