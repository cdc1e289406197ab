import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like those the operators use inside.
CLASHING = {name: "x" for name in ("doc", "version", "raw", "node", "key", "root", "spans_", "score", "size", "slot", "shard",
                                   "virtual_slot", "n_tokens", "kept", "kept_id", "features", "block", "host", "path", "rule")}


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, clashing=True):
        """Documents from texts, or from pairs of id and text."""
        from pyspark.sql import functions as F
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
        return df.withColumns({n: F.lit(v) for n, v in CLASHING.items()}) if clashing else df
    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Null, empty and blank texts, a very long one, ties, repeated rows, a repeated and a null id, marks and other scripts."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    plain = " ".join(f"word{i}" for i in range(120))
    return make_docs([
        (0, None), (1, ""), (2, " \n\t "), (3, long), (4, plain), (5, plain), (6, plain), (6, plain), (7, plain + " more"), (7, "other text"),
        (None, plain), (None, None), (8, "one"), (9, "One"), (10, "a" * 70_000), (11, "Ünïcödé ΣΑΣ 東京 👍 <|endoftext|> İ"),
        (12, "x\ny\nx\n\n \nx"), (13, plain.upper())])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf_dir():
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("driver tables not present")
    return folder


@pytest.fixture(scope="session")
def sf_docs(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
