import zlib
from collections import Counter, defaultdict

from hydromelt.llm import sharding


def test_every_row_once_and_bytes_near_equal(spark, make_docs):
    texts = [None, "", *("é" * (i % 900) for i in range(3000))]
    rows = sharding.shard_documents(make_docs(texts), 24, slots=1024).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    loads, places = Counter(), defaultdict(list)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        loads[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert set(loads) == set(range(24))
    assert max(loads.values()) <= 1.02 * min(loads.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert len({(r["virtual_slot"], r["shard"]) for r in rows}) == len({r["virtual_slot"] for r in rows})


def test_map_is_stored_and_edited(spark):
    sizes = [(i * 37) % 101 for i in range(512)]
    first = sharding.build_map(sizes, 4)
    again = sharding.read_map(first.frame(spark).unionByName(sharding.rebalance(first, shards=4).frame(spark)), 1)
    assert again == first
    sizes[3] += 2000
    later = sharding.rebalance(first, sizes)
    moved = [s for s in range(512) if later.shard_of[s] != first.shard_of[s]]
    assert later.version == 2 and 0 < len(moved) < 150
    assert max(later.loads()) - min(later.loads()) <= 0.01 * sum(sizes) / 4 + max(sizes) or max(later.loads()) == 2000 + 111
    grown = sharding.rebalance(first, shards=5)
    to = [grown.shard_of[s] for s in range(512) if grown.shard_of[s] != first.shard_of[s]]
    assert to.count(4) >= 0.9 * len(to) and len(to) < 0.25 * 512
    assert max(grown.loads()) <= 1.05 * min(grown.loads())
    shrunk = sharding.rebalance(grown, shards=4)
    assert set(shrunk.shard_of) == {0, 1, 2, 3} and max(shrunk.loads()) <= 1.05 * min(shrunk.loads())


def test_odd_and_empty(odd_docs, no_docs):
    rows = sharding.shard_documents(odd_docs, 3).collect()
    assert len(rows) == odd_docs.count()
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert sharding.shard_documents(no_docs, 3).count() == 0


def test_rows_repeated_often_are_spread(spark):
    """A third of the rows are one row again and again: shards stay even, and places are gapless."""
    rows = [(7, "the same text " * 20)] * 3000 + [(i, "other " * 40) for i in range(100, 6100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = sharding.shard_documents(df, 24).toPandas()
    loads = out.groupby("shard")["size"].sum()
    assert len(out) == 9000 and loads.max() < 1.05 * loads.mean()
    assert out[out.doc_id == 7].virtual_slot.nunique() > 1000
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
