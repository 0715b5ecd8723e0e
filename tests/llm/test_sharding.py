import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import sharding


def test_driver_table(docs):
    rows = sharding.shard_rows(docs, leaves=24).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    sizes, slots = Counter(), {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and 0 <= r["shard"] < 24
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)


def test_even_bytes(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 11)).alias("source"), (F.col("id") % 97).alias("n_chars"))
    sizes = [r[1] for r in sharding.shard_rows(df, leaves=24).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 24 and max(sizes) <= 1.02 * min(sizes)


def test_splits_follow_the_widest_dimension(spark):
    df = spark.createDataFrame([(i, "t", i * 1000) for i in range(100)], "doc_id long, text string, n long")
    out = sharding.shard(df, leaves=4, dimensions={"n": sharding.number(F.col("n"))})
    groups = {}
    for r in out.collect():
        groups.setdefault(r["shard"], []).append(r["n"])
    assert sorted(map(len, groups.values())) == [25] * 4
    spans = sorted((min(g), max(g)) for g in groups.values())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_target_bytes(docs):
    total = docs.agg(F.sum(sharding.byte_size(F.col("text")))).first()[0]
    out = sharding.shard(docs, target_bytes=total // 5 + 1)
    assert {r["shard"] for r in out.select("shard").distinct().collect()} == set(range(5))


@pytest.mark.parametrize("leaves", [1, 2, 24])
def test_odd_rows(odd_docs, no_docs, leaves):
    extra = odd_docs.withColumn("shard", F.lit("x"))
    rows = sharding.shard_rows(extra, leaves=leaves).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["shard"] < leaves for r in rows)
    assert sharding.shard_rows(no_docs, leaves=leaves).count() == 0 and sharding.shard(no_docs, target_bytes=100).count() == 0


def brute_tree(rows, leaves, first, whole):
    """(shard, row) by recursion: rows are (keys, size, row)."""
    if leaves == 1 or not rows:
        return [(first, r[2]) for r in rows]
    spread = [(max(r[0][d] for r in rows) - min(r[0][d] for r in rows)) / whole[d] for d in range(len(whole))]
    d = spread.index(max(spread))
    rows = sorted(rows, key=lambda r: r[0][d])
    left, best, had = sum(r[1] for r in rows) * (leaves // 2) / leaves, (float("inf"), 0), 0
    for i in range(len(rows) + 1):
        best = min(best, (abs(had - left), i))
        had += rows[i][1] if i < len(rows) else 0
    i = best[1]
    return brute_tree(rows[:i], leaves // 2, first, whole) + brute_tree(rows[i:], leaves - leaves // 2, first + leaves // 2, whole)


@pytest.mark.parametrize("leaves", [24, 7])
def test_equals_brute_force(docs, leaves, monkeypatch):
    keyed = [(r["__keys"], r["__size"], r["doc_id"]) for r in sharding._with_keys(docs, sharding.document_dimensions(), "doc_id", "text").collect()]
    whole = [max(1, max(k[0][d] for k in keyed) - min(k[0][d] for k in keyed)) for d in range(3)]
    wanted = {doc: shard for shard, doc in brute_tree(keyed, leaves, 0, whole)}
    assert {r["doc_id"]: r["shard"] for r in sharding.shard(docs, leaves=leaves).collect()} == wanted
    monkeypatch.setattr(sharding, "TASK_ROWS", 60)  # the upper levels by the driver's histograms
    monkeypatch.setattr(sharding, "TOLERANCE", 0)
    assert {r["doc_id"]: r["shard"] for r in sharding.shard(docs, leaves=leaves).collect()} == wanted


def test_query_equals_brute_force(spark):
    from quern.llm.queries import op6_sharding

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    keyed = [(r["__keys"], r["__size"], r["doc_id"]) for r in sharding._with_keys(docs, sharding.document_dimensions(), "doc_id", "text").collect()]
    whole = [max(1, max(k[0][d] for k in keyed) - min(k[0][d] for k in keyed)) for d in range(3)]
    assert {r["doc_id"]: r["shard"] for r in op6_sharding(spark, "/root/testdata/sf0.01").collect()} == {doc: shard for shard, doc in brute_tree(keyed, 24, 0, whole)}


def test_many_leaves(spark):
    df = spark.range(300_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"), (F.col("id") % 9).cast("string").alias("source"), (F.xxhash64("id") % 1000 + 1000).alias("n_chars"))
    sizes = sharding.shard(df, leaves=100_000).groupBy("shard").count().agg(F.count(F.lit(1)), F.max("count"), F.min("count")).first()
    assert tuple(sizes) == (100_000, 3, 3)


def test_repeated_rows_are_split(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 1000, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(9).cast("long").alias("n_chars"))
    rows = sharding.shard_rows(df, leaves=24).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == 2000 and len(counts) == 24 and max(counts.values()) - min(counts.values()) <= 4
    assert len({(r["shard"], r["slot"]) for r in rows}) == 2000


def test_numbers_beyond_31_bits(spark):
    df = spark.createDataFrame([(0,), (2**31,), (2**40,), (None,), (-5,)], "n long")
    found = [r[0] for r in df.select(sharding.number(F.col("n"), 2**40)).collect()]
    assert found == [0, 2**31 // 513, 2**40 // 513, 0, 0] and max(found) < 2**31
    with pytest.raises(Exception, match="beyond its bound"):
        df.select(sharding.number(F.col("n"))).collect()


def test_hot_copies_are_split(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(13).cast("long").alias("n_chars"))
    counts = [r["count"] for r in sharding.shard(df, leaves=24).groupBy("shard").count().collect()]
    assert len(counts) == 24 and max(counts) - min(counts) <= 3
