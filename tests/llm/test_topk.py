import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import topk


def brute(rows, asked, k):
    scaled = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows]
    out = []
    for qid, q in {(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in asked}:
        best = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), i) for i, v in scaled if i != qid)[:k]
        out += [(qid, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def found(df, asked, **options):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, asked, **options).collect())


def test_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute(rows, [r for r in rows if r[0] % 50 == 0], 5)
    for shard_rows, block in ((10_000, 100), (60, 3)):
        assert found(df, df.where("vec_id % 50 = 0"), shard_rows=shard_rows, block_queries=block) == want


def test_ties_and_a_hot_vector(spark):
    rows = [(i, [1.0, 0.0] if i % 3 else [0.5, float(i % 5)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(df, df.where("vec_id % 50 = 0"), shard_rows=64) == brute(rows, [r for r in rows if r[0] % 50 == 0], 5)


def test_odd_rows(spark):
    rows = [(0, [1.0, -2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [1.0, None]), (None, [1.0, 1.0]), (4, [float("inf"), 0.0]), (5, [0.0, 0.0]), (6, [3.0, 1.0]), (6, [3.0, 1.0]), (7, [-1.0, -0.001]), (8, []), (9, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit(1)).withColumn("v", F.lit("x"))
    kept = [(0, [1.0, -2.0]), (5, [0.0, 0.0]), (6, [3.0, 1.0]), (6, [3.0, 1.0]), (7, [-1.0, -0.001]), (8, []), (9, [2.0])]
    assert found(df, df) == brute(kept, kept, 5)
    none = df.where("vec_id = 77")
    assert found(none, none) == [] and found(df, none) == [] and found(df.where("vec_id = 0"), df.where("vec_id = 0")) == []


def test_stops_early():
    rng = np.random.default_rng(0)
    rows = np.floor(256 * rng.normal(size=(4000, 3)))
    rows[17] = [4000, 4000, 4000]
    lists, read = topk.Lists(np.arange(4000), rows), []

    class Counting(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray) and key.dtype != bool:
                read.append(len(key))
            return super().__getitem__(key)

    lists.rows = lists.rows.view(Counting)
    ids, _ = lists.top(-1, np.array([5.0, 3.0, 2.0]), 1)
    assert ids.tolist() == [17] and sum(read) < 400


@pytest.mark.parametrize("size", [2.0**20, 2.0**45])
def test_large_numbers_stay_exact(spark, size):
    rows = [(i, [size, float(i), -size]) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(df, df.where("vec_id = 0"), k=3)
    want = [(q, n, i, max(min(s, 2**63 - 1), -(2**63))) for q, n, i, s in brute(rows, rows[:1], 3)]
    assert got == want
