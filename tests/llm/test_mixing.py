import heapq
from collections import Counter
from fractions import Fraction

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import mixing


def brute_schedule(weights, blocks):
    """Earliest deadline first over all slots, one after the other, with the windows of real weights."""
    w, left = [Fraction(x) for x in weights], {s: Fraction(n) for s, n in enumerate(blocks) if n}
    windows, now = {s: [[Fraction(0), None]] for s in left}, Fraction(0)
    while left:  # the fluid mix, from one source's end to the next
        total = sum(w[s] for s in left)
        end = min(left[s] * total / w[s] for s in left)
        for s in left:
            rate, had = w[s] / total, blocks[s] - left[s]
            for j in range(int(had) + 1, int(had + rate * end) + 1):
                at = now + (j - had) / rate
                windows[s][j - 1][1] = at
                windows[s].append([at, None])
        left = {s: n - w[s] / total * end for s, n in left.items() if n > w[s] / total * end}
        now += end
    jobs = sorted((int(a), -int(-b // 1), s, j) for s, all_ in windows.items() for j, (a, b) in enumerate(all_[: blocks[s]]))
    ready, out, k = [], [], 0
    for slot in range(sum(blocks)):
        while k < len(jobs) and jobs[k][0] <= slot:
            heapq.heappush(ready, jobs[k][1:])
            k += 1
        due, s, j = heapq.heappop(ready)
        assert slot < due
        out.append((s, j, slot))
    return out


MIXES = st.lists(st.tuples(st.floats(0.001, 50), st.integers(0, 40)), min_size=1, max_size=12)


@settings(max_examples=120, deadline=None)
@given(MIXES, st.integers(1, 60))
def test_spans_equal_one_run(rows, span):
    weights, blocks = [r[0] for r in rows], [r[1] for r in rows]
    fluid = mixing.Fluid(weights, blocks)
    found = [x for a in range(0, fluid.slots, span) for x in mixing.schedule(fluid, a, a + span)]
    assert found == brute_schedule(weights, blocks)


@pytest.mark.parametrize("weights,blocks", [([1.0] * 20, [1603] * 20), ([0.9, 0.0999, 0.0001], [28_845, 3_203, 5]), ([n**0.5 for n in (18703, *range(1700, 1719))], [n // 8 + 1 for n in (18703, *range(1700, 1719))])])
def test_less_than_one_block_from_the_target(weights, blocks):
    fluid = mixing.Fluid(weights, blocks)
    span = max(999, fluid.longest())
    order = [x for a in range(0, fluid.slots, span) for x in mixing.schedule(fluid, a, a + span)]
    assert [x[2] for x in order] == list(range(sum(blocks)))
    total, done = sum(map(Fraction, weights)), Counter()
    shares = [Fraction(w) / total for w in weights]
    for s, j, slot in order[: fluid.on_target()]:
        assert j == done[s]
        done[s] += 1
        if slot % 7 == 0 or slot > fluid.on_target() - 50:
            assert all(abs(done[i] - x * (slot + 1)) < 1 for i, x in enumerate(shares))
    assert fluid.on_target() >= 0.9 * min(n / float(x) for n, x in zip(blocks, shares, strict=True))


def check(df, out, weights, block_rows):
    """The whole result, block by block, against the brute-force schedule."""
    rows, counts = out.collect(), Counter(r["source"] for r in df.collect())
    names = sorted(counts, key=lambda s: (s is None, "" if s is None else str(s)))
    order = brute_schedule([weights[s] for s in names], [-(-counts[s] // block_rows) for s in names])
    places = {(names[s], j): slot for s, j, slot in order}
    found = {}
    for r in rows:
        assert r["slot"] == places[r["source"], r["block"]]
        found.setdefault(r["slot"], []).append(r["place"])
    assert len(rows) == sum(counts.values()) and sorted(found) == list(range(len(order)))
    assert all(sorted(p) == list(range(len(p))) for p in found.values())
    for (s, j), slot in places.items():
        assert len(found[slot]) == min(block_rows, counts[s] - j * block_rows)
    on = [r["slot"] for r in rows if r["on_target"]]
    total, done = sum(Fraction(weights[s]) for s in names), Counter()
    for t in range(max(on, default=-1) + 1):
        done[names[order[t][0]]] += 1
        assert all(abs(done[s] - Fraction(weights[s]) / total * (t + 1)) < 1 for s in names)


def test_driver_table(docs):
    check(docs, mixing.mix(docs), mixing.source_weights(docs), mixing.BLOCK_ROWS)
    check(docs, mixing.mix(docs, block_rows=1, slots_per_task=3), mixing.source_weights(docs), 1)


def test_query_equals_brute_force(spark):
    from quern.llm.queries import op5_mixing

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    check(docs, op5_mixing(spark, folder), mixing.source_weights(docs), mixing.BLOCK_ROWS)


def test_given_weights(spark):
    df = spark.createDataFrame([(i, f"t{i}", "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    out = mixing.mix(df, {"a": 3.0, "b": 1.0, "not here": 5}, block_rows=5)
    check(df, out, {"a": 3.0, "b": 1.0}, 5)
    assert out.where("on_target and source = 'a'").count() == 200
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": 1.0})
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": 0.0, "b": 1.0})


def test_sources_of_other_types(spark):
    df = spark.createDataFrame([(i, "t", i % 3 if i % 4 else None) for i in range(100)], "doc_id long, text string, source int")
    check(df, mixing.mix(df, block_rows=3), mixing.source_weights(df), 3)


def test_odd_rows(odd_docs, no_docs):
    extra = odd_docs.withColumn("slot", F.lit("x")).withColumn("__n", F.lit(1))
    out = mixing.mix(extra, block_rows=2)
    assert out.count() == odd_docs.count() and out.where("source is null").count() == 3
    check(odd_docs, out, mixing.source_weights(odd_docs), 2)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_order(no_docs).count() == 0


def test_a_repeated_row_is_spread(spark, monkeypatch):
    from quern.llm import common

    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 50)
    df = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(brute.phrase(1, 9)).alias("text"), F.lit("hot").alias("source"))
    check(df, mixing.mix(df), mixing.source_weights(df), mixing.BLOCK_ROWS)
    numbered = common.indexed(df.withColumn("h", F.xxhash64("doc_id")), "source", ["h"], "n", 50)
    assert sorted(r["n"] for r in numbered.collect()) == list(range(3000))


def test_same_order_again(docs):
    a, b = (sorted((r["doc_id"], r["slot"], r["place"]) for r in mixing.mix(d).collect()) for d in (docs, docs.repartition(7)))
    assert a == b


def test_mixed_order_is_sorted(docs):
    slots = {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.mix(docs).collect()}
    found = [slots[r["doc_id"]] for r in mixing.mixed_order(docs).collect()]
    assert found == sorted(found)


def test_many_buckets(spark, monkeypatch):
    from quern.llm import common

    df = spark.range(5000).select(F.lit(1).alias("g"), F.xxhash64("id").alias("h"), "id")
    for rows in (7, 100, 10_000):
        out = common.indexed(df, "g", ["h", "id"], "n", rows_per_bucket=rows).orderBy("n").collect()
        assert [r["n"] for r in out] == list(range(5000)) and [r["h"] for r in out] == sorted(r["h"] for r in out)
