import brute
import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate


def check(df, bench):
    rows = df.collect()
    expected = brute.contamination({i: r["text"] for i, r in enumerate(rows)}, [(r["item_id"], r["text"]) for r in bench.collect()])
    want = sorted(((str(r["doc_id"]), *expected[i][:2], tuple(expected[i][2])) for i, r in enumerate(rows)))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], tuple(r["items"] or ())) for r in decontaminate.contamination(df, bench).collect())
    assert got == want


def test_driver_tables(spark, docs):
    check(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))


@pytest.fixture(scope="module")
def bench(spark, odd_docs):
    long = odd_docs.where("doc_id = 8").first()["text"].split()
    base = odd_docs.where("doc_id = 1").first()["text"].split()
    items = [(1, " ".join(long[1000:1030])), (2, "One two"), (3, ""), (4, None), (5, "éé ñ"), (10, "ÉÉ Ñ"), (6, " ".join(base[3:13])), (7, " ".join(base[3:14])), (8, "two"), (8, "two"), (9, " ".join(base[20:27]))]
    return spark.createDataFrame(items, "item_id long, text string")


def test_odd_rows(odd_docs, bench):
    check(odd_docs, bench)
    check(odd_docs.repartition(5), bench.unionAll(bench))


def test_shuffled_instead_of_broadcast(odd_docs, bench, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    check(odd_docs, bench)


def test_empty(spark, odd_docs, no_docs, bench):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(no_docs, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(odd_docs, none).collect())
    assert decontaminate.decontaminate(odd_docs, none).count() == odd_docs.count()


def test_null_item_ids_name_no_item(spark, odd_docs):
    nameless = spark.createDataFrame([(None, "one two")], "item_id long, text string")
    hit = {r["doc_id"]: r for r in decontaminate.contamination(odd_docs, nameless).collect() if r["n_hit"]}
    assert set(hit) == {9, 10} and not hit[9]["items"]


def test_removal(odd_docs, bench):
    extra = odd_docs.withColumn("hits", F.lit(1)).withColumn("k1", F.lit(2))
    clean = decontaminate.decontaminate(extra, bench)
    assert clean.columns == extra.columns and not decontaminate.contamination(clean, bench).where("contaminated").count()
    cut = decontaminate.decontaminate(extra, bench, "spans")
    assert cut.count() == extra.count() and not decontaminate.contamination(cut, bench).where("contaminated").count()
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[10] == "" and texts[7] == "?! --" and texts[11] == "ü ß" and texts[5] is None
    with pytest.raises(ValueError):
        decontaminate.decontaminate(odd_docs, bench, "everything")


def test_no_python_in_the_plan(odd_docs, bench):
    plan = decontaminate.contamination(odd_docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
