import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import jaccard


def rows_of(df):
    return [(i, r["doc_id"], r["text"]) for i, r in enumerate(df.collect())]


def check(df, **options):
    rows = [r for r in rows_of(df) if r[1] is not None]
    expected = sorted((i, *brute.near_duplicates(rows)[k]) for k, i, _ in rows)
    found = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(df.where("doc_id is not null"), **options).collect())
    assert found == expected


def test_equals_brute_force(docs):
    check(docs)


def test_odd_rows(odd_docs):
    check(odd_docs)
    by_id = {r["doc_id"]: r for r in jaccard.near_duplicates(odd_docs).collect()}
    assert by_id[1]["class_id"] == by_id[2]["class_id"] == by_id[3]["class_id"] == 1 and by_id[1]["n_links"] == 2
    assert by_id[9]["class_id"] == by_id[10]["class_id"] == 9  # short texts are one gram
    assert by_id[4]["n_links"] == 1 and by_id[5]["n_links"] == 0 and by_id[6]["class_id"] == 6
    assert jaccard.near_duplicates(odd_docs).count() == odd_docs.count()


def test_large_groups_are_verified_in_blocks(spark, monkeypatch):
    base = brute.phrase(9, 80).split()
    texts = []
    for i in range(60):
        w = list(base)
        for j in range(i % 4):
            w[(7 * i + 11 * j) % 80] = f"x{i}y{j}"
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 7)
    check(df)
    monkeypatch.setattr(jaccard, "DENSE_FROM", 2)
    check(df)


def test_empty_and_extra_columns(spark, no_docs, odd_docs):
    assert jaccard.near_duplicates(no_docs).count() == 0 and jaccard.keep_one(no_docs).count() == 0
    extra = odd_docs.withColumn("links", F.lit(1)).withColumn("class_id", F.lit("x")).withColumn("k1", F.lit(2.0))
    kept = jaccard.keep_one(extra)
    assert kept.columns == extra.columns


def test_keep_one(odd_docs, docs):
    kept = [r["doc_id"] for r in jaccard.keep_one(odd_docs).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 4, 5, 6, 7, 8, 9, 11] and kept.count(None) == 2
    classes = jaccard.near_duplicates(docs).select("class_id").distinct().count()
    none = docs.where("text is null").count()
    assert jaccard.keep_one(docs).count() == classes + none * 0


@pytest.mark.parametrize("threshold", [0.5, 0.95])
def test_other_thresholds(docs, threshold):
    rows = [r for r in rows_of(docs.limit(120))]
    expected = brute.near_duplicates(rows, threshold)
    found = {r["doc_id"]: r["n_links"] for r in jaccard.near_duplicates(docs.limit(120), threshold=threshold, bands=60, rows=2).collect()}
    assert found == {i: expected[k][1] for k, i, _ in rows}


def test_banding():
    assert jaccard.banding(0.8) == (25, 5)
    for threshold in (0.05, 0.3, 0.5, 0.7, 0.8, 0.9, 0.99):
        for recall in (0.9, 0.99, 0.9999):
            bands, rows = jaccard.banding(threshold, recall)
            assert 1 - (1 - threshold**rows) ** bands >= recall
            assert rows == 1 or bands * rows <= jaccard.HASHES
    assert jaccard.banding(1.0)[0] >= 1
    for threshold, recall in ((0, 0.9), (1.1, 0.9), (0.8, 1), (0.8, 0)):
        with pytest.raises(ValueError):
            jaccard.banding(threshold, recall)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.95])
def test_bands_follow_the_threshold(docs, threshold):
    rows = rows_of(docs.limit(120))
    expected = brute.near_duplicates(rows, threshold)
    found = {r["doc_id"]: r["n_links"] for r in jaccard.near_duplicates(docs.limit(120), threshold=threshold).collect()}
    assert found == {i: expected[k][1] for k, i, _ in rows}


def test_pairs_beside_the_threshold():
    """Unions over a million: one shared gram decides."""
    for shared, linked in ((1_600_000, True), (1_599_999, False)):
        a, b = np.arange(2_000_000, dtype=np.uint64), np.concatenate([np.arange(shared), np.arange(2_000_000, 3_600_000 - shared)]).astype(np.uint64)
        assert len(np.union1d(a, b)) - (3_600_000 - shared) == 0
        found = jaccard._link_counts(np.array([1, 2]), np.array([1, 1]), [a, b], None, 0.8)
        assert bool(found) == linked
