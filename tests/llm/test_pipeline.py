import os
import sys
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F
from test_mixing import brute_schedule

import corpus_pipeline
from quern.llm import decontaminate, jaccard, mixing, quality

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return out


def test_run_equals_brute_force(spark, stages):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rated = quality.classify(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    accepted = {r["doc_id"] for r in rated.where("accepted").collect()}
    rows = [(r["doc_id"], r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in accepted]
    classes = brute.near_duplicates(rows)
    single = {k: t for k, _, t in rows if classes[k][0] == k}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hits = brute.contamination(single, items)
    clean = {k: t for k, t in single.items() if not hits[k][1]}
    final = {r["doc_id"]: r["text"] for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert final == clean
    assert [{r["doc_id"] for r in s.collect()} for s in stages] == [accepted, set(single), set(clean), set(clean), set(clean)]


def test_columns(spark, stages):
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    assert all(s.columns == columns for s in stages[:-1]) and stages[-1].columns == [*columns, "shard"]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, FOLDER).count() <= docs.count()


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    good = docs.join(labels.where("quality = 1 and toxic = 0"), "doc_id", "left_semi")
    kept = corpus_pipeline.keep_good(spark, docs, FOLDER).join(good.select("doc_id"), "doc_id", "left_semi").count()
    assert kept >= 0.98 * good.count()


def test_entry_has_every_query():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_queries_equal_their_sql(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from oracle import assert_same, connect

    from quern.llm.queries import ORACLES, QUERIES

    con = connect(FOLDER)
    for name, sql in ORACLES.items():
        assert_same(QUERIES[name](spark, FOLDER), con, sql)


def test_operators_are_used():
    assert corpus_pipeline.jaccard is jaccard and corpus_pipeline.mixing is mixing and corpus_pipeline.decontaminate is decontaminate
    assert F is not None


def test_mix_decides_shards_and_their_order(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(corpus_pipeline, "SHARD_BYTES", 20_000)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    corpus_pipeline.mix_sources(spark, docs, FOLDER).repartition(5).write.parquet(str(tmp_path / "mix"))  # no order of files is left
    rows = corpus_pipeline.shard(spark, spark.read.parquet(str(tmp_path / "mix")), FOLDER).collect()
    counts = Counter(r["source"] for r in docs.collect())
    names = sorted(counts)
    shares = [counts[s] ** mixing.TEMPERATURE for s in names]
    order = brute_schedule(shares, [-(-counts[s] // mixing.BLOCK_ROWS) for s in names])
    wanted, slots = [], []
    for s, j, slot in order:
        n = min(mixing.BLOCK_ROWS, counts[names[s]] - j * mixing.BLOCK_ROWS)
        wanted += [names[s]] * n
        slots += [slot] * n
    whole = mixing.BLOCK_ROWS * mixing.Fluid(shares, [-(-counts[s] // mixing.BLOCK_ROWS) for s in names]).on_target()
    assert [r["source"] for r in rows] == wanted and {r["doc_id"]: r["text"] for r in rows} == {r["doc_id"]: r["text"] for r in docs.collect()}
    shards = [r["shard"] for r in rows]
    assert shards[-1] >= 4
    ends = {}
    for r, n in zip(rows, slots, strict=True):
        low, high = ends.get(r["shard"], (n, n))
        ends[r["shard"]] = (min(low, n), max(high, n))
    spans = [ends[k] for k in sorted(ends)]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))  # two shards share the slot of the cut at most
    for last in set(shards):
        prefix = Counter(r["source"] for r in rows if r["shard"] <= last)
        total = sum(prefix.values())
        if total <= whole:
            assert all(abs(prefix[s] - total * w / sum(shares)) <= 2 * mixing.BLOCK_ROWS for s, w in zip(names, shares, strict=True))
    plain = {r["doc_id"]: r["shard"] for r in corpus_pipeline.shard(spark, docs, FOLDER).collect()}
    assert plain != {r["doc_id"]: r["shard"] for r in rows}  # without the mix the shards are others
