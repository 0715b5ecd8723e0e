import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def brute_model(texts, order=5):
    """Interpolated modified Kneser-Ney, straight from its definition: probability of a tuple of symbols."""
    seqs = [[None] * (order - 1) + list(t) for t in texts]
    counts = {order: Counter(tuple(s[i - order + 1 : i + 1]) for s in seqs for i in range(order - 1, len(s)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discounts(c):
        n = [0, *(sum(v == i for v in c.values()) for i in range(1, 5))]
        if not all(n[1:]):
            return (0.5, 0.75, 0.9)
        y = n[1] / (n[1] + 2 * n[2])
        return tuple(min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.01), i - 0.01) for i in (1, 2, 3))

    cut = {k: discounts(c) for k, c in counts.items()}
    totals, held = {k: defaultdict(int) for k in counts}, {k: defaultdict(float) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            totals[k][g[:-1]] += n
            held[k][g[:-1]] += cut[k][min(n, 3) - 1]

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        k, low = len(g), p(g[1:])
        if g[:-1] not in totals[k]:
            return low
        n = counts[k].get(g, 0)
        own = (n - cut[k][min(n, 3) - 1]) / totals[k][g[:-1]] if n else 0.0
        return own + held[k][g[:-1]] / totals[k][g[:-1]] * low

    return p, counts


def bits_of(p, text, order=5):
    s = [None] * (order - 1) + list(text or "")
    return sum(-math.log2(p(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s)))


def test_model_equals_brute_force(spark, docs):
    texts = [r["text"] for r in docs.where("length(text) < 1500").limit(40).collect()]
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    p, counts = brute_model(texts)
    asked = [*texts[:5], "zzz qqq### ", "É ñ", "a", "Привет, мир", "你好世界", "\0\0 nul", "", None]
    frame = spark.createDataFrame(list(enumerate(asked)), "i int, text string")
    found = {r["i"]: r for r in quality.score(frame, model).collect()}
    for i, t in enumerate(asked):
        assert found[i]["__symbols"] == len(t or "") and found[i]["__bits"] == pytest.approx(bits_of(p, t), rel=1e-4)
    for context in ((None,) * 4, tuple("the "), tuple("zzzz"), tuple("qthe")):
        assert sum(p((*context, c)) for (c,) in counts[1]) + p((*context, "?unknown")) == pytest.approx(1.0)


def test_scripts_are_told_apart(spark):
    """Noise in capitals or in another script costs more than text, since no symbol is folded."""
    texts = ["привет мир это хороший текст", "ЭТО ХОРОШИЙ ТЕКСТ И МИР", "这是一个很好的文本"] * 30
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    asked = ["это хороший текст", "штыъ жщюэ фцчх", "这是很好的", "龘靐齉齾龗"]
    bits = {r["i"]: r["__bits"] / r["__symbols"] for r in quality.score(spark.createDataFrame(list(enumerate(asked)), "i int, text string"), model).collect()}
    assert bits[1] > bits[0] + 3 and bits[3] > bits[2] + 3


def test_pieces_and_chunks_change_nothing(spark, docs, monkeypatch):
    model = quality.train(docs.select("text"))
    texts = docs.select("doc_id", "text").repartition(3)
    plain = {r["doc_id"]: (r["__symbols"], r["__bits"]) for r in quality.score(texts, model).collect()}
    monkeypatch.setattr(quality, "BUFFER_CHARS", 100)
    monkeypatch.setattr(quality, "PACK_BYTES", 3000)
    monkeypatch.setattr(quality, "CHUNK_CHARS", 20_000)
    cut = {r["doc_id"]: (r["__symbols"], r["__bits"]) for r in quality.score(texts, model).collect()}
    assert set(cut) == set(plain) and all(cut[k][0] == n and cut[k][1] == pytest.approx(b, rel=1e-5) for k, (n, b) in plain.items())


def brute_verdicts(docs, labels, held, quantile=0.99):
    """{id: (perplexity, accepted)}; docs: (id, lang, text); labels: {id: trusted}; held: ids not for the model."""
    trusted = [(i, lang or "", text) for i, lang, text in docs if labels.get(i) and text]
    p, _ = brute_model([t for i, _, t in trusted if i not in held])
    bits = {i: bits_of(p, t) for i, _, t in docs}
    mean, spread, own, pool = {}, {}, {}, []
    for lang in {x[1] for x in trusted}:
        mine = [(bits[i], len(t)) for i, l, t in trusted if l == lang and i in held]
        seen = mine or [(bits[i], len(t)) for i, l, t in trusted if l == lang]
        mean[lang] = sum(b for b, _ in seen) / sum(n for _, n in seen)
        own[lang] = [(b - n * mean[lang]) / math.sqrt(n) for b, n in mine]
        if mine:
            spread[lang] = math.sqrt(max(sum(e * e for e in own[lang]) / len(mine), 1e-6))
            pool += [math.ceil(e / spread[lang] * 1000) for e in own[lang]]
    shared, typical = sorted(pool)[math.ceil(len(pool) * quantile) - 1], sum(spread.values()) / len(spread)
    out = {}
    for i, lang, text in docs:
        lang = lang or ""
        if not text or lang not in mean:
            out[i] = (2 ** (bits[i] / len(text)) if text else None, True)
            continue
        steps = sorted(math.ceil(e * 1000) for e in own[lang])
        limit = steps[math.ceil(len(steps) * quantile) - 1] if len(steps) >= quality.FEWEST_HELD else math.ceil(spread.get(lang, typical) * shared)
        out[i] = (2 ** (bits[i] / len(text)), math.ceil((bits[i] - len(text) * mean[lang]) / math.sqrt(len(text)) * 1000) <= limit + 2)
    return out


@pytest.mark.parametrize("fewest", [100, 3])
def test_limits_and_verdicts_equal_brute_force(spark, docs, monkeypatch, fewest):
    monkeypatch.setattr(quality, "FEWEST_HELD", fewest)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    short = docs.where("length(text) < 4000 or text is null")
    lone = short.limit(1).select(F.lit(-7).cast("long").alias("doc_id"), "text", F.lit("xx").alias("lang"), "source", "n_chars")
    table = short.unionByName(lone).withColumn("doc_id", F.col("doc_id"))
    more = labels.unionByName(spark.createDataFrame([(-7, 1, 0)], LABELS).select(*labels.columns))
    ids = quality.trusted_ids(more)
    held = {r["id"] for r in ids.where(F.pmod(F.xxhash64("id"), F.lit(quality.CALIBRATION)) == 0).collect()}
    want = brute_verdicts([(r["doc_id"], r["lang"], r["text"]) for r in table.collect()], {r["id"]: True for r in ids.collect()}, held)
    found = {r["doc_id"]: r for r in quality.classify(table, more).collect()}
    assert set(found) == set(want) and sum(not w[1] for w in want.values()) > 3
    for i, (perplexity, accepted) in want.items():
        assert found[i]["accepted"] == accepted and (found[i]["perplexity"] == pytest.approx(perplexity, rel=1e-3) if perplexity else found[i]["perplexity"] is None)
        if found[i]["limit"] is not None and abs(found[i]["perplexity"] / found[i]["limit"] - 1) > 1e-3:
            assert (found[i]["perplexity"] <= found[i]["limit"]) == accepted


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("doc_id % 2 = 0")
    out = quality.classify(docs, seen).join(labels.where("doc_id % 2 = 1 and toxic = 0"), "doc_id")
    counts = {(r["quality"], r["accepted"]): r["count"] for r in out.groupBy("quality", "accepted").count().collect()}
    good, bad = counts.get((1, True), 0), counts.get((0, False), 0)
    assert good >= 0.97 * (good + counts.get((1, False), 0)) and bad >= 0.8 * (bad + counts.get((0, True), 0))


def test_thresholds_are_quantiles(spark):
    rows = [("en", s, True) for s in range(1, 101)] + [("fr", 5, True), ("de", 9, False)]
    found = {r["language"]: r["limit"] for r in quality.thresholds(spark.createDataFrame(rows, "language string, score long, trusted boolean"), 0.9).collect()}
    assert found == {"en": 90, "fr": 5}


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 1), (4, 1, 0), (8, 1, 0), (9, None, None), (None, 1, 0)], LABELS)
    extra = odd_docs.withColumn("limit", F.lit(1)).withColumn("score", F.lit("x"))
    out = quality.classify(extra, labels)
    assert out.count() == odd_docs.count()
    by_id = {r["doc_id"]: r for r in out.collect()}
    assert by_id[5]["perplexity"] is None and by_id[5]["accepted"] and by_id[6]["accepted"] and by_id[1]["accepted"]
    kept = quality.accepted_documents(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["accepted"] for r in out.collect())
    none = spark.createDataFrame([], LABELS)
    assert quality.classify(no_docs, labels).count() == 0
    assert quality.accepted_documents(odd_docs, none).count() == odd_docs.count()  # nothing to trust, nothing rejected
    assert {r["id"] for r in quality.trusted_ids(labels).collect()} == {1, 4, 8}
