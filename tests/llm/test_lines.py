import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from quern.llm import lines


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def brute_chunks(text):
    parts = text.split("\n")
    starts = [0]
    for i in range(1, len(parts)):
        rolled = md5("".join(map(md5, parts[i - 2 : i]))) if i > 1 else "f"
        if rolled[0] in "0123" or md5(parts[i])[0] in "0123456789ab":
            starts.append(i)
    return [(a, b - a, "\n".join(parts[a:b])) for a, b in zip(starts, [*starts[1:], len(parts)], strict=True)]


def brute(rows):
    """{(id, text): text left}."""
    chunks = {k: brute_chunks(k[1]) for k in set(rows) if k[1] is not None and "\n" in k[1]}
    times = Counter(body for k in rows for _, _, body in chunks.get(k, []))
    places = {}
    for key, found in chunks.items():
        for j, (at, n, body) in enumerate(found):
            if times[body] > 1 and n > 1:
                places.setdefault((body,), []).append((key, at, n))
            if times[body] > 1 and j + 1 < len(found) and times[found[j + 1][2]] > 1 and 1 in (n, found[j + 1][1]):
                places.setdefault((body, found[j + 1][2]), []).append((key, at, n + found[j + 1][1]))
    out, stay = {}, {}
    for found in places.values():
        found.sort(key=lambda x: (x[0][0], x[1]))
        for i, (key, at, n) in enumerate(found if len(found) > 1 else []):
            (out if i else stay).setdefault(key, set()).update(range(at, at + n))
    return {k: k[1] if k not in out else "\n".join(x for i, x in enumerate(k[1].split("\n")) if i not in out[k] - stay.get(k, set())) for k in set(rows)}


def test_equals_brute_force(spark):
    rng = random.Random(5)
    pool = [f"line {i} " + "x" * rng.randint(0, 9) for i in range(40)]
    shared = [pool[i : i + 8] for i in (0, 10, 20)]
    rows = []
    for i in range(60):
        body = [f"own {i} {j}" for j in range(rng.randint(0, 6))] + rng.choice(shared) + [f"tail {i} {j}" for j in range(rng.randint(0, 5))]
        rows.append((i, "\n".join(body)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"]): r["text"] for r in lines.dedup_lines(df).collect()}
    assert found == {k[0]: v for k, v in brute(rows).items()}
    assert any(found[i] != t for i, t in rows)


def test_driver_table(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()} == {k[0]: v for k, v in brute(rows).items()}


def test_recall_of_repeated_runs(docs):
    """Lines in later occurrences of runs of two lines or more, of whatever surroundings."""
    rows = sorted((r["doc_id"], r["text"].split("\n")) for r in docs.collect() if r["text"] and "\n" in r["text"])
    first, wanted = {}, {}
    for i, parts in rows:
        for j, pair in enumerate(zip(parts, parts[1:], strict=False)):
            if first.setdefault(pair, (i, j)) != (i, j):
                wanted.setdefault(i, set()).update((j, j + 1))
    found = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(docs).collect() if r["n_removed"]}
    assert sum(found.values()) >= 0.8 * sum(map(len, wanted.values())) and set(found) <= set(wanted)


def test_long_documents_take_linear_time(spark):
    body = "\n".join(f"line {i}" for i in range(80_000))
    df = spark.createDataFrame([(1, body), (2, body + "\nown")], "doc_id long, text string")
    left = {r["doc_id"]: r for r in lines.dedup_lines(df).collect()}
    assert left[1]["text"] == body and left[2]["text"].split("\n")[-1] == "own" and left[2]["n_removed"] >= 79_990


def test_boundaries_resist_shifts(spark):
    body = "\n".join(f"some line {i}" for i in range(200))
    shifted = "new first line\n" + body
    a, b = ({c[2] for c in brute_chunks(t)} for t in (body, shifted))
    assert len(a & b) >= 0.9 * len(a)


def test_odd_rows(spark, odd_docs, no_docs):
    block = "\n".join(f"repeated {i}" for i in range(12))
    more = [(20, block, "en", "a", 1), (21, block, "en", "a", 1), (21, block, "en", "a", 1), (22, "\n\n\n\n\n\n", None, None, None), (None, "x\n" + block, None, None, None), (23, "\n" * 5000, "en", "a", 5000)]
    df = odd_docs.unionByName(spark.createDataFrame(more, odd_docs.schema)).withColumn("n_lines", F.lit(1))
    out = lines.dedup_lines(df)
    assert out.count() == df.count() and out.columns == [*odd_docs.columns, "n_lines", "n_removed", "n_runs_removed"]
    by_id = {}
    for r in out.collect():
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[20][0]["text"] == block and by_id[5][0]["text"] is None and by_id[6][0]["n_lines"] == 1
    assert len(by_id[21]) == 2 and by_id[21][0]["text"] == by_id[21][1]["text"] != block
    assert lines.dedup_lines(no_docs).count() == 0


def test_equal_keys_with_other_bytes_stay(spark, monkeypatch):
    block = "\n".join(f"same {i}" for i in range(10))
    other = "\n".join(f"else {i}" for i in range(10))
    df = spark.createDataFrame([(1, block), (2, block), (3, other)], "doc_id long, text string")
    plain = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}
    monkeypatch.setattr(lines.F, "xxhash64", lambda *c: F.length(c[-1]).cast("long") * 0)  # every key collides
    keys = lines.text_keys
    monkeypatch.setattr(lines, "text_keys", lambda t: {"k1": F.crc32(t.cast("binary")), "k2": F.length(t).cast("long")})
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()} == plain and keys is not None
    assert plain[3] == other


def test_no_python_in_the_plan(docs):
    plan = lines.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
