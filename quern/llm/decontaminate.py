"""Benchmark decontamination with DataFrame functions only.

A benchmark item is cut into windows of ten words (an item of fewer words is
one window).  Documents are probed with short grams: any occurrence of a window
of L words covers one whole gram of g words that starts at a multiple of
L - g + 1, so one gram in L - g + 1 is looked up in the broadcast hash set.
Around the grams that are found, whole windows are compared as text, which
makes the result exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import safe_id, sized, text_keys, words

WINDOW = 10
PROBE = 5
#: A set of windows or grams of at most so many rows (64 bytes each, or less
#: for grams) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, n, w): each distinct window of n words of each item."""
    w = F.col("__w")
    n = F.least(F.size(w), F.lit(WINDOW))
    return (
        benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("__w"))
        .where(F.size(w) > 0)
        .select("item_id", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))).alias("w"))
        .distinct()
    )


def _grams(w: Column, size: int, stride: int) -> Column:
    """(at, gram hash) of the grams that start at multiples of ``stride``."""
    last = F.size(w) - size
    at = F.when(last >= 0, F.sequence(F.lit(0), F.floor(last / stride).cast("int")))
    return F.transform(at, lambda i: F.struct((i * stride).alias("at"), F.xxhash64(F.slice(w, i * stride + 1, size)).alias("gram")))


def find_hits(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(k1, k2, hits, items) for each distinct text with a benchmark window.

    ``hits``: sorted (start word, number of words) of every occurrence;
    ``items``: the sorted distinct item ids as strings.  Results belong to a
    text (its 128-bit key), so repeated rows and copies share one.  Items with
    a null id count for hits but name no item.
    """
    windows = benchmark_windows(benchmark, item_col, item_text)
    shapes = windows.groupBy("n").agg(F.count_distinct("w").alias("rows")).collect()  # at most WINDOW rows
    docs = documents.select(safe_id(id_col).alias("did"), F.col(text_col).alias("text")).withColumns(text_keys(F.col("text")))
    tokens = docs.select("did", "k1", "k2", words(F.col("text")).alias("w"))
    found = None
    for n, rows in ((r["n"], r["rows"]) for r in shapes):
        size = min(PROBE, n)
        cut = F.split("w", " ")
        probes = (
            windows.where(F.col("n") == n)
            .select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - size)), lambda i: F.xxhash64(F.slice(cut, i + 1, size)))).alias("gram"))  # noqa: B023
            .distinct()
        )
        scanned = tokens.select("did", "k1", "k2", F.explode(_grams(F.col("w"), size, n - size + 1)).alias("g")).select("did", "k1", "k2", "g.at", "g.gram")
        at = scanned.join(sized(probes, BROADCAST_ROWS, rows * (n - size + 1)), "gram", "left_semi").select("did", "k1", "k2", F.struct(F.lit(n).alias("n"), "at").alias("p"))
        found = at if found is None else found.unionByName(at)
    if found is None:
        return docs.where(F.lit(False)).select("k1", "k2", F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))).alias("hits"), F.array(F.lit("")).alias("items"))
    near = found.groupBy("k1", "k2").agg(F.min("did").alias("did"), F.collect_set("p").alias("near"))
    starts = F.array_distinct(
        F.flatten(
            F.transform(
                "near",
                lambda p: F.transform(F.sequence(F.greatest(F.lit(0), p["at"] - p["n"] + F.least(F.lit(PROBE), p["n"])), p["at"]), lambda i: F.struct(i.alias("at"), p["n"].alias("n"))),
            )
        )
    )
    whole = (
        docs.join(near, ["k1", "k2", "did"])
        .select("k1", "k2", words(F.col("text")).alias("w"), starts.alias("s"))
        .select("k1", "k2", F.explode(F.transform(F.filter("s", lambda s: s["at"] + s["n"] <= F.size("w")), lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"), F.array_join(F.slice("w", s["at"] + 1, s["n"]), " ").alias("w")))).alias("c"))
        .select("k1", "k2", "c.*")
    )
    kinds = windows.select("n", "w").distinct()
    total = sum(r["rows"] for r in shapes)
    real = whole.join(sized(kinds, BROADCAST_ROWS, total), ["n", "w"], "left_semi").distinct()
    hits = real.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("hits"))
    items = (
        real.select("k1", "k2", "n", "w")
        .distinct()
        .join(windows.where(F.col("item_id").isNotNull()), ["n", "w"])
        .select("k1", "k2", F.col("item_id").cast("string").alias("item_id"))
        .groupBy("k1", "k2")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    return hits.join(items, ["k1", "k2"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def covered(hits: Column) -> Column:
    """Number of words inside any of the sorted (at, n) spans."""
    zero = F.struct(F.lit(0).alias("words"), F.lit(0).alias("end"))

    def step(acc: Column, h: Column) -> Column:
        end = h["at"] + h["n"]
        more = F.greatest(F.lit(0), end - F.greatest(h["at"], acc["end"]))
        return F.struct((acc["words"] + more).alias("words"), F.greatest(end, acc["end"]).alias("end"))

    return F.aggregate(hits, zero, step, lambda acc: acc["words"])


def contamination(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document row: id, n_words, n_hit, hits, items, contaminated.

    Null and empty texts have no words and are clean; repeated rows each get
    their row; a null id stays null; other columns are not read.
    """
    base = documents.select(F.col(id_col), F.size(words(F.col(text_col))).alias("n_words"), *(c.alias(k) for k, c in text_keys(F.col(text_col)).items()))
    found = find_hits(documents, benchmark, text_col, id_col, item_col, item_text)
    return (
        base.join(found, ["k1", "k2"], "left")
        .withColumn("n_hit", F.coalesce(covered(F.col("hits")), F.lit(0)))
        .withColumn("contaminated", F.col("n_hit") > 0)
        .drop("k1", "k2")
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Documents without benchmark passages; the columns of ``documents``.

    ``remove="documents"`` leaves out every document with a hit;
    ``remove="spans"`` cuts the words that are hit, with the separators that
    follow them, out of the text.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    keys = text_keys(F.col(text_col))
    found = find_hits(documents, benchmark, text_col, id_col)
    keyed = documents.withColumns({"__k1": keys["k1"], "__k2": keys["k2"]})
    on = (F.col("__k1") == F.col("__f1")) & (F.col("__k2") == F.col("__f2"))
    found = found.select(F.col("k1").alias("__f1"), F.col("k2").alias("__f2"), F.col("hits").alias("__hits"))
    if remove == "documents":
        return keyed.join(found.drop("__hits"), on, "left_anti").select(*documents.columns)
    cut = F.when(F.col("__hits").isNull(), F.col(text_col)).otherwise(_without(F.col(text_col), F.col("__hits")))
    return keyed.join(found, on, "left").withColumn(text_col, cut).select(*documents.columns)


def _without(text: Column, hits: Column) -> Column:
    """The text without the words in ``hits``; a kept word takes its separator along."""
    spans = F.regexp_extract_all(text, F.lit(r"([0-9A-Za-z\x{80}-\x{10FFFF}]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)"), F.lit(1))
    head = F.regexp_extract(text, r"^([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)", 1)
    hit = lambda i: F.exists(hits, lambda h: (h["at"] <= i) & (i < h["at"] + h["n"]))
    kept = F.filter(spans, lambda _, i: ~hit(i))
    return F.concat(head, F.array_join(kept, ""))
