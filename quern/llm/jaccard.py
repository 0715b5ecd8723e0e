"""Near-duplicate documents: n-gram Jaccard join by MinHash banding.

1. Each distinct text gets a MinHash signature over its word 5-grams.  Bands and
   rows follow from the threshold and the recall wanted there (``banding``): for
   0.8 they are 25 bands of 5 rows, which a pair of that similarity shares with
   probability 1 - (1 - 0.8**5)**25 > 0.9999.
2. Band hashes are shuffled; each bucket links its members to its least member
   (a star, never all pairs), and the components of these links hold every
   candidate pair.
3. Each component is verified on whole 5-gram sets: a task reads one component,
   or two blocks of a large one, counts the pairs at or over the threshold and
   returns one row per text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import textnum
from quern.llm.common import NULL_ID, checkpoint, has_words, in_arrow, safe_id, text_keys
from quern.llm.components import components

SIZE = 5
THRESHOLD = 0.8
#: Share of the pairs at the threshold that have to share a band, and hashes of a signature if that can be had with so many.
RECALL, HASHES = 0.9999, 128
#: A component of more shingles or texts than this is verified in blocks.
BLOCK_SHINGLES, BLOCK_TEXTS = 400_000, 800
#: Shingles in more texts of a block pair than this are counted by matrix product.
DENSE_FROM = 16


def banding(threshold: float, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, which let through the fewest other pairs,
    whose bands find ``recall`` of the pairs at ``threshold`` within ``hashes``
    hashes; single rows if even those need more.  What is left of the hashes
    goes to further bands."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("a threshold above 0 and up to 1, and a recall between them, are needed")

    def needed(rows: int) -> int:
        miss = 1 - threshold**rows
        return 1 if miss <= 0 else math.ceil(math.log(1 - recall) / math.log(miss))

    rows = max((r for r in range(1, hashes + 1) if threshold**r > 1e-12 and needed(r) * r <= hashes), default=1)
    return max(needed(rows), hashes // rows), rows


def _signer(bands: int, rows: int, size: int):
    seeds = np.random.default_rng(20240229).integers(0, 2**32, (2, bands * rows), dtype=np.uint64).astype(np.uint32)
    factors, shifts = seeds[0] | np.uint32(1), seeds[1]

    def sign(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of shingles and band hashes of each text."""
        counts, out = np.zeros(len(texts), dtype=np.int64), np.zeros((len(texts), bands), dtype=np.int64)
        for start, raws in textnum.batches(texts):
            words, offsets, *_ = textnum.words_of(raws)
            grams, where = textnum.shingles_of(words, offsets, size)
            each = np.diff(where)
            full = np.flatnonzero(each)
            counts[start : start + len(raws)] = each
            if not len(full):
                continue
            low = (grams >> np.uint64(32)).astype(np.uint32)
            least = np.empty((bands * rows, len(full)), dtype=np.uint32)
            for i in range(bands * rows):
                least[i] = np.minimum.reduceat((low ^ shifts[i]) * factors[i], where[:-1][full])
            keys = np.zeros((bands, len(full)), dtype=np.uint64)
            for b in range(bands):
                key = np.full(len(full), b + 1, dtype=np.uint64)
                for r in range(rows):
                    key = textnum.mix(key * np.uint64(textnum.GRAM_BASE) + least[b * rows + r])
                keys[b] = key
            out[start + full] = keys.T.view(np.int64)
        return counts, out

    def stage(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            counts, keys = sign(part.column(3).to_pylist())
            flat = pa.array(keys.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * keys.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(counts), lists], names=["did", "k1", "k2", "grams", "bands"])

    return stage


def _link_counts(ids: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, threshold: float) -> list[tuple[int, int, int]]:
    """(id, linked documents, least id it is joined to) of the texts with a link.

    Counts are whole numbers and the threshold is the decimal fraction that it
    is written as, so a pair exactly at it is linked however long the texts.
    ``side``: block of each text if only pairs across two blocks count.
    """
    n = len(ids)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=n)
    grams, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, dtype=np.int64)
    reps = np.diff(np.concatenate((starts, [len(grams)])))
    shared = np.zeros((n, n), dtype=np.int32)
    df = np.repeat(reps, reps)
    few = (df >= 2) & (df <= DENSE_FROM)
    run, who, size = np.repeat(np.arange(len(starts)), reps)[few], owner[few], df[few]
    for lag in range(1, int(size.max()) if len(size) else 1):
        same = np.flatnonzero(run[lag:] == run[:-lag])
        if not len(same):
            break
        shared += np.bincount(who[same] * n + who[same + lag], minlength=n * n).reshape(n, n)
    shared += shared.T
    many = df > DENSE_FROM
    run, who = np.unique(np.repeat(np.arange(len(starts)), reps)[many], return_inverse=True)[1], owner[many]
    for low in range(0, int(run.max()) + 1 if len(run) else 0, 4096):
        here = slice(*np.searchsorted(run, [low, low + 4096]))
        seen = np.zeros((n, int(run[here][-1]) - low + 1), dtype=np.float32)
        seen[who[here], run[here] - low] = 1
        shared += (seen @ seen.T).astype(np.int32)  # at most 4,096 each, exact as float32
    least_share = Fraction(str(threshold))
    both = sizes[:, None] + sizes[None, :]
    # shared / (both - shared) >= a / b without a division
    linked = shared * np.int64(least_share.numerator + least_share.denominator) >= both * np.int64(least_share.numerator)
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    root = ids.copy()
    while True:
        least = np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1)
        now = np.minimum(root, least)
        if np.array_equal(now, root):
            break
        root = now
    weight = linked.astype(np.float64) @ copies.astype(np.float64)
    return [(int(ids[i]), int(weight[i]), int(root[i])) for i in np.flatnonzero(linked.any(axis=1))]


def _verifier(size: int, threshold: float):
    fields = pa.schema([("rid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def solve(rows: list[tuple]) -> list[tuple[int, int, int]]:
        """rows: whole groups of (group, rid, copies, block, text)."""
        sets: list[np.ndarray] = []
        for _, raws in textnum.batches([r[4] for r in rows]):
            words, offsets, *_ = textnum.words_of(raws)
            grams, where = textnum.shingles_of(words, offsets, size)
            sets += [np.unique(grams[a:b]) for a, b in zip(where[:-1], where[1:], strict=True)]
        out, a = [], 0
        for b in range(1, len(rows) + 1):
            if b == len(rows) or rows[b][0] != rows[a][0]:
                group = rows[a:b]
                side = np.array([r[3] for r in group]) if group[0][0][1] != group[0][0][2] else None
                if b - a > 1:
                    out += _link_counts(np.array([r[1] for r in group]), np.array([r[2] for r in group]), sets[a:b], side, threshold)
                a = b
        return out

    def flat(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], schema=fields)

    def stage(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size_held = 0  # characters
        for part in parts:
            c, i, j, rid, copies, block, text = (col.to_pylist() for col in part.columns)
            for row in zip(zip(c, i, j, strict=True), rid, copies, block, text, strict=True):
                if held and row[0] != held[-1][0]:
                    if size_held > textnum.BUFFER:
                        yield flat(solve(held))
                        held, size_held = [], 0
                held.append(row)
                size_held += len(row[4] or "")
        if held:
            yield flat(solve(held))

    return stage


def _texts(documents: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return documents.select(safe_id(id_col).alias("did"), F.col(text_col).cast("string").alias("text")).withColumns(text_keys(F.col("text"))).select("did", "k1", "k2", "text")


def text_classes(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL, bands: int | None = None, rows: int | None = None) -> DataFrame:
    """One row per distinct text: k1, k2, n_docs, first_id, grams, links, class_id, is_first.

    ``links``: documents of other texts at or over the threshold;
    ``class_id``: least id of the documents joined by links and copies;
    ``is_first``: the text that holds that document.  ``bands`` and ``rows``
    are those that find ``recall`` of the pairs at the threshold, unless both
    are given.
    """
    if bands is None or rows is None:
        bands, rows = banding(threshold, recall)
    docs = _texts(documents, text_col, id_col)
    signed = docs.transform(in_arrow, _signer(bands, rows, size), "did long, k1 long, k2 long, grams long, bands array<long>")
    reps = signed.groupBy("k1", "k2").agg(F.min("did").alias("first_id"), F.count(F.lit(1)).alias("n_docs"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    reps = checkpoint(reps.withColumn("rid", F.monotonically_increasing_id()))
    marks = reps.where("grams > 0").select("rid", F.explode("bands").alias("h"))
    buckets = marks.groupBy("h").agg(F.min("rid").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = marks.join(buckets, "h").where("rid <> least").select("rid", "least").distinct()
    near = components(stars, "rid", "least")
    members = near.select(F.col("node").alias("rid"), F.col("root").alias("cid")).unionByName(near.select(F.col("root").alias("rid"), F.col("root").alias("cid")).distinct())
    members = members.join(reps.select("rid", "k1", "k2", "first_id", "n_docs", "grams"), "rid")
    sizes = members.groupBy("cid").agg(F.greatest(F.ceil(F.sum("grams") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS)).cast("int").alias("nb"))
    members = checkpoint(members.join(sizes, "cid").withColumn("block", F.when(F.col("nb") > 1, F.pmod(F.xxhash64("rid"), F.col("nb")).cast("int")).otherwise(0)))
    wanted = members.select("cid", "rid", "k1", "k2", F.col("first_id").alias("did"), "n_docs", "nb", "block")
    texts = docs.join(wanted, ["k1", "k2", "did"])
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    dealt = texts.withColumn("o", other).select("cid", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "rid", "n_docs", "block", "text")
    dealt = dealt.repartition("cid", "i", "j").sortWithinPartitions("cid", "i", "j", "rid")
    checked = checkpoint(dealt.transform(in_arrow, _verifier(size, threshold), "rid long, links long, root long"))
    roots = components(checked, "rid", "root")
    links = checked.groupBy("rid").agg(F.sum("links").alias("links"))
    classed = (
        reps.drop("bands")
        .join(links, "rid", "left")
        .join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left")
        .withColumns({"links": F.coalesce("links", F.lit(0).cast("long")), "root": F.coalesce("root", "rid")})
    )
    heads = classed.where("links > 0").groupBy("root").agg(F.min("first_id").alias("least_id"))
    return classed.join(heads, "root", "left").withColumn("class_id", F.coalesce("least_id", "first_id")).withColumn("is_first", F.col("first_id") == F.col("class_id")).drop("root", "least_id", "rid")


def near_duplicates(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document row: id, class_id and n_links.

    Two documents are linked if their texts are equal or the Jaccard
    similarity of their sets of word 5-grams is 0.8 or more; ``n_links``
    counts linked documents, ``class_id`` is the least id joined by links.
    Texts without words (null, empty, only marks) have no n-grams: they link
    to nothing and are their own class.  A null id gives a null class unless
    another document of its class has an id.  Repeated rows are copies.
    """
    classes = text_classes(documents, text_col, id_col, **options)
    rows = documents.select(F.col(id_col), safe_id(id_col).alias("__did"), *(c.alias(k) for k, c in text_keys(F.col(text_col)).items()))
    none = F.col("grams") == 0
    kept = classes.select("k1", "k2", "grams", "n_docs", "links", "class_id")
    return rows.join(kept, ["k1", "k2"]).select(
        F.col(id_col),
        F.when(none, F.col(id_col).cast("long")).otherwise(F.nullif("class_id", F.lit(NULL_ID))).alias("class_id"),
        F.when(none, F.lit(0)).otherwise(F.col("n_docs") - 1 + F.col("links")).cast("long").alias("n_links"),
    )


def keep_one(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The documents with one row of each class: that of its least id.

    Texts without words have no class and all stay; of repeated rows one stays.
    """
    keep = text_classes(documents, text_col, id_col, **options).where("grams > 0 and is_first")
    keys = ["__k1", "__k2", "__did"]
    keyed = documents.withColumns({f"__{k}": c for k, c in text_keys(F.col(text_col)).items()}).withColumn("__did", safe_id(id_col))
    found = keyed.join(keep.select(*(F.col(c).alias(k) for c, k in zip(("k1", "k2", "first_id"), keys, strict=True)), F.lit(True).alias("__kept")), keys, "left")
    found = found.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy("__did")))
    return found.where(~has_words(F.col(text_col)) | (F.col("__kept") & (F.col("__nth") == 1))).select(*documents.columns)
