"""Line deduplication by content-defined chunks, with DataFrame functions only.

A rolling hash over the hashes of the last ``WINDOW`` lines marks chunk ends and
the hash of a line marks chunk starts, so an inserted or deleted line moves the
boundaries near it and no others.  Chunks that occur more than once, neighbours
among them joined wherever one is a single line, make passages of several lines;
a passage whose bytes occur more than once in the corpus is removed everywhere
but at its first occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import checkpoint, safe_id, text_keys

#: Lines under the rolling hash.
WINDOW = 2
#: A line ends a chunk if the rolling hash starts with one of these digits: one line in four.
END_DIGITS = tuple("0123")
#: A line starts a chunk if its own hash starts with one of these: three lines in four.
START_DIGITS = tuple("0123456789ab")
MIN_LINES = 2


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def chunk_starts(lines: Column) -> Column:
    """Index of the first line of each chunk, from 0."""

    def starts(i: Column) -> Column:
        rolled = F.md5(F.array_join(F.transform(F.slice(lines, i - WINDOW + 1, WINDOW), lambda x: F.md5(x)), ""))
        ended = (i >= WINDOW) & F.substring(F.when(i >= WINDOW, rolled), 1, 1).isin(*END_DIGITS)
        return ended | F.substring(F.md5(F.element_at(lines, i + 1)), 1, 1).isin(*START_DIGITS)

    inner = F.when(F.size(lines) > 1, F.sequence(F.lit(1), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.lit(0)), F.filter(inner, starts))


def chunks_of(lines: Column, starts: Column) -> Column:
    """(at, n, text) of each chunk; ``starts`` is a column, not an expression."""

    def chunk(at: Column, i: Column) -> Column:
        end = F.coalesce(F.try_element_at(starts, i + 2), F.size(lines))
        return F.struct(at.alias("at"), (end - at).alias("n"), F.array_join(F.slice(lines, at + 1, end - at), "\n").alias("text"))

    return F.transform(starts, chunk)


def repeated_lines(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(did, k1, k2, out): the lines to remove from a document, in order.

    A document is an id and a text; the first occurrence of a passage is that of
    the least (id, text key, line), and its lines stay.  Chunk keys of 128 bits
    find what may repeat; the texts of chunks are compared byte by byte as
    grouping keys.  A passage is a repeated chunk of ``MIN_LINES`` or two
    repeated neighbours, so longer passages are runs of overlapping ones.
    """
    docs = documents.select(safe_id(id_col).alias("did"), F.col(text_col).alias("text")).where(F.col("text").contains("\n")).withColumns(text_keys(F.col("text")))
    cut = docs.select("did", "k1", "k2", lines_of(F.col("text")).alias("lines")).withColumn("starts", chunk_starts(F.col("lines")))
    chunks = cut.select("did", "k1", "k2", F.posexplode(chunks_of(F.col("lines"), F.col("starts"))).alias("j", "c"))
    chunks = chunks.select("did", "k1", "k2", "j", "c.at", "c.n", F.col("c.text").alias("chunk")).withColumns({"c1": F.xxhash64(F.lit(1), "chunk"), "c2": F.xxhash64(F.lit(2), "chunk")})
    # One shuffle of chunk bytes: equal bytes are one row here, whatever their keys.
    texts = chunks.groupBy("c1", "c2", "chunk").agg(F.count(F.lit(1)).alias("n"))
    often = checkpoint(texts.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("texts"), F.max("n").alias("times")).where("times > 1").drop("times"))
    doc, key = ["did", "k1", "k2"], ["c1", "c2", "c3"]
    alone = often.where("texts = 1").select("c1", "c2", F.lit(0).alias("c3"))
    places = chunks.select(*doc, "j", "at", "n", "c1", "c2").join(alone, ["c1", "c2"])
    mixed = often.where("texts > 1").select("c1", "c2")
    if not mixed.isEmpty():  # chunks of equal keys and other bytes: their bytes are numbered
        nth = F.row_number().over(Window.partitionBy("c1", "c2").orderBy("chunk")).alias("c3")
        named = texts.join(mixed, ["c1", "c2"], "left_semi").select("c1", "c2", "chunk", nth)
        places = places.unionByName(chunks.join(named, ["c1", "c2", "chunk"]).select(*places.columns))
    places = checkpoint(places.distinct())
    one = F.struct(*key).alias("one")
    whole = places.where(F.col("n") >= MIN_LINES).select(*doc, "at", "n", one, F.struct(F.lit(0).cast("long").alias("c1"), F.lit(0).cast("long").alias("c2"), F.lit(-1).alias("c3")).alias("two"))
    follows = F.lead(F.struct("j", "n", *key)).over(Window.partitionBy(*doc).orderBy("j"))
    joined = places.withColumn("after", follows).where("after.j = j + 1 and (n = 1 or after.n = 1)")
    joined = joined.select(*doc, "at", (F.col("n") + F.col("after.n")).alias("n"), one, F.struct(*(f"after.{k}" for k in key)).alias("two"))
    passages = checkpoint(whole.unionByName(joined))
    place = F.struct(*doc, "at")
    firsts = passages.groupBy("one", "two").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    spans = passages.join(firsts, ["one", "two"]).withColumn("stays", place == F.col("first"))

    def covered(which: Column) -> Column:
        return F.flatten(F.transform(F.collect_set(F.when(which, F.struct("at", "n"))), lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))

    out = spans.groupBy(*doc).agg(F.array_sort(F.array_except(covered(~F.col("stays")), covered(F.col("stays")))).alias("out"))
    return out.where(F.size("out") > 0)


def dedup_lines(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``documents`` with the later occurrences of repeated passages cut out of
    the text, and n_lines, n_removed (lines) and n_runs_removed (of such lines).

    Null texts have no lines and stay null; an empty text has one line; a text
    whose every line repeats becomes empty.  A single line that repeats between
    other ones stays.  Rows of equal id and text are one document and get the
    same text; an empty table stays empty.  Columns of ``documents`` named like
    the results are replaced.
    """
    documents = documents.drop("n_lines", "n_removed", "n_runs_removed")
    spans = repeated_lines(documents, text_col, id_col).select(F.col("did").alias("__d"), F.col("k1").alias("__1"), F.col("k2").alias("__2"), F.col("out").alias("__out"))
    keyed = documents.withColumn("__did", safe_id(id_col)).withColumns({f"__{k}": c for k, c in text_keys(F.col(text_col)).items()})
    cut = keyed.join(spans, (F.col("__did") == F.col("__d")) & (F.col("__k1") == F.col("__1")) & (F.col("__k2") == F.col("__2")), "left")
    cut = cut.withColumn("__lines", lines_of(F.col(text_col)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__out"))
    left = F.array_join(F.transform(kept, lambda i: F.element_at("__lines", i + 1)), "\n")
    fresh = F.filter("__out", lambda x, i: (i == 0) | (F.element_at("__out", F.greatest(i, F.lit(1))) != x - 1))
    return (
        cut.withColumn("n_lines", F.coalesce(F.when(F.col(text_col).isNotNull(), F.size("__lines")), F.lit(0)).cast("long"))
        .withColumn("n_removed", F.coalesce(F.when(F.col("__out").isNotNull(), F.size("__out")), F.lit(0)).cast("long"))
        .withColumn("n_runs_removed", F.coalesce(F.when(F.col("__out").isNotNull(), F.size(fresh)), F.lit(0)).cast("long"))
        .withColumn(text_col, F.when(F.col("__out").isNull(), F.col(text_col)).otherwise(left))
        .select(*documents.columns, "n_lines", "n_removed", "n_runs_removed")
    )
