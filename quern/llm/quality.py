"""Quality classifier: interpolated modified Kneser-Ney over character 5-grams.

Trusted text (labelled good and not toxic) is counted where it lies; symbols
are code points, none is folded.  Counts are merged by n-gram, and each order's
contexts by context, so the model is a set of sharded tables that grow with
the text.  To score documents, each task asks for the distinct 5-grams of its
texts; requests are joined with the counts of every order by n-gram and by
context, and the costs go back to the task that holds the texts, which are sent
once, compressed.  No table of n-grams is broadcast or gathered.

The excess of a document is its bits over those of as many symbols of its
language, by the root of its symbols, which keeps its spread alike at every
length.  A document is rejected if its excess is above a high quantile of
trusted documents of its language that the model hasn't seen; put in terms of
perplexity, short texts have a higher limit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quern.llm import textnum
from quern.llm.common import checkpoint, in_arrow, release, safe_id, sized, text_keys

ORDER = 5
#: The symbol before a text; no code point.
START = 0x110000
#: Share of trusted text of a language that the threshold lets pass.
QUANTILE = 0.99
#: One trusted document in so many is kept from the model and sets the threshold.
CALIBRATION = 2
#: A language with fewer such documents can't show the quantile itself: it takes
#: that of all languages, whose excesses are divided by their language's spread.
FEWEST_HELD = 100
#: Excesses are compared as whole numbers of this many a bit.
STEPS = 1000
#: Characters that are hashed at a time, and that one request covers at most.
BUFFER_CHARS, CHUNK_CHARS = 1 << 19, 1 << 26
#: Characters of a task's texts at least: partitions of fewer are joined, so that a 5-gram is asked for by fewer tasks.
TASK_CHARS = 16 << 20
#: Slots that equal 5-grams of a buffer meet in, as a power of two.
SLOT_BITS = 21
#: Bytes of texts that are packed together.
PACK_BYTES = 4 << 20
#: Compression level of what is sent.
LEVEL = 6
#: Tables of languages, of trusted ids and of rejected documents of at most so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_LANGUAGES, BROADCAST_KEYS = 10_000, 1 << 20

U = np.uint64
_WIDTH = 4 * ORDER


def _batches(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, places to count, index of the text of each place) of at most about BUFFER_CHARS; long texts go in pieces."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for a in range(0, len(text or ""), BUFFER_CHARS):
            piece = text[a : a + BUFFER_CHARS]
            held.append((i, text[a - ORDER + 1 : a] if a else "\0" * (ORDER - 1), piece, a == 0))
            size += len(piece)
            if size >= BUFFER_CHARS:
                yield _symbols(held)
                held, size = [], 0
    if held:
        yield _symbols(held)


def _symbols(pieces: list[tuple[int, str, str, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    units = np.frombuffer("".join(before + piece for _, before, piece, _ in pieces).encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
    lengths = np.fromiter((len(p[2]) for p in pieces), dtype=np.int64, count=len(pieces))
    begins = np.cumsum(lengths + ORDER - 1) - lengths - ORDER + 1
    fresh = begins[[p[3] for p in pieces]]
    counted = np.ones(len(units), dtype=bool)
    for k in range(ORDER - 1):
        units[fresh + k] = START
        counted[begins + k] = False
    return units, np.flatnonzero(counted), np.repeat([p[0] for p in pieces], lengths)


def _mixed(columns: Iterable[np.ndarray]) -> np.ndarray:
    """Hashes of 5-grams whose symbols are in ``columns``, the last one first."""
    total = U(0)
    for back, column in enumerate(columns):
        total = total + (column.astype(U) + U(1)) * U(pow(textnum.GRAM_BASE, back + 1, 1 << 64))
    return textnum.mix(total)


def _hashes(units: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the 5-gram that ends at each place."""
    if not len(at):
        return np.zeros(0, dtype=U)
    return _mixed(units[ORDER - 1 - back : len(units) - back] for back in range(ORDER))[at - ORDER + 1]


def _hash_of(symbols: np.ndarray) -> np.ndarray:
    return _mixed(symbols[:, ORDER - 1 - back] for back in range(ORDER))


def _alike(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of one of each distinct hash, for each hash the place of its equal among them).

    The last hash of each slot stands for its equals there; those that share a
    slot with another one are sorted.
    """
    slot, places = (hashes >> U(64 - SLOT_BITS)).astype(np.int64), np.arange(len(hashes))
    last = np.empty(1 << SLOT_BITS, dtype=np.int64)
    last[slot] = places
    same = last[slot]
    other = np.flatnonzero(hashes[same] != hashes)
    _, first, which = np.unique(hashes[other], return_index=True, return_inverse=True)
    same[other] = other[first][which]
    return np.flatnonzero(same == places), same


class _Distinct:
    """Distinct 5-grams by hash, their counts and their symbols."""

    def __init__(self) -> None:
        self.parts, self.size, self.least = [], 0, 1 << 16

    def add(self, units: np.ndarray, at: np.ndarray) -> None:
        hashes = _hashes(units, at)
        first, same = _alike(hashes)
        first = first[np.argsort(hashes[first])]
        self.put(hashes[first], np.bincount(same, minlength=len(same))[first], units[at[first][:, None] + np.arange(1 - ORDER, 1)])

    def put(self, found: np.ndarray, times: np.ndarray, symbols: np.ndarray) -> None:
        self.parts.append((found, times, symbols))
        self.size += len(found)
        if self.size > 2 * self.least:
            self.least = max(self.least, len(self.merged()[0]))

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64), np.zeros((0, ORDER), dtype="<u4")
        if len(self.parts) > 1:
            found, first, which = np.unique(np.concatenate([p[0] for p in self.parts]), return_index=True, return_inverse=True)
            times = np.bincount(which, np.concatenate([p[1] for p in self.parts])).astype(np.int64)
            symbols = np.concatenate([p[2] for p in self.parts])[first]
            self.parts, self.size = [(found, times, symbols)], len(found)
        return self.parts[0]


def _binary(symbols: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(symbols, dtype="<u4")
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(_WIDTH), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())


def _packed(data: np.ndarray) -> bytes:
    """Columns of ``data`` one after the other, compressed."""
    raw = np.ascontiguousarray(data.T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(raw, asbytes=True)


def _unpacked(blob: bytes, kind: str, columns: int = 1) -> np.ndarray:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(raw, dtype=kind).reshape(columns, -1).T


def _by_shard(found: np.ndarray, symbols: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, rows in the order of their symbols, in which they compress best)."""
    shard = (found % U(shards)).astype(np.int64)
    wide = symbols.astype(U)
    order = np.lexsort(((wide[:, 3] << U(21)) | wide[:, 4], (wide[:, 0] << U(42)) | (wide[:, 1] << U(21)) | wide[:, 2], shard))
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        if ends[s + 1] > ends[s]:
            yield s, order[ends[s] : ends[s + 1]]


def _counter(shards: int):
    """(shard, 5-grams of the texts of a task, their counts)."""

    def stage(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Distinct()
        for part in parts:
            for units, at, _ in _batches(part.column(0).to_pylist()):
                total.add(units, at)
        found, times, symbols = total.merged()
        rows = [(s, _packed(symbols[i]), _packed(times[i])) for s, i in _by_shard(found, symbols, shards)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], names=["shard", "blob", "times"])

    return stage


def _add_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, n): the counts of the 5-grams of a partition of shards, added up."""
    total = _Distinct()
    for part in parts:
        for blob, times in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
            symbols = _unpacked(blob, "<u4", ORDER)
            total.put(_hash_of(symbols), _unpacked(times, "<i8")[:, 0], symbols)
    _, times, symbols = total.merged()
    for a in range(0, len(times), 1 << 18):
        yield pa.RecordBatch.from_arrays([_binary(symbols[a : a + (1 << 18)]), pa.array(times[a : a + (1 << 18)])], names=["g", "n"])


def _suffix(order: int) -> Column:
    """The last ``order`` symbols of an n-gram of one more."""
    return F.expr(f"substring(g, 5, {4 * order})")


def _discounts(n: list[float]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more; ``n``: n-grams with counts 1 to 4."""
    if not all(n):
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.01), i - 0.01) for i in (1, 2, 3))


class Model:
    """``own``: (order, g, value), what an n-gram has itself; ``rest``: (order, h, value), what a context leaves to the lower order; ``base``: probability of an unknown symbol."""

    def __init__(self, own: DataFrame, rest: DataFrame, base: float) -> None:
        self.own, self.rest, self.base = own, rest, base


def train(trusted_text: DataFrame) -> Model:
    """The model of a one-column frame of texts."""
    shards = int(trusted_text.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = trusted_text.transform(in_arrow, _counter(shards), "shard int, blob binary, times binary").repartition(shards, "shard")
    table = checkpoint(sent.transform(in_arrow, _add_up, "g binary, n long"))
    counted = table.select(F.lit(ORDER).alias("order"), "g", "n")
    for order in range(ORDER - 1, 0, -1):
        table = table.select(_suffix(order).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        counted = counted.unionByName(table.select(F.lit(order).alias("order"), "g", "n"))
    counted = checkpoint(counted.withColumn("h", F.expr("substring(g, 1, length(g) - 4)")))
    cut, symbols = F.lit(None).cast("double"), 0
    for r in counted.groupBy("order").agg(F.count(F.lit(1)).alias("all"), *(F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5))).collect():  # ORDER rows
        d = _discounts([float(r[f"n{i}"]) for i in range(1, 5)])
        cut = F.when(F.col("order") == r["order"], F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])).otherwise(cut)
        symbols = r["all"] if r["order"] == 1 else symbols
    contexts = checkpoint(counted.groupBy("order", "h").agg(F.sum("n").alias("all"), F.sum(cut).alias("cut")))
    own = counted.join(contexts.drop("cut"), ["order", "h"]).select("order", "g", ((F.col("n") - cut) / F.col("all")).alias("value"))
    return Model(checkpoint(own), contexts.select("order", "h", (F.col("cut") / F.col("all")).alias("value")), 1.0 / (symbols + 1))


def gram_bits(grams: DataFrame, model: Model) -> DataFrame:
    """``grams`` (distinct ``g`` of five symbols, and other columns) with the bits of each.

    Orders are joined from the lowest: p = own + rest * p of the last symbols.
    """
    wanted = {ORDER: grams}
    for order in range(ORDER - 1, 0, -1):
        wanted[order] = wanted[order + 1].select(_suffix(order).alias("g")).distinct()
    lower = None
    for order in range(1, ORDER + 1):
        own = model.own.where(F.col("order") == order).select("g", F.col("value").alias("own"))
        rest = model.rest.where(F.col("order") == order).select("h", F.col("value").alias("rest"))
        asked = wanted[order].withColumn("h", F.expr("substring(g, 1, length(g) - 4)")).join(own, "g", "left").join(rest, "h", "left").drop("h")
        if lower is None:
            asked = asked.withColumn("p", F.lit(model.base))
        else:
            asked = asked.withColumn("low", _suffix(order - 1)).join(lower, "low").drop("low")
        asked = asked.withColumn("p", F.coalesce("own", F.lit(0.0)) + F.coalesce("rest", F.lit(1.0)) * F.col("p")).drop("own", "rest")
        lower = asked.select(F.col("g").alias("low"), "p")
    return asked.withColumn("bits", -F.log2("p")).drop("p")


def _chunks(parts: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(chunk, rows) of a task; a chunk is its next CHUNK_CHARS, rows have about PACK_BYTES."""
    base, chunk, size = TaskContext.get().partitionId() << 24, 0, 0
    for part in parts:
        lengths = np.array([len(t or "") for t in part.column(text_at).to_pylist()], dtype=np.int64)
        cuts = np.unique(np.concatenate(([0], np.searchsorted(np.cumsum(lengths), np.arange(PACK_BYTES, int(lengths.sum()) + 1, PACK_BYTES)) + 1, [len(lengths)])))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if size >= CHUNK_CHARS:
                chunk, size = chunk + 1, 0
            size += int(lengths[a:b].sum())
            yield base + chunk, part.slice(a, b - a)


def _asker(shards: int, text_at: int):
    """Requests: (shard, chunk, distinct 5-grams in the order of their symbols)."""

    def ask(chunk: int, seen: _Distinct) -> pa.RecordBatch:
        found, _, symbols = seen.merged()
        rows = [(s, _packed(symbols[i])) for s, i in _by_shard(found, symbols, shards)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "chunk", "blob"])

    def stage(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, _Distinct()
        for chunk, rows in _chunks(parts, text_at):
            if chunk != at:
                if at is not None:
                    yield ask(at, seen)
                at, seen = chunk, _Distinct()
            for units, places, _ in _batches(rows.column(text_at).to_pylist()):
                seen.add(units, places)
        if at is not None:
            yield ask(at, seen)

    return stage


def _distinct(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, g): the distinct 5-grams of the requests of a shard."""
    shards: dict[int, _Distinct] = {}
    for part in parts:
        for shard, blob in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            symbols = _unpacked(blob, "<u4", ORDER)
            shards.setdefault(shard, _Distinct()).put(_hash_of(symbols), np.ones(len(symbols), dtype=np.int64), symbols)
    for shard, seen in shards.items():
        symbols = seen.merged()[2]
        for a in range(0, len(symbols), 1 << 18):
            rows = symbols[a : a + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard, dtype=np.int32)), _binary(rows)], names=["shard", "g"])


def _answer(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, chunk): the costs of a shard, then its requests."""
    at, grams, costs, hashes = None, [], [], None
    for part in parts:
        out: list[tuple[int, int, bytes]] = []
        for shard, chunk, blob, bits in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
            if shard != at:
                at, grams, costs, hashes = shard, [], [], None
            if chunk < 0:
                grams.append(blob)
                costs.append(bits)
                continue
            if hashes is None:
                hashes = _hash_of(np.frombuffer(b"".join(grams), dtype="<u4").reshape(-1, ORDER))
                order = np.argsort(hashes)
                hashes, known, grams = hashes[order], np.array(costs, dtype=np.float32)[order], []
            out.append((chunk, shard, _packed(known[np.searchsorted(hashes, _hash_of(_unpacked(blob, "<u4", ORDER)))])))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], names=["chunk", "shard", "blob"])


def _pack(text_at: int):
    def stage(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _chunks(parts, text_at):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as writer:
                writer.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([2**31 - 1], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "shard", "blob"])

    return stage


def _scorer(shards: int, text_at: int, kept: list[int]):
    """Rows sorted by (chunk, shard): the answers to a chunk, then its documents."""

    def score(answers: dict[int, bytes], packs: list[bytes]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[pa.RecordBatch]:
            for blob in packs:
                yield from pa.ipc.open_stream(blob)

        seen = _Distinct()
        for part in rows():
            for units, at, _ in _batches(part.column(text_at).to_pylist()):
                seen.add(units, at)
        found, _, symbols = seen.merged()
        costs, asked = np.zeros(len(found)), dict(_by_shard(found, symbols, shards))
        given = {s: _unpacked(blob, "<f4")[:, 0] for s, blob in answers.items()}
        if {s: len(i) for s, i in asked.items()} != {s: len(bits) for s, bits in given.items()}:
            raise RuntimeError("documents weren't the same when they were read again")
        for s, i in asked.items():
            costs[i] = given[s]
        for part in rows():
            texts = part.column(text_at).to_pylist()
            bits = np.zeros(len(texts))
            for units, at, doc in _batches(texts):
                hashes = _hashes(units, at)
                first, same = _alike(hashes)
                cost = np.zeros(len(hashes))
                cost[first] = costs[np.searchsorted(found, hashes[first])]
                bits += np.bincount(doc, cost[same], minlength=len(texts))
            symbols = np.fromiter((len(t or "") for t in texts), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(symbols), pa.array(bits)], names=[*(part.schema.names[i] for i in kept), "__symbols", "__bits"])

    def stage(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, answers, packs = None, {}, []
        for part in parts:
            for chunk, shard, blob in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                if chunk != at:
                    yield from score(answers, packs)
                    at, answers, packs = chunk, {}, []
                if shard < shards:
                    answers[shard] = blob
                else:
                    packs.append(blob)
        yield from score(answers, packs)

    return stage


def score(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``documents`` without the text, and ``__symbols`` (long) and ``__bits``
    (double) of each whole text; null and empty texts have none of either.

    ``documents`` is read twice and has to be the same then: a table or a checkpoint.
    """
    shards = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = documents.columns.index(text_col)
    # Both readings take the same columns, so that both have the same plan.
    asked = checkpoint(documents.transform(in_arrow, _asker(shards, at), "shard int, chunk long, blob binary"))
    release(documents.sparkSession)  # what counting left
    distinct = asked.select("shard", "blob").repartition(shards, "shard").transform(in_arrow, _distinct, "shard int, g binary")
    costs = checkpoint(gram_bits(distinct, model).select("shard", F.lit(-1).cast("long").alias("chunk"), F.col("g").alias("blob"), "bits"))
    release(documents.sparkSession)  # what the joins of the orders sent
    requests = costs.unionByName(asked.withColumn("bits", F.lit(None).cast("double")))
    answers = requests.repartition(shards, "shard").sortWithinPartitions("shard", "chunk").transform(in_arrow, _answer, "chunk long, shard int, blob binary")
    kept = [i for i in range(len(documents.columns)) if i != at]
    packs = documents.transform(in_arrow, _pack(at), "chunk long, shard int, blob binary")
    # A chunk's number says which task of ``documents`` it is of: each has one here too.
    tasks = documents.rdd.getNumPartitions()
    met = packs.unionByName(answers).repartitionById(max(tasks, 1), F.shiftright("chunk", 24).cast("int")).sortWithinPartitions("chunk", "shard")
    schema = StructType([*(documents.schema.fields[i] for i in kept), StructField("__symbols", LongType()), StructField("__bits", DoubleType())])
    return met.transform(in_arrow, _scorer(shards, at, kept), schema)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """Ids whose labels all say good and not toxic."""
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    return said.agg(F.min(F.coalesce(quality_col, F.lit(0))).alias("q"), F.max(F.coalesce(toxic_col, F.lit(1))).alias("t")).where("q = 1 and t = 0").select("id")


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(language, limit): the quantile of trusted scores, over all of them.

    Scores are whole numbers, so a language has a bounded number of rows here
    however many documents it has.
    """
    bins = scored.where("trusted").groupBy("language", "score").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("language").orderBy("score")
    full = Window.partitionBy("language")
    ranked = bins.withColumns({"below": F.sum("n").over(up), "all": F.sum("n").over(full)})
    return ranked.where(F.col("below") >= F.ceil(F.col("all") * quantile)).groupBy("language").agg(F.min("score").alias("limit"))


def _excess() -> Column:
    return (F.col("__bits") - F.col("__symbols") * F.col("__mean")) / F.sqrt(F.greatest(F.col("__symbols"), F.lit(1)))


def language_limits(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(__language, __mean, __limit) of the languages with trusted documents.

    ``scored``: __language, __symbols, __bits and held (not seen by the model)
    of trusted documents with text.  A language without held documents has the
    mean of its other ones and the mean spread of all languages.
    """
    square = F.col("__bits") * F.col("__bits") / F.col("__symbols")
    sums = [F.sum(F.when(on, F.col(c))).alias(f"{c}{n}") for c in ("__bits", "__symbols") for n, on in (("", F.lit(True)), ("_h", F.col("held")))]
    per = scored.groupBy("__language").agg(*sums, F.count_if("held").alias("n"), F.sum(F.when(F.col("held"), square)).alias("squares"))
    per = per.withColumn("__mean", F.when(F.col("n") > 0, F.col("__bits_h") / F.col("__symbols_h")).otherwise(F.col("__bits") / F.col("__symbols")))
    spread = (F.col("squares") - 2 * F.col("__mean") * F.col("__bits_h") + F.col("__mean") * F.col("__mean") * F.col("__symbols_h")) / F.nullif(F.col("n"), F.lit(0))
    per = checkpoint(per.select("__language", "__mean", "n", F.when(F.col("n") > 0, F.sqrt(F.greatest(spread, F.lit(1e-6)))).alias("spread")))
    held = scored.where("held").join(sized(per, BROADCAST_LANGUAGES), "__language").withColumn("excess", _excess())
    own = thresholds(held.select(F.col("__language").alias("language"), F.ceil(F.col("excess") * STEPS).cast("long").alias("score"), F.lit(True).alias("trusted")), quantile)
    pooled = thresholds(held.select(F.lit("").alias("language"), F.ceil(F.col("excess") / F.col("spread") * STEPS).cast("long").alias("score"), F.lit(True).alias("trusted")), quantile)
    found = pooled.agg(F.max("limit")).first()[0]
    typical = per.agg(F.avg("spread")).first()[0]
    if found is None:  # nothing is held: no limit can be set
        return per.select("__language", "__mean", F.lit(None).cast("long").alias("__limit"))
    shared = F.ceil(F.coalesce("spread", F.lit(typical)) * found).cast("long")
    limits = per.join(own.select(F.col("language").alias("__language"), "limit"), "__language", "left")
    return checkpoint(limits.select("__language", "__mean", F.when(F.col("n") >= FEWEST_HELD, F.col("limit")).otherwise(shared).alias("__limit")))


def _rated(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, quantile: float) -> DataFrame:
    """Columns of ``documents`` but the text, and __symbols, __bits, __mean and __limit."""
    ids = checkpoint(trusted_ids(labels, id_col).withColumn("held", F.pmod(F.xxhash64("id"), F.lit(CALIBRATION)) == 0))
    total = documents.agg(F.sum(F.length(text_col))).first()[0] or 0
    tasks = max(documents.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_CHARS))
    told = sized(ids.withColumnRenamed("id", "__id"), BROADCAST_KEYS)
    text = documents.where(F.col(text_col).isNotNull()).select(id_col, text_col).join(told.where("not held"), F.col(id_col) == F.col("__id"), "left_semi").select(text_col)
    tongued = documents.withColumn("__language", F.coalesce(F.col(lang_col).cast("string"), F.lit(""))).coalesce(tasks)
    scored = checkpoint(score(tongued, train(text.coalesce(tasks)), text_col))
    release(documents.sparkSession)
    trusted = scored.where("__symbols > 0").join(told, F.col(id_col) == F.col("__id")).select("__language", "__symbols", "__bits", "held")
    return scored.join(sized(language_limits(trusted, quantile), BROADCAST_LANGUAGES), "__language", "left")


def _accepted() -> Column:
    return F.coalesce(F.ceil(_excess() * STEPS) <= F.col("__limit"), F.lit(True)) | (F.col("__symbols") == 0)


def classify(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """One row per document row: the columns of ``documents`` but the text,
    and perplexity, limit (the perplexity that a text of its language and
    length may have) and accepted.

    Perplexity is that of whole texts, however long.  Texts without characters
    (null, empty) have no perplexity and no limit and are accepted, as is a
    language without trusted text.  A null language is one language; a null id
    has no label; repeated rows each keep their row; an empty table stays empty
    and without labels nothing is rejected.  Columns of ``documents`` named
    like the results are replaced.
    """
    documents = documents.drop("perplexity", "limit", "accepted")
    symbols = F.when(F.col("__symbols") > 0, F.col("__symbols"))
    return (
        _rated(documents, labels, id_col, text_col, lang_col, quantile)
        .withColumn("perplexity", F.pow(F.lit(2.0), F.col("__bits") / symbols))
        .withColumn("limit", F.pow(F.lit(2.0), F.col("__mean") + F.col("__limit") / STEPS / F.sqrt(symbols)))
        .withColumn("accepted", _accepted())
        .select(*(c for c in documents.columns if c != text_col), "perplexity", "limit", "accepted")
    )


def accepted_documents(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """The documents that ``classify`` accepts, with their texts; odd rows as there."""
    keys = {"__did": safe_id(id_col), **{f"__{k}": c for k, c in text_keys(F.col(text_col)).items()}, "__lang": F.coalesce(F.col(lang_col).cast("string"), F.lit(""))}
    slim = documents.select(F.col(id_col), F.col(text_col), F.col(lang_col), *(c.alias(k) for k, c in keys.items()))
    rejected = checkpoint(_rated(slim, labels, id_col, text_col, lang_col, quantile).where(~_accepted()).select(*keys).distinct())
    return documents.withColumns(keys).join(sized(rejected, BROADCAST_KEYS), list(keys), "left_anti").select(*documents.columns)
