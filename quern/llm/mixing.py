"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are dealt into blocks of ``block_rows``.  In the fluid
mix every source is served at the rate of its weight until it runs out; then
the others share its rate by their weights.  Block j of a source is released at
the slot in which the fluid mix begins it and due when the fluid mix has ended
it (floor((j - 1) / w) and ceil(j / w) until the first source runs out).  In
every slot the released block with the earliest deadline goes next, so each
source is always less than one block from its fluid share.

Windows are closed forms of exact fractions, so spans of slots are scheduled
apart from each other: a task starts where the oldest block that is open at its
span was released.  Every block that is pending there is due before the span
begins; therefore it counts, but which source it belongs to changes nothing in
the span, and the task finds exactly what one run over all slots would.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quern.llm.common import BROADCAST_GROUPS, in_arrow, indexed, safe_id, sized, text_keys

BLOCK_ROWS = 8
#: Weights in proportion to the rows of a source to this power.
TEMPERATURE = 0.5
#: Rows, with their texts, that a task sorts at a time.
ROWS_PER_BUCKET = 2_048
#: Slots that a task schedules, if no block is open for longer.
SLOTS_PER_TASK = 1 << 15
#: A schedule of at most so many blocks (16 bytes each) is broadcast; a longer one is joined by shuffle.
BROADCAST_BLOCKS = 1 << 20


class Fluid:
    """The fluid mix of sources with a weight and a number of blocks each.

    At virtual time v a source of weight w and n blocks has had min(n, w * v)
    blocks, and the slot is the sum of that over all sources.
    """

    def __init__(self, weights: list[float | Fraction], blocks: list[int]) -> None:
        if any(not w > 0 for w in weights):
            raise ValueError("weights must be positive")
        exact = [Fraction(w) for w in weights]
        scale = lcm(*(w.denominator for w in exact)) if exact else 1
        self.weights, self.blocks = [int(w * scale) for w in exact], blocks
        by_end = sorted((s for s, n in enumerate(blocks) if n), key=lambda s: Fraction(blocks[s], self.weights[s]))
        self.ends = [Fraction(blocks[s], self.weights[s]) for s in by_end]
        self.gone, self.rate = [0], [sum(self.weights[s] for s in by_end)]
        for s in by_end:
            self.gone.append(self.gone[-1] + blocks[s])
            self.rate.append(self.rate[-1] - self.weights[s])
        self.end_slots = [g + v * r for g, v, r in zip(self.gone, self.ends, self.rate, strict=False)]
        self.slots = sum(blocks)

    def bounds(self, source: int, block: int) -> tuple[int, int]:
        """Release of block ``block`` + 1 and deadline of block ``block`` (from 1)."""
        w = self.weights[source]
        k = bisect_left(self.ends, Fraction(block, w))
        served = block * self.rate[k]
        return self.gone[k] + served // w, self.gone[k] - (-served // w)

    def served(self, slot: int) -> list[Fraction]:
        """Blocks of each source that the fluid mix has served before ``slot``."""
        k = bisect_left(self.end_slots, slot)
        if k == len(self.ends):
            return [Fraction(n) for n in self.blocks]
        v = Fraction(slot - self.gone[k], self.rate[k])
        return [min(Fraction(n), w * v) for w, n in zip(self.weights, self.blocks, strict=True)]

    def on_target(self) -> int:
        """Slots until the first source runs out."""
        return int(self.end_slots[0]) if self.ends else 0

    def longest(self) -> int:
        """No block is open for more slots: rates per source only grow."""
        return max((self.bounds(s, 1)[1] for s, n in enumerate(self.blocks) if n), default=1)


def schedule(fluid: Fluid, first: int, last: int) -> list[tuple[int, int, int]]:
    """(source, block from 0, slot) of the slots from ``first`` to before ``last``."""
    last = min(last, fluid.slots)
    if first >= last:
        return []
    at = fluid.served(first)
    start = min((fluid.bounds(s, int(f))[0] for s, f in enumerate(at) if f.denominator > 1), default=first)
    begun = fluid.served(start) if start < first else at
    open_ = [(fluid.bounds(s, int(f) + 1)[1], s, int(f) + 1) for s, f in enumerate(begun) if f.denominator > 1]
    pending = sum(-int(-f // 1) for f in begun) - start
    ready = sorted(open_)[len(open_) - pending :]
    released: list[list[tuple[int, int, int]]] = [[] for _ in range(last - start)]
    for s, f in enumerate(begun):
        j = -int(-f // 1) + 1
        if j > fluid.blocks[s]:
            continue
        release = fluid.bounds(s, j - 1)[0]
        while release < last:
            following, deadline = fluid.bounds(s, j)
            released[release - start].append((deadline, s, j))
            j, release = j + 1, following
            if j > fluid.blocks[s]:
                break
    out = []
    for slot in range(start, last):
        for block in released[slot - start]:
            heapq.heappush(ready, block)
        _, s, j = heapq.heappop(ready)
        if slot >= first:
            out.append((s, j - 1, slot))
    return out


def source_weights(documents: DataFrame, source_col: str = "source", temperature: float = TEMPERATURE) -> dict:
    """Rows of each source to the power of ``temperature``."""
    return {s: n**temperature for s, n in _counts(documents, source_col).items()}


def _counts(documents: DataFrame, source_col: str) -> dict:
    return {r[0]: r["count"] for r in documents.groupBy(source_col).count().collect()}  # one row a source


def mix(documents: DataFrame, weights: Mapping | None = None, source_col: str = "source", id_col: str = "doc_id", text_col: str | None = "text", block_rows: int = BLOCK_ROWS, slots_per_task: int = SLOTS_PER_TASK, seed: int = 0) -> DataFrame:
    """``documents`` with block, slot, place and on_target.

    ``slot`` (gapless from 0) orders the blocks, ``place`` the rows of a block.
    Every prefix of slots up to the end of the first source holds each source
    to its weight within less than one block; rows up to there have
    ``on_target``.  Later slots hold the sources that are left to their weights
    among each other; no row is dropped or repeated, and the last block of a
    source may be short.  Weights are exact: those given, or of the rows to the
    power of TEMPERATURE.  A null source is a source of its own; a weight
    without rows is ignored, a source without a weight an error; sources may be
    of any type that can be grouped.  Inside a source, order is by a seeded hash
    of id and text (null and empty texts differ), so repeated rows lie side by
    side.  An empty table gives an empty table.  Columns of ``documents`` named
    like the results are replaced.  One row a source reaches the driver and
    each task that schedules.
    """
    documents = documents.drop("block", "slot", "place", "on_target")
    spark = documents.sparkSession
    counts = _counts(documents, source_col)
    weights = {s: n**TEMPERATURE for s, n in counts.items()} if weights is None else weights
    if missing := [s for s in counts if s not in weights]:
        raise ValueError(f"no weight for source {missing[0]}")
    names = sorted(counts, key=lambda s: (s is None, "" if s is None else str(s)))
    fluid = Fluid([weights[s] for s in names], [-(-counts[s] // block_rows) for s in names])
    span = max(slots_per_task, fluid.longest())
    tasks = -(-fluid.slots // span)

    def stage(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for task in part.column(0).to_pylist():
                rows = schedule(fluid, task * span, (task + 1) * span)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2))], names=["__code", "block", "slot"])

    slots = spark.range(0, tasks, 1, max(1, tasks)).transform(in_arrow, stage, "__code int, block long, slot long")
    field = StructField("__source", documents.schema[source_col].dataType)
    named = spark.createDataFrame([(s, i) for i, s in enumerate(names)], StructType([field, StructField("__code", IntegerType())]))
    text = {} if text_col is None else text_keys(F.col(text_col))
    keyed = documents.withColumn("__hash", F.xxhash64(F.lit(seed), safe_id(id_col), *text.values()))
    coded = keyed.join(sized(named, BROADCAST_GROUPS, len(names)), F.col(source_col).eqNullSafe(F.col("__source"))).drop("__source")
    numbered = indexed(coded, "__code", ["__hash"], "__nth", ROWS_PER_BUCKET)
    blocks = numbered.withColumns({"block": F.expr(f"__nth div {block_rows}"), "place": (F.col("__nth") % block_rows).cast("int")})
    slotted = blocks.join(sized(slots, BROADCAST_BLOCKS, fluid.slots), ["__code", "block"])
    return slotted.withColumn("on_target", F.col("slot") < fluid.on_target()).select(*documents.columns, "block", "slot", "place", "on_target")


def mixed_order(documents: DataFrame, **options) -> DataFrame:
    """``documents`` sorted into their mixed order; rows as in ``mix``."""
    return mix(documents, **options).orderBy("slot", "place").select(*documents.columns)
