"""Sharding by a k-d tree over metadata with weighted medians.

Every node with more than one leaf is split along its widest dimension (range
against the range of the whole table) where the bytes to the left match the
leaves to the left.  While a node has more rows than a task takes, its median
comes from histograms that narrow around the target; only they reach the
driver.  Smaller nodes are split to their leaves by one task each, over their
sorted metadata.  A hash below each coordinate splits rows of equal metadata,
and the place of a row below that splits rows that are repeated.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpoint, indexed, safe_id, sized, text_keys

#: Histogram rows that reach the driver at a time, and bins of one node at least and at most.
HISTOGRAM_ROWS, FEWEST_BINS, MOST_BINS = 1 << 18, 64, 8_192
#: Nodes that the driver splits at most; a node of fewer than TASK_ROWS rows is left to a task.
NODES, TASK_ROWS = 1 << 13, 1 << 15
#: A median is near enough if the leaf sizes it decides are off by this share at most.
TOLERANCE = 0.001
#: Trees of nodes with at most so many leaves together (20 bytes each) are broadcast.
BROADCAST_LEAVES = 1 << 20
COORDINATES = 2**31


def named(value: Column) -> Column:
    """Coordinate of a category: 31 bits of its hash; null is 0."""
    return F.coalesce(F.shiftrightunsigned(F.xxhash64(value), 33), F.lit(0)) * F.when(value.isNull(), 0).otherwise(1)


def number(value: Column, most: int = COORDINATES - 1) -> Column:
    """Coordinate of a count from 0 to ``most``; null is 0.

    Up to 2**31 - 1, more than the characters of any text, a count is its own
    coordinate; with a larger ``most``, neighbouring counts share one.  A count
    beyond ``most`` is an error.
    """
    step = most // COORDINATES + 1
    whole = F.greatest(value.cast("long"), F.lit(0))
    coordinate = whole if step == 1 else (whole - F.pmod(whole, F.lit(step))) / step
    return F.coalesce(F.when(value.cast("long") > most, F.raise_error(F.lit("a count is beyond its bound"))).otherwise(coordinate), F.lit(0)).cast("long")


def document_dimensions() -> dict[str, Column]:
    return {"lang": named(F.col("lang")), "source": named(F.col("source")), "n_chars": number(F.col("n_chars"))}


def byte_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _with_keys(documents: DataFrame, dimensions: Mapping[str, Column], id_col: str, text_col: str) -> DataFrame:
    """Adds __size and __keys: each coordinate above 20 bits of a hash of id and text and 12 bits of the row's place."""
    tie = F.shiftrightunsigned(F.xxhash64(safe_id(id_col), *text_keys(F.col(text_col)).values()), 44) * 4096 + F.pmod(F.xxhash64(F.col("__place")), F.lit(4096))
    keys = F.array(*(c.cast("long") * F.lit(2**32) + F.col("__tie") for c in dimensions.values()))
    return documents.withColumn("__place", F.monotonically_increasing_id()).withColumn("__tie", tie).withColumns({"__size": byte_size(F.col(text_col)), "__keys": keys}).drop("__place", "__tie")


class Tree:
    """Nodes in arrays: dimension (-1: not split), cut (greatest key on the left), left child (right is next), first leaf and leaves."""

    def __init__(self, first: int, leaves: int) -> None:
        self.dim, self.cut, self.left, self.first, self.leaves, self.depth = [-1], [0], [-1], [first], [leaves], [0]

    def split(self, node: int, dim: int, cut: int) -> tuple[int, int]:
        n = self.leaves[node]
        left = len(self.dim)
        self.dim[node], self.cut[node], self.left[node] = dim, cut, left
        for first, leaves in ((self.first[node], n // 2), (self.first[node] + n // 2, n - n // 2)):
            for column, value in ((self.dim, -1), (self.cut, 0), (self.left, -1), (self.first, first), (self.leaves, leaves), (self.depth, self.depth[node] + 1)):
                column.append(value)
        return left, left + 1


def _constant(values: list[int]) -> Column:
    """An array that is one literal to the plan, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _walk(dim: Column, cut: Column, left: Column, depth: int | Column) -> Column:
    """The node that a row with __keys ends in."""

    def step(at: Column, _: Column) -> Column:
        d = F.get(dim, at)
        right = (F.get("__keys", d.cast("int")) > F.get(cut, at)).cast("long")
        return F.when(d < 0, at).otherwise(F.get(left, at) + right).cast("int")

    return F.aggregate(F.sequence(F.lit(0), F.lit(depth) if isinstance(depth, int) else depth), F.lit(0), step)


def _at_node(rows: DataFrame, tree: Tree) -> DataFrame:
    return rows.withColumn("__node", _walk(_constant(tree.dim), _constant(tree.cut), _constant(tree.left), max(tree.depth)))


def _medians(rows: DataFrame, wanted: dict[int, tuple]) -> dict[int, int]:
    """wanted: node -> (dimension, least key, greatest key, bytes wanted left, tolerance); node -> cut."""
    cuts: dict[int, int] = {}
    open_ = {node: (d, lo, hi, left, 0, slack) for node, (d, lo, hi, left, slack) in wanted.items()}
    while open_:
        count = min(max(HISTOGRAM_ROWS // len(open_), FEWEST_BINS), MOST_BINS)
        size = max(open_) + 1
        dim, low, high, width = [-1] * size, [0] * size, [-1] * size, [1] * size
        for node, (d, lo, hi, *_) in open_.items():
            dim[node], low[node], high[node], width[node] = d, lo, hi, max(1, -(-(hi - lo + 1) // count))
        at = F.col("__node")
        keyed = rows.where(F.coalesce(F.get(_constant(dim), at), F.lit(-1)) >= 0)
        keyed = keyed.select(at, "__size", F.get("__keys", F.get(_constant(dim), at).cast("int")).alias("key"), F.get(_constant(low), at).alias("lo"), F.get(_constant(high), at).alias("hi"), F.get(_constant(width), at).alias("w"))
        bins = keyed.where("key between lo and hi").groupBy("__node", F.expr("(key - lo) div w").alias("bin")).agg(F.sum("__size").alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi")).toArrow()
        columns = [np.asarray(bins.column(i)) for i in range(5)]
        order = np.lexsort((columns[1], columns[0]))
        nodes, _, weights, lows, highs = (c[order] for c in columns)
        still = {}
        for node, (d, _lo, hi, left, below, slack) in open_.items():
            a, b = np.searchsorted(nodes, [node, node + 1])
            sums = below + np.cumsum(weights[a:b])
            i = int(np.searchsorted(sums, left))
            if i == b - a:
                cuts[node] = hi
                continue
            lo, hi, w = int(lows[a + i]), int(highs[a + i]), int(weights[a + i])
            before = int(sums[i]) - w
            if w <= slack or lo == hi:
                cuts[node] = lo - 1 if left - before <= before + w - left else hi
            else:
                still[node] = (d, lo, hi, left, before, slack)
        open_ = still
    return cuts


def _finish(keys: np.ndarray, sizes: np.ndarray, tree: Tree, whole: list[int]) -> Tree:
    """Splits the one node of ``tree`` to its leaves; ``keys`` has a row for each dimension."""
    open_ = [(0, np.arange(len(sizes)))]
    while open_:
        node, rows = open_.pop()
        n = tree.leaves[node]
        if n < 2 or not len(rows):
            continue
        mine = keys[:, rows]
        d = int(np.argmax((mine.max(axis=1) - mine.min(axis=1)) / np.array(whole, dtype=float)))
        order = rows[np.argsort(mine[d], kind="stable")]
        key, sums = keys[d, order], np.cumsum(sizes[order])
        last = np.flatnonzero(np.append(key[1:] != key[:-1], True))  # the last row of each run of equal keys
        left = int(sums[-1]) * (n // 2) / n
        offsets = np.concatenate(([0], sums[last]))
        i = int(np.argmin(np.abs(offsets - left)))
        cut = int(key[0]) - 1 if i == 0 else int(key[last[i - 1]])
        a, b = tree.split(node, d, cut)
        middle = 0 if i == 0 else int(last[i - 1]) + 1
        open_ += [(a, order[:middle]), (b, order[middle:])]
    return tree


_SUBTREE = "__node int, __dim array<long>, __cut array<long>, __left array<long>, __first array<long>, __depth int"


def build_tree(rows: DataFrame, leaves: int, dims: int, nodes: int | None = None, task_rows: int | None = None) -> tuple[Tree, DataFrame]:
    """The driver's tree over ``rows`` (__size, __keys), and trees below its nodes, by ``__node``.

    The driver holds at most ``nodes`` nodes and HISTOGRAM_ROWS (FEWEST_BINS a
    node) bins; a task the metadata of ``task_rows`` rows or, of a larger
    table, of its share in so many nodes.
    """
    nodes, task_rows = nodes or NODES, task_rows or TASK_ROWS
    tree, whole, small = Tree(0, leaves), [1] * dims, set()
    while True:
        found = _at_node(rows, tree)
        ends = [f(F.element_at("__keys", i + 1)).alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
        stats = found.groupBy("__node").agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("w"), *ends).collect()  # at most ``nodes`` rows
        if len(tree.dim) == 1 and stats:
            whole = [max(1, stats[0][f"hi{i}"] - stats[0][f"lo{i}"]) for i in range(dims)]
        wanted = {}
        for s in stats:
            node, n = s["__node"], tree.leaves[s["__node"]]
            if n < 2:
                continue
            small.add(node)
            if s["n"] > task_rows and len(tree.dim) + 2 * len(wanted) < nodes:
                d = max(range(dims), key=lambda i: ((s[f"hi{i}"] - s[f"lo{i}"]) / whole[i], -i))  # noqa: B023
                wanted[node] = (d, s[f"lo{d}"], s[f"hi{d}"], s["w"] * (n // 2) / n, s["w"] / n * TOLERANCE)
        if not wanted:
            break
        for node, cut in _medians(found, wanted).items():
            tree.split(node, wanted[node][0], cut)
        small = set()
    first, spans = list(tree.first), list(tree.leaves)

    def finish(table: pa.Table) -> pa.Table:
        node = table.column("__node")[0].as_py()
        keys = np.asarray(table.column("__keys").combine_chunks().values).reshape(-1, dims).T
        below = _finish(keys, np.asarray(table.column("__size")), Tree(first[node], spans[node]), whole)
        arrays = [pa.array([x], pa.list_(pa.int64())) for x in (below.dim, below.cut, below.left, below.first)]
        return pa.table([pa.array([node], pa.int32()), *arrays, pa.array([max(below.depth)], pa.int32())], names=["__node", "__dim", "__cut", "__left", "__first", "__depth"])

    mine = found.where(F.get(_constant([int(i in small) for i in range(len(tree.dim))]), F.col("__node")) == 1)
    return tree, checkpoint(mine.groupBy("__node").applyInArrow(finish, _SUBTREE))


def shard(documents: DataFrame, leaves: int | None = None, target_bytes: int | None = None, dimensions: Mapping[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with ``shard`` (0 to leaves - 1), placed row by row.

    ``leaves``, or as many as the bytes of the table need at ``target_bytes``
    each.  ``dimensions`` are coordinates from 0 to 2**31 - 1 (``named``,
    ``number``).  Null metadata has coordinate 0; a null text has 8 bytes, an
    empty one too; ties are split by a hash of id and text, repeated rows by
    their place (into 4,096 parts at most); shards of a table with fewer rows
    than leaves can be empty, and an empty table stays empty.  A column of
    ``documents`` named ``shard`` is replaced.
    """
    documents = documents.drop("shard")
    dimensions = document_dimensions() if dimensions is None else dimensions
    keyed = _with_keys(documents, dimensions, id_col, text_col)
    rows = checkpoint(keyed.select("__size", "__keys"))
    if leaves is None:
        leaves = max(1, -(-(rows.agg(F.sum("__size")).first()[0] or 0) // target_bytes))
    tree, below = build_tree(rows, leaves, len(dimensions))
    placed = _at_node(keyed, tree).join(sized(below, 0, 0 if leaves <= BROADCAST_LEAVES else 1), "__node", "left")
    inner = F.get("__first", _walk(F.col("__dim"), F.col("__cut"), F.col("__left"), F.col("__depth")))
    return placed.withColumn("shard", F.coalesce(inner, F.get(_constant(tree.first), F.col("__node"))).cast("int")).select(*documents.columns, "shard")


def shard_rows(documents: DataFrame, leaves: int | None = None, target_bytes: int | None = None, dimensions: Mapping[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, size, text_crc32, shard and its slot there,
    gapless from 0; odd rows as in ``shard``, a null text has the checksum of an
    empty one."""
    placed = shard(documents, leaves, target_bytes, dimensions, id_col, text_col)
    rows = placed.select(
        F.col(id_col),
        byte_size(F.col(text_col)).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        "shard",
        F.xxhash64(safe_id(id_col), *text_keys(F.col(text_col)).values()).alias("__hash"),
    )
    return indexed(checkpoint(rows), "shard", ["__hash", id_col], "slot").drop("__hash")
