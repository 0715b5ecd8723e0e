"""Chat formatting: roles of transcript lines by a hidden Markov model.

States are the roles.  A line shows a speaker marker (``User:``, ``<|user|>``,
``### Assistant``), a length class, a closing mark, and whether a break (the
start of a stored turn, or a marker) comes before it.  Emissions and
transitions are counted over all rows whose role is known.  Viterbi gives the
best roles of a whole conversation; a long one is cut into segments whose
max-plus transfer matrices are joined, so no task holds more than a segment.
Then turns are rendered in one canonical form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import NULL_ID, checkpoint, in_arrow

ROLES = ("system", "user", "assistant")
#: Other names of the roles.
NAMES = {"system": ("system", "developer", "instructions"), "user": ("user", "human", "customer", "question", "q"), "assistant": ("assistant", "ai", "bot", "gpt", "model", "answer", "a")}
LENGTH_CLASSES = 16
#: Rows of a conversation that a task holds at a time.
SEGMENT_ROWS = 512
SMOOTHING = 0.5

_ROLE_OF = {name: i for i, role in enumerate(ROLES) for name in NAMES[role]}
_MARKER = re.compile(r"^\s*(?:<\|(?P<a>\w+)\|>|\[(?P<b>\w+)\]\s*:?|#{1,4}\s*(?P<c>\w+)\s*:?\s*$|\**(?P<d>\w+)\**\s*:)\s*", re.ASCII)


def marker_of(line: str) -> tuple[int, str]:
    """(1 + role named by the marker or 0, the line without its marker)."""
    found = _MARKER.match(line)
    name = next((x for x in found.groups() if x), "") if found else ""
    role = _ROLE_OF.get(name.lower())
    return (0, line) if role is None else (role + 1, line[found.end() :])


def line_features(text: str | None) -> list[tuple[int, int, int, int, int]]:
    """(marker, length class, closing class, class of the block's length, break) of each line."""
    lines = (text or "").split("\n")
    whole = min(len(text or "").bit_length(), LENGTH_CLASSES - 1)
    out = []
    for i, line in enumerate(lines):
        marker, rest = marker_of(line)
        bare = rest.rstrip()
        closing = 1 if bare.endswith("?") else 2 if bare.endswith(":") else 0
        starts = int(i == 0 or marker > 0)
        out.append((marker, min(len(bare).bit_length(), LENGTH_CLASSES - 1), closing, whole if i == 0 else 0, starts))
    return out


def role_code(role: Column) -> Column:
    """0, 1, 2 for the roles and their other names, else null."""
    low = F.lower(role)
    return F.coalesce(*(F.when(low.isin(*NAMES[r]), F.lit(i)) for i, r in enumerate(ROLES)))


class Model:
    """Log probabilities of transitions (after a break), starts and features."""

    def __init__(self, counts: dict[tuple[str, int, int], float]) -> None:
        n = len(ROLES)

        def logs(kind: str, size: int) -> np.ndarray:
            table = np.full((n, size), SMOOTHING)
            for (k, a, b), times in counts.items():
                if k == kind:
                    table[a, b] += times
            return np.log(table / table.sum(axis=1, keepdims=True))

        self.step = logs("step", n)
        begin = np.full(n, SMOOTHING)
        for (k, a, _), times in counts.items():
            if k == "begin":
                begin[a] += times
        self.begin = np.log(begin / begin.sum())
        self.length, self.closing, self.whole = logs("length", LENGTH_CLASSES), logs("closing", 3), logs("whole", LENGTH_CLASSES)
        self.hold = np.where(np.eye(n, dtype=bool), 0.0, -np.inf)
        named = np.full((n, n + 1), np.log(0.02 / n))
        named[:, 0] = np.log(0.9)
        named[np.arange(n), np.arange(n) + 1] = np.log(0.08)
        self.marker = named

    def scores(self, features: list[tuple[int, int, int, int, int]]) -> np.ndarray:
        f = np.array(features, dtype=np.int64).reshape(-1, 5)
        out = self.marker[:, f[:, 0]] + self.length[:, f[:, 1]] + self.closing[:, f[:, 2]]
        return (out + np.where(f[:, 4] * f[:, 3] > 0, self.whole[:, f[:, 3]], 0.0)).T

    def transfer(self, features: list) -> np.ndarray:
        """Best log probability from each state before the lines, and last from the
        start of a conversation, to each state after them."""
        out = None
        for score, f in zip(self.scores(features), features, strict=True):
            one = (self.step if f[4] else self.hold) + score
            out = np.vstack((one, self.begin + score)) if out is None else (out[:, :, None] + one[None, :, :]).max(axis=1)
        return out

    def decode(self, features: list, before: np.ndarray, last: int | None = None) -> list[int]:
        """Best states; ``before``: log weights of the state before the first line
        (or, as ``begin``, of the first state); ``last``: the last state if known."""
        scores, back, now = self.scores(features), [], before
        for i, f in enumerate(features):
            if i == 0 and before is self.begin:
                back.append(np.arange(len(ROLES)))
                now = before + scores[0]
                continue
            paths = now[:, None] + (self.step if f[4] else self.hold)
            back.append(paths.argmax(axis=0))
            now = paths.max(axis=0) + scores[i]
        state = int(now.argmax()) if last is None else last
        out = [state]
        for pointers in back[:0:-1]:
            out.append(int(pointers[out[-1]]))
        return out[::-1]


def _features_of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, role, class, count) of the rows of a task."""
    for part in parts:
        counts: dict[tuple[str, int, int], int] = {}
        for role, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            for _, length, closing, whole, starts in line_features(text):
                for key in (("length", role, length), ("closing", role, closing), *((("whole", role, whole),) if starts and whole else ())):
                    counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts]), *(pa.array([k[i] for k in counts], pa.int32()) for i in (1, 2)), pa.array(list(counts.values()), pa.int64())], names=["kind", "role", "class", "n"])


def _ordered(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows with the segment they lie in: spans of turns, cut by a hash where many rows share them."""
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumns({"c": F.coalesce("conv", F.lit(NULL_ID)), "t": F.coalesce("turn", F.lit(-1)), "h": F.shiftrightunsigned(F.xxhash64("text", "role"), 1)})
    span = F.expr(f"t div {SEGMENT_ROWS}")
    rows = rows.withColumn("s", span)
    many = rows.groupBy("c", "s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * SEGMENT_ROWS)
    bits = F.least(F.lit(40), F.ceil(F.log2(F.col("n") / SEGMENT_ROWS)).cast("int"))
    fine = rows.join(many.select("c", "s", bits.alias("bits")), ["c", "s"], "left")
    inner = F.when(F.col("bits").isNull(), F.lit(-1)).otherwise(F.col("t"))
    part = F.when(F.col("bits").isNull(), F.lit(0)).otherwise(F.expr("shiftrightunsigned(h, 63 - bits)"))
    return fine.withColumns({"s2": inner, "s3": part}).drop("bits")


def train(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Model:
    """Counts over all rows whose role is known; a few hundred reach the driver."""
    rows = conversations.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), role_code(F.col(role_col)).alias("r"), F.col(text_col).cast("string").alias("text")).where("r is not null")
    seen = rows.select("r", "text").transform(in_arrow, _features_of, "kind string, role int, class int, n long")
    pairs = rows.groupBy("c", "t").agg(F.min("r").alias("r"))
    after = pairs.select("c", (F.col("t") - 1).alias("t"), F.col("r").alias("next"))
    steps = pairs.join(after, ["c", "t"]).groupBy("r", "next").count().select(F.lit("step").alias("kind"), F.col("r").alias("role"), F.col("next").alias("class"), F.col("count").alias("n"))
    first = rows.groupBy("c").agg(F.min("t").alias("t")).join(pairs, ["c", "t"]).groupBy("r").count()
    begins = first.select(F.lit("begin").alias("kind"), F.col("r").alias("role"), F.lit(0).alias("class"), F.col("count").alias("n"))
    total = seen.unionByName(steps).unionByName(begins).groupBy("kind", "role", "class").agg(F.sum("n").alias("n"))
    return Model({(r["kind"], r["role"], r["class"]): r["n"] for r in total.collect()})


_GROUP = ["c", "s", "s2", "s3"]
_OUT = "conv long, turn long, role string, parsed array<struct<role:string,content:string>>"


def _segments(parts: Iterator[pa.RecordBatch], solve, names: list[str], finish) -> Iterator[pa.RecordBatch]:
    """Gathers the rows of each segment, which arrive sorted, and solves it."""
    at, held = None, []
    for part in parts:
        out = []
        for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if row[:4] != at:
                if held:
                    out += solve(held)
                at, held = row[:4], []
            held.append(row)
        yield finish(out)
    if held:
        yield finish(solve(held))


def _parse(rows: list[tuple], states: list[int], features: list[list]) -> list[tuple]:
    """Turns of each row: runs of lines of one role, markers taken off."""
    out, at = [], 0
    for row, each in zip(rows, features, strict=True):
        turns: list[dict] = []
        for line, f, state in zip((row[7] or "").split("\n"), each, states[at : at + len(each)], strict=True):
            body = marker_of(line)[1] if f[0] else line
            if turns and not (f[0] and turns[-1]["content"]) and turns[-1]["role"] == ROLES[state]:
                turns[-1]["content"] += "\n" + body
            else:
                turns.append({"role": ROLES[state], "content": body})
        at += len(each)
        out.append((row[4], row[5], row[6], [{"role": t["role"], "content": t["content"].strip()} for t in turns]))
    return out


def parse_transcripts(conversations: DataFrame, model: Model | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per row of ``conversations``: conversation, turn, role (as
    given) and parsed, the turns (role, content) that its lines hold.

    Roles come from the lines alone, not from the role column.  Rows without a
    conversation are one conversation; null turns come first; rows of one turn
    follow in the order of a hash of their text; null and empty texts are an
    empty turn; repeated rows each keep their row.
    """
    model = train(conversations, conv_col, turn_col, role_col, text_col) if model is None else model
    rows = _ordered(conversations, conv_col, turn_col, role_col, text_col)
    lone = rows.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n")).groupBy("c").agg(F.count(F.lit(1)).alias("segments"))
    lone = lone.where("segments > 1")
    sent = rows.sparkSession.sparkContext.broadcast(model)
    schema = pa.struct([("role", pa.string()), ("content", pa.string())])
    arrow = [pa.int64(), pa.int64(), pa.string(), pa.list_(schema)]

    def finish(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(arrow)], names=["conv", "turn", "role", "parsed"])

    def whole(held: list[tuple]) -> list[tuple]:
        features = [line_features(r[7]) for r in held]
        return _parse(held, sent.value.decode([f for each in features for f in each], sent.value.begin), features)

    def matrix(held: list[tuple]) -> list[tuple]:
        features = [f for r in held for f in line_features(r[7])]
        return [(*held[0][:4], sent.value.transfer(features).reshape(-1).tolist())]

    def matrices(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in out], pa.int64()) for i in range(4)), pa.array([r[4] for r in out], pa.list_(pa.float64()))], names=[*_GROUP, "m"])

    def ends(held: list[tuple]) -> list[tuple]:
        """The states before and after each segment of a conversation on its best path."""
        n, now, back = len(ROLES), None, []
        for row in held:
            m = np.array(row[4]).reshape(n + 1, n)
            if now is None:
                back.append(np.full(n, n))
                now = m[n]
                continue
            paths = now[:, None] + m[:n]
            back.append(paths.argmax(axis=0))
            now = paths.max(axis=0)
        state, out = int(now.argmax()), []
        for row, pointers in zip(held[::-1], back[::-1], strict=True):
            out.append((*row[:4], int(pointers[state]), state))
            state = int(pointers[state])
        return out

    def between(held: list[tuple]) -> list[tuple]:
        features, model = [line_features(r[7]) for r in held], sent.value
        before = model.begin if held[0][8] == len(ROLES) else np.where(np.arange(len(ROLES)) == held[0][8], 0.0, -np.inf)
        return _parse(held, model.decode([f for each in features for f in each], before, held[0][9]), features)

    columns = [*_GROUP, "conv", "turn", "role", "text"]
    order = [*_GROUP, "t", "h"]

    def by(group_keys: list[str], keep: list[str], df: DataFrame, order: list[str]) -> DataFrame:
        return df.repartition(*group_keys).sortWithinPartitions(*order).select(*keep)

    short = rows.join(lone, "c", "left_anti")
    done = by(_GROUP, columns, short, order).transform(in_arrow, lambda parts: _segments(parts, whole, columns, finish), _OUT)
    if lone.isEmpty():
        return _named(done, conv_col, turn_col, role_col)
    long_ = checkpoint(rows.join(lone, "c", "left_semi"))
    found = by(_GROUP, columns, long_, order).transform(in_arrow, lambda parts: _segments(parts, matrix, columns, matrices), "c long, s long, s2 long, s3 long, m array<double>")

    def chain(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def flat(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(6)], names=[*_GROUP, "before", "after"])

        for part in parts:
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if row[0] != at:
                    if held:
                        yield flat(ends(held))
                    at, held = row[0], []
                held.append(row)
        if held:
            yield flat(ends(held))

    bounds = found.repartition("c").sortWithinPartitions(*_GROUP).transform(in_arrow, chain, "c long, s long, s2 long, s3 long, before long, after long")
    bound = long_.join(checkpoint(bounds), _GROUP)
    rest = by(_GROUP, [*columns, "before", "after"], bound, order).transform(in_arrow, lambda parts: _segments(parts, between, columns, finish), _OUT)
    return _named(done.unionByName(rest), conv_col, turn_col, role_col)


def _named(done: DataFrame, conv_col: str, turn_col: str, role_col: str) -> DataFrame:
    return done.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "parsed")


def rendered(parsed: Column) -> Column:
    """Canonical text of parsed turns."""
    return F.array_join(F.transform(parsed, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["content"], F.lit("\n<|end|>"))), "\n")
