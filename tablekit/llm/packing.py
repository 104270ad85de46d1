"""Operator 8, best-fit packing after Martello-Toth dominance reduction."""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORDS_BYTES, chunks, narrow, utf8, written
from .tokens import hub_coder

Pattern = tuple[tuple[int, int], ...]  # (length, how many of it in a sequence)
#: Pieces of one length that are numbered together; there are as many parts as the most frequent length needs.
NUMBERED = 200_000


@dataclass
class Instance:
    """How many pieces there are of each length; lengths are at most the capacity, so this is of a fixed size."""

    left: dict[int, int]
    capacity: int

    def __post_init__(self) -> None:
        self.left = {v: n for v, n in self.left.items() if n}
        self.sizes = sorted(self.left)

    def take(self, pattern: Pattern, times: int) -> None:
        for v, c in pattern:
            self.left[v] -= c * times
            if not self.left[v]:
                del self.left[v]
                self.sizes.remove(v)

    def times(self, pattern: Pattern) -> int:
        return min(self.left[v] // c for v, c in pattern)

    def largest(self, most: int, used: dict[int, int]) -> int | None:
        """The largest length of at most ``most`` of which more is left than ``used``."""
        for k in range(bisect.bisect_right(self.sizes, most) - 1, -1, -1):
            if self.left[self.sizes[k]] > used.get(self.sizes[k], 0):
                return self.sizes[k]
        return None

    def smallest(self, count: int, used: dict[int, int]) -> list[int]:
        out: list[int] = []
        for v in self.sizes:
            out += [v] * min(count - len(out), self.left[v] - used.get(v, 0))
            if len(out) == count:
                break
        return out


def pattern_of(*lengths: int) -> Pattern:
    return tuple((v, lengths.count(v)) for v in sorted(set(lengths), reverse=True))


def best_pair(inst: Instance, room: int, used: dict[int, int]) -> tuple[int, int]:
    """The two pieces of the largest sum that fit into ``room``; (0, 0) if none do."""
    best = (0, 0)
    for a in inst.sizes:
        if 2 * a > room or inst.left[a] <= used.get(a, 0):
            continue
        b = inst.largest(room - a, used | {a: used.get(a, 0) + 1})
        if b and b >= a and a + b > sum(best):
            best = (a, b)
    return best


def dominating(inst: Instance, v: int) -> Pattern | None:
    """A set with a piece of length ``v`` that dominates all other sets with it (Martello and Toth), or None.

    Alone, if no other fits. With its largest partner, if that fills the sequence, if only one more can fit at all, or
    if at most two can and no two make more than that partner does.
    """
    room, used = inst.capacity - v, {v: 1}
    few = inst.smallest(3, used)
    fit = sum(s <= room for s in np.cumsum(few)) if few else 0
    if not fit:
        return pattern_of(v)
    partner = inst.largest(room, used)
    if fit == 1 or partner == room:
        return pattern_of(v, partner)
    if fit == 2 and partner >= sum(best_pair(inst, room, used)):
        return pattern_of(v, partner)
    return None


def reduce(inst: Instance) -> list[tuple[Pattern, int]]:
    """Fixes dominating sets, largest pieces first, until none is left to fix; each with how often it is used."""
    fixed: list[tuple[Pattern, int]] = []
    again = True
    while again:
        again = False
        for v in sorted(inst.left, reverse=True):
            while v in inst.left and (p := dominating(inst, v)):
                times = inst.times(p)
                if any(c > 1 for _, c in p) or len(p) == 1:
                    times = max(1, times)
                inst.take(p, times)
                fixed.append((p, times))
                again = True
    return fixed


def best_fit(inst: Instance) -> list[tuple[Pattern, int]]:
    """Best fit, largest pieces first, on all sequences of equal room at once."""
    rooms: dict[int, dict[Pattern, int]] = defaultdict(lambda: defaultdict(int))
    keys: list[int] = []

    def put(room: int, p: Pattern, n: int) -> None:
        if n:
            if not rooms[room]:
                bisect.insort(keys, room)
            rooms[room][p] += n

    for v in sorted(inst.left, reverse=True):
        n = inst.left[v]
        while n:
            k = bisect.bisect_left(keys, v)
            if k < len(keys):
                room = keys[k]
                p, bins = next(iter(rooms[room].items()))
            else:
                room, p, bins = inst.capacity, (), n
            each = room // v
            full = min(bins, n // each)
            rest = n - full * each if full < bins else 0
            used = full + (rest > 0)
            if p:
                rooms[room][p] -= used
                if not rooms[room][p]:
                    del rooms[room][p]
                if not rooms[room]:
                    keys.remove(room)
            put(room - each * v, (*p, (v, each)), full)
            put(room - rest * v, (*p, (v, rest)), int(rest > 0))
            n -= full * each + rest
    return [(p, n) for group in rooms.values() for p, n in group.items()]


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first number, sequence, offset, pieces of it in a sequence), sorted: where the pieces of a length go.

    The pieces of a length are numbered from 0; those from a row's first number to the next row's go, so many to a
    sequence, into consecutive sequences from the row's, at its offset and after.
    """
    inst = Instance(dict(histogram), capacity)
    patterns = reduce(inst) + best_fit(inst)
    rows, given, sequence = [], defaultdict(int), 0
    for p, times in patterns:
        offset = 0
        for v, c in p:
            rows.append((v, given[v], sequence, offset, c))
            given[v] += c * times
            offset += v * c
        sequence += times
    assert given == histogram or dict(given) == {v: n for v, n in histogram.items() if n}
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut(length: int, capacity: int) -> list[int]:
    """Where the pieces of a document begin; a document that is too long has its shorter piece first."""
    return [0, *range(length % capacity or capacity, length, capacity)] if length > capacity else [0]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces; no shuffle."""
    src = narrow(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = hub_coder(tokenizer)
        for part in chunks(batches, 1, WORDS_BYTES):
            data, offsets = utf8(part.column(1))
            ids, counts = coder.ids(data, offsets)
            ends = np.cumsum(counts)
            raw = memoryview(np.insert(ids, ends, np.uint32(end_id)).astype("<u4").tobytes())
            at, row, piece, start, length, crc = 0, [], [], [], [], []
            for i, n in enumerate((counts + 1).tolist()):
                begins = cut(n, capacity)
                for k, (a, b) in enumerate(zip(begins, [*begins[1:], n])):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw[4 * (at + a) : 4 * (at + b)]))
                at += n
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Packs all documents (doc_id, text) into sequences of at most ``capacity`` ids.

    Documents are encoded once, without a shuffle, and their pieces written. Only how many pieces have each length (at
    most ``capacity`` numbers) reaches the driver, where sets that dominate all others are fixed and the rest is packed
    by best fit; the plan has a few rows for each length and goes to the tasks. Pieces of a length are interchangeable:
    they are numbered in parts of about NUMBERED, so that a length that a third of all pieces has is spread, and take the
    plan's places by number.

    A null or empty text is the end id alone; null doc_ids stay, of whatever type; repeated rows are packed each; a long text
    is cut into pieces; an empty table gives an empty result; further columns, whatever their names, are ignored.
    """
    table = written(spark, pieces(docs, tokenizer, end_id, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places, slots = plan(histogram, capacity), max(16, -(-max(histogram.values(), default=0) // NUMBERED))
    slotted = table.withColumn("slot", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(slots)))
    counts = slotted.groupBy("length", "slot").count()
    before = counts.select("length", "slot", (F.sum("count").over(Window.partitionBy("length").orderBy("slot")) - F.col("count")).alias("before"))
    within = Window.partitionBy("length", "slot").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = slotted.withColumn("number", F.row_number().over(within) - 1).join(before, ["length", "slot"]).withColumn("number", F.col("number") + F.col("before")).select(*table.columns, "number")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (places[:, 0] << 44) + places[:, 1]
        for batch in batches:
            length, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = places[np.searchsorted(keys, (length.astype(np.int64) << 44) + number, "right") - 1]
            k = number - row[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 2] + k // row[:, 4]), pa.array(row[:, 3] + k % row[:, 4] * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return numbered.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")
