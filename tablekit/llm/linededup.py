"""Operator 3, line dedup: sharded cuckoo filters backed by exact reference counts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import chunks, narrow, positional, utf8, written
from .cuckoo import CuckooFilter
from .words import LOWER, SPACE, line_bounds

#: Frequent keys up to which filters and keys go to every task (16 and about 3 bytes each); beyond, keys are joined.
MOST_BROADCAST = 1_000_000
#: Keys for which a shard is meant.
SHARD_KEYS = 50_000


def line_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, 128-bit keys (two int64) and emptiness of all lines, and each text's first line.

    A line's key is a BLAKE2 hash of the line without [\\x20\\x09-\\x0D] at both ends and with A-Z in lower case.
    """
    starts, ends, first = line_bounds(data, offsets)
    solid = np.append(np.flatnonzero(~SPACE[data]), len(data))
    a = np.maximum(starts, np.minimum(solid[np.searchsorted(solid, starts)], ends))
    k = np.searchsorted(solid, ends) - 1
    b = np.maximum(a, np.where(k >= 0, solid[k] + 1, 0))
    low = memoryview(LOWER[data].tobytes())
    digest = b"".join([hashlib.blake2b(low[i:j], digest_size=16).digest() for i, j in zip(a.tolist(), b.tolist())])
    return starts, ends, np.frombuffer(digest, "<i8").reshape(-1, 2), a == b, first


def as_pairs(keys: np.ndarray) -> np.ndarray:
    """Two int64 columns as one of pairs, which sort and compare as a whole."""
    return np.ascontiguousarray(keys).view([("a", "<i8"), ("b", "<i8")]).ravel()


def _distinct_keys(src: DataFrame) -> DataFrame:
    """(k1, k2, docs): keys of non-empty lines with the number of rows that hold them, summed up within a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 0):
            data, offsets = utf8(part.column(0))
            _, _, keys, empty, first = line_keys(data, offsets)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            order = np.lexsort((doc, keys[:, 1], keys[:, 0]))
            order = order[~empty[order]]
            k, d = keys[order], doc[order]
            new_key = np.append(True, (k[1:] != k[:-1]).any(1))[: len(k)]
            new_pair = new_key | np.append(True, d[1:] != d[:-1])[: len(k)]
            at = np.flatnonzero(new_key)
            counts = np.add.reduceat(new_pair.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k[at, 0]), pa.array(k[at, 1]), pa.array(counts)], ["k1", "k2", "docs"])

    return src.mapInArrow(run, "k1 bigint, k2 bigint, docs bigint")


def _update(shard: tuple, filters: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after its keys have become frequent (up) or stopped being so (down)."""
    up, down = changes.k1[changes.up & ~changes.stays], changes.k1[changes.down]
    old = CuckooFilter.from_bytes(filters["filter"].iloc[0]) if len(filters) else None
    if old is None or not old.fits(len(up)):
        new = CuckooFilter.build(changes.k1[changes.up].to_numpy(np.int64).view(np.uint64))
    else:
        old.delete(down.to_numpy(np.int64).view(np.uint64))
        new = old if old.insert(up.to_numpy(np.int64).view(np.uint64)) else CuckooFilter.build(changes.k1[changes.up].to_numpy(np.int64).view(np.uint64))
    return pd.DataFrame({"shard": [shard[0]], "filter": [new.to_bytes()]})


class LineIndex:
    """How many documents hold each line, and the lines that at least ``threshold`` documents hold.

    ``counts`` (k1, k2, docs) is exact and decides; ``filters`` (shard, filter) are cuckoo filters of the frequent keys,
    which spare most lines the exact lookup. insert() and delete() give a new index and leave the old one as it is, so
    that inserting documents and deleting them again restores every decision. Counting sums up within chunks and map
    tasks before the shuffle, so a line that a third of all documents hold is a few rows for each task.
    """

    def __init__(self, spark: SparkSession, threshold: int = 10, shards: int | None = None, counts: DataFrame | None = None, filters: DataFrame | None = None):
        self.spark, self.threshold, self.shards, self.counts, self.filters = spark, threshold, shards, counts, filters

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Takes back documents that were inserted. Others leave negative counts, which inserting them later settles."""
        return self._changed(docs, -1)

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        delta = _distinct_keys(narrow(docs, "text")).withColumn("docs", F.col("docs") * sign)
        old = self.counts.withColumn("old", F.col("docs")) if self.counts is not None else None
        both = delta.withColumn("old", F.lit(0).cast("bigint"))
        both = both if old is None else old.unionByName(both)
        counts = written(self.spark, both.groupBy("k1", "k2").agg(F.sum("docs").alias("docs"), F.sum("old").alias("old")), "line_counts")
        up, was = F.col("docs") >= self.threshold, F.col("old") >= self.threshold
        frequent = counts.filter(up).count()
        wanted = max(1, frequent // SHARD_KEYS)
        keep = self.filters is not None and self.shards is not None and wanted <= 2 * self.shards  # else the shards are dealt anew
        shards = self.shards if keep or self.filters is None and self.shards else wanted
        changes = counts.filter(up | was).select(F.pmod("k2", F.lit(shards)).alias("shard"), "k1", up.alias("up"), (was & ~up if keep else F.lit(False)).alias("down"), (up & was if keep else F.lit(False)).alias("stays"))
        none = self.spark.range(0).select(F.col("id").alias("shard"), F.lit(b"").alias("filter"))
        filters = (self.filters if keep else none).groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(_update, "shard bigint, filter binary")
        left = counts.filter(F.col("docs") != 0).select("k1", "k2", "docs")
        return LineIndex(self.spark, self.threshold, shards, left, written(self.spark, filters, "line_filters"))

    def frequent(self) -> DataFrame:
        return self.counts.filter(F.col("docs") >= self.threshold).select("k1", "k2")

    def drop_lines(self, docs: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
        """``docs`` with the frequent lines gone from text, and n_lines and n_dropped after its columns.

        A null text is one empty line and comes back as the empty text; empty lines stay; the others are joined by \\n.
        Up to ``most_broadcast`` frequent keys, counted first, the filters and keys go to the tasks and nothing is
        shuffled; beyond, each document's lines are joined with the frequent keys, and documents with what they hold.
        Repeated rows are counted and treated as documents of their own; null doc_ids are no different from others.
        """
        few = self.frequent().limit(most_broadcast + 1).count() <= most_broadcast
        return self._with_broadcast(docs) if few else self._with_join(docs)

    def _with_broadcast(self, docs: DataFrame) -> DataFrame:
        exact = np.sort(as_pairs(self.frequent().toPandas().to_numpy(np.int64).reshape(-1, 2)))
        filters = {r["shard"]: r["filter"] for r in self.filters.collect()}
        shared = self.spark.sparkContext.broadcast((exact, filters))
        shards = self.shards

        def lookup(_: pa.RecordBatch):
            exact_keys, raw = shared.value
            probes = {s: CuckooFilter.from_bytes(f) for s, f in raw.items()}

            def find(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
                hit = np.zeros(len(keys), bool)
                shard = keys[:, 1] % shards
                for s, probe in probes.items():
                    at = np.flatnonzero(shard == s)
                    hit[at] = probe.contains(np.ascontiguousarray(keys[at, 0]).view(np.uint64))
                at = np.flatnonzero(hit)  # what the filters let through is confirmed by the exact keys
                place = np.searchsorted(exact_keys, as_pairs(keys[at]))
                hit[at] = exact_keys[np.minimum(place, len(exact_keys) - 1)] == as_pairs(keys[at]) if len(exact_keys) else False
                return hit

            return find

        return _rewrite(docs, lookup, None)

    def _with_join(self, docs: DataFrame) -> DataFrame:
        """Texts are joined by their MD5 with the frequent lines that they hold, so rows of one id, or of none, are spread."""
        plain = positional(docs)
        text = F.coalesce(plain[docs.columns.index("text")], F.lit(""))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in chunks(batches, 1):
                _, _, keys, empty, first = line_keys(*utf8(part.column(1)))
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[~empty]
                keys = keys[~empty]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1]))], ["_md5", "k1", "k2"])

        lines = plain.select(F.md5(text).alias("_md5"), text.alias("text")).mapInArrow(run, "_md5 string, k1 bigint, k2 bigint")
        held = lines.join(self.frequent(), ["k1", "k2"]).groupBy("_md5").agg(F.collect_set(F.struct("k1", "k2")).alias("_found"))
        joined = plain.join(held, F.md5(text) == held["_md5"], "left").select(*plain.columns, F.col("_found.k1").alias("_k1"), F.col("_found.k2").alias("_k2"))

        def lookup(part: pa.RecordBatch):
            n = part.num_columns
            pairs = [set(zip(a or (), b or ())) for a, b in zip(part.column(n - 2).to_pylist(), part.column(n - 1).to_pylist())]
            return lambda keys, doc: np.array([(a, b) in pairs[d] for (a, b), d in zip(keys.tolist(), doc.tolist())], bool)

        return _rewrite(joined, lookup, docs)


def _rewrite(docs: DataFrame, lookup, like: DataFrame | None) -> DataFrame:
    like = like if like is not None else docs
    text, width = like.columns.index("text"), len(like.columns)
    per_batch = like is not docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = None
        for part in chunks(batches, text):
            data, offsets = utf8(part.column(text))
            starts, ends, keys, empty, first = line_keys(data, offsets)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            find = lookup(part) if find is None or per_batch else find
            gone = find(keys, doc) & ~empty
            dropped = np.bincount(doc[gone], minlength=len(offsets) - 1)
            raw, texts = memoryview(data.tobytes()), []
            for i, n in enumerate(dropped.tolist()):
                lines = range(first[i], first[i + 1])
                texts.append(bytes(raw[offsets[i] : offsets[i + 1]]) if not n else b"\n".join([raw[starts[k] : ends[k]] for k in lines if not gone[k]]))
            new = pa.array(texts, pa.binary()).cast(part.schema.field(text).type)
            columns = [new if i == text else part.column(i) for i in range(width)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(first)), pa.array(dropped.astype(np.int64))], [f"c{i}" for i in range(width + 2)])

    fields = [StructField(f"c{i}", f.dataType, True) for i, f in enumerate(like.schema.fields)]
    out = positional(docs).mapInArrow(run, StructType([*fields, StructField(f"c{width}", LongType()), StructField(f"c{width + 1}", LongType())]))
    return out.toDF(*like.columns, "n_lines", "n_dropped")


def dedup_lines(spark: SparkSession, docs: DataFrame, threshold: int = 10) -> DataFrame:
    """Counts the lines of ``docs`` and drops the frequent ones; see LineIndex."""
    return LineIndex(spark, threshold).insert(docs).drop_lines(docs)
