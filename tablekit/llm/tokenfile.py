"""Operator 7, token-id files: documents in doc_id order, coded in checksummed, independently reset blocks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rangecoder
from .bytebpe import from_varint, to_varint
from .common import WORDS_BYTES, chunks, narrow, new_path, utf8
from .tokens import hub_coder

MAGIC = b"TKID1\0"
#: Ids after which a frame ends with its document; a frame's blocks are coded side by side.
FRAME_IDS = 1024 * rangecoder.BLOCK


def frame(doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """Whole documents: MAGIC, checksum and length of the head, head (null flags, doc_ids, counts), coded ids."""
    null = np.packbits(doc_ids.is_null().to_numpy(zero_copy_only=False))
    head = np.array([len(doc_ids)], "<u4").tobytes() + null.tobytes() + doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes() + to_varint(counts).tobytes()
    return MAGIC + np.array([zlib.crc32(head), len(head)], "<u4").tobytes() + head + rangecoder.encode(ids)


def unframe(raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The doc_ids, counts and ids of a frame; ValueError if it is damaged."""
    check, size = np.frombuffer(raw, "<u4", 2, len(MAGIC))
    head = raw[len(MAGIC) + 8 :][: int(size)]
    if raw[: len(MAGIC)] != MAGIC or zlib.crc32(head) != check:
        raise ValueError("not a frame of token ids, or damaged")
    n = int(np.frombuffer(head, "<u4", 1)[0])
    at = 4 + -(-n // 8)
    null = np.unpackbits(np.frombuffer(head, np.uint8, at - 4, 4))[:n].astype(bool)
    doc_ids = pa.array(np.frombuffer(head, "<i8", n, at), mask=null)
    return doc_ids, from_varint(np.frombuffer(head, np.uint8, -1, at + 8 * n)), rangecoder.decode(raw[len(MAGIC) + 8 + int(size) :])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Writes the ids of all documents (doc_id, text), each with ``end_id`` after it, in ascending doc_id order.

    Rows are dealt out by ranges of doc_id and of a hash of their text, and sorted within them; files and the frames in
    them follow that order, in a Parquet container: (part, frame, n_docs, n_ids, payload). Null doc_ids come first; rows
    of equal doc_id, or without one, are ordered by the hash, so they need not be one range. A null or empty text is the
    end id alone; a long text is one document of a frame; repeated rows are written each; an empty table gives an empty
    file; further columns, whatever their names, are ignored. doc_id must be a whole number, or text of one; the ids of the
    tokenizer must be below 65536.
    """
    src = narrow(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("hash", F.xxhash64("text"))
    ordered = src.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash").drop("hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, k = hub_coder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            nonlocal k
            doc_ids, counts, ids = pa.concat_arrays([h[0] for h in held]), *(np.concatenate([h[j] for h in held]) for j in (1, 2))
            held.clear()
            k += 1
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([k - 1]), pa.array([len(doc_ids)]), pa.array([len(ids)]), pa.array([frame(doc_ids, counts, ids)], pa.binary())], ["part", "frame", "n_docs", "n_ids", "payload"])

        for piece in chunks(batches, 1, WORDS_BYTES):
            ids, counts = coder.ids(*utf8(piece.column(1)))
            held.append((piece.column(0), counts + 1, np.insert(ids, np.cumsum(counts), np.uint32(end_id))))
            if sum(len(h[2]) for h in held) >= FRAME_IDS:
                yield out()
        if held:
            yield out()

    ordered.mapInArrow(run, "part bigint, frame bigint, n_docs bigint, n_ids bigint, payload binary").write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids of a file's documents.

    ids are little-endian 32-bit integers, ids_crc32 their checksum; without ids only numbers leave the decoder. A file
    of no documents gives no rows; null and repeated doc_ids come back as they were; damage raises ValueError.
    """
    frames = spark.read.parquet(path)
    sizes = frames.select("part", "frame", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))  # one row for each written file
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("frame")) - F.col("n_ids")
    first = sizes.withColumn("within", within).join(before, "part").select("part", "frame", (F.col("within") + F.col("before")).alias("first"))

    names = ["part", "frame", "doc_id", "at", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, counts, ids = unframe(batch.column(2)[k].as_py())
                offsets = np.concatenate([[0], np.cumsum(counts)])
                raw = ids.astype("<u4").tobytes()
                group = offsets[1:] // 500_000
                cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(counts)]
                for a, b in zip(cuts, cuts[1:]):
                    own = [raw[4 * i : 4 * j] for i, j in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist())]
                    n, sums = b - a, pa.array([zlib.crc32(x) for x in own], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column(0)[k].as_py())), pa.array(np.full(n, batch.column(1)[k].as_py())), doc_ids.slice(a, n), pa.array(offsets[a:b]), pa.array(counts[a:b]), sums, *[pa.array(own, pa.binary())] * with_ids], names)

    decoded = frames.select("part", "frame", "payload").mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'ids' else 'bigint'}" for n in names))
    return decoded.join(first, ["part", "frame"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), *names[4:])


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """write() into the shared folder, and read() back from there; odd rows as these say."""
    path = new_path(spark, "token_ids")
    write(docs, path, tokenizer, end_id)
    return read(spark, path, with_ids)
