"""Operator 5, byte-level BPE: a global shuffle of distinct words encodes each once."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS_BYTES, chunks, narrow, strings, utf8
from .tokens import CACHED_WORDS, PATTERN, gathered, ranks, words

#: Bytes of text whose words are gathered into one dictionary before they are dealt out.
DICTIONARY_BYTES = 8 << 20
#: Pre-tokens that are put together at a time.
ASSEMBLED = 500_000


def to_varint(values: np.ndarray) -> np.ndarray:
    """Seven bits a byte, the lowest first, the high bit set on all but the last byte."""
    v = values.astype(np.uint64)
    size = 1 + sum((v >= np.uint64(1 << (7 * k))).astype(np.int64) for k in range(1, 5))
    first = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(5):
        at = np.flatnonzero(size > k)
        out[first[at] + k] = (v[at] >> np.uint64(7 * k)).astype(np.uint8) & 127 | ((size[at] > k + 1).astype(np.uint8) << 7)
    return out


def from_varint(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])[: len(last)]
    out = np.zeros(len(last), np.int64)
    for k in range(int((last - first).max(initial=-1)) + 1):
        at = np.flatnonzero(first + k <= last)
        out[at] |= (raw[first[at] + k].astype(np.int64) & 127) << (7 * k)
    return out


def packed(*parts: np.ndarray) -> bytes:
    """Byte arrays, with their lengths, as one zstandard frame."""
    raw = [np.ascontiguousarray(p).view(np.uint8) for p in parts]
    head = np.array([len(r) for r in raw], "<u4")
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head.tobytes(), *[r.tobytes() for r in raw]]))


def unpacked(frame: bytes, parts: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), np.uint8)
    ends = 4 * parts + np.cumsum(raw[: 4 * parts].view("<u4").astype(np.int64))
    return [raw[a:b] for a, b in zip([4 * parts, *ends[:-1]], ends)]


@functools.cache
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@functools.cache
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes, where each token's begin, and how many it has."""
    found = ranks(path)
    table = [b""] * (max(found.values()) + 1)
    for token, i in found.items():
        table[i] = token
    lengths = np.array([len(t) for t in table])
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(lengths) - lengths, lengths


class _Dictionary:
    """The distinct words of consecutive documents, and which word stands at each place."""

    def __init__(self) -> None:
        self.local: dict[bytes, int] = {}
        self.index: list[np.ndarray] = []
        self.docs: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        distinct, index, counts = words(data, offsets)
        local = self.local
        own = np.array([local.setdefault(w, len(local)) for w in distinct.to_pylist()], np.int32)
        self.index.append(own[index])
        self.docs.append(ids)
        self.counts.append(counts)
        self.bytes += len(data)

    def ranked(self) -> tuple[list[bytes], np.ndarray]:
        """The words, the most frequent first, and the number of the word at each place: small numbers take few bytes."""
        listed, index = [*self.local], np.concatenate(self.index)
        order = np.argsort(-np.bincount(index, minlength=len(listed)), kind="stable")
        rank = np.empty(len(listed), np.int32)
        rank[order] = np.arange(len(listed))
        return [listed[i] for i in order], rank[index]


def dictionaries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Dictionary]]:
    """The dictionaries of a task's documents (doc_id, text), with numbers that are the same whenever the task is run."""
    number, held = TaskContext.get().partitionId() << 32, _Dictionary()
    for part in chunks(batches, 1, WORDS_BYTES):
        held.add(part.column(0), *utf8(part.column(1)))
        if held.bytes >= DICTIONARY_BYTES:
            yield number, held
            number, held = number + 1, _Dictionary()
    if held.docs:
        yield number, held


def by_bucket(listed: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of words by bucket, and where each bucket's begin and end in it."""
    bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in listed), np.int64, len(listed))
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def bytes_of(listed: list[bytes]) -> list[np.ndarray]:
    return [to_varint(np.fromiter(map(len, listed), np.int64, len(listed))), np.frombuffer(b"".join(listed), np.uint8)]


def encode(docs: DataFrame, path: str, pattern: str, buckets: int | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian 32-bit integers) of each row (doc_id, text), as tiktoken encodes it.

    The distinct words of each DICTIONARY_BYTES of text are dealt by word to ``buckets`` (by default the number of shuffle
    partitions), so a word as frequent as may be is one entry for each dictionary; there each distinct word is encoded once,
    as long as the worker's CACHED_WORDS hold it. Its ids go back to the dictionary, and meet there the documents,
    which are packets of word numbers by place: these travel once, the words alone there and back, all compressed. Both
    passes over the documents make the same dictionaries; ids that do not come back, as a table changed
    between them, are encoded where they are needed.

    A null or empty text has no ids; null doc_ids stay; doc_id must be a whole number, or text of one; repeated rows are
    encoded each; a very long text is one packet; an empty table gives an empty result; further columns, whatever their
    names, are ignored. Special tokens in a text are ordinary text. ``pattern`` must be the one that tokens.py splits by.
    """
    if pattern != PATTERN:
        raise ValueError("texts are split by tokens.PATTERN alone")
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = narrow(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, d in dictionaries(batches):
            listed, _ = d.ranked()
            order, cuts = by_bucket(listed, buckets)
            found = np.flatnonzero(np.diff(cuts))
            payload = [packed(*bytes_of([listed[i] for i in order[cuts[b] : cuts[b + 1]]])) for b in found]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([number] * len(found), pa.int64()), pa.array(payload, pa.binary())], ["bucket", "chunk", "payload"])

    def encoder() -> Callable[[list[bytes]], list[bytes]]:
        one, known, older = encoding(path, pattern).encode_ordinary, {}, {}

        def run(listed: list[bytes]) -> list[bytes]:
            nonlocal known, older
            if len(known) + len(listed) > CACHED_WORDS // 2:
                known, older = {}, known
            out = []
            for w in listed:
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = older.get(w) or np.array(one(w.decode()), "<u4").tobytes()
                out.append(ids)
            return out

        return run

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder()
        for batch in batches:
            out = []
            for frame in batch.column(2).to_pylist():
                lengths, raw = unpacked(frame, 2)
                found = run(strings(raw, from_varint(lengths)).to_pylist())
                out.append(packed(np.array([xxhash.xxh3_64_intdigest(raw.tobytes())], "<u8"), to_varint(np.fromiter(map(len, found), np.int64, len(found)) // 4), to_varint(np.frombuffer(b"".join(found), "<u4"))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["bucket", "chunk", "payload"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, d in dictionaries(batches):
            ids, (listed, index) = pa.concat_arrays(d.docs), d.ranked()
            frame = packed(ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), ids.fill_null(0).to_numpy().astype("<i8"), to_varint(np.concatenate(d.counts)), *bytes_of(listed), to_varint(index))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([frame], pa.binary())], ["chunk", "packet"])

    def assemble(coded: pa.Table, packets: pa.Table) -> pa.Table:
        parts = [_assembled(p, dict(zip(coded.column("bucket").to_pylist(), coded.column("payload").to_pylist())), buckets, encoder()) for p in packets.column("packet").to_pylist()]
        return pa.concat_tables([p for p in parts] or [pa.table({"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "ids": pa.array([], pa.binary())})])

    dealt = src.mapInArrow(distinct_words, "bucket int, chunk bigint, payload binary").repartition(buckets, "bucket")
    back = dealt.mapInArrow(encode_words, "bucket int, chunk bigint, payload binary")
    whole = src.mapInArrow(documents, "chunk bigint, packet binary")
    return back.groupBy("chunk").cogroup(whole.groupBy("chunk")).applyInArrow(assemble, "doc_id bigint, n_tokens bigint, ids binary")


def _assembled(frame: bytes, coded: dict[int, bytes], buckets: int, encode_words: Callable[[list[bytes]], list[bytes]]) -> pa.Table:
    """doc_id, n_tokens and ids of a packet's documents, from the ids of its words by bucket."""
    null, ids, counts, word_lengths, raw, index = unpacked(frame, 6)
    doc_ids, counts, word = pa.array(ids.view("<i8"), mask=null.astype(bool)), from_varint(counts), from_varint(index)
    listed = strings(raw, from_varint(word_lengths)).to_pylist()
    order, cuts = by_bucket(listed, buckets)
    lengths, flat = [], []
    for b in np.flatnonzero(np.diff(cuts)):
        own = [listed[i] for i in order[cuts[b] : cuts[b + 1]]]
        check, size, found = unpacked(coded[b], 3) if b in coded else (np.zeros(8, np.uint8), None, None)
        if size is not None and int(check.view("<u8")[0]) == xxhash.xxh3_64_intdigest(b"".join(own)):
            lengths.append(from_varint(size))
            flat.append(from_varint(found).astype("<u4"))
        else:
            found = encode_words(own)
            lengths.append(np.array([len(x) // 4 for x in found], np.int64))
            flat.append(np.frombuffer(b"".join(found), "<u4"))
    length = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    flat = np.concatenate(flat) if flat else np.zeros(0, "<u4")
    rank = np.empty(len(listed), np.int64)
    rank[order] = np.arange(len(listed))
    word, first, ends = rank[word], np.cumsum(length) - length, np.cumsum(counts)
    out, n_tokens = [], []
    group = ends // ASSEMBLED
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(counts)]
    for a, b in zip(edges, edges[1:]):
        if b == a:
            continue
        own = word[ends[a] - counts[a] : ends[b - 1]]
        ids, each = gathered(flat, first, length, own)
        total = np.concatenate([[0], np.cumsum(each)])
        last = ends[a:b] - (ends[a] - counts[a])
        tokens = total[last] - total[last - counts[a:b]]
        n_tokens.append(tokens)
        out.append(strings(ids.astype("<u4").view(np.uint8), tokens * 4).cast(pa.binary()))
    return pa.table({"doc_id": doc_ids, "n_tokens": pa.array(np.concatenate(n_tokens).astype(np.int64)), "ids": pa.chunked_array(out).combine_chunks()})


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with the bytes that the ids stand for, by the token-byte table; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 2):
            raw, offsets = utf8(part.column(2))
            data, each = gathered(*token_bytes(path), np.frombuffer(raw.tobytes(), "<u4").astype(np.int64))
            total = np.concatenate([[0], np.cumsum(each)])[offsets // 4]
            yield pa.RecordBatch.from_arrays([*part.columns, strings(data, np.diff(total)).cast(pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")
