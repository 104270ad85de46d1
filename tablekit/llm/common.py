"""What the operators of this subpackage share: exact column choice, shared scratch tables, bounded text chunks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once, and where distinct words are looked up in a dictionary, which larger
#: chunks spare; longer single texts make a chunk of their own.
CHUNK_BYTES, WORDS_BYTES = 1 << 20, 2 << 20
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not the GNU C library
    _TRIM = None
#: Session settings that operators bound where they have Spark's own values, by what those are: bytes of an Arrow batch, and
#: rows of a Parquet batch in the JVM. Thousands of rows of long texts would be gigabytes.
BOUNDED = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(4 << 20)), "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512")}


def positional(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by place, so that names that differ only by case, or repeat, do not matter; batches
    made from it are bounded, whatever the length of its texts."""
    conf = df.sparkSession.conf
    for key, (usual, bounded) in BOUNDED.items():
        if conf.get(key, usual) == usual:
            conf.set(key, bounded)
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def narrow(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """The columns ``names`` (and ``renamed``: new=old), found by exact name, whatever else the table holds.

    A further column that differs only by case, or that bears a name used inside an operator, does not matter:
    all columns are first renamed by position.
    """
    wanted = {n: n for n in names} | renamed
    places = {new: df.columns.index(old) for new, old in wanted.items()}
    return positional(df).select(*[F.col(f"_c{i}").alias(new) for new, i in places.items()])


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors, from spark.checkpoint.dir; a temporary one in local mode only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tablekit-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/tablekit/{uuid.uuid4().hex}/{name}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: its lineage is cut there, and lost executors cost nothing."""
    path, plain = new_path(spark, name), positional(df)
    plain.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a table that written() made, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose column number ``text`` holds about ``most`` bytes: bounded memory for any batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    release()


def release() -> None:
    """Gives memory that a task no longer needs back to the system, as workers wait for the next task."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """An Arrow array over consecutive pieces of ``data``, without copying."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over uint64 values."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
