"""Files of a folder as a stream: each is processed once, across restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import EngineError
from ..schema import Meta
from ..sources import text


Batch = Callable[[DataFrame, int], None]


def stream(spark: SparkSession, directory: str, meta: Meta, kind: str, files_per_batch: int = 1000) -> DataFrame:
    """A streaming DataFrame over the Parquet, JSON lines, TSV or CSV files of a folder, described by ``meta``."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    match kind:
        case "parquet":
            return reader.schema(meta.spark).parquet(directory)
        case "jsonl":
            return reader.schema(meta.spark).json(directory)
        case "tsv" | "csv":
            d = text.Dialect.of(f"x.{kind}", meta)
            lines = reader.text(directory)
            lines = text.without_heads(lines) if d.header else lines
            return text._typed(lines.filter(F.col("value") != "").select(text.cells_of(F.col("value"), d).alias("cells")), meta.names, meta)
    raise EngineError("INVALID_OPERATION", f"{kind} cannot be streamed")


def drain(frame: DataFrame, checkpoint: str, batch: Batch) -> StreamingQuery:
    """Processes what has arrived since the last call and stops; ``checkpoint`` remembers it. ``batch`` gets each part
    with its number, and the same part again if it failed, so it should overwrite by number."""
    query = frame.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_to(spark: SparkSession, target: str) -> Batch:
    """A batch function that writes each part as a folder of its own below ``target``."""
    return lambda rows, number: rows.write.mode("overwrite").parquet(f"{target}/batch={number}")



