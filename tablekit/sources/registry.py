"""Formats by suffix, and how each is opened and written."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..plans.parser import parse
from ..schema import Meta
from ..types import ColumnType
from . import jsonl, text, union
from .paths import FileFilter, delete, exists, first_file, first_line, footer, read_text, write_text

NATIVE = ".tkt"
SUFFIXES = [(NATIVE, "native"), (".parquet", "parquet"), (".union", "union"), (".jsonl", "jsonl"), (".ndjson", "jsonl"), (".csv", "csv"), (".tsv", "tsv"), (".tbl", "tsv")]


@dataclass(frozen=True)
class Plugin:
    """A further format: which paths it reads, how, and how it writes; the highest priority that supports a path wins."""

    name: str
    supports: Callable[[str], bool]
    open: Callable[[SparkSession, str, Meta | None], DataFrame]
    create: Callable[[DataFrame, str, Meta], None] | None = None
    priority: int = 0


PLUGINS: list[Plugin] = []


def register(plugin: Plugin) -> None:
    PLUGINS.append(plugin)
    PLUGINS.sort(key=lambda p: -p.priority)


def plugin_for(path: str) -> Plugin | None:
    return next((p for p in PLUGINS if p.supports(path)), None)


def format_of(path: str, default: str | None = None) -> str:
    """native, parquet, union, jsonl, csv, tsv or jdbc; a bare .gz or .zip takes ``default`` or is tsv."""
    if path.startswith("jdbc:"):
        return "jdbc"
    low = re.sub(r"(\.(gz|zip|bz2|zst|snappy))(#.*)?$", lambda m: "." + m[3].rpartition(".")[2] if m[3] else "", path.lower().rstrip("/"))
    for suffix, name in SUFFIXES:
        if low.endswith(suffix):
            return name
    if low != path.lower():
        return default or "tsv"
    raise EngineError("INVALID_DATA_TYPE", f"no format for {path}")


def sidecar(path: str) -> str:
    return path.rstrip("/").partition("#")[0] + ".desc"


def described(spark: SparkSession, path: str) -> Meta | None:
    """The description beside a file, if there is one."""
    return parse(read_text(spark, sidecar(path))).meta if exists(spark, sidecar(path)) else None


def resolve(spark: SparkSession, path: str) -> str:
    """a.tsv opens a.tsv.gz where that is what there is."""
    if re.search(r"\.(tsv|csv|tbl)$", path.lower()) and exists(spark, f"{path}.gz"):
        return f"{path}.gz"
    return path


def likeness(spark: SparkSession, path: str) -> tuple | None:
    """What files that can be read as one have in common: column names, format, schema or description; None for others."""
    path = resolve(spark, path)
    if plugin_for(path) or ".zip" in path.lower() or (kind := format_of(path)) not in ("parquet", "csv", "tsv"):
        return None
    meta = described(spark, path) or (described(spark, path.removesuffix(".gz")) if path.endswith(".gz") else None)
    own = first_file(spark, path, (".parquet",) if kind == "parquet" else ("",))
    if own is None:
        return None
    if kind == "parquet":
        schema = footer(spark, own).getFileMetaData().getSchema()
        names = tuple(f.getName().lower() for f in schema.getFields())
        return (names, kind, schema.toString(), meta.ddl() if meta else "")
    if meta:
        return (tuple(meta.names), kind, "", re.sub(r"TABLE .*", "", meta.ddl(), count=1))
    line = first_line(spark, own)
    if line is None:
        return None
    cells = text.split_line(line.removesuffix("\r"), text.Dialect.of(path))
    return (tuple((c or "").lower() for c in cells), kind, "", "")


def open_alike(spark: SparkSession, paths: list[str], multi_line: bool | None = None) -> DataFrame:
    """Files of equal likeness as one."""
    paths = [resolve(spark, p) for p in paths]
    first, kind = paths[0], format_of(paths[0])
    meta = described(spark, first) or (described(spark, first.removesuffix(".gz")) if first.endswith(".gz") else None)
    df = spark.read.parquet(*paths) if kind == "parquet" else text.read(spark, paths, meta, text.Dialect.of(first, meta), multi_line)
    return _shaped(df, kind, meta)


def _shaped(df: DataFrame, kind: str, meta: Meta | None) -> DataFrame:
    if meta is None:
        return df.toDF(*[c.lower() for c in df.columns])
    if kind != "parquet":
        return df
    return df.select(*[c.type.cast(F.col(f"`{name}`"), df.schema[name].dataType).alias(c.name) for c, name in zip(meta.columns, df.columns)])  # by position


def open_file(spark: SparkSession, path: str, meta: Meta | None = None, keep: FileFilter = lambda f: True, multi_line: bool | None = None) -> DataFrame:
    """The rows of a file or directory of files of any format but native tables."""
    if plugin := plugin_for(path):
        return plugin.open(spark, path, meta or described(spark, path))
    path, kind = resolve(spark, path), format_of(path)
    plain = path.partition("#")[0]
    if not exists(spark, plain):
        raise EngineError("TABLE_NOT_FOUND", path)
    meta = meta or described(spark, path) or (described(spark, path.removesuffix(".gz")) if path.endswith(".gz") else None)
    match kind:
        case "parquet":
            return _shaped(spark.read.parquet(path), kind, meta)
        case "jsonl":
            return jsonl.read(spark, [path], meta)
        case "union":
            return read_union(spark, union.descriptor(spark, path), keep)
        case "csv" | "tsv":
            return _shaped(text.read(spark, [path], meta, text.Dialect.of(path, meta), multi_line), kind, meta)
    raise EngineError("INVALID_OPERATION", f"{path} is not a file")


def read_union(spark: SparkSession, d: union.Descriptor, keep: FileFilter = lambda f: True, ordered: bool = False) -> DataFrame:
    """The files of a union, those alike in one scan."""
    return union.read(spark, d, lambda p: open_file(spark, p), keep, ordered, lambda p: likeness(spark, p), lambda ps: open_alike(spark, ps))


def predicted(df: DataFrame, rows: int) -> Meta:
    """Opt-in types of an all-text file from its first rows: DATE, TIME, INT64, DECIMAL or STRING, the first that fits all."""
    sample = df.limit(rows)
    kinds = [ColumnType.of("DATE"), ColumnType.of("TIME"), ColumnType.of("INT64"), ColumnType.of("DECIMAL", 20, 5)]
    patterns = [r"\d{4}-\d{2}-\d{2}", r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,3})?", r"[+-]?\d{1,18}", r"[+-]?\d*\.?\d+"]
    tests = [F.min(F.coalesce(F.col(f"`{c}`").rlike(f"^(?:{p})?$"), F.lit(True)) & F.lit(True)).alias(f"{k}_{j}") for k, c in enumerate(df.columns) for j, p in enumerate(patterns)]
    filled = [F.max(F.coalesce(F.col(f"`{c}`"), F.lit("")) != "").alias(f"{k}_any") for k, c in enumerate(df.columns)]
    found = sample.agg(*tests, *filled).head().asDict()
    from ..schema import Column

    return Meta("*", [Column(c, next((kinds[j] for j in range(len(kinds)) if found[f"{k}_any"] and found[f"{k}_{j}"]), ColumnType("STRING"))) for k, c in enumerate(df.columns)])


def write_file(spark: SparkSession, df: DataFrame, path: str, meta: Meta | None = None, compression: str | None = None, describe: bool = True) -> None:
    """Writes rows in the path's format; the path must not exist. Text and JSON get a description beside them."""
    if exists(spark, path):
        raise EngineError("INVALID_OPERATION", f"{path} exists")
    meta = meta or Meta.from_spark(path.rstrip("/").rsplit("/", 1)[-1], df.schema)
    if (plugin := plugin_for(path)) and plugin.create:
        plugin.create(df, path, meta)
        return
    kind = format_of(path)
    compression = compression or ("gzip" if path.lower().endswith(".gz") else None)
    match kind:
        case "parquet":
            df.write.option("compression", compression or "zstd").parquet(path)
            return
        case "jsonl":
            jsonl.write(df, path, compression)
        case "csv" | "tsv":
            text.write(df, path, text.Dialect.of(path, meta), compression)
        case _:
            raise EngineError("INVALID_OPERATION", f"{kind} cannot be written")
    if describe:
        write_text(spark, sidecar(path), meta.ddl())


def drop_file(spark: SparkSession, path: str) -> bool:
    gone = delete(spark, path)
    for p in (sidecar(path), f"{path}.crc"):
        delete(spark, p)
    return gone
