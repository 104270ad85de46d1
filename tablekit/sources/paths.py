"""Listing files through Hadoop's file systems, on the driver."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import SparkSession

FileFilter = Callable[["FileInfo"], bool]


@dataclass(frozen=True)
class FileInfo:
    path: str
    bytes: int
    modified: datetime
    directory: bool

    @property
    def name(self) -> str:
        return self.path.rstrip("/").rsplit("/", 1)[-1]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or (tempfile.gettempdir() if spark.sparkContext.master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir"))
    return f"{base.rstrip('/')}/tablekit-{uuid.uuid4().hex}/{name}"


def file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file by way of a new one beside it, so that a crash leaves no half of it. Where there is one already
    it is replaced: at once on file systems that can, else by way of a moment without it."""
    fs, p = file_system(spark, path)
    jvm = spark.sparkContext._jvm
    new = jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    stream = fs.create(new, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    full = fs.makeQualified(p)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(full.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), full, how)


def names(spark: SparkSession, directory: str) -> list[str]:
    """The names of what stands in a folder; none if there is no such folder."""
    fs, p = file_system(spark, directory)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def first_file(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("",)) -> str | None:
    """A file, or the first data file of a folder."""
    fs, p = file_system(spark, path)
    if not fs.getFileStatus(p).isDirectory():
        return path
    found = [n for n in names(spark, path) if not n.startswith(("_", ".")) and n.endswith(suffixes)]
    return f"{path.rstrip('/')}/{found[0]}" if found else None


def first_line(spark: SparkSession, path: str) -> str | None:
    """A text file's first line, without its end; compressed by suffix or not."""
    fs, p = file_system(spark, path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
    stream = fs.open(p) if codec is None else codec.createInputStream(fs.open(p))
    try:
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()


def footer(spark: SparkSession, path: str):
    """The footer of a Parquet file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf))
    try:
        return reader.getFooter()
    finally:
        reader.close()


def children(spark: SparkSession, directory: str) -> list[FileInfo]:
    fs, p = file_system(spark, directory)
    if not fs.exists(p):
        return []
    return sorted((FileInfo(str(s.getPath().toString()).removeprefix("file:"), s.getLen(), datetime.fromtimestamp(s.getModificationTime() / 1000), s.isDirectory()) for s in fs.listStatus(p)), key=lambda f: f.path)


def walk(spark: SparkSession, directory: str, depth: int = 1) -> list[FileInfo]:
    """Files and table directories down to ``depth`` levels, sorted by path within each directory."""
    out = []
    for f in children(spark, directory):
        if not f.directory or re.search(r"\.\w+$", f.name) and not re.fullmatch(r"[\d.\-]+", f.name):
            out.append(f)
        elif depth > 1:
            out += walk(spark, f.path, depth - 1)
    return out


_DATE = r"(\d{4})[-/]?(\d{2})[-/]?(\d{2})"


def _date(text: str) -> date | None:
    for m in re.finditer(rf"(?<!\d){_DATE}(?!\d)", text):
        try:
            return date(int(m[1]), int(m[2]), int(m[3]))
        except ValueError:
            continue
    return None


def date_in_name(first: date, last: date) -> FileFilter:
    """Files whose name holds a date (yyyy-MM-dd or yyyyMMdd) from ``first`` to ``last``; partition pruning by name."""
    return lambda f: (d := _date(f.name)) is not None and first <= d <= last


def date_in_directory(first: date, last: date) -> FileFilter:
    """Files whose directories hold a date (yyyy/MM/dd, any_yyyy-MM-dd or yyyyMMdd) from ``first`` to ``last``."""
    return lambda f: (d := _date(f.path.rsplit("/", 1)[0])) is not None and first <= d <= last
