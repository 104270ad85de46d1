"""Delimited text in the two dialects and their variations, parsed by JVM expressions line by line."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import Meta
from ..types import to_text

UNESCAPE = {"n": "\n", "t": "\t", "r": "\r"}


@dataclass(frozen=True)
class Dialect:
    delimiter: str = "\t"
    quote: str = ""
    null: str = "\\N"
    header: bool = True

    @classmethod
    def of(cls, path: str, meta: Meta | None = None) -> Dialect:
        """By suffix, then by the options of the table's description."""
        options = meta.options if meta else {}
        csv = options.get("FORMAT", "").lower() == "csv" or re.search(r"\.csv(\.|$|#)", path.lower()) is not None
        delimiter, quote, null = (",", '"', "NULL") if csv else ("\t", "", "\\N")
        return cls(options.get("DELIMITER", delimiter), options.get("QUOTE", quote), options.get("NULL", null), options.get("HEADER", "").upper() not in ("ABSENT", "SKIP"))


def split_line(text: str, d: Dialect) -> list[str | None]:
    """The cells of a record (which may hold line breaks in quotes); null only where the null string is not quoted."""
    if (d.quote or "\\") not in text:
        return [None if c == d.null else c for c in text.split(d.delimiter)]
    cells, cell, k, quoted, was_quoted, escaped = [], [], 0, False, False, False

    def done() -> None:
        nonlocal cell, was_quoted, escaped
        s = "".join(cell)
        raw_null = not was_quoted and not escaped and s == d.null
        cells.append(None if raw_null else s)
        cell, was_quoted, escaped = [], False, False

    while k < len(text):
        c = text[k]
        if quoted:
            if c == d.quote and text[k + 1 : k + 2] == d.quote:
                cell.append(c)
                k += 1
            elif c == d.quote:
                quoted = False
            else:
                cell.append(c)
        elif d.quote and c == d.quote and not cell:
            quoted = was_quoted = True
        elif c == "\\" and not d.quote and k + 1 < len(text):
            if text[k + 1] == "N" and d.null == "\\N" and not cell:
                cell.append("\\N")
            else:
                cell.append(UNESCAPE.get(text[k + 1], text[k + 1]))
                escaped = True
            k += 1
        elif c == d.delimiter:
            done()
        else:
            cell.append(c)
        k += 1
    done()
    return cells


def records(lines: Iterable[str], d: Dialect) -> Iterator[str]:
    """The records of a file's lines: these, joined while a quoted cell goes on."""
    held, odd = [], False
    for line in lines:
        held.append(line)
        odd ^= bool(d.quote) and line.count(d.quote) % 2 == 1
        if not odd:
            if record := "\n".join(held).rstrip("\r"):
                yield record
            held = []
    if held:
        yield "\n".join(held)


def _lines(source: str | BinaryIO) -> Iterator[str]:
    """What splitting at line feeds gives, one line after another; a stream is decoded as it is read."""
    if isinstance(source, str):
        at = 0
        while (end := source.find("\n", at)) >= 0:
            yield source[at:end]
            at = end + 1
        yield source[at:]
        return
    line = ""
    for line in io.TextIOWrapper(source, "utf-8", newline="\n"):
        yield line.removesuffix("\n")
    if not line or line.endswith("\n"):
        yield ""


def cells_of(line: Column, d: Dialect) -> Column:
    """The cells of a line as an array of strings, by JVM expressions alone.

    Lines without a quote or an escape, which are most, are only split.
    """
    q = re.escape(d.delimiter)

    def known(cells: Column) -> Column:
        return F.transform(cells, lambda c: F.when(c != d.null, c))

    if d.quote:
        k = re.escape(d.quote)
        raw = F.regexp_extract_all(F.concat(F.lit(d.delimiter), line), F.lit(f"{q}({k}(?:[^{k}]|{k}{k})*{k}|[^{q}]*)"), F.lit(1))
        full = F.transform(raw, lambda c: F.when(c.startswith(d.quote) & c.endswith(d.quote) & (F.length(c) > 1), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit(d.quote * 2), F.lit(d.quote))).when(c != d.null, c))
        return F.when(line.contains(d.quote), full).otherwise(known(F.split(line, q, -1)))
    whole = F.regexp_extract_all(F.concat(F.lit(d.delimiter), line), F.lit(rf"{q}((?:[^\\{q}]|\\[\s\S]|\\$)*)"), F.lit(1))

    def plain(cell: Column) -> Column:
        """Escapes taken from left to right."""
        one = lambda t: F.when(t.startswith("\\") & (F.length(t) == 2), _unescaped(F.substring(t, 2, 1))).otherwise(t)
        return F.array_join(F.transform(F.regexp_extract_all(cell, F.lit(r"\\[\s\S]|[^\\]+|\\$"), F.lit(0)), one), "")

    full = F.transform(whole, lambda c: F.when(c != d.null, F.when(c.contains("\\"), plain(c)).otherwise(c)))
    simple = F.split(line, q, -1)
    return F.when(line.contains("\\"), full).otherwise(simple if "\\" in d.null else known(simple))


def _unescaped(letter: Column) -> Column:
    out = letter
    for name, char in UNESCAPE.items():
        out = F.when(letter == name, F.lit(char)).otherwise(out)
    return out


def without_heads(lines: DataFrame) -> DataFrame:
    """Lines without the first of each file, found by its place: where a file's first split begins. Arrow batches are
    sliced, no line is touched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column(1)
            new = np.append(path[0].as_py() != before, pc.not_equal(path[1:], path[:-1]).to_numpy(zero_copy_only=False))
            before = path[-1].as_py()
            first = new & (batch.column(2).to_numpy() == 0)
            cuts = [-1, *np.flatnonzero(first).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b - a > 1:
                    yield batch.select([0]).slice(a + 1, b - a - 1)

    return lines.select("value", "_metadata.file_path", "_metadata.file_block_start").mapInArrow(run, "value string")


def read(spark: SparkSession, paths: list[str], meta: Meta | None, d: Dialect, multi_line: bool | None = None) -> DataFrame:
    """Rows of delimited files, typed by ``meta`` or all text named by the header.

    Lines are split where they are read. Files in which a quoted cell holds line breaks, and zip archives, are read
    whole by one task each; ``multi_line`` None looks for such cells first. The first line of each file is its header;
    lines further on stay, also such as are equal to it. Blank lines are no rows.
    """
    zipped = [p for p in paths if ".zip" in p.lower()]
    if zipped:
        arrays = _archives(spark, zipped, d)
        return _typed(arrays, meta.names if meta else _archive_names(spark, zipped[0], d), meta)
    lines = spark.read.text(paths)
    first = lines.head() if d.header else None
    head = split_line(first["value"].removesuffix("\r"), d) if first is not None else None
    whole = []
    if d.quote and multi_line is not False:
        odd = (F.length("value") - F.length(F.replace(F.col("value"), F.lit(d.quote), F.lit("")))) % 2 == 1
        whole = paths if multi_line else [r[0] for r in lines.filter(odd).select("_metadata.file_path").distinct().collect()]  # at most all files' names
    if whole and not multi_line:
        every = [r[0] for r in spark.read.format("binaryFile").load(paths).select("path").collect()]
        plain = sorted({_same(p) for p in every} - {_same(p) for p in whole})
        lines = spark.read.text(plain) if plain else None
    arrays = _whole(spark, whole, d) if whole else None
    if lines is not None and not (whole and multi_line):
        lines = without_heads(lines) if d.header else lines
        raw = F.col("value")
        value = F.when(raw.endswith("\r"), F.substring(raw, F.lit(1), F.length(raw) - 1)).otherwise(raw)
        split = lines.filter(value != "").select(cells_of(value, d).alias("cells"))
        arrays = split if arrays is None else arrays.unionByName(split)
    names = meta.names if meta else [(c or "").lower() for c in head] if head else [f"c{k}" for k in range(len(split_line((spark.read.text(paths).head() or {"value": ""})["value"], d)))]
    return _typed(arrays, names, meta)


def _same(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


def _typed(arrays: DataFrame, names: list[str], meta: Meta | None) -> DataFrame:
    cell = [F.get("cells", k) for k in range(len(names))]
    if meta is None:
        return arrays.select(*[c.alias(n) for c, n in zip(cell, names)])
    return arrays.select(*[F.coalesce(c.type.cast(v, T.StringType()), F.lit(None) if c.default is None else F.when(v.isNull() & (F.size("cells") <= k), c.type.cast(F.lit(c.default), T.StringType()))).alias(c.name) for k, (c, v) in enumerate(zip(meta.columns, cell))])


def _parsed(source: str | BinaryIO, d: Dialect) -> Iterator[pa.RecordBatch]:
    """A file's rows, of which no more than a batch is held."""
    rows = (split_line(r, d) for r in records(_lines(source), d))
    for some in itertools.batched(itertools.islice(rows, int(d.header), None), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.list_(pa.string()))], ["cells"])


def _whole(spark: SparkSession, paths: list[str], d: Dialect) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield from _parsed(text.as_py(), d)

    return spark.read.text(paths, wholetext=True).mapInArrow(run, "cells array<string>")


def _entry(content: pa.BinaryScalar, name: str) -> BinaryIO:
    """A stream of an archive's entry, by default the first; neither the archive is copied nor the entry held."""
    z = zipfile.ZipFile(pa.BufferReader(content.as_buffer()))
    return z.open(name or z.namelist()[0])


def _archives(spark: SparkSession, paths: list[str], d: Dialect) -> DataFrame:
    """The rows of the first entry of each archive, or of the one named after #."""
    entry = {p.partition("#")[0].rsplit("/", 1)[-1]: p.partition("#")[2] for p in paths}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with _entry(content, entry.get(path.rsplit("/", 1)[-1], "")) as stream:
                    yield from _parsed(stream, d)

    files = spark.read.format("binaryFile").load([p.partition("#")[0] for p in paths]).select("path", "content")
    return files.mapInArrow(run, "cells array<string>")


def _archive_names(spark: SparkSession, path: str, d: Dialect) -> list[str]:
    """The columns of an archive's entry, from its first record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with _entry(content, path.partition("#")[2]) as stream:
                    cells = split_line(next(records(_lines(stream), d), ""), d)
                    yield pa.RecordBatch.from_arrays([pa.array([cells], pa.list_(pa.string()))], ["cells"])

    cells = spark.read.format("binaryFile").load(path.partition("#")[0]).select("content").mapInArrow(run, "cells array<string>").head()["cells"]
    return [(c or "").lower() for c in cells] if d.header else [f"c{k}" for k in range(len(cells))]


def line_of(df: DataFrame, d: Dialect) -> Column:
    """A row as a line of the dialect, by JVM expressions alone."""

    def cell(f: T.StructField) -> Column:
        v = to_text(F.col(f"`{f.name}`"), f.dataType)
        if d.quote:
            special = v.contains(d.delimiter) | v.contains(d.quote) | v.contains("\n") | v.contains("\r") | (v == d.null)
            v = F.when(special, F.concat(F.lit(d.quote), F.replace(v, F.lit(d.quote), F.lit(d.quote * 2)), F.lit(d.quote))).otherwise(v)
        else:
            v = F.replace(v, F.lit("\\"), F.lit("\\\\"))
            for letter, char in UNESCAPE.items():
                v = F.replace(v, F.lit(char), F.lit(f"\\{letter}"))
            if d.delimiter != "\t":
                v = F.replace(v, F.lit(d.delimiter), F.lit(f"\\{d.delimiter}"))
        return F.coalesce(v, F.lit(d.null))

    line = F.concat_ws(d.delimiter, *[cell(f) for f in df.schema])
    return F.when(line == "", F.lit(d.quote * 2 or d.delimiter)).otherwise(line) if len(df.columns) == 1 else line  # a blank line is no row


def write(df: DataFrame, path: str, d: Dialect, compression: str | None = None) -> None:
    """Writes a directory of text files, each with the header, that read() takes as one table."""
    header = d.delimiter.join(df.columns)
    lines = df.select(line_of(df, d).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if d.header:
            yield pa.RecordBatch.from_arrays([pa.array([header])], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    lines.mapInArrow(run, "value string").write.option("compression", compression or "none").text(path)
