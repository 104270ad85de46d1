"""Declarative file-to-file pipelines, from XML or built in Python, as one DataFrame plan for each output."""

from __future__ import annotations

import os
import re
import subprocess
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..engine import Engine
from ..errors import EngineError
from ..functions import kernels
from ..schema import Column as TableColumn
from ..schema import Index, Meta
from ..sources import paths, registry
from ..types import ColumnType
from .lookup import lookup
from .tables import Table, observed

# Letters of date formats, units of relative times in seconds, suffixes of compressed files.
FORMATS = (("yyyy", "%Y"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("ss", "%S"))
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
COMPRESSIONS = ("gz", "zip", "bz2", "zst", "snappy")


def formatted(day: date, fmt: str) -> str:
    for a, b in FORMATS:
        fmt = fmt.replace(a, b)
    return day.strftime(fmt)


def basename(name: str) -> str:
    """A file's name without its suffixes: one for the format, one for the compression."""
    parts = name.split(".")
    if len(parts) > 2 and parts[-1].lower() in COMPRESSIONS:
        parts.pop()
    return ".".join(parts[:-1]) if len(parts) > 1 else name


@dataclass(frozen=True)
class Variable:
    """Text (env wins over value over default), or a date: today and ``offset`` days, or a range of offsets."""

    name: str
    value: str | None = None
    env: str | None = None
    default: str | None = None
    first: int | None = None
    last: int | None = None
    format: str = "yyyy-MM-dd"

    @property
    def ranged(self) -> bool:
        return self.first is not None and self.last is not None and self.first != self.last


def variable_sets(variables: Sequence[Variable], today: date | None = None) -> Iterator[dict[str, str]]:
    """The values of each run: one for each day of the first range, from which every date variable is formatted."""
    today = today or date.today()
    text = {v.name: os.environ.get(v.env or "") or v.value or v.default or "" for v in variables if v.first is None}
    dates = [v for v in variables if v.first is not None]
    driver = next((v for v in dates if v.ranged), None)
    for offset in range(driver.first, driver.last + 1) if driver else [None]:
        yield text | {v.name: formatted(today + timedelta(days=v.first if offset is None else offset), v.format) for v in dates}


def expand(text: str, values: dict[str, str]) -> str:
    for k, v in values.items():
        text = text.replace("{" + k + "}", v)
    return text


@dataclass(frozen=True)
class Condition:
    """A test of an input file: its age (mtime, in units back from now), or its basename compared or matched."""

    kind: str
    operator: str
    value: str

    def __call__(self, f: paths.FileInfo) -> bool:
        if self.kind == "mtime":
            m = re.fullmatch(r"-?(\d+)\s*([smhdw]?)\w*", self.value.strip())
            left, right = f.modified, datetime.now() - timedelta(seconds=int(m[1]) * UNITS[m[2] or "s"])
        elif self.operator in ("matches", "regex"):
            return re.fullmatch(self.value, basename(f.name)) is not None
        else:
            left, right = basename(f.name), self.value
        return {"=": left == right, "eq": left == right, "!=": left != right, "neq": left != right, "<": left < right, "lt": left < right, "<=": left <= right, "le": left <= right, ">": left > right, "gt": left > right, ">=": left >= right, "ge": left >= right}[self.operator]


@dataclass
class Input:
    directory: str
    pattern: str
    max_depth: int = 1
    where: str = ""
    conditions: list[Condition] = field(default_factory=list)


@dataclass
class Mapping:
    """An output column: the first input column of ``sources`` with a value (hash: the first non-blank one), or the default."""

    name: str
    type: ColumnType
    sources: list[str] = field(default_factory=list)
    default: str | None = None
    not_null: bool = False
    transform: str | None = None

    def value(self, schema: T.StructType) -> Column:
        known = {f.name.lower(): f for f in schema}
        found = [known[s.lower()] for s in self.sources or [self.name] if s.lower() in known]
        columns = [F.col(f"`{f.name}`") for f in found]
        if self.transform == "hash":
            blank = [F.when(F.trim(c.cast("string")) != "", c.cast("string")) for c in columns]
            out = kernels.hash63(F.coalesce(*blank)) if blank else F.lit(None)
            out = self.type.cast(out, T.LongType())
        else:
            cast = [self.type.cast(c, f.dataType) for c, f in zip(columns, found)]
            out = F.coalesce(*cast) if cast else F.lit(None).cast(self.type.spark)
        return out if self.default is None else F.coalesce(out, self.type.cast(F.lit(self.default), T.StringType()))


@dataclass
class LookupFilter:
    source: str
    column: str
    where: str
    operator: str = "eq"


@dataclass
class Output:
    directory: str
    filename: str
    mappings: list[Mapping]
    keys: list[str] = field(default_factory=list)
    sort: list[str] = field(default_factory=list)
    filters: list[LookupFilter] = field(default_factory=list)
    exists: str = "skip"
    compression: str | None = None


@dataclass
class Result:
    output: str
    rows_in: int
    rows_out: int
    errors: int
    skipped: bool = False


Handler = Callable[[DataFrame], DataFrame]
#: Gives the condition that rows must meet; a null does not.
RowFilter = Callable[[DataFrame], Column]
#: What a failing onstart command does: stops the run, or not.
POLICIES = ("continue", "ignore", "exit")


@dataclass
class Pipeline:
    """Inputs, handlers and an output; run() makes every output file of every day of the variables."""

    input: Input
    output: Output
    name: str = "pipeline"
    variables: list[Variable] = field(default_factory=list)
    handlers: list[Handler] = field(default_factory=list)
    max_errors: int = 1
    threads: int = 1
    onstart: list[str] = field(default_factory=list)
    onstart_policy: str = "continue"
    row_filters: list[RowFilter] = field(default_factory=list)

    def plan(self, engine: Engine, files: Sequence[str], values: dict[str, str], read_count: Observation | None = None) -> tuple[DataFrame, DataFrame]:
        """The rows read, and the rows to write with a column _error: a mapped column that may not be null is.

        The where clause with its limit applies to each file; handlers, then row filters, see the rows of all.
        """
        frames = [engine.find(f, expand(self.input.where, values)) for f in files]
        rows = frames[0]
        for other in frames[1:]:
            rows = rows.unionByName(other, allowMissingColumns=True)
        read = rows
        rows = rows if read_count is None else rows.observe(read_count, F.count("*").alias("n"))
        for handler in self.handlers:
            rows = handler(rows)
        for f in self.row_filters:
            rows = rows.filter(f(rows))
        for f in self.output.filters:
            rows = lookup(rows, f.column, engine.open(expand(f.source, values)), expand(f.where, values), f.operator)
        error = F.lit(False)
        mapped = []
        for m in self.output.mappings:
            value = m.value(rows.schema)
            mapped.append(value.alias(m.name))
            error = error | ~m.type.valid(F.col(f"`{m.name}`"))
            if m.not_null:
                error = error | F.col(f"`{m.name}`").isNull()
        return read, rows.select(*mapped).withColumn("_error", error)

    def meta(self, name: str) -> Meta:
        columns = [TableColumn(m.name, m.type, m.not_null, m.default) for m in self.output.mappings]
        return Meta(name, columns, [Index("primary", tuple(self.output.keys))] if self.output.keys else [])

    def _one(self, engine: Engine, target: str, files: list[str], values: dict[str, str]) -> Result:
        spark = engine.spark
        if paths.exists(spark, target):
            if self.output.exists != "overwrite":
                return Result(target, 0, 0, 0, True)
            engine.sql(f'DROP TABLE "{target}"')
        plain = not self.output.sort and not target.endswith(registry.NATIVE)
        read_count, seen = Observation() if plain else None, Observation()
        read, rows = self.plan(engine, files, values, read_count)
        meta = self.meta(target.rsplit("/", 1)[-1])
        if target.endswith(registry.NATIVE):
            counts = rows.agg(F.count("*").alias("n"), F.count_if("_error").alias("bad")).head()
            if counts["bad"] > self.max_errors and self.output.sort:
                return Result(target, read.count(), 0, counts["bad"])
            n = Table.create(spark, target, meta).insert(rows.filter(~F.col("_error")).drop("_error"), "replace")
            return Result(target, read.count(), n, counts["bad"])
        if self.output.sort:  # rows are counted above the sort, whose sampling would count them once more
            rows = rows.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in self.output.sort])
        rows = rows.observe(seen, F.count("*").alias("n"), F.count_if("_error").alias("bad"))
        registry.write_file(spark, rows.filter(~F.col("_error")).drop("_error"), target, meta, self.output.compression)
        counts = {"n": 0, "bad": 0} | observed(seen)
        total = observed(read_count).get("n", 0) if plain else read.count()
        if counts["bad"] > self.max_errors and self.output.sort:  # over the budget a sorted output does not stay
            registry.drop_file(spark, target)
            return Result(target, total, 0, counts["bad"])
        return Result(target, total, counts["n"] - counts["bad"], counts["bad"])

    def _started(self, values: dict[str, str]) -> None:
        for command in self.onstart:
            code = subprocess.run(expand(command, values), shell=True, check=False).returncode
            if code and self.onstart_policy == "exit":
                raise EngineError("INVALID_OPERATION", f"an onstart command failed with code {code}")

    def run(self, engine: Engine, today: date | None = None, allow_shell: bool = False) -> list[Result]:
        """Input files whose output has the same name are merged. ``allow_shell``: runs the onstart commands before each
        set of variables."""
        jobs: dict[str, tuple[list[str], dict[str, str]]] = {}
        for values in variable_sets(self.variables, today):
            if allow_shell:
                self._started(values)
            pattern = expand(self.input.pattern, values)
            for f in paths.walk(engine.spark, expand(self.input.directory, values), self.input.max_depth):
                if re.fullmatch(pattern, f.name) and all(c(f) for c in self.input.conditions):
                    own = values | {"basename": basename(f.name)}
                    target = f"{expand(self.output.directory, own)}/{expand(self.output.filename, own)}"
                    jobs.setdefault(target, ([], own))[0].append(f.path)
        with ThreadPoolExecutor(max(1, self.threads)) as pool:
            return list(pool.map(lambda j: self._one(engine, j[0], *j[1]), jobs.items()))


def _range(text: str) -> tuple[int, int]:
    """Offsets from today: of -2..0 or of days such as 2025-01-01..2025-01-31."""
    first, _, last = text.partition("..")
    return tuple(int(x) if re.fullmatch(r"[+-]?\d{1,5}", x) else (date.fromisoformat(x) - date.today()).days for x in (first, last or first))


def from_xml(text: str, handlers: dict[str, Handler] | None = None, row_filters: Sequence[RowFilter] = ()) -> Pipeline:
    """A pipeline of an XML text; row handlers are looked up by class or name in ``handlers``. Ranges of days given as
    dates are taken from today's date on."""
    root = ET.fromstring(text)
    if root.tag != "pipeline":
        raise EngineError("INVALID_OPERATION", "the root must be <pipeline>")
    variables, body, threads = [], root, int(root.get("max-threads", 1))
    if (loop := root.find("loop")) is not None:
        body = loop
        threads = int(loop.get("threads", threads))
        for k, v in loop.attrib.items():
            if k == "threads" or k.startswith("format-"):
                continue
            if v.startswith("env:"):
                variables.append(Variable(k, env=v[4:]))
            elif re.fullmatch(r"[+-]?\d+\.\.[+-]?\d+|\d{4}-\d\d-\d\d\.\.\d{4}-\d\d-\d\d", v):
                variables.append(Variable(k, first=_range(v)[0], last=_range(v)[1], format=loop.get(f"format-{k}", "yyyy-MM-dd")))
            else:
                variables.append(Variable(k, value=v))
    for v in root.iterfind("variables/variable"):
        if v.get("type", "string") == "date":
            if span := v.get("offset-range"):
                first, last = _range(span)
            elif v.get("last-days"):
                first, last = 1 - int(v.get("last-days")), 0
            elif v.get("from") or v.get("to"):
                days = [(date.fromisoformat(v.get(k)) - date.today()).days if v.get(k) else 0 for k in ("from", "to")]
                first, last = days
            else:
                first = last = int(v.get("offset", 0))
            variables.append(Variable(v.get("name"), first=first, last=last, format=v.get("format", "yyyy-MM-dd")))
        else:
            variables.append(Variable(v.get("name"), v.get("value") or (v.text or "").strip() or None, v.get("env"), v.get("default")))
    i, o = body.find("input"), body.find("output")
    if i is None or o is None:
        raise EngineError("INVALID_OPERATION", "<input> and <output> are required")
    conditions = [Condition(c.get("type") or c.get("kind") or ("mtime" if c.get("mtime") else "basename"), c.get("operator", "="), c.get("value") or c.get("mtime") or (c.text or "").strip()) for c in i.iterfind(".//matcher//condition")]
    source = Input((i.findtext("directory") or "").strip(), (i.findtext("pattern") or ".*").strip(), int(i.get("max-depth", 1)), (i.findtext("where") or "").strip(), conditions)
    mappings = []
    for c in o.iterfind(".//columns/column"):
        sizes = [int(c.get("bytes"))] if c.get("bytes") else []
        if c.get("precision") and sizes:
            sizes.append(int(c.get("precision")))
        kind = ColumnType.of(c.get("type", "string"), *sizes) if sizes or c.get("type", "string").lower() != "string" else ColumnType("STRING")
        mappings.append(Mapping(c.get("name").lower(), kind, [s.strip() for s in (c.get("from") or c.get("name")).split(",")], c.get("default"), c.get("not-null") == "true", c.get("transform")))
    filters = []
    for f in o.iterfind("filter"):
        for c in f.iterfind("condition"):
            filters.append(LookupFilter(f.get("source"), f.get("from"), c.get("lookup", ""), c.get("operator", "eq")))
    words = lambda e: [] if e is None else [c.strip().lower() for c in e.get("columns", "").split(",") if c.strip()]
    fmt = o.find(".//format")
    exists = o.find("if")
    output = Output((o.findtext("directory") or "").strip(), (o.findtext("filename") or "").strip(), mappings, words(o.find(".//indexes/primary")), words(o.find("sort")), filters, (exists.text or "skip").strip() if exists is not None else "skip", fmt.get("compression") if fmt is not None else None)
    wanted = [h.get("class") or h.get("name") for h in body.iterfind("row-handlers/handler")]
    missing = [w for w in wanted if w not in (handlers or {})]
    if missing:
        raise EngineError("RESOURCE_NOT_AVAILABLE", f"no handlers {missing}")
    start = root.find("onstart")
    commands = [] if start is None else [c.strip() for c in (start.text or "", *(e.text or "" for e in start.iterfind(".//command"))) if c.strip()]
    policy = "continue" if start is None else start.get("error", "continue").lower()
    if policy not in POLICIES:
        raise EngineError("INVALID_OPERATION", f"onstart policy {policy}")
    return Pipeline(source, output, root.get("name", "pipeline"), variables, [handlers[w] for w in wanted], int(root.get("max-errors", 1)), threads, commands, policy, list(row_filters))


def run_xml(spark: SparkSession, path: str, handlers: dict[str, Handler] | None = None, **options) -> list[Result]:
    return from_xml(paths.read_text(spark, path), handlers).run(Engine(spark), **options)
