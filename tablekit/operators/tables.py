"""Tables with a primary key: immutable Parquet files, a manifest of those that are current, and one writer at a time."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..plans.ast import Literal
from ..plans.parser import parse
from ..plans.predicates import constant, predicate, resolver
from ..schema import Meta
from ..sources.paths import delete, exists, file_system, footer, names, read_text, write_text
from ..sources.registry import sidecar


#: Parquet codecs by the COMPRESSOR option of a table.
CODECS = {"none": "none", "z": "gzip", "gzip": "gzip", "lz4": "lz4_raw", "zstd": "zstd", "snappy": "snappy"}


#: Types of first key columns whose ranges the manifest has.
RANGED = ("INT", "UINT", "INT8", "UINT8", "INT16", "UINT16", "INT64", "STRING")
#: Manifests that are kept, so that readers of an older one still find it and its files' names.
KEPT = 4


@dataclass(frozen=True)
class File:
    """A data file and the least and largest value of the first key column in it; None: not known."""

    path: str
    low: str | int | None = None
    high: str | int | None = None

    def meets(self, low: Any, high: Any) -> bool:
        """Whether it may hold a key from ``low`` to ``high``."""
        return None in (self.low, self.high, low, high) or type(self.low) is not type(low) or self.low <= high and low <= self.high


@dataclass
class Manifest:
    """The current files of a table."""

    files: list[File] = field(default_factory=list)
    version: int = 0

    def text(self) -> str:
        return json.dumps({"version": self.version, "files": [asdict(f) for f in self.files]})

    @classmethod
    def of(cls, text: str) -> Manifest:
        found = json.loads(text)
        return cls([File(**f) for f in found["files"]], found["version"])


def observed(seen: Observation) -> dict[str, int]:
    """What was observed; nothing where adaptive execution found that there are no rows, and left the observation out."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


def stored(value: Literal, column) -> Column:
    """A constant as a column stores it: decimals rounded toward minus infinity, text read by the column's type."""
    return F.lit(None).cast(column.type.spark) if value.value is None else column.type.cast(F.lit(value.value), T.StringType())


class Table:
    """A table in the folder ``path``.

    Changes write new files, then a manifest of the next number, which becomes current as it gets its name: there is no
    moment without one, and readers see the state before or after. Files are dealt out by ranges of the key, and the
    manifest has each file's range, so a change reads and writes again only files that may hold its rows. Outside a
    transaction each change commits by itself; a statement that fails leaves no trace, also within a transaction.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        if not exists(spark, sidecar(self.path)):
            raise EngineError("TABLE_NOT_FOUND", path)
        self.meta: Meta = parse(read_text(spark, sidecar(self.path))).meta
        self.staged: Manifest | None = None
        self.made: list[str] = []

    @classmethod
    def create(cls, spark: SparkSession, path: str, meta: Meta) -> Table:
        path = path.rstrip("/")
        if exists(spark, path) or exists(spark, sidecar(path)):
            raise EngineError("INVALID_OPERATION", f"{path} exists")
        meta.primary_key  # noqa: B018  raises if there is none
        write_text(spark, f"{path}/manifest/{0:012}", Manifest().text())
        write_text(spark, sidecar(path), meta.ddl())
        return cls(spark, path)

    def drop(self) -> None:
        delete(self.spark, self.path)
        for suffix in (".desc", ".wal", ".crc"):
            delete(self.spark, self.path + suffix)

    # -- reading

    def manifest(self) -> Manifest:
        if self.staged is not None:
            return self.staged
        return Manifest.of(read_text(self.spark, f"{self.path}/manifest/{self._versions()[-1]}"))

    def _versions(self) -> list[str]:
        return [n for n in names(self.spark, f"{self.path}/manifest") if n.isdigit()]

    def _read(self, files: Sequence[File]) -> DataFrame:
        schema = self.meta.spark
        if not files:
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f.path}" for f in files])

    def df(self) -> DataFrame:
        return self._read(self.manifest().files)

    def one(self, index: str, key: Sequence[Any]) -> DataFrame:
        """The row with a key; an empty DataFrame if there is none."""
        keys, files = self.meta.index(index).keys, self.manifest().files
        if keys[0] == self.meta.primary_key[0] and key and (wanted := self._plain(key[0])) is not None:
            files = [f for f in files if f.meets(wanted, wanted)]
        df = self._read(files)
        for k, v in zip(keys, key):
            df = df.filter(F.col(k) == constant(Literal(None if v is None else str(v), True), df.schema[k].dataType))
        return df.limit(1)

    # -- transactions

    def begin(self) -> None:
        if self.staged is not None:
            raise EngineError("TRANSACTION_FAILED", "a transaction is open")
        fs, lock = file_system(self.spark, f"{self.path}/LOCK")
        try:
            fs.create(lock, False).close()
        except Exception as e:
            raise EngineError("LOCK_TIMEOUT", self.path) from e
        self.staged, self.made = self.manifest(), []

    def commit(self) -> None:
        if self.staged is None:
            raise EngineError("TRANSACTION_NOT_STARTED", self.path)
        write_text(self.spark, f"{self.path}/manifest/{self.staged.version + 1:012}", Manifest(self.staged.files, self.staged.version + 1).text())
        for old in self._versions()[:-KEPT]:
            delete(self.spark, f"{self.path}/manifest/{old}")
        self._end()

    def rollback(self) -> None:
        if self.staged is None:
            raise EngineError("TRANSACTION_NOT_STARTED", self.path)
        for folder in self.made:
            delete(self.spark, f"{self.path}/{folder}")
        self._end()

    def _end(self) -> None:
        self.staged = None
        delete(self.spark, f"{self.path}/LOCK")

    def __enter__(self) -> Table:
        self.begin()
        return self

    def __exit__(self, kind, *_) -> None:
        self.commit() if kind is None else self.rollback()

    def _change(self, work) -> int:
        """Runs a statement; if it fails, what it staged and wrote is taken back, and an open transaction goes on without it."""
        if self.staged is None:
            with self:
                return work()
        files, made = list(self.staged.files), len(self.made)
        try:
            return work()
        except BaseException:
            self.staged.files = files
            for folder in self.made[made:]:
                delete(self.spark, f"{self.path}/{folder}")
            del self.made[made:]
            raise

    def _plain(self, value: Any) -> str | int | None:
        """A value given for the first key column as the manifest has it."""
        name = self.meta.column(self.meta.primary_key[0]).type.name
        if value is None or name not in RANGED:
            return None
        try:
            return str(value) if name == "STRING" else int(str(value))
        except ValueError:
            return None

    def _ranges(self, made: list[str]) -> list[File]:
        """The files with the ranges of their first key column, as their footers have them."""
        kind, key = self.meta.column(self.meta.primary_key[0]).type.name, self.meta.primary_key[0]
        if kind not in RANGED:
            return [File(f) for f in made]

        def one(name: str) -> File:
            found = footer(self.spark, f"{self.path}/{name}")
            ends = [c.getStatistics() for b in found.getBlocks() for c in b.getColumns() if c.getPath().toDotString() == key]
            if not ends or any(not e.hasNonNullValue() or e.getNumNulls() != 0 for e in ends):
                return File(name)
            low, high = [e.genericGetMin() for e in ends], [e.genericGetMax() for e in ends]
            if kind == "STRING":
                low, high = ([x.toStringUsingUTF8() for x in xs] for xs in (low, high))
            return File(name, min(low), max(high))

        with ThreadPoolExecutor(8) as pool:
            return list(pool.map(one, made))

    def _write(self, df: DataFrame, single: bool = False, **counts: Column) -> tuple[list[File], dict[str, int]]:
        """Writes rows as new files by ranges of the primary key and sorted by it, so that files and row groups can be
        skipped by key; the files, and the counts over the rows written."""
        folder = f"data-{uuid.uuid4().hex}"
        self.made.append(folder)
        codec = CODECS.get(self.meta.options.get("COMPRESSOR", "zstd").lower(), "zstd")
        typed = [F.col(f"`{c.name}`").cast(c.type.spark).alias(c.name) for c in self.meta.columns]
        rows, seen = df if single else df.repartitionByRange(*self.meta.primary_key).sortWithinPartitions(*self.meta.primary_key), Observation()
        rows = rows.observe(seen, *[c.alias(k) for k, c in counts.items()]) if counts else rows  # above the ranges, whose sampling would count twice
        rows.select(*typed).write.option("compression", codec).parquet(f"{self.path}/{folder}")
        return self._ranges([f"{folder}/{n}" for n in names(self.spark, f"{self.path}/{folder}") if n.endswith(".parquet")]), {k: 0 for k in counts} | (observed(seen) if counts else {})

    # -- changing

    def _watched(self, rows: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
        """Rows that are checked as they are written, and a function that raises for what the checks found: nulls in
        NOT NULL columns and values over their limits. So the rows are made once, not once more for the checks."""
        bad = {}
        for c in self.meta.columns:
            value = F.col(f"`{c.name}`")
            if c.not_null:
                bad[f"CHECK_CONSTRAINT_VIOLATION {c.name} is null"] = value.isNull()
            bad[f"{'ROW_BYTES_EXCEEDED' if c.type.name in ('STRING', 'BYTES') else 'INVALID_DATA_TYPE'} {c.name}"] = ~c.type.valid(value)
        seen = Observation()
        watched = rows.observe(seen, *[F.count_if(test).alias(f"t{k}") for k, test in enumerate(bad.values())])

        def verdict() -> None:
            found = observed(seen)
            for k, text in enumerate(bad):
                if found.get(f"t{k}"):
                    raise EngineError(*text.split(" ", 1))

        return watched, verdict

    def _same_key(self, a: DataFrame, b: DataFrame) -> Column:
        test = F.lit(True)
        for k in self.meta.primary_key:
            test = test & a[k].eqNullSafe(b[k])
        return test

    def _with_file(self, files: Sequence[File] | None = None) -> DataFrame:
        files = self.manifest().files if files is None else files
        rows = self._read(files)
        return rows.withColumn("_file", F.concat_ws("/", F.slice(F.split(F.col("_metadata.file_path"), "/"), -2, 2)) if files else F.lit(""))

    def _near(self, made: Sequence[File]) -> list[File]:
        """The current files whose key ranges meet those of ``made``."""
        return [f for f in self.manifest().files if any(f.meets(m.low, m.high) for m in made)]

    def insert(self, rows: DataFrame, mode: str = "error", single: bool = False) -> int:
        """Adds rows whose columns are the table's; mode error, replace (last row of a key wins) or ignore (first wins).

        New rows are grouped by key once, which also finds keys that repeat among them; ``single``: there is but one row.
        """
        key = list(self.meta.primary_key)

        def work() -> int:
            new, verdict = self._watched(rows.select(*self.meta.names))
            pick = F.max_by if mode == "replace" else F.min_by
            grouped = new.withColumn("_n", F.monotonically_increasing_id()).groupBy(*key).agg(pick(F.struct(*self.meta.names), "_n").alias("_row"), F.count("*").alias("_times"))
            new = grouped.select("_row.*", "_times") if not single else new.withColumn("_times", F.lit(1))
            before = self.manifest().files
            if mode == "ignore" and before:
                old = self._read(before)
                new = new.join(old, self._same_key(new, old), "left_anti")
            made, counts = self._write(new, single, n=F.count("*"), repeated=F.count_if(F.col("_times") > 1))
            verdict()
            if mode == "error" and counts["repeated"]:
                raise EngineError("DUPLICATE_KEY", "within the new rows")
            fresh, near = self._read(made), self._near(made)
            if near and mode != "ignore":
                old = self._with_file(near)
                touched = old.join(fresh, self._same_key(old, fresh), "left_semi")
                if mode == "error" and touched.head(1):
                    raise EngineError("DUPLICATE_KEY", self.path)
                if mode == "replace":
                    self._rewrite(touched, lambda kept: kept.join(fresh, self._same_key(kept, fresh), "left_anti"))
            self.staged.files = [*self.manifest().files, *made]
            return counts["n"]

        return self._change(work)

    def _rewrite(self, touched: DataFrame, change) -> None:
        """Writes again the files that hold ``touched`` rows (read with a column _file), changed."""
        paths = {r["_file"] for r in touched.select("_file").distinct().collect()}
        files = [f for f in self.manifest().files if f.path in paths]
        if files:
            made, _ = self._write(change(self._read(files)))
            self.staged.files = [f for f in self.manifest().files if f.path not in paths] + made

    def update(self, assignments: Sequence[tuple[str, Literal]], where: Any) -> int:
        """Sets columns to constants where the condition holds; a change of key columns must leave keys unique."""

        def work() -> int:
            old = self._with_file()
            test = F.coalesce(predicate(where, resolver(old.schema)), F.lit(False))
            n = old.filter(test).count()
            if n:
                new = {self.meta.column(c).name: stored(v, self.meta.column(c)) for c, v in assignments}
                verdicts = []

                def changed(rows: DataFrame) -> DataFrame:
                    watched, verdict = self._watched(rows.withColumns({c: F.when(test, v).otherwise(F.col(c)) for c, v in new.items()}))
                    verdicts.append(verdict)
                    return watched

                self._rewrite(old.filter(test), changed)
                for verdict in verdicts:
                    verdict()
                if set(new) & set(self.meta.primary_key) and self.df().groupBy(*self.meta.primary_key).count().filter("count > 1").head(1):
                    raise EngineError("DUPLICATE_KEY", self.path)
            return n

        return self._change(work)

    def delete(self, where: Any) -> int:
        def work() -> int:
            old = self._with_file()
            test = F.coalesce(predicate(where, resolver(old.schema)), F.lit(False))
            n = old.filter(test).count()
            if n:
                self._rewrite(old.filter(test), lambda rows: rows.filter(~test))
            return n

        return self._change(work)
