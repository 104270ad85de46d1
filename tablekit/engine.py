"""SQL over paths, and the same operations as methods."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import EngineError
from .operators.tables import Table, stored
from .plans import ast
from .plans.lexer import statements
from .plans.lower import limited, ordered, scanned, select
from .plans.parser import parse, parse_find
from .schema import Index, Meta
from .sources import jdbc, paths, registry

#: Files whose rows SHOW TABLES counts in one job.
COUNTED = 50


class Engine:
    """Reads and changes tables named by paths.

    Files are Parquet, TSV, CSV, TBL, JSON lines, unions of files, or what a plugin reads; tables with a primary key end
    in registry.NATIVE; databases are named by JDBC urls or by aliases of ``jdbc_properties``. ``stable``: ORDER BY keeps
    rows of equal keys in the order of the scan.
    """

    def __init__(self, spark: SparkSession, jdbc_properties: str = "", predict_types: bool = False, stable: bool = False):
        self.spark, self.aliases, self.predict_types, self.stable = spark, jdbc.aliases(jdbc_properties), predict_types, stable
        self.open_tables: dict[str, Table] = {}
        self.temporary: dict[str, str] = {}

    def close(self) -> None:
        """Rolls open transactions back and drops temporary tables; also at the end of a with block."""
        for table in self.open_tables.values():
            table.rollback()
        self.open_tables.clear()
        for name in list(self.temporary):
            self._drop(name)

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # -- names

    def _path(self, name: str) -> str:
        return self.temporary.get(name, name)

    def _native(self, name: str) -> bool:
        return self._path(name).rstrip("/").endswith(registry.NATIVE)

    def table(self, name: str) -> Table:
        """A table with a primary key; the same object while a transaction is open."""
        path = self._path(name).rstrip("/")
        return self.open_tables.get(path) or Table(self.spark, path)

    def open(self, name: str, meta: Meta | None = None) -> DataFrame:
        """The rows of a table or file."""
        if self._native(name):
            return self.table(name).df()
        if t := jdbc.target(name, self.aliases):
            return jdbc.read(self.spark, t)
        df = registry.open_file(self.spark, name, meta)
        if meta is None and self.predict_types and registry.format_of(name) in ("tsv", "csv") and registry.described(self.spark, name) is None:
            df = registry.open_file(self.spark, name, registry.predicted(df, 10))
        return df

    def meta(self, name: str) -> Meta | None:
        return self.table(name).meta if self._native(name) else registry.described(self.spark, name) if not name.startswith(("jdbc:", "@")) else None

    def find(self, name: str, clauses: str = "") -> DataFrame:
        """Rows by a find string: [USE INDEX(name [DESC])] [WHERE condition] [LIMIT [offset,] n]."""
        q = parse_find(clauses)
        q.table = name
        df = scanned(self.open(name), self.meta(name), q)
        return limited(ordered(df, q.order_by, self.stable) if q.order_by else df, q.offset, q.limit)

    def one(self, name: str, index: str, key: Sequence[Any]) -> Row | None:
        return self.table(name).one(index, key).head()

    def rows(self, name: str) -> int:
        return self.open(name).count()

    def traverse(self, name: str) -> Iterator[Row]:
        """All rows, one partition after another, in the driver."""
        return self.open(name).toLocalIterator()

    # -- SQL

    def script(self, text: str) -> list[DataFrame]:
        return [self.sql(s) for s in statements(text)]

    def sql(self, text: str) -> DataFrame:
        """Runs a statement; changes give one row: affected."""
        s = parse(text)
        match s:
            case ast.Select():
                return self._select(s)
            case ast.Insert():
                return self._affected(self._insert(s))
            case ast.Update() | ast.Delete():
                return self._affected(self._change(s))
            case ast.Create():
                return self._affected(self._create(s))
            case ast.Simple("DROP", target):
                return self._affected(self._drop(target))
            case ast.Simple("DESC", target):
                return self._desc(target)
            case ast.Simple("META", target):
                return self.spark.createDataFrame([(self._described(target).ddl(),)], "meta string")
            case ast.Simple("SHOW", target, recursive):
                return self._show(target or ".", recursive)
            case ast.Simple(verb, target):
                return self._affected(self._transaction(verb, target))
        raise EngineError("INVALID_OPERATION", text)

    def _affected(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "affected bigint")

    def _select(self, q: ast.Select) -> DataFrame:
        if t := jdbc.target(q.table, self.aliases):
            out = jdbc.read(self.spark, t, q)
        else:
            out = select(self.open(q.table), self.meta(q.table) if q.index or self._native(q.table) else None, q, self.stable)
        return out if q.into is None else self._affected(self._into(q, out))

    def _into(self, q: ast.Select, out: DataFrame) -> int:
        """Writes a query's rows to a new table or file; a table takes the source's key if it has its columns, else the first column."""
        if t := jdbc.target(q.into, self.aliases):
            return jdbc.write(out, t)
        source = self.meta(q.table) if not jdbc.target(q.table, self.aliases) else None
        kept = {c.name: c for c in source.columns} if source and not q.group_by else {}
        meta = Meta.from_spark(q.into.rstrip("/").rsplit("/", 1)[-1], out.schema)
        meta.columns = [kept.get(c.name, c) for c in meta.columns]
        if self._native(q.into):
            names = set(meta.names)
            key = source.primary_key if source and source.indexes and set(source.primary_key) <= names else (meta.names[0],)
            meta.indexes = [Index("primary", tuple(key))]
            return Table.create(self.spark, self._path(q.into), meta).insert(out, "replace")
        registry.write_file(self.spark, out, q.into, meta)
        return self.open(q.into).count()

    def _insert(self, s: ast.Insert) -> int:
        if t := jdbc.target(s.table, self.aliases):
            if s.values is not None:
                return jdbc.execute(self.spark, t, jdbc.change(t, s))
            rows = self._select(s.source)
            return jdbc.write(rows.toDF(*s.columns) if s.columns else rows, t)
        target = self.table(s.table) if self._native(s.table) else None
        meta = target.meta if target else self.meta(s.table)
        if target is None and (s.values is not None or paths.exists(self.spark, s.table)):
            raise EngineError("INVALID_OPERATION", f"{s.table} takes no rows")
        names = s.columns or (meta.names if meta else None)
        if s.values is not None:
            if len(s.values) != len(names):
                raise EngineError("COLUMN_MISMATCH", f"{len(s.values)} values for {len(names)} columns")
            given = {meta.column(c).name: v for c, v in zip(names, s.values)}
            rows = self.spark.range(0, 1, 1, 1).select(*[stored(given.get(c.name, ast.Literal(c.default, True)), c).alias(c.name) for c in meta.columns])
        else:
            source = self._select(s.source)
            if meta is None:
                registry.write_file(self.spark, source.toDF(*names) if names else source, s.table)
                return self.open(s.table).count()
            if len(source.columns) < len(names):
                raise EngineError("COLUMN_MISMATCH", f"{len(source.columns)} columns for {len(names)}")
            by_name = s.columns is None and set(names) <= set(source.columns)
            place = {c.lower(): (c if by_name else source.columns[k]) for k, c in enumerate(names)}
            rows = source.select(*[(c.type.cast(F.col(f"`{place[c.name]}`"), source.schema[place[c.name]].dataType) if c.name in place else stored(ast.Literal(c.default, True), c)).alias(c.name) for c in meta.columns])
        if target is None:
            registry.write_file(self.spark, rows, s.table, meta)
            return self.open(s.table).count()
        return target.insert(rows, "replace" if s.replace else "ignore" if s.ignore else "error", s.values is not None)

    def _change(self, s: ast.Update | ast.Delete) -> int:
        if t := jdbc.target(s.table, self.aliases):
            return jdbc.execute(self.spark, t, jdbc.change(t, s))
        if not self._native(s.table):
            raise EngineError("INVALID_OPERATION", f"{s.table} cannot be changed")
        table = self.table(s.table)
        return table.update(s.assignments, s.where) if isinstance(s, ast.Update) else table.delete(s.where)

    def _create(self, s: ast.Create) -> int:
        if s.temporary or s.meta.options.get("STORAGE", "").upper() == "MEMORY":
            from tempfile import gettempdir

            base = self.spark.conf.get("spark.sql.warehouse.dir", gettempdir())
            self.temporary[s.table] = f"{base}/temporary-{uuid.uuid4().hex}{registry.NATIVE}"
        elif not self._native(s.table):
            raise EngineError("INVALID_OPERATION", f"only tables that end in {registry.NATIVE} are created")
        Table.create(self.spark, self._path(s.table), s.meta)
        return 0

    def _drop(self, name: str) -> int:
        if self._native(name):
            self.table(name).drop()
            self.temporary.pop(name, None)
            return 1
        if not paths.exists(self.spark, name):
            raise EngineError("TABLE_NOT_FOUND", name)
        return int(registry.drop_file(self.spark, name))

    def _transaction(self, verb: str, name: str | None) -> int:
        if verb == "BEGIN":
            table = self.table(name)
            table.begin()
            self.open_tables[table.path] = table
            return 0
        for path in [self._path(name).rstrip("/")] if name else list(self.open_tables):
            table = self.open_tables.pop(path, None)
            if table is None:
                raise EngineError("TRANSACTION_NOT_STARTED", path)
            table.commit() if verb == "COMMIT" else table.rollback()
        return 0

    # -- catalogue

    def _described(self, name: str) -> Meta:
        t = jdbc.target(name, self.aliases)
        return self.meta(name) or Meta.from_spark(name.rstrip("/").rsplit("/", 1)[-1], (jdbc.lazy(self.spark, t) if t else self.open(name)).schema)

    def _desc(self, name: str) -> DataFrame:
        meta = self._described(name)
        primary = meta.indexes[0].keys if meta.indexes else ()
        others = {k for i in meta.indexes[1:] for k in i.keys}
        rows = [(c.name, str(c.type), "PRI" if c.name in primary else "MUL" if c.name in others else "", c.default) for c in meta.columns]
        return self.spark.createDataFrame(rows, "Column string, Type string, Key string, `Default` string")

    def _show(self, directory: str, recursive: bool) -> DataFrame:
        found = []
        for f in paths.walk(self.spark, directory, 100 if recursive else 1):
            try:
                kind = registry.format_of(f.path)
            except EngineError:
                continue
            if f.name.startswith(("_", ".")) or f.name.endswith((".desc", ".crc")):
                continue
            fs, p = paths.file_system(self.spark, f.path)
            found.append((f.name, kind, fs.getContentSummary(p).getLength(), f.modified, f.path))
        counts: dict[int, int] = {}
        for at in range(0, len(found), COUNTED):  # one job for many files
            each = [self.open(f[4]).agg(F.count("*").alias("n")).withColumn("k", F.lit(at + k)) for k, f in enumerate(found[at : at + COUNTED])]
            together = each[0]
            for other in each[1:]:
                together = together.union(other)
            counts |= {r["k"]: r["n"] for r in together.collect()}
        rows = [(name, kind, counts[k], size, modified, path) for k, (name, kind, size, modified, path) in enumerate(found)]
        return self.spark.createDataFrame(rows, T.StructType([T.StructField(n, t) for n, t in (("Table", T.StringType()), ("Format", T.StringType()), ("Rows", T.LongType()), ("Bytes", T.LongType()), ("Modified", T.TimestampType()), ("Path", T.StringType()))]))
