"""Table descriptions, their CREATE TABLE text, and the .desc files that keep it beside the data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from .errors import EngineError
from .types import ColumnType

# The options of CREATE TABLE, in the order in which they are printed.
OPTIONS = "DIRECTORY STORAGE INCREMENT COMPACT CACHE WAL WAL_BATCH_SIZE WAL_CHECKPOINT_INTERVAL WAL_COMPRESSION_THRESHOLD WAL_PAGE_DATA COMPRESSOR DICTIONARY HEADER DELIMITER QUOTE NULL FORMAT DATE MAX".split()
MOST_INDEXES = 19


@dataclass(frozen=True)
class Column:
    name: str
    type: ColumnType
    not_null: bool = False
    default: str | None = None
    comment: str | None = None


@dataclass(frozen=True)
class Index:
    name: str
    keys: tuple[str, ...]


@dataclass
class Meta:
    """A table's name, columns, indexes (the first is the primary key) and options."""

    name: str
    columns: list[Column]
    indexes: list[Index] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len(self.indexes) > MOST_INDEXES:
            raise EngineError("INVALID_OPERATION", f"more than {MOST_INDEXES} indexes")
        for index in self.indexes:
            for key in index.keys:
                self.column(key)

    @classmethod
    def from_spark(cls, name: str, schema: T.StructType) -> Meta:
        return cls(name, [Column(f.name.lower(), ColumnType.from_spark(f.dataType), not f.nullable) for f in schema])

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def primary_key(self) -> tuple[str, ...]:
        if not self.indexes:
            raise EngineError("NO_INDEXES", self.name)
        return self.indexes[0].keys

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name.lower():
                return c
        raise EngineError("COLUMN_MISMATCH", f"no column {name} in {self.name}")

    def index(self, name: str) -> Index:
        for k, index in enumerate(self.indexes):
            if index.name.lower() == name.lower() or k == 0 and name.lower() == "primary":
                return index
        raise EngineError("INDEX_NOT_FOUND", name)

    @property
    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type.spark, not c.not_null, {"bytes": c.type.bytes or 0, "comment": c.comment or ""}) for c in self.columns])

    def ddl(self) -> str:
        """CREATE TABLE text that plans.parser reads back to an equal description."""

        def quoted(s: str) -> str:
            return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"

        lines = []
        for c in self.columns:
            lines.append(f"{c.name} {c.type}" + " NOT NULL" * c.not_null + (f" DEFAULT {quoted(c.default)}" if c.default is not None else "") + (f" COMMENT {quoted(c.comment)}" if c.comment else ""))
        for k, index in enumerate(self.indexes):
            lines.append(("PRIMARY KEY" if k == 0 else f"KEY {index.name}") + f" ({', '.join(index.keys)})")
        options = ", ".join(f"{k}={self.options[k] if self.options[k].isalnum() else quoted(self.options[k])}" for k in OPTIONS if k in self.options)
        return f"CREATE TABLE {self.name or '*'} (\n\t" + ",\n\t".join(lines) + "\n)" + (f" {options}" if options else "")
