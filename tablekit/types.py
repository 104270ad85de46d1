"""Column types of the engine, their Spark types, casts and write-time checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import EngineError
from .functions import kernels

# Type names, their Spark types, and other names for them.
SPARK = {
    "INT": T.IntegerType(), "UINT": T.LongType(), "INT8": T.ByteType(), "UINT8": T.ShortType(), "INT16": T.ShortType(), "UINT16": T.IntegerType(),
    "INT64": T.LongType(), "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(), "STRING": T.StringType(), "DECIMAL": T.DecimalType(38, 0), "BYTES": T.BinaryType(),
    "DATE": T.DateType(), "TIME": T.TimestampNTZType(), "UUID": T.BinaryType(), "IPV6": T.BinaryType(),
}
ALIASES = {"VARCHAR": "STRING", "CHAR": "STRING", "TEXT": "STRING", "NUMERIC": "DECIMAL", "BINARY": "BYTES", "VARBINARY": "BYTES", "DATETIME": "TIME", "TIMESTAMP": "TIME", "JSON": "OBJECT"}
UNSUPPORTED = {"BLOB", "OBJECT", "NULL", "ZERO"}
RANGES = {"UINT": (0, 2**32 - 1), "UINT8": (0, 2**8 - 1), "UINT16": (0, 2**16 - 1)}
NUMERIC = {"INT", "UINT", "INT8", "UINT8", "INT16", "UINT16", "INT64", "DOUBLE", "FLOAT", "DECIMAL"}
DECIMAL_BYTES = 9
MAX_DIGITS = 38


@dataclass(frozen=True)
class ColumnType:
    """A type with its byte limit (STRING, BYTES, DECIMAL's unscaled value) and scale (DECIMAL)."""

    name: str
    bytes: int | None = None
    scale: int = 0

    @classmethod
    def of(cls, name: str, *sizes: int) -> ColumnType:
        name = ALIASES.get(name.upper(), name.upper())
        if name in UNSUPPORTED or name not in SPARK:
            raise EngineError("INVALID_DATA_TYPE", name)
        size = sizes[0] if sizes else DECIMAL_BYTES if name == "DECIMAL" else None
        if name in ("STRING", "BYTES") and size is not None and size <= 0:
            raise EngineError("INVALID_DATA_TYPE", f"{name}({size})")
        return cls(name, size if name in ("STRING", "BYTES", "DECIMAL") else None, sizes[1] if len(sizes) > 1 and name == "DECIMAL" else 0)

    @classmethod
    def from_spark(cls, kind: T.DataType) -> ColumnType:
        """The type that holds a Spark type's values; booleans are INT8, nested values text."""
        match kind:
            case T.BooleanType():
                return cls("INT8")
            case T.DecimalType():
                return cls("DECIMAL", 16, kind.scale)
            case T.TimestampType():
                return cls("TIME")
        for name in ("INT", "INT8", "INT16", "INT64", "DOUBLE", "FLOAT", "STRING", "BYTES", "DATE", "TIME"):
            if SPARK[name] == kind:
                return cls(name)
        return cls("STRING")

    @property
    def spark(self) -> T.DataType:
        return T.DecimalType(MAX_DIGITS, self.scale) if self.name == "DECIMAL" else SPARK[self.name]

    def __str__(self) -> str:
        if self.bytes is None:
            return self.name
        return f"{self.name}({self.bytes},{self.scale})" if self.scale else f"{self.name}({self.bytes})"

    def cast(self, value: Column, source: T.DataType) -> Column:
        """``value`` as this type; text that does not read as one is null.

        Empty text is null for all but STRING. Decimals are rounded toward minus infinity. Dates and times are taken
        by the length of their text (10, 19, 21 or 23); BYTES, UUID and IPV6 from hexadecimal digits.
        """
        text = isinstance(source, T.StringType)
        if self.name == "STRING":
            return to_text(value, source)
        if text and self.name != "STRING":
            value = F.when(F.trim(value) != "", F.trim(value))
        if self.name == "DECIMAL":
            return floor_decimal(value, self.scale)
        if self.name == "DATE":
            return value.try_cast("timestamp_ntz").cast("date") if not text else F.when(F.length(value).isin(10, 19, 21, 23), F.substring(value, 1, 10).try_cast("date"))
        if self.name == "TIME":
            return F.when(F.length(value).isin(10, 19, 21, 23), value.try_cast("timestamp_ntz")) if text else value.cast("timestamp_ntz")
        if self.name == "BYTES":
            return F.try_to_binary(value, F.lit("hex")) if text else value.cast("binary")
        if self.name == "UUID":
            return F.try_to_binary(F.regexp_replace(value, "-", ""), F.lit("hex")) if text else value.cast("binary")
        if self.name == "IPV6":
            return kernels.ipv6_to_bytes(value) if text else value.cast("binary")
        if isinstance(source, T.BooleanType):
            return value.cast("int").cast(self.spark)
        if self.name in RANGES:
            wide = value.try_cast("decimal(38,0)") if text else value
            low, high = RANGES[self.name]
            return F.when(wide.between(low, high), wide.try_cast(self.spark))
        return value.try_cast(self.spark)

    def valid(self, value: Column) -> Column:
        """Whether a value may be written: within the range of unsigned types and the limit in bytes; null is."""
        ok = F.lit(True)
        if self.name in RANGES:
            ok = value.between(*RANGES[self.name])
        elif self.name in ("STRING", "BYTES") and self.bytes:
            ok = F.octet_length(value) <= self.bytes
        elif self.name == "DECIMAL" and self.bytes and self.bytes < 16:
            limit = F.lit(f"{2 ** (8 * self.bytes - 1)}e-{self.scale}").cast(f"decimal({MAX_DIGITS},{self.scale})")
            ok = (value >= -limit) & (value < limit)
        return F.coalesce(ok, F.lit(True))


def floor_decimal(value: Column, scale: int) -> Column:
    """A decimal of ``scale`` digits, rounded toward minus infinity."""
    return F.floor(value.try_cast(f"decimal({MAX_DIGITS},{min(scale + 10, 18)})"), F.lit(scale)).try_cast(f"decimal({MAX_DIGITS},{scale})")


def to_text(value: Column, source: T.DataType) -> Column:
    """The text form of a value: dates yyyy-MM-dd, times yyyy-MM-dd HH:mm:ss, bytes in hexadecimal digits."""
    match source:
        case T.StringType():
            return value
        case T.BinaryType():
            return F.lower(F.hex(value))
        case T.TimestampNTZType() | T.TimestampType():
            return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        case T.BooleanType():
            return value.cast("int").cast("string")
        case T.ArrayType() | T.MapType() | T.StructType():
            return F.to_json(value)
    return value.cast("string")
