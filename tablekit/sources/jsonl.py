"""JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import Meta
from ..types import to_text


def read(spark: SparkSession, paths: list[str], meta: Meta | None) -> DataFrame:
    """One object a line; blank lines are skipped, missing keys take the column's default, names are lower-cased.

    Described columns are read as text and cast, so that decimals and dates written as text or as numbers read alike;
    other files are inferred by Spark, nested values becoming JSON text and booleans INT8.
    """
    if meta is not None:
        raw = spark.read.schema(T.StructType([T.StructField(c.name, T.StringType()) for c in meta.columns])).option("primitivesAsString", True).json(paths)
        return raw.select(*[c.type.cast(F.coalesce(F.col(f"`{c.name}`"), F.lit(c.default)), T.StringType()).alias(c.name) for c in meta.columns])
    was = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", True)  # keys that differ by case are told apart
    try:
        raw = spark.read.json(paths)
        schema = raw.schema
    finally:
        spark.conf.set("spark.sql.caseSensitive", was)
    columns: dict[str, list[T.StructField]] = {}
    for f in schema:
        columns.setdefault(f.name.lower(), []).append(f)

    def plain(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.BooleanType):
            return c.cast("tinyint")
        return to_text(c, kind) if isinstance(kind, T.ArrayType | T.MapType | T.StructType) else c

    if all(len(same) == 1 for same in columns.values()):
        raw = spark.read.schema(schema).json(paths)
        return raw.select(*[plain(F.col(f"`{f.name}`"), f.dataType).alias(low) for low, (f,) in columns.items()])
    keys = F.from_json("value", T.MapType(T.StringType(), T.StringType()))  # the first of the keys that differ by case and has a value
    rows = spark.read.text(paths).filter(F.trim("value") != "").select(keys.alias("keys"))

    def folded(f: T.StructField) -> Column:
        c = F.col("keys").getItem(f.name)
        return c.try_cast("boolean").cast("tinyint") if isinstance(f.dataType, T.BooleanType) else c if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType) else c.try_cast(f.dataType)

    return rows.select(*[F.coalesce(*map(folded, same)).alias(low) for low, same in columns.items()])


def write(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Objects with explicit nulls; decimals, dates and times as text, bytes in hexadecimal digits."""
    plain = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        plain.append((c.cast("string") if isinstance(f.dataType, T.DecimalType) else to_text(c, f.dataType) if not isinstance(f.dataType, T.NumericType | T.BooleanType) else c).alias(f.name))
    line = F.to_json(F.struct(*plain), {"ignoreNullFields": "false"})
    df.select(line.alias("value")).write.option("compression", compression or "none").text(path)
