"""Aggregate functions by name, group keys, conditions, and the aggregation itself."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from . import bitmaps, kernels

#: Digits after the point of sums and averages, and of the exact decimals that doubles are summed as.
SCALE, EXACT = 5, 10
HLL_BITS = 14


def exact(value: Column, kind: T.DataType) -> Column:
    """A number as a decimal, so that sums do not depend on the order of rows.

    Text that is no number is left out. A number that no decimal of 38 digits holds (10 of them after the point, for
    doubles), not a number and infinities are errors: nothing is left out silently.
    """
    if isinstance(kind, T.DecimalType):
        return value
    out = value.try_cast(f"decimal({28 if isinstance(kind, T.IntegralType) else 38},{0 if isinstance(kind, T.IntegralType) else EXACT})")
    if not isinstance(kind, T.DoubleType | T.FloatType):
        return out
    return F.coalesce(out, F.when(value.isNotNull(), F.raise_error(F.concat(F.lit("SUM and AVG cannot hold "), value.cast("string"))).cast(f"decimal(38,{EXACT})")))


@dataclass(frozen=True)
class Key:
    """A group key: a column, or an expression over the row such as time()."""

    alias: str
    column: str | Column

    def value(self) -> Column:
        return F.col(f"`{self.column}`") if isinstance(self.column, str) else self.column


def time(alias: str, column: str, fmt: str) -> Key:
    """Groups by a formatted date or time; nulls are the group '<NULL>'."""
    return Key(alias, F.coalesce(F.date_format(F.col(f"`{column}`"), fmt), F.lit("<NULL>")))


def between(column: str, low: object, high: object) -> Column:
    """An inclusive range, as a condition."""
    return F.col(f"`{column}`").between(F.lit(low), F.lit(high))


@dataclass(frozen=True)
class Function:
    """An aggregate ``name`` of ``columns``, over the rows where ``condition`` holds.

    CUSTOM takes ``build``, which makes the aggregate column from the input columns (a grouped-aggregate Pandas UDF will
    do). ROWID numbers the groups from ``start``.
    """

    name: str
    columns: Sequence[str] = ("*",)
    alias: str | None = None
    condition: Column | None = None
    build: Callable[..., Column] | None = None
    start: int = 1

    @property
    def output(self) -> str:
        return self.alias or f"{self.name.lower()}({', '.join(self.columns)})"


def _checked(total: Column, n: Column, none: Column) -> Column:
    """A sum or mean of n numbers; where it overflowed to null although there are some, an error."""
    return F.when(n == 0, none).otherwise(F.coalesce(total, F.raise_error(F.lit("SUM or AVG has more than 38 digits")).cast(f"decimal(38,{SCALE})")))


def _sum(c: Column, k: T.DataType, _: Column) -> Column:
    x = exact(c, k)
    return _checked(F.floor(F.sum(x), F.lit(SCALE)).cast(f"decimal(38,{SCALE})"), F.count(x), F.lit(0).cast(f"decimal(38,{SCALE})"))


def _avg(c: Column, k: T.DataType, _: Column) -> Column:
    x = exact(c, k)
    return _checked(F.round(F.avg(x), SCALE).cast(f"decimal(38,{SCALE})"), F.count(x), F.lit(None).cast(f"decimal(38,{SCALE})"))


def _avg0(c: Column, k: T.DataType, o: Column) -> Column:
    """A mean in which nulls count as zeros; of nothing, 0."""
    x = F.coalesce(exact(c, k), F.lit(0).cast(f"decimal(38,{EXACT})"))
    return _checked(F.round(F.avg(x), SCALE).cast(f"decimal(38,{SCALE})"), F.count(x), F.lit(0).cast(f"decimal(38,{SCALE})"))


def _hashable(c: Column, k: T.DataType) -> Column:
    return c if isinstance(k, T.IntegerType | T.LongType | T.StringType | T.BinaryType) else c.cast("string")


#: One-column functions: (column, its type, row order) to an aggregate; nulls are left out.
SIMPLE: dict[str, Callable[[Column, T.DataType, Column], Column]] = {
    "SUM": _sum,
    "AVG": _avg,
    "AVG0": _avg0,
    "MIN": lambda c, k, o: F.min(c),
    "MAX": lambda c, k, o: F.max(c),
    "FIRST": lambda c, k, o: F.min_by(c, F.when(c.isNotNull(), o)),
    "LAST": lambda c, k, o: F.max_by(c, F.when(c.isNotNull(), o)),
    "DISTINCT_SET": lambda c, k, o: F.array_sort(F.collect_set(c)),
    "DISTINCT_APPROX_COUNT": lambda c, k, o: F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(_hashable(c, k), HLL_BITS)), F.lit(0).cast("bigint")),
    "DISTINCT_APPROX_SKETCH": lambda c, k, o: F.hll_sketch_agg(_hashable(c, k), HLL_BITS),
    "DISTINCT_APPROX_COUNT_SUM": lambda c, k, o: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0).cast("bigint")),
    "DISTINCT_ROARING_BITMAP_COUNT": lambda c, k, o: F.count_distinct(c),
}
#: Counts of the numbers in stored bitmaps, of which a set has one for each bucket: takes the columns of bucket and bits.
BITMAP_SUM = "DISTINCT_ROARING_BITMAP_SUM"
SYNONYMS = {"DISTINCT_HLL_COUNT": "DISTINCT_APPROX_COUNT", "HLL_COUNT": "DISTINCT_APPROX_COUNT", "HLL_SUM": "DISTINCT_APPROX_COUNT_SUM"}
NAMES = {*SIMPLE, *SYNONYMS, BITMAP_SUM, "COUNT", "DISTINCT_COUNT", "ZERO", "NULL", "ROWID", "HASH", "CUSTOM"}


def column_of(f: Function, find: Callable[[str], tuple[Column, T.DataType]], order: Column) -> Column:
    """The aggregate column of a function; ``order`` is the order of rows for FIRST, LAST and HASH."""
    name = SYNONYMS.get(f.name.upper(), f.name.upper())
    keep = (lambda c: c) if f.condition is None else (lambda c: F.when(f.condition, c))
    if name == "COUNT":  # COUNT(column) counts rows, whatever the column holds
        for c in f.columns:
            if c not in ("*", "1", "0"):
                find(c)
        return F.count(keep(F.lit(1)))
    if name in ("ZERO", "NULL"):
        return F.max(F.lit(0 if name == "ZERO" else None))
    if name == "ROWID":
        return F.max(F.lit(None).cast("bigint"))
    cols = [find(c) for c in f.columns]
    if name == "DISTINCT_COUNT":  # a null counts as a value
        return F.count_distinct(keep(F.struct(*[c.alias(f"c{k}") for k, (c, _) in enumerate(cols)])))
    if name == "HASH":  # of the group's last row
        text = F.concat(*[x for c, _ in cols for x in (F.lit("#"), F.coalesce(c.cast("string"), F.lit("null")))])
        return F.max_by(text, keep(order))
    if name == "CUSTOM" and f.build:
        return f.build(*[keep(c) for c, _ in cols])
    if name not in SIMPLE:
        raise EngineError("INVALID_OPERATION", f"no aggregate {f.name}")
    if len(cols) != 1:
        raise EngineError("COLUMN_MISMATCH", f"{name} takes one column")
    return SIMPLE[name](keep(cols[0][0]), cols[0][1], order)


def aggregate(df: DataFrame, keys: Sequence[Key | str], functions: Sequence[Function], order: Sequence[str] = (), sort_keys: bool = False) -> DataFrame:
    """Groups ``df`` and gives the keys, then the aggregates.

    ``order`` names columns that put rows in order for FIRST, LAST and HASH; without, and only if they are used, the
    order of the scan counts. ``sort_keys`` sorts the groups by their keys, nulls last. If every function has a condition, groups none of whose rows meets one do not appear.
    Everything is declarative, so Catalyst aggregates partially before the shuffle and prunes columns.
    """
    from ..plans.predicates import resolver

    keys = [k if isinstance(k, Key) else Key(k.lower(), k) for k in keys]
    ordered = any(f.name.upper() in ("FIRST", "LAST", "HASH") for f in functions)
    position = F.struct(*[F.col(f"`{c}`") for c in order]) if order else F.col("_position")
    if ordered and not order:
        df = df.withColumn("_position", F.monotonically_increasing_id())
    find = resolver(df.schema)
    if functions and all(f.condition is not None for f in functions):
        met = functions[0].condition
        for f in functions[1:]:
            met = met | f.condition
        df = df.filter(met)
    stored = [f for f in functions if f.name.upper() == BITMAP_SUM]
    others = [f for f in functions if f not in stored]
    grouped = [k.value().alias(k.alias) for k in keys]
    out = df.groupBy(*grouped).agg(*[column_of(f, find, position).alias(f.output) for f in others]) if others or not stored else None
    for f in stored:
        counted = _bitmap_sum(df, grouped, [k.alias for k in keys], f, find)
        if out is None:
            out = counted
        else:
            test = F.lit(True)
            for k in keys:
                test = test & out[k.alias].eqNullSafe(counted[k.alias])
            out = out.join(counted, test).select(*[out[c] for c in out.columns], counted[f.output])  # one row for each group on either side
    if stored:
        out = out.select(*[F.col(f"`{k.alias}`") for k in keys], *[F.col(f"`{f.output}`") for f in functions])
    for f in functions:
        if f.name.upper() == "HASH":
            out = out.withColumn(f.output, kernels.murmur64(F.col(f"`{f.output}`")))
        elif f.name.upper() == "ROWID":  # one row for each group is numbered, not the input
            out = out.withColumn(f.output, (F.row_number().over(Window.orderBy(*[F.col(f"`{k.alias}`").asc_nulls_last() for k in keys] or [F.lit(1)])) - 1 + f.start).cast("bigint"))
    return out.orderBy(*[F.col(f"`{k.alias}`").asc_nulls_last() for k in keys]) if sort_keys and keys else out


def _bitmap_sum(df: DataFrame, grouped: Sequence[Column], keys: Sequence[str], f: Function, find: Callable[[str], tuple[Column, T.DataType]]) -> DataFrame:
    """Bitmaps of one bucket are united, then the buckets' counts summed up; bits are words as of bitmaps.build, or binary."""
    if len(f.columns) != 2:
        raise EngineError("COLUMN_MISMATCH", f"{f.name} takes the columns of bucket and bits")
    (bucket, _), (bits, kind) = (find(c) for c in f.columns)
    unite, count = (F.bitmap_or_agg, F.bitmap_count) if isinstance(kind, T.BinaryType) else (F.bit_or, F.bit_count)
    bits = bits if f.condition is None else F.when(f.condition, bits)
    united = df.groupBy(*grouped, bucket.alias("_bucket")).agg(unite(bits).alias("_bits"))
    return united.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.coalesce(F.sum(count("_bits")), F.lit(0)).cast("bigint").alias(f.output))


def bitmap_distinct(df: DataFrame, keys: Sequence[str], column: str, alias: str) -> DataFrame:
    """Exact distinct counts of an integer column by bitmaps, merged by their bucket."""
    return bitmaps.counts(bitmaps.build(df, keys, column), alias)
