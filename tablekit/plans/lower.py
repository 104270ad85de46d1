"""SELECT as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError, SqlSyntaxError
from ..functions.aggregates import NAMES, Function, Key, aggregate
from ..schema import Meta
from .ast import Select
from .predicates import predicate, resolver


def ordered(df: DataFrame, keys: list[tuple[str, bool]], stable: bool = False) -> DataFrame:
    """ORDER BY: null is the smallest value; ``stable``: rows of equal keys stay in the order of the scan."""
    find = resolver(df.schema)
    columns = [find(k)[0].desc_nulls_last() if down else find(k)[0].asc_nulls_first() for k, down in keys]
    if not stable:
        return df.orderBy(*columns)
    return df.withColumn("_scanned", F.monotonically_increasing_id()).orderBy(*columns, "_scanned").drop("_scanned")


def limited(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """LIMIT offset, n; a negative n is no limit."""
    df = df.offset(offset) if offset > 0 else df
    return df.limit(limit) if limit >= 0 else df


def scanned(df: DataFrame, meta: Meta | None, q: Select) -> DataFrame:
    """The filtered rows; an index hint gives them the order of the index's keys, nulls last."""
    if q.where is not None:
        df = df.filter(predicate(q.where, resolver(df.schema)))
    if q.index is not None:
        if meta is None:
            raise EngineError("NO_INDEXES", q.table)
        keys = [F.col(f"`{k}`") for k in meta.index(q.index).keys]
        if not q.order_by:
            df = df.orderBy(*[k.desc_nulls_first() if q.descending else k.asc_nulls_last() for k in keys])
    return df


def aggregated(df: DataFrame, meta: Meta | None, q: Select) -> DataFrame:
    if q.star:
        raise SqlSyntaxError("* cannot be selected with GROUP BY or aggregates")
    keys = [Key(next((i.name for i in q.items if i.column == g and i.alias), g), g) for g in q.group_by]
    find = resolver(df.schema)
    for i in q.items:
        if i.function is None and i.column not in q.group_by:
            raise EngineError("COLUMN_MISMATCH", f"{i.column} is neither grouped nor aggregated")
        if i.function and i.function not in NAMES:
            raise EngineError("INVALID_OPERATION", f"no aggregate {i.function}")
    for g in q.group_by:
        find(g)
    functions = [Function(i.function, i.arguments or ("*",), i.name) for i in q.items if i.function]
    order = meta.primary_key if meta is not None and meta.indexes else ()
    out = aggregate(df, keys, functions, order)
    if q.having is not None:
        by_text = {i.text.lower(): i.name for i in q.items if i.function}
        plain = resolver(out.schema)
        out = out.filter(predicate(q.having, lambda name: plain(by_text.get(name, name))))
    if q.order_by:
        by_text = {i.text.lower(): i.name for i in q.items if i.function}
        out = ordered(out, [(by_text.get(k, k), d) for k, d in q.order_by])
    return limited(out, q.offset, q.limit)


def select(df: DataFrame, meta: Meta | None, q: Select, stable: bool = False) -> DataFrame:
    """All clauses of a query over the rows of its table; everything after this is Catalyst's."""
    df = scanned(df, meta, q)
    if q.group_by or any(i.function for i in q.items):
        return aggregated(df, meta, q)
    if q.having is not None:
        raise SqlSyntaxError("HAVING needs GROUP BY or an aggregate")
    find = resolver(df.schema)
    picked = [find(i.column)[0].alias(i.name) for i in q.items]
    if q.distinct:
        df = (df if q.star else df.select(*picked)).dropDuplicates()
        return limited(ordered(df, q.order_by) if q.order_by else df, q.offset, q.limit)
    if q.order_by:
        df = ordered(df, q.order_by, stable)
    df = limited(df, q.offset, q.limit)
    return df if q.star else df.select(*picked)
