"""Conditions as Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError, SqlSyntaxError
from ..types import ColumnType
from .ast import And, Between, Compare, InList, IsNull, Literal, Not, Or

Resolve = Callable[[str], tuple[Column, T.DataType]]


def resolver(schema: T.StructType, columns: Callable[[str], Column] = F.col) -> Resolve:
    """Finds columns whatever the case of their names."""
    known = {f.name.lower(): f for f in schema}

    def find(name: str) -> tuple[Column, T.DataType]:
        f = known.get(name.lower())
        if f is None:
            raise EngineError("COLUMN_MISMATCH", f"no column {name}")
        return columns(f"`{f.name}`"), f.dataType

    return find


def constant(value: Literal, kind: T.DataType) -> Column:
    """A constant in a column's type, so that the comparison reaches the scan."""
    if value.value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.IntegralType) and not value.quoted and not value.value.lstrip("+-").isdigit():
        return F.lit(value.value).try_cast("double")
    if isinstance(kind, T.DecimalType):
        return F.lit(value.value).try_cast(f"decimal(38,{max(kind.scale, 10)})")
    if isinstance(kind, T.StringType):
        return F.lit(value.value)
    if isinstance(kind, T.DoubleType | T.FloatType | T.IntegralType):
        return F.lit(value.value).try_cast(kind)
    return ColumnType.from_spark(kind).cast(F.lit(value.value), T.StringType())


def pattern(text: str) -> str:
    """LIKE with * at either end for %."""
    text = "%" + text[1:] if text.startswith("*") else text
    return text[:-1] + "%" if text.endswith("*") and len(text) > 1 else text


def predicate(node: Any, find: Resolve) -> Column:
    """The condition as a column.

    = and IN hold for two nulls and <> for a null on one side, as null is a value there; with <, <=, >, >=, LIKE and
    BETWEEN a null does not match. NOT turns what does not match into what does. AND binds more closely than OR.
    """
    match node:
        case And(terms):
            out = predicate(terms[0], find)
            for t in terms[1:]:
                out = out & predicate(t, find)
            return out
        case Or(terms):
            out = predicate(terms[0], find)
            for t in terms[1:]:
                out = out | predicate(t, find)
            return out
        case Not(term):
            return ~F.coalesce(predicate(term, find), F.lit(False))
        case IsNull(column):
            return find(column)[0].isNull()
        case InList(column, values):
            col, kind = find(column)
            known = [constant(v, kind) for v in values if v.value is not None]
            out = col.isin(known) if known else F.lit(False)
            return out | col.isNull() if len(known) < len(values) else out
        case Between(column, low, high):
            col, kind = find(column)
            return col.between(constant(low, kind), constant(high, kind))
        case Compare(column, op, value):
            col, kind = find(column)
            if op == "LIKE":
                text = col if isinstance(kind, T.StringType) else col.cast("string")
                return text.like(pattern(value.value or ""))
            if value.value is None:
                if op in ("=", "!=", "<>"):
                    return col.isNull() if op == "=" else col.isNotNull()
                return F.lit(False)
            const = constant(value, kind)
            match op:
                case "=":
                    return col == const
                case "!=" | "<>":
                    return col.isNull() | (col != const)
                case "<":
                    return col < const
                case "<=":
                    return col <= const
                case ">":
                    return col > const
                case ">=":
                    return col >= const
    raise SqlSyntaxError(f"not a condition: {node!r}")



