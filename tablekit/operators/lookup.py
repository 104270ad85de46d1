"""Semi- and anti-joins with another table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ast import Compare, Literal
from ..plans.parser import parse_find
from ..plans.predicates import predicate, resolver


def lookup(df: DataFrame, column: str, source: DataFrame, where: str, operator: str = "eq") -> DataFrame:
    """Keeps rows whose ``column`` is found (eq, exists) or not found (neq, not-exists) in ``source``.

    ``where`` is a find string with ``key = ?``; further conditions filter the source first. Rows with a null key are
    dropped either way. Without ``?`` the question is whether the source has any such row at all. Spark chooses between
    a broadcast and a shuffle by the size that the source turns out to have.
    """
    found = operator in ("eq", "exists", "=")
    condition = parse_find(where).where
    key, rest = _split(condition)
    rows = source.filter(predicate(rest, resolver(source.schema))) if rest is not None else source
    if key is None:
        keep = bool(rows.head(1)) == found
        return df if keep else df.limit(0)
    keys = rows.select(F.col(f"`{key}`").alias("_key")).filter(F.col("_key").isNotNull()).distinct()
    kept = df.filter(F.col(f"`{column}`").isNotNull())
    return kept.join(keys, kept[column] == keys["_key"], "left_semi" if found else "left_anti")


def _split(node: Any) -> tuple[str | None, Any]:
    """The column compared with ?, and the other conditions."""
    from ..plans.ast import And

    terms = list(node.terms) if isinstance(node, And) else [] if node is None else [node]
    keys = [t for t in terms if isinstance(t, Compare) and t.value == Literal("?")]
    rest = [t for t in terms if t not in keys]
    return (keys[0].column if keys else None), (None if not rest else rest[0] if len(rest) == 1 else And(tuple(rest)))
