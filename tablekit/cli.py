"""Command line: python -m tablekit.cli -sql "..." or -f script.sql."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterable, Sequence
from itertools import chain, islice

from pyspark.sql import Row, SparkSession

from .engine import Engine
from .errors import EngineError
from .plans.lexer import statements

VERSION = "1.0"


def shown(value: object) -> str:
    if value is None:
        return "\\N"
    return value.hex() if isinstance(value, bytes | bytearray) else str(value)


def lines(columns: Sequence[str], rows: Iterable[Row], head: bool = True, numbers: bool = False) -> Iterable[str]:
    """Tab-separated lines."""
    if head:
        yield "\t".join([*["#"] * numbers, *columns])
    for k, r in enumerate(rows, 1):
        yield "\t".join([*[str(k)] * numbers, *map(shown, r)])


#: Rows whose cells set the widths of a table with borders; wider cells further on stick out.
MEASURED = 1000


def pretty(columns: Sequence[str], rows: Iterable[Row], head: bool = True, numbers: bool = False) -> Iterable[str]:
    """A table with borders, as wide as the cells of its first rows; only these are held."""
    table = (line.split("\t") for line in lines(columns, rows, True, numbers))
    first = list(islice(table, MEASURED + 1))
    width = [max(len(r[k]) for r in first) for k in range(len(first[0]))]
    border = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    yield border
    for k, r in enumerate(chain(first, table)):
        if k or head:
            yield "| " + " | ".join(c.ljust(w) for c, w in zip(r, width)) + " |"
        if k == 0 and head:
            yield border
    yield border


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    p = argparse.ArgumentParser(prog="tablekit", description=__doc__)
    p.add_argument("-sql", help="statements, separated by semicolons")
    p.add_argument("-f", help="a file of statements")
    for flag, text in (("-pretty", "tables with borders"), ("-nohead", "no column names"), ("-rownum", "number the rows"), ("-status", "rows and seconds after each statement")):
        p.add_argument(flag, action="store_true", help=text)
    p.add_argument("-log", help="Spark's log level", default="ERROR")
    p.add_argument("-version", action="version", version=VERSION)
    o = p.parse_args(args)
    out = out or sys.stdout
    script = o.sql or (open(o.f).read() if o.f else None)
    if not script:
        p.print_help(out)
        return 2
    spark = spark or SparkSession.builder.appName("tablekit").getOrCreate()
    spark.sparkContext.setLogLevel(o.log)
    engine = Engine(spark)
    for s in statements(script):
        began, n = time.time(), 0
        try:
            df = engine.sql(s)

            def counted():
                nonlocal n
                for r in df.toLocalIterator():
                    n += 1
                    yield r

            for line in (pretty if o.pretty else lines)(df.columns, counted(), not o.nohead, o.rownum):
                print(line, file=out)
        except EngineError as e:
            print(f"error {e.code}: {e}", file=sys.stderr)
            return 1
        if o.status:
            print(f"{n} rows, {time.time() - began:.2f} s", file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
