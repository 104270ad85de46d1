"""Registered queries of files, catalogue, changes, pipelines, JDBC, streaming and tools; see queries.py."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterable
from datetime import date

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import cli, webui
from .engine import Engine
from .errors import CODES, EngineError
from .functions import bitmaps, decimals, kernels
from .functions.aggregates import Function, aggregate, between
from .operators import pipeline
from .operators.lookup import lookup
from .queries import _CUSTOMER, ORACLE_SQL, SUM, _customers, query, registered, table
from .schema import Meta
from .sources import registry, text, union
from .sources.paths import date_in_name, file_system, scratch, write_text
from .streaming import files as stream_files
from .types import ColumnType


def literal_rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A few rows made in the driver."""
    return spark.createDataFrame(list(rows), schema)


def values(rows: Iterable[tuple], columns: str) -> str:
    """The same rows as SQL."""
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({columns})"


def code_of(work: Callable[[], object]) -> int:
    """The error code that ``work`` ends with; 0 without one."""
    try:
        work()
        return 0
    except EngineError as e:
        return e.code


# -- formats and files

_NAMES = [("a.tbl.gz", "tsv"), ("b.parquet", "parquet"), ("c.union", "union"), (f"d{registry.NATIVE}", "native"), ("e.gz", "tsv"), ("f.csv.zip#x.csv", "csv"), ("g.jsonl", "jsonl"), ("H.CSV", "csv"), ("jdbc:h2:mem", "jdbc")]


@registered(values(_NAMES, "path, format"))
def format_names(spark: SparkSession, d: str) -> DataFrame:
    return literal_rows(spark, [(p, registry.format_of(p)) for p, _ in _NAMES], "path string, format string")


def _text_of(spark: SparkSession, d: str, name: str, suffix: str, **options: str) -> str:
    """A table's rows in a text file with a description."""
    path, df = scratch(spark, f"{name}.{suffix}"), table(spark, d, name)
    meta = Meta.from_spark(name, df.schema)
    meta.options = options
    registry.write_file(spark, df, path, meta)
    return path


@registered("SELECT * FROM supplier")
def dialect_custom(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark).open(_text_of(spark, d, "supplier", "tbl", DELIMITER="|", HEADER="ABSENT", NULL="-"))


class _Out(io.RawIOBase):
    """What is written goes to a file of a Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        fs, p = file_system(spark, path)
        self.stream = fs.create(p, True)

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytearray(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()


def _zip(spark: SparkSession, d: str) -> str:
    """part as the second of two entries of an archive, written as its rows come."""
    path, part = scratch(spark, "part.csv.zip"), table(spark, d, "part")

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(["".join(f"{x}\n" for x in batch.column(0).to_pylist())])], ["lines"])

    lines = part.select(text.line_of(part, text.Dialect(",", '"', "NULL"))).mapInArrow(joined, "lines string").toLocalIterator()
    with io.BufferedWriter(_Out(spark, path), 1 << 20) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("sizes.csv", "p_size\n1\n2\n")
        with z.open("part.csv", "w", force_zip64=True) as entry:
            entry.write(f"{','.join(part.columns)}\n".encode())
            for some in lines:
                entry.write(some.lines.encode())
    return path


@registered("SELECT '1' AS p_size UNION ALL SELECT '2'")
def zip_first_entry(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark).open(_zip(spark, d))


@registered("SELECT p_partkey, p_name, p_retailprice FROM part")
def zip_named_entry(spark: SparkSession, d: str) -> DataFrame:
    part = Engine(spark).open(f"{_zip(spark, d)}#part.csv")
    return part.select(F.col("p_partkey").cast("bigint"), "p_name", F.col("p_retailprice").cast("double"))


@registered("SELECT * FROM part")
def gz_sibling(spark: SparkSession, d: str) -> DataFrame:
    """a.tsv is opened where only a.tsv.gz is."""
    return Engine(spark).open(_text_of(spark, d, "part", "tsv.gz").removesuffix(".gz"))


_ODD = "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'odd' WHEN 2 THEN NULL WHEN 3 THEN '\\n' ELSE p_name || chr(9) || chr(10) || '\\\\' || chr(65535) END"


@registered(f"SELECT {_ODD} AS odd FROM part")
def roundtrip_tsv_odd(spark: SparkSession, d: str) -> DataFrame:
    """Rows equal to the header, empty, null, escapes and a code point without a character, in a file of one column."""
    path, key = scratch(spark, "odd.tsv"), F.col("p_partkey") % 5
    odd = F.when(key == 0, "").when(key == 1, "odd").when(key == 3, "\\n").when(key == 4, F.concat("p_name", F.lit("\t\n\\\\￿")))
    registry.write_file(spark, table(spark, d, "part").select(odd.alias("odd")), path)
    return Engine(spark).open(path)


@registered("SELECT *, s_acctbal < 0 AS owes FROM supplier")
def plugin_format(spark: SparkSession, d: str) -> DataFrame:
    """A format of one's own: <file>.owing tells who is in debt."""
    own = registry.Plugin("owing", lambda p: p.endswith(".owing"), lambda s, p, m: s.read.parquet(p.removesuffix(".owing")).withColumn("owes", F.col("s_acctbal") < 0), priority=9)
    registry.register(own)
    try:
        return Engine(spark).sql(f"SELECT * FROM {d}/supplier.parquet.owing")
    finally:
        registry.PLUGINS.remove(own)


def _years(spark: SparkSession, d: str) -> str:
    """Orders in one sorted file for each year, named by the year's first day, and one for those without a date."""
    base, orders = scratch(spark, "years"), table(spark, d, "orders")
    for (y,) in orders.select(F.coalesce(F.year("o_orderdate"), F.lit(0))).distinct().collect():  # one row for each year
        own = orders.filter(F.coalesce(F.year("o_orderdate"), F.lit(0)) == y)
        registry.write_file(spark, own.coalesce(1).sortWithinPartitions("o_orderkey"), f"{base}/orders_{y:04}0101.parquet")
    return base


@registered("SELECT o_orderkey, year(o_orderdate) AS y FROM orders ORDER BY y DESC NULLS LAST, o_orderkey LIMIT 5000")
def union_ordered(spark: SparkSession, d: str) -> DataFrame:
    """File by file, the last year first, rows in their files' order."""
    found = registry.read_union(spark, union.Descriptor(_years(spark, d), r"orders_\d+\.parquet", 1, "desc"), ordered=True)
    return found.limit(5000).select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("y"))


@registered("SELECT * FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999")
def union_date_in_name(spark: SparkSession, d: str) -> DataFrame:
    return registry.read_union(spark, union.Descriptor(_years(spark, d), r"orders_\d+\.parquet", 1), date_in_name(date(1996, 1, 1), date(1999, 12, 31)))


@registered("SELECT count(*) AS n, -9000 AS code FROM orders")
def union_file(spark: SparkSession, d: str) -> DataFrame:
    """A .union file as a table, which takes no rows."""
    base, engine = _years(spark, d), Engine(spark)
    write_text(spark, f"{base}/all.union", "directory=.\npattern=orders_\\d+\\.parquet\nmax_depth=1\nsort=asc\n")
    code = code_of(lambda: engine.sql(f"INSERT INTO {base}/all.union VALUES (1)"))
    return engine.sql(f"SELECT COUNT(*) AS n FROM {base}/all.union").select("n", F.lit(code).alias("code"))


# -- reading tables


@registered("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def traverse(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    return spark.createDataFrame(list(engine.traverse(f"{d}/nation.parquet")), engine.open(f"{d}/nation.parquet").schema)


@registered("SELECT count(*) AS n FROM lineitem")
def row_count(spark: SparkSession, d: str) -> DataFrame:
    return literal_rows(spark, [(Engine(spark).rows(f"{d}/lineitem.parquet"),)], "n bigint")


@registered(_CUSTOMER + " WHERE c_custkey BETWEEN 20 AND 90 ORDER BY c_custkey LIMIT 40")
def index_range_asc(spark: SparkSession, d: str) -> DataFrame:
    engine, path = _customers(spark, d)
    return engine.find(path, "USE INDEX(PRIMARY ASC) WHERE c_custkey >= 20 AND c_custkey <= 90 LIMIT 40")


query("agg_default_names", "SELECT COUNT(*), SUM(l_quantity), l_linestatus FROM {d}/lineitem.parquet GROUP BY l_linestatus", f'SELECT l_linestatus, count(*) AS "count(*)", {SUM.format("l_quantity")} AS "sum(l_quantity)" FROM lineitem GROUP BY l_linestatus')
query("agg_bitmap_count_sql", "SELECT event_type, DISTINCT_ROARING_BITMAP_COUNT(user_id) AS users FROM {d}/events.parquet GROUP BY event_type", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
query("filter_literal_types", "SELECT o_orderkey FROM {d}/orders.parquet WHERE o_orderdate >= '1998-01-01 00:00:00' AND o_totalprice < 1.5e5 AND o_orderkey != -1 AND o_orderpriority LIKE '1*'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_totalprice < 150000 AND o_orderkey <> -1 AND o_orderpriority LIKE '1%'")


@registered("SELECT c_custkey, c_name, c_mktsegment AS segment FROM customer WHERE c_nationkey < 5")
def quoted_names(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark).sql(f'SELECT `c_custkey`, "c_name", "c_mktsegment" AS "segment" FROM "{d}/customer.parquet" WHERE `c_nationkey` < 5')


def _nulls(spark: SparkSession, d: str) -> str:
    path = scratch(spark, "nulls.parquet")
    table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_size")).alias("p_size"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("p_name")).write.parquet(path)
    return path


_NULLS = "(SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS p_size, CASE WHEN p_size % 2 = 0 THEN p_name END AS p_name FROM part)"
for _name, _where, _duck in (
    ("eq", "p_size = NULL", "p_size IS NULL"), ("ne", "p_size <> NULL", "p_size IS NOT NULL"), ("ne_value", "p_size != 30", "p_size IS DISTINCT FROM 30"), ("in", "p_size IN (30, NULL)", "p_size = 30 OR p_size IS NULL"),
    ("range", "p_size < 40", "p_size < 40"), ("like", "p_name LIKE '*r*'", "p_name LIKE '%r%'"), ("not", "NOT p_size < 40", "coalesce(p_size < 40, false) = false"), ("is", "p_name IS NULL AND p_size IS NOT NULL", "p_name IS NULL AND p_size IS NOT NULL"),
):
    registered(f"SELECT p_partkey, p_size, p_name FROM {_NULLS} WHERE {_duck}", f"null_{_name}")(lambda spark, d, where=_where: Engine(spark).sql(f"SELECT p_partkey, p_size, p_name FROM {_nulls(spark, d)} WHERE {where}"))


_REFUSED = [
    ("SELECT *, COUNT(*) FROM {t} GROUP BY c_name", -9000), ("SELECT * FROM {t} GROUP BY c_name", -9000), ("SELECT nothing FROM {t}", -2000), ("SELECT MEDIAN(c_custkey) FROM {t}", -9000), ("ALTER TABLE {t} ADD x INT", -9000), ("SELECT c_name FROM {t} HAVING c_name > 1", -9000),
    ("SELECT c_name FROM {t} WHERE c_custkey = c_nationkey + 1", -9000), ("SELECT c_name FROM {t} c_custkey = 1", -9000), ("SELECT c_name FROM {t} WHERE c_custkey == 1", -9000), ("SELECT c_name FROM {t} WHERE c_custkey =", -9000), ("DELETE FROM {t}", -9000), ("DELETE FROM {t} WHERE c_custkey = 1 LIMIT 5", -9000),
    ("UPDATE {t} SET c_name = 'x' WHERE c_custkey = 1 ORDER BY c_name", -9000), ("SELECT c_name FROM {t} CONNECT(a, b)", -9000), ("SELECT c_name FROM nowhere.parquet", -3000), ("SELECT c_name FROM x.exe", -2002), ("CREATE TABLE t.csv (a INT, PRIMARY KEY (a))", -9000), ("CREATE TABLE t" + registry.NATIVE + " (a BLOB)", -2002),
    ("CREATE TABLE t" + registry.NATIVE + " (a INT, PRIMARY KEY (b))", -2000),
]


@registered(values([(k, s.split(" FROM")[0], c) for k, (s, c) in enumerate(_REFUSED)], "k, statement, code"))
def refused_statements(spark: SparkSession, d: str) -> DataFrame:
    """Statements that must end in an error, and its code."""
    engine = Engine(spark)
    found = [(k, s.split(" FROM")[0], code_of(lambda s=s: engine.sql(s.format(t=f"{d}/customer.parquet")).count())) for k, (s, _) in enumerate(_REFUSED)]
    return literal_rows(spark, found, "k int, statement string, code int")


@registered(values([(-1, "NOT_FOUND"), (-1000, "DUPLICATE_KEY"), (-1001, "UNIQUE_CONSTRAINT_VIOLATION"), (-1002, "FOREIGN_KEY_VIOLATION"), (-1003, "CHECK_CONSTRAINT_VIOLATION"), (-2000, "COLUMN_MISMATCH"), (-2001, "ROW_BYTES_EXCEEDED"), (-2002, "INVALID_DATA_TYPE"), (-3000, "TABLE_NOT_FOUND"), (-3001, "INDEX_NOT_FOUND"), (-3002, "NO_INDEXES"), (-4000, "STORAGE_READ_ERROR"), (-4001, "STORAGE_WRITE_ERROR"), (-4002, "STORAGE_DELETE_ERROR"), (-4003, "STORAGE_FULL"), (-5000, "LOCK_TIMEOUT"), (-5001, "DEADLOCK_DETECTED"), (-5002, "TRANSACTION_FAILED"), (-5003, "TRANSACTION_NOT_STARTED"), (-9000, "INVALID_OPERATION"), (-9001, "RESOURCE_NOT_AVAILABLE"), (-9002, "INTERNAL_ERROR")], "code, name"))
def error_codes(spark: SparkSession, d: str) -> DataFrame:
    return literal_rows(spark, [(EngineError(name).code, name) for name, _ in CODES.values()], "code int, name string")


@registered("SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER () AS r FROM orders) ORDER BY o_orderpriority NULLS FIRST, r LIMIT 2000")
def order_stable(spark: SparkSession, d: str) -> DataFrame:
    """Rows of equal keys stay in the order of the input."""
    return Engine(spark, stable=True).sql(f"SELECT o_orderpriority, o_orderkey FROM {d}/orders.parquet ORDER BY o_orderpriority LIMIT 2000")


# -- aggregates


@registered("SELECT l_returnflag, CAST(sum(CAST(l_quantity AS HUGEINT) * 1000000000000000000) AS DECIMAL(38,5)) AS total, CAST(floor(CAST(sum(CAST(l_quantity AS HUGEINT)) AS DECIMAL(38,0)) / 1) AS DECIMAL(38,5)) AS plain FROM lineitem GROUP BY l_returnflag")
def agg_sum_wide(spark: SparkSession, d: str) -> DataFrame:
    """Doubles of 1e18 and more are summed up exactly."""
    wide = table(spark, d, "lineitem").withColumn("wide", F.col("l_quantity") * 1e18)
    return aggregate(wide, ["l_returnflag"], [Function("SUM", ["wide"], "total"), Function("SUM", ["l_quantity"], "plain")])


@registered("SELECT p_brand, CAST(round(sum(CASE WHEN p_size > 25 THEN p_size ELSE 0 END) * 100000.0 / count(*)) / 100000 AS DECIMAL(38,5)) AS mean FROM part GROUP BY p_brand")
def agg_avg_null_as_zero(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumn("size", F.when(F.col("p_size") > 25, F.col("p_size")))
    return aggregate(part, ["p_brand"], [Function("AVG0", ["size"], "mean")])


@registered("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def agg_bitmap_sum(spark: SparkSession, d: str) -> DataFrame:
    """Stored bitmaps of each day, united by bucket; ids are spread over many buckets."""
    events = table(spark, d, "events").withColumn("id", F.col("user_id") * 40_000).withColumn("day", F.to_date("ts"))
    return aggregate(bitmaps.build(events, ["event_type", "day"], "id"), ["event_type"], [Function("DISTINCT_ROARING_BITMAP_SUM", ["bucket", "bits"], "users")])


_M64 = "18446744073709551616"
_MURMUR = f"""
WITH g AS (SELECT DISTINCT l_returnflag, l_linestatus, 35 + ascii(l_returnflag) * 256 + 35 * 65536 + ascii(l_linestatus) * 16777216 AS w FROM lineitem),
a AS (SELECT *, (xor(xor(2538058380::UBIGINT, (4::UHUGEINT * 14313749767032793493 % {_M64})::UBIGINT), w::UBIGINT)::UHUGEINT * 14313749767032793493 % {_M64})::UBIGINT AS x FROM g),
b AS (SELECT l_returnflag, l_linestatus, (xor(x, x >> 47)::UHUGEINT * 14313749767032793493 % {_M64})::UBIGINT AS x FROM a),
c AS (SELECT l_returnflag, l_linestatus, xor(x, x >> 47) AS x FROM b)
SELECT l_returnflag, l_linestatus, (CASE WHEN x >= 9223372036854775808 THEN x::HUGEINT - {_M64}::HUGEINT ELSE x::HUGEINT END)::BIGINT AS hash FROM c"""


@registered(_MURMUR)
def agg_hash(spark: SparkSession, d: str) -> DataFrame:
    return aggregate(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], [Function("HASH", ["l_returnflag", "l_linestatus"], "hash")], order=["l_orderkey"])


@F.pandas_udf(T.LongType())
def above_median(v: pd.Series) -> int:
    """How many values are above the median."""
    return int((v > v.median()).sum())


@registered("SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > middle) AS above FROM (SELECT *, median(o_totalprice) OVER (PARTITION BY o_orderstatus) AS middle FROM orders) GROUP BY o_orderstatus")
def agg_udaf(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate function of the user's."""
    return aggregate(table(spark, d, "orders"), ["o_orderstatus"], [Function("CUSTOM", ["o_totalprice"], "above", build=above_median)])


@registered("SELECT l_shipmode, n, mid FROM (SELECT l_linestatus AS l_shipmode, count(*) AS n, count(*) FILTER (WHERE l_quantity BETWEEN 10 AND 20) AS mid FROM lineitem GROUP BY l_linestatus)")
def agg_between(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumnRenamed("l_linestatus", "l_shipmode")
    return aggregate(lines, ["l_shipmode"], [Function("COUNT", alias="n"), Function("COUNT", alias="mid", condition=between("l_quantity", 10, 20))])


@registered("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY o_custkey NULLS LAST LIMIT 30")
def group_order(spark: SparkSession, d: str) -> DataFrame:
    """Groups in the order of their keys."""
    return aggregate(table(spark, d, "orders"), ["o_custkey"], [Function("COUNT", alias="n")], sort_keys=True).limit(30)


@registered(f"SELECT l_returnflag, count(*) AS n, {SUM.format('l_quantity')} AS total FROM lineitem GROUP BY l_returnflag")
def agg_into_tsv(spark: SparkSession, d: str) -> DataFrame:
    engine, path = Engine(spark), scratch(spark, "sums.tsv")
    engine.sql(f"SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS total INTO {path} FROM {d}/lineitem.parquet GROUP BY l_returnflag")
    return engine.open(path)


@registered("SELECT o_orderkey FROM orders WHERE (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') > 0")
def lookup_constant(spark: SparkSession, d: str) -> DataFrame:
    """Without a key the question is whether the other table has any such row."""
    return lookup(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer"), "WHERE c_mktsegment = 'BUILDING'").select("o_orderkey")


# -- values


@registered("SELECT p_partkey, CAST(cents * 10 // p_size AS DECIMAL(38,3)) / 1000 AS each, CAST(-(cents // 7) AS DECIMAL(38,2)) / 100 AS seventh FROM (SELECT p_partkey, p_size, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part WHERE p_size > 0)")
def decimal_divide(spark: SparkSession, d: str) -> DataFrame:
    """Quotients cut off toward zero."""
    price, part = F.col("p_retailprice").cast("decimal(12,2)"), table(spark, d, "part").filter("p_size > 0")
    return part.select("p_partkey", decimals.divide(price, F.col("p_size").cast("decimal(10,0)"), 3).cast("double").alias("each"), decimals.divide_by_int(-price, F.lit(7), 2).cast("double").alias("seventh"))


_FNV = f"list_reduce(list_prepend(14695981039346656037::UBIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::UBIGINT)), lambda h, b: (xor(h, b)::UHUGEINT * 1099511628211 % {_M64})::UBIGINT)"
_JAVA = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: (h * 31 + b) % 4294967296)"


@registered(f"SELECT c_custkey, (xor(h, h >> 32) & 9223372036854775807::UBIGINT)::BIGINT AS hash FROM (SELECT c_custkey, {_FNV} AS h FROM customer)")
def hash63(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", kernels.hash63("c_name").alias("hash"))


ORACLE_SQL["map_hash63"] = ORACLE_SQL["hash63"]


@registered(f"SELECT c_custkey, (CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)::INT AS hash FROM (SELECT c_custkey, {_JAVA} AS h FROM customer)")
def java_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", decimals.java_hash(F.col("c_name")).alias("hash"))


@registered("SELECT s_suppkey, '2001:db8::' || lower(to_hex(s_suppkey + 1)) AS address, '::ffff:10.0.0.' || (s_suppkey % 256) AS mapped FROM supplier")
def cast_ipv6(spark: SparkSession, d: str) -> DataFrame:
    """Texts as 16 bytes and back, in their shortest form."""
    kind, key = ColumnType("IPV6"), F.col("s_suppkey")
    six = F.concat(F.lit("2001:0db8:0:0:0:0:0:"), F.lower(F.hex(key + 1)))
    four = F.concat(F.lit("10.0.0."), (key % 256).cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", *[kernels.bytes_to_ipv6(kind.cast(t, T.StringType())).alias(n) for n, t in (("address", six), ("mapped", four))])


@registered("SELECT s_suppkey, regexp_replace(md5(s_name), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS id FROM supplier")
def cast_uuid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", kernels.bytes_to_uuid(ColumnType("UUID").cast(F.upper(F.md5("s_name")), T.StringType())).alias("id"))


@registered("SELECT s_suppkey, s_name AS decoded, NULL::BLOB AS broken FROM supplier")
def cast_hex_decode(spark: SparkSession, d: str) -> DataFrame:
    kind = ColumnType("BYTES")
    df = table(spark, d, "supplier").select("s_suppkey", F.hex("s_name").alias("h"))
    return df.select("s_suppkey", kind.cast(F.col("h"), T.StringType()).cast("string").alias("decoded"), kind.cast(F.concat("h", F.lit("xy")), T.StringType()).alias("broken"))


# -- changes


@registered("SELECT -1000 AS code, -1000 AS again, count(*) AS n FROM customer")
def insert_duplicate(spark: SparkSession, d: str) -> DataFrame:
    """A key that is there, or twice among the new rows, is refused and changes nothing."""
    engine, path = _customers(spark, d)
    codes = code_of(lambda: engine.sql(f"INSERT INTO {path} VALUES (3, 'x', 'y')")), code_of(lambda: engine.table(path).insert(engine.open(path).limit(1).withColumn("c_custkey", F.lit(-5).cast("bigint")).selectExpr("*", "explode(array(1, 2)) AS twice").drop("twice")))
    return literal_rows(spark, [(*codes, engine.rows(path))], "code int, again int, n bigint")


@registered(_CUSTOMER + " UNION ALL SELECT -7, 'Seven', 'BUILDING'")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    engine, path = _customers(spark, d)
    engine.sql(f"INSERT IGNORE INTO {path} VALUES (3, 'x', 'y')")
    engine.sql(f"INSERT IGNORE INTO {path} VALUES (-7, 'Seven', 'BUILDING')")
    return engine.open(path)


@registered("SELECT c_custkey AS id, c_name AS name FROM customer")
def table_temporary(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.sql("CREATE TEMPORARY TABLE @rows (id INT64 NOT NULL, name STRING(40), PRIMARY KEY (id))")
    engine.sql(f"INSERT INTO @rows (id, name) FROM {d}/customer.parquet")
    return engine.sql("SELECT * FROM @rows")


@registered("SELECT 1 AS dropped, -3000 AS code, 0 AS left_over")
def table_drop(spark: SparkSession, d: str) -> DataFrame:
    engine, path = _customers(spark, d)
    dropped = engine.sql(f"DROP TABLE {path}").head()[0]
    fs, p = file_system(spark, path)
    return literal_rows(spark, [(dropped, code_of(lambda: engine.rows(path)), int(fs.exists(p)))], "dropped int, code int, left_over int")


@registered(_CUSTOMER)
def table_compressor(spark: SparkSession, d: str) -> DataFrame:
    engine, path = Engine(spark), scratch(spark, f"packed{registry.NATIVE}")
    engine.sql(f"CREATE TABLE {path} (c_custkey INT64 NOT NULL, c_name STRING(40), c_mktsegment STRING(20), PRIMARY KEY (c_custkey)) COMPRESSOR=lz4")
    engine.sql(f"INSERT INTO {path} FROM {d}/customer.parquet")
    return engine.open(path)


_DDL = "CREATE TABLE customer" + registry.NATIVE + " (\n\tc_custkey INT64 NOT NULL,\n\tc_name STRING(40),\n\tc_mktsegment STRING(20),\n\tPRIMARY KEY (c_custkey)\n)"


_ORDERS_DDL = "CREATE TABLE orders.parquet (\n\to_orderkey INT64,\n\to_custkey INT64,\n\to_orderstatus STRING,\n\to_totalprice DOUBLE,\n\to_orderdate TIME,\n\to_orderpriority STRING\n)"
ORACLE_SQL["meta"] = values([(_ORDERS_DDL,)], "meta")


@registered(values([(_DDL,)], "meta"))
def meta_ddl(spark: SparkSession, d: str) -> DataFrame:
    engine, path = _customers(spark, d)
    return engine.sql(f"META {path}").select(F.regexp_replace("meta", "TABLE .*/", "TABLE ").alias("meta"))


@registered(_CUSTOMER + " UNION ALL SELECT -1, 'One', NULL")
def tx_failed_update(spark: SparkSession, d: str) -> DataFrame:
    """Within a transaction a failed change of keys leaves no trace, and what came before it is committed."""
    engine, path = _customers(spark, d)
    engine.sql(f"BEGIN TRANSACTION {path}")
    engine.sql(f"INSERT INTO {path} VALUES (-1, 'One', NULL)")
    for sql in (f"UPDATE {path} SET c_custkey = 1 WHERE c_custkey = 2", f"INSERT INTO {path} VALUES (4, 'x', 'y')", f"UPDATE {path} SET c_name = '{'x' * 41}' WHERE c_custkey = 5"):
        assert code_of(lambda sql=sql: engine.sql(sql)) < 0
    engine.sql(f"COMMIT {path}")
    return engine.open(path)


@registered(_CUSTOMER + " WHERE c_custkey <> 5 UNION ALL SELECT c_custkey + 1000000, c_name, c_mktsegment FROM customer WHERE c_custkey < 10")
def tx_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows changed through the table object, all at once."""
    engine, path = _customers(spark, d)
    from .plans.parser import parse_condition

    with engine.table(path) as t:
        t.insert(t.df().filter("c_custkey < 10").withColumn("c_custkey", F.col("c_custkey") + 1_000_000))
        t.delete(parse_condition("c_custkey = 5"))
    return engine.open(path)


# -- databases: the embedded one that comes with Spark


def _database(spark: SparkSession, d: str, name: str) -> str:
    """customer's numbers in a table of a database on the driver's disk, which goes with the process."""
    from .sources import jdbc

    folder = tempfile.mkdtemp(prefix="tablekit-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    url = f"jdbc:derby:{folder}/{name};create=true"
    jdbc.write(table(spark, d, "customer").selectExpr("c_custkey AS C_CUSTKEY", "c_nationkey AS C_NATIONKEY", "c_acctbal AS C_ACCTBAL"), jdbc.Target(url, "customer"), "overwrite")
    return url


_LOWER = lambda df: df.toDF(*[c.lower() for c in df.columns])


@registered("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 1000 AND c_nationkey <> 3 ORDER BY c_custkey LIMIT 50 OFFSET 5")
def jdbc_scan(spark: SparkSession, d: str) -> DataFrame:
    """The database filters, sorts and cuts."""
    return _LOWER(Engine(spark).sql(f"SELECT c_custkey, c_acctbal FROM `{_database(spark, d, 'scan')}?table=customer` WHERE c_acctbal > 1000 AND c_nationkey <> 3 ORDER BY c_custkey LIMIT 5, 50"))


@registered("SELECT c_nationkey, count(*) AS n, max(c_custkey) AS biggest FROM customer GROUP BY c_nationkey HAVING count(*) > 3")
def jdbc_alias(spark: SparkSession, d: str) -> DataFrame:
    """A connection named in a properties text; the database groups."""
    url = _database(spark, d, "alias")
    return _LOWER(Engine(spark, f"shop.url={url}\n").sql("SELECT c_nationkey, COUNT(*) AS n, MAX(c_custkey) AS biggest FROM @shop:customer GROUP BY c_nationkey HAVING COUNT(*) > 3")).withColumn("n", F.col("n").cast("bigint"))


@registered("SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN 70 ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_custkey >= 10 UNION ALL SELECT -1, 5")
def jdbc_changes(spark: SparkSession, d: str) -> DataFrame:
    engine, name = Engine(spark), f"`{_database(spark, d, 'changes')}?table=customer`"
    engine.sql(f"INSERT INTO {name} (c_custkey, c_nationkey) VALUES (-1, 5)")
    engine.sql(f"UPDATE {name} SET c_nationkey = 70 WHERE c_nationkey = 7")
    engine.sql(f"DELETE FROM {name} WHERE c_custkey >= 0 AND c_custkey < 10")
    return _LOWER(engine.sql(f"SELECT c_custkey, c_nationkey FROM {name}"))


@registered("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def jdbc_partitioned(spark: SparkSession, d: str) -> DataFrame:
    return _LOWER(Engine(spark).open(f"{_database(spark, d, 'parts')}?table=customer&partitionColumn=c_custkey&numPartitions=4"))


@registered(values([("c_custkey", "INT64"), ("c_nationkey", "INT"), ("c_acctbal", "DOUBLE")], "name, type"))
def jdbc_types(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark).sql(f"DESC `{_database(spark, d, 'types')}?table=customer`").select(F.lower("Column").alias("name"), F.col("Type").alias("type"))


# -- pipelines


def _days(spark: SparkSession, d: str) -> str:
    """Orders as TSV files: two in a folder for each of the first four days of 1998, one for all other days; and customers
    that are active."""
    base = scratch(spark, "feed")
    orders = table(spark, d, "orders").withColumn("note", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")))
    for day in range(1, 5):
        own = orders.filter(F.to_date("o_orderdate") == F.lit(date(1998, 1, day)))
        for part in (0, 1):
            rows = own.filter(F.col("o_orderkey") % 2 == part).select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("client"), F.col("o_totalprice").alias("price"), "note")
            rows = rows.unionByName(spark.range(1).select(F.lit("bad").alias("id"), F.lit(0).cast("bigint").alias("client"), F.lit(0.5).alias("price"), F.lit(None).cast("string").alias("note"))) if part else rows
            registry.write_file(spark, rows.coalesce(1), f"{base}/in/1998-01-0{day}/orders_{'ab'[part]}.tsv")
    rest = orders.filter(~F.coalesce(F.to_date("o_orderdate").between(F.lit(date(1998, 1, 1)), F.lit(date(1998, 1, 4))), F.lit(False)))
    registry.write_file(spark, rest.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("client"), F.col("o_totalprice").alias("price"), "note"), f"{base}/in/1998-01-05/orders_a.tsv")
    table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey").write.parquet(f"{base}/active.parquet")
    return base


_XML = """<pipeline name="orders" max-errors="{errors}"><loop home="{home}" day="1998-01-01..1998-01-04" plain="1998-01-01..1998-01-04" format-day="yyyy-MM-dd" format-plain="yyyyMMdd" threads="2">
<input type="filesystem" max-depth="1"><directory>{{home}}/in/{{day}}</directory><pattern>orders_\\w\\.tsv</pattern><where>{where}</where>{matcher}</input>
<output><meta><columns><column name="id" type="int64" from="id" not-null="true"/><column name="client" type="int64" from="client"/><column name="price" type="decimal" bytes="12" precision="2" from="missing,price"/>
<column name="note" type="string" bytes="40" from="note" default="none"/></columns></meta>{lookup}<directory>{home}/out</directory><filename>{filename}</filename><if exists="yes">{exists}</if>{sort}</output></loop></pipeline>"""
_LOOKUP = '<filter from="client" source="{home}/active.parquet"><condition operator="eq" lookup="WHERE c_custkey = ?"/></filter>'


def _pipeline(home: str, errors: int = 9, where: str = "", matcher: str = "", lookup: bool = True, filename: str = "orders_{plain}.parquet", exists: str = "skip", sort: str = '<sort columns="id"/>', **more) -> pipeline.Pipeline:
    xml = _XML.format(home=home, errors=errors, where=where, matcher=matcher, lookup=_LOOKUP.format(home=home) if lookup else "", filename=filename, exists=exists, sort=sort)
    return pipeline.from_xml(xml, **more)


def _written(spark: SparkSession, home: str) -> DataFrame:
    return spark.read.parquet(f"{home}/out/*.parquet")


_RESULT = "output string, rows_in bigint, rows_out bigint, errors bigint, skipped boolean"


def _results(spark: SparkSession, found: list[pipeline.Result]) -> DataFrame:
    return literal_rows(spark, [(r.output.rsplit("/", 1)[-1], r.rows_in, r.rows_out, r.errors, r.skipped) for r in found], _RESULT)


_FEED = "(SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS note, strftime(o_orderdate, '%Y%m%d') AS day FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-01-05')"
_ROWS = f"SELECT o_orderkey AS id, o_custkey AS client, CAST(floor(CAST(o_totalprice AS DECIMAL(28,10)) * 100) / 100 AS DECIMAL(38,2)) AS price, coalesce(note, 'none') AS note FROM {_FEED}"
_ACTIVE = "o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"
_ALL_DAYS = "(SELECT unnest(['19980101', '19980102', '19980103', '19980104']) AS day)"


@registered(f"{_ROWS} WHERE {_ACTIVE}")
def pipeline_run(spark: SparkSession, d: str) -> DataFrame:
    """A day's files are merged, looked up, mapped and sorted into one file for each day of a range."""
    home = _days(spark, d)
    _pipeline(home).run(Engine(spark))
    return _written(spark, home)


def _metrics(rows_in: str, rows_out: str, errors: str, skipped: str = "false", name: str = "'orders_' || day || '.parquet'") -> str:
    return f"SELECT {name} AS output, {rows_in} AS rows_in, {rows_out} AS rows_out, {errors} AS errors, {skipped} AS skipped FROM (SELECT day, count(o_orderkey) AS n FROM {_ALL_DAYS} LEFT JOIN {_FEED} USING (day) GROUP BY day)"


@registered(_metrics("n + 1", "n", "1::BIGINT"))
def pipeline_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, _pipeline(_days(spark, d), lookup=False, sort="").run(Engine(spark)))


@registered(_metrics("0::BIGINT", "0::BIGINT", "0::BIGINT", "true"))
def pipeline_exists_skip(spark: SparkSession, d: str) -> DataFrame:
    home = _days(spark, d)
    _pipeline(home).run(Engine(spark))
    return _results(spark, _pipeline(home).run(Engine(spark)))


@registered(f"{_ROWS} WHERE o_totalprice > 100000")
def pipeline_exists_overwrite(spark: SparkSession, d: str) -> DataFrame:
    home = _days(spark, d)
    _pipeline(home, lookup=False).run(Engine(spark))
    _pipeline(home, lookup=False, exists="overwrite", row_filters=[lambda df: df.price.cast("double") > 100_000]).run(Engine(spark))
    return _written(spark, home)


@registered(f"SELECT * FROM ({_metrics('n + 1', '0::BIGINT', '1::BIGINT')})")
def pipeline_error_budget(spark: SparkSession, d: str) -> DataFrame:
    """A sorted output with more errors than the budget is not written."""
    home = _days(spark, d)
    found = _pipeline(home, errors=0, lookup=False).run(Engine(spark))
    fs, p = file_system(spark, f"{home}/out")
    assert not fs.exists(p) or not [s for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")]
    return _results(spark, found)


@registered(f"SELECT name AS output, coalesce(n, 0) + bad AS rows_in, coalesce(n, 0) AS rows_out, bad::BIGINT AS errors, false AS skipped FROM (VALUES ('orders_a.parquet', 0, 0), ('orders_b.parquet', 1, 4)) v(name, odd, bad) LEFT JOIN (SELECT o_orderkey % 2 AS odd, count(*) AS n FROM {_FEED} GROUP BY 1) USING (odd)")
def pipeline_grouping(spark: SparkSession, d: str) -> DataFrame:
    """Files of all days whose output has the same name make one."""
    return _results(spark, _pipeline(_days(spark, d), lookup=False, filename="{basename}.parquet").run(Engine(spark)))


@registered(f"{_ROWS} WHERE o_orderkey % 2 = 0")
def pipeline_matcher(spark: SparkSession, d: str) -> DataFrame:
    """Only files whose basename matches, and that are not older than a day."""
    home, conditions = _days(spark, d), '<condition type="basename" operator="matches" value="orders_[a]"/><condition mtime="-1d" operator="gt"/>'
    _pipeline(home, lookup=False, matcher=f"<matcher>{conditions}</matcher>").run(Engine(spark))
    return _written(spark, home)


@registered(f"{_ROWS} WHERE note LIKE '%H%'")
def pipeline_where(spark: SparkSession, d: str) -> DataFrame:
    """The where clause holds for each file."""
    home = _days(spark, d)
    _pipeline(home, lookup=False, where="WHERE note LIKE '*H*'").run(Engine(spark))
    return _written(spark, home)


@registered(f"SELECT id * 2 AS id, client, price, note FROM ({_ROWS})")
def pipeline_handler(spark: SparkSession, d: str) -> DataFrame:
    """A row handler between input and mapping."""
    home = _days(spark, d)
    p = _pipeline(home, lookup=False)
    p.handlers = [lambda df: df.withColumn("id", df.id.try_cast("bigint") * 2)]
    p.run(Engine(spark))
    return _written(spark, home)


_VARIABLES = [(0, "a", "given"), (0, "day", "1998-02-28"), (0, "plain", "19980228"), (1, "a", "given"), (1, "day", "1998-03-01"), (1, "plain", "19980301")]


@registered(values(_VARIABLES, "k, name, value"))
def pipeline_variables(spark: SparkSession, d: str) -> DataFrame:
    """Texts with defaults, and days of a range in two formats."""
    v = [pipeline.Variable("a", None, "TABLEKIT_UNSET", "given"), pipeline.Variable("day", first=-1, last=0), pipeline.Variable("plain", first=-1, last=0, format="yyyyMMdd")]
    found = [(k, n, x) for k, own in enumerate(pipeline.variable_sets(v, date(1998, 3, 1))) for n, x in own.items()]
    return literal_rows(spark, found, "k int, name string, value string")


# -- streams and tools


@registered("SELECT s_suppkey, s_name, s_suppkey % 2 AS batch FROM supplier")
def stream_drained(spark: SparkSession, d: str) -> DataFrame:
    """Files of a folder, processed once each as they come."""
    base, supplier = scratch(spark, "stream"), table(spark, d, "supplier").select("s_suppkey", "s_name")
    meta = Meta.from_spark("supplier", supplier.schema)
    for batch in (0, 1):
        part = f"{base}/part-{batch}"
        text.write(supplier.filter(F.col("s_suppkey") % 2 == batch).coalesce(1), part, text.Dialect())
        fs, p = file_system(spark, part)
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs.mkdirs(jvm(f"{base}/in"))
        source = next(s.getPath() for s in fs.listStatus(p) if s.getPath().getName().endswith(".txt"))
        fs.rename(source, jvm(f"{base}/in/{batch}.tsv"))
        stream_files.drain(stream_files.stream(spark, f"{base}/in", meta, "tsv"), f"{base}/state", stream_files.append_to(spark, f"{base}/out"))
    return spark.read.parquet(f"{base}/out").select("s_suppkey", "s_name", F.col("batch").cast("bigint").alias("batch"))


def _lines(spark: SparkSession, d: str, *flags: str) -> DataFrame:
    out = io.StringIO()
    code = cli.main(["-sql", f"SELECT n_nationkey, n_name FROM {d}/nation.parquet ORDER BY n_nationkey; SELECT COUNT(*) AS n FROM {d}/region.parquet", *flags], spark, out)
    assert code == 0
    return literal_rows(spark, enumerate(out.getvalue().splitlines()), "k int, line string")


@registered("SELECT (row_number() OVER () - 1)::INT AS k, line FROM (SELECT 'n_nationkey' || chr(9) || 'n_name' AS line UNION ALL (SELECT n_nationkey || chr(9) || n_name FROM nation ORDER BY n_nationkey) UNION ALL SELECT 'n' UNION ALL SELECT count(*)::VARCHAR FROM region)")
def cli_script(spark: SparkSession, d: str) -> DataFrame:
    """Statements of a script, their rows as tab-separated lines."""
    return _lines(spark, d)


@registered("WITH c AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS r, n_nationkey AS k, n_name AS s FROM nation), w AS (SELECT max(length(s)) AS w FROM c), b AS (SELECT '+----+-------------+' || repeat('-', (w + 2)::INT) || '+' AS b FROM w) SELECT k::INT AS k, line FROM (SELECT 0 AS k, b AS line FROM b UNION ALL SELECT r, '| ' || rpad(r::VARCHAR, 2, ' ') || ' | ' || rpad(k::VARCHAR, 11, ' ') || ' | ' || rpad(s, w::INT, ' ') || ' |' FROM c, w UNION ALL SELECT 26, b FROM b UNION ALL SELECT 27, '+---+---+' UNION ALL SELECT 28, '| 1 | ' || count(*) || ' |' FROM region UNION ALL SELECT 29, '+---+---+')")
def cli_pretty(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d, "-pretty", "-rownum", "-nohead")


@registered("SELECT 200 AS status, n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation UNION ALL SELECT 400, NULL, NULL")
def web_rows(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the web page: all rows, and the error of a bad statement."""
    import json

    status, parts = webui.answer(Engine(spark), json.dumps({"q": f"SELECT n_nationkey, n_name FROM {d}/nation.parquet"}))
    rows = [(status, *r) for r in json.loads("".join(parts))[1:]]
    bad, parts = webui.answer(Engine(spark), json.dumps({"q": "SELECT"}))
    assert json.loads("".join(parts))["error"]
    return literal_rows(spark, [*rows, (bad, None, None)], "status int, n_nationkey string, n_name string")

