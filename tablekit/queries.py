"""Registered queries of the engine, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .engine import Engine
from .functions import bitmaps
from .functions.aggregates import Function, Key, aggregate, bitmap_distinct, time
from .operators.lookup import lookup
from .operators.pipeline import Mapping
from .sources import registry, union
from .sources.paths import date_in_directory, scratch
from .types import ColumnType, floor_decimal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SUM = "CAST(floor(coalesce(sum(CAST({0} AS DECIMAL(28,10))), 0) * 100000) / 100000 AS DECIMAL(38,5))"
AVG = "CAST(round(avg(CAST({0} AS DECIMAL(20,5))), 5) AS DECIMAL(38,5))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str, oracle: str) -> None:
    """A query in the engine's dialect; {d} is the folder of the tables."""
    QUERIES[name] = lambda spark, d: Engine(spark).sql(sql.replace("{d}", d))
    ORACLE_SQL[name] = oracle


def registered(oracle: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLE_SQL[name or f.__name__] = oracle
        return f

    return add


# -- projections and predicates

query("scan_project", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM {d}/orders.parquet", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
query("flagship", "SELECT l_returnflag, COUNT(*) AS cnt, SUM(l_quantity) AS sum_qty, AVG(l_extendedprice) AS avg_price FROM {d}/lineitem.parquet WHERE l_quantity > 10 GROUP BY l_returnflag HAVING cnt > 5 ORDER BY l_returnflag", f"SELECT l_returnflag, count(*) AS cnt, {SUM.format('l_quantity')} AS sum_qty, {AVG.format('l_extendedprice')} AS avg_price FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag HAVING count(*) > 5")

_PREDICATES = {
    "filter_eq": ("l_returnflag = 'R' AND l_linestatus = 'F'", None),
    "filter_ne_null_safe": ("l_returnflag <> 'R'", "l_returnflag IS DISTINCT FROM 'R'"),
    "filter_range": ("l_quantity >= 10 AND l_quantity < 20 AND l_shipdate > '1995-03-15 00:00:00'", "l_quantity >= 10 AND l_quantity < 20 AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00'"),
    "filter_between": ("l_discount BETWEEN 0.05 AND 0.07 AND l_quantity <= 24", None),
    "filter_in": ("l_linenumber IN (1, 3, 5)", None),
    "filter_not": ("NOT l_returnflag = 'N' AND l_quantity NOT BETWEEN 5 AND 45", None),
    "filter_or_precedence": ("l_returnflag = 'A' OR l_returnflag = 'R' AND l_quantity > 45", None),
    "filter_parens": ("(l_returnflag = 'A' OR l_returnflag = 'R') AND l_quantity > 45", None),
    "filter_ne_null": ("l_returnflag != NULL AND l_quantity = 50", "l_returnflag IS NOT NULL AND l_quantity = 50"),
    "filter_is_null": ("l_returnflag IS NOT NULL AND l_quantity = 49", None),
}
for _name, (_where, _oracle) in _PREDICATES.items():
    _columns = "l_orderkey, l_linenumber, l_returnflag, l_quantity"
    query(_name, f"SELECT {_columns} FROM {{d}}/lineitem.parquet WHERE {_where}", f"SELECT {_columns} FROM lineitem WHERE {_oracle or _where}")
for _name, _like, _duck in (("prefix", "s%", "s%"), ("suffix", "%e", "%e"), ("contains", "%re%", "%re%"), ("star", "*re*", "%re%"), ("underscore", "_a%", "_a%")):
    query(f"filter_like_{_name}", f"SELECT p_partkey, p_name FROM {{d}}/part.parquet WHERE p_name LIKE '{_like}'", f"SELECT p_partkey, p_name FROM part WHERE p_name LIKE '{_duck}'")

# -- distinct, order, limit

query("distinct_one", "SELECT DISTINCT l_returnflag FROM {d}/lineitem.parquet", "SELECT DISTINCT l_returnflag FROM lineitem")
query("distinct_multi", "SELECT DISTINCT l_returnflag, l_linestatus FROM {d}/lineitem.parquet", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
query("order_limit", "SELECT o_orderkey, o_totalprice FROM {d}/orders.parquet ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS FIRST LIMIT 25")
query("order_multi", "SELECT o_orderpriority, o_orderkey FROM {d}/orders.parquet ORDER BY o_orderpriority, o_orderkey DESC LIMIT 40", "SELECT o_orderpriority, o_orderkey FROM orders ORDER BY o_orderpriority NULLS FIRST, o_orderkey DESC NULLS LAST LIMIT 40")
query("order_offset_limit", "SELECT o_orderkey FROM {d}/orders.parquet ORDER BY o_orderkey LIMIT 30, 20", "SELECT o_orderkey FROM orders ORDER BY o_orderkey NULLS FIRST LIMIT 20 OFFSET 30")

# -- aggregates

query("agg_count_all", "SELECT COUNT(*) AS n FROM {d}/lineitem.parquet", "SELECT count(*) AS n FROM lineitem")
query("agg_count_star", "SELECT event_type, COUNT(*) AS n FROM {d}/events.parquet GROUP BY event_type", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
query("agg_count_col", "SELECT event_type, COUNT(value) AS n FROM {d}/events.parquet GROUP BY event_type", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
query("agg_sum", "SELECT l_returnflag, l_linestatus, SUM(l_extendedprice) AS total FROM {d}/lineitem.parquet GROUP BY l_returnflag, l_linestatus", f"SELECT l_returnflag, l_linestatus, {SUM.format('l_extendedprice')} AS total FROM lineitem GROUP BY ALL")
query("agg_avg", "SELECT l_returnflag, AVG(l_discount) AS mean FROM {d}/lineitem.parquet GROUP BY l_returnflag", f"SELECT l_returnflag, {AVG.format('l_discount')} AS mean FROM lineitem GROUP BY ALL")
query("agg_min_max", "SELECT o_orderstatus, MIN(o_totalprice) AS low, MAX(o_orderdate) AS latest FROM {d}/orders.parquet GROUP BY o_orderstatus", "SELECT o_orderstatus, min(o_totalprice) AS low, max(o_orderdate) AS latest FROM orders GROUP BY ALL")
query("agg_global_empty", "SELECT COUNT(*) AS n, SUM(l_quantity) AS total, AVG(l_quantity) AS mean FROM {d}/lineitem.parquet WHERE l_quantity < 0", "SELECT 0::BIGINT AS n, 0::DECIMAL(38,5) AS total, NULL::DECIMAL(38,5) AS mean")
query("agg_distinct_count", "SELECT event_type, DISTINCT_COUNT(user_id) AS users FROM {d}/events.parquet GROUP BY event_type", "SELECT event_type, count(DISTINCT user_id) + max((user_id IS NULL)::INT) AS users FROM events GROUP BY event_type")
query("having_alias", "SELECT o_custkey, COUNT(*) AS cnt FROM {d}/orders.parquet GROUP BY o_custkey HAVING cnt >= 15", "SELECT o_custkey, count(*) AS cnt FROM orders GROUP BY o_custkey HAVING count(*) >= 15")
query("having_expr_text", "SELECT o_custkey, COUNT(*) AS cnt FROM {d}/orders.parquet GROUP BY o_custkey HAVING COUNT(*) > 14", "SELECT o_custkey, count(*) AS cnt FROM orders GROUP BY o_custkey HAVING count(*) > 14")
query("having_and", "SELECT o_custkey, COUNT(*) AS cnt, MAX(o_totalprice) AS top FROM {d}/orders.parquet GROUP BY o_custkey HAVING cnt > 10 AND top > 400000", "SELECT o_custkey, count(*) AS cnt, max(o_totalprice) AS top FROM orders GROUP BY o_custkey HAVING count(*) > 10 AND max(o_totalprice) > 400000")
query("having_or", "SELECT o_custkey, COUNT(*) AS cnt, MAX(o_totalprice) AS top FROM {d}/orders.parquet GROUP BY o_custkey HAVING cnt > 17 OR top > 440000 AND cnt < 5", "SELECT o_custkey, count(*) AS cnt, max(o_totalprice) AS top FROM orders GROUP BY o_custkey HAVING count(*) > 17 OR max(o_totalprice) > 440000 AND count(*) < 5")


@registered("SELECT event_type, first(value ORDER BY event_id) FILTER (WHERE value IS NOT NULL) AS first_value, last(value ORDER BY event_id) FILTER (WHERE value IS NOT NULL) AS last_value FROM events GROUP BY event_type")
def agg_first_last(spark: SparkSession, d: str) -> DataFrame:
    return aggregate(table(spark, d, "events"), ["event_type"], [Function("FIRST", ["value"], "first_value"), Function("LAST", ["value"], "last_value")], order=["event_id"])


@registered("SELECT l_returnflag, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS statuses FROM lineitem GROUP BY l_returnflag")
def agg_distinct_set(spark: SparkSession, d: str) -> DataFrame:
    out = aggregate(table(spark, d, "lineitem"), ["l_returnflag"], [Function("DISTINCT_SET", ["l_linestatus"], "statuses")])
    return out.withColumn("statuses", F.concat_ws(",", "statuses"))


@registered("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def agg_bitmap_count(spark: SparkSession, d: str) -> DataFrame:
    return bitmap_distinct(table(spark, d, "events"), ["event_type"], "user_id", "users")


@registered("SELECT event_type, count(DISTINCT user_id) AS exact, true AS close FROM events GROUP BY event_type")
def agg_hll_within_tolerance(spark: SparkSession, d: str) -> DataFrame:
    out = aggregate(table(spark, d, "events"), ["event_type"], [Function("DISTINCT_HLL_COUNT", ["user_id"], "near"), Function("DISTINCT_COUNT", ["user_id"], "exact")])
    return out.select("event_type", "exact", (F.abs(F.col("near") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


@registered("SELECT count(DISTINCT user_id) AS exact, true AS close FROM events")
def agg_hll_merge_within_tolerance(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    stored = aggregate(events, ["event_type"], [Function("DISTINCT_APPROX_SKETCH", ["user_id"], "sketch")])
    merged = aggregate(stored, [], [Function("HLL_SUM", ["sketch"], "near")])
    exact = events.agg(F.count_distinct("user_id").alias("exact"))
    return merged.join(exact).select("exact", (F.abs(F.col("near") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))  # one row each


@registered("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS many, " + SUM.format("CASE WHEN l_discount > 0.05 THEN l_extendedprice END") + " AS discounted FROM lineitem WHERE l_quantity > 25 OR l_discount > 0.05 GROUP BY l_returnflag")
def agg_condition(spark: SparkSession, d: str) -> DataFrame:
    return aggregate(table(spark, d, "lineitem"), ["l_returnflag"], [Function("COUNT", alias="many", condition=F.col("l_quantity") > 25), Function("SUM", ["l_extendedprice"], "discounted", F.col("l_discount") > 0.05)])


@registered("SELECT o_orderpriority, count(*) AS n, row_number() OVER (ORDER BY o_orderpriority NULLS LAST) AS id FROM orders GROUP BY o_orderpriority")
def agg_rowid(spark: SparkSession, d: str) -> DataFrame:
    return aggregate(table(spark, d, "orders"), ["o_orderpriority"], [Function("COUNT", alias="n"), Function("ROWID", (), "id")])


@registered()
def agg_hash_groups(spark: SparkSession, d: str) -> DataFrame:
    return aggregate(table(spark, d, "lineitem"), ["l_returnflag"], [Function("HASH", ["l_returnflag", "l_linestatus"], "hash")], order=["l_orderkey", "l_linenumber"])


@registered("SELECT coalesce(strftime(ts, '%Y-%m-%d'), '<NULL>') AS day, count(*) AS n FROM events GROUP BY 1")
def group_time_day(spark: SparkSession, d: str) -> DataFrame:
    return aggregate(table(spark, d, "events"), [time("day", "ts", "yyyy-MM-dd")], [Function("COUNT", alias="n")])


@registered("SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def group_time_month(spark: SparkSession, d: str) -> DataFrame:
    return aggregate(table(spark, d, "orders"), [time("month", "o_orderdate", "yyyy-MM"), Key("o_orderstatus", "o_orderstatus")], [Function("COUNT", alias="n")])


@registered("SELECT l_linestatus, 0 AS zero, count(*) AS n FROM lineitem GROUP BY l_linestatus")
def agg_constants(spark: SparkSession, d: str) -> DataFrame:
    return aggregate(table(spark, d, "lineitem"), ["l_linestatus"], [Function("ZERO", (), "zero"), Function("COUNT", alias="n")])


@registered("SELECT o_orderstatus, max(o_totalprice) - min(o_totalprice) AS span FROM orders GROUP BY o_orderstatus")
def agg_custom(spark: SparkSession, d: str) -> DataFrame:
    return aggregate(table(spark, d, "orders"), ["o_orderstatus"], [Function("CUSTOM", ["o_totalprice"], "span", build=lambda c: F.max(c) - F.min(c))])


def _bitmaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "events")
    return tuple(bitmaps.build(events.filter(test), ["event_type"], "user_id") for test in (F.col("value") > 50, F.col("value") < 5))


for _name, _set, _op in (("bitmap_or", bitmaps.union, "UNION"), ("bitmap_and", bitmaps.intersection, "INTERSECT"), ("bitmap_andnot", bitmaps.difference, "EXCEPT")):
    _sides = [f"SELECT event_type, user_id FROM events WHERE {t} AND user_id IS NOT NULL" for t in ("value > 50", "value < 5")]
    registered(f"SELECT event_type, count(*) AS users FROM (({_sides[0]}) {_op} ({_sides[1]})) GROUP BY event_type", _name)(partial(lambda spark, d, op: bitmaps.counts(op(*_bitmaps(spark, d)), "users").filter("users > 0"), op=_set))


# -- lookups and mappings


@registered("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def lookup_semi(spark: SparkSession, d: str) -> DataFrame:
    return lookup(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer"), "WHERE c_custkey = ? AND c_mktsegment = 'BUILDING'").select("o_orderkey", "o_custkey")


@registered("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def lookup_anti(spark: SparkSession, d: str) -> DataFrame:
    return lookup(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer"), "WHERE c_custkey = ? AND c_mktsegment = 'BUILDING'", "neq").select("o_orderkey", "o_custkey")


@registered("SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS k FROM orders) WHERE k IS NOT NULL AND k NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def lookup_filter_null_key(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("k", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")))
    return lookup(orders, "k", table(spark, d, "customer"), "WHERE c_custkey = ? AND c_acctbal > 0", "not-exists").select("o_orderkey")


def mapped(df: DataFrame, *mappings: Mapping) -> DataFrame:
    return df.select(*[m.value(df.schema).alias(m.name) for m in mappings])


@registered("SELECT c_custkey, coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END, 'none') AS segment FROM customer")
def map_default(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer").withColumn("segment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    return mapped(df, Mapping("c_custkey", ColumnType("INT64")), Mapping("segment", ColumnType("STRING"), default="none"))


@registered("SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, c_mktsegment) AS label FROM customer")
def map_coalesce(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer").withColumn("rich", F.when(F.col("c_acctbal") > 0, F.col("c_name")))
    return mapped(df, Mapping("c_custkey", ColumnType("INT64")), Mapping("label", ColumnType("STRING"), ["rich", "c_mktsegment"]))


@registered()
def map_hash63(spark: SparkSession, d: str) -> DataFrame:
    return mapped(table(spark, d, "customer"), Mapping("c_custkey", ColumnType("INT64")), Mapping("hash", ColumnType("INT64"), ["c_name"], transform="hash"))


# -- unions


def _orders_by_year(spark: SparkSession, d: str) -> str:
    """Orders as one Parquet folder for each year that occurs, below folders named by a date, and one for null dates."""
    base = scratch(spark, "orders")
    orders = table(spark, d, "orders")
    year = F.year("o_orderdate")
    for (y,) in orders.select(year).distinct().filter(year.isNotNull()).collect():  # one row for each year
        orders.filter(year == y).write.parquet(f"{base}/logs_{y:04}-01-01/orders_{y:04}.parquet")
    orders.filter(year.isNull()).write.parquet(f"{base}/logs_undated/orders_0.parquet")
    return base


_UNION = r"orders_\d+\.parquet"


@registered("SELECT * FROM orders")
def union_all_files(spark: SparkSession, d: str) -> DataFrame:
    return registry.read_union(spark, union.Descriptor(_orders_by_year(spark, d), _UNION, 3, "asc"))


@registered("SELECT * FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1997")
def union_date_filter(spark: SparkSession, d: str) -> DataFrame:
    keep = date_in_directory(date(1996, 1, 1), date(1997, 12, 31))
    return registry.read_union(spark, union.Descriptor(_orders_by_year(spark, d), _UNION, 3), keep)


@registered("SELECT true AS refused")
def union_schema_check(spark: SparkSession, d: str) -> DataFrame:
    from .errors import EngineError

    try:
        union.union_all([table(spark, d, "orders"), table(spark, d, "customer")])
        refused = False
    except EngineError:
        refused = True
    return spark.createDataFrame([(refused,)], "refused boolean")


# -- round trips


def _round_trip(spark: SparkSession, d: str, suffix: str) -> DataFrame:
    path = scratch(spark, f"part.{suffix}")
    part = table(spark, d, "part").withColumn("p_name", F.when(F.col("p_partkey") % 7 == 0, F.lit("a\tb,\"c\"\\N")).when(F.col("p_partkey") % 11 != 0, F.col("p_name")))
    registry.write_file(spark, part, path)
    return registry.open_file(spark, path)


_PART = "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'a' || chr(9) || 'b,\"c\"\\N' WHEN p_partkey % 11 <> 0 THEN p_name END AS p_name, p_brand, p_type, p_size, p_retailprice FROM part"
for _suffix in ("tsv", "csv", "jsonl", "parquet", "tsv.gz"):
    registered(_PART, f"roundtrip_{_suffix.replace('.', '_')}")(partial(lambda spark, d, suffix: _round_trip(spark, d, suffix), suffix=_suffix))


# -- tables with a key


def _customers(spark: SparkSession, d: str) -> tuple[Engine, str]:
    engine, path = Engine(spark), scratch(spark, f"customer{registry.NATIVE}")
    engine.sql(f"CREATE TABLE {path} (c_custkey INT64 NOT NULL, c_name STRING(40), c_mktsegment STRING(20), PRIMARY KEY (c_custkey))")
    engine.sql(f"INSERT INTO {path} FROM {d}/customer.parquet")
    return engine, path


_CUSTOMER = "SELECT c_custkey, c_name, c_mktsegment FROM customer"


@registered(_CUSTOMER)
def insert_from(spark: SparkSession, d: str) -> DataFrame:
    engine, path = _customers(spark, d)
    return engine.sql(f"SELECT * FROM {path}")


@registered("SELECT c_custkey, CASE WHEN c_custkey = 3 THEN 'Three' ELSE c_name END AS c_name, CASE WHEN c_custkey = 3 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -1, 'New', 'BUILDING'")
def dml_upsert(spark: SparkSession, d: str) -> DataFrame:
    engine, path = _customers(spark, d)
    engine.sql(f"REPLACE INTO {path} VALUES (3, 'Three', NULL)")
    engine.sql(f"REPLACE INTO {path} VALUES (-1, 'New', 'BUILDING')")
    return engine.open(path)


@registered(_CUSTOMER.replace("c_mktsegment", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END AS c_mktsegment"))
def dml_update(spark: SparkSession, d: str) -> DataFrame:
    engine, path = _customers(spark, d)
    engine.sql(f"UPDATE {path} SET c_mktsegment = 'HOUSES' WHERE c_mktsegment = 'BUILDING'")
    return engine.open(path)


@registered(_CUSTOMER + " WHERE NOT (c_mktsegment = 'BUILDING' AND c_custkey > 100)")
def dml_delete(spark: SparkSession, d: str) -> DataFrame:
    engine, path = _customers(spark, d)
    engine.sql(f"DELETE FROM {path} WHERE c_mktsegment = 'BUILDING' AND c_custkey > 100")
    return engine.open(path)


@registered(_CUSTOMER)
def tx_rollback(spark: SparkSession, d: str) -> DataFrame:
    engine, path = _customers(spark, d)
    engine.sql(f"BEGIN TRANSACTION {path}")
    engine.sql(f"DELETE FROM {path} WHERE c_custkey > 10")
    engine.sql(f"ROLLBACK {path}")
    return engine.open(path)


@registered(_CUSTOMER + " WHERE c_custkey <= 10")
def tx_commit(spark: SparkSession, d: str) -> DataFrame:
    engine, path = _customers(spark, d)
    engine.sql(f"BEGIN TRANSACTION {path}")
    engine.sql(f"DELETE FROM {path} WHERE c_custkey > 10")
    engine.sql(f"COMMIT {path}")
    return Engine(spark).open(path)


@registered("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
def select_into(spark: SparkSession, d: str) -> DataFrame:
    engine, path = Engine(spark), scratch(spark, f"rich{registry.NATIVE}")
    engine.sql(f"SELECT c_custkey, c_name INTO {path} FROM {d}/customer.parquet WHERE c_acctbal > 5000")
    return engine.open(path)


@registered(_CUSTOMER + " WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey DESC LIMIT 10")
def index_hint_desc(spark: SparkSession, d: str) -> DataFrame:
    engine, path = _customers(spark, d)
    return engine.find(path, "USE INDEX(PRIMARY DESC) WHERE c_mktsegment = 'BUILDING' LIMIT 10")


@registered(_CUSTOMER + " WHERE c_custkey = 42")
def pk_lookup(spark: SparkSession, d: str) -> DataFrame:
    engine, path = _customers(spark, d)
    return engine.table(path).one("primary", [42])


# -- catalogue and casts


@registered("SELECT * FROM (VALUES ('c_custkey', 'INT64', 'PRI', NULL::VARCHAR), ('c_name', 'STRING(40)', '', NULL), ('c_mktsegment', 'STRING(20)', '', NULL)) t(\"Column\", \"Type\", \"Key\", \"Default\")")
def desc(spark: SparkSession, d: str) -> DataFrame:
    engine, path = _customers(spark, d)
    return engine.sql(f"DESC {path}")


@registered()
def meta(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark).sql(f"META {d}/orders.parquet")


@registered("SELECT 'lineitem.parquet' AS \"Table\", 'parquet' AS \"Format\", count(*) AS \"Rows\" FROM lineitem")
def show_tables(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark).sql(f"SHOW TABLES WHERE {d}").filter(F.col("Table") == "lineitem.parquet").select("Table", "Format", "Rows")


@registered("SELECT p_partkey, CAST(floor(CAST(p_retailprice AS DECIMAL(28,10)) * -1.37 * 1000) / 1000 AS DECIMAL(38,3)) AS price FROM part")
def cast_floor_decimal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", floor_decimal(F.col("p_retailprice").cast("decimal(28,10)") * F.lit("-1.37").cast("decimal(3,2)"), 3).alias("price"))


@registered("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS size FROM part")
def cast_empty_to_null(spark: SparkSession, d: str) -> DataFrame:
    text_size = F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("")
    return table(spark, d, "part").select("p_partkey", ColumnType("INT").cast(text_size, T.StringType()).alias("size"))


@registered("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN date_trunc('day', o_orderdate)::TIMESTAMP WHEN 1 THEN date_trunc('second', o_orderdate)::TIMESTAMP END AS t FROM orders")
def cast_datetime_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Texts of 10 and 19 characters are dates and times; of 7, nothing."""
    form = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    return table(spark, d, "orders").select("o_orderkey", ColumnType("TIME").cast(form, T.StringType()).alias("t"))


@registered("SELECT s_suppkey, lower(hex(s_name::BLOB)) AS hex_name FROM supplier")
def cast_bytes_hex(spark: SparkSession, d: str) -> DataFrame:
    from .types import to_text

    df = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").cast("binary").alias("b"))
    return df.select("s_suppkey", to_text(F.col("b"), T.BinaryType()).alias("hex_name"))



from . import feature_queries  # noqa: E402, F401  registers its own
