"""Every registered query of the engine gives what DuckDB gives for its SQL."""

import duckdb
import pytest

from tablekit import queries

from .conftest import SF, rows

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name, tmp_path):
    df = queries.QUERIES[name](spark, SF)
    if name not in queries.ORACLE_SQL:
        assert df.count() > 0
        return
    df.write.parquet(f"{tmp_path}/out")
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    wanted, found = f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})", f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'"
    assert duck.sql(f"{wanted} EXCEPT ALL {found}").fetchall() == []
    assert duck.sql(f"{found} EXCEPT ALL {wanted}").fetchall() == []


def test_pushdown(spark):
    """Filters and columns reach the scan."""
    plan = queries.QUERIES["filter_eq"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "l_extendedprice" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_hashes(spark):
    """Brute force of the two queries that SQL cannot express."""
    from tablekit.functions.kernels import fnv63, murmur2_64a

    names = {r.c_custkey: fnv63(r.c_name) for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    assert {r.c_custkey: r.hash for r in queries.QUERIES["map_hash63"](spark, SF).collect()} == names
    last = {}
    for r in sorted(spark.read.parquet(f"{SF}/lineitem.parquet").collect(), key=lambda r: (r.l_orderkey, r.l_linenumber)):
        last.setdefault(r.l_returnflag, {}).setdefault((r.l_orderkey, r.l_linenumber), set()).add(murmur2_64a(f"#{r.l_returnflag}#{r.l_linestatus}".encode()))
    for r in queries.QUERIES["agg_hash_groups"](spark, SF).collect():
        group = last[r.l_returnflag]
        assert r.hash in group[max(group)]


def test_union_of_all_orders(spark, duck, tmp_path):
    """The folders that the union queries read hold every order, of any year or without a date."""
    from tablekit.engine import Engine
    from tablekit.sources import union

    duck.sql(f"COPY (SELECT * REPLACE (CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate) FROM orders) TO '{tmp_path}/orders.parquet'")
    for d in (SF, str(tmp_path)):
        whole = union.read(spark, union.Descriptor(queries._orders_by_year(spark, d), queries._UNION, 3), Engine(spark).open)
        assert rows(whole) == rows(spark.read.parquet(f"{d}/orders.parquet"))


def test_bitmaps_of_numbers_far_apart(spark):
    """A number far from all others takes a word, not a bitmap of kilobytes, and sets are united without sorts."""
    from pyspark.sql import functions as F

    from tablekit.functions import bitmaps
    from tablekit.functions.aggregates import Function, aggregate

    data = [(k, n) for k in ("a", None) for n in (-65, -64, -1, 0, 63, 64, 10**12)]
    a, b = (bitmaps.build(spark.createDataFrame(x, "k string, n long"), ["k"], "n") for x in (data, [(None, 63), (None, 10**12), ("a", 5), ("b", 1), (None, None)]))
    assert a.schema["bits"].dataType.simpleString() == "bigint"
    assert "Sort" not in bitmaps.counts(a, "n")._jdf.queryExecution().executedPlan().toString()
    assert rows(bitmaps.counts(bitmaps.union(a, b), "n")) == [("a", 8), ("b", 1), (None, 7)]
    assert rows(bitmaps.counts(bitmaps.intersection(a, b), "n").filter("n > 0")) == [(None, 2)]
    assert rows(bitmaps.counts(bitmaps.difference(a, b), "n")) == [("a", 7), (None, 5)]
    words = a.unionByName(b)
    stored = spark.createDataFrame([("a", 0), ("a", 40_000), ("b", 7)], "k string, n long").groupBy("k", F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))
    for df, wanted in ((words, [("a", 8), ("b", 1), (None, 7)]), (stored.unionByName(stored), [("a", 2), ("b", 1)])):
        assert rows(aggregate(df, ["k"], [Function("DISTINCT_ROARING_BITMAP_SUM", ["bucket", "bits"], "n")])) == wanted
