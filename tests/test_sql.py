from decimal import Decimal

import pytest

from tablekit.errors import EngineError, SqlSyntaxError
from tablekit.plans.lexer import statements
from tablekit.plans.parser import parse
from tablekit.schema import Meta

from .conftest import rows

HAVING = [
    ("category, product, quantity", [("Electronics", "a", 1), ("Electronics", "b", 2), ("Electronics", "c", 3), ("Books", "d", 4), ("Books", "e", 5), ("Clothing", "f", 6)], "SELECT category, COUNT(*) as product_count FROM {t} GROUP BY category HAVING product_count > 2", 1),
    ("region, x, sales", [("North", "", 1000), ("North", "", 2000), ("North", "", 3000), ("South", "", 500), ("South", "", 600), ("East", "", 4000), ("East", "", 5000)], "SELECT region, SUM(sales) as total_sales FROM {t} GROUP BY region HAVING total_sales > 5000", 2),
    ("dept, x, amount", [("IT", "", 100), ("IT", "", 200), ("IT", "", 150), ("HR", "", 50), ("HR", "", 60), ("Sales", "", 300), ("Sales", "", 400)], "SELECT dept, COUNT(*) as cnt, SUM(amount) as total FROM {t} GROUP BY dept HAVING cnt > 2 AND total > 400", 1),
    ("team, x, score", [("A", "", 10), ("A", "", 20), ("B", "", 100), ("B", "", 200), ("C", "", 5)], "SELECT team, COUNT(*) as cnt, SUM(score) as total FROM {t} GROUP BY team HAVING cnt > 2 OR total > 250", 1),
    ("status, x, value", [("Active", "", 10), ("Active", "", 20), ("Active", "", 30), ("Inactive", "", 5), ("Pending", "", 15), ("Pending", "", 25)], "SELECT status, AVG(value) as avg_value FROM {t} GROUP BY status HAVING avg_value >= 20", 2),
]


@pytest.mark.parametrize("columns,data,sql,expected", HAVING)
def test_having(spark, engine, tmp_path, columns, data, sql, expected):
    path = f"{tmp_path}/t.parquet"
    spark.createDataFrame(data, columns.split(", ")).write.parquet(path)
    assert engine.sql(sql.format(t=path)).count() == expected


@pytest.fixture
def fruit(spark, tmp_path):
    path = f"{tmp_path}/fruit.parquet"
    data = [("Fruit", "Apple", 100), ("Fruit", "Banana", 80), ("Fruit", "Orange", 90), ("Vegetable", "Carrot", 50), ("Vegetable", "Broccoli", 70), (None, None, None)]
    spark.createDataFrame(data, "Category string, item string, price bigint").coalesce(1).write.parquet(path)
    return path


def test_group_by(engine, fruit):
    df = engine.sql(f"SELECT COUNT(*) v, SUM(price), AVG(price) AS mean, category FROM {fruit} WHERE category != NULL GROUP BY category")
    assert df.columns == ["category", "v", "sum(price)", "mean"]  # keys first, then aggregates
    assert rows(df) == [("Fruit", 3, Decimal("270.00000"), Decimal("90.00000")), ("Vegetable", 2, Decimal("120.00000"), Decimal("60.00000"))]


def test_nulls_in_aggregates(engine, fruit):
    found = engine.sql(f"SELECT COUNT(price) AS n, SUM(price) AS s, AVG(price) AS a, MIN(price) AS lo, FIRST(item) AS f, LAST(item) AS l, DISTINCT_COUNT(category) AS d FROM {fruit}").head()
    assert tuple(found) == (6, Decimal("390.00000"), Decimal("78.00000"), 50, "Apple", "Broccoli", 3)


def test_order_and_limit(engine, fruit):
    assert [r.price for r in engine.sql(f"SELECT price FROM {fruit} ORDER BY price DESC LIMIT 1, 2").collect()] == [90, 80]
    assert [r.price for r in engine.sql(f"SELECT price FROM {fruit} ORDER BY price LIMIT 2").collect()] == [None, 50]
    assert [r.item for r in engine.sql(f"SELECT item FROM {fruit} ORDER BY price DESC LIMIT 1").collect()] == ["Apple"]  # sorts by a column that is not selected
    assert engine.sql(f"SELECT DISTINCT category FROM {fruit} LIMIT 1, 5").count() == 2


@pytest.mark.parametrize("sql", ["SELECT *, COUNT(*) FROM {t} GROUP BY category", "SELECT * FROM {t} GROUP BY category", "SELECT item FROM {t} GROUP BY category", "SELECT nothing FROM {t}", "SELECT MEDIAN(price) FROM {t}", "SELECT COUNT(nothing) FROM {t}", "ALTER TABLE {t} ADD x INT", "SELECT category FROM {t} HAVING price > 1"])
def test_refused(engine, fruit, sql):
    with pytest.raises(EngineError):
        engine.sql(sql.format(t=fruit)).collect()


def test_statements():
    assert statements("SELECT 'a;b' FROM t; -- x;\n/* ; */ SELECT 2 FROM u;") == ["SELECT 'a;b' FROM t", "-- x;\n/* ; */ SELECT 2 FROM u"]


def test_ddl_round_trip():
    ddl = "CREATE TABLE t.tkt (id UINT NOT NULL, Name STRING(100) NOT NULL DEFAULT 'it\\'s' COMMENT 'a, b', pay DECIMAL(10,2), raw VARBINARY(8), at DATETIME, PRIMARY KEY (id), KEY IX_NAME (name, id)) STORAGE=MEMORY, DELIMITER=',', QUOTE='\"'"
    meta = parse(ddl).meta
    again = parse(meta.ddl()).meta
    assert isinstance(meta, Meta) and again == meta
    assert meta.columns[1].default == "it's" and meta.index("ix_name").keys == ("name", "id") and str(meta.columns[3].type) == "BYTES(8)"


@pytest.mark.parametrize("ddl", ["CREATE TABLE t (a BLOB)", "CREATE TABLE t (a STRING(0))", "CREATE TABLE t (a INT, PRIMARY KEY (b))", "CREATE TABLE t (a JSON)"])
def test_ddl_refused(ddl):
    with pytest.raises(EngineError):
        parse(ddl)


def test_catalogue(spark, engine, fruit):
    assert [tuple(r) for r in engine.sql(f"DESC {fruit}").collect()][0] == ("category", "STRING", "", None)
    assert "price INT64" in engine.sql(f"META {fruit}").head()[0]
    assert engine.sql(f"SHOW TABLES WHERE {fruit.rsplit('/', 1)[0]}").select("Table", "Rows").collect() == [("fruit.parquet", 6)]
    engine.sql(f"DROP TABLE {fruit}")
    with pytest.raises(EngineError) as e:
        engine.sql(f"SELECT * FROM {fruit}")
    assert e.value.code == -3000
    with pytest.raises(SqlSyntaxError):
        engine.sql("SELEC * FROM x")
