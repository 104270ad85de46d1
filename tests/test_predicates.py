import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablekit.errors import SqlSyntaxError
from tablekit.plans.parser import parse, parse_condition
from tablekit.plans.predicates import predicate, resolver

CORPUS = [
    ("l_orderkey <= 1002", [0, 1, 2]),
    ("l_orderkey = 1001 AnD l_quantity = 1", [1]),
    ("l_orderkey = 1002 AND l_quantity = 2", [2]),
    ("l_orderkey = 1002 AND l_quantity <> 1", [2]),
    ("l_orderkey = 1002 AND l_quantity != 1", [2]),
    ("l_orderkey > 1003 AND l_quantity < 6", [4, 5]),
    ("l_comment != NULL", list(range(10))),
    ("(l_orderkey = 1001 OR l_orderkey = 1002) AND l_comment = 'comment - 1'", [1]),
    ("l_comment like 'comment%'", list(range(10))),
    ("l_comment like '%comment%'", list(range(10))),
    ("l_comment like '*comment*'", list(range(10))),
    ("l_comment like '%- 5%'", [5]),
    ("l_comment like '*- 7*'", [7]),
    ("l_comment like '%9'", [9]),
    ("l_comment like '*3'", [3]),
    ("l_quantity = NULL", [10]),
    ("l_comment = NULL", [10, 11]),
    ("l_quantity != NULL", [*range(10), 11]),
    ("l_orderkey = 1010 AND l_quantity = NULL", [10]),
    ("l_orderkey = 1011 AND l_comment = NULL", [11]),
    ("l_quantity <> 3", [0, 1, 2, *range(4, 12)]),
    ("l_quantity > 8", [9, 11]),
    ("l_quantity BETWEEN 3 AND 5", [3, 4, 5]),
    ("l_quantity IN (1, 2, NULL)", [1, 2, 10]),
    ("NOT l_quantity < 9", [9, 10, 11]),
    ("l_quantity IS NULL", [10]),
    ("l_comment = 'a AND b' OR l_quantity = 1", [1]),
]


@pytest.fixture(scope="module")
def table(spark):
    data = [(1000 + i, i, f"comment - {i}") for i in range(10)] + [(1010, None, None), (1011, 11, None)]
    return spark.createDataFrame(data, "l_orderkey bigint, l_quantity bigint, l_comment string").cache()


@pytest.mark.parametrize("text,expected", CORPUS)
def test_corpus(table, text, expected):
    found = table.filter(predicate(parse_condition(text), resolver(table.schema))).collect()
    assert sorted(r[0] - 1000 for r in found) == expected


@pytest.mark.parametrize("text", ["a == 1", "a := 1", "a <=> 1", "a =", "a", "a = 1 AND", "(a = 1", "a = 1)", "= 1"])
def test_errors(text):
    with pytest.raises(SqlSyntaxError):
        parse_condition(text)


def test_missing_where():
    with pytest.raises(SqlSyntaxError, match="WHERE"):
        parse("SELECT * FROM t.parquet a = 1")


def test_dml_needs_where():
    for sql in ("DELETE FROM t.tkt", "UPDATE t.tkt SET a = 1"):
        with pytest.raises(SqlSyntaxError):
            parse(sql)


terms = st.sampled_from(["a < 3", "a >= 2", "b = 'x'", "b <> 'y'", "a IN (1, 4)", "b LIKE 'x%'", "a BETWEEN 1 AND 3", "b = NULL", "NOT a = 2"])
conditions = st.recursive(terms, lambda c: st.tuples(c, st.sampled_from(["AND", "OR"]), c).map(lambda t: f"({t[0]}) {t[1]} ({t[2]})"), max_leaves=5)
DUCK = {"b <> 'y'": "b IS DISTINCT FROM 'y'", "b = NULL": "b IS NULL", "NOT a = 2": "NOT coalesce(a = 2, false)"}


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(conditions)
def test_random(spark, text):
    data = [(a, b) for a in (None, 0, 1, 2, 3, 4) for b in (None, "x", "xx", "y")]
    df = spark.createDataFrame(data, "a int, b string")
    duck_text = text
    for k, v in DUCK.items():
        duck_text = duck_text.replace(k, v)
    values = ", ".join(f"({'NULL' if a is None else a}, {'NULL' if b is None else repr(b)})" for a, b in data)
    wanted = duckdb.sql(f"SELECT * FROM (VALUES {values}) t(a, b) WHERE {duck_text}").fetchall()
    found = [tuple(r) for r in df.filter(predicate(parse_condition(text), resolver(df.schema))).collect()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)
