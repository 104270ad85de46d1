from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablekit import Engine
from tablekit.errors import EngineError

from .conftest import rows

DDL = "CREATE TABLE {t} (id UINT NOT NULL, name STRING(10) NOT NULL, age UINT8, salary DECIMAL(10,2) NOT NULL, PRIMARY KEY(id))"


@pytest.fixture
def path(engine, tmp_path):
    t = f"{tmp_path}/employees.tkt"
    engine.sql(DDL.format(t=t))
    for v in ("1,'Alice',30,60000.00", "2,'Bob',25,50000.00", "3,'Charlie',35,70000.00"):
        assert engine.sql(f"INSERT INTO {t} VALUES ({v})").head()[0] == 1
    return t


def test_sequence(engine, path, tmp_path):
    with pytest.raises(EngineError) as e:
        engine.sql(f"INSERT INTO {path} VALUES (3,'Again',1,1)")
    assert e.value.code == -1000
    engine.sql(f"REPLACE INTO {path} VALUES (3,'Charlie',35,70001.999)")
    engine.sql(f"UPDATE {path} SET salary = 65000.00 WHERE id = 2")
    assert engine.one(path, "primary", [3]).salary == Decimal("70001.99")  # rounded down
    assert engine.sql(f"DELETE FROM {path} WHERE id = 2").head()[0] == 1
    assert engine.sql(f"INSERT IGNORE INTO {path} VALUES (1,'Other',1,1)").head()[0] == 0
    for name, text in (("a", "id,name,age,salary\n4,D,40,1.5\n5,E,,2\n"), ("b", "id,name,salary\n7,G,3\n"), ("c", "id,salary,name,age\n10,4,J,9\n")):
        (tmp_path / f"{name}.csv").write_text(text)
        head = text.split("\n")[0]
        engine.sql(f"INSERT INTO {path} ({head}) FROM {tmp_path}/{name}.csv")
    assert [(r.id, r.name, r.age) for r in engine.find(path, "USE INDEX(PRIMARY) WHERE id > 3").collect()] == [(4, "D", 40), (5, "E", None), (7, "G", None), (10, "J", 9)]
    assert engine.rows(path) == 6


@pytest.mark.parametrize("values,code", [("9,NULL,1,1", -1003), ("9,'a name that is long',1,1", -2001), ("9,'x',300,1", 0), ("9,'x',1", -2000)])
def test_checks(engine, path, values, code):
    if code == 0:  # a number out of an unsigned type's range does not read as one
        engine.sql(f"INSERT INTO {path} VALUES ({values})")
        assert engine.one(path, "primary", [9]).age is None
        return
    with pytest.raises(EngineError) as e:
        engine.sql(f"INSERT INTO {path} VALUES ({values})")
    assert e.value.code == code and engine.rows(path) == 3


def test_transactions(spark, engine, path):
    engine.sql(f"BEGIN TRANSACTION {path}")
    engine.sql(f"INSERT INTO {path} VALUES (8,'H',1,1)")
    assert engine.rows(path) == 4 and Engine(spark).rows(path) == 3  # others see the state before
    with pytest.raises(EngineError) as e:
        Engine(spark).sql(f"DELETE FROM {path} WHERE id = 1")
    assert e.value.code == -5000
    engine.sql(f"ROLLBACK {path}")
    assert engine.rows(path) == 3
    engine.sql(f"BEGIN TRANSACTION {path}")
    engine.sql(f"INSERT INTO {path} VALUES (8,'H',1,1)")
    engine.sql("COMMIT")
    assert Engine(spark).rows(path) == 4
    with pytest.raises(EngineError):
        engine.sql(f"COMMIT {path}")
    with pytest.raises(ZeroDivisionError), engine.table(path) as t:
        t.insert(spark.createDataFrame([(20, "x", 1, Decimal(1))], t.meta.spark))
        1 / 0
    assert engine.rows(path) == 4


def test_key_change(engine, path):
    assert engine.sql(f"UPDATE {path} SET id = 30 WHERE id = 3").head()[0] == 1
    assert engine.one(path, "primary", [30]).name == "Charlie"
    with pytest.raises(EngineError):
        engine.sql(f"UPDATE {path} SET id = 1 WHERE id = 2")
    assert engine.rows(path) == 3


def test_into_and_drop(engine, path, tmp_path):
    engine.sql(f"SELECT id, salary INTO {tmp_path}/copy.tkt FROM {path} WHERE age > 26")
    assert engine.sql(f"SELECT COUNT(*) AS n FROM {tmp_path}/copy.tkt").head().n == 2
    with pytest.raises(EngineError):
        engine.sql(f"SELECT id INTO {tmp_path}/copy.tkt FROM {path}")
    engine.sql(f"DROP TABLE {path}")
    with pytest.raises(EngineError):
        engine.rows(path)


def test_temporary(engine):
    engine.sql("CREATE TEMPORARY TABLE @t (id INT64, PRIMARY KEY (id))")
    engine.temporary["@t"]  # noqa: B018
    with pytest.raises(EngineError):
        engine.sql("CREATE TABLE plain.csv (id INT64, PRIMARY KEY (id))")


def test_close(spark, path):
    """Temporary tables and open transactions end with the engine."""
    from tablekit.sources.paths import exists

    with Engine(spark) as own:
        own.sql("CREATE TEMPORARY TABLE @t (id INT64, PRIMARY KEY (id))")
        own.sql("INSERT INTO @t VALUES (1)")
        folder = own.temporary["@t"]
        own.sql(f"BEGIN TRANSACTION {path}")
        own.sql(f"DELETE FROM {path} WHERE id = 1")
    assert not exists(spark, folder) and not exists(spark, f"{path}/LOCK") and Engine(spark).rows(path) == 3


steps = st.lists(st.tuples(st.sampled_from(["replace", "delete", "update"]), st.integers(0, 4), st.integers(0, 99)), max_size=5)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(steps)
def test_model(spark, tmp_path_factory, steps):
    """A table behaves as a dictionary does."""
    engine, t, model = Engine(spark), f"{tmp_path_factory.mktemp('m')}/m.tkt", {}
    engine.sql(f"CREATE TABLE {t} (k INT64, v INT64, PRIMARY KEY (k))")
    for what, k, v in steps:
        if what == "replace":
            engine.sql(f"REPLACE INTO {t} VALUES ({k}, {v})")
            model[k] = v
        elif what == "delete":
            engine.sql(f"DELETE FROM {t} WHERE k = {k}")
            model.pop(k, None)
        else:
            engine.sql(f"UPDATE {t} SET v = {v} WHERE k <= {k}")
            model = {a: v if a <= k else b for a, b in model.items()}
    assert rows(engine.open(t)) == sorted(model.items(), key=repr)


def test_options(engine, tmp_path):
    t = f"{tmp_path}/o.tkt"
    engine.sql(f"CREATE TABLE {t} (id INT64, PRIMARY KEY (id)) COMPRESSOR=lz4, WAL=LOG, CACHE=1M")
    engine.sql(f"INSERT INTO {t} VALUES (1)")
    assert [p.suffixes for p in tmp_path.glob("o.tkt/data-*/*.parquet")][0][-2:] == [".lz4raw", ".parquet"] and engine.rows(t) == 1
    assert "COMPRESSOR=lz4" in engine.sql(f"META {t}").head()[0]


def test_failed_statement_leaves_no_trace(engine, path):
    """Within a transaction, too: what it staged is taken back, what came before stays."""
    engine.sql(f"BEGIN TRANSACTION {path}")
    engine.sql(f"INSERT INTO {path} VALUES (8,'H',1,1)")
    for sql in (f"UPDATE {path} SET id = 1 WHERE id = 2", f"INSERT INTO {path} VALUES (3,'x',1,1)", f"UPDATE {path} SET name = NULL WHERE id = 8"):
        with pytest.raises(EngineError):
            engine.sql(sql)
        assert sorted(r.id for r in engine.open(path).collect()) == [1, 2, 3, 8]
    engine.sql(f"COMMIT {path}")
    assert sorted(r.id for r in engine.open(path).collect()) == [1, 2, 3, 8] and engine.one(path, "primary", [1]).name == "Alice"


def test_crash_between_writing_and_naming(spark, engine, path, monkeypatch):
    """A manifest that never got its name changes nothing, and the next change goes on."""
    from tablekit.operators import tables

    def crash(spark, path, text):
        fs, p = tables.file_system(spark, f"{path}.new")
        stream = fs.create(p, True)
        stream.write(bytearray(text[: len(text) // 2].encode()))
        stream.close()
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(tables, "write_text", crash)
        engine.sql(f"DELETE FROM {path} WHERE id = 1")
    assert Engine(spark).rows(path) == 3
    tables.delete(spark, f"{path}/LOCK")  # what an operator does after a crash
    engine.sql(f"DELETE FROM {path} WHERE id = 1")
    assert Engine(spark).rows(path) == 2


def test_upsert_rewrites_one_file_of_many(spark, engine, tmp_path):
    t = f"{tmp_path}/many.tkt"
    engine.sql(f"CREATE TABLE {t} (id INT64, v INT64, PRIMARY KEY (id))")
    shuffled = spark.range(40_000).selectExpr("pmod(id * 7919, 40000) AS id", "id AS v").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        engine.table(t).insert(shuffled)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    before = {f.path for f in engine.table(t).manifest().files}
    assert len(before) == 4
    engine.sql(f"REPLACE INTO {t} VALUES (5, -1)")
    after = {f.path for f in engine.table(t).manifest().files}
    assert len(before & after) == 3 and engine.rows(t) == 40_000 and engine.one(t, "primary", [5]).v == -1
    ranges = sorted((f.low, f.high) for f in engine.table(t).manifest().files if f.path in before)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
