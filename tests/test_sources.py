import json
import os
import subprocess
import sys
import zipfile
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest

from tablekit import Engine
from tablekit.errors import EngineError
from tablekit.plans.parser import parse
from tablekit.sources import registry, text, union
from tablekit.sources.jdbc import aliases, change, query, target
from tablekit.sources.paths import date_in_directory, date_in_name, walk

from .conftest import rows

DDL = "CREATE TABLE t (id INT64, name STRING(128), score DECIMAL(20,5), dt DATE, ts TIME)"
DATA = [(1, "Alice", Decimal("12.34500"), date(2025, 8, 9), datetime(2025, 8, 9, 10, 20, 30)), (2, "Bob\t\"B\", \\N\nx", Decimal("98.76500"), date(2025, 8, 8), datetime(2025, 8, 8, 23, 59, 59)), (3, None, Decimal("77.00000"), date(2025, 8, 7), datetime(2025, 8, 7))]


@pytest.mark.parametrize("suffix", ["tsv", "csv", "tsv.gz", "csv.gz", "jsonl", "parquet", "tbl"])
def test_round_trip(spark, engine, tmp_path, suffix):
    meta, path = parse(DDL).meta, f"{tmp_path}/t.{suffix}"
    registry.write_file(spark, spark.createDataFrame(DATA, meta.spark), path, meta)
    assert rows(engine.open(path)) == rows(spark.createDataFrame(DATA, meta.spark))
    assert engine.find(path, "WHERE id >= 2").count() == 2
    with pytest.raises(EngineError):
        registry.write_file(spark, spark.range(1), path)


def test_text_traps(engine, tmp_path):
    (tmp_path / "a.csv").write_text('ID,name,n\n1,"NULL",\n2,NULL,5\n3,"a ""b"", c",6\n4,,7\n5,"two\nlines",8\n\n')
    assert rows(engine.open(f"{tmp_path}/a.csv")) == [("1", "NULL", ""), ("2", None, "5"), ("3", 'a "b", c', "6"), ("4", "", "7"), ("5", "two\nlines", "8")]
    (tmp_path / "a.tsv").write_text("id\tname\n1\ta\\tb\n2\t\\N\n3\tx\\\\ty\n4\t\\\\N\n5\tl\\nm\n")
    assert rows(engine.open(f"{tmp_path}/a.tsv")) == [("1", "a\tb"), ("2", None), ("3", "x\\ty"), ("4", "\\N"), ("5", "l\nm")]
    (tmp_path / "a.tsv.desc").write_text("CREATE TABLE a (id INT64, name STRING(9), extra STRING(9) DEFAULT 'e')")
    assert engine.open(f"{tmp_path}/a.tsv").filter("id = 1").head() == (1, "a\tb", "e")


def test_split_line():
    tsv, csv = text.Dialect(), text.Dialect(",", '"', "NULL")
    assert text.split_line("a\\tb\t\\N\tx\\\\", tsv) == ["a\tb", None, "x\\"]
    assert text.split_line('"a ""b""",NULL,"NULL",', csv) == ['a "b"', None, "NULL", ""]


def test_custom_dialect_and_zip(engine, tmp_path):
    (tmp_path / "x.tbl").write_text("1|one|\n2|two|\n")
    (tmp_path / "x.tbl.desc").write_text("CREATE TABLE x (id INT, w STRING(9)) HEADER=ABSENT, DELIMITER='|'")
    assert rows(engine.open(f"{tmp_path}/x.tbl")) == [(1, "one"), (2, "two")]
    with zipfile.ZipFile(tmp_path / "y.csv.zip", "w") as z:
        z.writestr("first.csv", "a,b\n1,2\n")
        z.writestr("second.csv", "a,b\n3,4\n")
    assert rows(engine.open(f"{tmp_path}/y.csv.zip")) == [("1", "2")]
    assert rows(engine.open(f"{tmp_path}/y.csv.zip#second.csv")) == [("3", "4")]


def test_zip_entries_are_streams(engine, tmp_path):
    """Parsing holds a batch of an archive's entry, not all of it; its rows are those of the plain file."""
    import io
    import tracemalloc

    odd = 'a,b\r\n1,"x\n\ny"\r\n\r\n\r,\n2,NULL\n"NULL","q""r"\n3,\u20ac\n4,"open\n'
    body = "".join(f"{k},{'w' * 50}\n" for k in range(200_000))
    with zipfile.ZipFile(tmp_path / "z.csv.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("odd.csv", odd)
        z.writestr("big.csv", f"a,b\n{body}")
        z.writestr("bad.csv", b"a,b\n1,\xff\n")
        z.writestr("none.csv", "")
    wanted = [("1", "x\n\ny"), ("\r", ""), ("2", None), ("NULL", 'q"r'), ("3", "\u20ac"), ("4", "open\n")]
    assert rows(engine.open(f"{tmp_path}/z.csv.zip")) == sorted(wanted, key=repr)
    assert engine.open(f"{tmp_path}/z.csv.zip#big.csv").count() == 200_000 and engine.open(f"{tmp_path}/z.csv.zip#none.csv").count() == 0
    with pytest.raises(Exception, match="utf-8"):
        engine.open(f"{tmp_path}/z.csv.zip#bad.csv").collect()
    with zipfile.ZipFile(tmp_path / "z.csv.zip") as z:
        tracemalloc.start()
        assert sum(b.num_rows for b in text._parsed(z.open("big.csv"), text.Dialect(",", '"', "NULL"))) == 200_000
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert held < len(body) / 2
    assert list(text._lines(io.BytesIO(b"a\n\nb\n"))) == list(text._lines("a\n\nb\n")) == "a\n\nb\n".split("\n")


def test_gz_sibling(engine, tmp_path):
    import gzip

    with gzip.open(tmp_path / "g.tsv.gz", "wt") as f:
        f.write("a\n1\n")
    assert rows(engine.open(f"{tmp_path}/g.tsv")) == [("1",)]


def test_jsonl(engine, tmp_path):
    lines = [{"ID": 1, "ok": True, "list": [1, 2]}, {"id": 2, "name": "x"}]
    (tmp_path / "j.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    df = engine.open(f"{tmp_path}/j.jsonl")
    assert sorted(df.columns) == ["id", "list", "name", "ok"]
    assert rows(df.select("id", "ok", "list", "name")) == [(1, 1, "[1,2]", None), (2, None, None, "x")]


def test_type_prediction(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("a\tb\tc\td\n1\t1.5\t2024-01-02\tx\n2\t\t2024-01-03\t2024-1\n")
    schema = Engine(spark, predict_types=True).open(f"{tmp_path}/p.tsv").dtypes
    assert schema == [("a", "bigint"), ("b", "decimal(38,5)"), ("c", "date"), ("d", "string")]


def test_union(spark, engine, tmp_path):
    for k, folder in enumerate(["2024/07/27", "2024/07/28", "2024/07/29", "logs_2024-07-30", "20240731", "2024-08-01", "other/no_date"], 1):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / f"app_logs_{k}.csv").write_text(f"n\n{k}\n")
    keep = date_in_directory(date(2024, 7, 28), date(2024, 7, 31))
    d = union.Descriptor(str(tmp_path), r"app_logs_\d\.csv", 4, "asc")
    assert [f.name[9] for f in union.files(spark, d, keep)] == ["2", "3", "4", "5"]
    assert [r.n for r in union.read(spark, d, engine.open, keep, ordered=True).collect()] == ["2", "3", "4", "5"]
    (tmp_path / "all.union").write_text("directory=.\npattern=app_logs_\\d\\.csv\nmax_depth=4\nsort=desc\n")
    assert engine.rows(f"{tmp_path}/all.union") == 7
    assert date_in_name(date(2024, 1, 1), date(2024, 1, 2))(walk(spark, str(tmp_path), 1)[0]) is False
    with pytest.raises(EngineError):
        engine.sql(f"INSERT INTO {tmp_path}/all.union VALUES (1)")
    (tmp_path / "2024-08-01" / "app_logs_9.csv").write_text("other\n1\n")
    with pytest.raises(EngineError):
        engine.open(f"{tmp_path}/all.union")


def test_plugin(spark, engine):
    plugin = registry.Plugin("range", lambda p: p.endswith(".range"), lambda s, p, m: s.range(int(p.split(".")[0])), priority=5)
    registry.register(plugin)
    try:
        assert engine.sql("SELECT COUNT(*) AS n FROM 7.range").head().n == 7
    finally:
        registry.PLUGINS.remove(plugin)


def test_formats():
    assert [registry.format_of(p) for p in ("a.tbl.gz", "b.parquet", "c.union", "d.tkt", "e.gz", "f.csv.zip#x.csv", "jdbc:h2:mem")] == ["tsv", "parquet", "union", "native", "tsv", "csv", "jdbc"]
    with pytest.raises(EngineError):
        registry.format_of("x.exe")


def test_jdbc_texts():
    known = aliases("shop.url=jdbc:postgresql://h/db\nshop.user=u\n# x=1\n")
    t = target("@shop:orders", known)
    assert target("shop.orders", known) == t and t.properties == {"driver": "org.postgresql.Driver", "user": "u"}
    assert target("jdbc:mysql://h/db?useSSL=false&table=t", {}).url == "jdbc:mysql://h/db?useSSL=false"
    assert target("a.parquet", known) is None
    q = parse("SELECT a, COUNT(*) AS n FROM @shop:orders WHERE b = 'it''s' AND c >= 2 GROUP BY a HAVING n > 1 ORDER BY n DESC LIMIT 5, 10")
    assert query(t, q) == "SELECT a, COUNT(*) AS n FROM orders WHERE (b = 'it''s') AND (c >= 2) GROUP BY a HAVING n > 1 ORDER BY n DESC LIMIT 10 OFFSET 5"
    assert change(t, parse("UPDATE x SET a = NULL WHERE b != NULL")) == "UPDATE orders SET a = NULL WHERE b IS NOT NULL"
    assert change(t, parse("DELETE FROM x WHERE NOT a IN (1, 'b')")) == "DELETE FROM orders WHERE NOT (a IN (1, 'b'))"
    with pytest.raises(EngineError):
        target("jdbc:h2:mem", {})


def test_jdbc_round_trip(spark, engine):
    """Over the embedded Derby database that comes with Spark."""
    url = "jdbc:derby:memory:tablekit;create=true"
    from tablekit.sources import jdbc

    t = jdbc.Target(url, "people")
    assert jdbc.write(spark.createDataFrame([(1, "a"), (2, "b")], "ID int, NAME string"), t, "overwrite") == 2
    assert jdbc.execute(spark, t, "DELETE FROM people WHERE id = 1") == 1
    assert engine.sql(f"SELECT id, name FROM `{url}?table=people` WHERE id > 0").collect() == [(2, "b")]


def test_jdbc_meaning_of_null(spark, engine):
    """What the database does is what the engine does on a file of the same rows."""
    from tablekit.sources import jdbc

    data = spark.createDataFrame([(1, "ab"), (2, None), (3, "b"), (None, "abc")], "ID int, NAME string")
    t = jdbc.Target("jdbc:derby:memory:nulls;create=true", "things")
    jdbc.execute(spark, t, "CREATE TABLE things (ID INT, NAME VARCHAR(9))")
    assert jdbc.execute(spark, t, "INSERT INTO things VALUES (1, 'ab'), (2, NULL), (3, 'b'), (NULL, 'abc')") == 4
    for where in ("name <> 'b'", "name = NULL", "name != NULL", "id IN (1, NULL)", "id IN (NULL)", "name LIKE '*b'", "name LIKE 'a*'", "id < NULL", "id > 1 AND name <> 'x'", "NOT id = 3 AND id > 0"):
        found = engine.sql(f"SELECT id, name FROM `{t.url}?table=things` WHERE {where}").collect()
        from tablekit.plans.parser import parse_condition
        from tablekit.plans.predicates import predicate, resolver

        wanted = data.filter(predicate(parse_condition(where), resolver(data.schema))).collect()
        assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, wanted), key=repr), where
    assert [tuple(r) for r in engine.sql(f"SELECT id FROM `{t.url}?table=things` WHERE id > 0 ORDER BY id LIMIT 1, 2").collect()] == [(2,), (3,)]
    split = engine.sql(f"SELECT id, name FROM `{t.url}?table=things&partitionColumn=ID&numPartitions=3`")
    assert split.rdd.getNumPartitions() == 3 - 1 and split.count() == 4  # no more partitions than values between the ends
    assert query(jdbc.Target("jdbc:sqlserver://h", "t"), parse("SELECT * FROM x LIMIT 5")) == "SELECT * FROM t ORDER BY (SELECT NULL) OFFSET 0 ROWS FETCH NEXT 5 ROWS ONLY"


_APART = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", sys.argv[1]).config("spark.sql.shuffle.partitions", "2").getOrCreate()
from tablekit import Engine
from tablekit.sources import jdbc
t = jdbc.Target(f"jdbc:derby:{sys.argv[1]}/db;create=true", "things")
rows = [(k, None if k % 7 == 0 else f"t{k}") for k in range(1000)]
assert jdbc.write(spark.createDataFrame(rows, "ID int, NAME string").repartition(3), t, "overwrite") == 1000
assert jdbc.write(spark.createDataFrame([(1000, "x")], "ID int, NAME string"), t) == 1
e, name = Engine(spark), f"`{t.url}?table=things&partitionColumn=ID&numPartitions=3`"
assert e.sql(f"DELETE FROM {name} WHERE id = 1000").head()[0] == 1
assert sorted(map(tuple, e.open(name.strip("`")).collect())) == rows
assert [tuple(r) for r in e.sql(f"SELECT id, name FROM {name} ORDER BY id DESC").collect()] == rows[::-1]
assert [tuple(r) for r in e.sql(f"SELECT id FROM {name} ORDER BY id LIMIT 5, 3").collect()] == [(5,), (6,), (7,)]
assert e.sql(f"SELECT id FROM {name} WHERE id < 0").collect() == [] and jdbc.write(e.sql(f"SELECT id, name FROM {name} WHERE id < 0"), t) == 0
assert [r[0] for r in e.sql(f"DESC {name}").collect()] == ["id", "name"] and e.rows(name.strip("`")) == 1000
print("whole")
"""


def test_jdbc_embedded_where_executors_are_other_processes(tmp_path):
    """The database lives in the driver's process alone."""
    root = Path(__file__).parent.parent
    done = subprocess.run([sys.executable, "-c", _APART, str(tmp_path)], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip() == "whole", done.stderr[-2000:]


def test_text_exact(spark, engine, tmp_path):
    """Rows that look like a header, rows of one empty cell, code points without a character, and escapes of all kinds."""
    head = spark.createDataFrame([("v", "w"), ("V", "W"), ("", None), (None, ""), ("a￿\\n", "\\"), ("\\\\", "\t\n\r\\t"), ("\\N", "NULL"), ("'", '"')], "v string, w string")
    one = spark.createDataFrame([("",), ("v",), (None,), ("x",), ("",)], "v string")
    for suffix in ("tsv", "csv", "tsv.gz"):
        for k, df in enumerate((head, one)):
            registry.write_file(spark, df.repartition(3), f"{tmp_path}/{k}.{suffix}")
            assert rows(engine.open(f"{tmp_path}/{k}.{suffix}")) == rows(df), (suffix, k)
    (tmp_path / "h.tsv").write_text("v\tw\n1\t2\nv\tw\n3\t4\n")
    (tmp_path / "h.csv").write_text('v,w\r\n1,"2\n"\r\nv,w\r\n')
    assert rows(engine.open(f"{tmp_path}/h.tsv")) == [("1", "2"), ("3", "4"), ("v", "w")]
    assert rows(engine.open(f"{tmp_path}/h.csv")) == [("1", "2\n"), ("v", "w")]


def test_csv_reads_only_odd_files_whole(spark, engine, tmp_path):
    (tmp_path / "m.csv").mkdir()
    (tmp_path / "m.csv" / "a.csv").write_text('n,t\n1,"x\ny"\n')
    (tmp_path / "m.csv" / "b.csv").write_text('n,t\n2,"z"\n')
    df = engine.open(f"{tmp_path}/m.csv")
    assert rows(df) == [("1", "x\ny"), ("2", "z")]


def test_union_reads_alike_files_at_once(spark, tmp_path):
    """Files of one kind are one scan, whatever their number; others stand beside it."""
    import gzip

    for k in range(4):
        (tmp_path / f"u{k}.csv").write_text(f"n,t\n{k},\"x\"\n")
        spark.createDataFrame([(f"p{k}", None)], "n string, t string").write.parquet(f"{tmp_path}/u{k}.parquet")
    with gzip.open(tmp_path / "u9.csv.gz", "wt") as f:
        f.write("N,T\n9,\n")
    d = union.Descriptor(str(tmp_path), r"u\d\.(csv|parquet|csv\.gz)", 1)
    df = registry.read_union(spark, d)
    assert rows(df) == [("0", "x"), ("1", "x"), ("2", "x"), ("3", "x"), ("9", ""), ("p0", None), ("p1", None), ("p2", None), ("p3", None)]
    assert df._jdf.queryExecution().analyzed().toString().count("Relation") == 2
    spark.createDataFrame([(1,)], "other int").write.parquet(f"{tmp_path}/u8.parquet")
    with pytest.raises(EngineError):
        registry.read_union(spark, d)
