import io
import json
import threading
import urllib.request
from datetime import date
from decimal import Decimal

import pytest

from tablekit import cli, webui
from tablekit.errors import EngineError
from tablekit.functions import kernels
from tablekit.functions.aggregates import Function, Key, aggregate, between, time
from tablekit.operators import pipeline
from tablekit.operators.lookup import lookup
from tablekit.plans.parser import parse
from tablekit.streaming import files as stream_files

from .conftest import rows

XML = """<pipeline name="p" max-errors="{errors}">
  <loop home="{home}" date="-2..0" dateDash="-2..0" format-date="yyyyMMdd" format-dateDash="yyyy-MM-dd" threads="2">
    <input type="filesystem" max-depth="1"><directory>{{home}}/in/{{dateDash}}</directory><pattern>log_\\w+\\.tsv</pattern></input>
    <output>
      <meta><columns>
        <column name="id" type="int64" from="id" not-null="true"/>
        <column name="hash" type="int64" from="missing,client" transform="hash" not-null="true"/>
        <column name="os" type="string" bytes="16" from="os" default="none"/>
      </columns><indexes><primary columns="id"/></indexes><format type="parquet" compression="snappy"/></meta>
      <filter from="client" source="{home}/active.parquet"><condition operator="eq" lookup="WHERE client_id = ?"/></filter>
      <directory>{home}/out</directory><filename>logs_{{date}}.parquet</filename>
      <if exists="yes">skip</if><sort columns="id"/>
    </output>
  </loop>
</pipeline>"""


@pytest.fixture
def home(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",), (None,)], "client_id string").write.parquet(f"{tmp_path}/active.parquet")
    for day in ("2024-03-01", "2024-03-02"):
        (tmp_path / "in" / day).mkdir(parents=True)
        (tmp_path / "in" / day / "log_x.tsv").write_text("id\tclient\tos\n3\ta\tlinux\n1\tb\t\\N\n2\tc\tmac\nbad\ta\tmac\n4\t\\N\tmac\n")
        (tmp_path / "in" / day / "log_y.tsv").write_text("id\tclient\tos\n9\tb\twin\n")
    return tmp_path


def test_loop(engine, home):
    p = pipeline.from_xml(XML.format(home=home, errors=1))
    found = sorted(p.run(engine, date(2024, 3, 2)), key=lambda r: r.output)
    assert [(r.rows_in, r.rows_out, r.errors) for r in found] == [(6, 3, 1)] * 2
    out = engine.open(f"{home}/out/logs_20240301.parquet").collect()
    assert [tuple(r) for r in out] == [(1, kernels.fnv63("b"), "none"), (3, kernels.fnv63("a"), "linux"), (9, kernels.fnv63("b"), "win")]
    assert all(r.skipped for r in p.run(engine, date(2024, 3, 2)))
    strict = pipeline.from_xml(XML.format(home=home, errors=0).replace("logs_{date}", "strict_{date}"))
    assert [(r.rows_out, r.errors) for r in strict.run(engine, date(2024, 3, 1))] == [(0, 1)]  # over the budget: a sorted output is not written
    assert not (home / "out" / "strict_20240301.parquet").exists()


def test_variables(monkeypatch):
    monkeypatch.setenv("TABLEKIT_X", "env")
    v = [pipeline.Variable("a", "value", "TABLEKIT_X", "default"), pipeline.Variable("b", default="default"), pipeline.Variable("d", first=-1, last=0, format="yyyyMMdd"), pipeline.Variable("e", first=-1, last=0)]
    assert list(pipeline.variable_sets(v, date(2024, 3, 1))) == [{"a": "env", "b": "default", "d": "20240229", "e": "2024-02-29"}, {"a": "env", "b": "default", "d": "20240301", "e": "2024-03-01"}]
    assert pipeline.basename("x.tsv.gz") == "x" and pipeline.basename("a.b.csv") == "a.b"


def test_into_table_and_handlers(spark, engine, home):
    xml = XML.format(home=home, errors=5).replace("logs_{date}.parquet", "keyed_{date}.tkt").replace("</loop>", '<row-handlers><handler class="double"/></row-handlers></loop>')
    with pytest.raises(EngineError):
        pipeline.from_xml(xml)
    p = pipeline.from_xml(xml, {"double": lambda df: df.withColumn("id", df.id.try_cast("bigint") * 2)})
    p.run(engine, date(2024, 3, 1))
    assert engine.one(f"{home}/out/keyed_20240301.tkt", "primary", [18]).os == "win"


def test_lookup(spark):
    df, other = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y"), (None, "x")], "id int, v string")
    assert rows(lookup(df, "k", other, "WHERE id = ?")) == [(1,)]
    assert rows(lookup(df, "k", other, "WHERE id = ?", "neq")) == [(2,)]
    assert lookup(df, "k", other, "WHERE v = 'x'").count() == 3 and lookup(df, "k", other, "WHERE v = 'q'").count() == 0


def test_kernels(spark):
    # published vectors: FNV-1a of "" and "a" before folding are cbf29ce484222325 and af63dc4c8601ec8c
    for text, h in (("", 0xCBF29CE484222325), ("a", 0xAF63DC4C8601EC8C)):
        assert kernels.fnv63(text) == (h ^ (h >> 32)) & (2**63 - 1)
    texts = ["", "a", "é", "long " * 200, "\U0001f600", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(kernels.hash63("t")).collect()] == [None if t is None else kernels.fnv63(t) for t in texts]
    assert len({kernels.murmur2_64a(b"x" * n) for n in range(20)}) == 20
    a = spark.createDataFrame([("2001:db8::1",), ("20010db8000000000000000000000001",), ("10.0.0.1",), ("x",)], "t string").select(kernels.ipv6_to_bytes("t").alias("b"))
    assert [r[0] for r in a.select(kernels.bytes_to_ipv6("b")).filter("b IS NOT NULL").collect()] == ["2001:db8::1", "2001:db8::1", "::ffff:10.0.0.1"]
    assert a.select(kernels.bytes_to_uuid(a.b)).head()[0] == "20010db8-0000-0000-0000-000000000001"


def test_aggregate_builder(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", 1, "2024-01-01"), ("a", 5, "2024-02-01"), ("b", None, None), ("c", 2, "2024-01-05")], "k string, v int, d string").withColumn("d", F.to_date("d"))
    out = aggregate(df, [time("month", "d", "yyyy-MM")], [Function("COUNT", alias="n"), Function("ROWID", (), "id", start=10)])
    assert rows(out) == [("2024-01", 2, 11), ("2024-02", 1, 12), ("<NULL>", 1, 10)] or rows(out)[0][0] == "2024-01"
    only = aggregate(df, [Key("k", "k")], [Function("SUM", ["v"], "s", between("v", 2, 9))])
    assert rows(only) == [("a", Decimal("5.00000")), ("c", Decimal("2.00000"))]
    assert rows(aggregate(df, [], [Function("DISTINCT_SET", ["v"], "s"), Function("NULL", (), "x")])) == [([1, 2, 5], None)]
    with pytest.raises(EngineError):
        aggregate(df, [], [Function("NOPE", ["v"])])


def test_cli(spark, tmp_path, capsys):
    spark.createDataFrame([(1, None)], "a int, b string").write.parquet(f"{tmp_path}/t.parquet")
    out = io.StringIO()
    assert cli.main(["-sql", f"SELECT * FROM {tmp_path}/t.parquet; SELECT COUNT(*) AS n FROM {tmp_path}/t.parquet"], spark, out) == 0
    assert out.getvalue() == "a\tb\n1\t\\N\nn\n1\n"
    out = io.StringIO()
    cli.main(["-sql", f"SELECT a FROM {tmp_path}/t.parquet", "-pretty", "-rownum"], spark, out)
    assert out.getvalue().splitlines() == ["+---+---+", "| # | a |", "+---+---+", "| 1 | 1 |", "+---+---+"]
    assert cli.main(["-sql", "SELECT * FROM nowhere.parquet"], spark, out) == 1
    assert "-3000" in capsys.readouterr().err


def test_web(engine, spark, tmp_path):
    spark.createDataFrame([(1, None)], "a int, b string").write.parquet(f"{tmp_path}/t.parquet")
    s = webui.server(engine, 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_port}"
    try:
        assert b"<textarea" in urllib.request.urlopen(url).read()
        body = json.dumps({"q": f"SELECT * FROM {tmp_path}/t.parquet"}).encode()
        assert json.load(urllib.request.urlopen(url, body)) == [["a", "b"], ["1", None]]
    finally:
        s.shutdown()


def test_stream(spark, tmp_path):
    meta = parse("CREATE TABLE t (id INT, w STRING(9))").meta
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("id\tw\n1\tx\\ty\n")
    frame = lambda: stream_files.stream(spark, f"{tmp_path}/in", meta, "tsv")
    stream_files.drain(frame(), f"{tmp_path}/state", stream_files.append_to(spark, f"{tmp_path}/out"))
    (tmp_path / "in" / "b.tsv").write_text("id\tw\n2\t\\N\n")
    stream_files.drain(frame(), f"{tmp_path}/state", stream_files.append_to(spark, f"{tmp_path}/out"))
    assert rows(spark.read.parquet(f"{tmp_path}/out").select("id", "w", "batch")) == [(1, "x\ty", 0), (2, None, 1)]


def test_onstart_policy_and_row_filter(spark, engine, home):
    xml = XML.format(home=home, errors=9).replace("<loop", f'<onstart error="POLICY">echo {{dateDash}} &gt;&gt; {home}/started; false</onstart><loop', 1).replace("-2..0", "2024-03-01..2024-03-02")
    with pytest.raises(EngineError):
        pipeline.from_xml(xml.replace("POLICY", "exit")).run(engine, allow_shell=True)
    p = pipeline.from_xml(xml.replace("POLICY", "continue").replace("<sort columns=\"id\"/>", ""), row_filters=[lambda df: df.os != "win"])
    found = sorted(p.run(engine, allow_shell=True), key=lambda r: r.output)
    assert [(r.rows_in, r.rows_out, r.errors) for r in found] == [(6, 1, 1)] * 2  # a null os does not meet the filter
    assert (home / "started").read_text().split() == ["2024-03-01", "2024-03-01", "2024-03-02"]
    with pytest.raises(EngineError):
        pipeline.from_xml(xml.replace("POLICY", "perhaps"))
