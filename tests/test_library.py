"""Schemas, codecs, generators, sinks, streams."""

import json

import pytest
from pyspark.sql import functions as F

from brightloom.functions import codecs as C
from brightloom.functions import dictionaries as D
from brightloom.operators import analytics as A
from brightloom.operators import shaping as S
from brightloom.plans import schemas
from brightloom.sources import distributions, sinks, tpcds, tpch
from brightloom.streaming.ingest import stream_table


def test_schemas():
    assert sum(len(schemas.schema("h", t)) for t in schemas.TPCH) == 61
    assert sum(len(schemas.schema("ds", t)) for t in schemas.TPCDS) == 424
    with pytest.raises(ValueError, match="unknown table"):
        schemas.schema("h", "nothing")


@pytest.mark.parametrize(("suite", "module", "tables"), [("h", tpch, schemas.TPCH), ("ds", tpcds, schemas.TPCDS)])
def test_generated_schema(spark, suite, module, tables):
    for t in tables:
        want, got = schemas.schema(suite, t), module.generate(spark, t, 0.001).schema
        assert [(f.name, f.dataType) for f in want] == [(f.name, f.dataType) for f in got], t


def test_rows_do_not_depend_on_partitions(spark):
    a = tpch.generate(spark, "lineitem", 0.001)
    assert a.count() == a.repartition(7).distinct().count()
    orders = tpch.generate(spark, "orders", 0.001)
    assert orders.count() == tpch.row_count("orders", 0.001) and a.join(orders, a.l_orderkey == orders.o_orderkey, "left_anti").count() == 0
    assert orders.where("o_custkey % 3 = 0").count() == 0
    with pytest.raises(ValueError, match="positive"):
        tpch.row_count("orders", 0)


def test_referential_integrity_of_sales(spark):
    sales, back = tpcds.generate(spark, "store_sales", 0.001), tpcds.generate(spark, "store_returns", 0.001)
    assert back.count() == sales.select("ss_ticket_number").distinct().count()
    assert sales.where(F.abs(F.col("ss_net_paid") - (F.col("ss_ext_sales_price") - F.col("ss_coupon_amt"))) > 0.005).count() == 0
    items = tpcds.generate(spark, "item", 0.001)
    assert sales.join(items, sales.ss_item_sk == items.i_item_sk, "left_anti").count() == 0


def test_codecs(spark):
    for name, values in D.DICTIONARIES.items():
        df = spark.createDataFrame([(v,) for v in [*values, "no such value", None]], "v string")
        code = C.encode(F.col("v"), values)
        got = [(r["v"], r["c"], r["b"]) for r in df.select("v", code.alias("c"), C.decode(code, values).alias("b")).collect()]
        assert got[:-2] == [(v, values.index(v), v) for v in values], name
        assert got[-2] == ("no such value", -1, None) and got[-1] == (None, None, None)
    one = spark.createDataFrame([("Brand#23", "1998-12-31", 'a"b,c', 7), ("Brand#7", "1999-01-01", None, 12345)], "b string, d string, t string, z int")
    assert [tuple(r) for r in one.select(C.brand_code(F.col("b")), C.date_code(F.col("d")), C.csv_field(F.col("t")), C.zip_code(F.col("z"))).collect()] == [(7, 2556, '"a""b,c"', "00007"), (None, None, "", "12345")]
    assert [C.zigzag(n) for n in (0, 1, -1, 64)] == [b"\x00", b"\x02", b"\x01", b"\x80\x01"] and C.avro_bytes("hello")[:1] == b"\x0a"


def test_distribution_file(spark, tmp_path):
    (tmp_path / "d.dss").write_text("# note\nbegin Colours\ncount|2\nred|1\ngreen|3\nend Colours\nBEGIN sizes\nCOUNT|1\nbig|5\nEND sizes\n")
    got = {(r["dist"], r["pos"], r["token"], r["weight"], r["cum_weight"]) for r in distributions.read(spark, str(tmp_path / "d.dss")).collect()}
    assert got == {("colours", 0, "red", 1, 1), ("colours", 1, "green", 3, 4), ("sizes", 0, "big", 5, 5)}


@pytest.mark.parametrize("kind", [k for k in sinks.FORMATS if k != "lance"])
def test_sinks_read_back(spark, tmp_path, kind):
    df = tpch.generate(spark, "supplier", 0.01).union(tpch.generate(spark, "supplier", 0.01).withColumn("s_name", F.lit('a "quoted", name')))
    path = f"{tmp_path}/{kind}"
    sinks.write(df, kind, path, rows_per_file=60)
    back = sinks.read(spark, kind, path, df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert sinks.size_of(spark, path) > 0
    if kind == "iceberg":
        meta = json.loads((tmp_path / kind / "metadata" / "v1.metadata.json").read_text())
        snapshot = meta["snapshots"][0]
        assert snapshot["summary"]["total-records"] == str(df.count()) and (tmp_path / kind / "metadata" / "version-hint.text").read_text() == "1"
        assert open(snapshot["manifest-list"], "rb").read(4) == b"Obj\x01"


def test_sinks_reject(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="unknown format"):
        sinks.write(df, "xls", "/tmp/none")
    with pytest.raises(ValueError, match="unknown compression"):
        sinks.write(df, "parquet", "/tmp/none", "lzo")


def test_stream(spark, tmp_path):
    df = tpch.generate(spark, "part", 0.001)
    df.write.parquet(f"{tmp_path}/in")
    stream_table(spark, f"{tmp_path}/in", df.schema, "parquet", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == df.count()


def test_shaping_and_reports(spark):
    df = spark.range(10)
    assert S.limit_rows(df, ["id"], 0).count() == 10 and S.limit_rows(df, ["id"], 3).count() == 3
    assert S.flatten(df, F.col("id")).count() == 45
    assert S.output_name("/x/", "part", "orc") == "/x/part.orc"
    with pytest.raises(ValueError, match="unknown format"):
        S.output_name("/x", "part", "xls")
    assert [r[0] for r in spark.createDataFrame([(5.0,), (1234.0,), (2.5e6,)], "v double").select(A.human(F.col("v"))).collect()] == ["5", "1.2K", "2.5M"]
    text = "Rows written: 1,000\nTime elapsed: 2.5 s\nThroughput: 400 rows/sec"
    row = spark.createDataFrame([(text,)], "t string").select(*[A.metric(F.col("t"), m).alias(m) for m in A.METRICS]).first()
    assert (row["rows_written"], row["elapsed"], row["throughput"], row["file_size"]) == (1000.0, 2.5, 400.0, None)
