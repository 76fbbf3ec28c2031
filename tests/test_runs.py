"""Runs over tables, table formats' metadata, plug-ins, and the parsers of distribution files."""

import io
import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from brightloom import __main__ as cli
from brightloom.functions import codecs as C
from brightloom.operators import analytics as A
from brightloom.operators import shaping as S
from brightloom.plans import runs
from brightloom.sources import avro, distributions, plugins, sinks, tables, text, tpcds, tpch

RECORD = {"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": ["null", "string"]}, {"name": "c", "type": {"type": "array", "items": "int"}}, {"name": "d", "type": "double"}, {"name": "e", "type": "boolean"}]}


@pytest.mark.parametrize("value", [0, 1, -1, 63, 64, -65, 300, 2**63 - 1, -(2**63)])
def test_numbers(value):
    raw = avro.encode("long", value)
    assert avro.read_long(io.BytesIO(raw)) == value
    assert {0: b"\x00", 1: b"\x02", -1: b"\x01", 300: b"\xd8\x04"}.get(value, raw) == raw and (abs(value) < 2**62 or len(raw) == 10)


def test_avro_values():
    assert avro.encode("string", "hello") == b"\x0ahello" and avro.encode("bytes", bytes([0xAA, 0xBB, 0xCC, 0xDD])) == b"\x08\xaa\xbb\xcc\xdd"
    assert avro.encode(["null", "long"], None) == b"\x00" and avro.encode(["null", "long"], 5) == b"\x02\x0a"
    with pytest.raises(ValueError, match="no Avro encoding"):
        avro.encode("fixed", b"")


@pytest.mark.parametrize("n", [0, 1, 5, 2_500])
def test_containers(n):
    rows = [{"a": i - 3, "b": None if i % 3 else f"é{i}", "c": list(range(i % 4)), "d": i / 7, "e": i % 2 == 0} for i in range(n)]
    raw = avro.container(RECORD, rows, {"own": "x"})
    meta, back = avro.read_container(raw)
    assert raw[:4] == b"Obj\x01" and json.loads(meta["avro.schema"]) == RECORD and meta["own"] == "x" and back == rows
    with pytest.raises(ValueError, match="not an Avro"):
        avro.read_container(b"nothing at all")


@pytest.mark.parametrize("kind", ["iceberg", "paimon"])
def test_metadata_leads_to_the_rows(spark, tmp_path, kind):
    path, df = f"{tmp_path}/t.{kind}", tpch.generate(spark, "supplier", 0.01)
    for _ in range(2):  # the second time overwrites
        sinks.write(df.repartition(2), kind, path, rows_per_file=30)
    files = tables.iceberg_files(spark, path) if kind == "iceberg" else tables.paimon_files(spark, path)
    assert len(files) >= 4 and len(set(files)) == len(files)
    assert sorted(map(str, sinks.read(spark, kind, path, df.schema).collect())) == sorted(map(str, df.collect()))
    stray = files[0].removeprefix("file:").rsplit("/", 1)[0] + "/not-committed.parquet"
    with open(stray, "wb") as f:
        f.write(b"no table")
    assert sinks.read(spark, kind, path, df.schema).count() == 100
    meta = [x for x in os.listdir(f"{path}/{'metadata' if kind == 'iceberg' else 'manifest'}") if not x.startswith(".")]
    assert len(meta) == (4 if kind == "iceberg" else 2)


def test_paimon_layout(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.write(tpch.generate(spark, "nation", 1).coalesce(1), "paimon", path)
    assert {"OPTIONS", "schema", "bucket-0", "manifest", "snapshot"} == {x for x in os.listdir(path) if not x.startswith(".")}
    options = (tmp_path / "t" / "OPTIONS").read_text()
    assert "table.type=APPEND_ONLY" in options and "data-files.format=parquet" in options
    schema, snapshot = (json.loads((tmp_path / "t" / x).read_text()) for x in ("schema/schema-0", "snapshot/snapshot-1"))
    assert [(f["id"], f["name"], f["type"]) for f in schema["fields"]] == [(0, "n_nationkey", "BIGINT"), (1, "n_name", "STRING"), (2, "n_regionkey", "BIGINT"), (3, "n_comment", "STRING")]
    assert (snapshot["version"], snapshot["id"], snapshot["commitKind"], snapshot["totalRecordCount"]) == (3, 1, "APPEND", 25)
    assert {(tmp_path / "t" / "snapshot" / x).read_text() for x in ("EARLIEST", "LATEST")} == {"1"}
    assert len([x for x in os.listdir(f"{path}/bucket-0") if x.startswith("data-") and x.endswith(".parquet")]) == 1
    _, (listed,) = avro.read_container((tmp_path / "t" / "manifest" / snapshot["deltaManifestList"]).read_bytes())
    _, (entry,) = avro.read_container((tmp_path / "t" / "manifest" / listed["_FILE_NAME"]).read_bytes())
    assert listed["_NUM_ADDED_FILES"] == 1 and entry["_FILE"]["rowCount"] == 25 and entry["_PARTITION"] == tables.EMPTY_ROW


@pytest.mark.parametrize("kind", ["iceberg", "paimon"])
def test_tables_of_no_rows_and_unknown_types(spark, tmp_path, kind):
    empty = spark.createDataFrame([], "a long, b string")
    sinks.write(empty, kind, f"{tmp_path}/t")
    assert sinks.read(spark, kind, f"{tmp_path}/t", empty.schema).count() == 0
    with pytest.raises(ValueError, match="no (Iceberg|Paimon) type"):
        sinks.write(spark.range(1).select(F.array("id").alias("x")), kind, f"{tmp_path}/u")


def test_dictionary_policy(spark, tmp_path):
    import pyarrow.parquet as pq

    sinks.write(tpch.generate(spark, "lineitem", 0.001).coalesce(1), "parquet", f"{tmp_path}/t", dictionaries=True)
    (file,) = [f for f in os.listdir(f"{tmp_path}/t") if f.endswith(".parquet")]
    group = pq.ParquetFile(f"{tmp_path}/t/{file}").metadata.row_group(0)
    coded = {group.column(i).path_in_schema for i in range(group.num_columns) if any("DICT" in e for e in group.column(i).encodings)}
    assert coded == {"l_returnflag", "l_linestatus", "l_shipinstruct", "l_shipmode"}


def test_fan_out_reports_and_failures(spark, tmp_path):
    frames = {t: tpch.generate(spark, t, 0.001) for t in ("orders", "part", "nation")}
    frames["broken"] = spark.range(3).select(F.raise_error(F.lit("no such disk")).alias("x"))
    report = runs.write_all(spark, frames, "parquet", str(tmp_path), slots=2, rows={"orders": 1500, "part": 200, "nation": 25}).collect()
    by = {r["table"]: r for r in report}
    assert [r["table"] for r in report][-1] == "orders" and [by[t]["rows"] for t in ("orders", "part", "nation")] == [1500, 200, 25]
    assert "no such disk" in by["broken"]["error"] and by["broken"]["rows"] is None
    for t in ("orders", "part", "nation"):
        assert spark.read.parquet(by[t]["path"]).count() == by[t]["rows"] and by[t]["bytes"] > 0
        found = spark.createDataFrame([(runs.report_text(by[t]),)], "t string").select(*[A.metric(F.col("t"), m).alias(m) for m in A.METRICS]).first()
        assert found["rows_written"] == by[t]["rows"] and found["file_size"] == by[t]["bytes"] and found["elapsed"] is not None
    assert runs.report_text(by["broken"]).splitlines()[1].startswith("FATAL")
    with pytest.raises(ValueError, match="unknown format"):
        runs.write_all(spark, frames, "xls", str(tmp_path))
    with pytest.raises(ValueError, match="slot"):
        runs.write_all(spark, frames, "orc", str(tmp_path), slots=0)


def test_coordinator(spark, tmp_path):
    c = runs.Coordinator(spark, str(tmp_path), "parquet")
    c.start("part", "nation")
    c.start("part")
    part = tpch.generate(spark, "part", 0.001)
    assert c.write("part", part.where("p_partkey <= 150")) == 150 and c.write("part", part.where("p_partkey > 150")) == 50
    with pytest.raises(ValueError, match="not open"):
        c.write("orders", part)
    report = {r["table"]: r["rows"] for r in c.finish().collect()}
    assert report == {"part": 200, "nation": 0} and spark.read.parquet(f"{tmp_path}/part.parquet").count() == 200
    with pytest.raises(ValueError, match="not open"):
        c.write("part", part)
    once = runs.Coordinator(spark, str(tmp_path), "paimon")
    once.start("part")
    once.write("part", part)
    with pytest.raises(ValueError, match="has been written"):
        once.write("part", part)


def test_counters():
    c = runs.Counters()
    for n in (5, 7):
        c.add_time("write", n)
    with c.timer("read"):
        pass
    c.add_time("read", 1_000_000)
    c.add("rows", 3)
    c.add("rows")
    c.set("files", 9)
    timers, counts = c.report()
    assert [t[0] for t in timers] == ["read", "write"] and timers[1] == ("write", 0.012, 2, 6) and counts == [("files", 9), ("rows", 4)]
    c.reset()
    assert c.report() == ([], [])


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["--suite", "h", "--table", "nation", "--table", "orders", "--scale-factor", "0.001", "--format", "csv", "--output-dir", str(tmp_path), "--max-rows", "20"]) == 0
    out = capsys.readouterr().out
    assert out.count("Rows written: 20") == 2 and "Throughput:" in out
    assert spark.read.option("header", True).csv(f"{tmp_path}/orders.csv").count() == 20
    with pytest.raises(SystemExit):
        cli.main(["--table", "nothing", "--output-dir", str(tmp_path)])



def test_data_source_and_table_function(spark, tmp_path, monkeypatch):
    plugins.register(spark)
    keys = spark.read.format("brightloom").option("rows", 25_000).load()
    assert keys.agg(F.count("*"), F.min("key"), F.max("key"), F.countDistinct("key")).first()[:] == (25_000, 1, 25_000, 25_000)
    assert spark.sql("select name from table_columns('h', 'region') order by position").toPandas().name.tolist() == ["r_regionkey", "r_name", "r_comment"]
    assert "h_orders" in plugins.create_views(spark, "h", 0.001) and spark.sql("select count(*) from h_orders").first()[0] == 1500
    assert [plugins.table_seed(i) for i in (0, 1)] == [123456789, (123456789 + 999999991) % 2**31]
    with pytest.raises(Exception, match="call"):
        keys.write.format("brightloom").mode("append").save()
    (tmp_path / "called_back.py").write_text(f"def note(table, row):\n    open({str(tmp_path / 'notes')!r}, 'a').write(f'{{table}} {{row.key}}\\n')\n")
    spark.sparkContext.addPyFile(str(tmp_path / "called_back.py"))
    keys.where("key <= 7").coalesce(1).write.format("brightloom").option("call", "called_back:note").option("table", "t").mode("append").save()
    assert sorted((tmp_path / "notes").read_text().split("\n"))[1:] == [f"t {i}" for i in range(1, 8)]


def test_rows_are_pulled_and_called_back(spark, tmp_path):
    part = tpch.generate(spark, "part", 0.001)
    batches = list(S.pull(part, 64))
    assert [len(b) for b in batches] == [64, 64, 64, 8] and {r.p_partkey for b in batches for r in b} == set(range(1, 201))
    target = str(tmp_path / "rows")

    def keep(table, row):
        with open(target, "a") as f:
            f.write(f"{table} {row.p_partkey}\n")

    S.each_row(part.where("p_partkey < 4").coalesce(1), "part", keep)
    assert sorted(open(target).read().split("\n"))[1:] == ["part 1", "part 2", "part 3"]
    with pytest.raises(ValueError, match="a row"):
        next(S.pull(part, 0))


def test_binary_index():
    names, pool = b"colors\0".ljust(20, b"\0"), b"red\0green\0blue\0"
    block = struct.pack(">2i", 6, 7) + struct.pack(">3i", 1, 4, 10) + struct.pack(">3i", 0, 4, 10) + struct.pack(">3i", 4, 10, 0) + b"al\0" + pool
    data = struct.pack(">i", 1) + block + names + struct.pack(">7i", 0, 4, len(pool), 3, 1, 2, 3)
    assert distributions.parse_index(data) == [{"name": "colors", "types": [6, 7], "weights": [[1, 4, 10]], "values": [["red", "green", "blue"], ["green", "blue", "red"]]}]
    for bad in (b"", data[:-30], struct.pack(">i", 99) + data[4:]):
        with pytest.raises(ValueError, match="index|cut short"):
            distributions.parse_index(bad)


def test_binary_index_as_a_table(spark, tmp_path):
    data = struct.pack(">i", 1) + struct.pack(">i", 6) + struct.pack(">2i", 2, 3) + struct.pack(">2i", 0, 2) + b"x\0y\0" + b"two".ljust(20, b"\0") + struct.pack(">7i", 0, 4, 4, 2, 1, 1, 0)
    (tmp_path / "d.idx").write_bytes(data)
    assert [tuple(r) for r in distributions.read_index(spark, str(tmp_path / "d.idx")).orderBy("pos").collect()] == [("two", 0, [2], ["x"]), ("two", 1, [3], ["y"])]


def test_sets_and_decimals(spark):
    dist = spark.createDataFrame([("o_oprio", "1-URGENT"), ("nouns", "foxes"), ("vp", "v")], "dist string, token string")
    assert {(r["dist"], r["set_name"]) for r in distributions.known_sets(dist).collect()} == {("o_oprio", "o_priority_set"), ("vp", "vp")}
    texts = ["12.50", "-0.5", "7", "-3", "", "+4.25", " 1.000 "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(distributions.decimal_parts(F.col("t")).alias("d")).collect()
    assert [tuple(r["d"]) for r in got] == [(0, 2, 2, 1250), (0, 1, 2, -5), (0, 0, 1, 7), (0, 0, 2, -3), (0, 0, 0, 0), (0, 2, 2, 425), (0, 3, 1, 1000)]


def test_text(spark):
    assert len(text.pool(500)) == 500 and text.pool(300) == text.pool(300) and set(text.pool(200, {"nouns": {"zebra": 1}}).split()) & {"zebra", "zebra.", "zebra;"}
    for t, c in (("part", "p_comment"), ("customer", "c_comment"), ("orders", "o_comment"), ("lineitem", "l_comment"), ("partsupp", "ps_comment"), ("nation", "n_comment")):
        least, most = tpch.generate(spark, t, 0.01).agg(F.min(F.length(c)), F.max(F.length(c))).first()
        lo, hi = text.LENGTHS[c]
        assert lo <= least <= most <= hi and (t == "nation" or (least, most) == (lo, hi)), t
    told = tpch.generate(spark, "supplier", 1).where("s_comment like '%Customer %Complaints%' or s_comment like '%Customer %Recommends%'").count()
    assert 2 <= told <= 30


def test_returns_modes(spark):
    lines, spec = (tpcds.generate(spark, "store_sales", 0.01), tpcds.generate(spark, "store_returns", 0.01, "spec"))
    assert 0.09 < spec.count() / lines.count() < 0.11
    assert spec.join(lines, (spec.sr_ticket_number == lines.ss_ticket_number) & (spec.sr_item_sk == lines.ss_item_sk), "left_anti").count() == 0
    with pytest.raises(ValueError, match="returns mode"):
        tpcds.generate(spark, "store_returns", 0.01, "other")


def test_human_formats(spark):
    df = spark.createDataFrame([(None,), (5,), (2048,), (3 * 1024**2,), (5 * 1024**4,)], "v long")
    assert [r[0] for r in df.select(A.human_bytes(F.col("v"))).collect()] == ["N/A", "5.0 B", "2.0 KB", "3.0 MB", "5.0 TB"]
    assert [r[0] for r in df.select(A.human_millis(F.col("v"))).limit(3).collect()] == ["N/A", "5 ms", "2.0 sec"]
    assert [r[0] for r in df.select(A.thousands(F.col("v"))).limit(3).collect()] == ["N/A", "5", "2,048"]


def test_lance_needs_a_connector(spark, tmp_path):
    with pytest.raises(ValueError, match="connector"):
        sinks.write(spark.range(1), "lance", f"{tmp_path}/t")
    with pytest.raises(ValueError, match="connector"):
        sinks.read(spark, "lance", f"{tmp_path}/t", "id long")


def test_meal_time_of_null_is_the_first_code(spark):
    df = spark.createDataFrame([(None,), ("",), ("dinner",), ("tea",)], "t_meal_time string")
    assert [r[0] for r in df.select(C.encode_field("t_meal_time")).collect()] == [0, 0, 3, -1]
