"""Queries of the library's own operators, each with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions import codecs as C
from brightloom.functions import dictionaries as D
from brightloom.operators import analytics as A
from brightloom.operators import shaping as S
from brightloom.plans import runs
from brightloom.plans.schemas import TPCDS, TPCH
from brightloom.sources import distributions, sinks, tpcds, tpch
from brightloom.sources.dialects import Duck

#: Scale factors of the generated tables that are registered.
SCALE_H, SCALE_DS = 0.01, 0.001

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _generated(suite, name: str, sf: float):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return suite.generate(spark, name, sf)

    return f, suite.sql(name, sf, Duck())


for _t in TPCH:
    QUERIES[f"gen_h_{_t}"], ORACLE[f"gen_h_{_t}"] = _generated(tpch, _t, SCALE_H)
for _t in TPCDS:
    if _t != "customer_demographics":  # 1.9 million rows at any scale: summed up below
        QUERIES[f"gen_ds_{_t}"], ORACLE[f"gen_ds_{_t}"] = _generated(tpcds, _t, SCALE_DS)


_DEMOGRAPHICS = "cd_gender, cd_marital_status, cd_education_status, cd_credit_rating"
_DIGEST = "count(*) as n, sum(cd_purchase_estimate) as estimate, sum(cd_demo_sk * (1 + cd_dep_count + 10 * cd_dep_employed_count + 100 * cd_dep_college_count)) as keys"


@query(f"select {_DEMOGRAPHICS}, {_DIGEST} from ({tpcds.sql('customer_demographics', 1, Duck())}) group by all")
def gen_ds_customer_demographics(spark, sf_dir):
    """All nine columns of the 1.9 million rows, summed up."""
    df = tpcds.generate(spark, "customer_demographics", 1)
    keys = F.col("cd_demo_sk") * (1 + F.col("cd_dep_count") + 10 * F.col("cd_dep_employed_count") + 100 * F.col("cd_dep_college_count"))
    return df.groupBy(*_DEMOGRAPHICS.split(", ")).agg(F.count("*").alias("n"), F.sum(F.col("cd_purchase_estimate").cast("long")).alias("estimate"), F.sum(keys).alias("keys"))


for _t in ("store_returns", "catalog_returns", "web_returns"):
    QUERIES[f"gen_ds_{_t}_spec"] = lambda spark, sf_dir, t=_t: tpcds.generate(spark, t, SCALE_DS, "spec")
    ORACLE[f"gen_ds_{_t}_spec"] = tpcds.sql(_t, SCALE_DS, Duck(), "spec")


def _list(values: list[str]) -> str:
    return "[" + ", ".join(Duck.text(v) for v in values) + "]"


def _code_counts(name: str, source: str, column: str) -> None:
    values = D.DICTIONARIES[column]

    def f(spark, sf_dir):
        return table(spark, sf_dir, source).groupBy(C.encode_field(column).alias("code")).agg(F.count("*").alias("n")).withColumn("value", C.decode(F.col("code"), values))

    QUERIES[name] = f
    ORACLE[name] = f"select code, count(*) as n, case when code >= 0 then list_extract({_list(values)}, code + 1) end as value from (select cast(coalesce(list_position({_list(values)}, {column}), 0) - 1 as int) as code from {source}) group by code"


for _name, _source, _column in [
    ("codec_returnflag", "lineitem", "l_returnflag"), ("codec_linestatus", "lineitem", "l_linestatus"), ("codec_orderstatus", "orders", "o_orderstatus"),
    ("codec_orderpriority", "orders", "o_orderpriority"), ("codec_mktsegment", "customer", "c_mktsegment"),
]:
    _code_counts(_name, _source, _column)


def _encoded(suite, table: str, column: str, sf: float, codes: str) -> None:
    """Codes of a generated table's column. The SQL has them from the rows' draws or numbers, not from the lists of values."""

    def f(spark, sf_dir):
        return suite.generate(spark, table, sf).groupBy(C.encode_field(column).alias("code")).agg(F.count("*").alias("n"))

    QUERIES[f"codec_{table}_{column}"] = f
    ORACLE[f"codec_{table}_{column}"] = f"select cast(code as int) as code, count(*) as n from ({codes}) group by 1"


_duck = Duck()
_lines = f"(select id * 8 + line as k from {_duck.children(_duck.rows(tpch.row_count('orders', SCALE_H)), '1 + ' + _duck.draw('lines') + ' % 7')})"
_parts = _duck.rows(tpch.row_count("part", SCALE_H))
_encoded(tpch, "lineitem", "l_shipinstruct", SCALE_H, f"select {_duck.draw('l_inst', 'k')} % 4 as code from {_lines}")
_encoded(tpch, "lineitem", "l_shipmode", SCALE_H, f"select {_duck.draw('l_mode', 'k')} % 7 as code from {_lines}")
_encoded(tpch, "part", "p_mfgr", SCALE_H, f"select {_duck.draw('p_mfgr')} % 5 as code from {_parts}")
_encoded(tpch, "part", "p_brand", SCALE_H, f"select {_duck.draw('p_mfgr')} % 5 * 5 + {_duck.draw('p_brand')} % 5 as code from {_parts}")
_encoded(tpch, "part", "p_container", SCALE_H, f"select {_duck.draw('p_cont')} % 40 as code from {_parts}")
_encoded(tpch, "part", "p_type", SCALE_H, f"select {_duck.draw('p_t1')} % 6 * 25 + {_duck.draw('p_t2')} % 5 * 5 + {_duck.draw('p_t3')} % 5 as code from {_parts}")
# positions of values in the specification's lists, by the numbers of the rows (from 0)
_hours = "(select range // 3600 as h from range(86400))"
for _table, _column, _codes in [
    ("customer_demographics", "cd_gender", "select range % 2 as code from range(1920800)"),
    ("customer_demographics", "cd_marital_status", "select range // 2 % 5 as code from range(1920800)"),
    ("customer_demographics", "cd_education_status", "select range // 10 % 7 as code from range(1920800)"),
    ("customer_demographics", "cd_credit_rating", "select range // 1400 % 4 as code from range(1920800)"),
    ("household_demographics", "hd_buy_potential", "select range // 20 % 6 as code from range(7200)"),
    ("time_dim", "t_am_pm", f"select h // 12 as code from {_hours}"),
    ("time_dim", "t_shift", f"select (h // 8 + 2) % 3 as code from {_hours}"),
    ("time_dim", "t_sub_shift", f"select (h // 6 + 3) % 4 as code from {_hours}"),
    ("time_dim", "t_meal_time", f"select case when h in (6, 7, 8) then 1 when h in (11, 12, 13) then 2 when h in (17, 18, 19, 20) then 3 else 0 end as code from {_hours}"),
    ("date_dim", "d_day_name", "select (range + 2) % 7 as code from range(73049)"),
    ("ship_mode", "sm_type", "select range % 6 as code from range(20)"),
    ("ship_mode", "sm_code", "select range % 7 as code from range(20)"),
    ("ship_mode", "sm_carrier", "select range as code from range(20)"),
]:
    _encoded(tpcds, _table, _column, 1, _codes)
for _table, _column, _size in [
    ("customer", "c_salutation", 6), ("customer_address", "ca_location_type", 3), ("customer_address", "ca_street_type", 20), ("customer_address", "ca_state", 51), ("call_center", "cc_class", 3),
    ("call_center", "cc_hours", 3), ("call_center", "cc_name", 12), ("catalog_page", "cp_type", 3), ("web_page", "wp_type", 7), ("item", "i_category", 10), ("item", "i_size", 7), ("item", "i_color", 92), ("item", "i_units", 21),
]:
    _encoded(tpcds, _table, _column, 0.1, f"select {_duck.draw(f'{_table}.{_column}')} % {_size} as code from {_duck.rows(tpcds.row_count(_table, 0.1))}")


@query("select l_orderkey, l_linenumber, case when cast(l_shipdate as date) between date '1992-01-01' and date '1998-12-31' then cast(date_diff('day', date '1992-01-01', cast(l_shipdate as date)) as int) end as day_code from lineitem")
def codec_date_index(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.date_code(F.col("l_shipdate")).alias("day_code"))


@query("select cast(i as int) as code, strftime(date '1992-01-01' + cast(i as int), '%Y-%m-%d') as day from range(2557) t(i)")
def date_dictionary(spark, sf_dir):
    return C.date_dictionary(spark)


@query("select count(*) as n, cast(0 as bigint) as mismatches from lineitem")
def decode_roundtrip(spark, sf_dir):
    same = [C.decode_field(c, C.encode_field(c)).eqNullSafe(F.col(c)) for c in ("l_returnflag", "l_linestatus")]
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.count_if(~(same[0] & same[1])).alias("mismatches"))


@query("select o_orderkey, cast(round(o_totalprice * 100) as bigint) as cents, cast(round(o_totalprice * 100) as bigint) / 100.0::double as dollars from orders")
def money_round_trip(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", C.cents(F.col("o_totalprice")).alias("cents"))
    return orders.withColumn("dollars", C.dollars(F.col("cents")))


@query("""select p_partkey, case when regexp_matches(t, '[,"\\n\\r]') then '"' || replace(t, '"', '""') || '"' else t end as field, lpad(cast(p_size as varchar), 5, '0') as zip
          from (select p_partkey, p_size, coalesce(case when p_partkey % 7 = 0 then null when p_partkey % 3 = 0 then p_name || ', "' || p_type || '"' else p_name end, '') as t from part)""")
def text_formats(spark, sf_dir):
    k = F.col("p_partkey")
    t = F.when(k % 7 == 0, F.lit(None)).when(k % 3 == 0, F.concat("p_name", F.lit(', "'), "p_type", F.lit('"'))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", C.csv_field(t).alias("field"), C.zip_code(F.col("p_size")).alias("zip"))


_REGIONS = []
for _step in tpch.NATIONS.values():
    _REGIONS.append((_REGIONS[-1] if _REGIONS else 0) + _step)


@query("select cast(i as int) as pos, list_extract(" + _list(list(tpch.NATIONS)) + ", i + 1) as nation, cast(list_extract(" + str(_REGIONS) + ", i + 1) as bigint) as regionkey from range(25) t(i)")
def dist_nation_regions(spark, sf_dir):
    return distributions.nation_regions(spark)


_WEIGHTS = [("red", 1), ("green", 3), ("blue", 6)]


@query("select case when o_orderkey % 10 < 1 then 'red' when o_orderkey % 10 < 4 then 'green' else 'blue' end as token, count(*) as n from orders group by 1")
def dist_weighted_pick(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(distributions.pick(_WEIGHTS, F.col("o_orderkey")).alias("token")).agg(F.count("*").alias("n"))


@query("select l_orderkey, l_linenumber, l_partkey from lineitem order by l_orderkey, l_linenumber, l_partkey limit 1001")
def limit_children(spark, sf_dir):
    return S.limit_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber", "l_partkey"], 1001)


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey in (select distinct l_orderkey from lineitem order by l_orderkey limit 333)")
def limit_parents(spark, sf_dir):
    return S.limit_parents(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 333)


@query("select o_orderkey, cast(unnest(range(1, o_orderkey % 8 + 1)) as int) as line from orders")
def flatten_orders(spark, sf_dir):
    return S.flatten(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey") % 8)


@query("select p_partkey, cast(unnest(range(1, 5)) as int) as line from part")
def flatten_partsupp(spark, sf_dir):
    return S.flatten(table(spark, sf_dir, "part").select("p_partkey"), F.lit(4))


@query("select event_id // 8192 as batch, count(*) as n from events group by 1")
def batch_sizes(spark, sf_dir):
    return S.batches(table(spark, sf_dir, "events"), "event_id", 8192).groupBy("batch").agg(F.count("*").alias("n"))


@query("select r_name, n_nationkey, run from region, nation, (select cast(unnest(range(3)) as int) as run)")
def cross_worklist(spark, sf_dir):
    runs = spark.range(3).select(F.col("id").cast("int").alias("run"))
    return S.worklist(table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "nation").select("n_nationkey"), runs)


@query("select o_orderpriority, count(*) as n, count(*) filter (where o_totalprice > 200000) as passed, count(*) filter (where not (o_totalprice > 200000)) as failed from orders group by 1")
def agg_pass_fail(spark, sf_dir):
    return A.pass_fail(table(spark, sf_dir, "orders"), ["o_orderpriority"], F.col("o_totalprice") > 200000)


@query("""select d as dimension, v as value, count(*) as n, count(*) filter (where ok) as passed, cast(floor(case when count(*) filter (where ok) > 0 then coalesce(sum(q) filter (where ok), 0) / count(*) filter (where ok) else 0 end) as bigint) as mean_rate
          from (select unnest(['l_returnflag', 'l_linestatus']) as d, unnest([l_returnflag, l_linestatus]) as v, l_discount < 0.05 as ok, case when l_linenumber < 4 then cast(l_quantity as bigint) end as q from lineitem) group by 1, 2""")
def agg_by_keys(spark, sf_dir):
    rate = F.when(F.col("l_linenumber") < 4, F.col("l_quantity").cast("long"))
    return A.grouped(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_discount") < 0.05, rate)


@query("select case when regexp_matches(event_type, 'click|tap') then 'touch' when regexp_matches(event_type, 'pur') then 'money' else 'other' end as category, count(*) as n, round(sum(value), 2) as total from events group by 1")
def categorise_first_match(spark, sf_dir):
    label = A.classify(F.col("event_type"), [("touch", "click|tap"), ("money", "pur")])
    return table(spark, sf_dir, "events").groupBy(label.alias("category")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("select * from (select o_orderpriority, o_orderkey, o_totalprice, cast(row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as int) as rank from orders) where rank <= 5")
def top5_per_group(spark, sf_dir):
    return A.top_per_group(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), ["o_orderpriority"], "o_totalprice", 5, "o_orderkey")


@query("""select l_returnflag, l_linestatus, round(mean, 6) as mean, least, most, round(s, 6) as spread_pct, case when s < 5 then 'excellent' when s < 15 then 'good' when s < 30 then 'fair' else 'poor' end as stability
          from (select *, (most - least) / mean * 100 as s from (select l_returnflag, l_linestatus, avg(l_quantity) as mean, min(l_quantity) as least, max(l_quantity) as most from lineitem group by 1, 2))""")
def spread_and_stability(spark, sf_dir):
    out = A.spread(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_quantity"))
    return out.withColumn("mean", F.round("mean", 6)).withColumn("spread_pct", F.round("spread_pct", 6))


@query("""select o_orderpriority, "F", "O", "P", round((coalesce("F", 0) + coalesce("O", 0) + coalesce("P", 0)) / ((("F" is not null)::int) + (("O" is not null)::int) + (("P" is not null)::int)), 6) as mean_of_max
          from (select o_orderpriority, max(o_totalprice) filter (where o_orderstatus = 'F') as "F", max(o_totalprice) filter (where o_orderstatus = 'O') as "O", max(o_totalprice) filter (where o_orderstatus = 'P') as "P" from orders group by 1)""")
def pivot_max(spark, sf_dir):
    out = A.pivot_max(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", D.ORDER_STATUS, "o_totalprice")
    return out.withColumn("mean_of_max", F.round("mean_of_max", 6))


@query("select l_returnflag, mean, cast(row_number() over (order by mean desc, l_returnflag) as int) as rank from (select l_returnflag, round(avg(l_extendedprice), 6) as mean from lineitem group by 1)")
def rank_by_mean(spark, sf_dir):
    means = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_extendedprice"), 6).alias("mean"))
    return A.rank_by(means, "mean", "l_returnflag")


@query("select o_orderpriority, first(o_orderkey order by o_totalprice, o_orderkey) as argmin, first(o_orderkey order by o_totalprice desc, o_orderkey) as argmax from orders group by 1")
def argmin_argmax(spark, sf_dir):
    return A.extremes(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderkey", "o_totalprice")


@query("""select l_linenumber, round(a, 6) as a, round(b, 6) as b, round(a / b, 6) as ratio, case when a / b > 1.05 then 'wins' when a / b < 0.95 then 'loses' when a / b is not null then 'even' end as verdict
          from (select l_linenumber, avg(l_extendedprice) filter (where l_returnflag = 'A') as a, avg(l_extendedprice) filter (where l_returnflag = 'R') as b from lineitem group by 1)""")
def ab_ratio(spark, sf_dir):
    out = A.compare(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_returnflag", "A", "R", "l_extendedprice")
    return out.select("l_linenumber", *[F.round(c, 6).alias(c) for c in ("a", "b", "ratio")], "verdict")


@query("select o_orderpriority, o_orderkey, round(o_totalprice / first_value(o_totalprice) over (partition by o_orderpriority order by o_orderkey), 6) as speedup from orders")
def speedup_vs_first(spark, sf_dir):
    out = A.speedup_vs_first(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderkey", "o_totalprice")
    return out.select("o_orderpriority", "o_orderkey", F.round("speedup", 6).alias("speedup"))


@query("select l_returnflag, round(avg(l_quantity), 6) as mean, round(stddev_samp(l_quantity), 6) as deviation, count(l_quantity) as n from lineitem group by 1")
def mean_and_deviation(spark, sf_dir):
    out = A.mean_deviation(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_quantity"))
    return out.select("l_returnflag", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "n")


@query("select l_linestatus, round(sum(l_extendedprice) / sum(l_quantity), 6) as rate from lineitem group by 1")
def weighted_rate(spark, sf_dir):
    return A.weighted_rate(table(spark, sf_dir, "lineitem"), ["l_linestatus"], F.col("l_extendedprice"), F.col("l_quantity")).select("l_linestatus", F.round("rate", 6).alias("rate"))


@query("select max(o_totalprice) as best, 100000 * 0.95::double as needed, max(o_totalprice) >= 95000 as passed from orders where contains(o_orderpriority, 'HIGH')")
def regression_gate(spark, sf_dir):
    return A.gate(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority", "HIGH", 100000.0)


@query("select event_type, event_id, value from (select *, row_number() over (partition by event_type order by value, event_id) as n from events) where n = 1")
def best_of(spark, sf_dir):
    return S.first_of_each(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), ["event_type"], ["value", "event_id"])


_FAULTS = [
    ("Segmentation fault", "crash"), ("got SIGSEGV", "crash"), ("std::bad_alloc", "oom"), ("ENOMEM", "oom"), ("Out of memory", "oom"), ("Timed out", "timeout"), ("timeout after 5 s", "timeout"),
    ("FATAL: disk", "fatal"), ("Fatal error", "fatal"), ("an error, retried", "other"), ("done", "other"),
]


@query(f"""select o_orderkey, cast(o_orderkey * 10 as double) as rows_written, o_totalprice as throughput, cast(null as double) as write_rate, cast(o_custkey as double) as file_size, o_orderkey % 100 / 10 as elapsed,
          list_extract({_list([x for _, x in _FAULTS])}, cast(o_orderkey % {len(_FAULTS)} as int) + 1) as problem from orders""")
def regex_extract_metrics(spark, sf_dir):
    k = F.col("o_orderkey")
    tail = F.element_at(F.array(*[F.lit(x) for x, _ in _FAULTS]), (k % len(_FAULTS)).cast("int") + 1)
    elapsed = F.concat(F.when(k % 2 == 0, "Time elapsed: ").otherwise("Elapsed time: "), F.format_string("%.1f", k % 100 / 10.0))
    lines = [F.concat(F.lit("Rows written: "), (k * 10).cast("string")), F.concat(F.lit("File size: "), F.col("o_custkey").cast("string")), elapsed, F.concat(F.lit("Throughput: "), F.format_string("%.2f", "o_totalprice"), F.lit(" rows/sec")), tail]
    run = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("\n", *lines).alias("t"))
    return run.select("o_orderkey", *[A.metric(F.col("t"), m).alias(m) for m in A.METRICS], A.classify(F.col("t"), A.ERRORS).alias("problem"))


@query("""select event_id, case when event_id % 5 > 0 then event_type end as format, case when event_id % 5 > 0 then case when event_id % 2 = 0 then 'order_lines' else 'part' end end as "table",
          case when event_id % 5 > 0 then 'async' end as mode from events""")
def run_name_parts(spark, sf_dir):
    k = F.col("event_id")
    name = F.when(k % 5 > 0, F.concat(F.lit("/logs/run.1/"), "event_type", F.when(k % 2 == 0, "_order_lines").otherwise("_part"), F.lit("_async.log"))).otherwise(F.concat(F.lit("/logs/"), "event_type", F.lit("_part.log")))
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in A.run_name(name).items()])


_PROFILE = [("encode", "parquet|zstd"), ("memory", "alloc|memcpy"), ("io", r"write|\[k")]


def _profile(spark, sf_dir):
    """Lines of a made-up profile from line items; every ninth has another form."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    symbol = F.element_at(F.array(*[F.lit(x) for x in ("ZSTD_compress", "memcpy", "do_write", "main")]), (k % 4).cast("int") + 1)
    share = F.concat((k % 3).cast("string"), F.lit("."), F.lpad((k % 100).cast("string"), 2, "0"))
    line = F.concat(F.lit("   "), share, F.lit("%  app  ["), F.when(n % 2 == 0, "kernel").otherwise("libx.so"), F.lit("]  "), symbol, F.lit("  "))
    return table(spark, sf_dir, "lineitem").select(F.when(k % 9 == 0, F.lit("# note 9%")).otherwise(line).alias("line"))


_HOT = """(select (l_orderkey % 3) + (l_orderkey % 100) / 100 as percentage, case when l_linenumber % 2 = 0 then 'kernel' else 'libx.so' end as dso, list_extract(['ZSTD_compress', 'memcpy', 'do_write', 'main'], cast(l_orderkey % 4 as int) + 1) as symbol,
          case l_orderkey % 4 when 0 then 'encode' when 1 then 'memory' when 2 then 'io' else 'other' end as category from lineitem where l_orderkey % 9 > 0)"""


@query(f"select dso, symbol, category, count(*) as n, round(sum(percentage), 4) as total from {_HOT} where percentage >= 0.5 group by 1, 2, 3")
def hotspot_lines(spark, sf_dir):
    found = A.hotspots(_profile(spark, sf_dir), "line", _PROFILE)
    return found.groupBy("dso", "symbol", "category").agg(F.count("*").alias("n"), F.round(F.sum("percentage"), 4).alias("total"))


@query(f"select category, count(*) as n, round(sum(percentage), 4) as total from {_HOT} where percentage >= 0.5 group by 1 order by 3 desc, 1")
def sum_by_category(spark, sf_dir):
    found = A.hotspots(_profile(spark, sf_dir), "line", _PROFILE)
    return A.sum_by(found, F.col("category"), "percentage").withColumn("total", F.round("total", 4))


_PAIRS = """(select l_linenumber, l_linestatus, l_shipdate::date as day, avg(l_extendedprice) filter (where l_returnflag = 'A') as a, avg(l_extendedprice) filter (where l_returnflag = 'R') as b from lineitem group by 1, 2, 3)"""


@query(f"select l_linestatus, l_linenumber, count(*) as pairs, round(avg(a / b), 6) as mean_ratio, count(*) filter (where a > b) as a_wins, count(*) filter (where a <= b) as b_wins from {_PAIRS} where a > 0 and b > 0 group by 1, 2")
def ab_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    pairs = A.compare(lines, ["l_linenumber", "l_linestatus", "day"], "l_returnflag", "A", "R", "l_extendedprice")
    return A.summarise(pairs, ["l_linestatus", "l_linenumber"]).withColumn("mean_ratio", F.round("mean_ratio", 6))


@query("""select l_linestatus, l_linenumber, max(l_quantity) filter (where l_returnflag = 'A') as "A_l_quantity", max(l_extendedprice) filter (where l_returnflag = 'A') as "A_l_extendedprice",
          max(l_quantity) filter (where l_returnflag = 'N') as "N_l_quantity", max(l_extendedprice) filter (where l_returnflag = 'N') as "N_l_extendedprice" from lineitem group by 1, 2""")
def cross_tab_cells(spark, sf_dir):
    return A.cross_tab(table(spark, sf_dir, "lineitem"), ["l_linestatus", "l_linenumber"], "l_returnflag", ["A", "N"], ["l_quantity", "l_extendedprice"])


@query("""select l_returnflag, l_linestatus, l_linenumber, round(avg(l_quantity), 6) as quantity, round(avg(l_extendedprice), 6) as price, case when grouping(l_returnflag) = 1 then 2 when grouping(l_linenumber) = 1 then 0 else 1 end as level
          from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag, l_linenumber), (l_linestatus))""")
def grouping_set_means(spark, sf_dir):
    sets = [["l_returnflag", "l_linestatus"], ["l_returnflag", "l_linenumber"], ["l_linestatus"]]
    out = A.means_by_sets(table(spark, sf_dir, "lineitem"), sets, {"quantity": "l_quantity", "price": "l_extendedprice"})
    return out.withColumn("quantity", F.round("quantity", 6)).withColumn("price", F.round("price", 6))


@query("select o_orderkey, case when o_custkey % 5 > 0 then o_totalprice / (o_custkey % 5) else 0 end as rate from orders")
def derived_rate(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", A.derived_rate(F.col("o_totalprice"), F.col("o_custkey") % 5).alias("rate"))


@query("""with m as (select l_linestatus, l_returnflag, avg(l_quantity) as mean, stddev_samp(l_quantity) as deviation, count(l_quantity) as n from lineitem group by 1, 2)
          select l_linestatus, l_returnflag, round(m.mean, 6) as mean, round(deviation, 6) as deviation, n, round(m.mean / b.mean, 6) as speedup
          from m left join (select l_linestatus as s, mean from m where l_returnflag = 'R') b on l_linestatus = s""")
def speedup_vs_baseline(spark, sf_dir):
    out = A.vs_baseline(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_returnflag", "R", "l_quantity")
    return out.select("l_linestatus", "l_returnflag", *[F.round(c, 6).alias(c) for c in ("mean", "deviation", "speedup")], "n")


@query("select p_partkey, 6001215 // (p_size * 500) as batches, least(greatest(22 + (6001215 // (p_size * 500) - 600) * 0.015::double, 18), 30) as encoding_pct from part")
def batch_size_metrics(spark, sf_dir):
    found = A.batch_metrics(6_001_215, F.col("p_size") * 500)
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in found.items()])


_RECORDS = "(select o_orderstatus as s, case when o_orderkey % 4 = 0 then 'FAILED' when o_orderkey % 4 = 1 then cast(o_custkey as varchar) else cast(o_custkey as varchar) || ' rows/sec' end as t, o_orderkey % 4 > 0 as ok, o_custkey from orders)"


@query(f"select s as test, cast(floor(sum(o_custkey) filter (where ok) / count(*) filter (where ok)) as bigint) as mean, count(*) as n, count(*) filter (where ok) as passed, count(*) filter (where not ok) as failed from {_RECORDS} group by 1")
def record_summary(spark, sf_dir):
    k = F.col("o_orderkey")
    rate = F.when(k % 4 == 0, "FAILED").when(k % 4 == 1, F.col("o_custkey").cast("string")).otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(" rows/sec")))
    lines = table(spark, sf_dir, "orders").select(F.concat_ws(",", "o_orderstatus", k.cast("string"), rate, F.lit("a,b")).alias("line"))
    rows = A.records(lines, "line", ["test", "rows", "throughput", "rest"])
    out = rows.groupBy("test").agg(A.whole_mean(F.col("throughput")).alias("mean"), F.count("*").alias("n"), F.count_if(F.col("throughput") != "FAILED").alias("passed"))
    return out.withColumn("failed", F.col("n") - F.col("passed"))


@query("""select o_orderpriority as log, cast(arg_max(o_custkey, o_orderkey) as varchar) || ',000' as last, arg_max(o_custkey, o_orderkey) * 1000 > 100000 as fast from orders where o_orderstatus = 'F' group by 1""")
def last_matching_line(spark, sf_dir):
    what = F.when(F.col("o_orderstatus") == "F", "Throughput:  ").otherwise("Rows written: ")
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("log"), "o_orderkey", F.concat(F.lit("  "), what, F.col("o_custkey").cast("string"), F.lit(",000 ")).alias("line"))
    return A.last_match(lines, ["log"], "o_orderkey", "line", "Throughput:").withColumn("fast", A.above(F.col("last"), 100_000))


@query("select event_id, event_type || ': ' || cast(event_id as varchar) as line from events where contains(event_type, 'c') or contains(event_type, 'v') or event_id % 1000 = 7")
def line_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit(": "), F.col("event_id").cast("string")).alias("line"))
    return A.matching_lines(lines, "line", ["c", "v"]).union(lines.where((F.col("event_id") % 1000 == 7) & ~F.col("line").contains("c") & ~F.col("line").contains("v")))


@query("select event_type as name, round(sum(event_id) / 1000, 3) as total_ms, count(event_id) as calls, cast(floor(avg(event_id)) as bigint) as mean_us from events group by 1")
def timer_totals(spark, sf_dir):
    return runs.timer_report(table(spark, sf_dir, "events"), "event_type", "event_id").withColumn("total_ms", F.round("total_ms", 3))


@query("select p_partkey, 0 as flags, cast(length(split_part(t, '.', 2)) as int) as precision, cast(length(split_part(t, '.', 1)) as int) as scale, cast(replace(t, '.', '') as bigint) as number from (select p_partkey, case when p_partkey % 2 = 0 then '-' else '' end || cast(p_size as varchar) || case when p_partkey % 3 = 0 then '' else '.' || lpad(cast(p_partkey % 100 as varchar), 2, '0') end as t from part)")
def decimal_text(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat(F.when(k % 2 == 0, "-").otherwise(""), F.col("p_size").cast("string"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("."), F.lpad((k % 100).cast("string"), 2, "0"))))
    return table(spark, sf_dir, "part").select("p_partkey", distributions.decimal_parts(text).alias("d")).select("p_partkey", "d.*")


@query("select sum(8 + 4 + strlen(n_name) + 8 + 3 / 8.0::double) as bytes from nation")
def batch_bytes(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long"))
    return df.agg(F.sum(S.estimated_bytes(df)).alias("bytes"))


@query(" union all ".join(f"select '{t}' as \"table\", '{k}' as format, count(*) as rows, true as whole from ({tpch.sql(t, 0.001, Duck())})" for k in ("parquet", "orc", "csv", "iceberg", "paimon") for t in ("region", "nation", "supplier", "part")))
def run_report(spark, sf_dir):
    """Four tables in each format, two tables at a time, and the report's lines; all written rows are read again."""
    out = None
    for kind in ("parquet", "orc", "csv", "iceberg", "paimon"):
        made = {t: tpch.generate(spark, t, 0.001) for t in ("part", "supplier", "nation", "region")}
        lines = runs.write_all(spark, made, kind, f"{runs.scratch(spark)}/{kind}", 2, {t: tpch.row_count(t, 0.001) for t in made})
        for line in lines.collect():
            back = sinks.read(spark, kind, line["path"], made[line["table"]].schema)
            one = back.agg(F.lit(line["table"]).alias("table"), F.lit(kind).alias("format"), F.lit(line["rows"]).alias("rows"), (F.count("*") == line["rows"]).alias("whole"))
            out = one if out is None else out.union(one)
    return out


@query("""select count(distinct l_returnflag) as returnflag, count(distinct l_linestatus) as linestatus, count(distinct l_suppkey) as suppliers, round(avg(case when l_discount > 0 then l_discount end), 6) as positive_mean,
          min(least(greatest(l_linenumber * 10, 18), 30)) as clamped_least, max(least(greatest(l_linenumber * 10, 18), 30)) as clamped_most from lineitem""")
def cardinality_vs_hint(spark, sf_dir):
    c = A.clamp(F.col("l_linenumber") * 10, 18, 30)
    return table(spark, sf_dir, "lineitem").agg(F.countDistinct("l_returnflag").alias("returnflag"), F.countDistinct("l_linestatus").alias("linestatus"), F.countDistinct("l_suppkey").alias("suppliers"), F.round(A.positive_mean(F.col("l_discount")), 6).alias("positive_mean"), F.min(c).alias("clamped_least"), F.max(c).alias("clamped_most"))


@query("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(avg(l_quantity), 6) as avg_qty, count(*) as n
          from lineitem where l_shipdate <= timestamp '2001-09-02' group by 1, 2""")
def pricing_summary(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_price"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))
