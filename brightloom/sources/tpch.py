"""TPC-H tables: every row from its key. Keys, prices, dates, flags and domains follow the formulas of the public
specification; the random draws are functions of the key, so the values are not those of the official generator. Comments
are parts of a pool of sentences by the specification's grammar, with its lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brightloom.functions import dictionaries as D
from brightloom.plans.schemas import TPCH, table_columns
from brightloom.sources import text
from brightloom.sources.dialects import Spark

#: Rows at scale factor 1, as fixed values; lineitem follows from orders (1 to 7 each), nation and region do not scale.
ROWS = {"part": 200_000, "supplier": 10_000, "partsupp": 800_000, "customer": 150_000, "orders": 1_500_000, "nation": 25, "region": 5}
#: Nation names with their steps to the region key, and regions, as fixed values.
NATIONS = {"ALGERIA": 0, "ARGENTINA": 1, "BRAZIL": 0, "CANADA": 0, "EGYPT": 3, "ETHIOPIA": -4, "FRANCE": 3, "GERMANY": 0, "INDIA": -1, "INDONESIA": 0, "IRAN": 2, "IRAQ": 0, "JAPAN": -2, "JORDAN": 2, "KENYA": -4, "MOROCCO": 0, "MOZAMBIQUE": 0, "PERU": 1, "CHINA": 1, "ROMANIA": 1, "SAUDI ARABIA": 1, "VIETNAM": -2, "RUSSIA": 1, "UNITED KINGDOM": 0, "UNITED STATES": -2}
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
POOL, ADDRESSES = text.pool(text.POOL_CHARS), text.letters(512)
#: 1995-06-17 as days since 1992-01-01.
CURRENT = 1263


def row_count(table: str, sf: float) -> int:
    """Rows of a table; for lineitem the expected number."""
    if sf <= 0:
        raise ValueError("the scale factor must be positive")
    if table == "lineitem":
        return 4 * row_count("orders", sf)
    return ROWS[table] if table in ("nation", "region") else max(1, round(ROWS[table] * sf))


def _comment(d, column: str, key: str) -> str:
    return text.part(d, POOL, d.draw(column, key), *text.LENGTHS[column])


def _supplier_comment(d) -> str:
    """One in 1,000 suppliers has customers' complaints or recommendations in its comment."""
    whole, kind = _comment(d, "s_comment", "id"), f"({d.draw('s_customers')} % 2000)"
    told = f"concat(substr({whole}, 1, 10), 'Customer ', substr({whole}, 11, 8), case when {kind} = 0 then 'Complaints' else 'Recommends' end)"
    return f"case when {kind} < 2 then {told} else {whole} end"


def _lines(d, sf: float) -> str:
    """Line items with their parts as integers: one row for each order and line."""
    orders, parts, supps = (row_count(t, sf) for t in ("orders", "part", "supplier"))
    u = lambda stream, n, least=0: f"({least} + {d.draw(stream, 'k')} % {n})"
    base = d.children(d.rows(orders), f"1 + {d.draw('lines')} % 7")
    keyed = f"(select id, line, id * 8 + line as k from {base})"
    drawn = f"(select *, {u('l_part', parts, 1)} as pk, {u('l_supp', 4)} as si, {u('l_qty', 50, 1)} as qty, {u('l_disc', 11)} as disc, {u('l_tax', 9)} as tax, {d.draw('o_date')} % 2406 as od from {keyed})"
    return f"(select *, 90000 + ({d.div('pk', '10')}) % 20001 + 100 * (pk % 1000) as retail, od + {u('l_ship', 121, 1)} as ship, od + {u('l_commit', 61, 30)} as due, (pk + si * ({d.div(str(supps), '4')} + {d.div('pk - 1', str(supps))})) % {supps} + 1 as sk from {drawn})"


def sql(table: str, sf: float, d=None) -> str:
    """The table as one SELECT in the dialect d."""
    d = d or Spark()
    n = row_count(table, sf) if table != "lineitem" else 0
    u = lambda stream, m, least=0, key="id": f"({least} + {d.draw(stream, key)} % {m})"
    money = lambda x: f"cast({x} as double) / 100"
    key = lambda a: f"({d.div(f'{a} - 1', '8')}) * 32 + ({a} - 1) % 8 + 1"
    name = lambda what, x: f"concat('{what}#', lpad(cast({x} as varchar(20)), 9, '0'))"
    phone = lambda s: f"concat_ws('-', cast(10 + {u(s + '_nation', 25)} as varchar(20)), cast({u(s + '_p1', 900, 100)} as varchar(20)), cast({u(s + '_p2', 900, 100)} as varchar(20)), cast({u(s + '_p3', 9000, 1000)} as varchar(20)))"
    if table in ("lineitem", "orders"):
        lines = _lines(d, sf)
        receipt = f"(select *, ship + {u('l_receipt', 30, 1, 'k')} as got from {lines})"
    if table == "lineitem":
        values = {
            "l_orderkey": key("id"), "l_partkey": "pk", "l_suppkey": "sk", "l_linenumber": "cast(line as bigint)", "l_quantity": "cast(qty as double)",
            "l_extendedprice": money("qty * retail"), "l_discount": money("disc"), "l_tax": money("tax"),
            "l_returnflag": f"case when got > {CURRENT} then 'N' when {u('l_flag', 2, 0, 'k')} = 0 then 'R' else 'A' end",
            "l_linestatus": f"case when ship > {CURRENT} then 'O' else 'F' end", "l_commitdate": d.day("due"), "l_shipdate": d.day("ship"), "l_receiptdate": d.day("got"),
            "l_shipinstruct": d.pick(D.SHIP_INSTRUCT, u("l_inst", 4, 0, "k")), "l_shipmode": d.pick(D.SHIP_MODE, u("l_mode", 7, 0, "k")), "l_comment": _comment(d, "l_comment", "k"),
        }
        source = receipt
    elif table == "orders":
        customers = row_count("customer", sf)
        open_ = f"sum(case when ship > {CURRENT} then 1 else 0 end)"
        source = f"(select id, od, count(*) as lines, {open_} as open_lines, sum(qty * retail * (100 + tax) * (100 - disc)) as total from {lines} group by id, od)"
        c = u("o_cust", max(1, customers), 1)
        values = {
            "o_orderkey": key("id"), "o_custkey": f"case when {c} % 3 = 0 then {c} - 1 else {c} end",
            "o_orderstatus": "case when open_lines = 0 then 'F' when open_lines = lines then 'O' else 'P' end", "o_totalprice": "cast(total as double) / 1000000", "o_orderdate": d.day("od"),
            "o_orderpriority": d.pick(D.ORDER_PRIORITY, u("o_prio", 5)), "o_clerk": name("Clerk", u("o_clerk", max(1, round(1000 * sf)), 1)), "o_shippriority": "cast(0 as bigint)", "o_comment": _comment(d, "o_comment", "id"),
        }
    elif table == "partsupp":
        supps = row_count("supplier", sf)
        source = f"(select id, line, id * 8 + line as k from {d.children(d.rows(row_count('part', sf)), '4')})"
        values = {
            "ps_partkey": "id", "ps_suppkey": f"(id + (line - 1) * ({d.div(str(supps), '4')} + {d.div('id - 1', str(supps))})) % {supps} + 1",
            "ps_availqty": u("ps_qty", 9999, 1, "k"), "ps_supplycost": money(u("ps_cost", 99_901, 100, "k")), "ps_comment": _comment(d, "ps_comment", "k"),
        }
    elif table in ("nation", "region"):
        source, at = d.rows(n, 0), "id"
        steps, region = 0, []
        for step in NATIONS.values():
            steps += step
            region.append(str(steps))
        if table == "nation":
            values = {"n_nationkey": "id", "n_name": d.pick(list(NATIONS), at), "n_regionkey": f"cast({d.pick(region, at)} as bigint)", "n_comment": _comment(d, "n_comment", "id")}
        else:
            values = {"r_regionkey": "id", "r_name": d.pick(REGIONS, at), "r_comment": _comment(d, "r_comment", "id")}
    else:
        source = d.rows(n)
        syllable = lambda s, m: d.pick(m, u(s, len(m)))
        mfgr = u("p_mfgr", 5, 1)
        values = {
            "c_custkey": "id", "c_name": name("Customer", "id"), "c_address": text.part(d, ADDRESSES, d.draw("c_addr"), 10, 40), "c_nationkey": u("c_nation", 25), "c_phone": phone("c"),
            "c_acctbal": money(f"({u('c_bal', 1_099_999)} - 99999)"), "c_mktsegment": d.pick(D.MARKET_SEGMENT, u("c_seg", 5)), "c_comment": _comment(d, "c_comment", "id"),
            "s_suppkey": "id", "s_name": name("Supplier", "id"), "s_address": text.part(d, ADDRESSES, d.draw("s_addr"), 10, 40), "s_nationkey": u("s_nation", 25), "s_phone": phone("s"),
            "s_acctbal": money(f"({u('s_bal', 1_099_999)} - 99999)"), "s_comment": _supplier_comment(d),
            "p_partkey": "id", "p_name": "concat_ws(' ', " + ", ".join(d.pick(D.COLOR, u(f"p_n{i}", 92)) for i in range(5)) + ")", "p_mfgr": f"concat('Manufacturer#', cast({mfgr} as varchar(20)))",
            "p_brand": f"concat('Brand#', cast({mfgr} as varchar(20)), cast({u('p_brand', 5, 1)} as varchar(20)))", "p_type": f"concat_ws(' ', {syllable('p_t1', D.TYPE_1)}, {syllable('p_t2', D.TYPE_2)}, {syllable('p_t3', D.TYPE_3)})",
            "p_size": u("p_size", 50, 1), "p_container": d.pick(D.CONTAINER, u("p_cont", 40)), "p_retailprice": money(f"90000 + ({d.div('id', '10')}) % 20001 + 100 * (id % 1000)"), "p_comment": _comment(d, "p_comment", "id"),
        }
    wanted = [f"{values[c]} as {c}" for c, _, _ in table_columns("h", table)]
    return f"select {', '.join(wanted)} from {source} as t"


def generate(spark: SparkSession, table: str, sf: float) -> DataFrame:
    """One table at a scale factor (fractions allowed); nothing is shuffled but the totals of orders."""
    return spark.sql(sql(table, sf))


def all_tables(spark: SparkSession, sf: float) -> dict[str, DataFrame]:
    return {t: generate(spark, t, sf) for t in TPCH}
