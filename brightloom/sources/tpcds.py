"""TPC-DS tables: deterministic dimensions by arithmetic, the others by draws from each row's key.

Calendar and demographic tables follow the public specification. For the scaled tables domains, keys and the identities
between prices hold (for example net_paid = ext_sales_price - coupon_amt); their distributions are uniform.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from brightloom.functions import dictionaries as D
from brightloom.plans.schemas import TPCDS, table_columns
from brightloom.sources import text
from brightloom.sources.dialects import Spark

#: Rows that do not depend on the scale factor, and rows at scale factor 1 of tables in proportion to it or to its root;
#: fixed values. Sales are counted in tickets or orders (their lines and returns follow).
FIXED = {"date_dim": 73_049, "time_dim": 86_400, "ship_mode": 20, "reason": 35, "income_band": 20, "household_demographics": 7_200, "customer_demographics": 1_920_800}
LINEAR = {"customer": 100_000, "customer_address": 50_000, "store": 12, "call_center": 6, "warehouse": 5, "inventory": 11_745_000, "store_sales": 240_000, "catalog_sales": 160_000, "web_sales": 60_000}
ROOT = {"item": 18_000, "catalog_page": 11_718, "web_page": 60, "web_site": 30, "promotion": 300}
#: Lines of a ticket or order, from and to.
LINES = {"store_sales": (8, 16), "catalog_sales": (4, 14), "web_sales": (8, 16)}
FIRST_DATE, SALES_FROM, SALES_DAYS = 2_415_022, 2_450_816, 1_823
#: What a column whose name ends so refers to.
REFERS = {
    "_item_sk": "item", "_customer_sk": "customer", "_cdemo_sk": "customer_demographics", "_hdemo_sk": "household_demographics", "_addr_sk": "customer_address", "_store_sk": "store",
    "_promo_sk": "promotion", "_call_center_sk": "call_center", "_catalog_page_sk": "catalog_page", "_ship_mode_sk": "ship_mode", "_warehouse_sk": "warehouse", "_web_page_sk": "web_page", "_web_site_sk": "web_site", "_reason_sk": "reason",
}


#: Words of text columns by the end of their names; a closed list of the generator's own, as the official ones are not public
#: domain files here.
NAMES = {
    "first_name": ["James", "Mary", "John", "Linda", "Robert", "Susan", "Karen", "David", "Nancy", "Paul", "Laura", "Mark", "Helen", "Peter", "Ruth", "Frank"],
    "last_name": ["Smith", "Jones", "Brown", "Miller", "Davis", "Garcia", "Wilson", "Moore", "Taylor", "Thomas", "White", "Harris", "Clark", "Lewis", "Young", "King"],
    "city": ["Midway", "Fairview", "Oak Grove", "Five Points", "Centerville", "Riverside", "Pleasant Hill", "Salem", "Liberty", "Greenville", "Union", "Springfield"],
    "county": ["Williamson County", "Franklin County", "Walker County", "Ziebach County", "Bronx County", "Daviess County", "Barrow County", "Luce County"],
    "street_name": ["Oak", "Main", "Park", "Elm", "Maple", "Cedar", "Pine", "Lake", "Hill", "First", "Second", "Third", "Walnut", "Spring", "Ridge", "Church"],
    "manager": ["Bob Belcher", "Felipe Perkins", "Mark Hightower", "Larry Mccray", "Gary Colburn", "Wayne Ray", "Scott Smith", "Edwin Adams"],
    "birth_country": ["CANADA", "FRANCE", "GERMANY", "JAPAN", "PERU", "KENYA", "BRAZIL", "IRELAND"],
    "class": ["accent", "classical", "pop", "rock", "fiction", "history", "travel", "dresses", "pants", "shirts", "camping", "fitness"],
    "reason_desc": ["Package was damaged", "Stopped working", "Did not fit", "Found a better price", "Wrong size", "Not the product that was ordered", "Parts missing", "Gift exchange"],
}
#: The longest part of the pool that a description, market text or the like has.
PROSE = {"desc": 100, "description": 100, "market_desc": 100, "mkt_desc": 100, "details": 100}
RETURNS_MODES = ("reference", "spec")
POOL = text.pool(512)


def row_count(table: str, sf: float) -> int:
    """Rows of a table; of a sales table its tickets or orders, of a returns table all rows (one for each ticket)."""
    if sf <= 0:
        raise ValueError("the scale factor must be positive")
    if table in FIXED:
        return FIXED[table]
    if table.endswith("_returns"):
        return row_count(table.replace("returns", "sales"), sf)
    if table in LINEAR:
        return max(1, round(LINEAR[table] * sf))
    if table in ROOT:
        return max(1, round(ROOT[table] * math.sqrt(sf)))
    raise ValueError(f"unknown table {table!r}; there are {sorted(TPCDS)}")


def _sales(p: str, key: str, d) -> dict[str, str]:
    """Prices of a sale in cents, as expressions over the columns that _priced adds."""
    money = lambda x: f"cast({x} as double) / 100"
    return {
        f"{p}_quantity": "cast(qty as int)", f"{p}_wholesale_cost": money("cost"), f"{p}_list_price": money("listed"), f"{p}_sales_price": money("price"),
        f"{p}_ext_discount_amt": money("qty * (listed - price)"), f"{p}_ext_sales_price": money("qty * price"), f"{p}_ext_wholesale_cost": money("qty * cost"), f"{p}_ext_list_price": money("qty * listed"),
        f"{p}_ext_tax": money("taxed"), f"{p}_coupon_amt": money("coupon"), f"{p}_net_paid": money("net"), f"{p}_net_paid_inc_tax": money("net + taxed"), f"{p}_net_profit": money("net - qty * cost"),
        f"{p}_ext_ship_cost": money("shipping"), f"{p}_net_paid_inc_ship": money("net + shipping"), f"{p}_net_paid_inc_ship_tax": money("net + shipping + taxed"),
    }


def _priced(table: str, sf: float, d, returned: str | None = None) -> str:
    """Lines of a sales table with prices as integers; ``returned`` as "reference": the last line of each ticket; as "spec":
    one line in ten, by a draw."""
    least, most = LINES[table]
    u = lambda s, n, lo=0, k="k": f"({lo} + {d.draw(f'{table}_{s}', k)} % {n})"
    base = d.rows(row_count(table, sf))
    count = f"{least} + {d.draw(f'{table}_lines')} % {most - least + 1}"
    lines = f"(select id, line, id * 32 + line as k from {d.children(base, count)})" if returned != "reference" else f"(select id, {count} as line, id * 32 + {count} as k from {base})"
    if returned == "spec":
        lines = f"(select * from {lines} where {u('returned', 10)} = 0)"
    one = f"(select *, {u('qty', 100, 1)} as qty, {u('cost', 9_901, 100)} as cost, {u('up', 101)} as up, {u('off', 101)} as off, {u('tax', 10)} as tax, {u('cut', 5)} as cut, {u('cutp', 101)} as cutp, {u('ship', 51)} as shipp from {lines})"
    two = f"(select *, cost + {d.div('cost * up', '100')} as listed from {one})"
    three = f"(select *, listed - {d.div('listed * off', '100')} as price, {d.div('qty * listed * shipp', '200')} as shipping from {two})"
    four = f"(select *, case when cut = 0 then {d.div('qty * price * cutp', '100')} else 0 end as coupon from {three})"
    five = f"(select *, qty * price - coupon as net from {four})"
    return f"(select *, {d.div('net * tax', '100')} as taxed from {five})"


def _refunds(p: str, table: str, d) -> dict[str, str]:
    u = lambda s, n, lo=0: f"({lo} + {d.draw(f'{table}_{s}', 'k')} % {n})"
    money = lambda x: f"cast({x} as double) / 100"
    paid = f"({u('rq', 100, 1)} % qty + 1) * price"
    tax = d.div(f"{paid} * tax", "100")
    fee, ship = u("fee", 9_951, 50), d.div(f"{paid} * shipp", "200")
    cash = d.div(f"{paid} * {u('cash', 101)}", "100")
    back = d.div(f"({paid} - {cash}) * {u('back', 101)}", "100")
    return {
        f"{p}_quantity": f"cast({u('rq', 100, 1)} % qty + 1 as int)", f"{p}_net_paid": money(paid), f"{p}_ext_tax": money(tax), f"{p}_net_paid_inc_tax": money(f"{paid} + {tax}"), f"{p}_fee": money(fee), f"{p}_ext_ship_cost": money(ship),
        f"{p}_refunded_cash": money(cash), f"{p}_reversed_charge": money(back), f"{p}_store_credit": money(f"{paid} - {cash} - {back}"), f"{p}_net_loss": money(f"{fee} + {ship} + {tax}"),
    }


def _calendar(d) -> dict[str, str]:
    """date_dim from the day's number n, day 0 being 1900-01-02."""
    part = lambda w, n="n": d.part(w, n)
    months = f"(({part('year')} - 1900) * 12 + {part('month')} - 1)"
    quarters = f"(({part('year')} - 1900) * 4 + {part('quarter')} - 1)"
    holiday = lambda n: f"case when ({part('month', n)} = 1 and {part('day', n)} = 1) or ({part('month', n)} = 7 and {part('day', n)} = 4) or ({part('month', n)} = 12 and {part('day', n)} = 25) then 1 else 0 end"
    week = d.div("n + 1", "7")
    sk = f"n + {FIRST_DATE}"
    values = {
        "d_date_sk": sk, "d_month_seq": months, "d_week_seq": f"{week} + 1", "d_quarter_seq": quarters, "d_year": part("year"), "d_dow": part("dow"), "d_moy": part("month"), "d_dom": part("day"), "d_qoy": part("quarter"),
        "d_fy_year": part("year"), "d_fy_quarter_seq": quarters, "d_fy_week_seq": f"{week} + 1", "d_day_name": d.pick(D.DAY_NAME, part("dow")), "d_holiday": holiday("n"),
        "d_weekend": f"case when {part('dow')} in (0, 6) then 1 else 0 end", "d_following_holiday": holiday("n - 1"), "d_first_dom": f"{sk} - {part('day')} + 1", "d_last_dom": f"{sk} - {part('day')} + {d.month_end('n')}",
        "d_same_day_ly": f"{sk} - 365", "d_same_day_lq": f"{sk} - 91",
    }
    return values | {f"d_current_{x}": "0" for x in ("day", "week", "month", "quarter", "year")}


def _clock(d) -> dict[str, str]:
    hour = d.div("n", "3600")
    return {
        "t_time_sk": "n", "t_time": "n", "t_hour": hour, "t_minute": f"{d.div('n', '60')} % 60", "t_second": "n % 60", "t_am_pm": f"case when n < 43200 then 'AM' else 'PM' end",
        "t_shift": f"case when {hour} < 8 then 'third' when {hour} < 16 then 'first' else 'second' end",
        "t_sub_shift": f"case when {hour} < 6 then 'night' when {hour} < 12 then 'morning' when {hour} < 18 then 'afternoon' else 'evening' end",
        "t_meal_time": f"case when {hour} between 6 and 8 then 'breakfast' when {hour} between 11 and 13 then 'lunch' when {hour} between 17 and 20 then 'dinner' else '' end",
    }


def _radix(d, digits: list[tuple[str, str, int]]) -> dict[str, str]:
    """Columns of a cross product: the row's number in mixed radix, first digit fastest."""
    out, step = {}, 1
    for column, expression, size in digits:
        digit = f"({d.div('n', str(step))} % {size})"
        out[column] = expression.replace("@", digit) if "@" in expression else d.pick(D.DICTIONARIES[column], digit)
        step *= size
    return out


def _plain(table: str, column: str, kind: str, sf: float, d, key: str) -> str:
    """A column without a formula of its own: references, dictionary values, ids, and numbers by what the name says."""
    u = lambda n, lo=0, s="": f"({lo} + {d.draw(f'{table}.{column}{s}', key)} % {n})"
    if column in D.DICTIONARIES:
        return d.pick(D.DICTIONARIES[column], u(len(D.DICTIONARIES[column])))
    if column.endswith(("_time_sk",)):
        return u(86_400)
    if "date" in column and kind != "string":
        return u(SALES_DAYS, SALES_FROM)
    ends = [e for e in REFERS if column.endswith(e)]
    if ends:
        return u(row_count(REFERS[max(ends, key=len)], sf), 1)
    if kind == "double":
        if column.endswith("gmt_offset"):
            return f"cast(-5 - {u(4)} as double)"
        if column.endswith("percentage"):
            return f"cast({u(12)} as double) / 100"
        return f"cast({u(9_901, 100)} as double) / 100"
    if kind == "string":
        if column.endswith("_id"):
            return f"concat('AAAAAAAA', lpad(cast({key} as varchar(20)), 8, '0'))"
        if column.endswith("_zip"):
            return f"lpad(cast({u(100_000)} as varchar(20)), 5, '0')"
        if column.endswith("email_address"):
            return f"concat(substr({d.hash(column, key)}, 1, 12), '@example.org')"
        for end, words in NAMES.items():
            if column.endswith(end):
                return d.pick(words, u(len(words)))
        for end, most in PROSE.items():
            if column.endswith(end):
                return text.part(d, POOL, d.draw(f"{table}.{column}", key), 10, most)
        return f"concat('{column.split('_', 1)[-1]}_', cast({u(1_000)} as varchar(20)))"
    ranges = {"day": (28, 1), "month": (12, 1), "year": (69, 1924), "street_number": (1_000, 1), "quantity_on_hand": (1_001, 0), "employees": (101, 200), "autogen_flag": (2, 0), "preferred_cust_flag": (2, 0), "discount_active": (2, 0)}
    for end, (n, lo) in ranges.items():
        if column.endswith(end):
            return u(n, lo)
    return u(2) if "_channel_" in column else u(1_000, 1)


def sql(table: str, sf: float, d=None, returns_mode: str = "reference") -> str:
    """The table as one SELECT in the dialect d. returns_mode: one return for each ticket, or ("spec") of a tenth of the lines."""
    if returns_mode not in RETURNS_MODES:
        raise ValueError(f"unknown returns mode {returns_mode!r}; there are {RETURNS_MODES}")
    d = d or Spark()
    n, key, values = row_count(table, sf), "id", {}
    source = d.rows(n)
    if table in LINES or table.endswith("_returns"):
        sales = table.replace("returns", "sales")
        source, key = _priced(sales, sf, d, None if table == sales else returns_mode), "k"
        p = table_columns("ds", table)[0][0].split("_")[0]
        values = _sales(p, key, d) if table == sales else _refunds(p, table, d)
        values |= {f"{p}_ticket_number": "id", f"{p}_order_number": "id"}
        if table != sales:  # what comes back is what the line sold
            sold = table_columns("ds", sales)[0][0].split("_")[0]
            values[f"{p}_item_sk"] = _plain(sales, f"{sold}_item_sk", "bigint", sf, d, key)
    elif table in ("date_dim", "time_dim", "household_demographics", "customer_demographics", "income_band"):
        source = f"(select id, id as n from {d.rows(n, 0)})"
        values = {
            "date_dim": lambda: _calendar(d),
            "time_dim": lambda: _clock(d),
            "income_band": lambda: {"ib_income_band_id": "n + 1", "ib_lower_bound": "case when n = 0 then 0 else n * 10000 + 1 end", "ib_upper_bound": "(n + 1) * 10000"},
            "household_demographics": lambda: {"hd_demo_sk": "n + 1"} | _radix(d, [("hd_income_band_sk", "@ + 1", 20), ("hd_buy_potential", "", 6), ("hd_dep_count", "@", 10), ("hd_vehicle_count", "@ - 1", 6)]),
            "customer_demographics": lambda: {"cd_demo_sk": "n + 1"} | _radix(d, [("cd_gender", "", 2), ("cd_marital_status", "", 5), ("cd_education_status", "", 7), ("cd_purchase_estimate", "(@ + 1) * 500", 20), ("cd_credit_rating", "", 4), ("cd_dep_count", "@", 7), ("cd_dep_employed_count", "@", 7), ("cd_dep_college_count", "@", 7)]),
        }[table]()
    elif table == "inventory":
        items, houses = row_count("item", sf), row_count("warehouse", sf)
        values = {"inv_item_sk": f"(id - 1) % {items} + 1", "inv_warehouse_sk": f"({d.div('id - 1', str(items))}) % {houses} + 1", "inv_date_sk": f"{SALES_FROM} + 7 * ({d.div('id - 1', str(items * houses))})"}
    elif table == "ship_mode":
        values = {"sm_type": d.pick(D.SHIP_TYPE, "(id - 1) % 6"), "sm_code": d.pick(D.SHIP_CODE, "(id - 1) % 7"), "sm_carrier": d.pick(D.CARRIER, "id - 1")}
    types = {"bigint": "bigint", "int": "int", "double": "double", "string": "varchar"}
    out = []
    for i, (column, kind, _) in enumerate(table_columns("ds", table)):
        x = values.get(column) or ("id" if i == 0 and table not in LINES and not table.endswith("_returns") and column.endswith("_sk") else _plain(table, column, kind, sf, d, key))
        out.append(f"{x} as {column}" if kind == "string" else f"cast({x} as {types[kind]}) as {column}")
    return f"select {', '.join(out)} from {source} as t"


def generate(spark: SparkSession, table: str, sf: float, returns_mode: str = "reference") -> DataFrame:
    """One table at a scale factor (fractions allowed). No table needs a shuffle: returns recompute their ticket's line."""
    return spark.sql(sql(table, sf, returns_mode=returns_mode))


def all_tables(spark: SparkSession, sf: float) -> dict[str, DataFrame]:
    return {t: generate(spark, t, sf) for t in TPCDS}
