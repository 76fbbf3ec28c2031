"""Schemas of the 8 TPC-H and 24 TPC-DS tables, in the order in which columns are emitted.

The names, orders and types below are fixed values. A star marks a column whose values come from a small dictionary.
"""

from __future__ import annotations

from pyspark.sql import types as T

TPCH: dict[str, str] = {
    "lineitem": """
        l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, l_quantity double,
        l_extendedprice double, l_discount double, l_tax double, l_returnflag string*, l_linestatus string*,
        l_commitdate string*, l_shipdate string*, l_receiptdate string*, l_shipinstruct string*,
        l_shipmode string*, l_comment string
    """,
    "orders": """
        o_orderkey bigint, o_custkey bigint, o_orderstatus string*, o_totalprice double, o_orderdate string*,
        o_orderpriority string*, o_clerk string, o_shippriority bigint, o_comment string
    """,
    "customer": """
        c_custkey bigint, c_name string, c_address string, c_nationkey bigint, c_phone string, c_acctbal double,
        c_mktsegment string*, c_comment string
    """,
    "part": """
        p_partkey bigint, p_name string, p_mfgr string*, p_brand string*, p_type string*, p_size bigint,
        p_container string*, p_retailprice double, p_comment string
    """,
    "partsupp": """
        ps_partkey bigint, ps_suppkey bigint, ps_availqty bigint, ps_supplycost double, ps_comment string
    """,
    "supplier": """
        s_suppkey bigint, s_name string, s_address string, s_nationkey bigint, s_phone string, s_acctbal double,
        s_comment string
    """,
    "nation": """
        n_nationkey bigint, n_name string, n_regionkey bigint, n_comment string
    """,
    "region": """
        r_regionkey bigint, r_name string, r_comment string
    """,
}

TPCDS: dict[str, str] = {
    "store_sales": """
        ss_sold_date_sk bigint, ss_sold_time_sk bigint, ss_item_sk bigint, ss_customer_sk bigint,
        ss_cdemo_sk bigint, ss_hdemo_sk bigint, ss_addr_sk bigint, ss_store_sk bigint, ss_promo_sk bigint,
        ss_ticket_number bigint, ss_quantity int, ss_wholesale_cost double, ss_list_price double,
        ss_sales_price double, ss_ext_discount_amt double, ss_ext_sales_price double, ss_ext_wholesale_cost double,
        ss_ext_list_price double, ss_ext_tax double, ss_coupon_amt double, ss_net_paid double,
        ss_net_paid_inc_tax double, ss_net_profit double
    """,
    "inventory": """
        inv_date_sk bigint, inv_item_sk bigint, inv_warehouse_sk bigint, inv_quantity_on_hand int
    """,
    "catalog_sales": """
        cs_sold_date_sk bigint, cs_sold_time_sk bigint, cs_ship_date_sk bigint, cs_bill_customer_sk bigint,
        cs_bill_cdemo_sk bigint, cs_bill_hdemo_sk bigint, cs_bill_addr_sk bigint, cs_ship_customer_sk bigint,
        cs_ship_cdemo_sk bigint, cs_ship_hdemo_sk bigint, cs_ship_addr_sk bigint, cs_call_center_sk bigint,
        cs_catalog_page_sk bigint, cs_ship_mode_sk bigint, cs_warehouse_sk bigint, cs_item_sk bigint,
        cs_promo_sk bigint, cs_order_number bigint, cs_quantity int, cs_wholesale_cost double,
        cs_list_price double, cs_sales_price double, cs_ext_discount_amt double, cs_ext_sales_price double,
        cs_ext_wholesale_cost double, cs_ext_list_price double, cs_ext_tax double, cs_coupon_amt double,
        cs_ext_ship_cost double, cs_net_paid double, cs_net_paid_inc_tax double, cs_net_paid_inc_ship double,
        cs_net_paid_inc_ship_tax double, cs_net_profit double
    """,
    "web_sales": """
        ws_sold_date_sk bigint, ws_sold_time_sk bigint, ws_ship_date_sk bigint, ws_item_sk bigint,
        ws_bill_customer_sk bigint, ws_bill_cdemo_sk bigint, ws_bill_hdemo_sk bigint, ws_bill_addr_sk bigint,
        ws_ship_customer_sk bigint, ws_ship_cdemo_sk bigint, ws_ship_hdemo_sk bigint, ws_ship_addr_sk bigint,
        ws_web_page_sk bigint, ws_web_site_sk bigint, ws_ship_mode_sk bigint, ws_warehouse_sk bigint,
        ws_promo_sk bigint, ws_order_number bigint, ws_quantity int, ws_wholesale_cost double,
        ws_list_price double, ws_sales_price double, ws_ext_discount_amt double, ws_ext_sales_price double,
        ws_ext_wholesale_cost double, ws_ext_list_price double, ws_ext_tax double, ws_coupon_amt double,
        ws_ext_ship_cost double, ws_net_paid double, ws_net_paid_inc_tax double, ws_net_paid_inc_ship double,
        ws_net_paid_inc_ship_tax double, ws_net_profit double
    """,
    "customer": """
        c_customer_sk bigint, c_customer_id string, c_current_cdemo_sk bigint, c_current_hdemo_sk bigint,
        c_current_addr_sk bigint, c_first_shipto_date_id int, c_first_sales_date_id int, c_salutation string*,
        c_first_name string, c_last_name string, c_preferred_cust_flag int, c_birth_day int, c_birth_month int,
        c_birth_year int, c_birth_country string, c_login string, c_email_address string, c_last_review_date int
    """,
    "item": """
        i_item_sk bigint, i_item_id string, i_rec_start_date_id bigint, i_rec_end_date_id bigint,
        i_item_desc string, i_current_price double, i_wholesale_cost double, i_brand_id bigint, i_brand string,
        i_class_id bigint, i_class string, i_category_id bigint, i_category string*, i_manufact_id bigint,
        i_manufact string, i_size string*, i_formulation string, i_color string*, i_units string*,
        i_container string*, i_manager_id bigint, i_product_name string, i_promo_sk bigint
    """,
    "date_dim": """
        d_date_sk bigint, d_date_id string, d_month_seq int, d_week_seq int, d_quarter_seq int, d_year int,
        d_dow int, d_moy int, d_dom int, d_qoy int, d_fy_year int, d_fy_quarter_seq int, d_fy_week_seq int,
        d_day_name string*, d_holiday int, d_weekend int, d_following_holiday int, d_first_dom int, d_last_dom int,
        d_same_day_ly int, d_same_day_lq int, d_current_day int, d_current_week int, d_current_month int,
        d_current_quarter int, d_current_year int
    """,
    "store_returns": """
        sr_returned_date_sk bigint, sr_returned_time_sk bigint, sr_item_sk bigint, sr_customer_sk bigint,
        sr_cdemo_sk bigint, sr_hdemo_sk bigint, sr_addr_sk bigint, sr_store_sk bigint, sr_reason_sk bigint,
        sr_ticket_number bigint, sr_quantity int, sr_net_paid double, sr_ext_tax double,
        sr_net_paid_inc_tax double, sr_fee double, sr_ext_ship_cost double, sr_refunded_cash double,
        sr_reversed_charge double, sr_store_credit double, sr_net_loss double
    """,
    "catalog_returns": """
        cr_returned_date_sk bigint, cr_returned_time_sk bigint, cr_item_sk bigint, cr_refunded_customer_sk bigint,
        cr_refunded_cdemo_sk bigint, cr_refunded_hdemo_sk bigint, cr_refunded_addr_sk bigint,
        cr_returning_customer_sk bigint, cr_returning_cdemo_sk bigint, cr_returning_hdemo_sk bigint,
        cr_returning_addr_sk bigint, cr_call_center_sk bigint, cr_catalog_page_sk bigint, cr_ship_mode_sk bigint,
        cr_warehouse_sk bigint, cr_reason_sk bigint, cr_order_number bigint, cr_quantity int, cr_net_paid double,
        cr_ext_tax double, cr_net_paid_inc_tax double, cr_fee double, cr_ext_ship_cost double,
        cr_refunded_cash double, cr_reversed_charge double, cr_store_credit double, cr_net_loss double
    """,
    "web_returns": """
        wr_returned_date_sk bigint, wr_returned_time_sk bigint, wr_item_sk bigint, wr_refunded_customer_sk bigint,
        wr_refunded_cdemo_sk bigint, wr_refunded_hdemo_sk bigint, wr_refunded_addr_sk bigint,
        wr_returning_customer_sk bigint, wr_returning_cdemo_sk bigint, wr_returning_hdemo_sk bigint,
        wr_returning_addr_sk bigint, wr_web_page_sk bigint, wr_reason_sk bigint, wr_order_number bigint,
        wr_quantity int, wr_net_paid double, wr_ext_tax double, wr_net_paid_inc_tax double, wr_fee double,
        wr_ext_ship_cost double, wr_refunded_cash double, wr_reversed_charge double, wr_store_credit double,
        wr_net_loss double
    """,
    "call_center": """
        cc_call_center_sk bigint, cc_call_center_id string, cc_rec_start_date_sk bigint, cc_rec_end_date_sk bigint,
        cc_closed_date_sk bigint, cc_open_date_sk bigint, cc_name string*, cc_class string*, cc_employees int,
        cc_sq_ft int, cc_hours string*, cc_manager string, cc_mkt_id int, cc_mkt_class string, cc_mkt_desc string,
        cc_market_manager string, cc_division int, cc_division_name string, cc_company int, cc_company_name string,
        cc_street_number int, cc_street_name string, cc_street_type string*, cc_suite_number string,
        cc_city string, cc_county string, cc_state string*, cc_zip string, cc_country string*,
        cc_gmt_offset double, cc_tax_percentage double
    """,
    "catalog_page": """
        cp_catalog_page_sk bigint, cp_catalog_page_id string, cp_start_date_sk bigint, cp_end_date_sk bigint,
        cp_department string*, cp_catalog_number int, cp_catalog_page_number int, cp_description string,
        cp_type string*
    """,
    "web_page": """
        wp_web_page_sk bigint, wp_web_page_id string, wp_rec_start_date_sk bigint, wp_rec_end_date_sk bigint,
        wp_creation_date_sk bigint, wp_access_date_sk bigint, wp_autogen_flag int, wp_customer_sk bigint,
        wp_url string, wp_type string*, wp_char_count int, wp_link_count int, wp_image_count int,
        wp_max_ad_count int
    """,
    "web_site": """
        web_site_sk bigint, web_site_id string, web_rec_start_date_sk bigint, web_rec_end_date_sk bigint,
        web_name string, web_open_date_sk bigint, web_close_date_sk bigint, web_class string*, web_manager string,
        web_mkt_id int, web_mkt_class string, web_mkt_desc string, web_market_manager string, web_company_id int,
        web_company_name string, web_street_number int, web_street_name string, web_street_type string*,
        web_suite_number string, web_city string, web_county string, web_state string*, web_zip string,
        web_country string*, web_gmt_offset double, web_tax_percentage double
    """,
    "warehouse": """
        w_warehouse_sk bigint, w_warehouse_id string, w_warehouse_name string, w_warehouse_sq_ft int,
        w_street_number int, w_street_name string, w_street_type string*, w_suite_number string, w_city string,
        w_county string, w_state string*, w_zip string, w_country string*, w_gmt_offset double
    """,
    "ship_mode": """
        sm_ship_mode_sk bigint, sm_ship_mode_id string, sm_type string*, sm_code string*, sm_carrier string*,
        sm_contract string
    """,
    "household_demographics": """
        hd_demo_sk bigint, hd_income_band_sk bigint, hd_buy_potential string*, hd_dep_count int,
        hd_vehicle_count int
    """,
    "customer_demographics": """
        cd_demo_sk bigint, cd_gender string*, cd_marital_status string*, cd_education_status string*,
        cd_purchase_estimate int, cd_credit_rating string*, cd_dep_count int, cd_dep_employed_count int,
        cd_dep_college_count int
    """,
    "customer_address": """
        ca_address_sk bigint, ca_address_id string, ca_street_number int, ca_street_name string,
        ca_street_type string*, ca_suite_number string, ca_city string, ca_county string, ca_state string*,
        ca_zip string, ca_country string*, ca_gmt_offset double, ca_location_type string*
    """,
    "income_band": """
        ib_income_band_id int, ib_lower_bound int, ib_upper_bound int
    """,
    "reason": """
        r_reason_sk bigint, r_reason_id string, r_reason_desc string
    """,
    "time_dim": """
        t_time_sk bigint, t_time_id string, t_time int, t_hour int, t_minute int, t_second int, t_am_pm string*,
        t_shift string*, t_sub_shift string*, t_meal_time string*
    """,
    "promotion": """
        p_promo_sk bigint, p_promo_id string, p_start_date_sk bigint, p_end_date_sk bigint, p_item_sk bigint,
        p_cost double, p_response_target int, p_promo_name string, p_channel_dmail int, p_channel_email int,
        p_channel_catalog int, p_channel_tv int, p_channel_radio int, p_channel_press int, p_channel_event int,
        p_channel_demo int, p_channel_details string, p_purpose string*, p_discount_active int
    """,
    "store": """
        s_store_sk bigint, s_store_id string, s_rec_start_date bigint, s_rec_end_date bigint,
        s_closed_date_sk bigint, s_store_name string, s_number_employees int, s_floor_space int, s_hours string*,
        s_manager string, s_market_id int, s_geography_class string*, s_market_desc string,
        s_market_manager string, s_division_id bigint, s_division_name string*, s_company_id bigint,
        s_company_name string*, s_street_number int, s_street_name string, s_street_type string*,
        s_suite_number string, s_city string, s_county string, s_state string*, s_zip string, s_country string*,
        s_gmt_offset double, s_tax_percentage double
    """,
}

_TYPES = {"bigint": T.LongType(), "double": T.DoubleType(), "int": T.IntegerType(), "string": T.StringType()}


def columns(text: str) -> list[tuple[str, str, bool]]:
    """(name, type, whether from a dictionary) of a table's text."""
    found = []
    for part in text.split(","):
        name, kind = part.split()
        found.append((name, kind.rstrip("*"), kind.endswith("*")))
    return found


def table_columns(suite: str, table: str) -> list[tuple[str, str, bool]]:
    tables = {"h": TPCH, "ds": TPCDS}[suite]
    if table not in tables:
        raise ValueError(f"unknown table {table!r}; there are {sorted(tables)}")
    return columns(tables[table])


def schema(suite: str, table: str, rows: int | None = None) -> T.StructType:
    """The table's schema; dictionary columns and the row count, if given, are noted as cardinality metadata."""
    from brightloom.functions.dictionaries import DICTIONARIES

    fields = []
    for name, kind, coded in table_columns(suite, table):
        known = DICTIONARIES.get(name)
        n = len(known) if coded and known else rows if kind == "string" else None
        fields.append(T.StructField(name, _TYPES[kind], True, {"cardinality": n} if n else {}))
    return T.StructType(fields)
