"""Dictionaries of low-cardinality columns. The position of a value (from 0) is its code.

All lists are fixed values of the public TPC-H and TPC-DS domains, in code order.
"""

from __future__ import annotations

RETURN_FLAG = ["A", "N", "R"]
LINE_STATUS = ["F", "O"]
SHIP_INSTRUCT = ["COLLECT COD", "DELIVER IN PERSON", "NONE", "TAKE BACK RETURN"]
SHIP_MODE = ["AIR", "FOB", "MAIL", "RAIL", "REG AIR", "SHIP", "TRUCK"]
ORDER_STATUS = ["F", "O", "P"]
ORDER_PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
MARKET_SEGMENT = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
MANUFACTURER = [f"Manufacturer#{i}" for i in range(1, 6)]
BRAND = [f"Brand#{i}{j}" for i in range(1, 6) for j in range(1, 6)]
CONTAINER = [f"{a} {b}" for a in ("SM", "MED", "LG", "JUMBO", "WRAP") for b in ("BOX", "BAG", "JAR", "PKG", "PACK", "CAN", "DRUM", "CUP")]
TYPE_1 = ["STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO"]
TYPE_2 = ["ANODIZED", "BURNISHED", "PLATED", "POLISHED", "BRUSHED"]
TYPE_3 = ["TIN", "NICKEL", "BRASS", "STEEL", "COPPER"]
PART_TYPE = [f"{a} {b} {c}" for a in TYPE_1 for b in TYPE_2 for c in TYPE_3]

GENDER = ["M", "F"]
MARITAL = ["M", "S", "D", "W", "U"]
EDUCATION = ["Primary", "Secondary", "College", "2 yr Degree", "4 yr Degree", "Advanced Degree", "Unknown"]
CREDIT = ["Good", "Low Risk", "High Risk", "Unknown"]
SALUTATION = ["Mr.", "Mrs.", "Ms.", "Miss", "Sir", "Dr."]
AM_PM = ["AM", "PM"]
SHIFT = ["first", "second", "third"]
SUB_SHIFT = ["morning", "afternoon", "evening", "night"]
MEAL = ["", "breakfast", "lunch", "dinner"]
DAY_NAME = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
CATEGORY = ["Women", "Men", "Children", "Shoes", "Music", "Jewelry", "Home", "Sports", "Books", "Electronics"]
ITEM_SIZE = ["petite", "small", "medium", "large", "extra large", "economy", "N/A"]
CATALOG_TYPE = ["bi-annual", "quarterly", "monthly"]
PAGE_TYPE = ["general", "order", "welcome", "ad", "feedback", "protected", "dynamic"]
SHIP_TYPE = ["REGULAR", "EXPRESS", "NEXT DAY", "OVERNIGHT", "TWO DAY", "LIBRARY"]
SHIP_CODE = ["AIR", "SURFACE", "SEA", "BIKE", "HAND CARRY", "MESSENGER", "COURIER"]
CARRIER = [
    "UPS", "FEDEX", "AIRBORNE", "USPS", "DHL", "TBS", "ZHOU", "ZOUROS", "MSC", "LATVIAN", "ALLIANCE", "ORIENTAL",
    "BARIAN", "BOXBUNDLES", "GREAT EASTERN", "DIAMOND", "RUPEKSA", "GERMA", "HARMSTORF", "PRIVATECARRIER",
]
LOCATION = ["single family", "condo", "apartment"]
CENTER_CLASS = ["small", "medium", "large"]
HOURS = ["8AM-4PM", "8AM-12AM", "8AM-8AM"]
CENTER_NAME = ["New England", "NY Metro", "Mid Atlantic", "Southeastern", "North Midwest", "Central Midwest", "South Midwest", "Pacific Northwest", "California", "Southwest", "Hawaii/Alaska", "Other"]
STREET = [
    "Street", "ST", "Avenue", "Ave", "Boulevard", "Blvd", "Road", "RD", "Parkway", "Pkwy", "Way", "Wy", "Drive",
    "Dr.", "Circle", "Cir.", "Lane", "Ln", "Court", "Ct.",
]
BUY_POTENTIAL = [">10000", "0-500", "501-1000", "5001-10000", "1001-5000", "unknown"]
STATE = [
    "AK", "AL", "AR", "AZ", "CA", "CO", "CT", "DC", "DE", "FL", "GA", "HI", "IA", "ID", "IL", "IN", "KS", "KY", "LA",
    "MA", "MD", "ME", "MI", "MN", "MO", "MS", "MT", "NC", "ND", "NE", "NH", "NJ", "NM", "NV", "NY", "OH", "OK", "OR",
    "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VA", "VT", "WA", "WI", "WV", "WY",
]
COLOR = [
    "almond", "antique", "aquamarine", "azure", "beige", "bisque", "black", "blanched", "blue", "blush", "brown",
    "burlywood", "burnished", "chartreuse", "chiffon", "chocolate", "coral", "cornflower", "cornsilk", "cream",
    "cyan", "dark", "deep", "dim", "dodger", "drab", "firebrick", "floral", "forest", "frosted", "gainsboro", "ghost",
    "goldenrod", "green", "grey", "honeydew", "hot", "indian", "ivory", "khaki", "lace", "lavender", "lawn", "lemon",
    "light", "lime", "linen", "magenta", "maroon", "medium", "metallic", "midnight", "mint", "misty", "moccasin",
    "navajo", "navy", "olive", "orange", "orchid", "pale", "papaya", "peach", "peru", "pink", "plum", "powder",
    "puff", "purple", "red", "rose", "rosy", "royal", "saddle", "salmon", "sandy", "seashell", "sienna", "sky",
    "slate", "smoke", "snow", "spring", "steel", "tan", "thistle", "tomato", "turquoise", "violet", "wheat", "white",
    "yellow",
]
UNITS = [
    "Unknown", "Each", "Dozen", "Case", "Pallet", "Gross", "Carton", "Box", "Bunch", "Bundle", "Oz", "Lb", "Ton",
    "Ounce", "Pound", "Tsp", "Tbl", "Cup", "Dram", "Gram", "N/A",
]
ONE = {"unknown": ["Unknown"], "department": ["DEPARTMENT"], "country": ["United States"]}

#: Column name to dictionary; columns of other names are not encoded.
DICTIONARIES: dict[str, list[str]] = {
    "l_returnflag": RETURN_FLAG, "l_linestatus": LINE_STATUS, "l_shipinstruct": SHIP_INSTRUCT, "l_shipmode": SHIP_MODE,
    "o_orderstatus": ORDER_STATUS, "o_orderpriority": ORDER_PRIORITY, "c_mktsegment": MARKET_SEGMENT,
    "p_mfgr": MANUFACTURER, "p_brand": BRAND, "p_container": CONTAINER, "p_type": PART_TYPE,
    "cd_gender": GENDER, "cd_marital_status": MARITAL, "cd_education_status": EDUCATION, "cd_credit_rating": CREDIT,
    "c_salutation": SALUTATION, "t_am_pm": AM_PM, "t_shift": SHIFT, "t_sub_shift": SUB_SHIFT, "t_meal_time": MEAL,
    "d_day_name": DAY_NAME, "i_category": CATEGORY, "i_size": ITEM_SIZE, "i_color": COLOR, "i_units": UNITS,
    "cp_type": CATALOG_TYPE, "wp_type": PAGE_TYPE, "sm_type": SHIP_TYPE, "sm_code": SHIP_CODE, "sm_carrier": CARRIER,
    "ca_location_type": LOCATION, "cc_class": CENTER_CLASS, "cc_name": CENTER_NAME, "hd_buy_potential": BUY_POTENTIAL,
    "cp_department": ONE["department"],
    **{c: ONE["unknown"] for c in ("i_container", "web_class", "s_geography_class", "s_division_name", "s_company_name", "p_purpose")},
    **{f"{p}_country": ONE["country"] for p in ("web", "w", "s", "cc", "ca")},
    **{f"{p}_state": STATE for p in ("web", "w", "s", "cc", "ca")},
    **{f"{p}_street_type": STREET for p in ("web", "w", "s", "cc", "ca")},
    **{f"{p}_hours": HOURS for p in ("s", "cc")},
}
