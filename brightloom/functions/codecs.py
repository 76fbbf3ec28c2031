"""Encoders and decoders of dictionary columns, dates, money and text formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions.dictionaries import DICTIONARIES, PART_TYPE

FIRST_DAY, LAST_DAY = "1992-01-01", "1998-12-31"
UNKNOWN = -1
#: Columns whose null is the empty text, which has a code.
EMPTY_IS_A_VALUE = ("t_meal_time",)


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def encode(value: Column, values: list[str], miss: int | None = UNKNOWN) -> Column:
    """Position of the value in the list; ``miss`` where it is not there (the reference's default), null stays null."""
    at = F.array_position(_array(values), value).cast("int") - 1
    return F.when(value.isNull(), F.lit(None).cast("int")).when(at >= 0, at).otherwise(F.lit(miss).cast("int"))


def decode(code: Column, values: list[str]) -> Column:
    """The value of a code; null for a code outside the list."""
    return F.get(_array(values), code)


def encode_field(name: str, value: Column | None = None) -> Column:
    if name not in DICTIONARIES:
        raise ValueError(f"{name} is not a dictionary column")
    value = F.col(name) if value is None else value
    return encode(or_empty(value) if name in EMPTY_IS_A_VALUE else value, DICTIONARIES[name])


def decode_field(name: str, code: Column) -> Column:
    return decode(code, DICTIONARIES[name])


def brand_code(value: Column) -> Column:
    """Brand#XY to (X - 1) * 5 + Y - 1; null where X and Y are not both from 1 to 5."""
    ok = value.rlike("^Brand#[1-5][1-5]$")
    return F.when(ok, (F.ascii(F.substring(value, 7, 1)) - 49) * 5 + F.ascii(F.substring(value, 8, 1)) - 49)


def priority_code(value: Column) -> Column:
    """First character less '1'."""
    return F.ascii(value) - 49


def date_code(day: Column) -> Column:
    """Days since 1992-01-01; null outside 1992 to 1998."""
    d = day.cast("date")
    return F.when(d.between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date")), F.datediff(d, F.lit(FIRST_DAY).cast("date")))


def date_of(code: Column) -> Column:
    return F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), code.cast("int")), "yyyy-MM-dd")


def date_dictionary(spark: SparkSession) -> DataFrame:
    """All 2557 days with their codes."""
    return spark.range(2557).select(F.col("id").cast("int").alias("code"), date_of(F.col("id")).alias("day"))


def dictionary_table(spark: SparkSession, name: str) -> DataFrame:
    values = DICTIONARIES[name]
    return spark.createDataFrame(list(enumerate(values)), "code int, value string")


def part_type_code(value: Column) -> Column:
    return encode(value, PART_TYPE)


def dollars(cents: Column) -> Column:
    return cents.cast("double") / 100


def cents(money: Column) -> Column:
    return F.round(money * 100).cast("long")


def decimal_to_double(number: Column, precision: Column) -> Column:
    """number / 10^precision, as one division."""
    return number.cast("double") / F.pow(F.lit(10.0), precision)


def zip_code(number: Column) -> Column:
    return F.lpad(number.cast("string"), 5, "0")


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def csv_field(text: Column) -> Column:
    """Quotes a field that holds a comma, quote or line end; null is empty."""
    t = or_empty(text)
    return F.when(t.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def zigzag(value: int) -> bytes:
    """Avro's variable-length integer."""
    n = (value << 1) ^ (value >> 63)
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def avro_bytes(value: bytes | str) -> bytes:
    raw = value.encode() if isinstance(value, str) else value
    return zigzag(len(raw)) + raw
