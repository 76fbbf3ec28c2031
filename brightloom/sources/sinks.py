"""Sinks by format name: Parquet, ORC, CSV, Iceberg and Paimon tables, and Lance where a connector is there."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from brightloom.functions.dictionaries import DICTIONARIES
from brightloom.sources import tables

COMPRESSION = ("zstd", "snappy", "none")
#: A quote is doubled, spaces at the ends of a field stay.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
FORMATS = ("parquet", "orc", "csv", "iceberg", "paimon", "lance")


def dictionary_options(columns: list[str]) -> dict[str, str]:
    """Parquet's dictionary encoding for the columns of closed domains only."""
    return {"parquet.enable.dictionary": "false"} | {f"parquet.enable.dictionary#{c}": "true" for c in columns if c in DICTIONARIES}


def write(df: DataFrame, kind: str, path: str, compression: str = "zstd", rows_per_file: int = 10_000_000, mode: str = "overwrite", dictionaries: bool = False) -> None:
    """Writes a table; unknown formats and compressions are errors. Dictionary codes are written as their text.

    mode: overwrite or append, the latter for files only. dictionaries: Parquet as dictionary_options has it.
    """
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; there are {FORMATS}")
    if compression not in COMPRESSION:
        raise ValueError(f"unknown compression {compression!r}; there are {COMPRESSION}")
    if mode != "overwrite" and kind not in ("parquet", "orc", "csv"):
        raise ValueError(f"{kind} tables are written in one go")
    w = df.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    if kind == "parquet":
        w = w.options(**dictionary_options(df.columns)) if dictionaries else w
        w.option("compression", compression).parquet(path)
    elif kind == "orc":
        w.option("compression", compression).option("orc.stripe.size", str(64 << 20)).option("orc.row.index.stride", "10000").orc(path)
    elif kind == "csv":
        w.options(**CSV, emptyValue="", nullValue="").csv(path)
    elif kind == "iceberg":
        tables.write_iceberg(df, path, compression, rows_per_file)
    elif kind == "paimon":
        tables.write_paimon(df, path, compression, rows_per_file)
    else:
        _lance(lambda: w.format("lance").save(path))


def _lance(f):
    try:
        return f()
    except (PySparkException, Py4JJavaError) as e:
        if "DATA_SOURCE_NOT_FOUND" in str(e):
            raise ValueError("format 'lance' needs a connector of that name among the session's packages") from e
        raise


def read(spark: SparkSession, kind: str, path: str, schema) -> DataFrame:
    if kind == "csv":
        return spark.read.schema(schema).options(**CSV).csv(path)
    if kind in ("iceberg", "paimon"):
        files = tables.iceberg_files(spark, path) if kind == "iceberg" else tables.paimon_files(spark, path)
        return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    if kind == "lance":
        return _lance(lambda: spark.read.format("lance").load(path))
    return spark.read.schema(schema).format(kind).load(path)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files below a folder."""
    fs, p = tables.file_system(spark, path)
    return fs.getContentSummary(p).getLength()
