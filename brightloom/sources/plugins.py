"""Generators and sinks as parts of Spark: a data source that reads and writes tables, and a table function for SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.functions import udtf

from brightloom.plans.schemas import schema

#: Rows of a partition, and of a batch, of a generated key range.
PARTITION, BATCH = 1_000_000, 10_000


class Keys(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class KeyReader(DataSourceReader):
    """The keys of a table in ranges, for generators that are written as functions of a key."""

    def __init__(self, rows: int):
        self.rows = rows

    def partitions(self) -> list[Keys]:
        return [Keys(at, min(at + PARTITION, self.rows + 1)) for at in range(1, self.rows + 1, PARTITION)]

    def read(self, partition: Keys) -> Iterator[pa.RecordBatch]:
        for at in range(partition.first, partition.last, BATCH):
            yield pa.RecordBatch.from_pydict({"key": pa.array(range(at, min(at + BATCH, partition.last)), pa.int64())})


class Written(WriterCommitMessage):
    def __init__(self, rows: int):
        self.rows = rows


class CallbackWriter(DataSourceWriter):
    """Hands each task's rows to a function that the option ``call`` names as module:function, with the table's name."""

    def __init__(self, call: str, table: str):
        self.call, self.table = call, table

    def write(self, iterator) -> Written:
        import importlib

        module, name = self.call.split(":")
        f, n = getattr(importlib.import_module(module), name), 0
        for row in iterator:
            f(self.table, row)
            n += 1
        return Written(n)


class BrightloomSource(DataSource):
    """spark.read.format("brightloom").option("rows", n) has the keys 1 to n; df.write.format("brightloom")
    .option("call", "module:function").option("table", t).mode("append") calls back with each row."""

    @classmethod
    def name(cls) -> str:
        return "brightloom"

    def schema(self) -> str:
        return "key long"

    def reader(self, schema) -> KeyReader:
        return KeyReader(int(self.options.get("rows", 0)))

    def writer(self, schema, overwrite: bool) -> CallbackWriter:
        if "call" not in self.options:
            raise ValueError('the option "call" names the function as module:function')
        return CallbackWriter(self.options["call"], self.options.get("table", ""))


@udtf(returnType="position int, name string, type string")
class TableColumns:
    """Columns of a table: select * from table_columns('h', 'orders')."""

    def eval(self, suite: str, table: str):
        for i, f in enumerate(schema(suite, table)):
            yield i, f.name, f.dataType.simpleString()


def register(spark: SparkSession) -> None:
    """Makes the data source and the table functions known to a session; tables become views h_<table>, ds_<table> on demand."""
    spark.dataSource.register(BrightloomSource)
    spark.udtf.register("table_columns", TableColumns)


def create_views(spark: SparkSession, suite: str, sf: float) -> list[str]:
    """A view of each generated table, so that SQL reaches the generators; nothing is generated before it is read."""
    from brightloom.plans.schemas import TPCDS, TPCH
    from brightloom.sources import tpcds, tpch

    module, names = (tpch, TPCH) if suite == "h" else (tpcds, TPCDS)
    for t in names:
        module.generate(spark, t, sf).createOrReplaceTempView(f"{suite}_{t}")
    return [f"{suite}_{t}" for t in names]


def table_seed(table_id: int) -> int:
    """The starting seed of a table, by its number: fixed values 123456789 and 999999991, modulo 2^31."""
    return (123_456_789 + table_id * 999_999_991) % (1 << 31)
