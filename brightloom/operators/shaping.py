"""Limits, flattening, batches, naming and worklists."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

EXTENSIONS = {"parquet": "parquet", "csv": "csv", "orc": "orc", "iceberg": "iceberg", "paimon": "paimon", "lance": "lance"}


def limit_rows(df: DataFrame, order: list[str], most: int = 1000) -> DataFrame:
    """The first ``most`` rows in an order, all if 0: a top-k, never a bare limit over unordered rows."""
    return df if most == 0 else df.orderBy(*order).limit(most)


def limit_parents(children: DataFrame, parent: str, most: int) -> DataFrame:
    """Children of the first ``most`` parents in key order. The parents' keys are a top-k of at most that many rows."""
    if most == 0:
        return children
    firsts = children.select(parent).distinct().orderBy(parent).limit(most)
    return children.join(firsts, parent, "left_semi")


def flatten(parents: DataFrame, count: Column, name: str = "line") -> DataFrame:
    """One row for each parent and each number from 1 to its count; none for a count of 0 or null."""
    n = F.coalesce(count.cast("int"), F.lit(0))
    return parents.withColumn(name, F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))))


def batches(df: DataFrame, position: str, size: int) -> DataFrame:
    """Number of the batch of ``size`` rows that each row falls in, from its generated position (from 0)."""
    return df.withColumn("batch", F.floor(F.col(position) / size).cast("long"))


def pull(df: DataFrame, size: int) -> Iterator[list[Row]]:
    """Batches of rows for a program that pulls them, a partition at a time on the driver; the last one may be shorter."""
    if size < 1:
        raise ValueError("a batch has a row at least")
    held: list[Row] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def each_row(df: DataFrame, table: str, callback: Callable[[str, Row], None]) -> None:
    """Calls back with the table's name and each row, on the executors, a partition at a time."""

    def run(rows: Iterator[Row]) -> None:
        for row in rows:
            callback(table, row)

    df.foreachPartition(run)


def estimated_bytes(df: DataFrame) -> Column:
    """Bytes that a row's values take in columnar buffers: fixed widths, and texts with their offsets; a bit for each null."""
    out = F.lit(0)
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind in ("string", "binary"):
            out = out + 4 + F.coalesce(F.octet_length(f.name), F.lit(0))
        else:
            out = out + {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}.get(kind, 8)
    return (out + F.lit(len(df.columns)) / 8).cast("double")


def output_name(folder: str, table: str, kind: str) -> str:
    if kind not in EXTENSIONS:
        raise ValueError(f"unknown format {kind!r}; there are {sorted(EXTENSIONS)}")
    return f"{folder.rstrip('/')}/{table}.{EXTENSIONS[kind]}"


def worklist(*sides: DataFrame) -> DataFrame:
    """All combinations of a few short lists (formats, tables, runs)."""
    return reduce(lambda a, b: a.crossJoin(b), sides)


def first_of_each(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
