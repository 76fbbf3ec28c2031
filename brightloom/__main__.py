"""Writes generated tables: python -m brightloom --suite h --scale-factor 1 --format parquet --output-dir /data [--table T]."""

from __future__ import annotations

import argparse
import sys

from brightloom.operators.shaping import limit_rows
from brightloom.plans import runs
from brightloom.plans.schemas import TPCDS, TPCH
from brightloom.sources import sinks, tpcds, tpch


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="brightloom", description=__doc__)
    p.add_argument("--suite", choices=("h", "ds"), default="h")
    p.add_argument("--table", action="append", help="a table; may be repeated; all tables by default")
    p.add_argument("--scale-factor", type=float, default=1.0)
    p.add_argument("--format", choices=sinks.FORMATS, default="parquet")
    p.add_argument("--output-dir", required=True)
    p.add_argument("--compression", choices=sinks.COMPRESSION, default="zstd")
    p.add_argument("--max-rows", type=int, default=0, help="rows of each table; 0: all")
    p.add_argument("--parallel", type=int, default=4, help="tables at a time")
    a = p.parse_args(argv)
    module, known = (tpch, TPCH) if a.suite == "h" else (tpcds, TPCDS)
    names = a.table or list(known)
    if unknown := [t for t in names if t not in known]:
        p.error(f"unknown tables {unknown}; there are {list(known)}")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    tables = {t: module.generate(spark, t, a.scale_factor) for t in names}
    if a.max_rows:
        tables = {t: limit_rows(df, df.columns[:2], a.max_rows) for t, df in tables.items()}
    rows = {t: module.row_count(t, a.scale_factor) for t in names}
    lines = runs.write_all(spark, tables, a.format, a.output_dir, a.parallel, rows, compression=a.compression).collect()
    print("\n\n".join(runs.report_text(x) for x in lines))
    return int(any(x["error"] for x in lines))


if __name__ == "__main__":
    sys.exit(main())
