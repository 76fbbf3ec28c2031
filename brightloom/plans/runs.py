"""Runs over many tables: a window of N tables at a time, a coordinator that routes batches, reports, and counters."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from brightloom.operators.shaping import output_name
from brightloom.sources import sinks

REPORT = "table string, format string, path string, rows long, bytes long, seconds double, rows_per_sec double, mb_per_sec double, error string"


_scratch: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A folder for a session's trial runs in the shared folder of spark.checkpoint.dir; in local mode a temp folder if unset."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _scratch[app] = f"{(base or tempfile.mkdtemp(prefix='brightloom-')).rstrip('/')}/brightloom-runs-{uuid.uuid4().hex}"
    return _scratch[app]


def counted(df: DataFrame, action: Callable[[DataFrame], None]) -> int:
    """Rows that an action has seen, observed on the way, without a second pass."""
    seen = Observation()
    action(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


def run_table(spark: SparkSession, table: str, df: DataFrame, kind: str, folder: str, **options) -> tuple:
    """Writes one table and returns its line of the report; a failure is told there and stops no other table."""
    path, began = output_name(folder, table, kind), time.time()
    try:
        rows = counted(df, lambda x: sinks.write(x, kind, path, **options))
        seconds, size = time.time() - began, sinks.size_of(spark, path)
        return table, kind, path, rows, size, seconds, rows / seconds, size / (1 << 20) / seconds, None
    except Exception as e:
        return table, kind, path, None, None, time.time() - began, None, None, f"{type(e).__name__}: {e}"[:2000]


def write_all(spark: SparkSession, tables: dict[str, DataFrame], kind: str, folder: str, slots: int = 4, rows: dict[str, int] | None = None, **options) -> DataFrame:
    """Writes all tables, up to ``slots`` at a time, those of few expected rows first; returns the report.

    Each slot submits its table's jobs from a thread of its own, so the scheduler fills idle cores of one table's last
    tasks with the next one's. An unknown format is an error before anything is written.
    """
    if slots < 1:
        raise ValueError("there must be a slot at least")
    for t in tables:
        output_name(folder, t, kind)
    order = sorted(tables, key=lambda t: (rows or {}).get(t, 0))
    with ThreadPoolExecutor(slots) as pool:
        lines = list(pool.map(lambda t: run_table(spark, t, tables[t], kind, folder, **options), order))
    return spark.createDataFrame(lines, REPORT)


class Coordinator:
    """Routes batches of several tables to a sink for each, and tells what each has got.

    Files take any number of batches; tables with a snapshot of their own take one.
    """

    def __init__(self, spark: SparkSession, folder: str, kind: str, **options):
        output_name(folder, "any", kind)
        self.spark, self.folder, self.kind, self.options = spark, folder, kind, options
        self.rows: dict[str, int] = {}
        self.seconds: dict[str, float] = {}
        self.done = False

    def start(self, *names: str) -> None:
        """Opens tables; those that are open already stay as they are."""
        for n in names:
            self.rows.setdefault(n, 0)
            self.seconds.setdefault(n, 0.0)

    def write(self, table: str, batch: DataFrame) -> int:
        if self.done or table not in self.rows:
            raise ValueError(f"table {table!r} is not open; open are {sorted(self.rows)}")
        began, path = time.time(), output_name(self.folder, table, self.kind)
        mode = "append" if self.kind in ("parquet", "orc", "csv") and self.rows[table] else "overwrite"
        if mode == "overwrite" and self.rows[table]:
            raise ValueError(f"{self.kind} table {table!r} has been written")
        n = counted(batch, lambda x: sinks.write(x, self.kind, path, mode=mode, **self.options))
        self.rows[table] += n
        self.seconds[table] += time.time() - began
        return n

    def finish(self) -> DataFrame:
        """Closes all tables and returns the report."""
        self.done = True
        lines = []
        for t, n in self.rows.items():
            path, s = output_name(self.folder, t, self.kind), self.seconds[t]
            size = sinks.size_of(self.spark, path) if n else 0
            lines.append((t, self.kind, path, n, size, s, n / s if s else None, size / (1 << 20) / s if s else None, None))
        return self.spark.createDataFrame(lines, REPORT)


def report_text(line) -> str:
    """A report line as the lines of a log, which analytics.METRICS reads."""
    if line["error"]:
        return f"Table: {line['table']}\nFATAL: {line['error']}"
    out = [f"Table: {line['table']}", f"Format: {line['format']}", f"Output file: {line['path']}", f"Rows written: {line['rows']}", f"File size: {line['bytes']} bytes", f"Time elapsed: {line['seconds']:.3f} seconds"]
    if line["rows"]:
        out += [f"Throughput: {line['rows_per_sec']:.0f} rows/sec", f"Write rate: {line['mb_per_sec']:.2f} MB/sec"]
    return "\n".join(out)


class Counters:
    """Named timers and counters of a driver program."""

    def __init__(self):
        self._lock = Lock()
        self.reset()

    def reset(self) -> None:
        with self._lock:
            self.micros: dict[str, int] = {}
            self.calls: dict[str, int] = {}
            self.counts: dict[str, int] = {}

    @contextmanager
    def timer(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.add_time(name, int((time.perf_counter() - began) * 1e6))

    def add_time(self, name: str, micros: int) -> None:
        with self._lock:
            self.micros[name] = self.micros.get(name, 0) + micros
            self.calls[name] = self.calls.get(name, 0) + 1

    def add(self, name: str, value: int = 1) -> None:
        with self._lock:
            self.counts[name] = self.counts.get(name, 0) + value

    def set(self, name: str, value: int) -> None:
        with self._lock:
            self.counts[name] = value

    def report(self) -> tuple[list[tuple[str, float, int, int]], list[tuple[str, int]]]:
        """Timers as (name, milliseconds, calls, mean microseconds), longest first; counters by name."""
        with self._lock:
            timers = sorted(self.micros.items(), key=lambda x: (-x[1], x[0]))
            return [(n, t / 1000, self.calls[n], t // self.calls[n]) for n, t in timers], sorted(self.counts.items())


def timer_report(events: DataFrame, name: str, micros: str) -> DataFrame:
    """The same for a table of timed events: total milliseconds, calls, mean whole microseconds, longest first."""
    out = events.groupBy(F.col(name).alias("name")).agg((F.sum(micros) / 1000).alias("total_ms"), F.count(micros).alias("calls"), F.floor(F.avg(micros)).alias("mean_us"))
    return out.orderBy(F.desc("total_ms"), "name")
