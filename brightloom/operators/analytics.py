"""Reporting on runs: filtered counts, spreads, ranks, pivots, comparisons, text metrics. All are DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of a run's report, as fixed values: what the program prints. Both words for elapsed time are accepted.
METRICS = {
    "rows_written": r"Rows written:\s+([\d,]+)",
    "file_size": r"File size:\s+([\d,]+)",
    "elapsed": r"(?:Time elapsed|Elapsed time):\s+([\d.]+)",
    "throughput": r"Throughput:\s+([\d,.]+)",
    "write_rate": r"Write rate:\s+([\d.]+)",
}
#: Texts by which a failed run is told, in order, as fixed values; the first that is found counts, in any case of letters.
ERRORS = [
    ("crash", "(?i)Segmentation fault|SIGSEGV"),
    ("oom", "(?i)out of memory|ENOMEM|bad_alloc"),
    ("timeout", "(?i)timeout|timed out"),
    ("fatal", "(?i)FATAL|Fatal error"),
]
#: A line of a profile: share, command, shared object, symbol.
HOTSPOT = r"^\s+([\d.]+)%\s+\S+\s+\[([^\]]+)\]\s+(.+)$"


def metric(text: Column, name: str) -> Column:
    """A number from a report; null where it is not found."""
    found = F.regexp_replace(F.regexp_extract(text, METRICS[name], 1), ",", "")
    return F.when(found != "", found).cast("double")


def classify(text: Column, rules: list[tuple[str, str]], other: str | None = "other") -> Column:
    """Label of the first rule whose pattern is found."""
    out = None
    for label, pattern in rules:
        out = F.when(text.rlike(pattern), label) if out is None else out.when(text.rlike(pattern), label)
    return out.otherwise(F.lit(other))


def bucket(value: Column, bounds: list[tuple[float, str]], above: str) -> Column:
    """Label of the first bound that the value lies below."""
    out = None
    for bound, label in bounds:
        out = F.when(value < bound, label) if out is None else out.when(value < bound, label)
    return out.otherwise(above)


def pass_fail(df: DataFrame, by: list[str], ok: Column) -> DataFrame:
    """Counts of all, of passed and of failed rows (a null outcome has failed)."""
    good = F.coalesce(ok, F.lit(False))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(good).alias("passed"), F.count_if(~good).alias("failed"))


def grouped(df: DataFrame, keys: list[str], ok: Column, rate: Column) -> DataFrame:
    """Count, successes, and the whole-number mean of the known rates over all successes, for each key by itself.

    One aggregation over grouping sets, so the table is read and shuffled once for all keys.
    """
    good = F.coalesce(ok, F.lit(False))
    named = df.select(*[F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(keys)], good.alias("_ok"), rate.alias("_rate"))
    by = [F.col(f"_k{i}") for i in range(len(keys))]
    total = F.coalesce(F.sum(F.when(F.col("_ok"), F.col("_rate"))), F.lit(0)).cast("double")
    passed = F.count_if("_ok")
    out = named.groupingSets([[c] for c in by], *by).agg(
        F.grouping_id().alias("_g"),
        F.count("*").alias("n"),
        passed.alias("passed"),
        F.floor(F.when(passed > 0, total / passed).otherwise(0.0)).cast("long").alias("mean_rate"),
    )
    # the bit of a key that takes part is 0, the first key's the highest
    is_key = [F.col("_g").bitwiseAND(F.lit(1 << (len(keys) - 1 - i))) == 0 for i in range(len(keys))]
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for hit, key, c in zip(is_key, keys, by, strict=True):
        name, value = F.when(hit, key).otherwise(name), F.when(hit, c).otherwise(value)
    return out.select(name.alias("dimension"), value.alias("value"), "n", "passed", "mean_rate")


def means_by_sets(df: DataFrame, sets: list[list[str]], values: dict[str, str]) -> DataFrame:
    """Means of values (new name to column) for each set of keys, in one aggregation; keys outside a row's set are null,
    and ``level`` is the set's number."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    out = df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("_g"), *[F.avg(c).alias(n) for n, c in values.items()])
    of = {sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s): n for n, s in enumerate(sets)}
    level = F.lit(None).cast("int")
    for g, n in of.items():
        level = F.when(F.col("_g") == g, n).otherwise(level)
    return out.select(*keys, *values, level.alias("level"))


def spread(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Mean, least, most and relative spread (most - least) / mean * 100 with a stability label."""
    out = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    out = out.withColumn("spread_pct", F.try_divide(F.col("most") - F.col("least"), F.col("mean")) * 100)
    return out.withColumn("stability", bucket(F.col("spread_pct"), [(5, "excellent"), (15, "good"), (30, "fair")], "poor"))


def mean_deviation(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"), F.count(value).alias("n"))


def pivot_max(df: DataFrame, row: str, column: str, labels: list[str], value: str) -> DataFrame:
    """Maxima by row and label, and the mean of each row's maxima."""
    out = df.groupBy(row).pivot(column, labels).agg(F.max(value))
    known = [F.col(f"`{x}`") for x in labels]
    total = sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in known), F.lit(0.0))
    return out.withColumn("mean_of_max", F.try_divide(total, sum((c.isNotNull().cast("int") for c in known), F.lit(0))))


def rank_by(df: DataFrame, value: str, *ties: str) -> DataFrame:
    """Ranks, largest first. For a report's few rows: the ranking is over the whole table."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), *ties)))


def top_per_group(df: DataFrame, by: list[str], value: str, k: int, *ties: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(value), *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sum_by(df: DataFrame, label: Column, value: str) -> DataFrame:
    """Sums by label, largest first."""
    out = df.groupBy(label.alias("category")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.orderBy(F.desc("total"), "category")


def compare(df: DataFrame, keys: str | list[str], side: str, a: str, b: str, value: str) -> DataFrame:
    """A/B in one aggregation, without a self-join: means of both sides, their ratio, and who wins by over 5%."""
    of = lambda x: F.avg(F.when(F.col(side) == x, F.col(value)))
    out = df.groupBy(*([keys] if isinstance(keys, str) else keys)).agg(of(a).alias("a"), of(b).alias("b")).withColumn("ratio", F.try_divide("a", "b"))
    return out.withColumn("verdict", F.when(F.col("ratio") > 1.05, "wins").when(F.col("ratio") < 0.95, "loses").when(F.col("ratio").isNotNull(), "even"))


def summarise(compared: DataFrame, by: list[str]) -> DataFrame:
    """Of compare(): pairs that have both sides above 0, mean ratio, and how often either side is the greater (a tie is b's)."""
    both = compared.where("a > 0 and b > 0")
    return both.groupBy(*by).agg(F.count("*").alias("pairs"), F.avg("ratio").alias("mean_ratio"), F.count_if(F.col("a") > F.col("b")).alias("a_wins"), F.count_if(F.col("a") <= F.col("b")).alias("b_wins"))


def cross_tab(df: DataFrame, rows: list[str], column: str, labels: list[str], values: list[str]) -> DataFrame:
    """Last-level cells of a report: for each row and label the maxima of the values, as columns <label>_<value>."""
    cells = [F.max(F.when(F.col(column) == x, F.col(v))).alias(f"{x}_{v}") for x in labels for v in values]
    return df.groupBy(*rows).agg(*cells)


def vs_baseline(df: DataFrame, by: list[str], mode: str, baseline: str, value: str) -> DataFrame:
    """Mean and sample deviation of each mode, and its mean against the baseline mode's of the same group.

    The baseline is a window over the aggregated rows, a few for each group.
    """
    out = df.groupBy(*by, mode).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"), F.count(value).alias("n"))
    base = F.max(F.when(F.col(mode) == baseline, F.col("mean"))).over(Window.partitionBy(*by))
    return out.withColumn("speedup", F.try_divide("mean", base))


def derived_rate(rows: Column, seconds: Column) -> Column:
    """Rows a second; 0 where no time passed or it is not known."""
    return F.when(seconds > 0, rows / seconds).otherwise(0.0)


def batch_metrics(rows: int, size: Column) -> dict[str, Column]:
    """Batches of a run of so many rows, and the estimated share of encoding: 22 % at 600 batches, 0.015 % for each more,
    from 18 to 30 (fixed values)."""
    n = F.floor(F.lit(rows) / size).cast("long")
    return {"batches": n, "encoding_pct": F.greatest(F.least(22.0 + (n - 600) * 0.015, F.lit(30.0)), F.lit(18.0))}


def run_name(path: Column) -> dict[str, Column]:
    """Format, table and mode of a log's file name: the first part, those between, and the last; null of fewer than three."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    parts = F.split(stem, "_")
    ok = F.size(parts) >= 3
    middle = F.when(ok, F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), "_"))
    return {"format": F.when(ok, parts[0]), "table": middle, "mode": F.when(ok, F.element_at(parts, -1))}


def hotspots(lines: DataFrame, line: str, rules: list[tuple[str, str]], least: float = 0.5) -> DataFrame:
    """Profile lines to (percentage, dso, symbol, category); lines of another form, or below ``least`` per cent, go."""
    part = lambda i: F.regexp_extract(F.col(line), HOTSPOT, i)
    found = lines.where(F.col(line).rlike(HOTSPOT)).select(part(1).cast("double").alias("percentage"), part(2).alias("dso"), F.trim(part(3)).alias("symbol"))
    found = found.where(F.col("percentage") >= least)
    return found.withColumn("category", classify(F.concat_ws(" ", "dso", "symbol"), [(x, f"(?i){p}") for x, p in rules]))


def records(lines: DataFrame, line: str, names: list[str]) -> DataFrame:
    """Comma-separated records to columns of text; missing fields are null, the last one keeps what is left."""
    parts = F.split(F.col(line), ",", len(names))
    return lines.select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def whole_mean(text: Column) -> Column:
    """Whole-number mean of the first words that are whole numbers; the others, with or without a unit, are passed over."""
    first = F.regexp_extract(text, r"^([0-9]+)(?: .*)?$", 1)
    number = F.when(first != "", first).cast("long")
    return F.floor(F.sum(number) / F.count(number)).cast("long")


def last_match(lines: DataFrame, by: list[str], order: str, line: str, contains: str) -> DataFrame:
    """The last field of each log's last line that holds the text; logs without one are not there."""
    found = lines.where(F.col(line).contains(contains)).groupBy(*by).agg(F.max_by(line, order).alias("_l"))
    return found.select(*by, F.element_at(F.split(F.trim("_l"), r"\s+"), -1).alias("last"))


def above(text: Column, bound: float) -> Column:
    """Whether the digits of a text are a number above the bound; null where there are none."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(digits != "", digits.cast("double") > bound)


def matching_lines(lines: DataFrame, line: str, texts: list[str]) -> DataFrame:
    """Lines that hold any of the texts."""
    any_of = None
    for t in texts:
        any_of = F.col(line).contains(t) if any_of is None else any_of | F.col(line).contains(t)
    return lines.where(any_of)


def speedup_vs_first(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Each row's value against that of its group's first row, which an aggregation finds: no group is in one task."""
    first = df.groupBy(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)]).agg(F.min_by(value, order).alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)]
    return df.join(first, same, "left").withColumn("speedup", F.try_divide(F.col(value), F.col("_first"))).drop("_first", *[f"_b{i}" for i in range(len(by))])


def weighted_rate(df: DataFrame, by: list[str], rows: Column, seconds: Column) -> DataFrame:
    """Sum of rows over sum of seconds; null where no time passed."""
    return df.groupBy(*by).agg(F.try_divide(F.sum(rows).cast("double"), F.sum(seconds)).alias("rate"))


def extremes(df: DataFrame, by: list[str], label: str, value: str) -> DataFrame:
    """Labels of the least and the greatest value; ties go to the smaller label."""
    least = F.min(F.struct(F.col(value), F.col(label)))[label]
    most = F.min(F.struct((-F.col(value)).alias("v"), F.col(label)))[label]
    return df.groupBy(*by).agg(least.alias("argmin"), most.alias("argmax"))


def gate(df: DataFrame, value: str, name: str, contains: str, baseline: float, share: float = 0.95) -> DataFrame:
    """Best value among rows whose name contains the text, against a share of the baseline."""
    best = df.where(F.col(name).contains(contains)).agg(F.max(value).alias("best"))
    return best.withColumn("needed", F.lit(baseline * share)).withColumn("passed", F.coalesce(F.col("best") >= F.col("needed"), F.lit(False)))


def human(value: Column) -> Column:
    """1234567 as 1.2M, 1234 as 1.2K."""
    return F.when(value >= 1e6, F.concat(F.format_string("%.1f", value / 1e6), F.lit("M"))).when(value >= 1e3, F.concat(F.format_string("%.1f", value / 1e3), F.lit("K"))).otherwise(F.format_string("%.0f", value))


def human_bytes(value: Column) -> Column:
    """Bytes with a unit from B to TB, steps of 1024, one digit; N/A where unknown."""
    out = F.when(value.isNull(), "N/A")
    for i, unit in enumerate(("B", "KB", "MB", "GB")):
        out = out.when(value < 1024.0 ** (i + 1), F.concat(F.format_string("%.1f", value / 1024.0**i), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.1f", value / 1024.0**4), F.lit(" TB")))


def human_millis(value: Column) -> Column:
    """Milliseconds below 1000, else seconds with one digit; N/A where unknown."""
    return F.when(value.isNull(), "N/A").when(value < 1000, F.concat(value.cast("string"), F.lit(" ms"))).otherwise(F.concat(F.format_string("%.1f", value / 1000.0), F.lit(" sec")))


def thousands(value: Column) -> Column:
    """Whole numbers in groups of three; N/A where unknown."""
    return F.when(value.isNull(), "N/A").otherwise(F.format_number(value, 0))


def clamp(value: Column, least: int, most: int) -> Column:
    return F.least(F.greatest(value, F.lit(least)), F.lit(most))


def positive_mean(value: Column) -> Column:
    return F.avg(F.when(value > 0, value))
