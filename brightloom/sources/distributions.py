"""Weighted distributions: parsing BEGIN ... END blocks of token|weight, prefix sums, weighted picks."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightloom.sources.tpch import NATIONS


def parse(lines: DataFrame) -> DataFrame:
    """Rows (pos long, value string) of a distribution file to (dist, pos int, token, weight int, cum_weight long).

    Comments and counts are passed over. A file is small; its blocks are told apart by a running count of openings.
    """
    line = F.trim("value")
    in_order = Window.orderBy("pos")
    opens = F.lower(line).rlike("^begin\\s")
    rows = lines.withColumn("line", line).where("line <> '' and line not like '#%'").withColumn("block", F.sum(opens.cast("int")).over(in_order))
    names = rows.where(F.lower("line").rlike("^begin\\s")).select(F.col("block").alias("b"), F.lower(F.regexp_extract("line", r"^\S+\s+(\S+)", 1)).alias("dist"))
    rows = rows.where(F.col("line").contains("|") & ~F.lower("line").startswith("count")).join(names, F.col("block") == F.col("b"))
    rows = rows.select("dist", "pos", F.substring_index("line", "|", 1).alias("token"), F.substring_index("line", "|", -1).cast("int").alias("weight"))
    return prefix_sums(rows.withColumn("pos", (F.row_number().over(Window.partitionBy("dist").orderBy("pos")) - 1).cast("int")))


#: Distributions that the generators know, with the names of their sets: fixed values.
SETS = {
    "p_cntr": "p_cntr_set",
    "colors": "colors",
    "p_types": "p_types_set",
    "nations": "nations",
    "nations2": "nations2",
    "regions": "regions",
    "o_oprio": "o_priority_set",
    "instruct": "l_instruct_set",
    "smode": "l_smode_set",
    "category": "l_category_set",
    "rflag": "l_rflag_set",
    "msegmnt": "c_mseg_set",
    "adverbs": "adverbs",
    "articles": "articles",
    "prepositions": "prepositions",
    "auxillaries": "auxillaries",
    "terminators": "terminators",
    "adjectives": "adjectives",
    "grammar": "grammar",
    "np": "np",
    "vp": "vp",
}


def known_sets(dist: DataFrame) -> DataFrame:
    """Rows of the distributions that have a set, with its name."""
    names = dist.sparkSession.createDataFrame(list(SETS.items()), "s_dist string, set_name string")
    return dist.join(F.broadcast(names), F.col("dist") == F.col("s_dist")).drop("s_dist")


#: Bytes of a name in the binary index, and numbers behind it: index, offset, string bytes, rows, weights, values, name bytes.
NAME_BYTES, NUMBERS = 20, 7


def text_at(pool: bytes, offset: int) -> str:
    """The text at an offset of a string pool, up to its closing zero or the pool's end."""
    end = pool.find(b"\0", offset)
    return pool[offset : len(pool) if end < 0 else end].decode("ascii", "replace")


def parse_index(data: bytes) -> list[dict]:
    """Distributions of a binary index (big-endian): name, type vector, and the rows' weights and values.

    The file opens with the number of entries and ends with their table; an entry tells where its block lies: types,
    weight sets, value sets (offsets in the string pool), names, strings. A file that is cut short is an error.
    """
    width = NAME_BYTES + 4 * NUMBERS
    try:
        (n,) = struct.unpack_from(">i", data, 0)
        out = []
        for at in range(len(data) - n * width, len(data), width):
            _, offset, strings, rows, weights, values, names = struct.unpack_from(f">{NUMBERS}i", data, at + NAME_BYTES)
            numbers = struct.unpack_from(f">{values + (weights + values) * rows}i", data, offset)
            sets = [numbers[values + i * rows : values + (i + 1) * rows] for i in range(weights + values)]
            pool_at = offset + 4 * len(numbers) + names
            pool = data[pool_at : pool_at + strings]
            if len(pool) < strings:
                raise ValueError("the string pool is cut short")
            out.append({
                "name": text_at(data[at : at + NAME_BYTES], 0),
                "types": list(numbers[:values]),
                "weights": [list(s) for s in sets[:weights]],
                "values": [[text_at(pool, x) for x in s] for s in sets[weights:]],
            })
    except struct.error as e:
        raise ValueError(f"not a distribution index: {e}") from e
    return out


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows (dist, pos, weights array<int>, values array<string>) of a binary index file, which is small."""
    (found,) = spark.read.format("binaryFile").load(path).select("content").collect()
    rows = []
    for d in parse_index(bytes(found["content"])):
        n = len((d["values"] or d["weights"] or [[]])[0])
        rows += [(d["name"], i, [w[i] for w in d["weights"]], [v[i] for v in d["values"]]) for i in range(n)]
    return spark.createDataFrame(rows, "dist string, pos int, weights array<int>, values array<string>")


def decimal_parts(text: Column) -> Column:
    """A decimal's text as struct(flags 0, precision: digits behind the point, scale: characters before it, number: all
    digits as one whole number with its sign)."""
    t = F.trim(text)
    parts = F.split(t, r"\.", 2)
    before, behind = parts[0], F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    digits = F.concat(F.regexp_replace(before, "[+-]", ""), behind)
    number = F.when(digits == "", F.lit(0)).otherwise(digits.cast("long")) * F.when(t.startswith("-"), -1).otherwise(1)
    return F.struct(F.lit(0).alias("flags"), F.length(behind).alias("precision"), F.length(before).alias("scale"), number.cast("long").alias("number"))


def read(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path).coalesce(1)
    return parse(text.select(F.monotonically_increasing_id().alias("pos"), "value"))


def prefix_sums(dist: DataFrame) -> DataFrame:
    return dist.withColumn("cum_weight", F.sum("weight").over(Window.partitionBy("dist").orderBy("pos")))


def nation_regions(spark: SparkSession) -> DataFrame:
    """Nations, whose weights are steps: their running sum is the region key."""
    steps = spark.createDataFrame([("nations", i, n, s) for i, (n, s) in enumerate(NATIONS.items())], "dist string, pos int, token string, weight int")
    return prefix_sums(steps).select("pos", F.col("token").alias("nation"), F.col("cum_weight").alias("regionkey"))


def pick(values: list[tuple[str, int]], draw: Column) -> Column:
    """The first token whose cumulative weight is at least the draw's place in 1 .. total."""
    total, out, cum = sum(w for _, w in values), None, 0
    at = F.pmod(draw, F.lit(total)) + 1
    for token, weight in values:
        cum += weight
        out = F.when(at <= cum, token) if out is None else out.when(at <= cum, token)
    return out
