"""Mixing sources to target weights along a time-varying curriculum, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.llm.common import materialize, need, word_count

#: Items that one (source, bucket) holds on average; a window never spans more than one bucket.
ITEMS_PER_BUCKET = 20_000
#: Sources up to which the table of sources is broadcast (about 200 bytes each); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 5_000
CAP = 3
#: Documents at the end of a source's last pass that are passed over as too long before the best fit is looked for.
SKIPS = 3


def cyclic_schedule(rank: Column, cycle: int = 3) -> Column:
    """The default curriculum: weights 1, 2, 3, repeating, in the order of ``rank`` (from 0).

    The schedule of a source is linear in training time t from 0 to 1. Sources of weight 1 come in late (half the weight
    at first, one and a half at the end), those of the largest weight fade out, the others are constant. The integral
    over t is the weight itself.
    """
    w = (F.pmod(rank, F.lit(cycle)) + 1).cast("double")
    tilt = F.when(w == 1, 0.5).when(w == cycle, -0.5).otherwise(0.0)
    knot = lambda t, x: F.struct(F.lit(t).alias("t"), x.alias("w"))
    return F.array(knot(0.0, w * (1 - tilt)), knot(1.0, w * (1 + tilt)))


def _segments(knots: Column) -> Column:
    """Linear pieces (t0, h, w0, slope, a0) of a schedule; a0: the integral before the piece."""
    k = F.array_sort(knots)
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(k) - 1),
        lambda i: F.struct(
            F.get(k, i - 1)["t"].alias("t0"),
            (F.get(k, i)["t"] - F.get(k, i - 1)["t"]).alias("h"),
            F.get(k, i - 1)["w"].alias("w0"),
            (F.get(k, i)["w"] - F.get(k, i - 1)["w"]).alias("rise"),
            ((F.get(k, i)["w"] + F.get(k, i - 1)["w"]) / 2 * (F.get(k, i)["t"] - F.get(k, i - 1)["t"])).alias("area"),
        ),
    )
    return pieces


def _invert(pieces: Column, total: Column, share: Column) -> Column:
    """The time at which the given share of the schedule's integral is reached."""
    want = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * total
    start = F.struct(F.lit(0.0).alias("done"), F.lit(None).cast("double").alias("t"))

    def step(acc: Column, p: Column) -> Column:
        left = want - acc["done"]
        inside = acc["t"].isNull() & (left <= p["area"]) & (p["h"] > 0)
        slope = F.try_divide(p["rise"], p["h"])
        root = F.sqrt(F.greatest(p["w0"] * p["w0"] + 2 * slope * left, F.lit(0.0)))
        x = F.coalesce(F.try_divide(2 * left, p["w0"] + root), F.lit(0.0))
        return F.struct((acc["done"] + p["area"]).alias("done"), F.when(inside, p["t0"] + F.least(x, p["h"])).otherwise(acc["t"]).alias("t"))

    return F.coalesce(F.aggregate(pieces, start, step)["t"], F.lit(1.0))


def targets(sizes: DataFrame, schedule=cyclic_schedule, cap: float = CAP) -> DataFrame:
    """Targets of the sources in sizes (source, source_size): adds weight, pieces and target.

    The sources share the sum of all sizes by the integrals of their schedules. A target stops at ``cap`` times its
    source's size; the excess is shared again, by weight, until none is above. With sources ordered by cap/weight the
    capped ones come first, so one running sum finds the level. One row for each source: a directory, not data.
    """
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("pieces", _segments(schedule(F.col("rank"))))
    ranked = ranked.withColumn("weight", F.aggregate("pieces", F.lit(0.0), lambda a, p: a + p["area"]))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.try_divide(F.col("most"), F.col("weight")))
    level = F.try_divide(
        F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)),
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    )
    level = ranked.withColumn("level", level)
    level = level.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("level")))).over(everything)["level"])
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return level.select("source", "source_size", "weight", "pieces", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"))


def mix_plan(docs: DataFrame, schedule=cyclic_schedule, cap: float = CAP, seed: str = "mix") -> DataFrame:
    """How often the mix takes each document, and when.

    docs: doc_id, text, source; other columns are ignored. Returns a row for each distinct (doc_id, source, text):
    doc_id, source, text_hash long, n_rows long (equal rows), size long, source_size long, target double, copies long,
    positions array<double> (training time from 0 to 1 of each copy).

    A source's documents stand in an order drawn by hash. Whole passes over it are taken as often as they fit in the
    target, then a beginning of one more pass, in which SKIPS documents too long for what is left are passed over, then
    the one document that comes nearest to what is left, if it brings the sum nearer. Documents are taken whole. A copy's
    position is the time at which the source's schedule has demanded the words that the mix takes before it. Null and blank texts have size 0; a null source is a source of its own, last in order;
    null ids are ordinary. An empty table gives an empty plan. Equal rows are taken together, so reruns agree.

    Running sums go over (source, bucket) and bucket sums are added, so a source of any size spreads over all tasks.
    """
    need(docs, doc_id="long", text="string", source="string")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_hash"))
    items = rows.groupBy("doc_id", "source", "text_hash").agg(F.count("*").alias("n_rows"), F.max("size").alias("size"))
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_hash"))
    items = items.withColumn("u", F.conv(F.substring(draw, 1, 15), 16, 10).cast("long")).withColumn("words", F.col("n_rows") * F.col("size"))
    items = materialize(items, "mix-items")
    buckets = max(16, items.count() // ITEMS_PER_BUCKET)
    items = items.withColumn("bucket", (F.col("u") / F.lit(float(1 << 60)) * buckets).cast("int"))

    sums = items.groupBy("source", "bucket").agg(F.sum("words").alias("words"))
    sums = materialize(sums, "mix-sums")
    sources = materialize(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), schedule, cap), "mix-sources")
    n_sources = sources.count()
    small = (lambda df: F.broadcast(df)) if n_sources <= BROADCAST_SOURCES else (lambda df: df)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), F.coalesce(F.sum("words").over(run), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "bucket").orderBy("u", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = items.withColumn("inner", F.coalesce(F.sum("words").over(within), F.lit(0)))
    placed = placed.join(offsets, (F.col("bucket") == F.col("o_bucket")) & F.col("source").eqNullSafe(F.col("o_source")))
    placed = placed.select("doc_id", "source", "text_hash", "n_rows", "size", "words", "u", (F.col("offset") + F.col("inner")).alias("before"))
    placed = placed.withColumn("start", F.col("before"))  # in whole passes no document is passed over
    s = sources.withColumnRenamed("source", "s_source")
    placed = placed.join(small(s), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    passes = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    placed = placed.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    placed = placed.withColumn("more", (F.col("before") + F.col("words") <= F.col("rest")) & (F.col("words") > 0)).withColumn("skipped", F.lit(False))
    order = F.struct("u", "doc_id", "text_hash")
    for _ in range(SKIPS):  # the first document that does not fit is passed over, and those after it move up
        placed = materialize(placed, "mix-placed")
        over = placed.where("not more and not skipped and words > 0").groupBy(F.col("source").alias("x_source"))
        over = over.agg(F.min(order).alias("x"), F.min_by("words", order).alias("x_words"))
        placed = placed.join(small(over), F.col("source").eqNullSafe(F.col("x_source")), "left")
        after = F.coalesce(order > F.col("x"), F.lit(False))
        at = F.coalesce(order.eqNullSafe(F.col("x")), F.lit(False))
        placed = placed.withColumn("before", F.when(after, F.col("before") - F.col("x_words")).otherwise(F.col("before"))).withColumn("skipped", F.col("skipped") | at)
        placed = placed.withColumn("more", F.col("more") | (after & ~F.col("skipped") & (F.col("words") > 0) & (F.col("before") + F.col("words") <= F.col("rest")))).drop("x", "x_words", "x_source")
    placed = materialize(placed, "mix-placed")

    left = placed.groupBy("source").agg((F.max("rest") - F.coalesce(F.sum(F.when(F.col("more"), F.col("words"))), F.lit(0))).alias("left"))
    left = left.withColumnRenamed("source", "l_source")
    fit = placed.where("not more and words > 0").join(small(left), F.col("source").eqNullSafe(F.col("l_source"))).where("words < 2 * left")
    fit = fit.groupBy(F.col("source").alias("f_source")).agg(F.min(F.struct(F.abs(F.col("words") - F.col("left")).alias("d"), "u", "doc_id", "text_hash")).alias("fit"), F.max("left").alias("left"))
    plan = placed.join(small(fit), F.col("source").eqNullSafe(F.col("f_source")), "left")
    chosen = F.coalesce((F.col("fit.u") == F.col("u")) & F.col("fit.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("fit.text_hash") == F.col("text_hash")), F.lit(False))
    plan = plan.withColumn("copies", F.col("passes") + (F.col("more") | chosen).cast("long"))
    last = F.when(chosen, F.col("rest") - F.col("left")).otherwise(F.col("before"))
    share = lambda i: F.coalesce(F.try_divide(i * F.col("source_size") + F.when(i < F.col("passes"), F.col("start")).otherwise(last), F.col("target")), F.lit(0.0))
    when = F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda i: _invert(F.col("pieces"), F.col("weight"), share(i)))
    plan = plan.withColumn("positions", F.when(F.col("copies") > 0, when).otherwise(F.array().cast("array<double>")))
    return plan.select("doc_id", "source", "text_hash", "n_rows", "size", "source_size", "target", "copies", "positions")


def mix(docs: DataFrame, schedule=cyclic_schedule, cap: float = CAP, seed: str = "mix") -> DataFrame:
    """The training sequence: docs with every taken copy of every document, range-sorted by position, and where positions
    are equal by source, doc_id and text, so that reruns agree.

    Adds ``position``, or ``mix_position`` where the table already has a column of that name.
    """
    name = "position" if "position" not in docs.columns else "mix_position"
    plan = mix_plan(docs, schedule, cap, seed).where("copies > 0")
    plan = plan.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("text_hash").alias("_h"), F.col("positions").alias("_p"))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*names.values())
    of = lambda c: F.col(names[c])
    key = F.md5(F.coalesce(of("text"), F.lit("")).cast("binary"))
    joined = rows.join(plan, of("doc_id").eqNullSafe(F.col("_d")) & of("source").eqNullSafe(F.col("_s")) & (key == F.col("_h")))
    placed = joined.select(*names.values(), F.explode("_p").alias("_at"), key.alias("_key"))
    return placed.sort("_at", of("source"), of("doc_id"), "_key").drop("_key").toDF(*names, name)


def op1_mix(spark, sf_dir: str) -> DataFrame:
    """The digest of the mix of all documents; each row of documents has its row, in the order of first positions.

    copies: how often the mix has the document; first_position: the training time of the first copy, null of none.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = mix_plan(docs).withColumn("first_position", F.round(F.try_element_at("positions", F.lit(1)), 9))
    plan = plan.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    plan = plan.sort(F.asc_nulls_last("first_position"), "source", "doc_id", "text_hash")
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "first_position")
