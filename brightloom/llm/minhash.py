"""MinHash near-dedup with SetSketch registers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import Words, components, grams, map_arrow, materialize, mix64, need, slices

SHINGLE = 5
THRESHOLD = 80
#: Registers of a sketch; ROWS of them form a band. A pair at the threshold of 0.8 shares none of the 24 bands with a
#: probability of 3e-6.
REGISTERS, ROWS = 96, 4
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: A pair that is less likely at this much under the threshold than below that (six standard errors) is not verified: a
#: pair at the threshold is lost with a probability of 1e-8.
MARGIN = 0.24
#: Members, and shingles of all members, of a chunk; a task compares a chunk or two. A family of more is dealt out.
CHUNK, CHUNK_SHINGLES = 1_000, 2_000_000
#: Families of up to a chunk share tasks, of about so many members, and of CHUNK_SHINGLES.
PACK = 2_000
#: Bits of the filter by which the second reading passes over documents that meet no other.
FILTER_BITS = 23
_SEEDS = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(least: np.ndarray) -> np.ndarray:
    """Register values from the least uniform 64-bit hash of each register: floor(1 - log_b x) of the least exponential.

    -log(1 - u) / RATE rises with u, so the least hash has the least exponential; values are cut to 0 .. TOP + 1.
    Sketches merge by the larger of each two registers. An empty set has zeros.
    """
    u = (least >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
    x = -np.log1p(-u) / RATE
    return np.clip(np.floor(1.0 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def _sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted within the text, and the texts' offsets; fewer than k words are one shingle."""
    g, ok = grams(w.hash, k), w.whole(k)
    n, doc = np.diff(w.range), w.of_doc()
    value, owner = g[ok], doc[: len(g)][ok]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        one = [int(xxhash.xxh3_64_intdigest(w.hash[w.range[i] : w.range[i + 1]].tobytes(), seed=k)) for i in few]
        value, owner = np.append(value, np.array(one, np.uint64)), np.append(owner, few)
    by = np.lexsort((value, owner))
    value, owner = value[by], owner[by]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(n) + 1))


def _sketch(k: int):
    """Rows (id, text, ...) to (id, ..., size, class, registers, shingles)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                value, off = _sets(Words(part.column(1), lower=True), k)
                sizes = np.diff(off)
                least = np.zeros((len(sizes), REGISTERS), np.uint64)
                some = np.flatnonzero(sizes)
                if len(some):
                    for j, a in enumerate(_SEEDS):
                        least[some, j] = np.minimum.reduceat(value * a, off[some])
                regs = np.where(sizes[:, None] > 0, registers(least), np.uint16(0))
                key = [xxhash.xxh3_128_digest(value[a:z].tobytes()) for a, z in zip(off[:-1], off[1:], strict=True)]
                key = np.frombuffer(b"".join(key), "<i8").reshape(-1, 2)
                out = [pa.array(sizes.astype(np.int64)), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array([r.tobytes() for r in regs], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], *out], names=["_id", *part.schema.names[2:], "_size", "_k1", "_k2", "_regs"])

    return f


def _bands():
    """Classes (cid, size, regs) to (band, cid, size)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                regs = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(b.num_rows, REGISTERS // ROWS, ROWS)
                v = np.ascontiguousarray(regs).view(np.uint64).reshape(b.num_rows, -1)
                band = mix64(v + mix64(np.arange(1, v.shape[1] + 1, dtype=np.uint64))[None, :])
                each = [np.repeat(b.column(i).to_numpy(), v.shape[1]) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(band.ravel().view(np.int64)), *map(pa.array, each)], names=["band", "cid", "size"])

    return f


def _shingles(k: int, shared):
    """Documents (id, text) that the filter passes, to their classes and shingle sets."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint64)
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            slot = (mix64(ids.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            hit = ((bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            b = b.filter(pa.array(hit & b.column(0).is_valid().to_numpy(zero_copy_only=False)))
            for part in slices(b, 1):
                value, off = _sets(Words(part.column(1), lower=True), k)
                sets = [value[a:z].tobytes() for a, z in zip(off[:-1], off[1:], strict=True)]
                key = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in sets]), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(sets, pa.binary())], names=["id", "k1", "k2", "shingles"])

    return f


def _slot_of():
    """Ids to (word, mask) of the filter."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = (mix64(b.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array((np.uint64(1) << (slot & 63).astype(np.uint64)).view(np.int64))], names=["word", "mask"])

    return f


def _id_filter(ids: DataFrame):
    words = map_arrow(ids, _slot_of(), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[words["word"].to_numpy()] = words["mask"].to_numpy()
    return ids.sparkSession.sparkContext.broadcast(bits.tobytes())


def reaches(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, floor: float) -> np.ndarray:
    """Whether the likeliest similarity is at least ``floor``, from the registers above and below.

    The log likelihood has one summit, so the summit lies at floor or above it where the likelihood rises at floor. It
    can't lie above the ratio of the sizes, which the caller has checked.
    """
    u = n_a / np.maximum(n_a + n_b, 1)
    v = 1.0 - u
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1.0) * (BASE - 1) / BASE) / np.log(BASE)

    def log_like(j: float) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + (REGISTERS - more - less) * np.log(np.maximum(1 - up - down, 1e-9))

    return log_like(floor) >= log_like(floor - 1e-3)


def overlaps(sets: list[np.ndarray], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets u and v (sorted, distinct): one by one, or all at once as a product of matrices."""
    left, right = np.unique(u), np.unique(v)
    used = np.union1d(left, right)
    value = np.concatenate([sets[i] for i in used])
    if len(u) * 12e-6 + sum(len(sets[i]) for i in u[:100].tolist()) * len(u) / min(len(u), 100) * 4e-8 < len(value) * 2e-7:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(u.tolist(), v.tolist(), strict=True)])
    owner = np.repeat(used, [len(sets[i]) for i in used])
    _, number, times = np.unique(value, return_inverse=True, return_counts=True)
    shared = times > 1  # the others are in no intersection
    column, kept = (np.cumsum(shared) - 1)[number], shared[number]
    column, owner = column[kept], owner[kept]
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    row_l, row_r = np.searchsorted(left, owner), np.searchsorted(right, owner)
    in_l, in_r = left[np.minimum(row_l, len(left) - 1)] == owner, right[np.minimum(row_r, len(right) - 1)] == owner
    both = np.zeros((len(left), len(right)), np.float32)  # counts below 2^24 are exact
    cuts = np.searchsorted(column, np.arange(0, int(shared.sum()) + 2048, 2048))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi > lo:
            x, y = np.zeros((len(left), 2048), np.float32), np.zeros((len(right), 2048), np.float32)
            m = np.arange(lo, hi)
            x[row_l[m[in_l[m]]], column[m[in_l[m]]] % 2048] = 1
            y[row_r[m[in_r[m]]], column[m[in_r[m]]] % 2048] = 1
            both += x @ y.T
    return both[np.searchsorted(left, u), np.searchsorted(right, v)].astype(np.int64)


def link_group(regs: np.ndarray, sets: list[np.ndarray], own: np.ndarray, threshold: int) -> np.ndarray:
    """For each member the first that it reaches by links: all pairs count, or those across, if own has two values."""
    n, floor = len(sets), threshold / 100 - MARGIN
    size = np.array([len(s) for s in sets])
    first = own.min()
    across = bool((own != first).any())
    left = np.flatnonzero(own == first) if across else np.arange(n)
    right = np.flatnonzero(own != first) if across else np.arange(n)
    found = [], []
    for lo in range(0, len(left), 64):
        i = left[lo : lo + 64]
        small, large = np.minimum.outer(size[i], size[right]), np.maximum.outer(size[i], size[right])
        fits = small * 100 >= threshold * large
        if not across:
            fits &= right[None, :] > i[:, None]
        x, y = np.nonzero(fits)
        x, y = i[x], right[y]
        for at in range(0, len(x), 50_000):
            a, b = x[at : at + 50_000], y[at : at + 50_000]
            ok = reaches((regs[a] > regs[b]).sum(1), (regs[a] < regs[b]).sum(1), size[a], size[b], floor)
            found[0].append(a[ok])
            found[1].append(b[ok])
    label = np.arange(n)
    u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in found)
    if not len(u):
        return label
    both = overlaps(sets, u, v)
    ok = both * 100 >= threshold * (size[u] + size[v] - both)
    u, v = u[ok], v[ok]
    while True:
        low = np.minimum(label[u], label[v])
        if (label[u] == label[v]).all():
            return label
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while (label[label] != label).any():
            label = label[label]


def _verify(threshold: int):
    """A task's families, or two chunks of one, to edges (fam, u, v)."""

    def f(table: pa.Table, loaded: pa.Table) -> pa.Table:
        fam, cid, own = (table[c].to_numpy() for c in ("fam", "cid", "own"))
        by = np.lexsort((cid, fam))
        fam, cid, own = fam[by], cid[by], own[by]
        cuts = np.append(np.flatnonzero(np.diff(fam, prepend=fam[0] - 1)), len(fam))
        ids = loaded["l_id"].to_numpy()
        ids, place = np.unique(ids, return_index=True)  # rows of one id and set count once
        shingles, regs = loaded["shingles"], loaded["regs"]
        out: tuple[list, list, list] = ([], [], [])
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            at = place[np.searchsorted(ids, cid[x:y])].tolist()
            sets = [np.frombuffer(shingles[i].as_py(), np.uint64) for i in at]
            r = np.frombuffer(b"".join([regs[i].as_py() for i in at]), np.uint16).reshape(-1, REGISTERS)
            label = link_group(r, sets, own[x:y], threshold)
            joined = np.flatnonzero(label != np.arange(len(label)))
            out[0].append(np.full(len(joined), fam[x]))
            out[1].append(cid[x:y][joined])
            out[2].append(cid[x:y][label[joined]])
        each = [np.concatenate(o) if o else np.empty(0, np.int64) for o in out]
        return pa.table({c: pa.array(o, pa.int64()) for c, o in zip(("fam", "u", "v"), each, strict=True)})

    return f


def _chunks(members: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(members / CHUNK), F.ceil(shingles / CHUNK_SHINGLES)).cast("int")


def _dealt(cid: Column, chunks: Column) -> Column:
    return F.pmod(F.xxhash64(cid, F.lit(5)), F.greatest(chunks, F.lit(1))).cast("int")


def _compare(docs: DataFrame, classes: DataFrame, tasks: DataFrame, shingle: int, threshold: int, tag: str) -> DataFrame:
    """Edges (fam, u, v) of tasks (task, fam, cid, own): each class's set is read again and sent once to each of its tasks."""
    wanted = tasks.groupBy(F.col("cid").alias("w_cid")).agg(F.collect_set("task").alias("tasks"))
    wanted = classes.join(wanted, F.col("cid") == F.col("w_cid")).select("_k1", "_k2", "cid", "regs", "tasks", F.col("rep._id").alias("rep"))
    wanted = materialize(wanted, f"near-wanted-{tag}")
    shared = _id_filter(wanted.select("rep"))
    sets = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _shingles(shingle, shared), "id long, k1 long, k2 long, shingles binary")
    sets = sets.join(wanted, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & (F.col("id") == F.col("rep")))
    loaded = sets.select(F.explode("tasks").alias("l_task"), F.col("cid").alias("l_id"), "regs", "shingles")
    edges = tasks.groupBy("task").cogroup(loaded.groupBy("l_task")).applyInArrow(_verify(threshold), "fam long, u long, v long")
    return materialize(edges, f"near-edges-{tag}")


def _links(docs: DataFrame, classes: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """Edges (u, v) that join all linked classes."""
    banded = materialize(map_arrow(classes.select("cid", "size", "regs"), _bands(), "band long, cid long, size long"), "near-bands")
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("cid").alias("least")).where("n > 1").select(F.col("band").alias("b_band"), "least")
    members = banded.join(buckets, F.col("band") == F.col("b_band")).select("least", "cid", "size").distinct()
    members = materialize(members, "near-families")
    families = members.groupBy(F.col("least").alias("f")).agg(_chunks(F.count("*"), F.sum("size")).alias("chunks"))
    members = materialize(members.join(families, F.col("least") == F.col("f")).drop("f"), "near-members")
    few = F.col("chunks") <= 1
    n, weight, large = members.agg(F.count(F.when(few, 1)), F.sum(F.when(few, F.col("size"))), F.max("chunks")).first()
    packs = max(8, n // PACK, (weight or 0) // CHUNK_SHINGLES)
    key = lambda *x: F.lit(packs) + F.pmod(F.xxhash64(*x), F.lit(1 << 60))
    small = members.where(few).select(F.pmod(F.xxhash64("least"), F.lit(packs)).alias("task"), F.col("least").alias("fam"), "cid", F.lit(0).alias("own"))
    if (large or 1) <= 1:
        return _compare(docs, classes, small, shingle, threshold, "all").select("u", "v")
    big, head = members.where(~few), F.col("least") == F.col("cid")
    starred = big.withColumn("j", F.explode(F.when(head, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(_dealt(F.col("cid"), F.col("chunks"))))))
    starred = starred.select(key("least", "j").alias("task"), F.col("least").alias("fam"), "cid", F.when(head, 0).otherwise(1).alias("own"))
    star = _compare(docs, classes, small.union(starred), shingle, threshold, "star")
    joined = star.select(F.col("fam").alias("j_fam"), F.col("u").alias("j_cid")).distinct()
    rest = big.where(~head).join(joined, (F.col("least") == F.col("j_fam")) & (F.col("cid") == F.col("j_cid")), "left")
    rest = rest.select("least", "cid", "size", F.col("j_cid").isNotNull().alias("with_head"))
    side = lambda is_: (F.count(F.when(is_, 1)), F.sum(F.when(is_, F.col("size")).otherwise(0)))
    sides = rest.groupBy(F.col("least").alias("f")).agg(_chunks(*side(~F.col("with_head"))).alias("apart"), _chunks(*side(F.col("with_head"))).alias("together"))
    rest = rest.join(sides.where("apart > 0"), F.col("least") == F.col("f"))
    own = F.when(F.col("with_head"), _dealt(F.col("cid"), F.col("together"))).otherwise(_dealt(F.col("cid"), F.col("apart")))
    pair = lambda kind, x, y, o: F.struct(F.lit(kind).alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(o).cast("int").alias("own") if isinstance(o, int) else o.cast("int").alias("own"))
    upto = lambda c, f: F.when(F.col(c) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col(c), F.lit(1)) - 1), f)).otherwise(F.expr("array()"))
    inside = upto("apart", lambda b: pair(0, F.least(F.col("mine"), b), F.greatest(F.col("mine"), b), F.col("mine")))
    outward = upto("together", lambda b: pair(1, F.col("mine"), b, 0))
    inward = upto("apart", lambda b: pair(1, b, F.col("mine"), 1))
    sent = rest.withColumn("mine", own).select("least", "cid", F.explode(F.when(F.col("with_head"), inward).otherwise(F.concat(inside, outward))).alias("t"))
    sent = sent.select(key("least", "t.kind", "t.x", "t.y").alias("task"), F.col("least").alias("fam"), "cid", "t.own")
    sent = materialize(sent, "near-rest")
    apart = _compare(docs, classes, sent, shingle, threshold, "rest")
    return star.select("u", "v").union(apart.select("u", "v"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, carry_text: bool = False) -> DataFrame:
    """Classes of near-duplicate documents: links where 100 * intersection >= threshold * union of the shingle sets.

    docs: doc_id long, text, and any other columns, which are kept (text only with carry_text). Words are split at ASCII white space after
    A-Z were lower-cased; a set holds the distinct runs of ``shingle`` words, or the whole of a shorter text. Adds
    n_shingles long, component_id long (the smallest doc_id reachable by links, itself included), kept boolean (doc_id =
    component_id) and single boolean (true for one row of each component: also one of rows that repeat an id). Texts that
    are null or blank have empty sets and link with nothing; neither does a null id, whose component is null and which is
    kept. Columns of those names in docs are replaced. An empty table gives an empty result.

    1. Each document is sketched; equal sets are one class, known by its smallest id (aggregated before the shuffle).
    2. Bands of registers of the classes meet in buckets; buckets of one least member, the head, are one family. Families
       of up to a chunk share tasks. In a larger one every member is first compared with the head, a chunk a task; what
       links with the head is together, and only the others meet each other and those, as pairs of chunks. So no task
       holds more than two chunks, no pairs are sent, and a tight family of any size costs one comparison a member.
    3. The joint likelihood of the registers picks the pairs whose whole sets are compared; a task sends at most one edge
       for each member.
    4. Components of the edges join the classes, and these the documents.
    """
    need(docs, doc_id="long", text="string")
    docs = docs.drop("n_shingles", "component_id", "kept", "single")
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if carry_text or c != "text"}
    fields = ", ".join(f"{names[x.name]} {x.dataType.simpleString()}" for x in docs.schema if x.name in names)
    lean = docs.select(F.col("doc_id").cast("long").alias("_id"), "text", *[F.col(c).alias(n) for c, n in names.items()])
    sketched = map_arrow(lean, _sketch(shingle), f"_id long, {fields}, _size long, _k1 long, _k2 long, _regs binary")
    sketched = materialize(sketched.withColumn("_row", F.monotonically_increasing_id()), "near-sketch")
    some = sketched.where("_size > 0 and _id is not null")
    least = F.min(F.struct("_id", "_row"))
    classes = some.groupBy("_k1", "_k2").agg(F.min("_row").alias("cid"), least.alias("rep"), F.first("_size").alias("size"), F.first("_regs").alias("regs"))
    classes = materialize(classes, "near-classes")
    found = components(_links(docs, classes, shingle, threshold))

    classes = classes.select("_k1", "_k2", "cid", "rep").join(found, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    classes = materialize(classes, "near-found")
    heads = classes.groupBy(F.col("component").alias("h")).agg(F.min("rep").alias("head"))
    classes = classes.join(heads, F.col("component") == F.col("h")).select(F.col("_k1").alias("d1"), F.col("_k2").alias("d2"), "head")
    out = sketched.join(classes, (F.col("_k1") == F.col("d1")) & (F.col("_k2") == F.col("d2")) & (F.col("_size") > 0) & F.col("_id").isNotNull(), "left")
    component = F.coalesce("head._id", "_id")
    kept, single = F.coalesce(component == F.col("_id"), F.lit(True)), F.col("head").isNull() | (F.col("head._row") == F.col("_row"))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("_size").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), single.alias("single"))


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=4).select("doc_id", "n_shingles", "component_id", "kept")
