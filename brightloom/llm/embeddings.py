"""Embedding near-dedup by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import components, map_arrow, materialize, mix64, need

COSINE = 0.98
#: Dimensions of a block. The squared distance of unit vectors is 2 - 2 cos; split over the blocks by their dimensions,
#: at least one block of a linked pair stays within its part.
BLOCK = 8
#: Rounding of vectors and rotation: blocks are compared with this much more than their budget, pairs then exactly.
SLACK = 1e-6
#: A block's range join is dealt out in cells of WIDTH times the block's radius, by so many of its leading dimensions that
#: there are about as many cells as chunks: a dimension has some CELLS cells that are well filled.
WIDTH, CELLS, GRID = 3.0, 3, 2
#: Vectors that one task compares with as many others; a larger cell is dealt out in pairs of chunks.
CHUNK = 2_000


def rotation(dims: int, seed: int = 2) -> np.ndarray:
    """A fixed random rotation: it spreads what differs over all blocks."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the valid ones: not null, not zero, all components finite."""
    at, rows = [], []
    for i, v in enumerate(vectors):
        if v is None or not len(v) or None in v:
            continue
        x = np.array(v, np.float64)
        with np.errstate(all="ignore"):
            n = np.abs(x).max()
        if np.isfinite(n) and n > 0:
            x = x / n
            at.append(i)
            rows.append(x / np.sqrt(x @ x))
    return np.array(at, np.int64), rows


def _prepare():
    """Rows (row, id, label, vector) to (row, id, label, dims, key, unit vector)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = unit(b.column(3).to_pylist())
            valid = b.take(pa.array(at))
            key = np.frombuffer(b"".join(xxhash.xxh3_128_digest(r.tobytes()) for r in rows), "<i8").reshape(-1, 2)
            out = [pa.array([len(r) for r in rows], pa.int32()), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array([r.tobytes() for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([*valid.columns[:3], *out], names=["row", "id", "label", "dims", "k1", "k2", "unit"])

    return f


def grid(vectors: int) -> int:
    """Leading dimensions by which a table of so many vectors is dealt out. Any number gives the same links."""
    return min(BLOCK, max(GRID, int(np.ceil(np.log(max(vectors, 1) / CHUNK) / np.log(CELLS)))))


def _blocks(budget: float, axes: int = GRID):
    """Classes (cid, label, dims, unit) to a row for each block and each cell within the block's radius."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column(2).to_numpy()
            cid, label = b.column(0).to_numpy(), b.column(1).to_numpy()
            raw = b.column(3).to_pylist()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d not in turns:
                    turns[d] = rotation(int(d))
                x = np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), d) @ turns[d]
                for k, lo in enumerate(range(0, d, BLOCK)):
                    part = np.ascontiguousarray(x[:, lo : lo + BLOCK])
                    radius = np.sqrt(budget * part.shape[1] / d) + SLACK
                    g = min(axes, part.shape[1])
                    step = WIDTH * radius
                    low, high = np.floor((part[:, :g] - radius / 2) / step).astype(np.int64), np.floor((part[:, :g] + radius / 2) / step).astype(np.int64)
                    who, cell = np.arange(len(at)), np.zeros((len(at), 0), np.int64)
                    for j in range(g):
                        two = np.flatnonzero(high[who, j] > low[who, j])
                        cell = np.concatenate([np.column_stack([cell, low[who, j]]), np.column_stack([cell[two], high[who[two], j]])])
                        who = np.concatenate([who, who[two]])
                    flat = (cell.view(np.uint64) @ mix64(np.arange(1, g + 1, dtype=np.uint64))).view(np.int64)  # cells that collide are one
                    n = len(who)
                    yield pa.RecordBatch.from_arrays([pa.array(label[at][who]), pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(flat), pa.array(cid[at][who]), pa.array([p.tobytes() for p in part[who]], pa.binary())], names=["label", "dims", "block", "cell", "cid", "part"])

    return f


def _compare(budget: float):
    """One cell, or two of its chunks, to candidate pairs: blocks within the radius."""

    def f(table: pa.Table) -> pa.Table:
        part = np.frombuffer(b"".join(table["part"].to_pylist()), np.float64).reshape(table.num_rows, -1)
        cid, own = table["cid"].to_numpy(), table["own"].to_numpy()
        dims = table["dims"][0].as_py()
        limit = (np.sqrt(budget * part.shape[1] / dims) + SLACK) ** 2
        cross = table["c1"][0].as_py() != table["c2"][0].as_py()
        left = np.flatnonzero(own == table["c1"][0].as_py())
        right = np.flatnonzero(own == table["c2"][0].as_py()) if cross else left
        norm = (part * part).sum(1)
        u, v = [], []
        for at in range(0, len(left), 512):
            i = left[at : at + 512]
            near = norm[i][:, None] + norm[right][None, :] - 2 * part[i] @ part[right].T <= limit + 1e-12
            a, b = np.nonzero(near)
            a, b = cid[i[a]], cid[right[b]]
            ok = a != b if cross else a < b
            u.append(np.minimum(a[ok], b[ok]))
            v.append(np.maximum(a[ok], b[ok]))
        pairs = np.unique(np.column_stack([np.concatenate(u), np.concatenate(v)]), axis=0) if u else np.zeros((0, 2), np.int64)
        return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})

    return f


def _verify(cosine: float):
    """Pairs with both unit vectors to those that are linked, in double precision."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [b.column(i).to_pylist() for i in (2, 3)]
            size = np.array([len(x) for x in raw[0]], np.int64)
            linked = np.zeros(b.num_rows, bool)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                x, y = (np.frombuffer(b"".join([r[i] for i in at.tolist()]), np.float64).reshape(len(at), -1) for r in raw)
                linked[at] = np.einsum("ij,ij->i", x, y) >= cosine
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(linked))

    return f


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Classes of near-duplicate vectors: links between vectors of equal, non-null label whose cosine is at least ``cosine``.

    vectors: vec_id long, embedding array<float or double>, label long or int, and any other columns, which are kept (but
    embedding). Adds n_links long (other vectors linked directly), component_id long (the smallest vec_id reachable by
    links, itself included), kept boolean (vec_id = component_id). Columns of those names are replaced. Vectors that are
    null, empty, zero or hold null or non-finite components, and those with a null label or id, link with nothing: 0
    links, a component of their own. Vectors of different length do not link. Repeated rows are vectors of their own.
    An empty table gives an empty result.

    1. Rows of equal label and equal unit vector are one class; copies count as links but are never paired.
    2. Unit vectors are rotated and split into blocks of BLOCK dimensions. A linked pair is within the block's share of
       the squared distance 2 - 2 * cosine in at least one block. For each, a range join is dealt out by a grid on its
       first dimensions: a vector goes to each cell that its half radius touches, so that two vectors within the radius
       share a cell. Cells of over CHUNK vectors are dealt out in pairs of chunks; no task holds more than two.
    3. The union of the blocks' candidates is verified with whole vectors.
    """
    need(vectors, vec_id="long", embedding="array", label="long")
    vectors = vectors.drop("n_links", "component_id", "kept")
    rest = [c for c in vectors.columns if c != "embedding"]
    budget = 2 - 2 * cosine
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("lab"), "embedding", F.struct(*rest).alias("own"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "emb-rows")
    some = rows.where("lab is not null and id is not null and embedding is not null").select("row", "id", "lab", "embedding")
    ready = materialize(map_arrow(some, _prepare(), "row long, id long, label long, dims int, k1 long, k2 long, unit binary"), "emb-units")
    classes = ready.groupBy("label", "dims", "k1", "k2").agg(F.min("row").alias("cid"), F.min("id").alias("rep"), F.count("*").alias("n"), F.first("unit").alias("unit"))
    classes = materialize(classes, "emb-classes")

    cells = materialize(map_arrow(classes.select("cid", "label", "dims", "unit"), _blocks(budget, grid(classes.count())), "label long, dims int, block int, cell long, cid long, part binary"), "emb-cells")
    place = ["label", "dims", "block", "cell"]
    sizes = cells.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1").select(*[F.col(c).alias(f"s_{c}") for c in place], F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    dealt = cells.join(sizes, [F.col(c) == F.col(f"s_{c}") for c in place]).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select(*place, "cid", "part", "own", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2"))
    pairs = dealt.groupBy(*place, "c1", "c2").applyInArrow(_compare(budget), "u long, v long").distinct()
    of = lambda c: classes.select(F.col("cid").alias(c), F.col("unit").alias(f"unit_{c}"))
    both = pairs.join(of("cu"), F.col("u") == F.col("cu")).join(of("cv"), F.col("v") == F.col("cv")).select("u", "v", "unit_cu", "unit_cv")
    links = materialize(map_arrow(both, _verify(cosine), "u long, v long"), "emb-links")

    n_of = classes.select(F.col("cid").alias("o_cid"), F.col("n").alias("o_n"))
    ends = links.select(F.col("u").alias("a"), F.col("v").alias("b")).union(links.select(F.col("v").alias("a"), F.col("u").alias("b")))
    others = ends.join(n_of, F.col("b") == F.col("o_cid")).groupBy("a").agg(F.sum("o_n").alias("others"))
    found = components(links)
    known = classes.select("label", "dims", "k1", "k2", "cid", "rep", "n").join(others, F.col("cid") == F.col("a"), "left").join(found, F.col("cid") == F.col("node"), "left")
    known = materialize(known.withColumn("component", F.coalesce("component", "cid")), "emb-found")
    heads = known.groupBy(F.col("component").alias("h")).agg(F.min("rep").alias("head"))
    known = known.join(heads, F.col("component") == F.col("h")).select(F.col("label").alias("l2"), F.col("dims").alias("d2"), F.col("k1").alias("k12"), F.col("k2").alias("k22"), "head", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    own = ready.select(F.col("row").alias("r"), "label", "dims", "k1", "k2").join(known, (F.col("label") == F.col("l2")) & (F.col("dims") == F.col("d2")) & (F.col("k1") == F.col("k12")) & (F.col("k2") == F.col("k22")))
    out = rows.select("row", "id", "own").join(own.select("r", "head", "links"), F.col("row") == F.col("r"), "left")
    component = F.coalesce("head", "id")
    return out.select(*[F.col("own")[c].alias(c) for c in rest], F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op2_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")).drop("label")
