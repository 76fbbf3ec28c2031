"""Approximate nearest neighbours by a hierarchical navigable small-world graph per shard."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightloom.llm.common import map_arrow, materialize, mix64, need

#: Rows of a shard at least, in how many shards larger tables are cut, and the bytes that a shard has at most.
SHARD, SHARDS, SHARD_BYTES = 16_384, 64, 64 << 20
#: Neighbours of a node that its own search picks, and in all with those that picked it; candidates they are picked from.
PICK, MOST, CANDIDATES = 32, 64, 128
#: Width of the beam of queries on the lowest layer and of inserted nodes, of both above, and nodes that a step expands.
BEAM, INSERT, UPPER, STEP = 160, 96, 16, 4
#: Nodes that are inserted together at most, and at first.
TOGETHER, FIRST = 1_024, 128


def vectors_of(column: list) -> tuple[np.ndarray, list[bytes], list[int]]:
    """(places, float64 bytes, lengths) of the vectors that are not null or zero and have finite components only."""
    at, raw, dims = [], [], []
    for i, v in enumerate(column):
        if v is None or not len(v) or None in v:
            continue
        x = np.array(v, np.float64)
        if np.isfinite(x).all() and x.any():
            at.append(i)
            raw.append(x.tobytes())
            dims.append(len(x))
    return np.array(at, np.int64), raw, dims


def _valid():
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, raw, dims = vectors_of(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], names=["id", "dims", "v"])

    return f


def walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The best nodes found for each query and their inner products, best first (node len(x): none); all queries step together."""
    n, m = len(q), len(x)
    seen = np.zeros((n, m + 1), bool)
    seen[:, m] = True
    wide = max(min(width, m), entry.shape[1])
    ids = np.full((n, wide), m, np.int64)
    near = np.full(ids.shape, -np.inf, np.float32)
    ids[:, : entry.shape[1]] = entry
    near[:, : entry.shape[1]] = np.einsum("qd,qed->qe", q, x[entry])
    seen[np.arange(n)[:, None], entry] = True
    done = ids == m
    live = np.arange(n)
    while len(live):
        waiting = np.where(done[live], -np.inf, near[live])
        e = np.argsort(-waiting, axis=1, kind="stable")[:, :STEP]
        valid = np.take_along_axis(waiting, e, 1) > -np.inf
        go = valid.any(1)
        live, e, valid = live[go], e[go], valid[go]
        if not len(live):
            break
        at = np.take_along_axis(ids[live], e, 1)
        mark = done[live]
        np.put_along_axis(mark, e, True, 1)
        done[live] = mark
        nb = np.where(valid[..., None], links[np.minimum(at, m - 1)], -1).reshape(len(live), -1).astype(np.int64)
        nb[nb < 0] = m
        nb.sort(1)
        nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = m
        nb[seen[live[:, None], nb]] = m
        seen[live[:, None], nb] = True
        s = np.einsum("qd,qed->qe", q[live], x[np.minimum(nb, m - 1)])
        s[nb == m] = -np.inf
        all_near, all_ids = np.concatenate([near[live], s], 1), np.concatenate([ids[live], nb], 1)
        all_done = np.concatenate([done[live], nb == m], 1)
        best = np.argpartition(-all_near, wide - 1, axis=1)[:, :wide]
        near[live], ids[live], done[live] = (np.take_along_axis(a, best, 1) for a in (all_near, all_ids, all_done))
    by = np.argsort(-near, axis=1, kind="stable")[:, : min(width, m)]
    return np.take_along_axis(ids, by, 1), np.take_along_axis(near, by, 1)


def _pick(x: np.ndarray, c: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Up to PICK of each row's candidates c (products v, best first; -inf: none): those nearer to the row than to any
    picked before come first, then the nearest of the others."""
    cv = x[np.maximum(c, 0)]
    among = np.matmul(cv, cv.transpose(0, 2, 1))
    chosen = np.zeros(c.shape, bool)
    for j in range(c.shape[1]):
        blocked = (chosen & (among[:, j, :] >= v[:, j, None])).any(1)
        chosen[:, j] = ~blocked & (chosen.sum(1) < PICK) & (v[:, j] > -np.inf)
    rank = np.argsort(~chosen, axis=1, kind="stable")[:, :PICK]
    c, v = np.take_along_axis(c, rank, 1), np.take_along_axis(v, rank, 1)
    return np.where(v > -np.inf, c, -1), v


def insert_layer(x: np.ndarray, descend, most: int) -> np.ndarray:
    """Flat neighbour arrays (-1: none) of the layer of nodes x, which are inserted in order, some together.

    Each node searches the graph of those before it, from where ``descend`` has come in the layers above, and sees those
    that are inserted with it. It links with the ones it picks from what it has found, and they with it: behind its own
    picks a node keeps the nearest of those that picked it.
    """
    n = len(x)
    links = np.full((n, most), -1, np.int32)
    near = np.full((n, most), -np.inf, np.float32)
    done, pick = 0, min(PICK, most)
    while done < n:
        rows = np.arange(done, min(n, done + min(max(FIRST, done), TOGETHER)))
        q = x[rows]
        s = q @ q.T
        np.fill_diagonal(s, -np.inf)
        few = min(len(rows), CANDIDATES)
        c = np.argpartition(-s, few - 1, axis=1)[:, :few]
        c, v = c + done, np.take_along_axis(s, c, 1)
        if done:
            found, value = walk(x[:done], links[:done], q, descend(q, done), INSERT)
            value[found == done] = -np.inf
            c, v = np.concatenate([found, c], 1), np.concatenate([value, v], 1)
        by = np.argsort(-v, axis=1, kind="stable")[:, :CANDIDATES]
        own, value = _pick(x, np.take_along_axis(c, by, 1), np.take_along_axis(v, by, 1))
        own, value = own[:, :pick], value[:, :pick]
        links[rows, : own.shape[1]], near[rows, : own.shape[1]] = own, value
        src, dst, value = np.repeat(rows, own.shape[1]), own.ravel(), value.ravel()
        there = dst >= 0
        src, dst, value = src[there], dst[there], value[there]
        new = ~(links[dst, :pick] == src[:, None]).any(1)
        src, dst, value = src[new], dst[new], value[new]
        by = np.lexsort((-value, dst))
        src, dst, value = src[by], dst[by], value[by]
        place = np.arange(len(dst)) - np.searchsorted(dst, dst)
        room = place < most - pick
        src, dst, value, place = src[room], dst[room], value[room], place[room]
        at, row = np.unique(dst, return_inverse=True)
        more, more_near = np.full((len(at), most - pick), -1, np.int32), np.full((len(at), most - pick), -np.inf, np.float32)
        more[row, place], more_near[row, place] = src, value
        more, more_near = np.concatenate([links[at, pick:], more], 1), np.concatenate([near[at, pick:], more_near], 1)
        best = np.argsort(-more_near, axis=1, kind="stable")[:, : most - pick]
        links[at, pick:], near[at, pick:] = np.take_along_axis(more, best, 1), np.take_along_axis(more_near, best, 1)
        done += len(rows)
    return links


class Graph:
    """A shard's index: distinct vectors, for each the smallest ids that have it, and layers of flat neighbour arrays.

    Nodes stand in order of their layers, so that each layer has the first ones; the inner product itself is the nearness.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], np.ascontiguousarray(x[order])
        _, first, back = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        u = mix64(ids[first].view(np.uint64) ^ np.uint64(0x5555))
        level = np.floor(-np.log(np.maximum((u >> np.uint64(11)).astype(np.float64) * 2.0**-53, 1e-18)) / np.log(UPPER)).astype(int)
        stand = np.lexsort((u, -level))
        self.x, level = x[first[stand]], level[stand]
        by = np.argsort(np.argsort(stand)[back], kind="stable")  # ids ascend within a node
        start = np.searchsorted(np.argsort(stand)[back][by], np.arange(len(first) + 1))
        keep = np.concatenate([by[a : min(b, a + k + 1)] for a, b in zip(start[:-1], start[1:], strict=True)])
        self.ids, self.start = ids[keep], np.cumsum([0, *np.minimum(np.diff(start), k + 1)])
        self._flatten()
        top = 0
        while (level > top).sum() > UPPER:
            top += 1
        self.layers: list[np.ndarray] = []  # the highest first
        for layer in range(top, -1, -1):
            self.layers.append(insert_layer(self.flat[: int((level >= layer).sum())], self._descend, MOST if layer == 0 else PICK + UPPER))

    def _flatten(self) -> None:
        self.flat = (self.x / np.abs(self.x).max()).astype(np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "flat"}

    def __setstate__(self, state) -> None:
        self.__dict__ = state
        self._flatten()

    def _descend(self, q: np.ndarray, among: int) -> np.ndarray:
        """Nodes of the first ``among`` from which the next layer is searched."""
        if not self.layers or among < len(self.layers[-1]):
            return np.tile(np.arange(min(among, UPPER)), (len(q), 1))
        at = np.tile(np.arange(min(len(self.layers[0]), UPPER)), (len(q), 1))
        for links in self.layers if among <= len(self.x) else self.layers[:-1]:
            m = len(links)
            at = walk(self.flat[:m], links, q, at, UPPER)[0]
            at = np.where(at < m, at, at[:, :1])
        return at

    def search(self, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vec_id, score) of the k best found; a query's own id is passed over.

        A score is the sum of the products from the first component to the last, in double precision, so that it depends on
        the two vectors only.
        """
        out: tuple[list, list, list] = ([], [], [])
        for lo in range(0, len(q), 512):
            own = q[lo : lo + 512]
            flat = (own / np.abs(own).max(1, keepdims=True)).astype(np.float32)
            at = self._descend(flat, len(self.x) + 1)
            found, _ = walk(self.flat, self.layers[-1], flat, at, max(BEAM, 2 * k))
            for i in range(len(own)):
                c = found[i][found[i] < len(self.x)]
                s = np.cumsum(self.x[c] * own[i], axis=1)[:, -1]
                n = self.start[c + 1] - self.start[c]
                vec, s = np.concatenate([self.ids[self.start[j] : self.start[j + 1]] for j in c.tolist()]), np.repeat(s, n)
                mine = vec != ids[lo + i]
                vec, s = vec[mine], s[mine]
                by = np.lexsort((vec, -s))[:k]
                for x, y in zip(out, (np.full(len(by), ids[lo + i]), vec[by], s[by]), strict=True):
                    x.append(y)
        return tuple(np.concatenate(o) if o else np.empty(0) for o in out)


def _matrix(column) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _build(k: int):
    def f(table: pa.Table) -> pa.Table:
        g = Graph(table["id"].to_numpy(), _matrix(table["v"]), k)
        return pa.table({"dims": table["dims"][:1], "shard": table["shard"][:1], "graph": pa.array([pickle.dumps(g, 5)], pa.binary())})

    return f


def _search(k: int):
    """Rows (dims, shard, block, id, v) in order, each block's graph (a null id) before its queries, to what these find."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, graph = None, None
        for b in batches:
            key = [b.column(i).to_numpy() for i in range(3)]
            is_graph = b.column(3).is_null().to_numpy(zero_copy_only=False)
            new = np.ones(b.num_rows + 1, bool)
            new[1:-1] = is_graph[1:] | is_graph[:-1] | np.any([c[1:] != c[:-1] for c in key], axis=0)
            cuts = np.flatnonzero(new)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                here = tuple(int(c[lo]) for c in key)
                if is_graph[lo]:
                    at, graph = here, pickle.loads(b.column(4)[lo].as_buffer())
                elif at == here:  # there is no graph where no vector has that length
                    part = b.slice(lo, hi - lo)
                    found = graph.search(part.column(3).to_numpy(), _matrix(part.column(4)), k)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return f


def shard_rows(rows: int, dims: int) -> int:
    """Rows of a shard: a SHARDS-th of the table, SHARD at least, as far as its graph has SHARD_BYTES."""
    return max(1, min(max(SHARD, rows // SHARDS), SHARD_BYTES // (8 * dims + 4 * MOST + 64)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, shard: int | None = None) -> DataFrame:
    """The k nearest of all rows of vectors for each row of queries, by inner product, as far as the graphs find them.

    Both tables: vec_id long, embedding array<float or double>; other columns are ignored. Returns query_id long, rank int
    from 1, vec_id long, score double: nearest first, ties to the smaller vec_id, without the query's own vec_id; all
    candidates if there are fewer. Vectors that are null, empty, zero or hold null or non-finite components take no part,
    nor do null ids; of rows with one id the first by value counts. Only vectors of equal length meet. Empty tables give
    empty results.

    Rows are dealt to shards of about ``shard`` rows (shard_rows by default) by a hash of their id, so that copies and
    clusters spread. A shard's graph, flat arrays in one row, is written to the shared folder; every row is in a graph.
    Copies within a shard are one node. A graph is read once for each block of a shard's queries, of which there are no more
    than keep all cores busy, and the block's queries stream through it; a shard returns k rows for a query, and these are
    merged.
    """
    need(vectors, vec_id="long", embedding="array")

    def clean(df: DataFrame) -> DataFrame:
        some = df.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("id"), "embedding")
        valid = map_arrow(some, _valid(), "id long, dims int, v binary")
        return valid.groupBy("id").agg(F.min(F.struct("dims", "v")).alias("x")).select("id", "x.dims", "x.v")

    rows, asked = materialize(clean(vectors), "ann-rows"), materialize(clean(queries), "ann-queries")
    n, dims = rows.agg(F.count("*"), F.max("dims")).first()
    shards = -(-n // (shard or shard_rows(n, dims or 1))) or 1
    blocks = -(-rows.sparkSession.sparkContext.defaultParallelism // shards)
    part = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    graphs = materialize(part.groupBy("dims", "shard").applyInArrow(_build(k), "dims int, shard int, graph binary"), "ann-graphs")
    index = graphs.select("dims", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(None).cast("long").alias("id"), "graph")
    sent = asked.select("dims", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id", F.lit(9)), F.lit(blocks)).cast("int").alias("block"), "id", "v")
    both = index.union(sent).repartition(shards * blocks, "dims", "shard", "block").sortWithinPartitions("dims", "shard", "block", F.asc_nulls_first("id"))
    found = map_arrow(both, _search(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0"))
