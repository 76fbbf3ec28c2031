"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import Words, held_out, labelled_sample, map_arrow, materialize, need, sigmoid, slices

BUCKETS = 1 << 18
FACTORS = 4
#: Labelled documents of each class that the machine is fitted on, at most.
SAMPLE = 4_000
#: Terms that take part: those that tell the classes apart at this chi-square or more, the best TERMS of them.
CHI_SQUARE, TERMS = 14.0, 1_024
EPOCHS, RATE, DECAY = 12, 0.2, 1e-4
THRESHOLD = 0.3
#: Besides whole words, their beginnings of so many bytes are terms: inflected insults share them.
PREFIXES = (4, 5, 6)


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct hashed terms of each text, sorted by text."""
    w = Words(column, lower=True, letters=True)
    size, doc = w.end - w.start, w.of_doc()
    hashes, owners = [w.hash], [doc]
    for p in PREFIXES:
        at = np.flatnonzero(size > p)
        hashes.append(w.part(w.start[at], w.start[at] + p) ^ np.uint64(p * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        owners.append(doc[at])
    key = np.concatenate(owners).astype(np.uint64) * np.uint64(BUCKETS) + (np.concatenate(hashes) & np.uint64(BUCKETS - 1))
    key = np.unique(key)
    return (key // np.uint64(BUCKETS)).astype(np.int64), (key % np.uint64(BUCKETS)).astype(np.int64)


def _term_lists():
    """Rows (text, y) to (y, terms)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 0):
                doc, bucket = terms(part.column(0))
                cuts = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.ListArray.from_arrays(pa.array(cuts), pa.array(bucket.astype(np.int32)))], names=["y", "terms"])

    return f


class Machine:
    """w0 + sum of w_i + sum over pairs i < j of v_i . v_j, over the terms that a text has."""

    def __init__(self, w0: float, place: np.ndarray, w: np.ndarray, v: np.ndarray):
        self.w0, self.place, self.w, self.v = w0, place, w, v

    def margin(self, doc: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        out = self.w0 + np.bincount(doc, self.w[slot], n)
        for f in range(self.v.shape[1]):
            x = self.v[slot, f]
            out += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        doc, bucket = terms(column)
        slot = self.place[bucket]
        known = slot >= 0
        return sigmoid(self.margin(doc[known], slot[known], len(column)))


def choose(with_term: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The buckets that take part, best first. with_term: for each class (0, 1) the texts that have each bucket, of n.

    A term that by itself does not tell the classes apart takes no part, so neither do its pairs.
    """
    b, a = with_term
    n0, n1 = np.maximum(n, 1)
    both = n0 + n1
    expected = (a + b) * (n1 / both)
    chi = np.where(a + b >= 4, (a - expected) ** 2 * both / np.maximum(expected * (1 - (a + b) / both) * (n0 / both), 1e-9), 0)
    best = np.argsort(-chi, kind="stable")[:TERMS]
    return best[chi[best] >= CHI_SQUARE]


def fit(lists: list[np.ndarray], y: np.ndarray, sizes: dict[int, int], best: np.ndarray | None = None, seed: int = 5) -> Machine:
    """Adagrad on weighted logistic loss; weights give the classes the shares they have among all labelled rows.

    best: the buckets that take part, as choose() has them; chosen from the lists if not given.
    """
    place = np.full(BUCKETS, -1, np.int32)
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    total = max(1, sizes.get(0, 0) + sizes.get(1, 0))
    prior = np.clip(sizes.get(1, 0) / total, 1e-4, 1 - 1e-4)
    if not len(lists) or (y == 1).sum() == 0 or (y == 0).sum() == 0:
        return Machine(float(np.log(prior / (1 - prior))), place, np.zeros(1), np.zeros((1, FACTORS)))
    flat = np.concatenate(lists).astype(np.int64)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    if best is None:
        best = choose(np.stack([np.bincount(flat[y[owner] == c], minlength=BUCKETS) for c in (0, 1)]), np.array([n0, n1]))
    n = n1 + n0
    place[best] = np.arange(len(best), dtype=np.int32)
    slot = place[flat]
    owner, slot = owner[slot >= 0], slot[slot >= 0].astype(np.int64)
    cuts = np.searchsorted(owner, np.arange(len(lists) + 1))
    rng = np.random.default_rng(seed)
    m = max(1, len(best))
    w, v = np.zeros(m), rng.normal(0, 0.01, (m, FACTORS))
    gw, gv, w0, g0 = np.full(m, 1e-6), np.full((m, FACTORS), 1e-6), float(np.log(prior / (1 - prior))), 1e-6
    weight = np.where(y == 1, prior / n1, (1 - prior) / n0) * n
    for _ in range(EPOCHS):
        order = rng.permutation(len(lists))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            idx = np.concatenate([np.arange(cuts[r], cuts[r + 1]) for r in rows]) if len(rows) else np.empty(0, int)
            doc, s = np.repeat(np.arange(len(rows)), cuts[rows + 1] - cuts[rows]), slot[idx]
            x = v[s]
            sums = np.stack([np.bincount(doc, x[:, f], len(rows)) for f in range(FACTORS)], 1)
            z = w0 + np.bincount(doc, w[s], len(rows)) + 0.5 * ((sums**2).sum(1) - np.bincount(doc, (x * x).sum(1), len(rows)))
            d = (sigmoid(z) - y[rows]) * weight[rows] / len(rows)
            g0 += d.sum() ** 2
            w0 -= RATE * d.sum() / np.sqrt(g0)
            used, at_ = np.unique(s, return_inverse=True)
            dw = np.bincount(at_, d[doc], len(used)) + DECAY * w[used]
            gw[used] += dw * dw
            w[used] -= RATE * dw / np.sqrt(gw[used])
            dv = np.stack([np.bincount(at_, d[doc] * (sums[doc, f] - x[:, f]), len(used)) for f in range(FACTORS)], 1) + DECAY * v[used]
            gv[used] += dv * dv
            v[used] -= 0.25 * RATE * dv / np.sqrt(gv[used])
    return Machine(w0, place, w, v)


def _only(shared):
    """Rows (y, terms) to those of the terms that take part."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = np.zeros(BUCKETS, bool)
        part[shared.value] = True
        for b in batches:
            x = b.column(1)
            cuts = x.offsets.to_numpy() - x.offsets[0].as_py()
            flat = x.flatten().to_numpy()
            kept = part[flat]
            cuts = np.concatenate([[0], np.cumsum(kept)])[cuts].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat[kept]))], names=["y", "terms"])

    return f


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fits a machine on up to ``sample`` labelled documents of each class that are not held out.

    Of rows that repeat an id the least text counts. The sample's terms stay in the shared folder: the driver gets how many
    texts of each class have a bucket, at most BUCKETS lines, and then of each sampled text the up to TERMS terms that take
    part.
    """
    ids, sizes = labelled_sample(labels, "toxic", sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), "text").join(F.broadcast(ids), F.col("d") == F.col("l_id"))
    rows = rows.groupBy("d").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    lists = materialize(map_arrow(rows.select("text", "y"), _term_lists(), "y int, terms array<int>"), "toxic-terms")
    counts = lists.select("y", F.explode("terms").alias("t")).groupBy("y", "t").agg(F.count("*").alias("n"))
    counts = counts.groupBy("t").agg(*[F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]).toArrow()
    with_term = np.zeros((2, BUCKETS))
    for c in (0, 1):
        with_term[c, counts["t"].to_numpy()] = counts[f"n{c}"].to_numpy()
    n = {r["y"]: r["count"] for r in lists.groupBy("y").count().collect()}
    best = choose(with_term, np.array([n.get(0, 0), n.get(1, 0)]))
    got = map_arrow(lists, _only(docs.sparkSession.sparkContext.broadcast(best)), "y int, terms array<int>").toArrow()
    kept = [x.values.to_numpy() for x in got["terms"]]
    y = np.array(got["y"].to_pylist(), np.int64)
    order = sorted(range(len(y)), key=lambda i: (int(y[i]), len(kept[i]), kept[i].tobytes()))  # whatever the partitions
    return fit([kept[i] for i in order], y[order], sizes, best)


def toxicity(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """Scores each whole text: docs with toxic_score double (0 to 1) and toxic_predicted int (1 if score >= threshold).

    docs: text and any other columns, all kept; the two added ones are replaced if there. Null, empty and unknown texts
    have the score of no terms, which is about the share of toxic rows. Repeated rows have equal scores. An empty table
    gives an empty result. The model has a fixed size: BUCKETS places, TERMS weights and factors.
    """
    need(docs, text="string")
    docs = docs.drop("toxic_score", "toxic_predicted")
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for part in slices(b, at):
                s = m.score(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "s", "p"])

    ddl = ", ".join(f"c{i} {x.dataType.simpleString()}" for i, x in enumerate(docs.schema))
    out = map_arrow(docs.toDF(*names), f, f"{ddl}, s double, p int")
    return out.toDF(*docs.columns, "toxic_score", "toxic_predicted")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity(docs, machine)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))
