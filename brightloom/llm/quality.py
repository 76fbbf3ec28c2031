"""Quality classifier by Bradley-Terry pairwise ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import Words, grams, held_out, map_arrow, materialize, need, sigmoid, slices, text_bytes

THRESHOLD = 0.7
RIDGE, STEPS = 1e-3, 25
#: Distances of the nodes that scores are dealt to: for sums over pairs (by six nodes each, to about 1e-8) and for the
#: curvature (by two nodes).
FINE, COARSE = 1 / 8, 1 / 2
#: Parts of a Newton step that are tried at once, and nodes in one vector of a histogram.
TRIED, CHUNK = (1.0, 0.5, 0.25, 0.0625), 256
#: Byte classes that are counted, as fixed values: class number by characters.
CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!", "?", ".,;:", "|", "#$%&*@^~", "<>{}[]\\/=_+`", "\"'()-", "\n", " \t\r"]
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate(CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _i + 1
_CLASS[128:] = len(CLASSES) + 1
KINDS = len(CLASSES) + 2


#: Buckets of hashed words, whose shares of a text are features: what is written about counts beside how.
LEXICAL = 256


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each text."""
    if not len(doc):
        return np.zeros(n)
    by = np.lexsort((value, doc))
    d, v = doc[by], value[by]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return np.bincount(d[new], minlength=n).astype(float)


def features(column: pa.Array) -> np.ndarray:
    """A row for each text: shares of byte classes, lengths, how much repeats, and square roots of the shares of hashed words,
    letters only and A-Z lower-cased. Nothing but the text is looked at."""
    w = Words(column, lower=True)
    n, doc = len(w), w.of_doc()
    size = np.diff(w.offsets).astype(float)
    kind = np.bincount(np.repeat(np.arange(n), np.diff(w.offsets)) * KINDS + _CLASS[w.data], minlength=n * KINDS).reshape(n, KINDS)
    share = kind[:, 1:] / np.maximum(size, 1)[:, None]
    words = np.diff(w.range).astype(float)
    per = np.maximum(words, 1)
    long = (w.end - w.start).astype(float)
    mean = np.bincount(doc, long, n) / per
    var = np.bincount(doc, long * long, n) / per - mean * mean
    distinct = _distinct(doc, w.hash, n) / per
    same = np.bincount(doc[1:], (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1]), n) / per if len(doc) else np.zeros(n)
    four, ok = grams(w.hash, 4), w.whole(4)
    fours = np.bincount(doc[: len(four)][ok], minlength=n) if len(four) else np.zeros(n)
    repeat = 1 - (_distinct(doc[: len(four)][ok], four[ok], n) / np.maximum(fours, 1) if len(four) else np.zeros(n))
    repeat = np.where(fours > 0, repeat, 0)
    last = w.data[w.end - 1] if len(w.end) else w.data
    odd = np.bincount(doc, (_CLASS[last] >= 7) & (_CLASS[last] <= 9), n) / per if len(doc) else np.zeros(n)
    base = np.column_stack([share, np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(var, 0)), distinct, same, repeat, odd, size == 0])
    root = np.sqrt(np.maximum(np.column_stack([share, same, repeat, odd]), 0))
    plain = Words(column, lower=True, letters=True)
    bucket = plain.of_doc() * LEXICAL + (plain.hash >> np.uint64(40)).astype(np.int64) % LEXICAL
    lexical = np.bincount(bucket, minlength=n * LEXICAL).reshape(n, LEXICAL) / np.maximum(np.diff(plain.range), 1)[:, None]
    return np.column_stack([base, root, np.sqrt(lexical), distinct**2, distinct * np.log1p(words), mean**2, np.minimum(distinct, 0.5)])


class Ranking:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, cut: float, unit: float):
        self.mean, self.scale, self.weight, self.cut, self.unit = mean, scale, weight, cut, unit

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (np.clip((x - self.mean) / self.scale, -6, 6) * self.weight).sum(1)  # row by row: the same in any batch

    def score(self, column: pa.Array) -> np.ndarray:
        return sigmoid((self.raw(features(column)) - self.cut) / self.unit + np.log(THRESHOLD / (1 - THRESHOLD)))


#: What adds up over documents: vectors by (kind, place), from some rows of features and their labels.
Sums = dict[tuple[int, int], np.ndarray]
Part = Callable[[np.ndarray, np.ndarray], Iterator[tuple[tuple[int, int], np.ndarray]]]


def _add(parts: Iterator[tuple[np.ndarray, np.ndarray]], f: Part) -> Sums:
    out: Sums = {}
    for x, y in parts:
        for at in range(0, len(y), 2_048):
            for key, v in f(x[at : at + 2_048], y[at : at + 2_048]):
                if key in out:
                    out[key] += v
                else:
                    out[key] = np.array(v, float)
    return out


def _total(rows: DataFrame, f: Part) -> Sums:
    """Sums over a table (x binary, y int): tasks add up their rows, a shuffle by key the tasks' sums in one order. The
    driver gets one vector a key, whatever the number of rows and tasks."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for b in batches:
                if b.num_rows:
                    data, _ = text_bytes(b.column(0))
                    yield np.frombuffer(data.tobytes()).reshape(b.num_rows, -1), b.column(1).to_numpy()

        sums = _add(arrays(), f)
        keys, task = list(sums), TaskContext.get().partitionId()
        for at in range(0, len(keys), 512):
            some = keys[at : at + 512]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in some], pa.int32()), pa.array([k for _, k in some], pa.int64()), pa.array([task] * len(some), pa.int32()), pa.array([sums[k].tobytes() for k in some], pa.binary())],
                names=["kind", "place", "task", "v"],
            )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, np.empty(0)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["kind", "place", "v"])

        for b in batches:
            for kind, place, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if (kind, place) == key:
                    sums = sums + np.frombuffer(v)
                    continue
                if key is not None:
                    yield out()
                key, sums = (kind, place), np.frombuffer(v)
        if key is not None:
            yield out()

    parts = map_arrow(rows, part, "kind int, place long, task int, v binary").repartition("kind", "place").sortWithinPartitions("kind", "place", "task")
    got = map_arrow(parts, join, "kind int, place long, v binary").toArrow().sort_by([("kind", "ascending"), ("place", "ascending")])
    return {(k, at): np.frombuffer(v) for k, at, v in zip(*(got[c].to_pylist() for c in ("kind", "place", "v")), strict=True)}


def _nodes(s: np.ndarray, width: float, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The first of the nodes that a score is dealt to, and its weights on them: Lagrange's on 2 * reach nodes around it."""
    at = np.floor(s / width)
    t, near = s / width - at, np.arange(1 - reach, reach + 1)
    weight = np.ones((len(s), len(near)))
    for i, a in enumerate(near):
        for b in near[near != a]:
            weight[:, i] *= (t - b) / (a - b)
    return at.astype(np.int64) + 1 - reach, weight


def _histogram(s: np.ndarray, kind: int, width: float, reach: int) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    if not len(s):
        return
    first, weight = _nodes(s, width, reach)
    lo = first.min() // CHUNK * CHUNK
    n = (first.max() + 2 * reach - lo) // CHUNK * CHUNK + CHUNK
    mass = sum(np.bincount(first - lo + j, weight[:, j], n) for j in range(2 * reach))
    for at in range(0, n, CHUNK):
        if mass[at : at + CHUNK].any():
            yield (kind, int(lo + at) // CHUNK), mass[at : at + CHUNK]


def _dense(sums: Sums, kinds: list[int]) -> tuple[int, list[np.ndarray]]:
    """Histograms of these kinds over the same nodes, and the first node."""
    at = [place for kind, place in sums if kind in kinds]
    lo, hi = min(at), max(at) + 1
    none = np.zeros(CHUNK)
    return lo * CHUNK, [np.concatenate([sums.get((k, i), none) for i in range(lo, hi)]) for k in kinds]


def _over(mass: np.ndarray, width: float, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """For each node the sum over all nodes of mass times f(their score - its score)."""
    n = len(mass)
    return np.convolve(mass, f(width * np.arange(n - 1, -n, -1)), "valid")


def _learn(total: Callable[[Part], Sums], dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
    """Means and scales of the features, the weights of the least mean logistic loss over all pairs of a document of label 1
    and one of label 0 plus the ridge, and the classes' sizes; ``total`` adds up over all documents.

    A document's part in the gradient is the mean of sigmoid(other - own) over the scores of the whole other class. Those are
    dealt to nodes that reproduce polynomials up to degree 5, so a pass adds up the histograms and another one the gradient:
    all pairs count, and work grows with the documents. The curvature has coarser nodes with the second-order error of the
    interpolation taken off; it stays positive and only steers the steps.
    """
    first = total(lambda x, y: ((((int(c), 0), np.append(x[y == c].sum(0), (y == c).sum())) for c in (0, 1))))
    size = {c: int(first[c, 0][-1]) if (c, 0) in first else 0 for c in (0, 1)}
    if not size[0] or not size[1]:
        return np.zeros(dims), np.ones(dims), np.zeros(dims), size
    mean = (first[0, 0] + first[1, 0])[:-1] / (size[0] + size[1])
    square = total(lambda x, y: [((0, 0), ((x - mean) ** 2).sum(0))])[0, 0]
    scale = np.maximum(np.sqrt(square / (size[0] + size[1])), 1e-6)

    def even(x: np.ndarray) -> np.ndarray:
        return np.clip((x - mean) / scale, -6, 6)

    def histograms(weights: np.ndarray) -> Part:
        """Kinds 4t to 4t + 3 for the weights of column t: fine of label 0 and 1, coarse of both."""

        def f(x: np.ndarray, y: np.ndarray):
            s = even(x) @ weights
            for t in range(s.shape[1]):
                for c in (0, 1):
                    yield from _histogram(s[y == c, t], 4 * t + c, FINE, 3)
                    yield from _histogram(s[y == c, t], 4 * t + 2 + c, COARSE, 1)

        return f

    def soft(u: np.ndarray) -> np.ndarray:
        return np.logaddexp(0, u)

    def bend(u: np.ndarray) -> np.ndarray:
        h = sigmoid(u) * sigmoid(-u)
        return h * (1 - COARSE**2 / 6 * (1 - 6 * h))

    def loss(sums: Sums, t: int, w: np.ndarray) -> float:
        _, (bad, good) = _dense(sums, [4 * t, 4 * t + 1])
        return float(good @ _over(bad, FINE, soft)) / size[0] / size[1] + RIDGE / 2 * float(w @ w)

    weight = np.zeros(dims)
    sums, t = {(k, at): v * size[k % 2] for (k, at), v in _add(iter([(np.stack([mean, mean]), np.array([0, 1]))]), histograms(weight[:, None])).items()}, 0
    now = loss(sums, t, weight)
    for _ in range(STEPS):
        lo, (bad, good) = _dense(sums, [4 * t, 4 * t + 1])
        pull = [_over(good, FINE, lambda u: sigmoid(-u)) / size[1], _over(bad, FINE, sigmoid) / size[0]]
        low, (bad, good) = _dense(sums, [4 * t + 2, 4 * t + 3])
        curve = [_over(good, COARSE, bend) / size[1], _over(bad, COARSE, bend) / size[0]]

        def slopes(x: np.ndarray, y: np.ndarray, w=weight, lo=lo, low=low, pull=pull, curve=curve):
            z = even(x)
            s = z @ w
            for c in (0, 1):
                own, of = z[y == c], s[y == c]
                if not len(of):
                    continue
                at, part = _nodes(of, FINE, 3)
                p = (part * pull[c][at[:, None] - lo + np.arange(6)]).sum(1)
                yield (0, 0), (1 - 2 * c) / size[c] * (p @ own)
                at, part = _nodes(of, COARSE, 1)
                h = (part * curve[c][at[:, None] - low + np.arange(2)]).sum(1)
                rows = (own * h[:, None]).T @ own / size[c]
                for i in range(dims):
                    yield (1, i), rows[i]
                places, back = np.unique(np.concatenate([at, at + 1]), return_inverse=True)
                deal = np.zeros((len(places), len(of)))
                deal[back[: len(of)], np.arange(len(of))] = part[:, 0]
                deal[back[len(of) :], np.arange(len(of))] = part[:, 1]
                for place, v in zip(places.tolist(), deal @ own / size[c], strict=True):
                    yield (2 + c, place), v

        got = total(slopes)
        at = [np.array([place for kind, place in got if kind == 2 + c]) for c in (0, 1)]
        of = [np.stack([got[2 + c, int(place)] for place in at[c]]) for c in (0, 1)]
        cross = of[1].T @ bend(COARSE * (at[1][:, None] - at[0][None, :])) @ of[0]
        hess = np.stack([got[1, i] for i in range(dims)]) - cross - cross.T + RIDGE * np.eye(dims)
        step = np.linalg.solve(hess, got[0, 0] + RIDGE * weight)
        tried = [weight - part * step for part in TRIED]
        sums = total(histograms(np.column_stack(tried)))
        losses = [loss(sums, i, w) for i, w in enumerate(tried)]
        t = next((i for i, x in enumerate(losses) if x <= now + 1e-12), int(np.argmin(losses)))
        weight, now = tried[t], losses[t]
        if np.abs(step).max() < 1e-7:
            break
    return mean, scale, weight, size


def _order(s: np.ndarray) -> np.ndarray:
    """Numbers without sign that stand in the order of these doubles."""
    bits = np.ascontiguousarray(s + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _ranked(total: Callable[[Part], Sums], score: Callable[[np.ndarray], np.ndarray], ranks: list[int]) -> list[float]:
    """The scores at these places of the order of all documents' scores, exactly: 16 bits a pass."""
    found, left = [0] * len(ranks), list(ranks)
    for shift in (48, 32, 16, 0):

        def count(x: np.ndarray, y: np.ndarray, shift=shift, found=tuple(found)):
            key = _order(score(x))
            for i, prefix in enumerate(found):
                own = key if shift == 48 else key[key >> np.uint64(shift + 16) == np.uint64(prefix)]
                digit = ((own >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)
                for place in np.unique(digit // CHUNK).tolist():
                    yield (i, place), np.bincount(digit[digit // CHUNK == place] - place * CHUNK, minlength=CHUNK).astype(float)

        got = total(count)
        for i in range(len(ranks)):
            places = sorted(place for kind, place in got if kind == i)
            seen = np.cumsum(np.concatenate([got[i, place] for place in places]))
            at = int(np.searchsorted(seen, left[i], "right"))
            left[i] -= int(seen[at - 1]) if at else 0
            found[i] = (found[i] << 16) + places[at // CHUNK] * CHUNK + at % CHUNK
    bits = np.array(found, np.uint64)
    return np.where(bits >> np.uint64(63) == 1, bits ^ np.uint64(1 << 63), ~bits).view(np.float64).tolist()


def _one_class(dims: int, good: int, bad: int) -> Ranking:
    up = 30.0 if good else -30.0
    return Ranking(np.zeros(dims), np.ones(dims), np.zeros(dims), -up if good or bad else 0.0, 1.0)


def fit(x: np.ndarray, y: np.ndarray, sizes: dict[int, int], pairs: int | None = None, seed: int = 4) -> Ranking:
    """Bradley-Terry in memory: P(a better than b) = sigmoid(s(a) - s(b)), s linear in the features; ridge, Newton steps.
    All pairs count, or as many drawn ones as ``pairs`` says.

    The cut is the quantile of the scores below which, with the classes at their true shares, as many documents lie as
    have label 0. It is mapped to THRESHOLD.
    """
    dims = x.shape[1]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return _one_class(dims, len(good), len(bad))
    if pairs is None:
        mean, scale, weight, _ = _learn(lambda f: _add(iter([(x, y)]), f), dims)
    else:
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        weight = _drawn(np.clip((x - mean) / scale, -6, 6), good, bad, pairs, seed)
    s = np.clip((x - mean) / scale, -6, 6) @ weight
    share = sizes.get(0, 0) / max(1, sizes.get(0, 0) + sizes.get(1, 0))
    by = np.argsort(s, kind="stable")
    mass = np.cumsum(np.where(y[by] == 0, share / len(bad), (1 - share) / len(good)))
    least = min(share / len(bad), (1 - share) / len(good))
    at = min(int(np.searchsorted(mass, share - least / 2)), len(by) - 1)  # the sums' rounding is no document
    low = s[by[at]]
    above = s[by[at + 1]] if at + 1 < len(by) else low
    return Ranking(mean, scale, weight, float((low + above) / 2), 1.0)


def _drawn(z: np.ndarray, good: np.ndarray, bad: np.ndarray, pairs: int, seed: int) -> np.ndarray:
    dims = z.shape[1]
    rng = np.random.default_rng(seed)
    better, worse = rng.choice(good, pairs), rng.choice(bad, pairs)
    weight = np.zeros(dims)
    for _ in range(STEPS):
        g, h = RIDGE * weight, RIDGE * np.eye(dims)
        for at in range(0, pairs, 8_192):  # the differences of a part of the pairs at a time
            d = z[better[at : at + 8_192]] - z[worse[at : at + 8_192]]
            p = sigmoid(-(d @ weight))
            g -= d.T @ p / pairs
            h += (d * (p * (1 - p))[:, None]).T @ d / pairs
        step = np.linalg.solve(h, g)
        weight -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return weight


def _feature_rows():
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 0):
                x = features(part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), part.column(1)], names=["x", "y"])

    return f


def train(docs: DataFrame, labels: DataFrame) -> Ranking:
    """Fits a ranking on all labelled documents that are not held out and on all pairs of them; their features are written
    once, and the driver gets sums only. Rows with a null id or label are left out; an id with several labels has the
    largest, and of rows that repeat an id the least text counts. The cut lies between the two scores, in the order of all
    these documents, below which as many lie as have label 0."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    own = own.groupBy(F.col("doc_id").cast("long").alias("d")).agg(F.max(F.col("quality").cast("int")).alias("y")).where("y in (0, 1)")
    texts = docs.where(~held_out(F.col("doc_id"), 4, 2)).select(F.col("doc_id").cast("long").alias("d"), "text")
    rows = texts.join(own.hint("merge"), "d").groupBy("d").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    rows = materialize(map_arrow(rows.sortWithinPartitions("d").select("text", "y"), _feature_rows(), "x binary, y int"), "quality")
    dims = features(pa.array([""])).shape[1]
    mean, scale, weight, size = _learn(lambda f: _total(rows, f), dims)
    if not size[0] or not size[1]:
        return _one_class(dims, size[1], size[0])
    ranking = Ranking(mean, scale, weight, 0.0, 1.0)
    low, above = _ranked(lambda f: _total(rows, f), ranking.raw, [size[0] - 1, size[0]])
    ranking.cut = (low + above) / 2
    return ranking


def quality(docs: DataFrame, ranking: Ranking, threshold: float = THRESHOLD) -> DataFrame:
    """Scores each whole text: docs with quality_score double (0 to 1) and quality_predicted int (1 if >= threshold).

    docs: text and any other columns, all kept; the two added ones are replaced if there. Null and empty texts are scored
    as texts without words. Repeated rows have equal scores. An empty table gives an empty result.
    """
    need(docs, text="string")
    docs = docs.drop("quality_score", "quality_predicted")
    shared = docs.sparkSession.sparkContext.broadcast(ranking)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for b in batches:
            for part in slices(b, at):
                s = r.score(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "s", "p"])

    ddl = ", ".join(f"c{i} {x.dataType.simpleString()}" for i, x in enumerate(docs.schema))
    return map_arrow(docs.toDF(*names), f, f"{ddl}, s double, p int").toDF(*docs.columns, "quality_score", "quality_predicted")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ranking = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality(docs, ranking)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))
