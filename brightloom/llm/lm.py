"""LM scoring by prediction by partial matching, with a word unigram as base."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import Words, held_out, map_arrow, materialize, need, slices

#: Longest context in bytes.
ORDER = 4
END, START, SYMBOLS, BITS = 256, 257, 257, 9
#: Contexts that the broadcast trie has: those seen most often, of all orders. It has all their symbols, and the contexts
#: that end them too, as they are seen at least as often, so it is exact behind a context of ORDER bytes that it has. All
#: other positions meet their probabilities, of the whole model, in a join.
CONTEXTS = 1 << 15
#: Most frequent words whose counts are broadcast (4 MB); the others meet their counts in a join.
HEAD = 1 << 18
#: Values that a task holds before it sends their counts.
FLUSH = 2_000_000
#: The end of a text counts as this word.
END_WORD = 0


def _tally(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    v, c = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
    u, back = np.unique(v, return_inverse=True)
    return u, np.bincount(back, c, len(u)).astype(np.int64)


def _counts(values, names: tuple[str, str]):
    """Texts to (value, count), summed within the task."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        fresh: list[np.ndarray] = []
        n = size = 0

        def fold() -> None:
            nonlocal fresh, n, size
            if fresh:
                u, c = np.unique(np.concatenate(fresh), return_counts=True)
                held.append((u, c))
                size += len(u)
                fresh, n = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal size
            u, c = _tally(held)
            held.clear()
            size = 0
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=list(names))

        for b in batches:
            for part in slices(b, 0):
                fresh.append(values(part.column(0)))
                n += len(fresh[-1])
                if n >= FLUSH:
                    fold()
                if size >= FLUSH:
                    yield from send()
        fold()
        if held:
            yield from send()

    return f


def _words(column: pa.Array) -> np.ndarray:
    w = Words(column, lower=True)
    return np.concatenate([w.hash, np.full(len(w), END_WORD, np.uint64)])


def symbols(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the texts, ORDER starts before and one end after each; the places of bytes and ends; their texts."""
    n, size = len(w), np.diff(w.offsets)
    doc = np.repeat(np.arange(n), size)
    out = np.full(len(w.data) + n * (ORDER + 1), START, np.int64)
    out[np.arange(len(w.data)) + doc * (ORDER + 1) + ORDER] = w.data
    ends = w.offsets[1:] + np.arange(n) * (ORDER + 1) + ORDER
    out[ends] = END
    at = np.flatnonzero(out != START)
    return out, at, np.repeat(np.arange(n), size + 1)


def _mask(n: int) -> int:
    """The bits of the last n symbols of a gram."""
    return (1 << (BITS * n)) - 1


def _codes(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The grams that end at the given places: ORDER symbols and the one there."""
    code = np.zeros(len(at), np.int64)
    for j in range(ORDER, -1, -1):
        code = code << BITS | s[at - j]
    return code


def _grams(column: pa.Array) -> np.ndarray:
    s, at, _ = symbols(Words(column))
    return _codes(s, at).view(np.uint64)


class Trie:
    """Contexts by node, as arrays. Node 0 is the empty context; a node's parent lacks its oldest symbol.

    With n in the context's node: P(s) = c/(T+q) for a symbol seen there c times of T, q symbols being distinct; else the
    escape q/(T+q) and what the parent says of the symbols not seen in n (those are excluded there, so the same formula
    holds with what is left of T and q). The empty context escapes to all symbols not seen at all, equally.
    """

    def __init__(self, order: np.ndarray, code: np.ndarray, node: np.ndarray, symbol: np.ndarray, count: np.ndarray, whole: bool):
        self.whole = whole  # no context is missing
        n = len(order)
        used = np.unique(np.concatenate([symbol, *[(code >> (BITS * j)) & 511 for j in range(ORDER)], [END, START]]))
        self.map = np.full(START + 1, len(used), np.int64)  # symbols not seen share the last column
        self.map[used] = np.arange(len(used))
        width = self.width = len(used) + 1
        key = order.astype(np.int64) << (BITS * ORDER) | code
        by = np.argsort(key)
        below = np.where(order > 0, (order.astype(np.int64) - 1) << (BITS * ORDER) | (code & ((1 << (BITS * np.maximum(order.astype(np.int64) - 1, 0))) - 1)), key)
        parent = by[np.searchsorted(key[by], below)]
        self.child = np.zeros(n * width, np.int32)
        inner = np.flatnonzero(order > 0)
        oldest = code[inner] >> (BITS * (order[inner].astype(np.int64) - 1))
        self.child[parent[inner] * width + self.map[oldest]] = inner
        c = np.zeros((n, width), np.float32)
        c[node, self.map[symbol]] = count
        seen = c > 0
        total, kinds = c.sum(1, dtype=np.float64), seen.sum(1).astype(np.float64)
        left_symbols = max(1.0, SYMBOLS - kinds[0]) if n else 1.0
        below_p = np.full((n, width), 1.0 / left_symbols, np.float32)  # of symbols not seen in the node, after its escape
        logs = np.empty((n, width), np.float32)
        for k in range(ORDER + 1):
            at = np.flatnonzero(order == k)
            for lo in range(0, len(at), 4096):
                m = at[lo : lo + 4096]
                if k:
                    p = parent[m]
                    rest = total[p] - np.where(seen[m], c[p], 0).sum(1, dtype=np.float64)
                    kind = kinds[p] - kinds[m]
                    whole = np.maximum(rest + kind, 1e-300)[:, None]
                    empty = (kind <= 0)[:, None]
                    below_p[m] = np.where(empty, below_p[p], np.where(seen[p], c[p] / whole, kind[:, None] / whole * below_p[p]))
                whole = np.maximum(total[m] + kinds[m], 1e-300)[:, None]
                prob = np.where(seen[m], c[m] / whole, np.where(total[m, None] > 0, kinds[m, None] / whole, 1.0) * below_p[m])
                logs[m] = np.log10(np.maximum(prob, 1e-300))
        self.logs = logs.ravel()

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each text with its end, without the positions the trie can't tell; their texts and grams."""
        w = Words(column)
        s, at, doc = symbols(w)
        raw, s = s, self.map[s]
        node = self.child[s[at - 1]].astype(np.int64)
        live = node > 0
        for j in range(2, ORDER + 1):
            nxt = self.child[node * self.width + s[at - j]]
            live &= nxt > 0
            node = np.where(live, nxt, node)
        logs = self.logs[node * self.width + s[at]].astype(np.float64)
        if self.whole:
            return np.bincount(doc, logs, len(w)), np.empty(0, np.int64), np.empty(0, np.int64)
        return np.bincount(doc, np.where(live, logs, 0.0), len(w)), doc[~live], _codes(raw, at[~live])


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of sorted keys; 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0).astype(np.float64)


def chances(asked: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 probability of each asked gram, as in Trie. levels: of each order, sorted codes with their symbol, and counts."""
    logs, done = np.zeros(len(asked)), np.zeros(len(asked), bool)
    kinds_above, count_above = np.zeros(len(asked)), np.zeros(len(asked))  # of the symbols seen in the longer context
    for k in range(ORDER, -1, -1):
        code, count = levels[k]
        contexts, of = np.unique(code >> BITS, return_inverse=True)
        total, kinds = np.bincount(of, count, len(contexts)), np.bincount(of, minlength=len(contexts))
        gram = asked & _mask(k + 1)
        c, t, q = _lookup(code, count, gram), _lookup(contexts, total, gram >> BITS), _lookup(contexts, kinds, gram >> BITS)
        kind = q - kinds_above
        share = np.where(c > 0, c, kind) / np.maximum(t - count_above + kind, 1)
        logs += np.where(done | (kind <= 0), 0.0, np.log10(np.maximum(share, 1e-300)))
        done |= c > 0
        kinds_above = q
        if k:
            count_above = _lookup(contexts, np.bincount(of, _lookup(*levels[k - 1], code & _mask(k)), len(contexts)), gram >> BITS)
    return logs - np.where(done, 0.0, np.log10(np.maximum(SYMBOLS - kinds_above, 1.0)))


def _chances(shared):
    """Rows (gram, c) of a partition that has all grams of each two last bytes, asked ones with c = 0, to (gram, log)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not held:
            return
        gram, c = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        asked, gram, c = gram[c == 0], gram[c > 0], c[c > 0]
        levels = [*shared.value, *(_tally([(gram & _mask(k + 1), c)]) for k in range(len(shared.value), ORDER + 1))]
        for lo in range(0, len(asked), FLUSH):
            part = asked[lo : lo + FLUSH]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(chances(part, levels))], names=["gram", "log"])

    return f


def gram_logs(asked: DataFrame, model: dict) -> DataFrame:
    """(gram, log) of each asked gram, once, under the whole model.

    Grams of the training texts and asked ones meet by their contexts' last two bytes; the counts of shorter contexts are
    broadcast, which are at most 258 * 257.
    """
    shared = asked.sparkSession.sparkContext.broadcast(model["low"])
    both = model["grams"].select("gram", "c").union(asked.select("gram").distinct().select("gram", F.lit(0).cast("long")))
    both = both.repartition(F.shiftright("gram", BITS).bitwiseAND(F.lit(_mask(2))))
    return materialize(map_arrow(both, _chances(shared), "gram long, log double"), "lm-logs")


def train(docs: DataFrame) -> dict:
    """Counts over all rows of docs (text): word and gram counts (tables), sums, the words' head, and the trie's arrays."""
    words = map_arrow(docs.select("text"), _counts(_words, ("word", "c")), "word long, c long")
    words = materialize(words.groupBy("word").agg(F.sum("c").alias("c")), "lm-words")
    total, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = words.orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    grams = map_arrow(docs.select("text"), _counts(_grams, ("gram", "c")), "gram long, c long")
    grams = materialize(grams.groupBy("gram").agg(F.sum("c").alias("c")), "lm-grams")
    each = None
    for k in range(ORDER + 1):
        cut = grams.select(F.lit(k).alias("k"), F.col("gram").bitwiseAND(F.lit((1 << (BITS * (k + 1))) - 1)).alias("g"), "c")
        cut = cut if k == ORDER else cut.groupBy("k", "g").agg(F.sum("c").alias("c"))
        each = cut if each is None else each.union(cut)
    each = materialize(each.select("k", F.shiftright("g", BITS).alias("ctx"), F.col("g").bitwiseAND(F.lit(511)).alias("s"), "c"), "lm-orders")
    kept = each.groupBy("k", "ctx").agg(F.sum("c").alias("t")).orderBy(F.desc("t"), "k", "ctx").limit(CONTEXTS).select(F.col("k").alias("k2"), F.col("ctx").alias("ctx2"))
    found = each.join(F.broadcast(kept), (F.col("k") == F.col("k2")) & (F.col("ctx") == F.col("ctx2"))).select("k", "ctx", "s", "c").toArrow()
    k, ctx, s, c = (found[x].to_numpy().astype(np.int64) for x in ("k", "ctx", "s", "c"))
    if not len(k):
        k, ctx, s, c = np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([START]), np.zeros(1, np.int64)
    key, node = np.unique(k << (BITS * ORDER) | ctx, return_inverse=True)  # node 0: order 0
    arrays = (key >> (BITS * ORDER), key & ((1 << (BITS * ORDER)) - 1), node, s, c)
    short = each.where("k < 2").toArrow()
    k2, g2, c2 = short["k"].to_numpy(), short["ctx"].to_numpy() << BITS | short["s"].to_numpy(), short["c"].to_numpy()
    low = [_tally([(g2[k2 == n], c2[k2 == n])]) for n in range(2)]
    h = head["word"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return {"words": words, "total": total, "kinds": kinds, "head": (h[order], head["c"].to_numpy()[order]), "trie": arrays, "whole": len(key) < CONTEXTS, "grams": grams, "low": low}


_TRIES: dict[str, Trie] = {}


def _lists(doc: np.ndarray, value: np.ndarray, n: int) -> list[pa.Array]:
    """The distinct values of each of n texts, and how often each is there."""
    by = np.lexsort((value, doc))
    doc, value = doc[by], value[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    cuts = pa.array(np.searchsorted(doc[first], np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (value[first], np.diff(np.append(first, len(doc))).astype(np.int32))]


def _score(shared, key: str, keep: list[str]):
    """Rows (text, ...) to (..., tokens, known and log sum of the head's words, score of the trie's positions, and the
    other words and the other positions' grams with counts)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if key not in _TRIES:
            _TRIES.clear()
            _TRIES[key] = Trie(*model["trie"], model["whole"])
        trie, (head, c), total, kinds = _TRIES[key], model["head"], model["total"], model["kinds"]
        floor = total + 0.5 * (kinds + 1)
        logs = np.log10((c + 0.5) / floor)
        end = np.searchsorted(head, np.uint64(END_WORD))
        end_known = len(head) > end and head[end] == END_WORD
        end_log = logs[end] if end_known else np.log10(0.5 / floor)
        for b in batches:
            for part in slices(b, 0):
                w = Words(part.column(0), lower=True)
                n, doc = len(w), w.of_doc()
                at = np.minimum(np.searchsorted(head, w.hash), max(0, len(head) - 1))
                known = head[at] == w.hash if len(head) else np.zeros(len(w.hash), bool)
                base = np.bincount(doc[known], logs[at[known]], n) + end_log
                n_known = np.bincount(doc[known], minlength=n) + int(end_known)
                score, of, gram = trie.score(part.column(0))
                rest = [*_lists(doc[~known], w.hash[~known].view(np.int64), n), *_lists(of, gram, n)]
                out = [pa.array(np.diff(w.range) + 1, pa.int64()), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score), *rest]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *out], names=[*keep, "_n", "_known", "_base", "_score", "_h", "_t", "_g", "_u"])

    return f


def lm_score(docs: DataFrame, model: dict) -> DataFrame:
    """Scores whole texts: docs without text, with n_tokens, n_known, train_tokens long, base_score and score double.

    Tokens are the words, A-Z lower-cased, and one end. base_score: sum of log10((c + 0.5) / (N + 0.5 * (V + 1))) with
    counts over all training texts. score: log10 probability of the text's bytes and its end under the counts of all
    contexts, which do not adapt to the text. Columns of those names in docs are replaced. A null text is empty: its only token is the end.
    Repeated rows get equal scores. With no training text all counts are 0. An empty table gives an empty result.

    Words are known by 64-bit hashes. The counts of the head's words and the trie are broadcast (a fixed number); the other
    words and byte grams of each document meet theirs in joins whose volume is in proportion to the documents.
    """
    need(docs, text="string")
    docs = docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = [c for c in docs.columns if c != "text"]
    names = {c: f"c{i}" for i, c in enumerate(keep)}
    fields = "".join(f"{names[x.name]} {x.dataType.simpleString()}, " for x in docs.schema if x.name != "text")
    small = {x: model[x] for x in ("total", "kinds", "head", "trie", "whole")}
    shared = docs.sparkSession.sparkContext.broadcast(small)
    lean = docs.select("text", *[F.col(c).alias(n) for c, n in names.items()])
    key = uuid.uuid4().hex
    scored = map_arrow(lean, _score(shared, key, list(names.values())), f"{fields}_n long, _known long, _base double, _score double, _h array<long>, _t array<int>, _g array<long>, _u array<int>")
    scored = materialize(scored.withColumn("_row", F.monotonically_increasing_id()), "lm-scored")
    floor = F.lit(model["total"] + 0.5 * (model["kinds"] + 1))
    listed = lambda v, n: scored.where(F.size(v) > 0).select(F.col("_row").alias("_r"), F.explode(F.arrays_zip(v, n)).alias("x")).select("_r", F.col(f"x.{v}").alias("v"), F.col(f"x.{n}").alias("t"))
    words = listed("_h", "_t").join(model["words"], F.col("v") == F.col("word"), "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / floor)
    rest = words.select("_r", (F.col("t") * log).alias("more"), F.when(F.col("c") > 0, F.col("t")).otherwise(0).alias("some"), F.lit(0.0).alias("deep"))
    if not model["whole"]:
        grams = listed("_g", "_u")
        logs = gram_logs(grams.select(F.col("v").alias("gram")), model)
        grams = grams.join(logs, F.col("v") == F.col("gram"))
        rest = rest.union(grams.select("_r", F.lit(0.0), F.lit(0), F.col("t") * F.col("log")))
    rest = rest.groupBy("_r").agg(F.sum("more").alias("more"), F.sum("some").alias("some"), F.sum("deep").alias("deep"))
    out = scored.drop("_h", "_t", "_g", "_u").join(rest, F.col("_row") == F.col("_r"), "left")
    return out.select(
        *[F.col(n).alias(c) for c, n in names.items()],
        F.col("_n").alias("n_tokens"),
        (F.col("_known") + F.coalesce("some", F.lit(0))).alias("n_known"),
        F.lit(model["total"]).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("_score") + F.coalesce("deep", F.lit(0.0))).alias("score"),
    )


def op8_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 5, 1))
    return lm_score(docs, train(docs.where(~F.col("held_out"))))
