"""Substring dedup with suffix automata of reference shards."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import Words, binary, grams, map_arrow, materialize, mix64, need, slices

WINDOW = 13
#: Words of the sampled grams; a window's anchor is the gram with the least hash of the WINDOW - ANCHOR + 1 in it.
ANCHOR = 5
#: The broadcast filter of repeated anchors has this many bits (16 MB), whatever the input: false positives cost work, not results.
FILTER_BITS = 27
HASH_BITS = 48
#: Anchors that a task holds before it sends them.
FLUSH = 4_000_000
#: Words of the fragments that one automaton is built from, on average.
SHARD_WORDS = 100_000
#: A fragment has at most so many windows; their marks are the bits of half a long.
RUN = 32
#: An anchor with more fragments than this (or a ten-thousandth of all) is dealt out by whole windows instead.
HOT_ANCHOR = 20_000


def anchors(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """The anchor of each window: equal windows have equal anchors."""
    m = grams(h, anchor)
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    left, span = window - anchor + 1, 1
    while span * 2 <= left:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < left:
        m = np.minimum(m[: len(m) - (left - span)], m[left - span :])
    return m[:n]


def _slots(m: np.ndarray) -> np.ndarray:
    return mix64(m) >> np.uint64(64 - HASH_BITS)


def _pack(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    raw = np.zeros((len(b) * 8 // HASH_BITS, 8), np.uint8)
    raw[:, : HASH_BITS // 8] = np.frombuffer(b, np.uint8).reshape(-1, HASH_BITS // 8)
    return raw.view("<u8").ravel()


def _count(parts: int, window: int):
    """Texts to rows (part, once, more): hashes of anchors that the task saw in one document and in more."""
    shift = np.uint64(HASH_BITS - parts.bit_length() + 1)

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        u, c = np.unique(np.concatenate(held), return_counts=True)
        part = (u >> shift).astype(np.int64)
        cuts = np.searchsorted(part, np.arange(parts + 1))
        rows = [(p, u[a:b], c[a:b] > 1) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([_pack(r[1][~r[2]]) for r in rows], pa.binary()), pa.array([_pack(r[1][r[2]]) for r in rows], pa.binary())], names=["part", "once", "more"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for part in slices(b, 0, most_rows=1 << 15):
                w = Words(part.column(0))
                m = anchors(w.hash, window)
                ok = w.whole(window)
                doc = w.of_doc()[: len(m)][ok].astype(np.uint64)
                held.append(np.unique(doc << np.uint64(HASH_BITS) | _slots(m[ok])) & np.uint64((1 << HASH_BITS) - 1))
                n += len(held[-1])
                if n >= FLUSH:
                    yield from send(held)
                    held, n = [], 0
        if n:
            yield from send(held)

    return f


def _repeated(parts: int):
    """The filter's bits for the anchors of one part that are in more than one document."""
    bits = FILTER_BITS - (parts.bit_length() - 1)

    def f(table: pa.Table) -> pa.Table:
        once = [_unpack(x) for x in table["once"].to_pylist()]
        more = [_unpack(x) for x in table["more"].to_pylist()]
        u, c = np.unique(np.concatenate(once), return_counts=True)
        u = np.concatenate([u[c > 1], *more])
        flags = np.zeros(1 << bits, bool)
        flags[((u >> np.uint64(HASH_BITS - FILTER_BITS)) & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
        return pa.table({"part": table["part"][:1], "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    return f


def repeated_filter(texts: DataFrame, window: int) -> bytes:
    """A bit for each slot whose anchors are in more than one row. Of fixed size; every task owns a slice of it."""
    parts = 1 << min(14, max(4, (2 * texts.rdd.getNumPartitions() - 1).bit_length()))
    counted = map_arrow(texts, _count(parts, window), "part int, once binary, more binary")
    found = counted.groupBy("part").applyInArrow(_repeated(parts), "part int, bits binary").collect()
    whole, size = bytearray((1 << FILTER_BITS) // 8), (1 << FILTER_BITS) // 8 // parts
    for r in found:
        whole[r["part"] * size : (r["part"] + 1) * size] = r["bits"]
    return bytes(whole)


def _mark(keep: list[str], shared, window: int, digest: bool):
    """Adds to each document the fragments that may repeat: starts, numbers of windows, anchors."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            for part in slices(b, 1):
                w = Words(part.column(1))
                m = anchors(w.hash, window)
                slot = (_slots(m) >> np.uint64(HASH_BITS - FILTER_BITS)).astype(np.int64)
                doc = w.of_doc()[: len(m)]
                known = part.column(0).is_valid().to_numpy(zero_copy_only=False)
                may = ((bits[slot >> 3] >> (slot & 7)) & 1).astype(bool) & w.whole(window) & known[doc]
                at = np.flatnonzero(may)
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(at) != 1) | (m[at[1:]] != m[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) if len(at) else at
                first = np.flatnonzero(new | (run % RUN == 0))
                cuts = pa.array(np.searchsorted(doc[at[first]], np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [(at[first] - w.range[doc[at[first]]], np.int32), (np.diff(np.append(first, len(at))), np.int32), (m[at[first]].view(np.int64), np.int64)]
                out = [pa.array(np.diff(w.range), pa.int64()), *(pa.ListArray.from_arrays(cuts, pa.array(x.astype(t))) for x, t in lists)]
                if digest:
                    some = np.diff(cuts.to_numpy()) > 0
                    raw = binary(part.column(1))
                    sha = [None if x else hashlib.sha256(b" ".join(t.split())).hexdigest() for x, t in zip(some.tolist(), raw, strict=True)]
                    text = pa.array([t.decode("utf-8", "replace") if x else None for x, t in zip(some.tolist(), raw, strict=True)], pa.string())
                    out += [pa.array(sha, pa.string()), text]
                else:
                    out += [pa.nulls(part.num_rows, pa.string()), part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], *out], names=["_id", *keep, "_n", "_starts", "_sizes", "_keys", "_sha", "_text"])

    return f


def _fragments(hot: frozenset[int], window: int, shards: int, contents: bool):
    """Marked documents to rows of fragments: their places (contents False) or, once for each task, their words."""

    def pieces(words: list[bytes], starts, sizes, keys):
        for s, n, k in zip(starts, sizes, keys, strict=True):
            if k in hot:
                for i in range(s, s + n):
                    c = b" ".join(words[i : i + window])
                    yield i, 1, xxhash.xxh3_64_intdigest(c), c
            else:
                yield s, n, k, b" ".join(words[s : s + n + window - 1])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, tuple[int, int]] = {}

        def send() -> Iterator[pa.RecordBatch]:
            by: dict[int, list[bytes]] = {}
            for c, (shard, _) in first.items():
                by.setdefault(shard, []).append(c)
            blobs = [_squeeze(np.array([first[c][1] for c in cs], "<i8").tobytes() + b"\n".join(cs)) for cs in by.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array([len(x) for x in by.values()], pa.int32()), pa.array([x[0] for x in blobs], pa.int32()), pa.array([x[1] for x in blobs], pa.binary())], names=["shard", "n", "size", "blob"])
            first.clear()

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [[], [], [], []]
                for doc, rid, raw, *lists in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), binary(part.column(2)), *(part.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                    for s, n, k, c in pieces(raw.split(), *lists):
                        if contents:
                            old = first.get(c)
                            if old is None or doc < old[1]:
                                first[c] = (k % shards, doc)
                        else:
                            for x, v in zip(rows, (rid, doc, s, xxhash.xxh3_128_digest(c)), strict=True):
                                x.append(v)
                if not contents and rows[0]:
                    key = np.frombuffer(b"".join(rows[3]), "<i8").reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(key[:, 0]), pa.array(key[:, 1])], names=["_rid", "doc", "start", "f1", "f2"])
                if len(first) > 200_000:
                    yield from send()
        if first:
            yield from send()

    return f


def _squeeze(raw: bytes) -> tuple[int, bytes]:
    return len(raw), pa.Codec("zstd").compress(raw, asbytes=True)


class SuffixAutomaton:
    """Of word sequences added in ascending order of document: each state knows the first document it occurs in."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def _state(self, length: int, nxt: dict, link: int, first: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, p: int, c: bytes, q: int) -> int:
        nxt, link = self.next, self.link
        clone = self._state(self.length[p] + 1, nxt[q].copy(), link[q], self.first[q])
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def add(self, words: list[bytes], doc: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in words:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
                continue
            cur, p = self._state(length[last] + 1, {}, 0, doc), last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = cur

    def firsts(self, words: list[bytes], window: int) -> list[int | None]:
        """Matching statistics, cut at the window: for each window of words the first document that has it."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        v = n = 0
        out: list[int | None] = []
        for i, c in enumerate(words):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v, n = nxt[v][c], n + 1
            while v and length[link[v]] >= window:
                v = link[v]
                n = length[v]
            if i + 1 >= window:
                out.append(first[v] if n >= window else None)
        return out


def _match(window: int):
    """One shard: an automaton of its fragments, through which each of them is streamed."""

    def f(table: pa.Table) -> pa.Table:
        first: dict[bytes, int] = {}
        for n, size, blob in zip(table["n"].to_pylist(), table["size"].to_pylist(), table["blob"].to_pylist(), strict=True):
            raw = pa.Codec("zstd").decompress(blob, size, asbytes=True)
            for c, d in zip(raw[8 * n :].split(b"\n"), np.frombuffer(raw[: 8 * n], "<i8").tolist(), strict=True):
                if c not in first or d < first[c]:
                    first[c] = d
        ordered = sorted(first.items(), key=lambda x: x[1])
        gc.disable()  # states hold no cycles
        try:
            sam = SuffixAutomaton()
            for c, d in ordered:
                sam.add(c.split(b" "), d)
            found = [sam.firsts(c.split(b" "), window) for c, _ in ordered]
        finally:
            gc.enable()
        key = np.frombuffer(b"".join([xxhash.xxh3_128_digest(c) for c, _ in ordered]), "<i8").reshape(-1, 2)
        return pa.table({"g1": pa.array(key[:, 0]), "g2": pa.array(key[:, 1]), "firsts": pa.array(found, pa.list_(pa.int64()))})

    return f


def _cut(keep: list[str], window: int, digest: bool):
    """Removes the marked windows' words."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(keep)
        for b in batches:
            removed, out = [], []
            n = b.column(k).to_pylist()
            for raw, own, sha, spans in zip(binary(b.column(k + 2)), b.column(k + 2), b.column(k + 1).to_pylist(), b.column(k + 3).to_pylist(), strict=True):
                if not spans:
                    removed.append(0)
                    out.append((sha if sha is not None else hashlib.sha256(b" ".join(raw.split())).hexdigest()) if digest else own.as_py())
                    continue
                w = raw.split()
                code = np.array(spans, np.int64)  # a fragment's start, and a bit for each of its windows
                row, offset = np.nonzero((code[:, None] >> np.arange(RUN)) & 1)
                at = (code >> 32)[row] + offset
                edge = np.bincount(at, minlength=len(w) + 1) - np.bincount(at + window, minlength=len(w) + 1)
                gone = np.cumsum(edge)[:-1] > 0
                removed.append(int(gone.sum()))
                kept = b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g])
                out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], names=[*keep, "n_words", "n_removed", "kept_sha256" if digest else "text"])

    return f


def substring_dedup(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """Removes each word that a window covers whose word sequence also starts in a document with a smaller doc_id.

    docs: doc_id long, text, and any other columns. Returns the other columns with n_words, n_removed and, with digest,
    kept_sha256 (of the kept words joined by a space), else text: as it was where nothing was removed, else the kept
    words joined by a space. Columns of those names in docs are replaced. Windows are judged on the input. A null text
    has no words; a document with a null id keeps all and precedes none; rows of equal id do not remove from each other.
    Empty tables give empty results.

    1. A window's anchor is its gram of least hash. Tasks count anchors; those in more than one document set bits of a
       filter of fixed size, which is broadcast. A filter that fills up makes more work, never other results.
    2. Runs of windows with one anchor that passes the filter are fragments; equal windows meet under equal anchors.
    3. Distinct fragments (each task sends a fragment once, with its first document) go to the shard of their anchor,
       where a suffix automaton is built from them and all are streamed through it for matching statistics cut at the
       window. Nothing depends on a hash here: words are compared. Anchors with very many fragments go by whole windows.
    4. Places are joined to the answers (a skewed fragment's places can be split), and spans are cut out.
    """
    need(docs, doc_id="long", text="string")
    docs = docs.drop("n_words", "n_removed", *(["kept_sha256"] if digest else []))
    keep = [c for c in docs.columns if c != "text"]
    names = {c: f"c{i}" for i, c in enumerate(keep)}
    fields = ", ".join(f"{names[x.name]} {x.dataType.simpleString()}" for x in docs.schema if x.name != "text")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(repeated_filter(docs.where("doc_id is not null").select("text"), window))
    lean = docs.select(F.col("doc_id").cast("long").alias("_id"), "text", *[F.col(c).alias(names[c]) for c in keep])
    marked = map_arrow(lean, _mark(list(names.values()), shared, window, digest), f"_id long, {fields}, _n long, _starts array<int>, _sizes array<int>, _keys array<long>, _sha string, _text string")
    marked = materialize(marked.withColumn("_rid", F.monotonically_increasing_id()), "sub-marked")
    some = marked.where(F.size("_starts") > 0).select("_id", "_rid", "_text", "_starts", "_sizes", "_keys")
    total = some.agg(F.coalesce(F.sum(F.size("_starts")), F.lit(0)), F.coalesce(F.sum(F.aggregate("_sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    shards = max(8, (total[1] + total[0] * (window - 1)) // SHARD_WORDS + 1)
    limit = max(HOT_ANCHOR, total[0] // 10_000)
    hot = some.select(F.explode("_keys").alias("k")).groupBy("k").count().where(F.col("count") > limit).select("k").collect() if total[0] > limit else []
    hot = frozenset(r["k"] for r in hot)  # at most 10,000
    contents = map_arrow(some, _fragments(hot, window, shards, True), "shard int, n int, size int, blob binary")
    answers = contents.groupBy("shard").applyInArrow(_match(window), "g1 long, g2 long, firsts array<long>")
    places = map_arrow(some, _fragments(hot, window, shards, False), "_rid long, doc long, start int, f1 long, f2 long")
    hits = places.join(answers, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")))
    bit = lambda acc, i: acc.bitwiseOR(F.when(F.get("firsts", i) < F.col("doc"), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    bits = F.aggregate(F.sequence(F.lit(0), F.size("firsts") - 1), F.lit(0).cast("long"), bit)
    hits = hits.select("_rid", "start", bits.alias("bits")).where("bits <> 0")
    spans = hits.groupBy(F.col("_rid").alias("_r")).agg(F.collect_list(F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("bits"))).alias("_spans"))
    whole = marked.join(spans, F.col("_rid") == F.col("_r"), "left").select(*names.values(), "_n", "_sha", "_text", "_spans")
    last = "kept_sha256" if digest else "text"
    out = map_arrow(whole, _cut(list(names.values()), window, digest), f"{fields}, n_words long, n_removed long, {last} string")
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], "n_words", "n_removed", last)


def op9_substrings(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs, digest=True)
