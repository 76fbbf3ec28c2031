"""Language ID by unigrams over the pieces of a public vocabulary, with all segmentations summed."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import _BASE, _BYTE, Words, collect_small, held_out, map_arrow, materialize, mix64, need, slices

#: Training documents of each language, about; all their words count.
SAMPLE = 1_000
ROUNDS, FLOOR = 3, 1e-7
LANGUAGES = 1_000
#: Probabilities that a forward pass holds at once, of all words, languages and places; and places between two scalings.
HELD, SCALE = 1 << 22, 8


@functools.cache
def vocabulary(path: str) -> tuple[bytes, ...]:
    """All pieces of the sentencepiece model at path that can be part of a word, a word's opening written as a space; and
    the single bytes, which its byte pieces stand for."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    found = {p.replace("▁", " ").encode() for p in pieces}
    return tuple(sorted({p for p in found if b" " not in p[1:]} | {b" "} | {bytes([i]) for i in range(256)}))


class Pieces:
    """Finds pieces in texts: by length and by whether they open a word, sorted hashes and row numbers."""

    def __init__(self, path: str):
        self.pieces = vocabulary(path)
        self.n = len(self.pieces)  # row n stands for no piece
        self.space = self.pieces.index(b" ")
        by: dict[tuple[bool, int], list[tuple[bytes, int]]] = {}
        for i, p in enumerate(self.pieces):
            opens = p[:1] == b" " and len(p) > 1
            body = p[1:] if opens else p
            by.setdefault((opens, len(body)), []).append((body, i))
        self.tables = {}
        for k, rows in by.items():
            h = np.array([self._hash(b) for b, _ in rows], np.uint64)
            h = mix64(h + np.uint64(k[1]))
            order = np.argsort(h)
            self.tables[k] = h[order], np.array([i for _, i in rows])[order]
        self.lengths = sorted({k for _, k in by} - {0})

    @staticmethod
    def _hash(b: bytes) -> int:
        return sum(int(_BYTE[c]) * pow(int(_BASE), j, 1 << 64) for j, c in enumerate(b)) % (1 << 64)

    def find(self, w: Words, start: np.ndarray, size: int, opens: bool) -> np.ndarray:
        table = self.tables.get((opens, size))
        if table is None:
            return np.full(len(start), self.n)
        h = w.part(start, start + size)
        at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
        return np.where(table[0][at] == h, table[1][at], self.n)


@functools.cache
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def forward(pieces: Pieces, p: np.ndarray, w: Words, at: np.ndarray) -> np.ndarray:
    """Log probability of each word for each language: the sum over all its segmentations into pieces.

    p: probabilities, a row for each piece and a last row of zeros, a column for each language. Only as many places of a
    word are held as the longest piece has bytes; they are scaled as they shrink, so words may have any length.
    """
    out = np.zeros((len(at), p.shape[1]))
    ring = pieces.lengths[-1] + 1
    order = np.argsort(-(w.end[at] - w.start[at]), kind="stable")
    many = max(64, HELD // (ring * p.shape[1]))
    for lo in range(0, len(order), many):
        o = order[lo : lo + many]
        s, n = w.start[at[o]], w.end[at[o]] - w.start[at[o]]
        held = np.zeros((ring, len(o), p.shape[1]))
        held[0] = 1.0
        scale = np.zeros((len(o), p.shape[1]))
        for pos in range(int(n[0]) + 1):
            live = int(np.searchsorted(-n, -pos, "left"))
            ends = int(np.searchsorted(-n, -pos, "right"))
            here = held[pos % ring]
            out[o[live:ends]] = np.log(here[live:ends]) + scale[live:ends]
            for k in pieces.lengths:
                fits = int(np.searchsorted(-n, -(pos + k), "right"))
                if not fits:
                    break
                q = p[pieces.find(w, s[:fits] + pos, k, False)]
                if pos == 0:
                    q = q * p[pieces.space] + p[pieces.find(w, s[:fits], k, True)]
                held[(pos + k) % ring, :fits] += here[:fits] * q
            here[:] = 0
            if pos % SCALE == SCALE - 1 and live:
                most = held[:, :live].max(0)
                held[:, :live] /= most
                scale[:live] += np.log(most)
    return out


def start(pieces: Pieces, langs: int) -> np.ndarray:
    """Piece probabilities before the first round, a column for each language."""
    p = np.full((pieces.n + 1, langs), 1.0 / pieces.n)
    p[-1] = 0
    lengths = np.array([len(x) for x in pieces.pieces])
    p[:-1] *= 0.25 ** (1.0 / np.maximum(lengths, 1))[:, None]
    return p


def expect(pieces: Pieces, p: np.ndarray, words: pa.Array, counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in one language, over all segmentations of the words, which are there so often.

    Forward and backward sums are logarithms, one for each byte of the words.
    """
    w = Words(words)
    with np.errstate(divide="ignore"):
        log_p = np.log(p)
    total = np.zeros_like(p)
    for lo in range(0, len(w.start), 20_000):
        first, size = w.start[lo : lo + 20_000], (w.end - w.start)[lo : lo + 20_000]
        by = np.argsort(-size, kind="stable")
        first, size, n = first[by], size[by], counts[w.of_doc()[lo : lo + 20_000]][by]
        row = np.cumsum(size + 1) - size - 1  # a word's sums stand together
        before = np.full(int((size + 1).sum()), -np.inf)
        before[row] = 0.0
        after = np.full(len(before), -np.inf)
        after[row + size] = 0.0

        def uses(pos: int, k: int, first=first, size=size):
            """Words that have a piece of k bytes at pos, its number and log probability, first within a word, then as its opening."""
            fits = int(np.searchsorted(-size, -(pos + k), "right"))
            ids = pieces.find(w, first[:fits] + pos, k, False)
            out = [(ids, log_p[ids] + (log_p[pieces.space] if pos == 0 else 0.0))]
            if pos == 0:
                ids = pieces.find(w, first[:fits], k, True)
                out.append((ids, log_p[ids]))
            for ids, q in out:
                some = np.flatnonzero(ids < pieces.n)
                yield some, ids[some], q[some]

        for pos in range(int(size[0])):
            for k in pieces.lengths:
                if k > size[0] - pos:
                    break
                for some, _, q in uses(pos, k):
                    to = row[some] + pos + k
                    before[to] = np.logaddexp(before[to], before[row[some] + pos] + q)
        whole = before[row + size]
        for pos in range(int(size[0]) - 1, -1, -1):
            for k in pieces.lengths:
                if k > size[0] - pos:
                    break
                for some, ids, q in uses(pos, k):
                    at = row[some] + pos
                    q = q + after[at + k]
                    after[at] = np.logaddexp(after[at], q)
                    used = np.exp(before[at] + q - whole[some]) * n[some]
                    np.add.at(total, ids, used)
                    if pos == 0:
                        total[pieces.space] += used[[pieces.pieces[i][:1] != b" " for i in ids.tolist()]].sum()
    return total


def settle(total: np.ndarray) -> np.ndarray:
    """Probabilities from expected uses."""
    total[-1] = 0
    p = total / np.maximum(total.sum(0), 1e-300) + FLOOR
    p[-1] = 0
    return p


def _expect(shared):
    """Rows (lang, word, n) to (lang, piece, uses), summed within the task; lang as a number."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, p = shared.value
        pieces = pieces_of(path)
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            lang = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(lang)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                at, part = int(lang[lo]), b.slice(lo, hi - lo)
                uses = expect(pieces, p[:, at], part.column(1), part.column(2).to_numpy().astype(float))
                totals[at] = totals[at] + uses if at in totals else uses
        for at, total in totals.items():
            used = np.flatnonzero(total[:-1] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), at, np.int32)), pa.array(used.astype(np.int32)), pa.array(total[used])], names=["lang", "piece", "uses"])

    return f


def learn(counted: DataFrame, path: str, langs: int, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of each language by expectation maximisation over all segmentations of all words.

    counted: lang int (from 0), word binary, n long, rows of a language together. Words stay where they are; the driver
    sees the expected uses of pieces only, at most the vocabulary for each language.
    """
    pieces = pieces_of(path)
    p = start(pieces, langs)
    for _ in range(rounds):
        shared = counted.sparkSession.sparkContext.broadcast((path, p))
        uses = map_arrow(counted, _expect(shared), "lang int, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toArrow()
        total = np.zeros_like(p)
        total[uses["piece"].to_numpy(), uses["lang"].to_numpy()] = uses["uses"].to_numpy()
        p = settle(total)
        shared.destroy()
    return p


def _count_words():
    """Rows (text, lang) to (lang, word, n) of each batch part."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 0):
                w = Words(part.column(0), letters=True)
                names, lang = np.unique(np.array(part.column(1).to_pylist(), object).astype(str), return_inverse=True)
                out: tuple[list, list, list] = ([], [], [])
                for i, name in enumerate(names):
                    at = np.flatnonzero(lang[w.of_doc()] == i)
                    _, first, n = np.unique(w.hash[at], return_index=True, return_counts=True)
                    out[0].extend([name] * len(n))
                    out[1].extend(w.data[a:z].tobytes() for a, z in zip(w.start[at[first]], w.end[at[first]], strict=True))
                    out[2].extend(n.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], names=["lang", "word", "n"])

    return f


def train(docs: DataFrame, path: str, sample: int = SAMPLE) -> dict:
    """A model from text and lang of the documents that are not held out: about ``sample`` of each language, drawn by hash."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    sizes = {r["lang"]: r["count"] for r in collect_small(own.groupBy("lang").count(), LANGUAGES, "languages")}
    langs = sorted(sizes)
    if not langs:
        return {"path": path, "langs": [], "p": None, "prior": None}
    spark = docs.sparkSession
    share = spark.createDataFrame([(x, i, min(1.0, sample / sizes[x])) for i, x in enumerate(langs)], "l string, i int, share double")
    drawn = own.join(F.broadcast(share), F.col("lang") == F.col("l")).where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)) < F.col("share"))
    counted = map_arrow(drawn.select("text", "lang"), _count_words(), "lang string, word binary, n long")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).join(F.broadcast(share), F.col("lang") == F.col("l"))
    counted = materialize(counted.select(F.col("i").alias("lang"), "word", "n").coalesce(2 * len(langs)).sortWithinPartitions("lang", "word"), "language-words")
    total = sum(sizes.values())
    return {"path": path, "langs": langs, "p": learn(counted, path, len(langs)), "prior": np.log([sizes[x] / total for x in langs])}


class Scorer:
    """Scores texts; words that were seen before are remembered."""

    def __init__(self, model: dict):
        self.model, self.pieces = model, pieces_of(model["path"])
        self.most = min(400_000, 4 * HELD // max(1, len(model["langs"])))
        self.known = np.empty(0, np.uint64)
        self.logs = np.empty((0, len(model["langs"])))

    def words(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(row of logs for each word, logs)."""
        h, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        new = self.known[at] != h if len(self.known) else np.ones(len(h), bool)
        logs = np.empty((len(h), len(self.model["langs"])))
        logs[~new] = self.logs[at[~new]]
        logs[new] = forward(self.pieces, self.model["p"], w, first[new])
        if len(self.known) + new.sum() > self.most:
            self.known, self.logs = h, logs
        elif new.any():
            both = np.concatenate([self.known, h[new]])
            order = np.argsort(both, kind="stable")
            self.known, self.logs = both[order], np.concatenate([self.logs, logs[new]])[order]
        return back, logs

    def score(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        w = Words(column, letters=True)
        n, langs = len(w), self.model["langs"]
        ascii_letter = np.concatenate([[0], np.cumsum(((w.data | 32) >= 97) & ((w.data | 32) <= 122))])
        letter = ascii_letter[w.offsets[1:]] > ascii_letter[w.offsets[:-1]]
        for i in np.flatnonzero(~letter & (np.diff(w.offsets) > 0)):
            letter[i] = any(c.isalpha() for c in w.data[w.offsets[i] : w.offsets[i + 1]].tobytes().decode("utf-8", "replace"))
        if not langs:
            return ["und"] * n, np.zeros(n)
        total = np.tile(self.model["prior"], (n, 1))
        if len(w.hash):
            row, logs = self.words(w)
            doc = w.of_doc()
            total += np.stack([np.bincount(doc, logs[row, k], n) for k in range(len(langs))], 1)
        best = total.argmax(1)
        score = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [langs[b] if ok else "und" for b, ok in zip(best.tolist(), letter.tolist(), strict=True)], np.where(letter, score, 0.0)


def language(docs: DataFrame, model: dict) -> DataFrame:
    """Predicts each whole text's language: docs with lang_pred string and lang_score double (0 to 1, its posterior).

    docs: text and any other columns, all kept; the two added ones are replaced if there. A text that is null, empty or
    has no letter is ``und`` with score 0, as is all where nothing was learnt. Words are runs of letters and
    digits as they stand, of any length. Ties go to the first language by code point. Repeated rows
    get equal results; an empty table gives an empty one. The model's size is that of the vocabulary times the languages.
    """
    need(docs, text="string")
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            for part in slices(b, at):
                pred, score = scorer.score(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*names, "p", "s"])

    ddl = ", ".join(f"c{i} {x.dataType.simpleString()}" for i, x in enumerate(docs.schema))
    return map_arrow(docs.toDF(*names), f, f"{ddl}, p string, s double").toDF(*docs.columns, "lang_pred", "lang_score")


def op10_language(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    out = language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
