"""BPE encoding and decoding by tree concatenation."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import binary, map_arrow, materialize, need

#: Bytes of unsplit text that one leaf of the tree encodes; longer ones are halved, wherever the middle falls.
LEAF = 512
#: Characters of a document from which its parts become rows of their own, encoded by different tasks.
SEGMENT_CHARS = 1 << 18
#: Words that a worker remembers (some 200 bytes each), and words that are encoded in one text.
CACHE_WORDS, FILL = 600_000, 1_000
#: Equal neighbouring tokens on each side of a join that settle it.
AGREE = 4
WINDOW = 32
SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: Behind a letter or digit, before punctuation: neither normal forms nor the pre-tokenizer's pattern reach over this.
SAFE = re.compile(r"(?<=[A-Za-z0-9\u4e00-\u9fff])(?=[!-/:-@\[-`{-~\u3001\u3002\uff0c])")
#: Kinds of rows that a long document becomes.
WORDS, PIECES, CHUNK = 0, 1, 2


@functools.cache
def load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Encoder:
    """Encodes whole texts exactly as the library does, long unsplit text from halves.

    The pre-tokenizer drops white space, so that words between ASCII white space are encoded each for itself, and the short
    ones are remembered. A longer run is normalised and pre-tokenized as a whole, as marks may compose over any cut. What
    is then left unsplit is a sequence of bytes; one of over ``leaf`` is halved and its halves are encoded for themselves.
    At the join a window grows in both directions until AGREE tokens on either side are those that the halves have at the
    same place. A token sequence is the merge result of its text if each two neighbours are (the merges are ordered pairs),
    so the rest stays valid; a window that reaches an end needs no agreement there.
    """

    def __init__(self, path: str, leaf: int = LEAF):
        self.tok, self.leaf = load(path), leaf
        self.model, self.normalizer, self.pre = self.tok.model, self.tok.normalizer, self.tok.pre_tokenizer
        if [len(self._library(x)) for x in ("a", "a a", " a\u00a0\n")] != [1, 2, 1]:
            raise ValueError(f"{path}: its pre-tokenizer keeps white space")
        self.cache: dict[bytes, bytes] = {}
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.names, self.numbers = [self.tok.id_to_token(i) for i in range(size)], [str(i) for i in range(size)]
        suffix = self.model.end_of_word_suffix or ""
        self.length = [len(n.removesuffix(suffix)) for n in self.names]
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.marks = re.compile("|".join(f"({re.escape(x)})" for x in self.special) or "(?!)")

    def _library(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _merge(self, piece: str) -> list[int]:
        return [x.id for x in self.model.tokenize(piece)]

    def split(self, text: str) -> Iterator[str]:
        """A run's special tokens, and what the pre-tokenizer leaves unsplit between them."""
        for part in self.marks.split(text):
            if part in self.special:
                yield part
            elif part:
                yield from [x for x, _ in self.pre.pre_tokenize_str(self.normalizer.normalize_str(part) if self.normalizer else part)]

    def piece(self, text: str) -> list[int]:
        """Ids of unsplit text, by halves."""
        if len(text) <= self.leaf:
            return [self.special[text]] if text in self.special else self._merge(text)
        mid = len(text) // 2
        return self.join(text, mid, self.piece(text[:mid]), self.piece(text[mid:]))

    def join(self, text: str, mid: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of text from those of text[:mid] and text[mid:]."""
        w = WINDOW
        while True:
            lo, hi = max(0, mid - w), min(len(text), mid + w)
            ids = self._merge(text[lo:hi])
            at = lo + np.cumsum([0] + [self.length[i] for i in ids])[:-1]
            a = b = None
            if lo == 0:
                a = 0, 0
            else:
                tail = left[-w:]
                place = mid - np.cumsum([self.length[i] for i in reversed(tail)])[::-1]
                m = self._meet(ids, at, tail, place, range(int(np.searchsorted(at, mid))))
                a = m and (len(left) - len(tail) + m[1] + 1, m[0] + 1)
            if hi == len(text):
                b = len(ids), len(right)
            else:
                tail = right[:w]
                place = mid + np.cumsum([0] + [self.length[i] for i in tail])[:-1]
                b = self._meet(ids, at, tail, place, range(int(np.searchsorted(at, mid)), len(ids)))
            if a and b and a[1] <= b[0]:
                return left[: a[0]] + ids[a[1] : b[0]] + right[b[1] :]
            w *= 2

    @staticmethod
    def _meet(ids: list[int], at: np.ndarray, side: list[int], place: np.ndarray, among: range) -> tuple[int, int] | None:
        """Where in the window and in the side the last of the first AGREE equal neighbours stands."""
        where = {p: k for k, p in enumerate(place.tolist())}
        streak = 0
        for j in among:
            k = where.get(int(at[j]))
            streak = streak + 1 if k is not None and side[k] == ids[j] else 0
            if streak == AGREE:
                return j, k
        return None

    def run(self, text: str) -> list[int]:
        """Ids of a text without ASCII white space."""
        return [i for x in self.split(text) for i in self.piece(x)]

    def fill(self, words: set[bytes]) -> None:
        """Remembers the short ones of these runs: those not yet known are encoded in one text, white space between them."""
        new = [w for w in words if w not in self.cache and len(w) <= self.leaf]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = [w for w in words if len(w) <= self.leaf]
        for at in range(0, len(new), FILL):
            part = new[at : at + FILL]
            texts = [w.decode("utf-8", "replace") for w in part]
            e = self.tok.encode(" ".join(texts), add_special_tokens=False)
            opens = np.cumsum([0] + [len(t) + 1 for t in texts])
            cuts = (np.searchsorted(np.array([x for x, _ in e.offsets], np.int64), opens) * 4).tolist()
            ids = np.array(e.ids, np.int32).tobytes()
            self.cache.update((w, ids[a:z]) for w, a, z in zip(part, cuts[:-1], cuts[1:], strict=True))

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        split = [t.split() for t in texts]
        self.fill(set().union(*split))
        cache = self.cache
        for words in split:
            known = list(map(cache.get, words))
            if None in known:
                known = [np.array(self.run(w.decode("utf-8", "replace")), np.int32).tobytes() if x is None else x for x, w in zip(known, words, strict=True)]
            yield np.frombuffer(b"".join(known), np.int32)


@functools.cache
def encoder(path: str, leaf: int = LEAF) -> Encoder:
    """A worker's encoder: its memory of words outlives a task."""
    return Encoder(path, leaf)


def _encode_batches(path: str, leaf: int, digest: bool):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, leaf)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                n, one, two = [], [], []
                for ids in enc.encode(binary(part.column(0))):
                    n.append(len(ids))
                    each = ids.tolist()
                    tokens = " ".join([enc.names[i] for i in each])
                    if digest:
                        one.append(hashlib.sha256(" ".join([enc.numbers[i] for i in each]).encode()).hexdigest())
                        two.append(hashlib.sha256(tokens.encode()).hexdigest())
                    else:
                        one.append(ids)
                        two.append(tokens)
                out = [pa.array(n, pa.int64()), pa.array(one, pa.string() if digest else pa.list_(pa.int32())), pa.array(two, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *out], names=[*part.schema.names[1:], "n_tokens", "ids_sha256" if digest else "token_ids", "decoded_sha256" if digest else "decoded"])

    return f


def segments(enc: Encoder, raw: bytes, most: int) -> Iterator[tuple[int, int, list[str]]]:
    """Parts (kind, number, texts) of a long text, of about ``most`` bytes: words; or, of a longer run, what is unsplit in
    it; or chunks of one such piece, which share a number and are joined afterwards."""
    at = number = 0
    while at < len(raw):
        end = at + most
        if end >= len(raw):
            yield WORDS, 0, [raw[at:].decode("utf-8", "replace")]
            return
        spaces = [m.start() for m in SPACE.finditer(raw, at, end)]
        if spaces:
            yield WORDS, 0, [raw[at : spaces[-1]].decode("utf-8", "replace")]
            at = spaces[-1] + 1
            continue
        stop = m.start() if (m := SPACE.search(raw, end)) else len(raw)
        text = raw[at:stop].decode("utf-8", "replace")
        held, size, lo = [], 0, 0
        while lo < len(text):
            m = SAFE.search(text, lo + most)
            # a special token has such places inside, so it stays with what is before it
            hi = len(text) if m is None else max([m.start(), *[x.end() for x in enc.marks.finditer(text, max(lo, m.start() - 64), m.start() + 64) if x.start() < m.start()]])
            for x in enc.split(text[lo:hi]):
                if len(x) > most:
                    if held:
                        yield PIECES, 0, held
                    held, size, number = [], 0, number + 1
                    for c in range(0, len(x), most):
                        yield CHUNK, number, [x[c : c + most]]
                    continue
                held.append(x)
                size += len(x)
                if size > most:
                    yield PIECES, 0, held
                    held, size = [], 0
            lo = hi
        if held:
            yield PIECES, 0, held
        at = stop


def _cut(path: str, leaf: int, most: int):
    """Rows (text, doc) to their segments."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, leaf)
        for b in batches:
            for i in range(b.num_rows):
                doc = b.column(1)[i].as_py()
                for seg, (kind, number, texts) in enumerate(segments(enc, binary(b.column(0).slice(i, 1))[0], most)):
                    cols = [pa.array([doc]), pa.array([seg], pa.int32()), pa.array([kind], pa.int32()), pa.array([number], pa.int32()), pa.array([texts], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc", "seg", "kind", "number", "texts"])

    return f


def segment_ids(enc: Encoder, kind: int, texts: list[str]) -> list[int]:
    if kind == WORDS:
        return next(enc.encode([texts[0].encode()])).tolist()
    return [i for x in texts for i in enc.piece(x)]


def _encode_segments(path: str, leaf: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, leaf)
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                kind, texts = one.column(2)[0].as_py(), one.column(4)[0].as_py()
                chunk = texts[0] if kind == CHUNK else ""
                ids = pa.array([np.array(segment_ids(enc, kind, texts), np.int32)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*one.columns[:4], pa.array([chunk]), ids], names=["doc", "seg", "kind", "number", "chunk", "ids"])

    return f


def join_chunks(enc: Encoder, texts: list[str], ids: list[list[int]]) -> list[int]:
    """Ids of one unsplit piece from those of its chunks, pairwise, as a tree."""
    if len(texts) == 1:
        return ids[0]
    m = len(texts) // 2
    left, right = "".join(texts[:m]), "".join(texts[m:])
    return enc.join(left + right, len(left), join_chunks(enc, texts[:m], ids[:m]), join_chunks(enc, texts[m:], ids[m:]))


def _join_docs(path: str, leaf: int, digest: bool):
    def f(table: pa.Table) -> pa.Table:
        enc = encoder(path, leaf)
        table = table.sort_by("seg").combine_chunks()
        kind, number = table["kind"].to_pylist(), table["number"].to_pylist()
        parts: list[np.ndarray] = []
        at = 0
        while at < len(kind):
            to = at + 1
            if kind[at] == CHUNK:
                while to < len(kind) and (kind[to], number[to]) == (CHUNK, number[at]):
                    to += 1
            ids = [table["ids"][i].values.to_numpy() for i in range(at, to)]
            if to > at + 1:
                ids = [np.array(join_chunks(enc, table["chunk"].slice(at, to - at).to_pylist(), [x.tolist() for x in ids]), np.int32)]
            parts += ids
            at = to
        parts = [x for x in parts if len(x)]
        words = lambda of: (("" if i == 0 else " ") + " ".join([of[j] for j in x.tolist()]) for i, x in enumerate(parts))
        if digest:
            one, two = hashlib.sha256(), hashlib.sha256()
            for sha, of in ((one, enc.numbers), (two, enc.names)):
                for t in words(of):
                    sha.update(t.encode())
            result = [pa.array([one.hexdigest()]), pa.array([two.hexdigest()])]
        else:
            result = [pa.array([np.concatenate([np.empty(0, np.int32), *parts])], pa.list_(pa.int32())), pa.array(["".join(words(enc.names))])]
        return pa.table({"doc": table["doc"][:1], "n_tokens": pa.array([sum(map(len, parts))], pa.int64()), "one": result[0], "two": result[1]})

    return f


def bpe(docs: DataFrame, path: str, digest: bool = False, leaf: int = LEAF, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Encodes each whole text with the tokenizer file at ``path`` (the same on all machines) and decodes it again.

    docs: text and any other columns. Returns the other columns with n_tokens long and, with digest, ids_sha256 and
    decoded_sha256 (of the ids joined by a space, and of the decoded text), else token_ids array<int> and decoded string.
    Columns of those names in docs are replaced. A null or blank text has no tokens; strings of special tokens in a text
    encode as the library has it. Repeated rows are encoded each for itself. Empty tables give empty results. A tokenizer
    that keeps white space is an error.

    Documents up to ``segment_chars`` characters are encoded in place, without a shuffle. A longer one is cut into rows by
    one task, which reads it once, encoded by as many tasks, and joined per document.
    """
    need(docs, text="string")
    one, two = ("ids_sha256", "decoded_sha256") if digest else ("token_ids", "decoded")
    docs = docs.drop("n_tokens", one, two)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    docs = docs.select("text", *[F.col(c).alias(n) for c, n in names.items()])
    keep = list(names.values())
    fields = [f"{x.name} {x.dataType.simpleString()}" for x in docs.schema if x.name != "text"]
    kind = "string" if digest else "array<int>"
    ddl = ", ".join([*fields, "n_tokens long", f"{one} {kind}", f"{two} string"])
    size = F.coalesce(F.length("text"), F.lit(0))
    if not _any_longer(docs, segment_chars):
        return map_arrow(docs.select("text", *keep), _encode_batches(path, leaf, digest), ddl).toDF(*names, "n_tokens", one, two)
    short = map_arrow(docs.where(size <= segment_chars).select("text", *keep), _encode_batches(path, leaf, digest), ddl)
    long = materialize(docs.where(size > segment_chars).withColumn("_doc", F.monotonically_increasing_id()), "bpe-long")
    cut = map_arrow(long.select("text", "_doc"), _cut(path, leaf, segment_chars), "doc long, seg int, kind int, number int, texts array<string>")
    cut = cut.repartition(max(8, long.sparkSession.sparkContext.defaultParallelism), "doc", "seg")
    parts = map_arrow(cut, _encode_segments(path, leaf), "doc long, seg int, kind int, number int, chunk string, ids array<int>")
    joined = parts.groupBy("doc").applyInArrow(_join_docs(path, leaf, digest), f"doc long, n_tokens long, one {kind}, two string")
    joined = long.drop("text").join(joined, F.col("_doc") == F.col("doc")).select(*keep, "n_tokens", F.col("one").alias(one), F.col("two").alias(two))
    return short.union(joined).toDF(*names, "n_tokens", one, two)


def _any_longer(docs: DataFrame, chars: int) -> bool:
    return bool(docs.where(F.length("text") > chars).select(F.lit(1)).limit(1).collect())


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe(docs, public_tokenizers.path("word_bpe_49k.json"), digest=True)
