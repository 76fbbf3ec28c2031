"""What the operators of this subpackage share: scratch tables, word hashing, Arrow plumbing, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, as every contract of this subpackage defines it. ``bytes.split()`` splits at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this session in the shared folder named by spark.checkpoint.dir; in local mode a temp folder if unset."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="brightloom-")
            spark.sparkContext.setCheckpointDir(base)
        _scratch[app] = f"{base.rstrip('/')}/brightloom-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, _scratch[app])
    return _scratch[app]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared scratch folder and reads it back: lineage ends here, and a lost executor costs no recomputation."""
    path = f"{scratch_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def need(df: DataFrame, **types: str) -> None:
    """Fails early, with a clear message, where a required column is missing."""
    missing = [c for c in types if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; there are {df.columns}")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    ends = F.when(parts[0] == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls in the given part; a null id never does."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_PUNCT = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_BASE = np.uint64(0xD1342543DE82EF95)
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
#: Places whose powers are one table; those behind are products of two entries.
_TABLE_BITS = 20


class _Powers:
    """Powers of a 64-bit number by place, modulo 2^64, without an entry for each place of a long text."""

    def __init__(self, base: int):
        self.near = self._run(base)
        self.step, self.far = pow(base, 1 << _TABLE_BITS, 1 << 64), np.ones(1, np.uint64)

    @staticmethod
    def _run(base: int) -> np.ndarray:
        x = np.full(1 << _TABLE_BITS, base, np.uint64)
        x[0] = 1
        return np.cumprod(x)

    def _reach(self, place: int) -> None:
        while len(self.far) <= place >> _TABLE_BITS:
            self.far = np.append(self.far, np.uint64(int(self.far[-1]) * self.step % (1 << 64)))

    def multiply(self, values: np.ndarray) -> None:
        """Multiplies each value by the power of its place, in place."""
        self._reach(len(values))
        for at in range(0, len(values), 1 << _TABLE_BITS):
            part = values[at : at + (1 << _TABLE_BITS)]
            part *= self.near[: len(part)]
            if at:
                part *= self.far[at >> _TABLE_BITS]

    def at(self, places: np.ndarray, most: int) -> np.ndarray:
        """The powers of places up to ``most``."""
        if most < 1 << _TABLE_BITS:
            return self.near[places]
        self._reach(most)
        return self.near[places & ((1 << _TABLE_BITS) - 1)] * self.far[places >> _TABLE_BITS]


_POWERS, _INVERSE = _Powers(int(_BASE)), _Powers(pow(int(_BASE), -1, 1 << 64))


def _marks(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to spaces, punctuation and symbols beyond ASCII: U+00A0 to U+00BF, general punctuation, arrows,
    CJK punctuation and its full-width forms."""
    out = np.zeros(len(data), bool)
    n = len(data) - 2
    at = np.flatnonzero(data[: max(n, 0)] >= 0xE2)  # sequences of three bytes
    if len(at):
        a, b, c = data[at], data[at + 1], data[at + 2]
        code = ((a & 0x0F).astype(np.int32) << 12) | ((b & 0x3F).astype(np.int32) << 6) | (c & 0x3F)
        is_mark = (a < 0xF0) & (((code >= 0x2000) & (code < 0x2200)) | ((code >= 0x3000) & (code < 0x3004)) | ((code >= 0x3008) & (code < 0x3021)) | ((code >= 0xFF01) & (code < 0xFF10)) | ((code >= 0xFF1A) & (code < 0xFF21)))
        for j in range(3):
            out[at[is_mark] + j] = True
    at = np.flatnonzero(data[:-1] == 0xC2) if len(data) else np.empty(0, np.int64)
    at = at[data[at + 1] < 0xC0]
    out[at] = out[at + 1] = True
    return out


class Words:
    """The words of some texts: hashes, first and past-the-end bytes in data, and each text's range of words."""

    def __init__(self, column: pa.Array, lower: bool = False, letters: bool = False):
        """lower: A-Z count as a-z; letters: a word is a run of letters, digits and the like."""
        self.data, offsets = text_bytes(column)
        self.offsets = offsets
        n = len(self.data)
        space = _PUNCT[self.data] | _marks(self.data) if letters else _SPACE[self.data]
        opens = np.ones(n + 1, bool)  # what stands before a byte is no part of its word
        opens[1:] = space
        opens[offsets] = True
        closes = np.ones(n, bool)  # likewise behind
        closes[:-1] = space[1:]
        closes[offsets[1:][offsets[1:] > 0] - 1] = True
        self.start = np.flatnonzero(opens[:n] & ~space)
        self.end = np.flatnonzero(closes & ~space) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.take(_BYTE_LOWER if lower else _BYTE, self.data, out=sums[1:], mode="clip")
        _POWERS.multiply(sums[1:])  # in place: a text may be long
        np.cumsum(sums[1:], out=sums[1:])
        self._sums = sums
        self.hash = self.part(self.start, self.end)
        self.range = np.searchsorted(self.start, offsets)

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of runs of bytes: equal bytes, equal hash."""
        return mix64((self._sums[end] - self._sums[start]) * _INVERSE.at(start, len(self._sums)) + (end - start).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.range) - 1

    def of_doc(self) -> np.ndarray:
        """The text's number, for each word."""
        return np.repeat(np.arange(len(self)), np.diff(self.range))

    def whole(self, k: int) -> np.ndarray:
        """For each word whether the k words from it on belong to one text; as long as grams(hash, k)."""
        n = max(0, len(self.hash) - k + 1)
        return (np.repeat(self.range[1:], np.diff(self.range))[:n] - np.arange(n)) >= k


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and each text's offsets (one more than texts); a null has none."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(b: pa.RecordBatch, text: int, most_bytes: int = 1 << 20, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about most_bytes together; a longer text is a part of its own."""
    _, offsets = text_bytes(b.column(text))
    at = 0
    while at < b.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1
        to = min(max(to, at + 1), at + most_rows, b.num_rows)
        yield b.slice(at, to - at)
        at = to


MUL = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive words, from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = np.zeros(n, np.uint64)
    for j in range(k):
        x = (x * MUL) + h[j : j + n]
    return mix64(x)


def binary(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes, nulls as empty."""
    values = column.cast(pa.large_binary()) if not pa.types.is_binary(column.type) else column
    return [v or b"" for v in values.to_pylist()]


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    return df.mapInArrow(f, ddl)


def collect_small(df: DataFrame, most: int, what: str) -> list:
    """Rows of a table that has a bound; more than the bound is an error, never a silent cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))


def labelled_sample(labels: DataFrame, label: str, most: int, parts: int = 4, part: int = 2) -> tuple[DataFrame, dict[int, int]]:
    """Ids and labels of up to ``most`` labelled rows of each class that are not held out, drawn by hash; and class sizes.

    The sample is bounded by the parameter, whatever the input. Rows with a null id or label are left out; an id with
    several labels has the largest.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), parts, part))
    own = own.groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    sizes = {r["y"]: r["count"] for r in own.groupBy("y").count().where("y in (0, 1)").collect()}
    draw = lambda y: own.where(F.col("y") == y).orderBy(F.xxhash64("l_id", F.lit(3)), "l_id").limit(most)
    return draw(0).union(draw(1)), sizes


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of one partition by stars that join the same nodes: at most a row for each node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        r = x
        while (up := parent.get(r, r)) != r:
            r = up
        while parent.get(x, x) != r:
            parent[x], x = r, parent.get(x, x)
        return r

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = root(u), root(v)
            parent.setdefault(u, a)
            parent.setdefault(v, c)
            if a != c:
                lo, hi = (a, c) if a < c else (c, a)
                parent[hi] = lo
                parent.setdefault(lo, lo)
    nodes = list(parent)
    u, v = np.array(nodes, np.int64), np.array([root(x) for x in nodes], np.int64)
    keep = u != v
    for at in range(0, int(keep.sum()), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(u[keep][at : at + 100_000]), pa.array(v[keep][at : at + 100_000])], names=["u", "v"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (u long, v long): returns (node long, component long), component the smallest node.

    Partitions first shrink to stars, which only loses redundant edges; then large-star and small-star steps alternate
    until nothing changes. Each round is written to the shared folder. Nodes without edges are not returned. A node with
    very many neighbours is only ever grouped by aggregation (min), which combines before the shuffle.
    """
    stars = materialize(map_arrow(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v"), _local_forest, "u long, v long"), "cc")
    seen = None
    for _ in range(most_rounds):
        # large star: every neighbour larger than u joins the smallest of u's neighbourhood
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        # small star: u and its smaller neighbours join the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        stars = materialize(small, "cc")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if now == seen:
            return stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
