"""The ten operators on small tables: brute force, exact round trips, and odd rows."""

import collections
import functools
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brightloom.llm import bpe, embeddings, language, lm, minhash, mixing, neighbours, quality, substrings, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
rng = random.Random(1)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base, passage = prose(120, 1), prose(20, 2)
    out = [(i, prose(40 + i, 100 + i), ["en", "de"][i % 2], ["s1", "s2", None][i % 3], 5) for i in range(24)]
    out += [(30, base, "en", "s1", 1), (31, base, "en", "s1", 1), (32, base.upper() + " more", "en", "s2", 1), (33, base + " x y", None, "s2", 1)]
    out += [(40, prose(9, 7) + " " + passage + " " + prose(9, 8), "en", "s1", 1), (41, prose(9, 9) + "\n" + passage.replace(" ", "\t") + "  " + prose(9, 10), "en", "s1", 1)]
    out += [(50, None, "en", "s1", None), (51, "", None, None, 0), (52, " \n\t ", "en", "s2", 3), (53, "one", "en", "s2", 3), (53, "one", "en", "s2", 3), (54, "Grüße — naïve 東京 12345 !!! …", "de", "s2", 3)]
    out += [(55, "x" * 3000 + " " + prose(4000, 11), "en", "s1", 1), (None, base, "en", "s1", 1), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def clashing(docs):
    """Columns with the names that the operators use themselves."""
    names = "_id _row _n _h _t _d _s _p _r c0 c1 u v size position cid rep label unit word c s k score n_tokens text_hash taken copies bits start own links single kept".split()
    return docs.withColumns({n: F.lit(f"own {n}") for n in names})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().split()


# 1 mixing


def test_targets_stop_at_the_cap_and_share_the_rest(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), (None, 1), ("c", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # weights 1, 2, 3, 1 for a, b, c, null; c and null stop at 0 and 3, a at 300
    assert got["c"] == 0 and got[None] == 3 and got["a"] == pytest.approx(300) and got["b"] == pytest.approx(1101 - 303)


def test_mix_takes_whole_documents_near_the_targets(docs, rows):
    plan = mixing.mix_plan(docs).toPandas()
    assert plan.n_rows.sum() == len(rows)
    assert ((plan.copies >= 0) & (plan.copies <= 3)).all()
    again = mixing.mix_plan(docs.repartition(5)).toPandas()
    key = ["doc_id", "text_hash", "copies"]
    assert sorted(map(str, plan[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))


def test_positions_follow_the_schedule(spark):
    many = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("source"))
    mixed = mixing.mix(many).toPandas()
    assert mixed.position.is_monotonic_increasing and mixed.position.between(0, 1).all()
    early = (mixed[mixed.source == "x"].position < 0.5).mean()  # weight 1 rises from a half to one and a half
    assert early == pytest.approx(0.375, abs=0.02) and (mixed[mixed.source == "y"].position < 0.5).mean() == pytest.approx(0.5, abs=0.02)


def test_mix_odd_rows(clashing, empty):
    assert set(clashing.columns) <= set(mixing.mix(clashing).columns)
    assert mixing.mix(clashing).count() > 0
    assert mixing.mix(empty).count() == 0
    with pytest.raises(ValueError, match="missing"):
        mixing.mix_plan(empty.drop("source"))


# 2 embeddings


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(120, 24))
    x[20:40] = x[0] + 0.08 * r.normal(size=(20, 24))
    x[40:60] = x[1] + 0.12 * r.normal(size=(20, 24))
    rows = [(i, [float(a) for a in v], i % 2 if i >= 60 else 1) for i, v in enumerate(x)]
    rows += [(200, rows[5][1], 1), (201, [2 * a for a in rows[5][1]], 1), (202, rows[5][1], None), (203, None, 1), (204, [0.0] * 24, 1), (205, [float("nan")] * 24, 1), (206, [None] * 24, 1), (207, [], 1), (208, [1.0, 2.0], 1), (209, [2.0, 4.0], 1), (None, rows[5][1], 1), (210, rows[5][1], 1), (210, rows[5][1], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)


def usable(v):
    return v is not None and len(v) > 0 and all(a is not None and math.isfinite(a) for a in v) and any(v)


def test_vector_links_equal_brute_force(vectors):
    rows = vectors.collect()
    got = collections.defaultdict(list)
    for r in embeddings.near_vectors(vectors).collect():
        got[r["vec_id"]].append((r["n_links"], r["component_id"], r["kept"]))
    near = [[j for j, b in enumerate(rows) if i != j and linked(a, b)] for i, a in enumerate(rows)]
    for i, a in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(rows[j]["vec_id"] for j in seen) if a["vec_id"] is not None else None
        assert (len(near[i]), least, least == a["vec_id"] if least is not None else True) in got[a["vec_id"]], a["vec_id"]
    assert sum(map(len, got.values())) == len(rows)


def linked(a, b):
    if None in (a["vec_id"], b["vec_id"], a["label"], b["label"]) or a["label"] != b["label"]:
        return False
    x, y = a["embedding"], b["embedding"]
    if not (usable(x) and usable(y)) or len(x) != len(y):
        return False
    return np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98


def test_no_pair_is_lost_at_the_threshold(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(300):  # pairs whose cosine is just above 0.98
        a = r.normal(size=64)
        a /= np.linalg.norm(a)
        b = r.normal(size=64)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist(), 1), (2 * i + 1, (0.98001 * a + math.sqrt(1 - 0.98001**2) * b).tolist(), 1)]
    out = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert out.where("n_links = 1 and component_id = vec_id - vec_id % 2").count() == 600


def test_vectors_empty_and_clashing(spark, vectors):
    assert embeddings.near_vectors(vectors.limit(0)).count() == 0
    assert embeddings.near_vectors(vectors.withColumns({c: F.lit(1) for c in ("id", "row", "own", "n_links", "r", "head")})).count() == vectors.count()


# 3 BPE


@functools.cache
def library_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    t.no_truncation()
    t.no_padding()
    return t


def library(text):
    t = library_tokenizer()
    return t, t.encode(text, add_special_tokens=False).ids


def odd_text(r, n):
    parts = ["a", "the", "don't", "''s", "é", "é", "ß", "東", "12", "!", "…", "<|endoftext|>", "Ω", "ing", "x", "'", " ", "-"]
    return "".join(r.choice(parts) + (" " if r.random() < 0.02 else "") for _ in range(n))


#: Other white space, marks that reorder and compose, Hangul letters, Indic vowels, special tokens, contractions.
POOLS = [" \u0085\u3000\u2003x", "a\u0323\u0301", "\u11a8\u4f60\u0323\u00e9\uac00\u1100\u1161", "abcdeinghstr", "\u0130J\u030c\u03a3\u03c3\u03c2'stre", "<|endoftext|>", "東京、。ひ\u3099か", "0123456789", "!?.,'", "ﬁﬃⅣ①", "\u0915\u093c\u0958\u09c7\u09be", "\U0001f600\u200d\ufe0f", "\x00\x1c\x1f", "e\u0316\u0300"]


def odd_run(r):
    n = r.choice([1, 5, 40, 600, 1500, 5000])
    parts = list("".join(r.sample(POOLS, r.randint(1, 4))))
    parts += ["<|endoftext|>", "<|startoftext|>", "'re", "'ve"] * (r.random() < 0.5) + [" ", "\n"] * (r.random() < 0.3)
    x = r.random()
    return r.choice(parts) * n if x < 0.1 else "a" + "".join(r.sample(parts, min(2, len(parts)))) * n if x < 0.2 else "".join(r.choice(parts) for _ in range(n))


def by_segments(enc, text, most):
    rows, out, i = list(bpe.segments(enc, text.encode(), most)), [], 0
    ids = [bpe.segment_ids(enc, kind, texts) for kind, _, texts in rows]
    while i < len(rows):
        j = i + 1
        while rows[i][0] == bpe.CHUNK and j < len(rows) and rows[j][:2] == rows[i][:2]:
            j += 1
        out += bpe.join_chunks(enc, [x[2][0] for x in rows[i:j]], ids[i:j]) if rows[i][0] == bpe.CHUNK else ids[i]
        i = j
    return out


@pytest.mark.parametrize("leaf", [40, 512])
def test_odd_texts_equal_the_library_in_place_and_by_segments(leaf):
    """2,000 texts of up to 5,000 parts, whole and cut every 300 bytes."""
    enc = bpe.Encoder(WORD_BPE, leaf)
    for seed in range(1000):
        text = odd_run(random.Random(seed + leaf))
        want = library(text)[1]
        assert next(enc.encode([text.encode()])).tolist() == want, (seed, text[:60])
        assert by_segments(enc, text, 300) == want, (seed, text[:60])


@pytest.mark.parametrize("text", [*["\u00a0" * 600, "\u0085" * 600, "東" + "\u3000" * 600 + "京", "a" + "\u0323\u0301" * 700], "x" * 513, "ab" * 3000, odd_text(random.Random(3), 3000)])
def test_hard_runs(text):
    enc = bpe.Encoder(WORD_BPE)
    assert enc.run(text) == library(text)[1] if " " not in text else by_segments(enc, text, 200) == library(text)[1]


def test_three_million_characters_by_both_paths():
    r = random.Random(8)
    enc = bpe.Encoder(WORD_BPE)
    for text in ("".join(r.choice("acgt") for _ in range(3_000_000)), " ".join(prose(50, i) for i in range(12_000))):
        want = library(text)[1]
        assert len(text) >= 3_000_000 and next(enc.encode([text.encode()])).tolist() == want
        assert by_segments(enc, text, bpe.SEGMENT_CHARS) == want


def test_a_tokenizer_that_keeps_white_space_is_an_error():
    with pytest.raises(ValueError, match="white space"):
        bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_rows_equal_the_library_and_segments_join(spark, docs, rows):
    odd = [odd_run(random.Random(i)) for i in range(60)]
    rows = [*rows, *[(1000 + i, t, "en", "s", 1) for i, t in enumerate(odd)]]
    docs = spark.createDataFrame(rows, DOCS)
    digests = {n: bpe.bpe(docs, WORD_BPE, digest=True, leaf=64, segment_chars=n).collect() for n in (500, 1 << 20)}
    small = bpe.bpe(docs, WORD_BPE, leaf=64, segment_chars=500).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        t, ids = library(text or "")
        want[doc_id, len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False)] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, " ".join(map(str, r.token_ids)), r.decoded) for r in small) == want
    whole = collections.Counter({(d, n, sha(i), sha(t)): c for (d, n, i, t), c in want.items()})
    for got in digests.values():
        assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == whole


def test_bpe_empty_and_clashing(empty, clashing):
    assert bpe.bpe(empty, WORD_BPE).count() == 0
    assert bpe.bpe(clashing, WORD_BPE, segment_chars=500).count() == clashing.count()


# 4, 5 classifiers


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        text, bad, toxic = prose(r.randint(20, 60), 5000 + i), i % 4 == 0, i % 5 == 0
        if toxic:
            w = text.split()
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["insulto", "insulte", "grossly"]) + r.choice(["", "ly", "."]))
            text = " ".join(w)
        if bad:
            text = " ".join(x.upper() + "!!" for x in text.split()) if i % 8 else " ".join([text.split()[0]] * 40)
        rows.append((i, text, "en", "s", 1))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], LABELS)


@pytest.mark.parametrize(("module", "score", "label"), [(quality, "quality", "quality"), (toxicity, "toxicity", "toxic")])
def test_classifiers_hold_out(spark, labelled, docs, empty, clashing, module, score, label):
    train_docs, labels = labelled
    model = module.train(train_docs, labels)
    apply = getattr(module, score)
    name = "quality" if label == "quality" else "toxic"
    got = apply(train_docs, model).join(labels.select("doc_id", label).where(f"{label} is not null").groupBy("doc_id").max(label), "doc_id").toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]]
    assert len(held) > 100 and (held[f"{name}_predicted"] == held[f"max({label})"]).mean() > 0.93
    odd = apply(docs, model).toPandas()
    assert odd[f"{name}_score"].between(0, 1).all() and len(odd) == docs.count()
    assert apply(empty, model).count() == 0 and apply(clashing, model).count() == docs.count()
    nothing = module.train(train_docs, labels.limit(0))
    assert apply(docs, nothing).where(f"{name}_score between 0 and 1").count() == docs.count()


def test_machine_learns_a_pair_that_single_terms_do_not_tell():
    lists, y = [], []
    r = np.random.default_rng(0)
    for _ in range(600):
        a, b = r.integers(0, 2, 2)
        lists.append(np.array([1] * a + [2] * b + [10 + int(r.integers(0, 5))], np.int64))
        y.append(int(a and b))
    m = toxicity.fit(lists, np.array(y), {0: y.count(0), 1: y.count(1)})
    slot = lambda t: m.place[np.array(t)].astype(np.int64)
    z = [m.margin(np.zeros(len(t), np.int64), slot(t), 1)[0] for t in ([1], [2], [1, 2])]
    assert z[2] > 0 > max(z[0], z[1])


# 6 nearest neighbours


def test_neighbours_reach_the_brute_force(spark):
    r = np.random.default_rng(6)
    centre = r.normal(size=(8, 16))
    x = centre[r.integers(0, 8, 3000)] + 0.4 * r.normal(size=(3000, 16))
    x[100:130] = x[99]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000, None), (3020, [0.0] * 16), (3040, [float("inf")] * 16), (None, x[0].tolist()), (3060, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("own"))
    got = neighbours.nearest(table, table.where("vec_id % 20 = 0"), shard=800).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        if q == 3060:
            raise AssertionError("no other vector has its length")
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:20]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and q not in set(g.vec_id)
        assert np.allclose(g.score, x[g.vec_id] @ x[q])
        assert all(a > b or (a == b and u < v) for a, b, u, v in zip(g.score[:-1], g.score[1:], g.vec_id[:-1], g.vec_id[1:], strict=True))
        hits += len(set(best) & set(g.vec_id))
    assert len(got) == 150 * 20 and hits / len(got) >= 0.95
    few = table.where("vec_id < 5")
    assert neighbours.nearest(few, few.where("vec_id = 0")).count() == 4
    assert neighbours.nearest(table.limit(0), table.limit(0)).count() == 0


def test_scores_depend_on_the_two_vectors_only(spark):
    """Copies in different shards tie exactly, in order of their ids, however the table is cut."""
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 33))
    x[[7, 41, 130, 222, 377, 401, 555, 599]] = x[7] * 3
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = [neighbours.nearest(table, table.where("vec_id % 20 = 0"), shard=n).orderBy("query_id", "rank").collect() for n in (50, 199, 10_000)]
    for g in got:
        for q in range(0, 600, 20):
            mine = [(row["score"], row["vec_id"]) for row in g if row["query_id"] == q]
            copies = [(s, v) for s, v in mine if v in (7, 41, 130, 222, 377, 401, 555, 599)]
            assert len({s for s, _ in copies}) <= 1 and [v for _, v in copies] == sorted(v for _, v in copies)
            assert all(s == float(np.cumsum(x[v] * x[q])[-1]) for s, v in mine)
    score = [{(row["query_id"], row["vec_id"]): row["score"] for row in g} for g in got]
    assert all(a[p] == b[p] for a in score for b in score for p in a.keys() & b.keys())


@pytest.mark.parametrize(("kind", "dims"), [("normal", 128), ("norms", 64), ("clusters", 64)])
def test_recall_of_a_full_shard(kind, dims):
    r = np.random.default_rng(1)
    n = neighbours.SHARD
    x = r.normal(size=(n, dims))
    if kind == "norms":
        x *= r.lognormal(0, 0.5, size=(n, 1))
    if kind == "clusters":
        x = r.normal(size=(n // 40, dims))[r.integers(0, n // 40, n)] + 0.2 * x
    own = np.arange(0, n, 20)
    q, v, _ = neighbours.Graph(np.arange(n), x, 20).search(own, x[own], 20)
    s = x[own] @ x.T
    s[np.arange(len(own)), own] = -np.inf
    best = np.argpartition(-s, 20, axis=1)[:, :20]
    hits = sum(len(set(v[q == i].tolist()) & set(b.tolist())) for i, b in zip(own.tolist(), best, strict=True))
    assert hits / (20 * len(own)) >= 0.95


# 7 MinHash


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def test_near_duplicates_equal_brute_force(spark, docs, rows, clashing, empty):
    base = prose(200, 21).split()
    more = []
    for i in range(60):  # copies with more and more words changed
        w = list(base)
        for j in range(i):
            w[(j * 37) % 200] = f"new{i}x{j}"
        more.append((100 + i, " ".join(w), "en", "s", 1))
    table = spark.createDataFrame([*rows, *more], DOCS)
    real = [(i, t) for i, t, *_ in [*rows, *more] if i is not None]
    sets = {i: shingle_set(t, 4) for i, t in real}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = minhash.near_duplicates(table, shingle=4).collect()
    assert len(got) == len(rows) + len(more)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"]) == (find(r["doc_id"]), len(sets[r["doc_id"]])), r["doc_id"]
    assert sum(r["single"] for r in got if r["doc_id"] is not None and r["n_shingles"]) == len({find(i) for i in sets if sets[i]})
    assert minhash.near_duplicates(clashing).count() == len(rows) and minhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("chunk", [5, 17, 1000])
def test_large_families_are_dealt_in_chunks(spark, monkeypatch, chunk):
    """Copies with few changes join the head, others each other only, and some nothing: as by brute force."""
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    base, r = prose(100, 31).split(), random.Random(5)
    texts = []
    for i in range(90):
        w = list(base)
        for j in r.sample(range(100), r.choice([1, 2, 4, 6, 9])):
            w[j] = f"new{i}x{j}"
        texts.append(" ".join(w))
        if i % 9 == 0:  # a copy's own copy
            texts.append(" ".join([*w[:50], "other", *w[51:]]))
    sets = [shingle_set(t, 4) for t in texts]
    least = list(range(len(texts)))
    while True:
        new = [min(least[j] for j in range(len(sets)) if 100 * len(s & sets[j]) >= 80 * len(s | sets[j])) for s in sets]
        if new == least:
            break
        least = new
    assert 3 < len(set(least)) < len(least) - 3
    out = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shingle=4)
    assert [r["component_id"] for r in out.orderBy("doc_id").collect()] == least


def test_overlaps_by_matrices_and_one_by_one():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 5_000, n).astype(np.uint64)) for n in r.integers(1, 900, 60)]
    u, v = (x.ravel() for x in np.meshgrid(np.arange(25), np.arange(25, 60)))
    for m in (slice(None), slice(0, 3)):
        assert minhash.overlaps(sets, u[m], v[m]).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(u[m], v[m], strict=True)]


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(7)
    a, b = r.integers(0, 2**63, 4000, dtype=np.uint64), r.integers(0, 2**63, 1000, dtype=np.uint64)
    least = lambda x: np.array([(x * s).min() for s in minhash._SEEDS])
    ra, rb, both = (minhash.registers(least(x)) for x in (a, b, np.concatenate([a, b])))
    assert (np.maximum(ra, rb) == both).all()
    more, less = (ra > both).sum(), (ra < both).sum()  # similarity 0.8
    reaches = lambda floor: minhash.reaches(np.array([more]), np.array([less]), np.array([4000]), np.array([5000]), floor)[0]
    assert reaches(0.56) and reaches(0.67) and not reaches(0.799 + 0.13)


# 8 LM scoring


def test_lm_equals_brute_force(docs, rows, empty, clashing):
    train = docs.where("doc_id < 20 or doc_id = 50")
    model = lm.train(train)
    got = collections.defaultdict(list)
    for r in lm.lm_score(docs, model).collect():
        got[r["doc_id"]].append(r)
    texts = [(t or "").encode() for i, t, *_ in rows if i is not None and (i < 20 or i == 50)]
    count = collections.Counter(w for t in texts for w in [*t.lower().split(), None])
    total, kinds = sum(count.values()), len(count)
    key = list(zip(model["trie"][0].tolist(), model["trie"][1].tolist(), strict=True))
    table = collections.defaultdict(dict)
    for node, s, c in zip(*[x.tolist() for x in model["trie"][2:]], strict=True):
        table[key[node]][s] = c
    for i, t, *_ in rows:
        t = (t or "").encode()
        if len(t) > 2000:
            continue
        tokens = [*t.lower().split(), None]
        base = sum(math.log10((count[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in tokens)
        score, ctx = 0.0, [lm.START] * lm.ORDER
        for x in [*t, lm.END]:
            score += log_p(table, ctx, x)
            ctx = ctx[1:] + [x]
        assert any(r["n_tokens"] == len(tokens) and r["n_known"] == sum(count[x] > 0 for x in tokens) and r["train_tokens"] == total and r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score, rel=1e-5) for r in got[i]), i
    assert sum(10 ** log_p(table, [lm.START] * lm.ORDER, x) for x in range(lm.SYMBOLS)) == pytest.approx(1)
    assert lm.lm_score(empty, model).count() == 0 and lm.lm_score(clashing, model).count() == len(rows)
    assert lm.lm_score(docs, lm.train(empty)).where("train_tokens = 0 and n_known = 0").count() == len(rows)


def test_lm_loses_no_context_that_the_trie_lacks(docs, monkeypatch):
    train = docs.where("doc_id < 20 or doc_id = 50")
    scores = lambda model: sorted((str(r["doc_id"]), r["score"]) for r in lm.lm_score(docs, model).select("doc_id", "score").collect())
    whole = scores(lm.train(train))
    for few in (60, 1):
        monkeypatch.setattr(lm, "CONTEXTS", few)
        model = lm.train(train)
        assert len(model["trie"][0]) == few
        got = scores(model)
        assert [x[0] for x in got] == [x[0] for x in whole] and [x[1] for x in got] == pytest.approx([x[1] for x in whole], rel=1e-5)


def log_p(table, ctx, symbol):
    seen, p = set(), 1.0
    for k in range(lm.ORDER, -1, -1):
        code = 0
        for x in ctx[lm.ORDER - k :]:
            code = code << lm.BITS | x
        left = {s: c for s, c in table.get((k, code), {}).items() if s not in seen}
        if not left:
            continue
        whole = sum(left.values()) + len(left)
        if symbol in left:
            return math.log10(p * left[symbol] / whole)
        p *= len(left) / whole
        seen |= set(left)
    return math.log10(p / (lm.SYMBOLS - len(seen)))


# 9 substrings


def cut(rows, window=13):
    first = {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


def test_substrings_equal_brute_force(spark, docs, rows, clashing, empty, monkeypatch):
    got = substrings.substring_dedup(docs, digest=True)
    show = lambda r: (r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])
    assert sorted(map(str, map(show, got.collect()))) == sorted(map(str, cut(rows)))
    noise = random.Random(9)
    few = [(i, " ".join(noise.choice("abc") for _ in range(60)), "en", "s", 1) for i in range(80)]
    table = spark.createDataFrame(few, DOCS)
    assert sorted(map(str, map(show, substrings.substring_dedup(table, 5, digest=True).collect()))) == sorted(map(str, cut(few, 5)))
    monkeypatch.setattr(substrings, "HOT_ANCHOR", 3)
    assert sorted(map(str, map(show, substrings.substring_dedup(table, 5, digest=True).collect()))) == sorted(map(str, cut(few, 5)))
    assert substrings.substring_dedup(clashing).count() == len(rows) and substrings.substring_dedup(empty).count() == 0
    assert substrings.substring_dedup(docs).where("doc_id = 0").first()["text"] == rows[0][1]


# 10 language


def test_forward_sums_all_segmentations():
    import pyarrow as pa

    pieces = language.pieces_of(PIECES)
    p = np.random.default_rng(8).random((pieces.n + 1, 2)) / pieces.n
    p[-1] = 0
    words = [b"then", b"ab", "Straße".encode(), "東京都".encode(), b"a", b"information"]
    w = language.Words(pa.array(words, pa.binary()))
    row = {x: i for i, x in enumerate(pieces.pieces)}

    def total(word, at, k):
        if at == len(word):
            return 1.0
        out = 0.0
        for n in range(1, len(word) - at + 1):
            part = word[at : at + n]
            if len(part) == n:
                q = p[row[part], k] if part in row else 0.0
                if at == 0:
                    q = q * p[row[b" "], k] + (p[row[b" " + part], k] if b" " + part in row else 0.0)
                out += q * total(word, at + n, k)
        return out

    got = language.forward(pieces, p, w, np.arange(len(words)))
    for i, word in enumerate(words):
        assert np.allclose(np.exp(got[i]), [total(word, 0, k) for k in range(2)], rtol=1e-9)


def test_forward_of_long_words_in_logarithms(monkeypatch):
    """Words of up to 4,000 bytes, unseen bytes among them, against sums of logarithms one by one."""
    import pyarrow as pa

    pieces = language.pieces_of(PIECES)
    p = np.random.default_rng(9).random((pieces.n + 1, 3)) ** 8 / pieces.n + 1e-9
    p[-1] = 0
    row, logs = {x: i for i, x in enumerate(pieces.pieces)}, np.log(p[:-1])
    words = ["informationen" * 90, "\u0e01" * 46, "x" * 4000, "東京都" * 60, "ab"]
    monkeypatch.setattr(language, "HELD", 1)
    w = language.Words(pa.array(words))
    got = language.forward(pieces, p, w, np.arange(len(words)))
    for i, word in enumerate(x.encode() for x in words):
        a = np.full((len(word) + 1, 3), -np.inf)
        a[0] = 0
        for at in range(len(word)):
            for n in pieces.lengths:
                part = word[at : at + n]
                if len(part) == n and part in row:
                    a[at + n] = np.logaddexp(a[at + n], a[at] + logs[row[part]] + (0 if at else logs[row[b" "]]))
                if len(part) == n and not at and b" " + part in row:
                    a[n] = np.logaddexp(a[n], logs[row[b" " + part]])
        assert np.allclose(got[i], a[-1], rtol=1e-9)


def test_language_holds_out(spark, docs, empty, clashing):
    en, de = "the of and that with from river stone".split(), "und der nicht schön wäre über fluss stein".split()
    r = random.Random(10)
    rows = [(i, " ".join(r.choice(en if i % 2 else de) for _ in range(12)), "en" if i % 2 else "de", "s", 1) for i in range(400)]
    table = spark.createDataFrame(rows, DOCS)
    model = language.train(table, PIECES, sample=100)
    got = language.language(table, model).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.99
    odd = {(r["doc_id"], r["lang_pred"], r["lang_score"]) for r in language.language(docs, model).where("doc_id in (50, 51, 52)").collect()}
    assert odd == {(50, "und", 0.0), (51, "und", 0.0), (52, "und", 0.0)}
    assert language.language(empty, model).count() == 0 and language.language(clashing, model).count() == docs.count()
    assert language.language(docs, language.train(empty, PIECES)).where("lang_pred = 'und'").count() == docs.count()


# long documents


def test_hashes_do_not_depend_on_the_place(monkeypatch):
    """Words far behind in a text have the hashes that they have at its start, across the tables' ends."""
    import pyarrow as pa

    from brightloom.llm import common

    text = " ".join(prose(400, 5) for _ in range(1_500))
    assert len(text) > 3 << common._TABLE_BITS
    far, near = common.Words(pa.array(["x", text]), lower=True), common.Words(pa.array([text[: len(prose(400, 5))]]), lower=True)
    assert (far.hash[1:].reshape(1_500, 400) == near.hash).all()


def test_documents_of_megabytes(spark):
    """A document of 3 MB beside short ones, through the operators that hold a text as one array."""
    big = " ".join(prose(1_000, 70_000 + i) for i in range(600))
    assert len(big) > 3_000_000
    rows = [(1, big, "en", "s", 1), (2, big + " more", "en", "s", 1), (3, prose(50, 3), "de", "s", 1), (4, prose(60, 4), "en", "s", 1), (5, prose(50, 3), "de", "s", 1)]
    table = spark.createDataFrame(rows, DOCS).repartition(2)
    near = {r["doc_id"]: r for r in minhash.near_duplicates(table, shingle=4).collect()}
    assert near[1]["n_shingles"] == len(shingle_set(big, 4)) and [near[i]["component_id"] for i in range(1, 6)] == [1, 1, 3, 4, 3]
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.substring_dedup(table).collect()}
    assert cut == {1: (600_000, 0), 2: (600_001, 600_000), 3: (50, 0), 4: (60, 0), 5: (50, 50)}
    scored = {r["doc_id"]: r for r in lm.lm_score(table, lm.train(table)).collect()}
    assert scored[1]["n_tokens"] == scored[1]["n_known"] == 600_001 and scored[2]["score"] < scored[1]["score"] < scored[4]["score"]
    found = {r["doc_id"]: r for r in language.language(table, language.train(table, PIECES)).collect()}
    assert found[1]["lang_pred"] == found[2]["lang_pred"] == "en"
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 6)], LABELS)
    for module, name in ((quality, "quality"), (toxicity, "toxicity")):
        scores = [r[0] for r in getattr(module, name)(table, module.train(table, labels)).select(f"{'quality' if name == 'quality' else 'toxic'}_score").collect()]
        assert len(scores) == 5 and all(0 <= x <= 1 for x in scores)


# pipeline


def test_language_keeps_all_words_of_a_small_language(spark, monkeypatch):
    names = lambda letters, n, seed: [" ".join("".join(random.Random(f"{seed} {i} {k}").choices(letters, k=7)) for k in range(80)) for i in range(n)]
    big, small = names("abcdefgh", 1200, 1), names("qrstuvwxyz", 5, 2)
    table = spark.createDataFrame([(i, t, "big" if i < len(big) else "small") for i, t in enumerate(big + small)], "doc_id long, text string, lang string")
    seen = []
    learn = language.learn
    monkeypatch.setattr(language, "learn", lambda counted, *rest: seen.append(counted) or learn(counted, *rest))
    model = language.train(table, PIECES)
    words = {x for i, x in ((r["doc_id"], r["text"]) for r in table.where("lang = 'small'").collect()) if zlib.crc32(str(i).encode()) % 5 for x in x.split()}
    assert words and {bytes(r["word"]).decode() for r in seen[0].where(F.col("lang") == 1).collect()} == words
    assert seen[0].count() > 60_000
    got = language.language(table, model).where("lang = 'small'").collect()
    assert {r["lang_pred"] for r in got} == {"small"}


def test_expected_uses_by_all_segmentations():
    import pyarrow as pa

    pieces = language.pieces_of(PIECES)
    p = np.random.default_rng(5).random(pieces.n + 1) / pieces.n
    p[-1] = 0
    row = {x: i for i, x in enumerate(pieces.pieces)}

    def ways(rest, first):
        """(pieces, probability) of each segmentation."""
        if not rest:
            yield [], 1.0
        for n in range(1, len(rest) + 1):
            for lead in ([[b" ", rest[:n]], [b" " + rest[:n]]] if first else [[rest[:n]]]):
                if all(x in row for x in lead):
                    for tail, q in ways(rest[n:], False):
                        yield lead + tail, q * np.prod([p[row[x]] for x in lead])

    want = np.zeros_like(p)
    words = [(b"then", 2.0), ("süß".encode(), 1.0), (b"theory", 3.0)]
    for word, n in words:
        all_ = list(ways(word, True))
        for used, q in all_:
            for x in used:
                want[row[x]] += n * q / sum(y for _, y in all_)
    got = language.expect(pieces, p, pa.array([x for x, _ in words], pa.binary()), np.array([n for _, n in words]))
    assert np.allclose(got, want)


def test_learning_in_parts_equals_learning_at_once(spark):
    import pyarrow as pa

    words = [(i, "".join(random.Random(f"{i} {k}").choices("abcdeé", k=6)).encode(), k + 1) for i in range(2) for k in range(50)]
    pieces = language.pieces_of(PIECES)
    p = language.start(pieces, 2)
    for _ in range(language.ROUNDS):
        each = [[x for x in words if x[0] == i] for i in range(2)]
        uses = [language.expect(pieces, p[:, i], pa.array([x[1] for x in mine], pa.binary()), np.array([float(x[2]) for x in mine])) for i, mine in enumerate(each)]
        p = language.settle(np.stack(uses, 1))
    table = spark.createDataFrame(words, "lang int, word binary, n long").repartition(3).sortWithinPartitions("lang")
    assert language.learn(table, PIECES, 2) == pytest.approx(p, rel=1e-9)


def test_pipeline(spark, sf, docs, rows, clashing, empty):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "token_ids" in out.columns
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, clashing, empty):
            got = stage(spark, table, sf)
            assert name == "bpe" or got.columns == corpus_pipeline.COLUMNS
            assert got.count() <= 3 * len(rows)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()}
    assert 30 in kept and not {31, 32, 33} & kept and set(range(24)) <= kept
