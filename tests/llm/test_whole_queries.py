"""The registered queries and the pipeline's stages over whole tables, against SQL or plain recomputation."""

import collections
import hashlib
import math
import random
import sys
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brightloom.llm import common, language, lm, mixing, oracles, quality, queries, toxicity

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_operators import DOCS, WORD_BPE, library, log_p, prose, shingle_set  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
TABLES = ("documents", "embeddings", "labels")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(rows):
    show = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted("|".join(show(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_equals_sql(spark, sf, duck, name):
    ours, theirs = queries.QUERIES[name](spark, sf), duck.sql(oracles.SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert plain(tuple(r) for r in ours.select(*columns).collect()) == plain(theirs.project(", ".join(f'"{c}"' for c in columns)).fetchall())


# op8


LM_SQL = r"""with tokens as (select doc_id, crc, unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '')) as w from held),
    counts as (select w, count(*) as c from tokens where crc <> 1 group by w), sums as (select sum(c) as n, count(*) as v from counts)
    select doc_id, count(*) as n_tokens, count(c) as n_known, max(n) as train_tokens, sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) as base from tokens left join counts using (w), sums group by doc_id"""


def test_lm_query_equals_sql_and_brute_force(spark, sf, duck):
    """Counts and base scores by SQL; scores by partial matching over all training texts, byte by byte, however long."""
    held = [(i, t, zlib.crc32(str(i).encode()) % 5) for i, t in duck.sql("select doc_id, text from documents").fetchall()]
    duck.register("held", pa.table({"doc_id": [x[0] for x in held], "text": [x[1] for x in held], "crc": [x[2] for x in held]}))
    want = {r[0]: r[1:] for r in duck.sql(LM_SQL).fetchall()}
    table = collections.defaultdict(collections.Counter)
    for _, text, part in held:
        if part != 1:
            ctx = [lm.START] * lm.ORDER
            for x in [*(text or "").encode(), lm.END]:
                code = 0
                table[0, 0][x] += 1
                for k in range(1, lm.ORDER + 1):
                    code |= ctx[-k] << lm.BITS * (k - 1)
                    table[k, code][x] += 1
                ctx = [*ctx[1:], x]
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_lm"](spark, sf).collect()}
    assert len(got) == len(held) and max(len(t or "") for _, t, _ in held) > 10_000
    seen: dict = {}
    for i, text, part in held:
        r, score, ctx = got[i], 0.0, (lm.START,) * lm.ORDER
        for x in [*(text or "").encode(), lm.END]:
            if (ctx, x) not in seen:
                seen[ctx, x] = log_p(table, list(ctx), x)
            score += seen[ctx, x]
            ctx = (*ctx[1:], x)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (part == 1, *want[i][:3])
        assert r["base_score"] == pytest.approx(want[i][3]) and r["score"] == pytest.approx(score, rel=1e-5)


# op10


def test_language_query_equals_brute_force(spark, sf, duck):
    """The model learnt at once from all training words; each word's probability by sums of logarithms."""
    rows = duck.sql("select doc_id, text, lang from documents").fetchall()
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = language.pieces_of(path)
    langs = sorted({x[2] for x in rows if x[2]})
    own = {x: collections.Counter() for x in langs}
    words_of = lambda t: [w.data[a:z].tobytes() for w in [common.Words(pa.array([t or ""]), letters=True)] for a, z in zip(w.start, w.end, strict=True)]
    n = collections.Counter()
    for i, text, lang in rows:
        if lang and text is not None and zlib.crc32(str(i).encode()) % 5:
            own[lang].update(words_of(text))
            n[lang] += 1
    assert max(n.values()) <= language.SAMPLE  # so all of them are the sample
    p = language.start(pieces, len(langs))
    for _ in range(language.ROUNDS):
        p = language.settle(np.stack([language.expect(pieces, p[:, k], pa.array(list(own[x]), pa.binary()), np.array(list(own[x].values()), float)) for k, x in enumerate(langs)], 1))
    row, logs, space = {x: i for i, x in enumerate(pieces.pieces)}, np.log(p[:-1]), pieces.space
    known: dict = {}

    def log_word(word):
        if word not in known:
            a = np.full((len(word) + 1, len(langs)), -np.inf)
            a[0] = 0
            for at in range(len(word)):
                for m in pieces.lengths:
                    if at + m <= len(word):
                        part = word[at : at + m]
                        if part in row:
                            a[at + m] = np.logaddexp(a[at + m], a[at] + logs[row[part]] + (0 if at else logs[space]))
                        if not at and b" " + part in row:
                            a[m] = np.logaddexp(a[m], logs[row[b" " + part]])
            known[word] = a[-1]
        return known[word]

    got = {r["doc_id"]: r for r in queries.QUERIES["op10_language"](spark, sf).collect()}
    prior = np.log([n[x] / sum(n.values()) for x in langs])
    for i, text, _ in rows:
        total = prior + sum((log_word(w) for w in words_of(text)), np.zeros(len(langs)))
        r = got[i]
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        assert r["lang_pred"] == langs[int(total.argmax())] and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert r["score"] == pytest.approx(1 / np.exp(total - total.max()).sum(), abs=1e-6)


# op5


def test_toxicity_query_equals_sums_over_pairs(spark, sf, duck):
    """Scores of all documents from the model's weights: single terms and all pairs of terms, one by one."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_toxicity"](spark, sf).collect()}
    rows = duck.sql("select doc_id, text from documents").fetchall()
    assert len(got) == len(rows)
    for i, text in rows:
        _, bucket = toxicity.terms(pa.array([text or ""]))
        slots = [s for s in m.place[bucket].tolist() if s >= 0]
        z = m.w0 + sum(m.w[s] for s in slots) + sum(float(m.v[a] @ m.v[b]) for x, a in enumerate(slots) for b in slots[:x])
        score = 1 / (1 + math.exp(-max(-700, min(700, z))))
        assert got[i]["score"] == pytest.approx(score, abs=1e-9)
        if abs(score - toxicity.THRESHOLD) > 1e-9:
            assert got[i]["predicted"] == int(score >= toxicity.THRESHOLD)


@pytest.mark.parametrize("module", ["toxicity", "quality"])
def test_repeated_ids_of_the_sample_count_once(spark, sf, module):
    import importlib

    op = importlib.import_module(f"brightloom.llm.{module}")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    often = docs.union(docs.where("doc_id % 7 = 0")).union(docs.where("doc_id % 7 = 0")).repartition(5)
    apply = getattr(op, module)
    name = [c for c in apply(docs.limit(0), op.train(docs, labels)).columns if c.endswith("_score")][0]
    a, b = ({r["doc_id"]: r[name] for r in apply(docs, op.train(x, labels)).select("doc_id", name).collect()} for x in (docs, often))
    assert a == pytest.approx(b, abs=1e-9)


# op1


def test_positions_are_where_the_schedule_has_demanded_the_words_before(spark):
    rows = [(i, prose(5 + i % 40, i), None, f"s{i % 3}", 1) for i in range(120)]
    rows += [(7, prose(12, 7), None, "s1", 1)] * 3 + [(200, None, None, "s0", 1), (201, "", None, None, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    knots = [(0.0, 2.0), (0.25, 0.5), (0.6, 3.0), (1.0, 0.0)]
    schedule = lambda rank: F.array(*[F.struct(F.lit(t).alias("t"), (F.lit(w) * (rank + 1)).alias("w")) for t, w in knots])
    times = np.linspace(0, 1, 400_001)
    weight = np.interp(times, *zip(*knots, strict=True))
    demand = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)]) / ((weight[1:] + weight[:-1]) / 2).sum()
    plan = mixing.mix_plan(docs, schedule).collect()
    by = collections.defaultdict(list)
    for r in plan:
        draw = hashlib.md5("|".join(["mix", str(r["doc_id"]), r["text_hash"]]).encode()).hexdigest()
        by[r["source"]].append((int(draw[:15], 16), r["doc_id"], r["text_hash"], r["n_rows"] * r["size"], r))
    assert len(by) == 4 and sum(len(x) for x in by.values()) == 122
    for items in by.values():
        items.sort(key=lambda x: x[:3])
        size, target = items[0][4]["source_size"], items[0][4]["target"]
        assert size == sum(x[3] for x in items) and target <= 3 * size
        passes = int(target // size) if size else 0
        rest, taken, skipped, last = target - passes * size, 0, 0, {}
        for x in items:
            if x[3] and taken + x[3] <= rest:
                last[x[:3]] = taken
                taken += x[3]
            elif x[3] and (skipped := skipped + 1) > mixing.SKIPS:
                break
        left = rest - taken
        fits = [x for x in items if x[3] and x[:3] not in last and x[3] < 2 * left]
        if fits:
            last[min(fits, key=lambda x: (abs(x[3] - left), *x[:3]))[:3]] = taken
        start = 0
        for x in items:
            want = [i * size + start for i in range(passes)] + ([passes * size + last[x[:3]]] if x[:3] in last else [])
            assert x[4]["copies"] == len(want) == len(x[4]["positions"])
            for words, t in zip(want, x[4]["positions"], strict=True):
                assert np.interp(t, times, demand) * target == pytest.approx(words, abs=1e-5 * target + 1e-9)
            start += x[3]
    out = mixing.mix(docs, schedule)
    seen = [(r["position"], r["source"] or "", r["doc_id"]) for r in out.collect()]
    assert seen == sorted(seen) and seen == [(r["position"], r["source"] or "", r["doc_id"]) for r in mixing.mix(docs.repartition(7), schedule).collect()]


# pipeline


def test_each_stage_equals_its_brute_force(spark, sf, duck):
    """Every stage on all that the one before it kept: decisions recomputed in plain Python or SQL, row by row."""
    rng = random.Random(4)
    passage = prose(40, 77)
    extra = [(10_000 + i, prose(60, 900 + i) + " " + passage + " " + prose(30, 950 + i), "en", "s1", 1) for i in range(4)]
    base = prose(150, 78).split()
    for i in range(6):
        w = list(base)
        for j in rng.sample(range(20, 130), 1):
            w[j] = f"w{i}"
        extra.append((10_100 + i, " ".join(w), "en", "s2", 1))
    extra += [(10_200, None, "en", "s1", None), (10_201, "", None, None, 0), (10_202, "one two", "en", "s9", 7), (10_203, passage, "en", "s1", 1)]
    given = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS).union(spark.createDataFrame(extra, DOCS))
    docs, seen = common.materialize(given, "given"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, sf), name)
        seen[name] = docs.collect(), out.collect()
        docs = out
    row = lambda r: tuple(r[c] for c in corpus_pipeline.COLUMNS)

    before, after = seen["toxicity"]
    m = toxicity.train(given, spark.read.parquet(f"{sf}/labels.parquet"))
    clean = m.score(pa.array([r["text"] for r in before], pa.string())) < toxicity.THRESHOLD
    assert 0 < (~clean).sum() < len(clean) / 4
    assert collections.Counter(map(row, after)) == collections.Counter(row(r) for r, ok in zip(before, clean, strict=True) if ok)

    before, after = seen["minhash"]
    sets = [shingle_set(r["text"], 5) for r in before]
    least = [r["doc_id"] for r in before]
    holders = collections.defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].add(i)
    links = [(i, j) for i, s in enumerate(sets) for j in set().union(*(holders[x] for x in s)) if j > i and 100 * len(s & sets[j]) >= 80 * len(s | sets[j])]
    for _ in range(len(sets)):
        old = list(least)
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
        if old == least:
            break
    assert {10_100 + i for i in range(1, 6)} <= {r["doc_id"] for r, m in zip(before, least, strict=True) if m < r["doc_id"]}
    assert collections.Counter(map(row, after)) == collections.Counter(row(r) for r, m in zip(before, least, strict=True) if m == r["doc_id"])

    before, after = seen["substrings"]
    words = {r["doc_id"]: (r["text"] or "").encode().split() for r in before}
    first: dict = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    want = {}
    for r in before:
        w = words[r["doc_id"]]
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < r["doc_id"] for j in range(13)}
        if not w or len(gone) < len(w):
            want[r["doc_id"]] = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else r["text"]
    assert {r["doc_id"]: r["text"] for r in after} == want and 10_203 not in want and len(words[10_001]) > len((want[10_001] or "").split())
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after)

    before, after = seen["mixing"]
    con = duckdb.connect()
    con.register("documents", pa.table({c: [r[c] for r in before] for c in ("doc_id", "text", "source")}, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string())])))
    copies = {r[0]: r[1] for r in con.sql(f"select doc_id, copies from ({oracles.mix_sql()})").fetchall()}
    assert collections.Counter(map(row, after)) == collections.Counter({row(r): copies[r["doc_id"]] for r in before if copies[r["doc_id"]]})

    before, after = seen["bpe"]
    want = collections.Counter()
    for r in before:
        t, ids = library(r["text"] or "")
        text = t.decode(ids, skip_special_tokens=False)
        want[r["doc_id"], r["lang"], r["source"], r["n_chars"], len(ids), tuple(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["lang"], r["source"], r["n_chars"], r["n_tokens"], tuple(r["token_ids"]), r["decoded_sha256"]) for r in after) == want
    assert WORD_BPE


# op4


def test_quality_ranking_is_the_least_loss_over_pairs():
    """At the learnt weights no step along any feature lowers the logistic loss over the drawn pairs plus the ridge."""
    r = np.random.default_rng(1)
    x, y = r.normal(size=(300, 5)), (r.random(300) < 0.7).astype(int)
    x[:, 0] += 0.8 * y
    x[:, 3] -= 0.5 * y
    m = quality.fit(x, y, {0: 300, 1: 700}, pairs=9_000)
    draw = np.random.default_rng(4)
    a, b = draw.choice(np.flatnonzero(y == 1), 9_000), draw.choice(np.flatnonzero(y == 0), 9_000)
    z = np.clip((x - m.mean) / m.scale, -6, 6)
    loss = lambda w: np.mean(np.log1p(np.exp(-(z[a] - z[b]) @ w))) + quality.RIDGE / 2 * w @ w
    least = loss(m.weight)
    assert all(loss(m.weight + e * np.eye(5)[k]) >= least - 1e-12 for k in range(5) for e in (-1e-3, 1e-3, -0.1, 0.1)) and least < np.log(2) - 0.05
    below = (z @ m.weight < m.cut)
    share = np.where(y == 0, 0.3 / (y == 0).sum(), 0.7 / (y == 1).sum())
    assert share[below].sum() == pytest.approx(0.3, abs=0.02)


def test_quality_query_equals_each_text_alone(spark, sf, duck):
    ranking = quality.train(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")))
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_quality"](spark, sf).collect()}
    rows = duck.sql("select doc_id, text from documents").fetchall()
    assert len(got) == len(rows)
    for i, text in rows:
        (score,) = ranking.score(pa.array([text], pa.string()))
        assert got[i]["score"] == pytest.approx(score, abs=1e-9) and got[i]["predicted"] == int(score >= quality.THRESHOLD)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_quality_learns_from_all_labelled_documents_and_pairs(spark):
    """Means, weights and cut are those of all labelled texts that are not held out: no step lowers the loss over all pairs
    of the classes, and as many texts lie below the cut as have label 0."""
    rng, rows, given = random.Random(8), [], {}
    for i in range(6_400):
        bad = i % 16 == 0
        text = prose(3 + i % 9, i) + (" !! WIN" if rng.random() < (0.7 if bad else 0.1) else "")
        rows.append((i, text, "en", "s", 1))
        given[i] = 0 if bad else 1
    rows += [(6_400 + i, "the same few words", "en", "s", 1) for i in range(40)]
    given |= {6_400 + i: i % 2 for i in range(40)}
    labels = spark.createDataFrame([*((i, y, 0) for i, y in given.items()), (3, None, None), (None, 0, 0), (9_999, 0, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    given.pop(5)  # its largest label is no class
    m = quality.train(spark.createDataFrame(rows, DOCS).repartition(3), labels)
    own = [r for r in rows if r[0] in given and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    x, y = quality.features(pa.array([r[1] for r in own])), np.array([given[r[0]] for r in own])
    assert (y == 1).sum() > 4_000 and m.mean == pytest.approx(x.mean(0), abs=1e-9)
    z = np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-6), -6, 6)
    s = z @ m.weight
    p = 1 / (1 + np.exp(s[y == 1][:, None] - s[y == 0][None, :]))  # of each pair, that the worse one wins
    slope = -(p.mean(1) @ z[y == 1]) / (y == 1).sum() + (p.mean(0) @ z[y == 0]) / (y == 0).sum() + quality.RIDGE * m.weight
    assert np.abs(slope).max() < 1e-8 and np.abs(m.weight).max() > 0.05
    raw = np.sort(m.raw(x))
    assert m.cut == pytest.approx((raw[(y == 0).sum() - 1] + raw[(y == 0).sum()]) / 2, abs=1e-9)


def test_quality_in_memory_counts_all_pairs_and_places_of_scores():
    r = np.random.default_rng(3)
    x, y = r.normal(size=(400, 4)) * [1, 30, 1e-3, 1], (r.random(400) < 0.8).astype(int)
    x[:, 0] += 3 * y
    m = quality.fit(x, y, {0: (y == 0).sum(), 1: (y == 1).sum()})
    z = np.clip((x - m.mean) / m.scale, -6, 6)
    a, b = z[y == 1][:, None], z[y == 0][None]
    loss = lambda w: np.logaddexp(0, -((a - b) @ w)).mean() + quality.RIDGE / 2 * w @ w
    assert all(loss(m.weight + e * np.eye(4)[k]) > loss(m.weight) for k in range(4) for e in (-1e-4, 1e-4))
    n, raw = (y == 0).sum(), np.sort(z @ m.weight)
    assert m.cut == pytest.approx((raw[n - 1] + raw[n]) / 2, abs=1e-12)
    s = np.concatenate([r.normal(size=500) * 10.0 ** r.integers(-9, 9, 500), np.zeros(40), [-0.0, 5e-324, -5e-324]])
    ranks = [0, 1, 250, 270, 541, 542]
    found = quality._ranked(lambda f: quality._add(iter([(s[:, None], np.ones(len(s), int))]), f), lambda x: x[:, 0], ranks)
    assert found == np.sort(s)[ranks].tolist()
