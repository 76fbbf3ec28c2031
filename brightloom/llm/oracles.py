"""SQL of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from brightloom.llm.mixing import CAP, SKIPS


def mix_sql() -> str:
    """op1: the same rules as one statement; sources and passes by windows over the whole table."""
    words = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    order = "partition by source order by rn rows between unbounded preceding and 1 preceding"
    steps = [
        f"rows_ as (select doc_id, source, cast({words} as bigint) as size, md5(coalesce(text, '')) as h from documents)",
        "items as (select doc_id, source, h, count(*) as n_rows, max(size) as size, count(*) * max(size) as words from rows_ group by all)",
        "drawn as (select *, cast('0x' || substr(md5('mix|' || coalesce(cast(doc_id as varchar), '') || '|' || h), 1, 15) as bigint) as u from items)",
        "numbered as (select *, row_number() over (partition by source order by u, doc_id nulls first, h) as rn from drawn)",
        f"sums as (select source, cast(sum(words) as bigint) as ss, cast(sum(words) * {CAP} as bigint) as most from items group by source)",
        "weighed as (select *, cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as double) as w from sums)",
        "ratios as (select *, most / w as ratio from weighed)",
        "levels as (select *, (sum(ss) over () - coalesce(sum(most) over o, 0)) / (sum(w) over () - coalesce(sum(w) over o, 0)) as level from ratios window o as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding))",
        "found as (select min_by(level, ratio) filter (where level <= ratio) as level from levels)",
        "targets as (select source, ss, w, case when ss > 0 then least(cast(most as double), coalesce(found.level, 0) * w) else 0.0 end as target from ratios, found)",
        "based as (select n.*, ss, w, target, case when ss > 0 then cast(floor(target / ss) as bigint) else 0 end as passes from numbered n join targets t on n.source is not distinct from t.source)",
        f"p0 as (select *, target - passes * ss as rest, coalesce(sum(words) over ({order}), 0) as before, coalesce(sum(words) over ({order}), 0) as start, false as skipped from based)",
        "q0 as (select *, before + words <= rest and words > 0 as more from p0)",
    ]
    for i in range(SKIPS):
        steps += [
            f"x{i} as (select source as xs, min(rn) as x, min_by(words, rn) as xw from q{i} where not more and not skipped and words > 0 group by source)",
            f"p{i + 1} as (select q.* exclude (before, skipped, more), case when rn > x then before - xw else before end as before, skipped or coalesce(rn = x, false) as skipped, more, coalesce(rn > x, false) as after from q{i} q left join x{i} on source is not distinct from xs)",
            f"q{i + 1} as (select * exclude (more, after), more or (after and not skipped and words > 0 and before + words <= rest) as more from p{i + 1})",
        ]
    last = f"q{SKIPS}"
    # the schedule of weight w runs from w * (1 - tilt) to w * (1 + tilt); the time at which it has demanded this share
    tilt, share = "case w when 1 then 0.5::double when 3 then -0.5::double else 0.0::double end", "coalesce(case when passes > 0 then start when rn = fit then rest - lft else before end / nullif(target, 0), 0)"
    first, left = f"(w * (1 - {tilt}))", f"(least(greatest({share}, 0), 1) * w)"
    position = f"least(2 * {left} / ({first} + sqrt({first} * {first} + 2 * (2 * w * {tilt}) * {left})), 1)"
    steps += [
        f"lefts as (select source as ls, max(rest) - coalesce(sum(words) filter (where more), 0) as lft from {last} group by source)",
        f"fits as (select source as fs, arg_min(rn, {{'d': abs(words - lft), 'rn': rn}}) as fit, max(lft) as lft from {last} join lefts on source is not distinct from ls where not more and words > 0 and words < 2 * lft group by source)",
        f"plan as (select q.*, fit, lft, passes + cast(more or coalesce(rn = fit, false) as bigint) as copies from {last} q left join fits on source is not distinct from fs)",
    ]
    return f"with {', '.join(steps)} select doc_id, size, ss as source_size, target, size * copies as taken, copies, case when copies > 0 then round({position}, 9) end as first_position from (select *, unnest(range(n_rows)) from plan)"


_REACH = "reach as (select id as a, id as b from nodes union select r.a, l.b from reach r join links l on r.b = l.a), least_ as (select a as id, min(b) as c from reach group by a)"


def links_sql() -> str:
    """op2: all pairs of equal label, in double precision, and what they reach."""
    return f"""with recursive raw as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
        vectors as (select *, sqrt(list_dot_product(e, e)) as n from raw where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
        links as (select p.vec_id as a, q.vec_id as b from vectors p join vectors q on p.label = q.label and p.vec_id <> q.vec_id and len(p.e) = len(q.e)
                  where p.n > 0 and q.n > 0 and list_dot_product(p.e, q.e) / (p.n * q.n) >= 0.98),
        nodes as (select vec_id as id from embeddings), {_REACH}
        select vec_id, coalesce(k, 0) as n_links, c as component_id, vec_id = c as kept from embeddings join least_ on vec_id = id left join (select a, count(*) as k from links group by a) on a = vec_id"""


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def near_sql(shingle: int = 4, threshold: int = 80) -> str:
    """op7: intersections of all sets that share a shingle, and what the links reach."""
    lowered = _WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    return f"""with recursive words as (select doc_id, {lowered} as w from documents),
        sets as (select distinct doc_id, array_to_string(list_slice(w, i, i + {shingle - 1}), ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - {shingle - 2}, 2))) as i from words where len(w) > 0)),
        sizes as (select doc_id, count(*) as n from sets group by doc_id),
        both_ as (select p.doc_id as a, q.doc_id as b, count(*) as c from sets p join sets q on p.s = q.s and p.doc_id <> q.doc_id group by all),
        links as (select a, b from both_ join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= {threshold} * (x.n + y.n - c)),
        nodes as (select doc_id as id from documents), {_REACH}
        select d.doc_id, coalesce(n, 0) as n_shingles, c as component_id, d.doc_id = c as kept from documents d join least_ l on d.doc_id = l.id left join sizes z on z.doc_id = d.doc_id"""


def passages_sql(window: int = 13) -> str:
    """op9: every window's first document; a word goes if one of the windows over it goes."""
    return f"""with words as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
        each_ as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from words),
        windows as (select doc_id, i, array_to_string(list_slice(w, i, i + {window - 1}), ' ') as s from (select doc_id, w, unnest(range(1, len(w) - {window - 2})) as i from words where len(w) >= {window})),
        firsts as (select s, min(doc_id) as first from windows group by s),
        gone as (select doc_id, i, first < doc_id as g from windows join firsts using (s)),
        marked as (select e.doc_id, e.i, e.word, max(coalesce(g, false)) over (partition by e.doc_id order by e.i rows between {window - 1} preceding and current row) as g from each_ e left join gone using (doc_id, i)),
        summed as (select doc_id, count(*) as n, count(*) filter (where g) as r, string_agg(word, ' ' order by i) filter (where not g) as t from marked group by doc_id)
        select d.doc_id, coalesce(n, 0) as n_words, coalesce(r, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from documents d left join summed using (doc_id)"""


SQL = {"op1_mix": mix_sql(), "op2_embeddings": links_sql(), "op7_minhash": near_sql(), "op9_substrings": passages_sql()}
