"""SQL (DuckDB) of the Jaccard joins, the periodic runs and the Merkle manifest, each from the definition of its result."""

from __future__ import annotations

_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
#: Unsigned crc32 of a number's decimal digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda x: [ord(x)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
 lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))))"""

#: Components of documents whose sets of word shingles have a Jaccard similarity of at least 0.85.
COMPONENTS = r"""
with recursive d as (select row_number() over () as r, doc_id, """ + _WORDS.format(_LOWERED.format("coalesce(text, '')")) + r""" as ws from documents),
s as (select r, doc_id, list_sort(list_distinct(case when len(ws) = 0 then [] when len(ws) < {width} then [array_to_string(ws, ' ')]
 else list_transform(range(1, len(ws) - {width} + 2), lambda i: array_to_string(ws[i:i + {width} - 1], ' ')) end)) as shingles from d),
node as (select row_number() over () as g, shingles, len(shingles) as n from (select distinct shingles from s where len(shingles) > 0)),
element as (select g, n, hash(unnest(shingles)) as e from node),
pair as (select a.g as a, b.g as b from element a join element b on a.e = b.e and a.g < b.g and 100 * a.n >= 85 * b.n and 100 * b.n >= 85 * a.n group by a.g, a.n, b.g, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edge as (select a, b from pair union select b, a from pair),
reach as (select g as x, g as y from node where g in (select a from edge) union select x, b from reach join edge on y = a),
top as (select x as g, min(y) as root from reach group by x),
placed as (select s.r, s.doc_id, len(s.shingles) as n, coalesce(top.root, node.g) as root from s left join node on s.shingles = node.shingles left join top on node.g = top.g),
named as (select doc_id, n as n_shingles, case when n = 0 then doc_id else min(doc_id) over (partition by root) end as component_id from placed)
select doc_id, n_shingles, component_id{kept} from named"""

#: Runs of words: stretches that agree with themselves some words on, the smallest period of each.
RUNS = r"""
with source as (select row_number() over () as r, doc_id, """ + _CRC + " as h, " + _WORDS.format("coalesce(text, '')") + r""" as ws from documents),
sized as (select *, len(ws) as n, case when h % 10 = 0 and len(ws) > 0 then (h // 10) % len(ws) end as a from source),
periodic as (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from sized),
word as (select r, n, unnest(range(0, n)) as i, unnest(case when a is null then ws else list_transform(range(0, n), lambda i: case when i < a then ws[i + 1] else ws[a + (i - a) % p + 1] end) end) as w from periodic),
same as (select x.r, y.i - x.i as q, x.i from word x join word y on x.r = y.r and x.w = y.w and x.i < y.i and 2 * (y.i - x.i) <= x.n),
island as (select r, q, i, i - row_number() over (partition by r, q order by i) as g from same),
stretch as (select r, q, min(i) as s, count(*) + q as n from island group by r, q, g having count(*) >= q and count(*) + q >= 12),
run as (select r, s, n, min(q) as q from stretch group by r, s, n),
listed as (select r, count(*) as n_runs, first({{'s': s, 'n': n, 'q': q}} order by n desc, s, q) as best, string_agg(s || ',' || n || ',' || q || chr(10), '' order by s, q) as runs from run group by r),
gone as (select distinct r, unnest(range(s + q, s + n)) as i from run),
kept as (select word.r, string_agg(w, ' ' order by word.i) as text from word left join gone on word.r = gone.r and word.i = gone.i where gone.r is null group by word.r)
select doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, best.n as length, best.q as period, 1000 * best.n // best.q as exponent_milli,
 sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
from source left join listed on source.r = listed.r left join kept on source.r = kept.r""".replace("{{", "{").replace("}}", "}")


def _manifest(levels: int = 5) -> str:
    """Trees of up to 16 ** levels nodes: within each source (p), then over the sources (s)."""
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*(field(c) for c in ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    parts = [f"""d as (select row_number() over () as r, dense_rank() over (order by source nulls first) - 1 as s, doc_id, {leaf('text')} as leaf,
 case when {_CRC} % 5 = 0 then {leaf(_LOWERED.format('text'))} else {leaf('text')} end as tampered from documents)""",
             "p0 as (select r, s as tree, row_number() over (partition by s order by doc_id nulls first, leaf, r) - 1 as i, leaf as h from d)"]
    for name in "ps":
        for k in range(levels):
            counted = f"(select *, count(*) over (partition by tree) as c from {name}{k})"
            parts += [f"{name}{k}w as (select a.tree, a.i, any_value(a.c) as c, coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i and a.c > 1), '') as l, "
                      f"coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i and a.c > 1), '') as g from {counted} a join {name}{k} b on a.tree = b.tree and a.i // 16 = b.i // 16 group by a.tree, a.i)",
                      f"{name}{k + 1} as (select tree, i // 16 as i, case when any_value(c) > 1 then sha256(string_agg(h, '' order by i)) else any_value(h) end as h from {counted} group by tree, i // 16)"]
        if name == "p":
            parts.append(f"s0 as (select 0 as tree, tree as i, h from p{levels})")
    parts.append("f as (select d.r, d.doc_id, d.s, leaf, tampered, i from d join p0 on d.r = p0.r)")
    joins = []
    for name, tree, at in (("p", "f.s", "f.i"), ("s", "0", "f.s")):
        for k in range(levels):
            w = f"{name}{k}w"
            joins.append(f"join {w} on {w}.tree = {tree} and {w}.i = {at} // {16 ** k}")
    steps = [f"x0 as (select f.*, {', '.join(f'{n}{k}w.l as l{n}{k}, {n}{k}w.g as g{n}{k}, {n}{k}w.c as c{n}{k}' for n in 'ps' for k in range(levels))}, tampered as now from f {' '.join(joins)})"]
    names = [f"{n}{k}" for n in "ps" for k in range(levels)]
    steps += [f"x{j + 1} as (select * exclude (now), case when c{x} > 1 then sha256(l{x} || now || g{x}) else now end as now from x{j})" for j, x in enumerate(names)]
    end = f"""select doc_id, leaf, sub.h as subroot, top.h as root, sha256({' || '.join(f'l{x} || g{x}' for x in names)}) as proof_sha256, now as folded_root, now = top.h as verified
from x{len(names)} x join p{levels} sub on sub.tree = x.s cross join s{levels} top"""
    return "with " + ",\n".join(parts + steps) + "\n" + end


MANIFEST = _manifest()
