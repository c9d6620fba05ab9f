"""DuckDB SQL for the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

_NOT_SPACE = r"[^\x20\x09-\x0D]"
_COUNT = lambda pattern, c="t": f"length({c}) - length(regexp_replace({c}, '{pattern}', '', 'g'))"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _near(n: int, percent: int) -> str:
    """Sets of word n-grams, all pairs that share one, and what their links reach."""
    return rf"""with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '{_NOT_SPACE}+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {n} then [w] else list_transform(range(1, len(w) - {n - 2}), lambda i: w[i:i + {n - 1}]) end) g from d), n as (select doc_id, count(*) n from s group by 1),
i as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= {percent} * (x.n + y.n - k)),
reach as (select doc_id a, doc_id b from d union select reach.a, e.b from reach join e on e.a = reach.b),
c as (select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, c component_id from d left join n using (doc_id) join (select a doc_id, min(b) c from reach group by 1) using (doc_id))"""


def _merkle(depth: int = 8) -> str:
    """Runs of 16 level by level, up to 16**depth leaves a source and as many sources; a level applies where its tree has several nodes."""
    field = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bits = "list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda x, b: case when b >= 0 then xor(x, b) else xor(x >> 1, 3988292384 * (x & 1)) end)"
    out = [
        f"with d as (select row_number() over () r, doc_id, source, {leaf('text')} leaf, case when xor({bits}, 4294967295) % 5 = 0 then {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end other from documents)",
        "o as (select *, coalesce('=' || source, '-') tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by source) n from d)",
        "n0 as (select tree, pos, n, leaf h from o)",
    ]
    for k in range(depth):
        out.append(f"r{k} as (select tree, pos // 16 run, list(h order by pos) hs from n{k} where n > 1 group by all)")
        out.append(f"n{k + 1} as (select tree, run pos, (any_value(n) + 15) // 16 n, sha256(array_to_string(any_value(hs), '')) h from r{k} join n{k} using (tree) where n{k}.pos = run * 16 group by tree, run union all select tree, pos, n, h from n{k} where n = 1)")
    out.append(f"m0 as (select tree, row_number() over (order by tree collate binary) - 1 pos, count(*) over () n, h from n{depth})".replace(" collate binary", ""))
    for k in range(depth):
        out.append(f"q{k} as (select pos // 16 run, list(h order by pos) hs from m{k} where n > 1 group by all)")
        out.append(f"m{k + 1} as (select run pos, (any_value(n) + 15) // 16 n, sha256(array_to_string(any_value(hs), '')) h from q{k}, m{k} where m{k}.pos = run * 16 group by run union all select pos, n, h from m{k} where n = 1)")
    # of each leaf: the siblings so far, and what its own digest has become
    step = "{0} as (select p.*, p.place // 16 place1, concat(sib, array_to_string(list_concat(hs[:p.place % 16], hs[p.place % 16 + 2:]), '')) sib1, case when hs is null then cur else sha256(concat(array_to_string(hs[:p.place % 16], ''), cur, array_to_string(hs[p.place % 16 + 2:], ''))) end cur1 from {1} p left join {2} on {3})"
    out.append("p0 as (select r, doc_id, tree, leaf, pos place, '' sib, coalesce(other, leaf) cur from o)")
    for k in range(depth):
        out.append(step.format(f"x{k}", f"p{k}", f"r{k} t", "t.tree = p.tree and t.run = p.place // 16"))
        out.append(f"p{k + 1} as (select r, doc_id, tree, leaf, place1 place, sib1 sib, cur1 cur from x{k})")
    out.append(f"s0 as (select r, doc_id, leaf, m0.h subroot, m0.pos place, sib, cur from p{depth} join m0 using (tree))")
    for k in range(depth):
        out.append(step.format(f"y{k}", f"s{k}", f"q{k} t", "t.run = p.place // 16"))
        out.append(f"s{k + 1} as (select r, doc_id, leaf, subroot, place1 place, sib1 sib, cur1 cur from y{k})")
    return ",\n".join(out) + f"\nselect doc_id, leaf, subroot, m{depth}.h root, sha256(sib) proof_sha256, cur folded_root, cur = m{depth}.h verified from s{depth}, m{depth}"


ORACLES: dict[str, str] = {
    "op11_minhash_near_dup": _near(2, 80) + " select *, doc_id = component_id kept from c",
    "op12_lexical_search": rf"""with d as (select row_number() over () r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from documents), s as (select count(*) filter (len(w) > 0) n, sum(len(w))::bigint l from d),
b as (select row_number() over () i, item_id, unnest(list_distinct(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) t from benchmark),
f as (select r, t, count(*) tf from (select r, unnest(w) t from d) group by all), w as (select t, floor(1000 * ln((2 * s.n + 2)::double / (2 * count(*) + 1)::double))::bigint w from f, s group by t, s.n),
m as (select r, doc_id, 50 + (50 * len(w)::bigint * s.n) // s.l m from d, s where len(w) > 0),
c as (select i, item_id, r, doc_id, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * m.m)))::bigint score from b join f using (t) join w using (t) join m using (r) group by all)
select item_id, (row_number() over v)::int "rank", doc_id, score from c where score > 0 window v as (partition by i order by score desc, doc_id) qualify row_number() over v <= 50""",
    "op13_merkle_manifest": _merkle(),
    "op2_quality_rules": rf"""with d as (select row_number() over () r, doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{_NOT_SPACE}+') w from documents),
l as (select r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_NOT_SPACE}')) l from d),
p as (select r, unnest(range(1, len(w) - 6)) i, w from d where len(w) >= 8), q as (select r, i, w[i:i + 7] s from p),
c as (select r, i from q qualify count(*) over (partition by r, s) > 1), x as (select r, count(distinct i + k) n from c, range(0, 8) t(k) group by r),
m as (select d.doc_id, len(w)::bigint n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars, {_COUNT('[#*$%&|<>]+')} n_symbols, (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(x.n, 0)::bigint n_repeat_words, len(l)::bigint n_lines,
{_COUNT(chr(92) + 'p{L}+')} n_letters, {_COUNT(chr(92) + 'p{Lu}+')} n_upper, {_COUNT('[!?#*$%&|<>~^{}' + chr(92) * 2 + chr(92) + '[' + chr(92) + ']]+')} n_marks, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::bigint n_stutter
from d join l using (r) left join x using (r)),
b as (select *, ((n_words < 20)::bigint + 2 * (100 * n_repeat_words > 30 * n_words)::bigint + 4 * (100 * n_symbols > 30 * n_words)::bigint + 8 * (n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines)::bigint + 16 * (100 * n_stutter > 30 * n_words)::bigint
+ 32 * (100 * n_upper > 40 * n_letters)::bigint + 64 * (100 * n_marks > 50 * n_words)::bigint + 128 * (100 * n_letters < 50 * word_chars)::bigint + 256 * (word_chars < 2 * n_words or word_chars > 14 * n_words)::bigint)::bigint fail_bits from m)
select *, fail_bits & 3 <> 0 base_failed, fail_bits = 0 kept, case when bit_count(fail_bits) = 1 then fail_bits else 0 end lone_bit from b""",
    "op7_ngram_jaccard": rf"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_NOT_SPACE}+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [w] else list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) end) g from d), n as (select doc_id, count(*) n from s group by 1),
i as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
reach as (select doc_id a, doc_id b from d union select reach.a, e.b from reach join e on e.a = reach.b)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, c component_id from d left join n using (doc_id) join (select a doc_id, min(b) c from reach group by 1) using (doc_id)""",
    "op8_topk_search": """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint score from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0)
select query_id, (row_number() over w)::int "rank", vec_id, score from s window w as (partition by query_id order by score desc, vec_id) qualify row_number() over w <= 5""",
    "op6_chat_formatting": r"""with t as (select conv_id, turn, role, text, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::int n, 'c' || conv_id || '-' || turn id from conversations),
u as (select * from t where role = 'user'), d as (select u.*, case when u.turn % 4 >= 2 and e.id is not null then 1 else 0 end as level from u left join u e on e.conv_id = u.conv_id and e.turn = u.turn - 2),
a as (select t.*, d.id call_id, d.turn call_turn, coalesce(d.level, -1) as level from t left join d on d.conv_id = t.conv_id and d.turn = t.turn - 1 where t.role = 'assistant')
select conv_id, turn place, -1 as level, 0 pos, 0 part, 'message' kind, 'ok' status, '' errors, '{"content":' || case when role = 'user' then to_json(to_json({'text': text})::varchar)::varchar else to_json(text)::varchar end || ',"role":"' || case when role = 'user' then 'assistant' else role end || '","type":"message"}' line from t where role <> 'assistant'
union all select d.conv_id, d.turn, d.level, 0, 1, 'call', case when d.n > 30 then 'invalid' when a.id is null then 'no result' else 'linked' end, case when d.n > 30 then 'max_words is not integer' else '' end,
'{"arguments":{"max_words":' || case when d.n > 30 then '"' || d.n || '"' else d.n::varchar end || ',"style":"plain"},"id":"' || d.id || '","name":"reply","role":"assistant","type":"call"}' from d left join a on a.call_id = d.id
union all select conv_id, coalesce(call_turn, turn), level, 0, 2, 'result', case when call_id is null then 'no call' else 'linked' end, '', '{"content":' || to_json(text)::varchar || ',"id":"c' || conv_id || '-' || (turn - 1) || '","role":"tool","type":"result"}' from a""",
    "op3_source_mixing": rf"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_NOT_SPACE}+'))::bigint size, ('0x' || substr(md5('42:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, '')) || ':' || row_number() over (partition by doc_id, source, coalesce(text, ''))), 1, 5))::bigint u from documents),
s as (select source, sum(size)::bigint z, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] w from d group by source),
o as (select *, sum(z) over () * 150 budget, coalesce(sum(200 * z) over before, 0) full_before, sum(w) over (order by z::double / w, source rows between current row and unbounded following) w_left from s window before as (order by z::double / w, source rows between unbounded preceding and 1 preceding)),
f as (select (budget - full_before)::double n, w_left::double w from o where 200 * z::double * w_left >= w * (budget - full_before)::double order by z::double / o.w, source limit 1),
g as (select s.source, z, coalesce(least(f.n * s.w / f.w / 100.0, 2.0 * z), 2.0 * z) target from s left join f on true),
p as (select source, z, target, case when z = 0 then 0 else floor(target / z)::bigint end whole, target - case when z = 0 then 0 else floor(target / z) end * z want from g),
h as (select source, u, sum(size) s from d group by all), c as (select *, sum(s) over (partition by source order by u rows unbounded preceding) cum, sum(s) over (partition by source, u // 1024) bucket from h),
e as (select c.source, min(u // 1024) b from (select source, u // 1024 * 1024 u, max(cum) cum from c group by source, u // 1024) c join p on c.source is not distinct from p.source where cum > want group by 1),
l as (select e.source, coalesce(max(case when c.cum - c.s / 2 <= p.want then c.u + 1 end), min(e.b * 1024)) lim from e join c on c.source is not distinct from e.source and c.u // 1024 = e.b join p on p.source is not distinct from e.source group by 1)
select doc_id, size, z source_size, target, (least(whole + (u < coalesce(lim, 0))::bigint, 2) * size)::bigint taken from d join p on p.source is not distinct from d.source left join l on l.source is not distinct from d.source""",
}
