"""DuckDB SQL of the numbered queries."""

QUALITY = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
      list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from d),
i as (select rid, ws, unnest(range(1, len(ws) - 1)) as p from w where len(ws) >= 3),
g as (select rid, p, count(*) over (partition by rid, ws[p], ws[p + 1], ws[p + 2]) as c from i),
cov as (select rid, count(distinct p + o) as n from g, (values (0), (1), (2)) v(o) where c > 1 group by rid),
m as (select doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
      (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
      len(ls)::bigint as n_lines from w left join cov using (rid)),
b as (select *, (case when n_words < 50 then 1 else 0 end)::bigint + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
      + (case when 100 * n_symbols > 30 * n_words then 4 else 0 end) + (case when 100 * n_dup_lines > 50 * n_lines then 8 else 0 end)
      + (case when word_chars < 2 * n_words then 16 else 0 end) + (case when word_chars > 20 * n_words then 32 else 0 end) as failed_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 as base_failed,
       (failed_bits & 15) = 0 as kept, n_lines, failed_bits from b
"""

# DuckDB has no CRC-32: the polynomial division runs over the bytes with a table made here
SHARDS = r"""
with recursive tab as (select n, list_reduce(list_prepend(n::ubigint, range(8)::ubigint[]),
        lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as v from range(256) r(n)),
t256 as (select list(v order by n) as tv from tab),
d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, md5(coalesce(text, '')) as k from documents),
u as (select k, any_value(t) as t from d group by k),
h as (select k, hex(encode(t)) as x from u),
crc as (select k, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(len(x) // 2),
        lambda j: ('0x' || substr(x, 2 * j + 1, 2))::ubigint)), lambda c, b: xor(tv[((xor(c, b) & 255) + 1)::bigint], c >> 8)), 4294967295::ubigint)::bigint as crc
        from h, t256),
s as (select rid, doc_id, k, strlen(t) + 1 as size, crc from d join crc using (k)),
p as (select *, sum(size) over (order by k, doc_id nulls first, rid) - size as start,
      row_number() over (order by k, doc_id nulls first, rid) - 1 as nth, sum(size) over () as total,
      count(*) over (partition by k) as copies, sum(size) over (partition by k) as gb from s),
q as (select *, min(start) over (partition by k) as g0 from p),
r as (select doc_id, size, crc, nth, least(7, ((case when copies > 1 and gb <= total // 160 then 2 * g0 + gb else 2 * start + size end) * 8)
      // (2 * total))::int as shard from q)
select doc_id, size::bigint as size, crc as text_crc32, 'bytes' as law, shard,
       (nth - min(nth) over (partition by shard))::bigint as slot, cast(null as int) as grown_shard from r
"""

MIX = r"""
with recursive tab as (select n, list_reduce(list_prepend(n::ubigint, range(8)::ubigint[]),
        lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as v from range(256) r(n)),
t256 as (select list(v order by n) as tv from tab),
d as (select doc_id, source, coalesce(text, '') as t, md5(coalesce(text, '')) as k from documents),
h as (select k, hex(encode(any_value(t))) as x from d group by k),
crc as (select k, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(len(x) // 2),
        lambda j: ('0x' || substr(x, 2 * j + 1, 2))::ubigint)), lambda c, b: xor(tv[((xor(c, b) & 255) + 1)::bigint], c >> 8)), 4294967295::ubigint)::bigint as crc
        from h, t256),
led as (select doc_id, source, case when source is null then 'null' else '=' || source end as s,
        len(list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as tokens,
        ('0x' || substr(md5('0|' || coalesce(doc_id::varchar, 'null') || '|' || crc), 1, 15))::bigint as u from d join crc using (k)),
src as (select s, count(*) as docs, sum(tokens)::bigint as st from led group by s),
sh as (select s, docs, st, st / (sum(st) over ())::double as share, (sum(st) over ())::bigint as total from src),
live as (select * from sh where st > 0),
bis(step, low) as (select 1048576::bigint, 0::bigint union all
  select step // 32, low + (step // 32) * coalesce((select max(kk) from (
     select kk, ln(sum(share ** a)) - sum(share ** a * ln(share) * a) / sum(share ** a) as ent, count(*) as n
     from (select share, kk, (low + (step // 32) * kk) / 1048576.0::double as a from live, range(1, 33) r(kk)) group by kk)
     where n = 1 or ent >= 0.95 * ln(n)), 0) from bis where step > 1),
rep(step, low) as (select 1048576::bigint, 0::bigint union all
  select step // 32, low + (step // 32) * coalesce((select max(kk) from (
     select kk, max(share ** a / share) / sum(share ** a) as r
     from (select share, kk, (low + (step // 32) * kk) / 1048576.0::double as a from live, range(1, 33) r(kk)) group by kk)
     where r > 4.0), 0) from rep where step > 1),
r1 as (select low + (select case when max(share ** (low / 1048576.0::double) / share) / sum(share ** (low / 1048576.0::double)) > 4.0 then 1 else 0 end from live) as k
       from rep where step = 1),
e as (select least(1048576, greatest((select low from bis where step = 1), (select k from r1))) as k),
w as (select s, docs, st, total, share ** (k / 1048576.0::double) as p from live, e),
q as (select s, docs, st, round(p / (sum(p) over ()) * total)::bigint as quota from w),
qq as (select s, quota // st as epochs, quota % st as rest, (docs + 511) // 512 as nb from q),
rows_ as (select led.*, epochs, rest, u % nb as block from led join qq using (s)),
bl as (select s, block, epochs, rest, sum(tokens) as bt, ('0x' || substr(md5('0|' || epochs || '|' || s || '|' || block), 1, 15))::bigint as bd
       from rows_ group by all),
bo as (select s, block, sum(bt) over (partition by s order by bd, block rows unbounded preceding) - bt as before from bl),
ro as (select r.*, before, ('0x' || substr(md5('0|row|' || epochs || '|' || u), 1, 15))::bigint as d0 from rows_ r join bo using (s, block)),
c as (select *, before + sum(tokens) over (partition by s, block order by d0, u) <= rest as extra from ro),
n as (select doc_id, source, s, u, tokens, block, epochs + case when extra then 1 else 0 end as copies from c),
x as (select *, unnest(range(copies)) as epoch from n)
select doc_id, source, tokens, epoch::int as epoch, block::bigint as block,
       ('0x' || substr(md5('0|' || epoch || '|' || s || '|' || block), 1, 15))::bigint as block_rank,
       ('0x' || substr(md5('0|row|' || epoch || '|' || u), 1, 15))::bigint as draw from x
"""

LEXICAL = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
s as (select count(*) as nd, sum(len(ts))::bigint as nt from d where len(ts) > 0),
q as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
t as (select rid, doc_id, len(ts) as n, unnest(ts) as term from d),
c as (select rid, doc_id, n, term, count(*) as tf from t where term in (select term from q) group by all),
f as (select term, floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1)::double))::bigint as w from c, s group by term),
sc as (select item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nt))))::bigint as score
       from c join f using (term) join q using (term), s group by all),
r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from sc where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 10
"""

CAP_LINKS = r"""
with recursive v as (select row_number() over () as rid, vec_id, embedding::double[] as x from embeddings),
u as (select rid, vec_id, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) as norm from v
  where vec_id is not null and len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(x, lambda c: c <> 0)) > 0),
l as (select a.rid as a, b.rid as b, b.vec_id as other from u a join u b on a.rid <> b.rid and len(a.x) = len(b.x)
  and list_sum(list_transform(list_zip(a.x, b.x), lambda t: t[1] * t[2])) >= 0.9 * a.norm * b.norm),
r as (select rid, rid as at, vec_id as low from u union select r.rid, l.b, l.other from r join l on r.at = l.a),
c as (select rid, min(low) as component_id from r group by rid),
n as (select a as rid, count(*) as n from l group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(component_id, vec_id) as component_id,
       vec_id is not distinct from coalesce(component_id, vec_id) as kept from v left join c using (rid) left join n using (rid)
"""


def vector_codes(rounds=4) -> str:
    """Integer k-means of the four parts, every round two steps of one long statement."""
    steps = ["""with v as (select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::double)::bigint) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
p as (select rid, unnest(range(4)) as part, x, len(x) // 4 as w from v),
q as (select rid, part, x[part * w + 1:part * w + w] as x from p),
e0 as (select part, nth - 1 as entry, x from (select q.part, q.x, row_number() over (partition by q.part order by vec_id nulls last, v.x) as nth
  from q join v using (rid)) where nth <= 256)"""]
    for i in range(rounds + 1):
        steps.append(f"""d{i} as materialized (select rid, part, min(struct_pack(d := list_sum(list_transform(list_zip(q.x, e.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::bigint,
  e := entry)) as b from q join e{i} e using (part) group by rid, part)""")
        if i < rounds:
            steps.append(f"""s{i} as (select part, b.e as entry, pos, sum(c)::bigint as s, count(*) as n from (select rid, part, b, unnest(x) as c, unnest(range(len(x))) as pos
  from d{i} join q using (rid, part)) group by all),
u{i} as (select part, entry, list(((s - ((s % n) + n) % n) // n)::bigint order by pos) as x from s{i} group by all),
e{i + 1} as materialized (select part, entry, coalesce(u.x, e.x) as x from e{i} e left join u{i} u using (part, entry))""")
    return ",\n".join(steps) + f""",
h as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from e{rounds}),
c as (select rid, string_agg(lpad(to_hex(b.e), 2, '0'), '' order by part) as code, sum(b.d)::bigint as error from d{rounds} group by rid)
select vec_id, lower(code) as code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from c join v using (rid), h
"""
