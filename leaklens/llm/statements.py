"""DuckDB SQL of operators whose statement is made from parameters."""

from __future__ import annotations


def codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd rounds in whole numbers, one after the other."""
    near = lambda k: f"""a{k} as (select rid, p, min(d) as d, arg_min(e, (d, e)) as e from (
  select rid, x.p, e, list_sum([(s[i] - c[i]) * (s[i] - c[i]) for i in range(1, len(s) + 1)])::bigint as d from cut x join b{k} y on x.p = y.p) group by rid, p)"""  # noqa: E731
    turn = lambda k: f"""{near(k)},
b{k + 1} as (select p, e, coalesce(new.c, old.c) as c from b{k} old left join (
  select p, e, list((total - ((total % n) + n) % n) // n order by i) as c from (
    select p, e, i, sum(s[i])::bigint as total, count(*) as n from (select a.p, a.e, s, unnest(range(1, len(s) + 1)) as i from a{k} a join cut using (rid, p)) group by p, e, i) group by p, e) new using (p, e))"""  # noqa: E731
    return f"""
with kept as (select row_number() over () as rid, vec_id, label, [floor(4096 * x::double)::bigint for x in embedding] as v from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
cut as (select rid, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] as s from kept, range({parts}) t(p)),
ids as (select vec_id, row_number() over (order by vec_id) - 1 as e from (select distinct vec_id from kept where vec_id is not null) qualify e < {entries}),
first as (select e, min(v) as v from kept join ids using (vec_id) group by e),
b0 as (select p, e, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] as c from first, range({parts}) t(p)),
{",".join(turn(k) for k in range(rounds))},
{near(rounds)},
done as (select rid, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from a{rounds} group by rid),
book as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from b{rounds}),
each as (select vec_id, label, code, error from kept join done using (rid))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from each, book"""


def _crc(state: int, zeros: int = 1) -> int:
    """The state of CRC-32 after some zero bytes."""
    for _ in range(8 * zeros):
        state = state >> 1 ^ (state & 1) * 0xEDB88320
    return state


def _xor(terms: list[str]) -> str:
    return terms[0] if len(terms) == 1 else f"xor({_xor(terms[: len(terms) // 2])}, {_xor(terms[len(terms) // 2 :])})"


def shards() -> str:
    """Eight shards as places of racks of regions, and a ninth; CRC-32 by blocks of 256 bytes, the first of which is the shorter one."""
    table = f"(cast({[_crc(i) for i in range(256)]} as bigint[]))"
    shift = _xor([f"(c // {1 << j}) % 2 * {_crc(1 << j, 256)}" for j in range(32)])
    return _SHARDS.replace("TABLE", table).replace("SHIFT", shift)


_SHARDS = r"""
with docs as (select doc_id, coalesce(text, '') as text, strlen(coalesce(text, '')) + 1 as size, coalesce(doc_id::varchar, 'null') as name from documents),
blocks as (select doc_id, text, size, name, unnest(range((size - 1) // 256 + 1)) as k, (size - 1) % 256 as r, [('0x' || x)::bigint for x in regexp_extract_all(hex(encode(text)), '..')] as h from (select distinct * from docs)),
parts as (select doc_id, text, size, name, k, list_reduce([case k when 0 then 4294967295 else 0 end] || h[case k when 0 then 1 else r + (k - 1) * 256 + 1 end : r + k * 256],
  lambda c, x: xor(c // 256, TABLE[1 + xor(c % 256, x)])) as c from blocks),
sums as (select doc_id, text, size, name, xor(4294967295, list_reduce(list(c order by k), lambda c, x: xor(x, SHIFT))) as text_crc32 from parts group by all),
summed as (select doc_id, size, name, text_crc32 from docs join sums using (doc_id, text, size, name)),
leaves(shard, region, rack, place) as (select s, s // 4, s // 2 % 2, s % 2 from range(8) t(s) union all select 8, 2, 0, 0),
nodes as (select distinct unnest([region::varchar, region || '/' || rack, region || '/' || rack || '/' || place]) as node, unnest(['', region::varchar, region || '/' || rack]) as parent, unnest([case region when 2 then 1 else 4 end, case region when 2 then 1 else 2 end, 1]) as weight from leaves),
draws as (select doc_id, name, node, parent, -ln((('0x' || md5('13:' || node || ':' || name)[1:13])::bigint::double + 0.5) / 4503599627370496.0) / weight as score from (select distinct doc_id, name from docs), nodes),
best as (select name, parent, arg_min(node, (score, node)) as node, arg_min(node, (score, node)) filter (parent <> '' or node < '2') as of8 from draws group by name, parent),
path as (select r.name, a.node as node8, b.node as node9 from best r
  join best x on x.name = r.name and x.parent = r.of8 join best a on a.name = r.name and a.parent = x.node
  join best y on y.name = r.name and y.parent = r.node join best b on b.name = r.name and b.parent = y.node where r.parent = ''),
placed as (select doc_id, size, text_crc32, 'key' as law, s.shard::int as shard, g.shard::int as grown_shard from summed join path using (name)
  join leaves s on node8 = s.region || '/' || s.rack || '/' || s.place join leaves g on node9 = g.region || '/' || g.rack || '/' || g.place)
select *, row_number() over (partition by shard order by ('0x' || md5(concat_ws(':', coalesce(doc_id::varchar, 'null'), size, text_crc32, law, shard, grown_shard))[1:15])::bigint, doc_id) - 1 as slot from placed"""
