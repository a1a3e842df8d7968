"""Check SQL of the operators that SQL expresses."""

ORACLES = {
    "op11_block_anchors": r"""
with split as (
  select row_number() over () as id, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as words from documents),
windows as (
  select id, doc_id, i, array_to_string(words[i:i + 12], ' ') as w
  from split, unnest(range(1, len(words) - 11)) as t(i) where len(words) >= 13),
least as (select w, min(doc_id) as first from windows group by w),
gone as (
  select distinct id, j from windows join least using (w), unnest(range(i, i + 13)) as t(j) where first < doc_id),
lists as (select id, list(j) as gone from gone group by id),
cut as (
  select s.doc_id, s.words, coalesce(l.gone, []) as gone from split s left join lists l using (id))
select doc_id, len(words)::bigint as n_words, len(gone)::bigint as n_removed,
  sha256(array_to_string(case when len(gone) = 0 then words else list_filter(words, lambda w, k: not list_contains(gone, k)) end, ' ')) as kept_sha256
from cut
""",
    # CRC-32 bit by bit: a byte is xored in, then -1 stands for one shift
    "op13_nested_rollup": r"""
with recursive keyed as (
  select row_number() over () as id, *, case when lang is null then '0' else '1' || lang end as g,
    case when doc_id is null then false else xor(list_reduce(
      flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, e: case when e >= 0 then xor(a, e) else xor(a >> 1, 3988292384 * (a & 1)) end, 4294967295::bigint), 4294967295) % 7 = 0 end as tampered
  from documents),
hashed as (
  select id, doc_id, g, sha256(f_id || f_source || f_lang || f_n || f_text) as leaf,
    sha256(f_id || f_source || f_lang || case when tampered then f_more else f_n end || f_text) as given
  from (select id, doc_id, g, tampered,
      coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') as f_id, coalesce(strlen(source) || ':' || source, '-') as f_source,
      coalesce(strlen(lang) || ':' || lang, '-') as f_lang, coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as f_n,
      coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') as f_more, coalesce(strlen(text) || ':' || text, '-') as f_text
    from keyed)),
ranked as (
  select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as r, count(*) over (partition by g) as n from hashed),
under(g, lvl, pos, n, h) as (
  select g, 0, r, n, leaf from ranked
  union all
  select g, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from under where n > 1 group by g, lvl, pos // 2, n),
subroots as (
  select g, h as subroot, row_number() over (order by g) - 1 as r, count(*) over () as n from under where n = 1),
over_(lvl, pos, n, h) as (
  select 0, r, n, subroot from subroots
  union all
  select lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from over_ where n > 1 group by lvl, pos // 2, n),
levels as (select distinct g, lvl, n, 0 as tier from under where n > 1),
tops as (select distinct lvl, n from over_ where n > 1),
steps as (
  select k.id, l.lvl, 0 as tier, (k.r >> l.lvl) & 1 as bit, u.h as other
  from ranked k join levels l using (g) left join under u on u.g = k.g and u.lvl = l.lvl and u.pos = xor(k.r >> l.lvl, 1)
  union all
  select k.id, t.lvl, 1, (s.r >> t.lvl) & 1, o.h
  from ranked k join subroots s using (g) cross join tops t left join over_ o on o.lvl = t.lvl and o.pos = xor(s.r >> t.lvl, 1)),
proofs as (
  select id, sha256(coalesce(string_agg(other, '' order by tier, lvl) , '')) as proof_sha256,
    list({bit: bit, other: coalesce(other, '')} order by tier, lvl) as path from steps group by id),
folded(id, i, h) as (
  select id, 0, given from ranked
  union all
  select f.id, i + 1, sha256(case when path[i + 1].bit = 0 then h || path[i + 1].other else path[i + 1].other || h end)
  from folded f join proofs p on p.id = f.id where i < len(path)),
ends as (select id, arg_max(h, i) as folded_root from folded group by id)
select k.doc_id, k.leaf, s.subroot, t.h as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, e.folded_root, e.folded_root = t.h as verified
from ranked k join subroots s using (g) cross join (select h from over_ where n = 1) t left join proofs p on p.id = k.id join ends e on e.id = k.id
""",
}
