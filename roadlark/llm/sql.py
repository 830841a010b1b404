"""SQL twins, for DuckDB, of the corpus queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Connected components of symmetric edges e(a, b) over nodes(id).
COMPONENTS = "reach(id, r) as (select id, id from nodes union select e.a, reach.r from reach join e on e.b = reach.id), component as (select id, min(r) as component_id from reach group by id)"

JACCARD = f"""
with recursive w as (select doc_id, coalesce({WORDS.format(t=LOWER)}, []) as w from documents),
s as (select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end)) as s from w),
one as (select min(doc_id) as id, s, count(*) as n_copies from s where len(s) > 0 group by s),
x as (select id, len(s) as n, unnest(s) as g from one),
pairs as (select a.id as a, b.id as b, count(*) as inter, any_value(a.n) as na, any_value(b.n) as nb from x a join x b on a.g = b.g and a.id <> b.id group by 1, 2),
e as (select a, b from pairs where 100 * inter >= 75 * (na + nb - inter)),
nodes as (select id from one), {COMPONENTS}
select doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(component_id, doc_id) as component_id, coalesce(n_copies, 1) as n_copies
from s left join one on s.s = one.s left join component using (id)
"""

QUALITY = rf"""
with d as (select row_number() over () as k, doc_id, source, coalesce(text, '') as t, coalesce({WORDS.format(t="text")}, []) as w from documents),
tri as (select k, i, count(*) over (partition by k, g) as c from (select k, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from d where len(w) >= 3)),
rep as (select k, count(distinct p) as n from (select k, unnest([i, i + 1, i + 2]) as p from tri where c >= 2) group by k),
raw as (select k, unnest(string_split(t, chr(10))) as x from d),
dup as (select k, count(*) - count(distinct x) as n from raw where regexp_matches(x, '[^\x20\x09-\x0D]') group by k),
lines as (select k, source, t, trim(regexp_replace(unnest(string_split(lower(t), chr(10))), '[ \t\x0B\f\r]+', ' ', 'g')) as x from d),
freq as (select source, x, count(distinct t) as n from lines where x <> '' group by all),
above as (select source, x from freq where n > 20),
lost as (select k, sum(len(string_split(lines.x, ' '))) as n from lines join above on lines.source is not distinct from above.source and lines.x = above.x group by k),
f as (select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols,
  cast(coalesce(dup.n, 0) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words, cast(coalesce(lost.n, 0) as bigint) as n_removed_words
  from d left join dup using (k) left join rep using (k) left join lost using (k)),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f)
select *, not base_failed and n_words - n_removed_words >= 0.3e0 * n_words as kept from v
"""

LINKS = f"""
with recursive u as (select vec_id, embedding::double[] as v, list_sum(list_transform(embedding::double[], lambda x: x * x)) as q from embeddings),
usable as (select * from u where q > 0 and isfinite(q)),
e as (select a.vec_id as a, b.vec_id as b from usable a join usable b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.9e0),
nodes as (select vec_id as id from u), n as (select a, count(*) as c from e group by a), {COMPONENTS}
select vec_id, coalesce(n.c, 0) as n_links, component_id, vec_id = component_id as kept from u left join n on n.a = vec_id join component on component.id = vec_id
"""

def _field(x: str) -> str:
    return f"case when {x} is null then '-' else strlen(cast({x} as varchar)) || ':' || cast({x} as varchar) end"


#: Unsigned crc32 of the ASCII text {t}, with the table of its 256 bytes made by rule as crc_table.t.
CRC_TABLE = "crc_table as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(3988292384, c // 2) else c // 2 end)) as t)"
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({t}, ''), lambda x: cast(ascii(x) as bigint))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"

MERKLE = f"""
with recursive {CRC_TABLE},
d as (select row_number() over () as k, *, doc_id is not null and {CRC.format(t="cast(doc_id as varchar)")} % 5 = 0 as tampered from documents, crc_table),
leaves as (select k, doc_id, dense_rank() over (order by source nulls first) - 1 as tree, sha256({" || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", "text"))}) as leaf,
  sha256({" || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars"))} || {_field(f"(case when tampered then {LOWER} else text end)")}) as changed from d),
own as (select k, doc_id, leaf, changed, tree, row_number() over (partition by tree order by doc_id nulls first, leaf, k) - 1 as pos, count(*) over (partition by tree) as total from leaves),
low as (select tree, 0 as level, pos, leaf as h, total from own union all
  select tree, level + 1, pos // 16, sha256(string_agg(h, '' order by pos)), (any_value(total) + 15) // 16 from low where total > 1 group by tree, level, pos // 16),
high as (select -1 as tree, 0 as level, tree as pos, h, count(*) over () as total from low where total = 1 union all
  select -1, level + 1, pos // 16, sha256(string_agg(h, '' order by pos)), (any_value(total) + 15) // 16 from high where total > 1 group by level, pos // 16),
node as (select *, string_agg(h, '') over (partition by tree, level, pos // 16 order by pos rows between unbounded preceding and 1 preceding) as l, string_agg(h, '') over (partition by tree, level, pos // 16 order by pos rows between 1 following and unbounded following) as r from (select * from low union all select * from high)),
walk as (select k, tree, 0 as level, pos, changed as h, '' as proof from own union all
  select k, case when n.total > 1 then n.tree else -1 end, case when n.total > 1 then n.level + 1 else 0 end, case when n.total > 1 then n.pos // 16 else n.tree end,
    case when n.total > 1 then sha256(concat(l, walk.h, r)) else walk.h end, case when n.total > 1 then concat(proof, l, r) else proof end
  from walk join node n on n.tree = walk.tree and n.level = walk.level and n.pos = walk.pos where n.total > 1 or n.tree >= 0),
done as (select k, walk.h as folded_root, proof, n.h as root from walk join node n on n.tree = walk.tree and n.level = walk.level and n.pos = walk.pos where n.tree = -1 and n.total = 1)
select doc_id, leaf, low.h as subroot, root, sha256(proof) as proof_sha256, folded_root, folded_root = root as verified, own.pos as position
from own join done using (k) join low on low.tree = own.tree and low.total = 1
"""

ORACLE = {"op2_jaccard_join": JACCARD, "op8_quality_rules": QUALITY, "op9_cover_tree": LINKS, "op11_merkle_manifest": MERKLE}
