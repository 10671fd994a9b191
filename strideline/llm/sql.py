"""DuckDB SQL of the document operators that SQL can express."""

from __future__ import annotations

#: The CRC-32 table of a byte, made from its polynomial, and the macro-like expression for a list of bytes.
CRC_TABLE = """crc_table as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from (select unnest(range(256)) as i))"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a non-empty text's UTF-8 bytes; crc_table.t must be in reach."""
    code = f"hex(encode({text}))"
    octets = f"list_transform(range(length({code}) // 2), lambda i: ('0x' || substr({code}, 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::varchar) || ':' || {column}::varchar, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _levels(name: str, leaves: str) -> str:
    """Levels of the trees of ``leaves`` (tree, i, h, n), bottom up."""
    return f"""{name} as (select tree, 0 as level, i, h, n from {leaves}
  union all select tree, level + 1, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from {name} where n > 1 group by tree, level, i // 2, n)"""


MERKLE = f"""with recursive {CRC_TABLE},
crc as (select doc_id as id, {crc32("doc_id::varchar")} as c from (select distinct doc_id from documents where doc_id is not null), crc_table),
docs as (select doc_id, coalesce('=' || lang, '-') as tree, {_leaf("n_chars")} as leaf, {_leaf("(n_chars + 1)")} as other, coalesce(c % 7 = 0, false) as hit
  from documents left join crc on doc_id = id),
leaves as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by tree) as n, leaf as h from docs),
{_levels("low", "leaves")},
subs as (select '' as tree, tree as name, row_number() over (order by encode(tree)) - 1 as i, count(*) over () as n, h from low where n = 1),
{_levels("high", "subs")},
-- A step: the level in the whole path, and the sibling (null: none).
steps as (select l.tree, l.i as leaf_i, s.level, (l.i >> s.level) & 1 as slot, x.h from leaves l join (select distinct tree, level, n from low where n > 1) s on l.tree = s.tree
    left join low x on x.tree = l.tree and x.level = s.level and x.i = xor(l.i >> s.level, 1)
  union all select l.tree, l.i, 1000 + s.level, (b.i >> s.level) & 1, x.h from leaves l join subs b on b.name = l.tree join (select distinct level, n from high where n > 1) s on true
    left join high x on x.level = s.level and x.i = xor(b.i >> s.level, 1)),
paths as (select tree, leaf_i, list({{'slot': slot, 'h': h}} order by level) as path, string_agg(h, '' order by level) as siblings from steps group by all),
fold as (select l.tree, l.i, case when hit then other else leaf end as h, path, 1 as k from leaves l left join paths p on p.tree = l.tree and p.leaf_i = l.i
  union all select tree, i, sha256(case when path[k].slot = 1 then coalesce(path[k].h, '') || h else h || coalesce(path[k].h, '') end), path, k + 1 from fold where k <= len(path))
select l.doc_id::bigint as doc_id, l.leaf, b.h as subroot, r.h as root, sha256(coalesce(p.siblings, '')) as proof_sha256, f.h as folded_root, f.h = r.h as verified
from leaves l join subs b on b.name = l.tree join (select h from high where n = 1) r on true
left join paths p on p.tree = l.tree and p.leaf_i = l.i
join fold f on f.tree = l.tree and f.i = l.i and f.k = coalesce(len(f.path), 0) + 1"""

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPELLING = f"""with recursive {CRC_TABLE},
runs as (select doc_id, unnest(regexp_extract_all(translate(text, '{_CAPITALS}', '{_SMALL}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents),
hashed as (select run, n, {crc32("coalesce(doc_id::varchar, '') || ':' || run")} as h from (select doc_id, run, count(*) as n from runs group by doc_id, run), crc_table),
typed as (select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from typed where length(word) >= 5 group by word having sum(n) >= 3),
cuts as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
wild as (select word, n, i, substr(word, 1, i - 1) as a, substr(word, i + 1) as b from cuts),
shorter as (select distinct word, n, a || b as d from wild),
near as (select x.word, y.word as other, y.n as m from wild x join wild y on x.i = y.i and x.a = y.a and x.b = y.b and x.word <> y.word
  union all select s.word, w.word, w.n from shorter s join words w on w.word = s.d
  union all select w.word, s.word, s.n from shorter s join words w on w.word = s.d),
best as (select word, count(*) as n_near, first(other order by m desc, encode(other)) as form, max(m) as form_n from near group by word),
forms as (select word, n, coalesce(n_near, 0) as n_near, case when form_n >= 2 * n then form end as form, case when form_n >= 2 * n then form_n end as form_n from words left join best using (word)),
chain as (select word, form as last_form, 1 as k from forms where form is not null union all select c.word, f.form, k + 1 from chain c join forms f on f.word = c.last_form where f.form is not null),
roots as (select word, arg_max(last_form, k) as root from chain group by word)
select word, form, coalesce(root, word) as root, n, n_near, form_n from forms left join roots using (word)"""

MINHASH = f"""with recursive docs as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents),
shingled as (select doc_id, list_distinct(case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from docs),
sized as (select doc_id, len(s) as n, s from shingled),
named as (select s, min(doc_id) as id, any_value(n) as n from (select doc_id, n, list_sort(s) as s from sized where n > 0) group by s),
flat as (select id, n, unnest(s) as x from named),
ordered as (select id, n, x, row_number() over (partition by id order by df, x) as k from flat join (select x, count(*) as df from flat group by x) using (x)),
-- Two sets that are similar enough share one of their first, rarest shingles.
firsts as (select id, n, x from ordered where k <= n - (4 * n + 4) // 5 + 1),
candidates as (select distinct a.id as a, b.id as b, a.n as na, b.n as nb from firsts a join firsts b on a.x = b.x and a.id < b.id and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n),
shared as (select a, b, na, nb, count(*) as n from candidates join flat f on f.id = a join flat g on g.id = b and g.x = f.x group by a, b, na, nb),
links as (select a, b from shared where 100 * n >= 80 * (na + nb - n)),
edges as (select a, b from links union select b, a from links),
reach as (select a as x, a as y from edges union select r.x, e.b from reach r join edges e on r.y = e.a),
roots as (select x, min(y) as root from reach group by x),
ids as (select doc_id, n, id from (select doc_id, n, list_sort(s) as s from sized) left join named using (s, n))
select doc_id, n::bigint as n_shingles, coalesce(root, id, doc_id) as component_id, doc_id = coalesce(root, id, doc_id) as kept from ids left join roots on id = x"""
