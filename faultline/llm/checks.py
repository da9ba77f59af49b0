"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP = rf"""
with recursive words as (
  select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then w
    else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as sh from words),
sizes as (select doc_id, count(*) as n from sets group by 1),
sized as (select s.doc_id, sh, n from sets s join sizes z on z.doc_id = s.doc_id),
links as (
  select a.doc_id as a, b.doc_id as b from sized a join sized b on a.sh = b.sh and a.doc_id <> b.doc_id
    and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach as (select doc_id as doc, doc_id as other from documents union select doc, b from reach join links on a = other),
lows as (select doc, min(other) as low from reach group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, low as component_id, d.doc_id = low as kept
from documents d join lows on doc = d.doc_id left join sizes z on z.doc_id = d.doc_id
"""

_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATE = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_LETTERS}') as w from documents),
b as (select item_id, regexp_extract_all({_LOWER.format('text')}, '{_LETTERS}') as w from benchmark where text is not null),
windows as (
  select item_id, n, p, array_to_string(w[p:p + n - 1], ' ') as win
  from (select distinct item_id, w, least(13, len(w)) as n, unnest(range(1, greatest(2, len(w) - 11))) as p from b where len(w) > 0) s),
places as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from windows) s where len(w) >= n) p),
hits as (select doc_id, i, q.n, item_id, p from places q join windows x on x.n = q.n and x.win = q.win),
runs as (select *, i - row_number() over (partition by doc_id, item_id, i - p order by i) as run from hits),
found as (
  select doc_id, cast(item_id as varchar) as item, min(p) - 1 as item_word, min(i) - 1 as doc_word, max(i) - min(i) + max(n) as n_words
  from runs group by doc_id, item_id, i - p, run),
matched as (
  select doc_id, count(*) as n_matches, max(n_words) as longest_match,
    string_agg(item || ':' || item_word || ':' || doc_word || ':' || n_words, ',' order by doc_word, item, item_word, n_words) as matches
  from found group by 1),
covered as (select doc_id, count(distinct spot) as n_hit from (select doc_id, unnest(range(i, i + n)) as spot from hits) c group by 1),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) h group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated,
  coalesce(n_matches, 0) as n_matches, cast(coalesce(longest_match, 0) as bigint) as longest_match, coalesce(matches, '') as matches
from d left join covered c on c.doc_id = d.doc_id left join named m on m.doc_id = d.doc_id left join matched l on l.doc_id = d.doc_id
"""

_CONTROL = r"</?s>|\[INST!?\]|\[/INST\]"


def _escaped(x: str) -> str:
    out = rf"replace({x}, '\', '\\')"
    for mark in ("<s>", "</s>", "[INST]", "[INST!]", "[/INST]"):
        out = rf"replace({out}, '{mark}', '{mark[0]}\{mark[1:]}')"
    return out


CHAT_FORMAT = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f as (
  select *, case when regexp_matches(role, '{_CONTROL}') or regexp_matches(text, '{_CONTROL}')
    then '<s>[INST!]' || {_escaped('role')} || '[/INST]' || {_escaped('text')} || '</s>' else '<s>[INST]' || role || '[/INST]' || text || '</s>' end as shown
  from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(shown)) as bigint) as formatted_chars
from f group by conv_id
"""

# twenty bits of the hexadecimal digest at a time give four digits of base 32
WARC = r"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
best as (select hex, max(page_id) as best from p group by 1)
select page_id, strlen(html) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (cast('0x' || substr(p.hex, 1 + 5 * (k // 4), 5) as bigint) >> (15 - 5 * (k % 4))) % 32, 1)), '') as payload_digest,
  case when page_id = best then 'response' else 'revisit' end as record_type, case when page_id <> best then best end as refers_to
from p join best on best.hex = p.hex
"""

#: CRC-32 of the UTF-8 bytes of a text, by the table ``crc`` of its 256 steps
_CRC = """crc as (select list(v order by i) as steps from (
  select i, list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(i)))"""


def _crc32(text: str) -> str:
    code = f"list_transform(range(0, strlen({text})), lambda k: cast('0x' || substr(hex(encode({text})), 1 + 2 * k, 2) as bigint))"
    return f"xor(list_reduce([4294967295] || {code}, lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)])), 4294967295)"


def _leaf(text: str) -> str:
    parts = [f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", text)]
    return f"sha256({' || '.join(parts)})"


def _merkle() -> str:
    """Eight levels of the languages' trees and four of the tree above, written out."""
    ctes = [
        _CRC,
        f"""l as (select doc_id, coalesce('=' || lang, '') as tree, {_leaf("text")} as leaf,
  case when {_crc32("cast(doc_id as varchar)")} % 3 = 0 then {_leaf(_LOWER.format("text"))} else {_leaf("text")} end as own from documents, crc)""",
        """w0 as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, own as folded, '' as proof from l)""",
        "a0 as (select tree, pos, count(*) over (partition by tree) as n, leaf as digest from w0)",
    ]

    def level(nodes: str, up: str, rows: str, out: str) -> None:
        beside = "over (partition by tree, pos // 8 order by pos rows between"
        ctes.append(f"""s_{nodes} as (select tree, pos, n, coalesce(string_agg(digest, '') {beside} unbounded preceding and 1 preceding), '') as low,
  coalesce(string_agg(digest, '') {beside} 1 following and unbounded following), '') as high from {nodes})""")
        ctes.append(f"""{up} as (select tree, pos // 8 as pos, (any_value(n) + 7) // 8 as n,
  case when any_value(n) = 1 then any_value(digest) else sha256(string_agg(digest, '' order by pos)) end as digest from {nodes} group by 1, 2)""")
        ctes.append(f"""{out} as (select w.* replace (w.pos // 8 as pos, proof || low || high as proof,
  case when n = 1 then folded else sha256(low || folded || high) end as folded) from {rows} w join s_{nodes} s on s.tree = w.tree and s.pos = w.pos)""")

    for k in range(8):
        level(f"a{k}", f"a{k + 1}", f"w{k}", f"w{k + 1}")
    ctes.append("b0 as (select '' as tree, tree as below, row_number() over (order by tree) - 1 as pos, count(*) over () as n, digest from a8)")
    ctes.append("v0 as (select w.doc_id, w.leaf, b.digest as subroot, w.folded, w.proof, b.pos, b.tree from w8 w join b0 b on b.below = w.tree)")
    for k in range(4):
        level(f"b{k}", f"b{k + 1}", f"v{k}", f"v{k + 1}")
    return "with " + ",\n".join(ctes) + """
select doc_id, leaf, subroot, digest as root, sha256(proof) as proof_sha256, folded as folded_root, folded = digest as verified from v4, b4"""


MERKLE = _merkle()


#: two words are near if one is the other without a code point, or both are equal without the code point at one place
_RUNS = r"unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}'))"
SPELLING = rf"""
with {_CRC},
runs as (select doc_id, {_LOWER.format(_RUNS)} as run from documents),
distinct_runs as (select coalesce(cast(doc_id as varchar), '') || ':' || run as named, run, count(*) as c from runs group by all),
hashed as (select run, c, {_crc32("named")} as h from distinct_runs, crc),
typed as (select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, c from hashed),
words as (select word, cast(sum(c) as bigint) as n from typed where length(word) >= 7 group by 1 having sum(c) >= 2),
less as (select distinct word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words) x),
near as (
  select a.word, b.word as other, b.n as other_n from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select l.word, w.word, w.n from less l join words w on w.word = l.rest
  union select w.word, l.word, l.n from less l join words w on w.word = l.rest),
best as (select word, count(*) as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from near group by 1),
forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 10 * n then other end as form, case when other_n >= 10 * n then other_n end as form_n
  from words w left join best b on b.word = w.word),
chain as (
  with recursive c as (select word, form as root from forms where form is not null union all select c.word, f.form from c join forms f on f.word = c.root where f.form is not null)
  select word, first(root order by n desc) as root from c join (select word as root, n from words) using (root) group by 1)
select f.word, form, coalesce(root, f.word) as root, n, n_near, form_n from forms f left join chain c on c.word = f.word
"""
