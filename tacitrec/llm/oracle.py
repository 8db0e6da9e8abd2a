"""SQL that gives the rows of the corpus queries, for those that SQL can express."""

from __future__ import annotations

from tacitrec.llm.queries import SHARD_TREE, URL_RULES
from tacitrec.llm.sharding import with_one_more

BLANK_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = r"""
with rows as (
    select doc_id, length(coalesce(text, '')) as chars,
        sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256
    from documents
), ranked as (
    select *, row_number() over g as place, first_value(doc_id) over g as keep_id,
        count(*) over (partition by text_sha256) as group_size
    from rows window g as (partition by text_sha256 order by chars desc, doc_id nulls last)
)
select doc_id, keep_id, group_size, place = 1 as kept, text_sha256 from ranked
"""


def op4(levels: int = 10) -> str:
    """Segments with 20 urls stay literal with 2% of their parent's, or with labels unlike the rest's (z over 2)."""
    host = "coalesce(" + LOWER.format(r"regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)") + ", '')"
    path = r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '')"
    band = " + ".join(f"(share >= {begin}::double)::int" for begin in (0.04, 0.15, 0.31, 0.49, 0.69, 0.85, 0.96))
    steps = [f"""
urls as (select page_id, {host} as host, {path} as path from pages),
shown as (
    select u.host, u.path, quality = 1 and toxic = 0 as good
    from urls u join labels l
    on l.doc_id = try_cast(nullif(regexp_extract(u.path, '/([0-9]{{1,18}})[^/0-9]*/?$', 1), '') as bigint)
),
known as (select host, path, count(good) as labelled, sum(case when not good then 1 else 0 end) as bad from shown group by all),
tree0 as (
    select u.host, u.path, string_split(regexp_replace(u.path, '^/', ''), '/') as segments, '' as template, true as open, n,
        coalesce(labelled, 0) as labelled, coalesce(bad, 0) as bad
    from (select host, path, count(*) as n from urls group by all) u left join known k on u.host = k.host and u.path = k.path
)"""]
    for level in range(levels):
        here = f"segments[{level + 1}]"
        steps.append(f"""
children{level} as (
    select host, template, {here} as segment, sum(n) as n, sum(labelled) as labelled, sum(bad) as bad
    from tree{level} where open and len(segments) > {level} group by all
),
totals{level} as (
    select host, template, sum(n) as everything, sum(labelled) as all_labelled, sum(bad) as all_bad from children{level} group by all
),
supported{level} as (
    select c.*, everything, all_labelled, all_bad, c.n >= everything * 0.02::double as large
    from children{level} c join totals{level} t on c.host = t.host and c.template = t.template where c.n >= 20
),
tests{level} as (
    select *, (bad + rest_bad) / nullif(labelled + rest, 0) as mean,
        (bad + 10.0::double * case when all_labelled > 0 then all_bad / all_labelled else 0.0::double end) / (labelled + 10.0::double) as share
    from (
        select *, all_labelled - sum(case when large then labelled else 0 end) over w - labelled as rest,
            all_bad - sum(case when large then bad else 0 end) over w - bad as rest_bad
        from supported{level} window w as (partition by host, template))
),
literal{level} as (
    select host, template, segment, {band} as band from tests{level}
    where large or (labelled > 0 and rest > 0
        and abs(bad / labelled - rest_bad / rest) > 2.0::double * sqrt(mean * (1 - mean) * (1 / labelled + 1 / rest)))
),
tokens{level} as (
    select host, template, segment, case when count(*) over (partition by host, template, band) > 1
        then '+' || band::varchar else segment end as token
    from literal{level}
),
tree{level + 1} as (
    select t.host, path, segments, open and (len(segments) <= {level} or everything >= 20) as open, n, labelled, bad,
        t.template || case when not open or len(segments) <= {level} then '' when everything < 20 then '/**'
            else '/' || coalesce(token, '*') end as template
    from tree{level} t
    left join totals{level} a on t.host = a.host and t.template = a.template
    left join tokens{level} k on t.host = k.host and t.template = k.template and t.{here} = k.segment
)""")
    fits = " ".join(
        f"when (host = '{r.partition('/')[0]}' or host like '%.{r.partition('/')[0]}')"
        f" and starts_with(path, '/{r.partition('/')[2]}') then {{'rule': '{r}', 'verdict': '{v}'}}"
        for r, v in sorted(URL_RULES, key=lambda r: (-len(r[0]), r[0]))
    )
    steps.append(f"""
tree as (select host, path, template, labelled, bad from tree{levels}),
leaves as (select host, template, sum(labelled) as labelled, sum(bad) as bad from tree group by all),
overall as (select case when sum(labelled) > 0 then (sum(labelled) - sum(bad)) / sum(labelled) else 1.0 end as share from leaves),
hosts as (
    select host, (sum(labelled) - sum(bad) + 10.0 * any_value(share)::double) / (sum(labelled) + 10.0) as host_purity
    from leaves, overall group by host
),
judged as (
    select l.host, l.template, (labelled - bad + 10.0::double * host_purity) / (labelled + 10.0::double) as purity
    from leaves l join hosts h on l.host = h.host
),
verdicts as (
    select u.page_id, u.host, u.path, case {fits} end as fit, t.template, purity,
        case when purity < 0.5 then 'block' else 'allow' end as verdict
    from (select page_id, host, path from urls) u join tree t on u.host = t.host and u.path = t.path
    join judged j on j.host = t.host and j.template = t.template
)
select page_id, host, path, fit.rule as rule, coalesce(fit.verdict, verdict) as verdict, template, purity from verdicts""")
    text = "with " + ",".join(steps)
    # qualify the names that two joined tables share
    return text.replace("case when (host =", "case when (u.host =").replace("when (host =", "when (u.host =").replace(
        "or host like", "or u.host like").replace("starts_with(path", "starts_with(u.path")


OP8 = f"""
with docs as (select doc_id, source, {WORDS} as size from documents),
sources as (select source, sum(size)::bigint as source_size from docs group by source),
weighted as (
    select *, [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight from sources
),
levels as (
    select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over before, 0))::double
        / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double as level
    from (select *, row_number() over (order by 3 * source_size / weight, source) as place from weighted)
    window before as (order by place rows between unbounded preceding and 1 preceding)
),
water as (
    select coalesce(arg_min(level, place) filter (where level * weight < 3 * source_size), max(level)) as level from levels
),
targets as (
    select w.*, least(level * weight, (3 * source_size)::double) as target from weighted w, water
),
rated as (select *, case when source_size > 0 then target / source_size else 0.0 end as rate from targets),
drawn as (
    select d.doc_id, d.size, r.source_size, r.target, rate,
        (('0x' || md5('42/' || coalesce(d.doc_id::varchar, ''))[1:13])::bigint::double + 1) / 4503599627370496.0 as u
    from docs d join rated r on d.source is not distinct from r.source
)
select doc_id, size, source_size, target,
    size * (floor(rate) + case when u <= rate - floor(rate) then 1 else 0 end)::bigint as taken,
    (floor(rate) + case when u <= rate - floor(rate) then 1 else 0 end)::bigint as copies
from drawn
"""

OP9 = f"""
with lines as (
    select doc_id, i, line, {LOWER.format(f"trim(line, {BLANK_CHARS})")} as key
    from (
        select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
            unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i
        from documents
    )
),
frequent as (select key from lines where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(f.key) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (where f.key is null), '')) as kept_sha256
from lines l left join frequent f on l.key = f.key
group by doc_id
"""


def _descend(tree, name: str) -> str:
    """CTEs that walk down one tree: the node of each level per document."""
    regions = ", ".join(f"({r}, {float(sum(sum(k) for k in racks))})" for r, racks in enumerate(tree))
    racks = ", ".join(f"({r}, {k}, {float(sum(w))})" for r, ks in enumerate(tree) for k, w in enumerate(ks))
    leaves, first = [], 0
    for r, ks in enumerate(tree):
        for k, ws in enumerate(ks):
            leaves += [f"({r}, {k}, {s}, {float(w)}, {first + s})" for s, w in enumerate(ws)]
            first += len(ws)

    def draw(path: str) -> str:
        digest = f"md5(key || '/' || {path})[1:13]"
        return f"-ln((('0x' || {digest})::bigint::double + 1) / 4503599627370496.0)"

    return f"""
{name}_region as (
    select key, arg_min(r, struct_pack(a := {draw("'region/' || r")} / w, b := r)) as r
    from keys, (values {regions}) t(r, w) group by key
),
{name}_rack as (
    select d.key, any_value(d.r) as r, arg_min(k, struct_pack(a := {draw("'rack/' || d.r || '/' || k").replace('(key', '(d.key')} / w, b := k)) as k
    from {name}_region d join (values {racks}) t(r, k, w) on d.r = t.r group by d.key
),
{name} as (
    select d.key, arg_min(number, struct_pack(a := {draw("'shard/' || d.r || '/' || d.k || '/' || s").replace('(key', '(d.key')} / w, b := s))::integer as shard
    from {name}_rack d join (values {', '.join(leaves)}) t(r, k, s, w, number) on d.r = t.r and d.k = t.k group by d.key
)"""


CRC_TABLE = """
with recursive steps as (
    select i, i::bigint as c, 0 as round from range(256) t(i)
    union all
    select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, round + 1 from steps where round < 8
)
select list(c order by i) as t from steps where round = 8
"""

OP10 = f"""
with keys as (select distinct coalesce(doc_id::varchar, '') as key from documents),
{_descend(SHARD_TREE, "now")},
{_descend(with_one_more(SHARD_TREE), "grown")},
crc as ({CRC_TABLE}),
bytes as (
    select doc_id, (strlen(coalesce(text, '')) + 16)::bigint as size,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint) as codes
    from documents
),
sums as (
    select doc_id, size, xor(list_reduce([4294967295::bigint] || codes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32
    from bytes, crc
),
placed as (
    select s.*, n.shard, g.shard as grown_shard from sums s
    join now n on n.key = coalesce(s.doc_id::varchar, '') join grown g on g.key = n.key
)
select doc_id, size, text_crc32, 'key' as law, shard,
    row_number() over (partition by shard order by doc_id, text_crc32, size) - 1 as slot, grown_shard
from placed
"""

# Windows as hexadecimal digits, two per byte; kept bytes are put together again from the digits.
OP5 = """
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows as (
    select doc_id, i, substr(h, 2 * i + 1, 100) as w
    from (select doc_id, h, unnest(range(greatest(len(h) // 2 - 49, 0))) as i from docs)
),
first as (select w, min(doc_id) as smallest from windows group by w having min(doc_id) < max(doc_id)),
hits as (select w.doc_id, i from windows w join first f on w.w = f.w where f.smallest < w.doc_id),
marked as (select doc_id, i, i - coalesce(lag(i) over (partition by doc_id order by i), -1000) > 50 as head from hits),
spans as (
    select doc_id, min(i) as a, max(i) + 50 as b
    from (select *, sum(head::int) over (partition by doc_id order by i) as run from marked) group by doc_id, run
),
gaps as (
    select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from spans
),
kept as (
    select d.doc_id, any_value(len(h) // 2) as n_bytes, sum(coalesce(b - a, 0)) as n_removed, count(a) as n_spans,
        coalesce(string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a), '')
            || substr(any_value(h), 2 * coalesce(max(b), 0) + 1) as rest
    from docs d left join gaps g on d.doc_id = g.doc_id group by d.doc_id
)
select doc_id, n_bytes::bigint as n_bytes, n_removed::bigint as n_removed, n_spans, sha256(unhex(rest)) as kept_sha256 from kept
"""

def _merkle_tier(name: str, bottom: str, travellers: str, levels: int) -> str:
    """SQL of the trees over `bottom` (tree, idx, digest), climbed by `travellers`.

    A traveller has (tree, place, siblings, folded): at each level it takes up the siblings of its
    place and folds them with what it carries.
    """
    steps = [f"""
{name}0 as (select tree, idx, digest, count(*) over (partition by tree) as size from {bottom}),
{name}_way0 as (select * from {travellers})"""]
    for level in range(levels):
        steps.append(f"""
{name}_run{level} as (
    select tree, idx // 16 as idx, list(digest order by idx) as run, any_value(size) as size from {name}{level} group by 1, 2
),
{name}{level + 1} as (
    select tree, idx, case when size = 1 then run[1] else sha256(array_to_string(run, '')) end as digest, (size + 15) // 16 as size
    from {name}_run{level}
),
{name}_way{level + 1} as (
    select w.* replace (
        w.place // 16 as place,
        case when r.size = 1 then siblings
            else siblings || array_to_string(list_filter(run, lambda d, i: i <> w.place % 16 + 1), '') end as siblings,
        case when r.size = 1 then folded else sha256(array_to_string(
            list_transform(run, lambda d, i: case when i = w.place % 16 + 1 then folded else d end), '')) end as folded
    )
    from {name}_way{level} w join {name}_run{level} r on r.tree = w.tree and r.idx = w.place // 16
)""")
    return ",".join(steps)


def op11(levels: int = 6) -> str:
    """Six levels per tier: up to 16 million leaves a source, and as many sources."""

    def field(value: str) -> str:
        return f"coalesce(strlen({value})::varchar || ':' || {value}, '-')"

    head = " || ".join(field(f"{name}::varchar") for name in ("doc_id", "source", "lang", "n_chars"))
    shown = f"case when tampered then {field(LOWER.format('text'))} else {field('text')} end"
    return f"""
with crc as ({CRC_TABLE}),
rows as (
    select *, {head} as head, xor(list_reduce([4294967295::bigint] || list_transform(
        string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 as tampered
    from documents, crc
),
digests as (select doc_id, source, sha256(head || {field('text')}) as digest, sha256(head || {shown}) as shown from rows),
leaves as (
    select *, dense_rank() over (order by source nulls first) - 1 as tree,
        row_number() over (partition by source order by doc_id nulls first, digest) - 1 as idx
    from digests
),
climbers as (select doc_id, digest as leaf, tree, idx as place, '' as siblings, shown as folded from leaves),{_merkle_tier("low", "leaves", "climbers", levels)},
subroots as (select 0 as tree, tree as idx, digest from low{levels}),
arrived as (
    select w.doc_id, w.leaf, s.digest as subroot, 0 as tree, w.tree as place, siblings, folded
    from low_way{levels} w join subroots s on s.idx = w.tree
),{_merkle_tier("high", "subroots", "arrived", levels)}
select doc_id, leaf, subroot, r.digest as root, sha256(siblings) as proof_sha256, folded as folded_root, folded = r.digest as verified
from high_way{levels}, high{levels} r
"""


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {at + 1}, 5))::bigint >> {shift}) & 31)::bigint + 1, 1)"
    for at in range(0, 40, 5) for shift in (15, 10, 5, 0)
)
OP12 = f"""
with rows as (
    select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h,
        max(page_id) over (partition by coalesce(html, '')) as keep
    from pages
)
select page_id, payload_bytes::bigint as payload_bytes, {_BASE32} as payload_digest,
    case when page_id is not distinct from keep then 'response' else 'revisit' end as record_type,
    case when page_id is distinct from keep then keep end as refers_to
from rows
"""

OP13_TERMS = (
    "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
OP13 = f"""
with tokens as (select doc_id, unnest({OP13_TERMS}) as term from documents),
counts as (select doc_id, term, count(*) as tf from tokens group by all),
lengths as (select doc_id, sum(tf)::bigint as n from counts group by doc_id),
corpus as (select count(*) as docs, sum(n)::bigint as words from lengths),
frequency as (select term, count(*) as df from counts group by term),
weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w from frequency, corpus),
norms as (select doc_id, 100 - 50 + (50 * n * docs) // words as m from lengths, corpus),
asked as (select distinct item_id, unnest({OP13_TERMS}) as term from benchmark),
scored as (
    select item_id, c.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
    from asked a join weights using (term) join counts c using (term) join norms d on d.doc_id = c.doc_id group by 1, 2
),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from scored where score > 0)
select item_id, place::int as rank, doc_id, score from ranked where place <= 50
"""

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": OP1,
    "op4_url_templates": op4(),
    "op5_suffix_dedup": OP5,
    "op8_mixing": OP8,
    "op9_line_dedup": OP9,
    "op10_sharding": OP10,
    "op11_merkle": op11(),
    "op12_warc": OP12,
    "op13_ranked_search": OP13,
}
