"""SQL for each query, written the naive way: full masks, full score tables, plain sums."""

from __future__ import annotations

from checks.inputs import EVENTS_K, LINES_EMPTY_K, LINES_K

ORACLE_SQL: dict[str, str] = {}

LINES = """
lines as (
  select cast(o_custkey as varchar) user_id, cast(l_partkey as varchar) item_id,
         cast(epoch(o_orderdate) as bigint) "timestamp", l_orderkey order_key,
         l_linenumber line_number, cast(round(l_extendedprice * 100) as bigint) cents,
         l_quantity rating
  from orders join lineitem on o_orderkey = l_orderkey)"""

EVENTS = """
clicks as (
  select cast(user_id as varchar) user_id, json_extract_string(props, '$.k') item_id,
         epoch_us(ts) "timestamp", event_id
  from events where json_extract_string(props, '$.k') is not null)"""


def prepared(view: str, order: str) -> str:
    """Encode and split: `encoded`, `train`, `test`, `users`, `items`, `seen`."""
    return f"""
encoded as (
  select *, dense_rank() over (order by user_id) - 1 user_idx,
            dense_rank() over (order by item_id) - 1 item_idx from {view}),
ranked as (
  select *, row_number() over (partition by user_idx order by {order}) last_first from encoded),
train as (select * exclude (last_first) from ranked where last_first > 1),
test as (select * exclude (last_first) from ranked where last_first = 1),
users as (select distinct user_id, user_idx idx from encoded),
items as (select distinct item_id, item_idx idx from encoded),
seen as (select distinct user_idx, item_idx from train)"""


# A chain beside a dense core: every nation is linked with the next, so that with two partners
# required the chain falls apart from its ends, one link per pass.
CHAIN = """
chain as (
  select 'u' || cast(n_nationkey as varchar) user_id, 'i' || cast(n_nationkey + d as varchar) item_id
  from nation, (select unnest([0, 1]) d)
  union all
  select 'c' || cast(o_custkey as varchar), 'd' || cast(o_custkey % 10 + d as varchar)
  from (select distinct o_custkey from orders), (select unnest([0, 1, 2]) d))"""

LINE_LAST = '"timestamp" desc, order_key desc, line_number desc, item_idx desc, cents desc'
LINE_PREFIX = LINES.replace(",\n         l_quantity rating", "") + "," + prepared("lines", LINE_LAST)
EVENT_PREFIX = EVENTS + "," + prepared("clicks", '"timestamp" desc, event_id desc')
LINES_ONLY = LINES.replace(",\n         l_quantity rating", "")


def confidence(alpha: float, source: str = "train", name: str = "confidence") -> str:
    """`{name}(item_idx, c)`: c0 = 64 spread over all items by popularity to the alpha."""
    return f"""
{name}_share as (
  select items.idx item_idx,
         power(greatest(coalesce(n, 0) / (select cast(count(*) as double) from {source}), 1e-12), {alpha}) share
  from items left join (select item_idx, count(*) n from {source} group by 1) counts
    on counts.item_idx = items.idx),
{name} as (
  select item_idx, 64.0::double * share / (select sum(share) from {name}_share) c from {name}_share)"""


def grid_start(k: int) -> str:
    """`p0(idx, x0..)` and `q0(idx, x0..)`: vectors of multiples of 1/64."""
    p = ", ".join(f"((idx * {2 * f + 7} + {f + 3}) % {17 + 2 * f} - {8 + f}) / 64.0::double x{f}" for f in range(k))
    q = ", ".join(f"((idx * {4 * f + 11} + {f + 2}) % {19 + 2 * f} - {9 + f}) / 64.0::double x{f}" for f in range(k))
    return f"""
p0 as materialized (select idx, {p} from users),
q0 as materialized (select idx, {q} from items)"""


def digest_start(k: int, seed: int = 42) -> str:
    """`p0` and `q0`: pairs of normal components from digests of seed, side, index and place."""
    def cells(side: str) -> str:
        columns = []
        for f in range(k):
            digest = f"md5(concat_ws('|', '{seed}', '{side}', cast(idx as varchar), '{f // 2}'))"
            u = f"(cast('0x' || substr({digest}, 1, 13) as bigint) + 1) / power(16.0::double, 13)"
            v = f"(cast('0x' || substr({digest}, 14, 13) as bigint) + 1) / power(16.0::double, 13)"
            turn = "sin" if f % 2 else "cos"
            columns.append(f"0.01::double * sqrt(-2.0::double * ln({u})) * {turn}(2.0::double * pi() * {v}) x{f}")
        return ", ".join(columns)

    return f"""
p0 as materialized (select idx, {cells('user')} from users),
q0 as materialized (select idx, {cells('item')} from items)"""


def half_step(new: str, old: str, other: str, key: str, other_key: str, k: int, conf: str, source: str) -> str:
    """`{new}`: one sweep of all vectors in `{old}`, given `{other}`; regularisation 0.01.

    The normal equations are summed per entity; then one factor after the other is set,
    each from the newest values of the factors before it.
    """
    item_side = key == "item_idx"
    pairs = [(f, g) for f in range(k) for g in range(f, k)]
    weighted = "1.0::double" if item_side else "c"
    gram = ", ".join(f"sum({weighted} * x{f} * x{g}) s{f}_{g}" for f, g in pairs)
    gram_from = f"{other}" if item_side else f"{other} join {conf} on item_idx = idx"
    sums = ", ".join(f"sum((1.0::double - c) * x{f} * x{g}) a{f}_{g}" for f, g in pairs)
    values = ", ".join(f"sum(x{f}) b{f}" for f in range(k))
    steps = [f"""
{new}_gram as materialized (select {gram} from {gram_from}),
{new}_sums as materialized (
  select t.{key} idx, {sums}, {values} from {source} t join {other} o on t.{other_key} = o.idx
  join {conf} w on t.item_idx = w.item_idx group by 1),
{new}_0 as materialized (
  select o.*, e.* exclude (idx), g.*, e.idx is not null trained, {'w.c' if item_side else '1.0::double'} weight
  from {old} o left join {new}_sums e on e.idx = o.idx
  {f'join {conf} w on w.item_idx = o.idx' if item_side else ''} cross join {new}_gram g)"""]

    def a(f: int, g: int) -> str:
        low, high = min(f, g), max(f, g)
        return f"(a{low}_{high} + weight * s{low}_{high})"

    for f in range(k):
        rest = "".join(f" - {a(f, g)} * x{g}" for g in range(k) if g != f)
        steps.append(f"""
{new}_{f + 1} as materialized (
  select * replace (case when trained then
    (b{f}{rest}) / greatest(a{f}_{f} + weight * s{f}_{f} + 0.01::double, 1e-10::double)
    else x{f} end as x{f}) from {new}_{f})""")
    columns = ", ".join(f"x{f}" for f in range(k))
    steps.append(f"\n{new} as materialized (select idx, {columns} from {new}_{k})")
    return ",".join(steps)


def epochs(n: int, k: int, conf: str = "confidence", source: str = "train", tag: str = "") -> str:
    """`p1{tag}, q1{tag}, p2{tag}, ...` from `p0` and `q0`."""
    steps = []
    for epoch in range(1, n + 1):
        before = "" if epoch == 1 else tag
        p_old, q_old = f"p{epoch - 1}{before}", f"q{epoch - 1}{before}"
        p_new, q_new = f"p{epoch}{tag}", f"q{epoch}{tag}"
        steps.append(half_step(p_new, p_old, q_old, "user_idx", "item_idx", k, conf, source))
        steps.append(half_step(q_new, q_old, p_new, "item_idx", "user_idx", k, conf, source))
    return ",".join(steps)


def rounded_columns(k: int, digits: int = 6) -> str:
    return ", ".join(f"round(x{f}, {digits}) + 0.0 x{f}" for f in range(k))


def both_sides(p: str, q: str, k: int, digits: int = 6) -> str:
    columns = rounded_columns(k, digits)
    return (
        f"select 'user' side, idx, {columns} from {p} union all select 'item', idx, {columns} from {q}"
    )


def score(k: int) -> str:
    return " + ".join(f"p.x{f} * q.x{f}" for f in range(k))


def ranks(p: str, q: str, k: int, name: str = "ranks", test: str = "test") -> str:
    """`{name}(user_idx, item_idx, rk)`: score everything, mask what was seen, count."""
    return f"""
{name}_masked as (
  select p.idx user_idx, q.idx item_idx, case when seen.user_idx is null then {score(k)} end s
  from {test} t join {p} p on p.idx = t.user_idx cross join {q} q
  left join seen on seen.user_idx = p.idx and seen.item_idx = q.idx),
{name}_held as (
  select m.user_idx, m.item_idx, m.s from {name}_masked m join {test} t
  on m.user_idx = t.user_idx and m.item_idx = t.item_idx),
{name} as (
  select h.user_idx, h.item_idx,
         cast(1 + sum(case when m.s is not null and (h.s is null or m.s > h.s) then 1 else 0 end) as bigint) rk
  from {name}_masked m join {name}_held h on m.user_idx = h.user_idx group by 1, 2)"""


def metrics(name: str = "ranks", top_k: int = 100) -> tuple[str, str]:
    hr = f"avg(case when rk <= {top_k} then 1.0::double else 0.0 end)"
    ndcg = f"avg(case when rk <= {top_k} then 1.0::double / log2(cast(rk + 1 as double)) else 0.0 end)"
    return hr, ndcg


def best(p: str, q: str, k: int, n: int) -> str:
    """`best(user_idx, item_idx, score, rn)`: the n best unseen items per user."""
    return f"""
best as (
  select user_idx, item_idx, score, cast(rn as int) rn from (
    select *, row_number() over (partition by user_idx order by score desc, item_idx) rn from (
      select p.idx user_idx, q.idx item_idx, {score(k)} + 0.0 score
      from {p} p cross join {q} q left join seen on seen.user_idx = p.idx and seen.item_idx = q.idx
      where seen.user_idx is null)) where rn <= {n})"""


def kcore_passes(view: str, columns: str, k: int) -> str:
    """`core(..., it)`: what is left after `it` passes, as long as they change something.

    `settled`: the rows of the last pass that stay, which are none if it removes the rest.
    """
    counted = "count(*) over (partition by user_id) cu, count(*) over (partition by item_id) ci"
    return f"""
core as (
  select {columns}, 0 it from {view}
  union all
  select {columns}, it + 1 from (
    select *, max(case when cu < {k} or ci < {k} then 1 else 0 end) over () changes
    from (select *, {counted} from core))
  where cu >= {k} and ci >= {k} and changes = 1),
settled as (
  select {columns}, it from (select *, {counted} from core where it = (select max(it) from core))
  where cu >= {k} and ci >= {k})"""


def kcore_stats(k: int) -> str:
    return f"""with recursive {LINES_ONLY}, {kcore_passes('lines', 'user_id, item_id', k)},
sizes as (select count(*) n, count(distinct user_id) u, count(distinct item_id) i from settled),
last as (select max(it) + case when (select n from sizes) = 0 then 2 else 1 end passes from core)
select cast(passes as bigint) passes, n n_rows, u n_users, i n_items, n loop_rows, u loop_users, i loop_items
from last, sizes"""


LINE_COLUMNS = 'user_id, item_id, "timestamp", order_key, line_number, cents'
SPLIT_COLUMNS = 'user_idx, item_idx, "timestamp", order_key, line_number, cents'
EVENT_COLUMNS = 'user_id, item_id, "timestamp", event_id'


def digest(columns: str, *salts: int) -> str:
    """md5 of the values, each after its length; nulls are `n;`."""
    values = [f"cast({c.strip()} as varchar)" for c in columns.split(",")] + [f"'{salt}'" for salt in salts]
    return "md5(" + " || ".join(f"coalesce(length({v}) || ':' || {v}, 'n;')" for v in values) + ")"


CHOSEN = f"""
chosen as (
  select * from test
  order by {digest('user_idx, item_idx', 42, 1)}, user_idx, item_idx
  limit 500)"""

SAMPLE_KEY = "user_id, item_id, order_key, line_number, cents"
SAMPLE_ORDER = f"{digest(SAMPLE_KEY, 42)}, {digest(LINE_COLUMNS)}"


def sampled(fraction: float) -> str:
    return f"""with {LINES_ONLY}, placed as (
  select *, row_number() over (order by {SAMPLE_ORDER}) place
  from lines)
select {LINE_COLUMNS} from placed where place <= (select round_even({fraction} * count(*), 0) from lines)"""


def objective(p: str, q: str, k: int) -> str:
    """The loss cell by cell: all users times all items, the rows' errors, the norms."""
    squares = " + ".join(f"x{f} * x{f}" for f in range(k))
    return f"""(
  select round(
    (select sum(c * ({score(k)}) * ({score(k)})) from {p} p, {q} q join confidence w on w.item_idx = q.idx)
    + (select sum((1.0::double - s) * (1.0::double - s) - c * s * s) from (
        select {score(k)} s, c from train t join {p} p on p.idx = t.user_idx join {q} q on q.idx = t.item_idx
        join confidence w on w.item_idx = t.item_idx))
    + 0.01::double * ((select sum({squares}) from {p}) + (select sum({squares}) from {q})), 4) + 0.0)"""


def on_lines(select: str, *parts: str) -> str:
    return "with " + ",".join([LINE_PREFIX, *parts]) + "\n" + select


def on_events(select: str, *parts: str) -> str:
    return "with " + ",".join([EVENT_PREFIX, *parts]) + "\n" + select


HISTORY = """
h as (
  select case when event_id % 2 = 0 then 'uniform' else 'popularity' end variant,
         cast(floor(event_id / greatest((select count(*) from events) / 20.0::double, 1.0::double)) as int) + 1 epoch,
         round(avg(value), 2) time_s,
         round(sum(case when event_type = 'click' then 1 else 0 end) / cast(count(*) as double), 4) hr,
         round(sum(case when event_type = 'view' then 1 else 0 end) / cast(count(*) as double), 4) ndcg
  from events group by 1, 2)"""
GAPS = """
gaps as (
  select variant, epoch, time_s, case when time_s > m then null else hr end hr,
         case when time_s > m then null else ndcg end ndcg
  from h, (select avg(time_s) m from h))"""


def on_history(select: str, *parts: str) -> str:
    return "with " + ",".join([HISTORY, *parts]) + "\n" + select


def best_of(source: str, missing_as_zero: bool = False) -> str:
    key = "coalesce(hr, 0.0)" if missing_as_zero else "hr"
    where = "" if missing_as_zero else "where hr is not null"
    return f"""
winner as (
  select variant, epoch, hr, ndcg from (
    select *, row_number() over (partition by variant order by {key} desc, epoch) rn from {source} {where})
  where rn = 1)"""


def summary_of(train_users: str, train_items: str) -> str:
    return f"""select cast({train_users} as bigint) n_users, cast({train_items} as bigint) n_items,
  count(*) n_train, (select count(*) from test) n_test,
  round(1.0::double - count(*) / (cast({train_users} as double) * {train_items}), 8) + 0.0 sparsity from train"""


ORACLE_SQL.update({
    "interactions": f"with {LINES_ONLY} select {LINE_COLUMNS} from lines",
    "interactions_events": f"with {EVENTS} select {EVENT_COLUMNS} from clicks",
    "ratings_csv": f"""with {LINES}
select case when order_key % 5 = 0 then 'a"b""c,' || user_id else user_id end user_id,
       case when order_key % 7 = 0 then null else item_id end item_id,
       case when line_number % 3 = 0 then null else rating end rating, "timestamp" from lines""",
    "sample_exact_collisions": f"""with {LINES_ONLY}, clashing as (
  select unnest([user_id || '|' || item_id, user_id, null, '']) user_id,
         unnest(['c', item_id || '|c', item_id, item_id]) item_id, order_key, line_number, cents from lines),
placed as (
  select *, row_number() over (order by {digest('user_id, item_id', 42)},
    {digest('user_id, item_id, order_key, line_number, cents')}) place from clashing)
select * exclude (place) from placed where place <= (select round_even(0.34 * count(*), 0) from clashing)""",
    "sample_exact_repeats": f"""with {LINES_ONLY}, placed as (
  select *, row_number() over (order by {digest('user_id', 42)}, {digest(LINE_COLUMNS)}) place from lines)
select {LINE_COLUMNS} from placed where place <= (select round_even(0.3 * count(*), 0) from lines)""",
    "training_relation": on_lines("select user_idx, item_idx, 1.0::double r, 1.0::double w from train"),
    "train_preview": on_lines(
        'select user_idx, item_idx, "timestamp", order_key, line_number, cents from train '
        'order by user_idx, "timestamp", order_key, line_number, item_idx, cents limit 20'
    ),
    "sample_exact": sampled(0.2),
    "sample_exact_half": sampled(0.5),
    "user_item_counts": f"""with {LINES_ONLY}
select 'user' side, user_id id, count(*) n from lines group by 2
union all select 'item', item_id, count(*) from lines group by 2""",
    "kcore_single_pass": f"""with recursive {LINES_ONLY},
{kcore_passes('lines', LINE_COLUMNS, LINES_K)} select {LINE_COLUMNS} from core where it = 1""",
    "kcore": f"""with recursive {LINES_ONLY},
{kcore_passes('lines', LINE_COLUMNS, LINES_K)} select {LINE_COLUMNS} from settled""",
    "kcore_events": f"""with recursive {EVENTS},
{kcore_passes('clicks', EVENT_COLUMNS, EVENTS_K)} select {EVENT_COLUMNS} from settled""",
    "kcore_many_passes": f"""with recursive {CHAIN}, {kcore_passes('chain', 'user_id, item_id', 2)}
select user_id, item_id, cast((select max(it) + 1 from core) as bigint) passes from settled""",
    "kcore_stats": kcore_stats(LINES_K),
    "kcore_empty": kcore_stats(LINES_EMPTY_K),
    "id_dictionary_user": on_lines("select user_id id, idx from users"),
    "id_dictionary_item": on_lines("select item_id id, idx from items"),
    "encode_ids": on_lines(f"select {LINE_COLUMNS}, user_idx, item_idx from encoded"),
    "cardinalities": on_lines(
        "select (select count(*) from users) n_users, (select count(*) from items) n_items"
    ),
    "loo_test": on_lines(f"select {SPLIT_COLUMNS} from test"),
    "loo_train": on_lines(f"select {SPLIT_COLUMNS} from train"),
    "loo_test_events": on_events('select user_idx, item_idx, "timestamp", event_id from test'),
    "item_popularity": on_lines("""select items.idx item_idx,
  round(coalesce(n, 0) / (select cast(count(*) as double) from train), 12) + 0.0 f
from items left join (select item_idx, count(*) n from train group by 1) c on c.item_idx = items.idx"""),
    "item_confidence_uniform": on_lines(
        "select idx item_idx, round(64.0::double / (select count(*) from items), 9) + 0.0 c from items"
    ),
    "item_confidence_pop": on_lines("select item_idx, round(c, 9) + 0.0 c from confidence", confidence(0.5)),
    "item_confidence_stats": on_lines(
        "select round(min(c), 9) + 0.0 min_c, round(max(c), 9) + 0.0 max_c, round(avg(c), 9) + 0.0 mean_c "
        "from confidence", confidence(0.5)
    ),
    "dataset_summary": on_lines(summary_of("count(distinct user_idx)", "count(distinct item_idx)")),
    "dataset_summary_encoded": on_lines(
        summary_of("(select count(*) from users)", "(select count(*) from items)")
    ),
    "factor_init": on_lines(both_sides("p0", "q0", 8, 9), digest_start(8)),
    "train_with_conf": on_lines(
        "select user_idx, train.item_idx, 1.0::double r, 1.0::double w, round(c, 9) + 0.0 c "
        "from train join confidence on confidence.item_idx = train.item_idx", confidence(0.5)
    ),
    "user_group_sizes": on_lines("select user_idx, count(*) n_rows from train group by 1"),
    "item_group_sizes": on_lines("select item_idx, count(*) n_rows from train group by 1"),
    "gram_items": on_lines(
        " union all ".join(
            f"select {f}::int f, {g}::int g, round(sum(c * x{f} * x{g}), 6) + 0.0 as value "
            "from q0 join confidence on item_idx = idx" for f in range(4) for g in range(f, 4)
        ), confidence(0.5), grid_start(4),
    ),
    "gram_users": on_lines(
        " union all ".join(
            f"select {f}::int f, {g}::int g, round(sum(x{f} * x{g}), 6) + 0.0 as value from p0"
            for f in range(4) for g in range(f, 4)
        ), grid_start(4),
    ),
    "user_half_step_k2": on_lines(
        f"select idx user_idx, {rounded_columns(2)} from p1", confidence(0.5), grid_start(2), epochs(1, 2)
    ),
    "item_half_step_k2": on_lines(
        f"select idx item_idx, {rounded_columns(2)} from q1", confidence(0.5), grid_start(2), epochs(1, 2)
    ),
    "one_epoch_k2": on_lines(both_sides("p1", "q1", 2), confidence(0.5), grid_start(2), epochs(1, 2)),
    "one_epoch_events": on_events(both_sides("p1", "q1", 4), confidence(0.5), grid_start(4), epochs(1, 4)),
    "one_epoch_hot": on_lines(both_sides("p1", "q1", 4), confidence(0.5), grid_start(4), epochs(1, 4)),
    "cold_entities_keep_init": on_lines(
        both_sides("p1", "q1", 2), "\ncheap as (select * from train where cents < 500000)",
        confidence(0.5, "cheap"), grid_start(2), epochs(1, 2, source="cheap"),
    ),
    "train_k8": on_lines(both_sides("p2", "q2", 8), confidence(0.5), digest_start(8), epochs(2, 8)),
    "one_epoch_ranges": on_lines(both_sides("p1", "q1", 4), confidence(0.5), grid_start(4), epochs(1, 4)),
    "objective_k4": on_lines(
        " union all ".join(
            f"select {epoch}::int epoch, '{step}' step, {objective(p, q, 4)} objective"
            for epoch, step, p, q in (
                (0, "start", "p0", "q0"), (1, "users", "p1", "q0"), (1, "items", "p1", "q1"),
                (2, "users", "p2", "q1"), (2, "items", "p2", "q2"),
            )
        ), confidence(0.5), grid_start(4), epochs(2, 4),
    ),
    "resume_equals_full": on_lines(
        "select 'user' side, count(*) n, 0::bigint n_different from users "
        "union all select 'item', count(*), 0 from items"
    ),
    "guard_empty_data": f"""with recursive {LINES_ONLY}, {kcore_passes('lines', LINE_COLUMNS, LINES_EMPTY_K)}
select count(*) n_ratings, case when (select count(*) from settled) = 0
  then 'no users or items left: lower min_interactions or raise sample_fraction' end message from lines""",
    "guard_no_training_rows": on_lines(
        "select count(*) n_test, 'the training rows are needed to leave out what a user has seen' message from test"
    ),
    "warm_start_equals_full": on_lines(
        "select 'user' side, count(*) n, 0::bigint n_different from users "
        "union all select 'item', count(*), 0 from items"
    ),
    "score_pairs": on_lines(
        f"select user_idx, item_idx, {score(2)} + 0.0 score from seen join p0 p on p.idx = user_idx "
        "join q0 q on q.idx = item_idx", grid_start(2)
    ),
    "predict_user": on_lines(
        f"select q.idx item_idx, {score(2)} + 0.0 score from q0 q, p0 p where p.idx = 0", grid_start(2)
    ),
    "predict_all": on_lines(
        f"select user_idx, count(*) n_scores, max(s) max_score, min(s) min_score, sum(s) sum_scores from "
        f"(select p.idx user_idx, {score(4)} s from p0 p cross join q0 q) group by 1", grid_start(4)
    ),
    "recommend_user": on_lines(
        "select item_idx, score from best where user_idx = 0", grid_start(2), best("p0", "q0", 2, 10)
    ),
    "recommend_all": on_lines("select * from best", grid_start(2), best("p0", "q0", 2, 10)),
    "recommend_all_events": on_events("select * from best", grid_start(4), best("p0", "q0", 4, 50)),
    "recommend_decoded": on_lines(
        "select user_id, item_id, score, rn from best join users u on u.idx = user_idx "
        "join items i on i.idx = item_idx", grid_start(4), best("p0", "q0", 4, 10)
    ),
    "seen_items": on_lines("select user_idx, item_idx from seen"),
    "eval_subsample": on_lines(f"""select user_idx, item_idx from (
  select *, row_number() over (order by {digest('user_idx, item_idx', 42, 0)},
    user_idx, item_idx) place from test) where place <= 500"""),
    "test_item_rank": on_lines(
        "select user_idx, item_idx, rk as rank from ranks", grid_start(2), ranks("p0", "q0", 2)
    ),
})


def _metrics_sql(top_k: int = 100) -> str:
    hr, ndcg = metrics(top_k=top_k)
    return f"select count(*) n, round({hr}, 6) + 0.0 hr, round({ndcg}, 6) + 0.0 ndcg from ranks"


def _variant(tag: str, variant: str, alpha: float, k: int = 4) -> tuple[list[str], str]:
    """Two epochs, and the metrics after each."""
    parts = [confidence(alpha, name=f"confidence{tag}"), epochs(2, k, f"confidence{tag}", tag=tag)]
    selects = []
    for epoch in (1, 2):
        name = f"ranks{epoch}{tag}"
        parts.append(ranks(f"p{epoch}{tag}", f"q{epoch}{tag}", k, name))
        hr, ndcg = metrics()
        selects.append(
            f"select '{variant}' variant, {epoch}::int epoch, round({hr}, 4) + 0.0 hr, "
            f"round({ndcg}, 4) + 0.0 ndcg, true timed from {name}"
        )
    return parts, " union all ".join(selects)


_popular, _popular_select = _variant("_b", "popularity", 0.5)
_uniform, _uniform_select = _variant("_a", "uniform", 0.0)

_popular8, _popular8_select = _variant("_b", "popularity", 0.5, 8)
_uniform8, _uniform8_select = _variant("_a", "uniform", 0.0, 8)

ORACLE_SQL.update({
    "experiment_run": f"""with recursive {LINES_ONLY}, placed as (
  select *, row_number() over (order by {SAMPLE_ORDER}) place from lines),
sampled as (
  select * exclude (place) from placed where place <= (select round_even(0.5 * count(*), 0) from lines)),
{kcore_passes('sampled', LINE_COLUMNS, 8)},
kept as (select {LINE_COLUMNS} from settled),
{prepared('kept', LINE_LAST)},
{','.join([digest_start(8), *_uniform8, *_popular8])},
records as ({_uniform8_select} union all {_popular8_select})
select variant, epoch best_epoch, hr, ndcg, true timed from (
  select *, row_number() over (partition by variant order by hr desc, epoch) rn from records) where rn = 1""",
    "train_and_recommend": on_lines(
        "select user_id, item_id, round(score, 6) + 0.0 score, rn from best join users u on u.idx = user_idx "
        "join items i on i.idx = item_idx",
        confidence(0.5), digest_start(8), epochs(2, 8), best("p2", "q2", 8, 10),
    ),
    "epoch_history": on_lines(_popular_select, grid_start(4), *_popular),
    "compare_variants": on_lines(
        _uniform_select + " union all " + _popular_select, grid_start(4), *_uniform, *_popular
    ),
    "hr_ndcg": on_lines(_metrics_sql(), grid_start(2), ranks("p0", "q0", 2)),
    "hr_ndcg_events": on_events(_metrics_sql(20), grid_start(4), ranks("p0", "q0", 4)),
    "hr_ndcg_subsample": on_lines(
        _metrics_sql(), CHOSEN, grid_start(2), ranks("p0", "q0", 2, test="chosen")
    ),
    "evaluator_subsample": on_lines(
        _metrics_sql(), CHOSEN, grid_start(2), ranks("p0", "q0", 2, test="chosen")
    ),
    "format_history": on_history('select variant, epoch, time_s, hr "HR@100", ndcg "NDCG@100" from h'),
    "history_csv": on_history("select variant, epoch, time_s, hr, ndcg from h"),
    "best_epoch": on_history("select * from winner", GAPS, best_of("gaps")),
    "best_epoch_coalesced": on_history("select * from winner", GAPS, best_of("gaps", True)),
    "variant_summary": on_history(
        "select variant, epoch best_epoch, hr, ndcg, t avg_time_s from "
        "(select variant, round_even(avg(time_s), 2) t from h group by 1) left join winner using (variant)",
        best_of("h"),
    ),
    "relative_gain": on_history(
        "select round((p.hr - u.hr) / (u.hr + 1e-12) * 100, 6) + 0.0 hr_gain_pct, "
        "round((p.ndcg - u.ndcg) / (u.ndcg + 1e-12) * 100, 6) + 0.0 ndcg_gain_pct "
        "from winner p, winner u where p.variant = 'popularity' and u.variant = 'uniform'", best_of("h"),
    ),
    "epoch_times_aligned": on_history("""select u.epoch, u.time_s left_time_s, p.time_s right_time_s,
  (select round(avg(time_s), 6) + 0.0 from h where variant = 'uniform') left_mean_s,
  (select round(avg(time_s), 6) + 0.0 from h where variant = 'popularity') right_mean_s
from h u join h p on u.epoch = p.epoch and u.variant = 'uniform' and p.variant = 'popularity'"""),
    "hr_pivot": on_history("""select epoch, max(case when variant = 'uniform' then hr end) uniform,
  max(case when variant = 'popularity' then hr end) popularity from h group by 1"""),
})
