"""DuckDB SQL for the rows of ``queries``. Folds are recursive CTEs, row by row, where Spark uses windows or a stream."""

from cadentia.functions.boxes import LTRB_KEYS, NESTED_KEYS, POLYGON_KEYS, XYWH_KEYS
from cadentia.operators.signal import gauss_weights
from cadentia.plans.rules import BOX_FORMS, CORRECTION_FORMS, GT_RULES, LEAST_IOU, RULES

_EVENTS = """ev as (
  select user_id as match_id, event_id as seq, epoch_us(ts) / 1e6::double as ts, value,
         case when event_type in ('click', 'purchase') then 'player_a' when event_type in ('view', 'signup') then 'player_b' else 'unknown' end as winner
  from events),
known as (select *, row_number() over (partition by match_id order by ts, seq) as rn from ev where winner <> 'unknown')"""


def _replay(best_of: int) -> str:
    need = best_of // 2 + 1
    return f"""{_EVENTS},
st as (
  select match_id, 0::bigint as rn, null::bigint as seq, null::double as ts, 1 as set_number, 0 as score_a, 0 as score_b, 0 as sets_a, 0 as sets_b, null::varchar as winner, null::int as closed_a, null::int as closed_b
  from (select distinct match_id from known)
  union all
  select match_id, rn, seq, ts,
         case when won and not over then set_number + 1 else set_number end,
         case when won and not over then 0 else na end, case when won and not over then 0 else nb end, wa, wb,
         case when win is not null then win when wa >= {need} then 'player_a' when wb >= {need} then 'player_b' end,
         case when won then na end, case when won then nb end
  from (
    select *, wa >= {need} or wb >= {need} as over from (
      select *, sets_a + (won and na > nb)::int as wa, sets_b + (won and nb > na)::int as wb from (
        select *, win is null and greatest(na, nb) >= 11 and abs(na - nb) >= 2 as won from (
          select k.match_id, k.rn, k.seq, k.ts, st.set_number, st.sets_a, st.sets_b, st.winner as win,
                 st.score_a + (st.winner is null and k.winner = 'player_a')::int as na, st.score_b + (st.winner is null and k.winner = 'player_b')::int as nb
          from st join known k on k.match_id = st.match_id and k.rn = st.rn + 1)))))"""


def _timeline(best_of: int) -> str:
    return f"with recursive {_replay(best_of)} select match_id, seq, ts, set_number, score_a, score_b, sets_a, sets_b, winner is not null as is_finished, winner from st where rn > 0"


_WINS = "count(*) as n, count(*) filter (where event_type in ('click', 'purchase')) as wins_a, count(*) filter (where event_type in ('view', 'signup')) as wins_b"
_WINDOWED = "select epoch_us({start}) as from_us, epoch_us({start} + interval {days} day) as to_us, {keys}" + _WINS + " from {source} group by {keys}{start}"
_MIXED = "mx as (select * replace (case when winner = 'unknown' and match_id % 3 <> 0 then 'player_a' else winner end as winner) from ev)"
_SIGNAL = "sg as (select user_id as clip, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, epoch_us(ts) / 1e6::double as t, value as v from events)"
_BY = "(partition by clip order by idx)"


def _tap(k: int) -> str:
    return "v" if k == 0 else f"coalesce({'lead' if k > 0 else 'lag'}(v, {abs(k)}) over {_BY}, 0)"


_GAUSS = "gs as (select *, " + " + ".join(f"{w:.17e}::double * {_tap(k - 5)}" for k, w in enumerate(gauss_weights())) + " as smooth from sg)"
_NORMAL = """en as (
  select clip, idx, t, v, least(greatest((smooth - p10) / (p95 - p10 + 1e-6::double), 0), 1) as e
  from (select *, quantile_cont(smooth, 0.10) over (partition by clip) as p10, quantile_cont(smooth, 0.95) over (partition by clip) as p95 from gs))"""
_E = f"{_SIGNAL}, {_GAUSS}, {_NORMAL}"


def _hysteresis(source: str, value: str, high: float, low: float, gap: float, dur: float, name: str, flush: bool = True) -> str:
    """Row by row: active, first hot and last warm sample; what closes at a row, and what is open at the end."""
    end = f"union all select clip, s, st, w, wt from {name}_r where active and idx = (select max(x.idx) from {source} x where x.clip = {name}_r.clip)" if flush else ""
    return f"""{name}_r as (
  select clip, -1::bigint as idx, false as active, null::bigint as s, null::double as st, null::bigint as w, null::double as wt, null::bigint as cs, null::double as cst, null::bigint as cw, null::double as cwt from (select distinct clip from {source})
  union all
  select clip, idx, active2 and not closes, s2, st2, w2, wt2, case when closes then s2 end, case when closes then st2 end, case when closes then w2 end, case when closes then wt2 end
  from (
    select *, active and t - wt2 > {gap}::double as closes from (
      select x.clip, x.idx, x.t, r.active, r.active or x.{value} > {high}::double as active2,
             case when r.active then r.s when x.{value} > {high}::double then x.idx end as s2, case when r.active then r.st when x.{value} > {high}::double then x.t end as st2,
             case when r.active and x.{value} <= {low}::double then r.w else x.idx end as w2, case when r.active and x.{value} <= {low}::double then r.wt else x.t end as wt2
      from {name}_r r join {source} x on x.clip = r.clip and x.idx = r.idx + 1))),
{name} as (
  select clip, st as t_start, wt as t_end, s as i_start, w as i_end
  from (select clip, cs as s, cst as st, cw as w, cwt as wt from {name}_r where cs is not null {end})
  where wt - st > {dur}::double)"""


def _rules(source: str, value: str, r, name: str, flush: bool = True) -> str:
    return _hysteresis(source, value, r.high, r.low, r.max_gap, r.min_dur, name, flush)


_SEGMENTS = f"{_E}, {_rules('en', 'e', RULES, 'hs')}"
_SHOW = "select clip, round(t_start, 6) as t_start, round(t_end, 6) as t_end, i_start, i_end from "
_FUSED = "fu as (select clip, idx, t, greatest(e, case when idx % 3 = 0 then least(v / 100, 1) else 0 end) as x from en)"

_R = RULES
_SPLIT = f"""{_SEGMENTS},
dip as (
  select h.clip, h.i_start, h.i_end, en.idx, en.t, en.idx - row_number() over (partition by h.clip, h.i_start order by en.idx) as run
  from hs h join en on en.clip = h.clip and en.idx between h.i_start and h.i_end where h.t_end - h.t_start > {_R.long}::double and en.e < {_R.split_low!r}::double),
cut as (
  select distinct clip, i_start, (a + b) // 2 as pos from (
    select clip, i_start, i_end, min(idx) as a, max(idx) as b, max(t) - min(t) as lasts from dip group by clip, i_start, i_end, run)
  where lasts >= {_R.split_gap}::double and (a + b) // 2 > i_start and (a + b) // 2 < i_end),
bnd as (
  select clip, i_start, list(pos order by pos) as cuts from cut group by clip, i_start),
seg as (
  select h.*, list_concat([h.i_start], coalesce(b.cuts, []), [h.i_end]) as pts, row_number() over () as sid from hs h left join bnd b on b.clip = h.clip and b.i_start = h.i_start),
pc as (
  select sid, clip, t_start as seg_t, k, pts[k] as a, pts[k + 1] as b, ta.t as ta, tb.t as tb, len(pts) - 1 as n
  from (select *, unnest(range(1, len(pts))) as k from seg) s join en ta using (clip) join en tb using (clip) where ta.idx = pts[k] and tb.idx = pts[k + 1]),
-- the literal loop: walk over pieces, carry the open one
wk as (
  select sid, 0::bigint as k, null::bigint as a, null::bigint as b, null::double as ta, null::double as tb, 0::bigint as extra, 0::bigint as grp, true as lead from (select distinct sid from pc)
  union all
  select p.sid, p.k,
         case when wk.k = 0 then p.a when wk.lead and wk.tb - wk.ta < {_R.min_split}::double then wk.a when p.tb - p.ta < {_R.min_split}::double then wk.a else p.a end, p.b,
         case when wk.k = 0 then p.ta when wk.lead and wk.tb - wk.ta < {_R.min_split}::double then wk.ta when p.tb - p.ta < {_R.min_split}::double then wk.ta else p.ta end, p.tb,
         case when wk.k = 0 then 0 when wk.lead and wk.tb - wk.ta < {_R.min_split}::double then 1 when p.tb - p.ta < {_R.min_split}::double then wk.extra + 1 else 0 end,
         case when wk.k = 0 then 0 when wk.lead and wk.tb - wk.ta < {_R.min_split}::double then wk.grp when p.tb - p.ta < {_R.min_split}::double then wk.grp else wk.grp + 1 end,
         case when wk.k = 0 then true when wk.lead and wk.tb - wk.ta < {_R.min_split}::double then true else false end
  from wk join pc p on p.sid = wk.sid and p.k = wk.k + 1),
grpd as (
  select sid, grp, arg_max(a, k) as a, arg_max(b, k) as b, arg_max(ta, k) as ta, arg_max(tb, k) as tb, arg_max(extra, k) as extra from wk where k > 0 group by sid, grp),
good as (
  select s.clip, s.sid, g.ta as t_start, g.tb as t_end, g.a as i_start, g.b as i_end, list_concat(['split_long'], list_transform(range(0, extra), lambda q: 'merged_short_split')) as flags
  from grpd g join seg s using (sid) where len(s.pts) > 2 and g.tb - g.ta >= {_R.min_dur}::double),
sp as (
  select clip, t_start, t_end, i_start, i_end, flags from good
  union all
  select clip, t_start, t_end, i_start, i_end, case when t_end - t_start > {_R.long}::double then ['long_unsplit'] else []::varchar[] end from seg where sid not in (select sid from good))"""

_FINAL = f"""{_SPLIT},
cf as (
  select sp.clip, sp.t_start, sp.t_end, sp.flags, least(greatest(quantile_cont(en.e, 0.5), 0.5), 1) as confidence
  from sp join en on en.clip = sp.clip and en.idx between sp.i_start and sp.i_end group by sp.clip, sp.t_start, sp.t_end, sp.i_start, sp.i_end, sp.flags),
rn as (
  select *, sum(brk) over (partition by clip order by t_start, t_end) as run from (
    select *, case when t_start - lag(t_end) over (partition by clip order by t_start, t_end) <= {_R.eps}::double then 0 else 1 end as brk from cf)),
rs as (
  select clip, run, count(*) as n, list({{'a': t_start, 'b': t_end, 'c': confidence, 'f': flags}} order by t_start, t_end) as ps, min(t_end - t_start) as shortest from rn group by clip, run),
mg as (
  select clip, case when n = 1 or shortest >= {_R.artefact}::double then list_transform(ps, lambda p: {{'m': [p], 'tag': ''}})
    when n >= {_R.tail_pieces} and ps[1].b - ps[1].a >= {_R.tail_first}::double then [{{'m': ps[1:1], 'tag': ''}}, {{'m': ps[2:], 'tag': 'merged_contiguous_tail_artifact'}}]
    else [{{'m': ps, 'tag': 'merged_contiguous_artifact'}}] end as gs from rs)
select clip, round(g.m[1].a, 6) as t_start, round(g.m[-1].b, 6) as t_end,
       round(case when g.tag = '' then g.m[1].c else least(greatest(list_aggregate(list_transform(g.m, lambda p: p.c), 'median'), 0.5), 1) end, 6) as confidence,
       array_to_string(case when g.tag = '' then g.m[1].f else list_sort(list_distinct(list_append(flatten(list_transform(g.m, lambda p: p.f)), g.tag))) end, '|') as flags
from (select clip, unnest(gs) as g from mg)"""

_SIDES = f"""{_SEGMENTS}, {_rules('en', 'e', GT_RULES, 'hg')},
pr as (select *, row_number() over (partition by clip order by t_start) - 1 as seq, (['player_a', 'player_b', 'unknown'])[i_start % 3 + 1] as winner, round((i_end - i_start) % 10 / 10.0, 1)::double as confidence from hs),
gt as (select *, row_number() over (partition by clip order by t_start) - 1 as seq, (['player_a', 'player_b', 'unknown'])[i_start % 3 + 1] as winner from hg),
cand as (
  select * from (
    select pr.clip, pr.seq as pi, gt.seq as gi, (least(pr.t_end, gt.t_end) - greatest(pr.t_start, gt.t_start)) / (greatest(pr.t_end, gt.t_end) - least(pr.t_start, gt.t_start)) as iou
    from pr join gt on pr.clip = gt.clip where pr.t_start < gt.t_end and gt.t_start < pr.t_end)
  where iou >= {LEAST_IOU}::double)"""
_MATCHES = f"""{_SIDES},
cr as (select *, row_number() over (partition by clip order by iou desc, pi, gi) as rn from cand),
mt as (
  select clip, 0::bigint as rn, []::bigint[] as ps, []::bigint[] as gs, null::bigint as pi, null::bigint as gi, null::double as iou from (select distinct clip from cr)
  union all
  select clip, rn, case when ok then list_append(ps, p) else ps end, case when ok then list_append(gs, g) else gs end, case when ok then p end, case when ok then g end, i
  from (select cr.clip, cr.rn, mt.ps, mt.gs, cr.pi as p, cr.gi as g, cr.iou as i, not list_contains(mt.ps, cr.pi) and not list_contains(mt.gs, cr.gi) as ok from mt join cr on cr.clip = mt.clip and cr.rn = mt.rn + 1)),
ma as (select clip, pi, gi, iou from mt where pi is not null)"""
_CLIPS = f"""{_MATCHES},
cl as (
  select clip, coalesce(tp, 0) as tp, coalesce(np, 0) - coalesce(tp, 0) as fp, coalesce(ng, 0) - coalesce(tp, 0) as fn, coalesce(mi, 0) as mean_iou,
         case when nk > 0 then nr / nk::double else 0 end as winner_accuracy, case when np > 0 then nu / np::double else 0 end as unknown_rate, case when np > 0 then nv / np::double else 0 end as review_rate
  from (select clip, count(*) as np, count(*) filter (winner = 'unknown') as nu, count(*) filter (winner = 'unknown' or confidence < 0.85) as nv from pr group by clip)
  full join (select clip, count(*) as ng from gt group by clip) using (clip)
  left join (
    select ma.clip, count(*) as tp, avg(iou) as mi, count(*) filter (gt.winner <> 'unknown') as nk, count(*) filter (gt.winner <> 'unknown' and gt.winner = pr.winner) as nr
    from ma join pr on pr.clip = ma.clip and pr.seq = pi join gt on gt.clip = ma.clip and gt.seq = gi group by ma.clip) using (clip)),
rt as (select *, case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as recall from cl),
ra as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from rt)"""

_POINTS = """pt as (
  select o_custkey as clip, o_orderkey as seq, epoch_us(o_orderdate) / 1e6::double as t_start, epoch_us(o_orderdate) / 1e6::double + o_orderkey % 7 * 60 as t_end,
         case o_orderstatus when 'F' then 'player_a' when 'O' then 'player_b' else 'unknown' end as winner, round(o_orderkey % 101 / 100.0::double, 2) as confidence from orders)"""
_BOXES = """bx as (
  select l_orderkey as clip, (l_linenumber::bigint * 1000000 + l_partkey) * 1000 + l_suppkey % 1000 as seq, (l_partkey * 7 % 1400)::int as x, (l_suppkey * 11 % 800)::int as y, l_quantity::int * 9 + 20 as w, l_quantity::int * 3 + 10 as h, round(l_discount * 10, 2) as score from lineitem)"""

def _filled(forms: list[str], number: str, values: dict[str, str]) -> str:
    text = "[" + ", ".join("'" + f.replace("'", "''") + "'" for f in forms) + f"][{number} % {len(forms)} + 1]"
    for k, v in values.items():
        text = f"replace({text}, '{{{k}}}', ({v})::varchar)"
    return text


def _number(text: str) -> str:
    return f"round_even(try_cast({text} as double), 0)::int"


def _field(k: str) -> str:
    return _number(f"node->>'{k}'")


def _valid(x: str, y: str, w: str, h: str) -> str:
    return f"case when {x} is not null and {y} is not null and {w} > 0 and {h} > 0 then {{'x': {x}, 'y': {y}, 'w': {w}, 'h': {h}}} end"


def _between(x0: str, y0: str, x1: str, y1: str) -> str:
    return _valid(x0, y0, f"({x1} - {x0})", f"({y1} - {y0})")


def _around(k: str) -> str:
    """The box of a polygon in a field."""
    points = f"case when json_type(node->'{k}') = 'ARRAY' then from_json(node->'{k}', '[\"JSON\"]') end"
    along = lambda name, place: f"list_filter(list_transform({points}, lambda p: {_number(f'case when json_type(p) = {chr(39)}OBJECT{chr(39)} then p->>{chr(39)}{name}{chr(39)} else p->>{place} end')}), lambda v: v is not null)"
    xs, ys = along("x", 0), along("y", 1)
    return _between(f"list_min({xs})", f"list_min({ys})", f"list_max({xs})", f"list_max({ys})")


_HAS = [(keys, _valid if keys in XYWH_KEYS else _between) for keys in (*XYWH_KEYS, *LTRB_KEYS)]
_ALL_OF = ["list_has_all(json_keys(node), ['" + "', '".join(keys) + "'])" for keys, _ in _HAS]
_BOX_OF = "case when json_type(node) = 'ARRAY' and json_array_length(node) = 4 then coalesce({}, {}) when json_type(node) <> 'OBJECT' then null {} else coalesce({}) end".format(
    _valid(*(_number(f"node->>{k}") for k in range(4))),
    _between(*(_number(f"node->>{k}") for k in range(4))),
    " ".join(f"when {has} then {make(*map(_field, keys))}" for has, (keys, make) in zip(_ALL_OF, _HAS, strict=True)),
    ", ".join(map(_around, POLYGON_KEYS)),
)
_ROI = f"""with recursive {_BOXES},
js as (select clip, seq, x, y, w, h, {_filled(BOX_FORMS, "seq", {"x": "x", "y": "y", "w": "w", "h": "h", "r": "x + w", "b": "y + h"})} as j from bx),
nodes as (
  select clip, seq, x, y, w, h, j::json as node, '' as path from js where json_valid(j)
  union all
  select clip, seq, x, y, w, h, node->key as node, path || printf('%08d', coalesce(list_position([{", ".join(f"'{k}'" for k in NESTED_KEYS)}], key), k + 9)) as path
  from (select *, unnest(json_keys(node)) as key, unnest(range(len(json_keys(node))))::int as k from nodes where json_type(node) = 'OBJECT' and not ({" or ".join(_ALL_OF)}))),
found as (select clip, seq, x, y, w, h, path, {_BOX_OF} as box from nodes),
firsts as (select clip, seq, x, y, w, h, arg_min(box, path) as box from found where box is not null group by all)
select bx.clip, bx.seq, box.x as bx, box.y as by, box.w as bw, box.h as bh from bx left join firsts using (clip, seq, x, y, w, h)"""
_CORRECTIONS = f"""with t as (select o_custkey::varchar as path, o_orderkey as seq, {_filled(CORRECTION_FORMS, "o_orderkey", {"key": "o_orderkey", "status": "o_orderstatus", "day": "o_orderkey % 28 + 1"})}::json as j from orders),
c as (select path, seq, unnest(from_json(j, '["JSON"]')) as c, unnest(range(json_array_length(j)::bigint))::int as place from t),
f as (select *, unnest(json_keys(c->'changes')) as field from c)
select path, seq, place, coalesce(c->>'at', '') as at, coalesce(c->>'by', '') as by, coalesce(c->>'note', '') as note, field,
       case when json_type(c->'changes'->field) = 'OBJECT' then c->'changes'->field->>'from' end as before, case when json_type(c->'changes'->field) = 'OBJECT' then c->'changes'->field->>'to' end as after from f"""

_IOU = "case when {i} > 0 then {i} / ({w} * {h} + {nw} * {nh} - {i})::double else 0 end"


def _overlap(x: str, y: str, w: str, h: str, nx: str, ny: str, nw: str, nh: str) -> str:
    i = f"(greatest(0, least({x} + {w}, {nx} + {nw}) - greatest({x}, {nx})) * greatest(0, least({y} + {h}, {ny} + {nh}) - greatest({y}, {ny})))::double"
    return _IOU.format(i=i, w=w, h=h, nw=nw, nh=nh)


_ASPECT = "exp(-pow((w / greatest(1.0::double, h) - 3.2::double) / 0.85::double, 2))"
_CENTRE = """least(greatest(exp(-(pow(((x + w / 2.0::double) / 1280 - 0.5::double) / 0.35::double, 2) + pow(((y + h / 2.0::double) / 720 - 0.55::double) / 0.28::double, 2)))
  * case when x / 1280.0::double < 0.03 or (x + w) / 1280.0::double > 0.97 then 0.20 when x / 1280.0::double < 0.06 or (x + w) / 1280.0::double > 0.94 then 0.55 else 1.0 end, 0), 1)"""

ORACLES: dict[str, str] = {
    "score_timeline": _timeline(3),
    "score_timeline_bo5": _timeline(5),
    "stream_score": _timeline(3),
    "score_final": f"""with recursive {_replay(3)}
      select match_id, max(rn) as n_events, arg_max(set_number, rn) as set_number, arg_max(score_a, rn) as score_a, arg_max(score_b, rn) as score_b, arg_max(sets_a, rn) as sets_a, arg_max(sets_b, rn) as sets_b,
             max(winner) is not null as is_finished, max(winner) as winner from st group by match_id""",
    "set_results": f"""with recursive {_replay(3)}
      select match_id, row_number() over (partition by match_id order by rn)::int as set_no, closed_a as points_a, closed_b as points_b, case when closed_a > closed_b then 'player_a' else 'player_b' end as set_winner from st where closed_a is not null""",
    "score_validation": f"""with recursive {_replay(3)},
      c as (select match_id, count(*) as event_count, count(*) filter (winner = 'unknown') as unk from ev group by match_id),
      l as (select match_id, max(winner) as winner, count(closed_a) as done, coalesce(arg_max(closed_a, rn) filter (closed_a is not null), arg_max(score_a, rn)) as fa, coalesce(arg_max(closed_b, rn) filter (closed_a is not null), arg_max(score_b, rn)) as fb from st group by match_id),
      r as (select c.*, event_count - unk as kn, l.winner, coalesce(done, 0) as done, coalesce(fa, 0) as fa, coalesce(fb, 0) as fb from c left join l using (match_id))
      select match_id, event_count, kn as known_winner_count, unk as unknown_winner_count, winner is not null as is_match_finished, winner as match_winner, done as completed_sets, fa || '-' || fb as inferred_scoreline,
             array_to_string(list_filter([case when kn = 0 then 'No scored events available for validation.' end, case when unk > 0 then 'Unknown winners remaining: ' || unk || '.' end,
               case when winner is null then 'Expected full match clip, but match is not finished.' end, case when fa <> 11 or fb <> 7 then 'Final set score mismatch: expected 11-7, got ' || fa || '-' || fb || '.' end], lambda x: x is not null), '|') as issues,
             case when winner is null or fa <> 11 or fb <> 7 then 'fail' when kn = 0 or unk > 0 then 'warn' else 'pass' end as status from r""",
    "load_checks": f"with {_EVENTS}, {_MIXED} select match_id, count(*) as n_events, count(*) filter (winner = 'unknown') as n_bad, count(*) filter (winner = 'unknown') = 0 as loaded from mx group by match_id",
    "exported_events": f"""with {_EVENTS}, {_MIXED} select match_id, row_number() over (partition by match_id order by ts, seq) - 1 as place, round(ts, 6) as timestamp, winner
      from mx where match_id not in (select match_id from mx where winner = 'unknown')""",
    "score_validation_set": f"""with recursive {_replay(3)},
      c as (select match_id, count(*) filter (winner = 'unknown') as unk, count(*) filter (winner <> 'unknown') as kn from ev group by match_id),
      l as (select match_id, count(closed_a) as done from st group by match_id),
      r as (select coalesce(done, 0) as done, ((kn = 0)::int + (unk > 0)::int + (coalesce(done, 0) = 0)::int) as n_issues from c left join l using (match_id))
      select case when done = 0 then 'fail' when n_issues > 0 then 'warn' else 'pass' end as status, n_issues, count(*) as matches, sum(done)::bigint as completed_sets from r group by all""",
    "score_reports": f"""with recursive {_replay(3)},
      c as (select match_id, count(*) filter (winner = 'unknown') as unk, count(*) filter (winner <> 'unknown') as kn from ev group by match_id),
      l as (select match_id, max(winner) as winner, arg_max(score_a, rn) as a, arg_max(score_b, rn) as b,
              string_agg(closed_a || '-' || closed_b || '-' || case when closed_a > closed_b then 'player_a' else 'player_b' end, '|' order by rn) filter (closed_a is not null) as sets from st group by match_id)
      select match_id, case when kn = 0 or unk > 0 then 'warn' else 'pass' end as status, 3 as best_of, 'any' as expected_scope, coalesce(sets, '') as sets,
             case when winner is null then coalesce(a, 0) || '-' || coalesce(b, 0) end as open_set from c left join l using (match_id)""",
    "winner_counts": f"with {_EVENTS} select match_id, count(*) filter (winner = 'player_a') as wins_a, count(*) filter (winner = 'player_b') as wins_b, count(*) filter (winner = 'unknown') as unknown from ev group by match_id",
    "unknown_policy": f"with {_EVENTS} select match_id, seq, case winner when 'unknown' then 'player_a' else winner end as final_winner from ev",
    "signal_diff": f"with {_SIGNAL} select clip, idx, round(diff, 6) as diff from (select clip, idx, abs(v - lag(v) over {_BY}) as diff from sg) where diff is not null",
    "signal_sampled": f"with {_SIGNAL} select clip, idx, v from sg where t >= epoch(timestamp '2024-01-05') and t < epoch(timestamp '2024-01-15') and idx % 3 = 0",
    "signal_fir_gauss": f"with {_SIGNAL}, {_GAUSS} select clip, idx, round(smooth, 6) as smooth from gs",
    "signal_fir_box": f"with {_SIGNAL} select clip, idx, round(sum(v) over (partition by clip order by idx rows between 3 preceding and 3 following) / 7, 5) as box7, round(sum(v) over (partition by clip order by idx rows between 75 preceding and 75 following) / 151, 5) as box151 from sg",
    "signal_snr": f"with {_SIGNAL} select clip, idx, round(sum(v) over (partition by clip order by idx rows between 3 preceding and 3 following) / 7 / (sum(v) over (partition by clip order by idx rows between 75 preceding and 75 following) / 151 + 1e-6::double), 5) as snr from sg",
    "signal_normalized": f"with {_E} select clip, idx, round(e, 6) as e from en",
    "segments_hysteresis": f"with recursive {_SEGMENTS} {_SHOW} hs",
    "segments_noflush": f"with recursive {_E}, {_rules('en', 'e', RULES, 'hs', False)} {_SHOW} hs",
    "segments_fused": f"with recursive {_E}, {_FUSED}, {_rules('fu', 'x', RULES, 'hs')} {_SHOW} hs",
    "segments_split": f"with recursive {_SPLIT} select clip, round(t_start, 6) as t_start, round(t_end, 6) as t_end, i_start, i_end, array_to_string(flags, '|') as flags from sp",
    "segments_split_sql": f"with recursive {_SPLIT} select clip, round(t_start, 6) as t_start, round(t_end, 6) as t_end, i_start, i_end, array_to_string(flags, '|') as flags from sp",
    "segments_final": f"with recursive {_FINAL}",
    "stream_segments": f"with recursive {_SIGNAL}, lv as (select clip, idx, t, least(v / 100, 1) as x from sg), {_rules('lv', 'x', RULES, 'hs', False)} select clip, round(t_start, 6) as t_start, round(t_end, 6) as t_end from hs",
    "score_timeline_sets": _timeline(5),
    "score_resumed": _timeline(3) + " and ts >= epoch_us(timestamp '2024-01-15') / 1e6::double",
    "match_states": f"""with recursive {_replay(5)},
c as (select match_id, string_agg(closed_a || '-' || closed_b || '-' || case when closed_a > closed_b then 'player_a' else 'player_b' end, '|' order by rn) as done from st where closed_a is not null group by match_id),
l as (select * from (select *, row_number() over (partition by match_id order by rn desc) as back from st where rn > 0) where back = 1)
select l.match_id, 5 as best_of, concat_ws('|', done, case when winner is null then score_a || '-' || score_b end) as sets, winner, winner is not null as is_finished from l left join c using (match_id)""",
    "order_errors": """with b as (select o_custkey as match_id, o_orderkey as seq, epoch_us(o_orderdate) / 1e6::double as ts, lag(epoch_us(o_orderdate) / 1e6::double) over (partition by o_custkey order by o_orderkey) as before from orders)
select *, 'Event timestamp must be non-decreasing' as message from b where ts < before""",
    "load_errors": f"with {_EVENTS}, {_MIXED} select match_id, seq, 'Event ' || seq || ': unknown winner ' || winner as message from mx where winner = 'unknown'",
    "published_events": f"with {_EVENTS} select match_id, rn - 1 as place, round(ts, 6) as timestamp, winner from known",
    # Row by row in order of time, with the time of the last event found.
    "motion_events_by_jumps": """with recursive h as (
  select event_id as idx, epoch_us(ts) / 1e6::double as t, value, row_number() over (order by ts, event_id) as k
  from events where value >= 40 and event_id > (select min(event_id) from events)),
r as (
  select k, idx, t, value, t as last, true as found from h where k = 1
  union all
  select h.k, h.idx, h.t, h.value, case when h.t - r.last >= 600 then h.t else r.last end, h.t - r.last >= 600 from r join h on h.k = r.k + 1)
select 1::bigint as clip, idx, round(t, 6) as t, value from r where found""",
    "review_in_sql": f"""with {_POINTS}, n as (select *, lead(t_start) over v as n0, lead(t_end) over v as n1 from pt window v as (partition by clip order by t_start, seq))
select clip, seq, case when confidence >= 0.85 then 'auto' when confidence >= 0.60 then 'review' else 'block' end as bucket, winner = 'unknown' or confidence < 0.85 as needs, 'pt_' || lpad(seq::varchar, greatest(4, length(seq::varchar))::int, '0') as point_id,
       lpad((floor(t_end - t_start)::bigint // 60)::varchar, 2, '0') || ':' || lpad((floor(t_end - t_start)::bigint % 60)::varchar, 2, '0') as lasts,
       round(case when least(t_end, n1) > greatest(t_start, n0) then (least(t_end, n1) - greatest(t_start, n0)) / (greatest(t_end, n1) - least(t_start, n0)) else 0 end, 6) as iou,
       round(case when seq % 3 > 0 then confidence / (seq % 3) else 0 end, 6) as part, winner as label from n""",
    "stream_ordered_score": _timeline(3).replace("from events)", "from events where not (event_id % 41 = 0 and ts < timestamp '2024-01-15'))").replace("select match_id, seq, ts, set_number", "select match_id, seq, ts, false as late, set_number")
    + """ union all
  select user_id, event_id, epoch_us(ts) / 1e6::double, true, null, null, null, null, null, null, null
  from events where event_id % 41 = 0 and ts < timestamp '2024-01-15' and event_type <> 'error'""",
    # Warm samples farther apart than the gap are in different islands, whatever lies between.
    "stream_silent_segments": f"""with {_SIGNAL}, x as (select *, least(v / 100, 1) as x from sg),
w as (select *, t - lag(t) over {_BY} > {RULES.max_gap}::double as apart from x where x > {RULES.low}::double),
i as (select *, sum(coalesce(apart, false)::int) over {_BY} as island from w),
g as (select clip, min(case when x > {RULES.high}::double then t end) as t_start, max(t) as t_end from i group by clip, island)
select clip, round(t_start, 6) as t_start, round(t_end, 6) as t_end from g where t_end - t_start > {RULES.min_dur}::double""",
    "stream_tumbling": _WINDOWED.format(keys="user_id, ", source="events", start="time_bucket(interval 1 day, ts)", days=1),
    "stream_sliding": _WINDOWED.format(keys="", source="(select *, unnest([0, 1]) as back from events)", start="time_bucket(interval 1 day, ts) - to_days(back::int)", days=2),
    "stream_sessions": f"""with s as (
  select *, sum(new) over (partition by user_id order by ts, event_id) as session
  from (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 8 hours, true)::int as new from events))
select epoch_us(min(ts)) as from_us, epoch_us(max(ts) + interval 8 hours) as to_us, user_id, {_WINS} from s group by user_id, session""",
    "stream_machines": f"""with recursive {_SIGNAL},
      tb as (select clip, idx, t, v / 160 as x from sg),
      fz as (select clip, idx, t, greatest(v / 160, case when floor(v)::bigint % 3 = 0 then least(v / 80, 1) else 0 end, case when floor(v)::bigint % 4 = 0 then least(v / 60, 1) else 0 end) as x from sg),
      {_rules('tb', 'x', RULES, 'ht', False)}, {_rules('fz', 'x', GT_RULES, 'hf', False)}
      select clip, 'table' as machine, round(t_start, 6) as t_start, round(t_end, 6) as t_end from ht
      union all select clip, 'fused', round(t_start, 6), round(t_end, 6) from hf""",
    "motion_events": f"""with recursive {_SIGNAL},
      r as (
        select clip, 0::bigint as idx, -1e18::double as last, null::double as t, null::double as value from sg where idx = 0
        union all
        select s.clip, s.idx, case when s.v >= 40 and s.t - r.last >= 43200 then s.t else r.last end, case when s.v >= 40 and s.t - r.last >= 43200 then s.t end, s.v
        from r join sg s on s.clip = r.clip and s.idx = r.idx + 1)
      select clip, idx, round(t, 6) as t, value from r where t is not null""",
    "iou_candidates": f"with recursive {_SIDES} select clip, pi, gi, round(iou, 6) as iou from cand",
    "iou_matches": f"with recursive {_MATCHES} select clip, pi, gi, round(iou, 6) as iou from ma",
    "unmatched_pred": f"with recursive {_MATCHES} select clip, seq from pr where not exists (select 1 from ma where ma.clip = pr.clip and ma.pi = pr.seq)",
    "unmatched_gt": f"with recursive {_MATCHES} select clip, seq from gt where not exists (select 1 from ma where ma.clip = gt.clip and ma.gi = gt.seq)",
    "eval_clip": f"with recursive {_CLIPS} select clip, tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, round(mean_iou, 6) as mean_iou, round(winner_accuracy, 6) as winner_accuracy, round(unknown_rate, 6) as unknown_rate, round(review_rate, 6) as review_rate from ra",
    "eval_aggregate": f"""with recursive {_CLIPS},
      t as (select count(*) as n_clips, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, avg(precision) as macro_precision, avg(recall) as macro_recall, avg(f1) as macro_f1, avg(mean_iou) as macro_mean_iou, avg(winner_accuracy) as macro_winner_accuracy, avg(review_rate) as macro_review_rate from ra),
      m as (select *, tp / (tp + fp)::double as p, tp / (tp + fn)::double as r from t)
      select n_clips, tp, fp, fn, round(macro_precision, 6) as macro_precision, round(macro_recall, 6) as macro_recall, round(macro_f1, 6) as macro_f1, round(macro_mean_iou, 6) as macro_mean_iou, round(macro_winner_accuracy, 6) as macro_winner_accuracy,
             round(macro_review_rate, 6) as macro_review_rate, round(p, 6) as micro_precision, round(r, 6) as micro_recall, round(2 * p * r / (p + r), 6) as micro_f1 from m""",
    "asof_state": f"""with recursive {_replay(3)},
      q as (
        select o_orderkey, o_custkey as match_id, epoch_us(o_orderdate) / 1e6::double as tt from orders
        union all select -1, match_id, min(ts) from st where rn > 0 group by match_id
        union all select -2, match_id, floor(avg(ts)) from st where rn > 0 group by match_id),
      u as (select match_id, ts, arg_max(set_number, seq) as set_number, arg_max(score_a, seq) as score_a, arg_max(score_b, seq) as score_b, arg_max(sets_a, seq) as sets_a, arg_max(sets_b, seq) as sets_b from st where rn > 0 group by match_id, ts)
      select q.o_orderkey, q.match_id, u.set_number, u.score_a, u.score_b, u.sets_a, u.sets_b from q asof left join u on q.match_id = u.match_id and q.tt >= u.ts""",
    "majority_vote": """with c as (select l_orderkey as item_id, l_returnflag as vote, count(*) as n from lineitem group by all),
      r as (select *, rank() over (partition by item_id order by n desc) as rk, sum(n) over (partition by item_id) as total from c)
      select item_id, case when count(*) > 1 then 'unknown' else min(vote) end as winner, round(case when count(*) > 1 then 0 else max(n) / max(total)::double end, 6) as consensus from r where rk = 1 group by item_id""",
    "refine_points": f"""with {_POINTS},
      c as (select l_orderkey as id, case l_returnflag when 'A' then 'player_a' else 'player_b' end as vote, count(*) as n from lineitem group by all),
      r as (select *, rank() over (partition by id order by n desc) as rk, sum(n) over (partition by id) as total from c),
      v as (select id, case when count(*) > 1 then 'unknown' else min(vote) end as voted, case when count(*) > 1 then 0 else max(n) / max(total)::double end as cons from r where rk = 1 group by id)
      select seq as id, case when winner = 'unknown' and voted is not null then voted else winner end as winner, round(case when winner = 'unknown' and cons > 0 then cons else confidence end, 6) as confidence,
             case when winner = 'unknown' and cons < 0.67 then 'winner_low_consensus' else '' end as flags from pt left join v on v.id = pt.seq""",
    "review_buckets": f"with {_POINTS} select case when confidence >= 0.85 then 'auto' when confidence >= 0.60 then 'review' else 'block' end as bucket, count(*) as points, count(*) filter (winner = 'unknown' or confidence < 0.85) as needing_review from pt group by 1",
    "flip_suggestions": f"""with {_POINTS}, k as (select * from pt where winner <> 'unknown'),
      p as (select clip, 6 - count(*) filter (winner = 'player_a') as da, 2 - count(*) filter (winner = 'player_b') as db from k group by clip),
      f as (select clip, abs(da) as needed, case when da < 0 then 'player_a' else 'player_b' end as from_winner from p where da = -db and da <> 0),
      r as (select k.clip, row_number() over (partition by k.clip order by confidence, t_end - t_start desc, seq)::int as place, seq, from_winner, needed from k join f on f.clip = k.clip and f.from_winner = k.winner)
      select clip, place, seq, from_winner, case from_winner when 'player_a' then 'player_b' else 'player_a' end as to_winner, needed from r where place <= least(needed, 10)""",
    "correction_outcomes": f"""with {_POINTS}, p as (select clip, 6 - count(*) filter (winner = 'player_a') as delta_a, 2 - count(*) filter (winner = 'player_b') as delta_b, count(*) filter (winner = 'unknown') as n_unknown from pt group by clip)
      select *, case when delta_a + delta_b <> 0 then 'segmentation_error' when delta_a = 0 then 'none' else 'flips' end as outcome from p""",
    "document_errors": """select c_custkey::varchar as path, 'ROI is missing or has zero width' as message from customer where c_custkey % 5 - 1 <= 0
      union all select c_custkey::varchar, 'Invalid video_fps' from customer where c_custkey % 7 = 0""",
    "sample_times": """with k as (select unnest(range(6))::int as k), t as (select event_id, k, case when k = 0 then greatest(0, value - 5) else value - 5 + k * 2 end as a from events, k)
      select event_id, k, round(a, 6) as at_time, round(a, 6) / 100 < 0.39::double as low from t""",
    "draft_errors": f"""with {_POINTS}, n as (select *, row_number() over (partition by clip order by seq) - 1 as k, lag(t_start) over (partition by clip order by seq) as before from pt)
      select clip, k::int as seq, 'Point ' || k || ': Invalid time range (' || t_start || ' -> ' || t_end || ')' as message from n where t_start < 0 or t_end <= t_start
      union all select clip, k::int, 'Point ' || k || ': Non-monotonic timestamps (start before previous end)' from n where t_start < coalesce(before, -1)""",
    "key_times": f"with {_POINTS} select clip, seq, 0 as k, (t_start + t_end) / 2 as at_time from pt union all select clip, seq, 1, t_end - 0.5 from pt union all select clip, seq, 2, t_end from pt",
    "roi_clamp": f"with {_BOXES}, c as (select *, greatest(0, least(x, 1279)) as cx, greatest(0, least(y, 719)) as cy from bx) select clip, seq, cx as x, cy as y, greatest(1, least(w, 1280 - cx)) as w, greatest(1, least(h, 720 - cy)) as h from c",
    "play_zone": f"with {_BOXES}, z as (select *, greatest(0, x - trunc(w * 0.25)::int) as zx, greatest(0, y - h) as zy from bx) select clip, seq, zx as zone_x, zy as zone_y, least(1280 - zx, w + trunc(w * 0.5)::int) as zone_w, least(720 - zy, h + trunc(h * 1.2::double)::int) as zone_h from z",
    "box_iou": f"""with {_BOXES}, n as (select *, lead(x) over v as nx, lead(y) over v as ny, lead(w) over v as nw, lead(h) over v as nh from bx window v as (partition by clip order by seq))
      select clip, seq, round({_overlap(*'xywh', 'nx', 'ny', 'nw', 'nh')}, 6) as iou, x < nx + nw + 100 and x + w > nx - 100 as near from n where nx is not null""",
    "box_priors": f"with {_BOXES} select clip, seq, round({_ASPECT}, 6) as aspect, round({_CENTRE}, 6) as centre, round(least(greatest((w * h / 921600.0::double - 0.03::double) / 0.20::double, 0), 1), 6) as area from bx where w >= 192 and h >= 43.2",
    "box_ranks": f"""with {_BOXES}, p as (select *, {_CENTRE} as c, {_ASPECT} as s from bx where seq % 4 <> 0)
      select clip, seq, round(greatest(0, least(1, s * 1.6::double)) * 0.4::double + c * 0.4::double + greatest(0, least(1, w * h / 921600.0::double * 6)) * 0.1::double + score * 0.1::double, 6) as detection,
             round(s * 0.55::double + score * 0.2::double + c * 0.25::double, 6) as recovery, trunc(w * 0.5)::int as half_w from p""",
    "box_consensus": f"""with {_BOXES}, m as (select *, trunc(median(x) over v)::int as mx, trunc(median(y) over v)::int as my, trunc(median(w) over v)::int as mw, trunc(median(h) over v)::int as mh from bx window v as (partition by clip)),
      r as (select *, {_overlap(*'xywh', 'mx', 'my', 'mw', 'mh')} * 0.25 + {_CENTRE} * 0.25 + score * 0.25 + {_ASPECT} * 0.25 as rk from m),
      b as (select *, row_number() over (partition by clip order by rk desc, seq) as place, greatest(0, y - round_even(h * 0.02::double, 0)::int) as top from r)
      select clip, seq, x, top as y, w, least(720 - top, h + y - top) as h from b where place = 1""",
    "recovered_boxes": f"""with li as (
  select l_orderkey as clip, l_orderkey * 10 + l_linenumber as seq, (l_partkey * 7 % 900)::int as x, (l_suppkey * 11 % 600)::int as y, trunc(l_quantity * 8 + 60)::int as w, trunc(l_quantity * 3 + 20)::int as h,
         round(l_discount * 5, 2) as score, round(l_tax * 5, 2) as ls, round(l_discount * 4, 2) as rs
  from (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey, min(l_quantity) as l_quantity, min(l_discount) as l_discount, min(l_tax) as l_tax from lineitem group by all)),
b as (select *, x - (seq % 3 * 4)::int as dx, w + (seq % 5 * 4)::int as dw, trunc(w * (1 + seq % 4) / 4)::int as more, round(score - seq % 3 * 0.03::double, 2) as rscore from li),
t as (select *, abs(x - dx) <= greatest(6, trunc(dw * 0.02::double)::int) as at_left, abs(x + w - dx - dw) <= greatest(6, trunc(dw * 0.02::double)::int) as at_right, w / greatest(1, h)::double < 2.95 as narrow, {_ASPECT} as shape, {_CENTRE} as centre from b),
s as (select *, narrow and case when at_left and at_right then case when ls > rs * 1.1::double then true when rs > ls * 1.1::double then false else true end else at_left end as left_side,
             narrow and case when at_left and at_right then case when ls > rs * 1.1::double then false else true end else at_right end as right_side from t),
o as (select clip, seq, shape * 0.55 + score * 0.2::double + centre * 0.25 as own_rank, shape as own_shape, score as own_score, w / greatest(1, h)::double as own_aspect, left_side, right_side from s),
r as (
  select clip, seq, 0 as k, 'left' as side, greatest(0, x - more) as x, y, w + more as w, h, rscore as score from s where left_side
  union all select clip, seq, 1, 'right', x, y, w + more, h, rscore from s where right_side),
q as (select *, {_ASPECT} * 0.55 + score * 0.2::double + {_CENTRE} * 0.25 as rank, {_ASPECT} as shape from r),
f as (
  select q.*, row_number() over (partition by q.clip, q.seq order by q.rank desc, k) as place from q join o on q.clip = o.clip and q.seq = o.seq
  where w / greatest(1, h)::double > greatest(2.95::double, own_aspect + 0.2::double) and shape >= own_shape + 0.08::double and score >= own_score - 0.04::double and rank > own_rank)
select b.clip, b.seq, coalesce(f.x, b.x) as x, coalesce(f.y, b.y) as y, coalesce(f.w, b.w) as w, coalesce(f.h, b.h) as h, round(coalesce(f.score, b.score), 6) as score, f.side
from b left join f on f.clip = b.clip and f.seq = b.seq and f.place = 1""",
    "roi_parse": _ROI,
    "corrections": _CORRECTIONS,
    "json_props": "select event_type, count(*) as n, count(props->>'$.k') as with_k, round(sum((props->>'$.k')::double), 3) as sum_k from events group by event_type",
    "time_format": "select event_id, lpad((floor(value * 60)::bigint // 60)::varchar, greatest(2, length((floor(value * 60)::bigint // 60)::varchar))::int, '0') || ':' || lpad((floor(value * 60)::bigint % 60)::varchar, 2, '0') as shown, 'pt_' || lpad(event_id::varchar, greatest(4, length(event_id::varchar))::int, '0') as point_id from events",
    "label_normalize": "select event_id, case when event_id % 5 = 0 then 'unknown' when event_id % 3 in (0, 1) then 'player_a' else 'player_b' end as label from events",
    "parsed_texts": "select event_id, (event_id % 12)::int as a, (user_id % 12)::int as b, round(case when event_id % 4 = 0 then 30 else event_id % 60000 / (event_id % 4)::double end, 6) as rate, 'm' || user_id || '_refined.json' as path, (event_id % 4 + 1)::int as needed from events",
    "nearest_two": f"""with {_BOXES}, q as (select *, (x + w / 2.0::double - 640) ** 2 + (y + h / 2.0::double - 360) ** 2 as distance from bx), r as (select *, row_number() over (partition by clip order by distance, seq)::int as place from q)
      select clip, seq, place, distance from r where place <= 2""",
    "wrist_speed": f"""with {_BOXES}, p as (select clip, seq % 2 as player, seq as idx, x / 1000.0::double as lx, y / 1000.0::double as ly, w / 1000.0::double as rx, h / 1000.0::double as ry, h / 100.0::double as height from bx),
      q as (select *, sqrt((lx - lag(lx) over v) ** 2 + (ly - lag(ly) over v) ** 2) / height as a, sqrt((rx - lag(rx) over v) ** 2 + (ry - lag(ry) over v) ** 2) / height as b from p window v as (partition by clip, player order by idx))
      select clip, player, idx, round(coalesce(greatest(case when a < 0.5 then a end, case when b < 0.5 then b end), 0), 6) as speed, case when lx > 0 and ly > 0 and height > 0 then (lx - ly) / height else 1 end as ratio from q""",
    "player_slots": """with f as (select l_orderkey as clip, l_suppkey as s, min(l_linenumber) as first from lineitem group by all), r as (select *, row_number() over (partition by clip order by first, s) as k from f)
      select clip, coalesce(max(s) filter (k = 1), 0) as p1, coalesce(max(s) filter (k = 2), 0) as p2 from r group by clip""",
    "pooled_change": """with b as (select vec_id, label, embedding as e, lag(embedding) over (partition by label order by vec_id) as f from embeddings)
      select vec_id, label, round(list_sum(list_transform(list_zip(e, f), lambda z: abs(z[1]::double - z[2]::double))) / len(e), 6) as change from b where f is not null""",
    "turn_gaps": """with g as (select *, turn - lag(turn) over (partition by conv_id order by turn) as gap from conversations)
      select conv_id, count(*) as turns, count(*) filter (gap <> 1) as gaps, arg_max(role, turn) as last_role from g group by conv_id""",
}
