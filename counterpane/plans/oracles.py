"""The same results as ANSI-style SQL over the same tables, for checking the registered queries."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

EMB = """emb as (select vec_id as series_id, label, list_transform(embedding, lambda v: v::double) as x from embeddings),
el as (select series_id, label, i - 1 as i, ((i - 1) // 4)::int as t, ((i - 1) % 4)::int as c, x[i] as v
       from emb, range(1, 65) r(i))"""
MEANS = "mean as (select label, i, t, c, avg(v) as v from el group by label, i, t, c)"
DEVIATION = """dm as (select i, avg(v) as m from el group by i),
dev as (select series_id, t, round(sum(abs(v - m)), 6) as w from el join dm using (i) group by series_id, t)"""
CENTROID = """sq as (select e.series_id, m.label as k, sum((e.v - m.v) * (e.v - m.v)) as d
       from el e join mean m on e.i = m.i group by e.series_id, m.label),
pr as (select series_id, k, exp(-160 * (d - min(d) over (partition by series_id))) as e from sq),
pn as (select series_id, k, e / sum(e) over (partition by series_id) as p from pr),
sc as (select series_id, arg_max(k, struct_pack(p := p, k := -k)) as pred_label, max(p) as confidence
       from pn group by series_id)"""
NUN = f"""{EMB}, {MEANS}, {CENTROID}, {DEVIATION},
sx as (select e.series_id, e.x, s.pred_label, s.confidence from emb e join sc s using (series_id)),
pd as (select q.series_id as query_id, r.series_id as nun_id, r.pred_label as nun_label, r.confidence as nun_confidence,
              list_distance(q.x, r.x) as dist from sx q join sx r on q.pred_label <> r.pred_label),
rk as (select *, row_number() over (partition by query_id order by dist, nun_id) as rn from pd),
nun as (select query_id, nun_id, nun_label, nun_confidence, dist from rk where rn = 1 and nun_confidence >= 0.51)"""


def events_cte(days: int) -> str:
    steps = 30 // days
    return f"""ev as (select user_id as series_id, (date_diff('day', date '2024-01-01', ts::date) // {days})::int as t,
  case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3
                  when 'view' then 4 end as c, value from events),
sums as (select series_id, t, c, round(sum(value), 2) as v from ev group by series_id, t, c),
grid as (select u.series_id, t::int as t, c::int as c
         from (select distinct user_id as series_id from events) u, range({steps}) a(t), range(5) b(c)),
el as (select g.series_id, g.t, g.c, g.t * 5 + g.c as i, coalesce(s.v, 0.0) as v
       from grid g left join sums s on s.series_id = g.series_id and s.t = g.t and s.c = g.c)"""


LOGIT = """m0 as (select avg(v) as m0 from el),
pb as (select series_id, least(greatest(1 / (1 + exp(-2 * (avg(v) - any_value(m0)))), 0.01), 0.99) as p
       from el, m0 group by series_id),
sc as (select series_id, case when p > 1 - p then 1 else 0 end::int as pred_label, greatest(p, 1 - p) as confidence
       from pb)"""


def cells(select: str, index: str = "i", value: str = "value") -> str:
    """One row per element of the list column `a` of `select`."""
    return (f"select series_id, (j - 1)::int as {index}, round(a[j], 6) as {value} "
            f"from ({select}), range(1, 65) r(j) where j <= len(a)")


# --- draws ---

M = 2147483647


def draw(*keys: object) -> str:
    listed = ", ".join(f"({k})::bigint" for k in keys)
    step = f"((r * 48271 + k + 11) % {M})"
    state = f"list_reduce([12345::bigint, {listed}], lambda r, k: ({step} * {step} + 69621) % {M})"
    last = f"(({state}) * 16807 % {M})"
    return f"((({last} * {last} + 40692) % {M}) / {float(M)})"


# --- sources and scalar functions ---

ORACLES["panel_events"] = f"with {events_cte(1)} select series_id, t, c, round(v, 6) as value from el"
ORACLES["panel_events_wide"] = """with
ev as (select user_id as series_id, floor(date_diff('day', date '2024-01-01', ts::date) / 2)::int as t, event_type, value
       from events),
ch as (select event_type, (row_number() over (order by event_type) - 1)::int as c from (select distinct event_type from ev)),
sums as (select series_id, t, c, round(sum(value), 2) as v from ev join ch using (event_type) group by all),
grid as (select series_id, t::int as t, c from (select distinct series_id from ev), ch,
         (select unnest(range((select max(t) + 1 from ev))) as t))
select g.series_id, g.t, g.c, round(coalesce(s.v, 0.0), 6) as value
from grid g left join sums s on s.series_id = g.series_id and s.t = g.t and s.c = g.c"""
ORACLES["panel_embeddings"] = f"with {EMB} select series_id, t, c, round(v, 6) as value from el"
ORACLES["panel_long_roundtrip"] = ORACLES["panel_embeddings"]
ORACLES["panel_csv_roundtrip"] = (f"with {EMB} select series_id, t, c, round(v, 6) as value, label::bigint as label "
                                  "from el")
ORACLES["format_array"] = (f"with {EMB} select series_id, array_to_string(list_transform(x, "
                           "lambda v: v::decimal(12, 6)::varchar), ' ') as text from emb")
ORACLES["parse_array"] = f"with {EMB} {cells('select series_id, x as a from emb')}"
ORACLES["as_series"] = ORACLES["parse_array"]
ORACLES["select_channels"] = f"""with {EMB} select series_id, (t * 2 + case c when 3 then 0 else 1 end)::int as i,
 round(v, 6) as value from el where c in (1, 3)"""
ORACLES["channels_first"] = f"with {EMB} select series_id, (c * 16 + t)::int as i, round(v, 6) as value from el"
ORACLES["slice_window"] = f"""with {EMB} select series_id, ((t - label - 3) * 4 + c)::int as i, round(v, 6) as value
 from el where t >= label + 3 and t < label + 11"""
SPLICED = """sp as (select e.series_id, e.label, e.i, e.t, e.c, e.v as x,
   case when e.t >= e.label and e.t < e.label + 4 then m.v else e.v end as cf
   from el e join mean m on e.label = m.label and e.i = m.i)"""
ORACLES["splice_window"] = f"""with {EMB}, {MEANS}, {SPLICED}
 select series_id, i::int as i, round(cf, 6) as value from sp"""
ORACLES["minmax_weights"] = f"""with {EMB}, {DEVIATION} select series_id, t, round(case when max(w) over s > min(w) over s
 then (w - min(w) over s) / (max(w) over s - min(w) over s) else 0 end, 6) as value
 from dev window s as (partition by series_id)"""
ORACLES["minmax_step"] = ORACLES["minmax_weights"].replace("partition by series_id", "partition by t")
ORACLES["deviation"] = f"with {events_cte(1)}, {DEVIATION} select series_id, t, round(w, 6) as value from dev"
ORACLES["peak_step"] = f"""with {events_cte(1)}, {DEVIATION}
 select series_id, arg_max(t, struct_pack(w := w, t := -t)) as peak from dev group by series_id"""
ORACLES["validate_declared_shapes"] = """
 select 'shape_mismatch' as rule, count(*)::bigint as n_bad, min(vec_id)::bigint as example_id from embeddings
 where len(embedding) <> (label + 12) * 4 having count(*) > 0
 union all
 select 'mixed_shapes', 1::bigint, null::bigint from embeddings having min(label) <> max(label)"""

# --- scoring and attribution ---

ORACLES["score_centroid"] = f"""with {EMB}, {MEANS}, {CENTROID}
 select s.series_id, s.pred_label, round(s.confidence, 6) as confidence, round(p.p, 6) as own_proba
 from sc s join emb e using (series_id) join pn p on p.series_id = s.series_id and p.k = e.label"""
ORACLES["score_logit"] = f"""with {events_cte(1)}, {LOGIT}
 select series_id, pred_label, round(confidence, 6) as confidence from sc"""
CONV = """act as (select e.series_id, e.t + 1 - o as t, f, sum(e.v * ((o * 7 + e.c * 3 + f * 5) % 11 - 5) / 10.0::double) as a
        from el e, range(3) r(o), range(4) s(f) where e.t + 1 - o between 0 and 15 group by all),
lg as (select series_id, k, sum(a * ((f * 3 + k * 4) % 7 - 3) / 0.2::double) / 16 as z
       from act, range(2) r(k) group by all),
cs as (select series_id, max(case when k = 0 then z end) as z0, max(case when k = 1 then z end) as z1
       from lg group by all)"""
ORACLES["score_conv"] = f"""with {EMB}, {CONV} select series_id, (z1 > z0)::int as pred_label,
 round(1 / (1 + exp(-abs(z1 - z0))), 6) as confidence from cs"""
ORACLES["cam"] = f"""with {EMB}, {CONV}
 select a.series_id, a.t::int as t, round(sum(a.a * ((a.f * 3 + (z1 > z0)::int * 4) % 7 - 3) / 0.2::double), 6) as value
 from act a join cs using (series_id) group by all"""
ORACLES["class_mean"] = f"""with {EMB}, {MEANS} select label::bigint as series_id, i::int as i, round(v, 6) as value
 from mean"""

# --- distances ---

LOCK_STEP = f"with {EMB}, {MEANS} select e.series_id as left_id, m.label::bigint as right_id, " \
            "round({}, 6) as dist from el e join mean m on e.i = m.i group by all"
ORACLES["dist_euclidean"] = LOCK_STEP.format("sqrt(sum((e.v - m.v) * (e.v - m.v)))")
ORACLES["dist_manhattan"] = LOCK_STEP.format("sum(abs(e.v - m.v))")


def aligned(cost: str, init: str, edge: str, cell: str, steps: int) -> str:
    """Row-by-row alignment of the cell costs `cost` (qa, rb, i, j, cost): the CTEs up to `fin (qa, rb, v)`."""
    return f"""{cost},
cr as (select qa, rb, i, list(cost order by j) as cs from cc group by qa, rb, i),
al as (select qa, rb, -1 as i, list_concat([{init}::double], list_transform(range(0, {steps}), lambda j: {edge}::double)) as prev
       from (select distinct qa, rb from cr)
  union all
  select al.qa, al.rb, cr.i,
    list_reduce(list_transform(range(1, {steps + 1}), lambda j: [cr.cs[j::int], al.prev[(j + 1)::int], al.prev[j::int]]),
                lambda acc, e: list_append(acc, {cell}), [{edge}::double])
  from al join cr on cr.qa = al.qa and cr.rb = al.rb and cr.i = al.i + 1),
fin as (select qa, rb, prev[{steps + 1}] as v from al where i = {steps - 1})"""


LAST = "acc[len(acc)]"
DTW_CELL = f"e[1] + least(e[2], e[3], {LAST})"
LOW = f"least(e[2], e[3], {LAST})"
SOFT_CELL = f"e[1] + {LOW} - ln(exp({LOW} - e[2]) + exp({LOW} - e[3]) + exp({LOW} - {LAST}))"


def gak_cell(sigma: float) -> str:
    near = f"exp(-e[1] / {2.0 * sigma * sigma!r}::double)"
    return f"(e[2] + e[3] + {LAST}) * {near} / (2.0::double - {near})"


def class_cost(where: str = "true", scale: str = "cost") -> str:
    return f"""cc0 as (select e.series_id as qa, m.label as rb, e.t as i, m.t as j, sum((e.v - m.v) * (e.v - m.v)) as cost
  from el e join mean m on e.c = m.c group by all),
cc as (select qa, rb, i, j, {scale} as cost from cc0 where {where})"""


def class_dtw(cost: str, init: str, edge: str, cell: str, value: str) -> str:
    return f"""with recursive {EMB}, {MEANS}, {aligned(cost, init, edge, cell, 16)}
 select qa as left_id, rb::bigint as right_id, round({value}, 6) as dist from fin"""


INF = "'inf'"
ORACLES["dist_dtw"] = class_dtw(class_cost(), "0.0", INF, DTW_CELL, "sqrt(v)")
ORACLES["dist_dtw_band"] = class_dtw(class_cost(scale="case when abs(j - i) <= 2 then cost else 'inf'::double end"),
                                     "0.0", INF, DTW_CELL, "sqrt(v)")
ORACLES["dist_soft_dtw"] = class_dtw(class_cost(), "0.0", INF, SOFT_CELL, "v")
ORACLES["dist_gak_raw"] = class_dtw(class_cost(), "1.0", "0.0", gak_cell(1.0), "ln(v)")
GAK_COST = """cx as (select 0 as side, series_id as a, label as b, t, c, v from el),
items as (select 'q' || series_id as id, t, c, v from el union all select 'm' || label, t, c, v from mean),
want as (select 'q' || e.series_id as qa, 'm' || l.label as rb from emb e, (select distinct label from emb) l
         union all select distinct id, id from items),
cc as (select w.qa, w.rb, a.t as i, b.t as j, sum((a.v - b.v) * (a.v - b.v)) as cost
       from want w join items a on a.id = w.qa join items b on b.id = w.rb and b.c = a.c group by all)"""
ORACLES["dist_gak"] = f"""with recursive {EMB}, {MEANS}, {aligned(GAK_COST, '1.0', '0.0', gak_cell(0.3), 16)}
 select f.qa[2:]::bigint as left_id, f.rb[2:]::bigint as right_id, round(f.v / sqrt(x.v * y.v), 6) as dist
 from fin f join fin x on x.qa = f.qa and x.rb = f.qa join fin y on y.qa = f.rb and y.rb = f.rb where f.qa <> f.rb"""
OWN_COST = """cc as (select e.series_id as qa, m.label as rb, e.t as i, m.t as j, sum((e.v - m.v) * (e.v - m.v)) as cost
  from el e join mean m on e.c = m.c and e.label = m.label group by all)"""
ORACLES["cost_cells"] = f"""with {EMB}, {MEANS}, {OWN_COST}
 select qa as left_id, rb::bigint as right_id, i::int as i, j::int as j, round(cost, 6) as cost from cc"""
ORACLES["pair_dtw"] = class_dtw(OWN_COST, "0.0", INF, DTW_CELL, "sqrt(v)")
ORACLES["dtw_path"] = ORACLES["pair_dtw"]

# --- neighbours ---


def embedding_knn(k: int, dist: str, columns: str) -> str:
    return f"""with {EMB}, pd as (select q.series_id as query_id, r.series_id as ref_id, {dist} as dist from emb q, emb r),
 rk as (select *, row_number() over (partition by query_id order by dist, ref_id) as rn from pd)
 select query_id, rn::int as rank, ref_id{columns} from rk where rn <= {k}"""


ORACLES["knn_euclidean"] = embedding_knn(5, "list_distance(q.x, r.x)", ", round(dist, 6) as dist")
ORACLES["knn_manhattan"] = embedding_knn(
    5, "list_sum(list_transform(list_zip(q.x, r.x), lambda z: abs(z[1] - z[2])))", ", round(dist, 6) as dist")
ORACLES["knn_ids"] = embedding_knn(3, "list_distance(q.x, r.x)", "")


def event_pairs(where: str, band: int | None = None) -> str:
    cost = "sum((a.v - b.v) * (a.v - b.v))"
    if band is not None:
        cost = f"case when abs(any_value(a.t) - any_value(b.t)) <= {band} then {cost} else 'inf'::double end"
    return f"""want as (select q.series_id as qa, r.series_id as rb from {where}),
cc as (select w.qa, w.rb, a.t as i, b.t as j, {cost} as cost
       from want w join el a on a.series_id = w.qa join el b on b.series_id = w.rb and b.c = a.c group by all)"""


def event_knn(cell: str, value: str) -> str:
    users = "(select distinct series_id from el) q, (select distinct series_id from el) r"
    return f"""with recursive {events_cte(6)}, {aligned(event_pairs(users), '0.0', INF, cell, 5)},
 rk as (select qa, rb, {value} as dist, row_number() over (partition by qa order by {value}, rb) as rn from fin)
 select qa as query_id, rn::int as rank, rb as ref_id, round(dist, 6) as dist from rk where rn <= 3"""


ORACLES["knn_dtw"] = event_knn(DTW_CELL, "sqrt(v)")
ORACLES["knn_soft_dtw"] = event_knn(SOFT_CELL, "v")
ORACLES["flagged_edits"] = f"""with {EMB} select series_id, v::int as visit, v = 1 + series_id % 4 as is_best
 from emb, range(1, 5) r(v)"""
ORACLES["results_read_back"] = f"""with {EMB}, {MEANS} select el.series_id, el.series_id % 2 = 0 as is_best,
   el.label::bigint as label, count(*) as cells, round(sum(case when el.i < 16 then mean.v else el.v end), 6) as total
 from el join mean on mean.label = el.label and mean.i = el.i group by el.series_id, el.label"""
ORACLES["knn_gak"] = f"""with recursive {events_cte(6)}, {aligned(event_pairs(
    "(select distinct series_id from el) q, (select distinct series_id from el) r"), '1.0', '0.0', gak_cell(500.0), 5)},
 ks as (select f.qa, f.rb, f.v / sqrt(x.v * y.v) as dist from fin f join fin x on x.qa = f.qa and x.rb = f.qa
   join fin y on y.qa = f.rb and y.rb = f.rb),
 rk as (select *, row_number() over (partition by qa order by dist, rb) as rn from ks)
 select qa as query_id, rn::int as rank, rb as ref_id, round(dist, 6) as dist from rk where rn <= 3"""
ORACLES["nun_euclidean"] = f"""with {NUN} select query_id, nun_id, nun_label, round(nun_confidence, 6) as nun_confidence,
 round(dist, 6) as dist from nun"""
ORACLES["nun_euclidean_k5"] = f"""with {NUN}, k5 as (select *, row_number() over (partition by query_id order by rn) as n
   from rk where rn <= 5 and nun_confidence >= 0.9)
 select query_id, nun_id, nun_label, round(nun_confidence, 6) as nun_confidence, round(dist, 6) as dist
 from k5 where n = 1"""


def event_nun(band: int | None) -> str:
    unlike = "sc q join sc r on q.pred_label <> r.pred_label"
    return f"""with recursive {events_cte(6)}, {LOGIT}, {aligned(event_pairs(unlike, band), '0.0', INF, DTW_CELL, 5)},
 rk as (select qa, rb, sqrt(v) as dist, row_number() over (partition by qa order by v, rb) as rn from fin)
 select qa as query_id, rb as nun_id, s.pred_label as nun_label, round(s.confidence, 6) as nun_confidence,
        round(dist, 6) as dist
 from rk join sc s on s.series_id = rk.rb where rn = 1 and s.confidence >= 0.51"""


ORACLES["nun_dtw"] = event_nun(None)
ORACLES["nun_dtw_band"] = event_nun(1)
ORACLES["nun_attributes"] = f"""with {NUN},
 xs as (select series_id, sum(v) as x_sum from el group by series_id),
 ws as (select series_id, sum(w) as weight_sum from dev group by series_id)
 select query_id, nun_id, round(x_sum, 6) as x_sum, round(weight_sum, 6) as weight_sum
 from nun join xs on xs.series_id = nun_id join ws on ws.series_id = nun_id"""
for _other, _same in (("nun_euclidean_cells", "nun_euclidean"), ("knn_dtw_cells", "knn_dtw"),
                      ("dist_manhattan_blocks", "dist_manhattan")):
    ORACLES[_other] = ORACLES[_same]

# --- windows and candidates ---


def starts(weights: str, k: str, steps: int = 16) -> str:
    """First best window per series for the lengths `k`: CTE `st (series_id, k, start)`."""
    return f"""ws0 as (select w.series_id, k.k, w.t as s, round(sum(u.w), 9) as total
   from {weights} w, {k}, {weights} u where u.series_id = w.series_id and u.t >= w.t and u.t < w.t + k.k
   and w.t + k.k <= {steps} group by all),
st as (select series_id, k, arg_max(s, struct_pack(w := total, s := -s)) as start from ws0 group by all)"""


ORACLES["max_sum_start"] = f"""with {EMB}, {DEVIATION}, {starts('dev', '(select 5 as k) k')}
 select series_id, start::int as start from st"""
def long_windows(key: str, length: int) -> str:
    """The best window of rows by event, per key (or of all rows)."""
    part = f"partition by {key}" if key else ""
    return f"""with s as (select {key + "," if key else ""} event_id, max(abs(value)) over ({part}) as unit,
   round(value / max(abs(value)) over ({part}), 9)::decimal(38, 9) as v from events),
 w as (select *, sum(v) over win as total, count(*) over win as n from s
   window win as ({part} order by event_id rows between current row and {length - 1} following))
 select {key + "," if key else ""} arg_min(event_id, struct_pack(a := -total, b := event_id)) as start,
   round(max(total)::double * max(unit), 6) as total from w where n = {length} {"group by " + key if key else ""}"""


ORACLES["event_window"] = long_windows("", 1000)
ORACLES["user_windows"] = long_windows("user_id", 3)
ORACLES["naive_candidates"] = f"""with {NUN}, {starts('dev', '(select unnest(range(1, 17)) as k) k')},
 tr as (select n.query_id as series_id, n.nun_label, st.k, st.start, e.i,
          case when e.t >= st.start and e.t < st.start + st.k then d.v else e.v end as v
        from nun n join st on st.series_id = n.nun_id join el e on e.series_id = n.query_id
        join el d on d.series_id = n.nun_id and d.i = e.i),
 ts as (select tr.series_id, tr.nun_label, tr.k, tr.start, m.label, sum((tr.v - m.v) * (tr.v - m.v)) as d
        from tr join mean m on m.i = tr.i group by all),
 te as (select *, exp(-160 * (d - min(d) over (partition by series_id, k))) as e from ts),
 tp as (select *, e / sum(e) over (partition by series_id, k) as p from te),
 th as (select series_id, k, start, max(case when label = nun_label then p end) as target,
          arg_max(label, struct_pack(p := p, l := -label)) as label from tp group by all),
 tk as (select *, row_number() over (partition by series_id order by k) as n from th where target > 0.51)
 select series_id, k::int as length, start::int as start, label, round(target, 6) as target_confidence from tk where n = 1"""
ORACLES["changed_spans"] = f"""with {EMB}, {MEANS}, {SPLICED},
 ch as (select series_id, c, min(t) as a, max(t) as b, count(*) as n from sp where x <> cf group by all)
 select ch.series_id, ch.c, ch.a as first_t, ch.b as last_t, ch.n::int as n_changed, round(p.cf, 6) as first_value,
   round(q.cf, 6) as last_value, round(o.x, 6) as before_value, round(r.x, 6) as after_value
 from ch join sp p on p.series_id = ch.series_id and p.c = ch.c and p.t = ch.a
 join sp q on q.series_id = ch.series_id and q.c = ch.c and q.t = ch.b
 left join sp o on o.series_id = ch.series_id and o.c = ch.c and o.t = ch.a - 1
 left join sp r on r.series_id = ch.series_id and r.c = ch.c and r.t = ch.b + 1"""
ORACLES["scaled_importance"] = f"""with {EMB}, {DEVIATION},
 nw as (select series_id, t, case when max(w) over s > min(w) over s
          then (w - min(w) over s) / (max(w) over s - min(w) over s) else 0 end as w from dev window s as (partition by t)),
 rg as (select series_id, c, min(v) as low, max(v) as high from el group by all)
 select r.series_id, r.c, n.t, round(n.w * (r.high - r.low) + r.low, 6) as value from rg r join nw n using (series_id)"""


def judged(size: int) -> str:
    return f"""{NUN}, {starts('dev', '(select 8 as k) k')},
 sl as (select n.query_id as series_id, n.nun_id, n.nun_label, st.start, s::int as slot
        from nun n join st on st.series_id = n.nun_id, range({size}) r(s)),
 bt as (select series_id, slot, start, nun_id, nun_label, b, {draw(1, 1, 'series_id', 0, 'slot', 'b')} < 0.5 as bit
        from sl, range(32) r(b)),
 ed as (select b.series_id, b.slot, b.start, b.nun_label, e.i, e.v as x, case when c.bit then d.v else e.v end as v,
          coalesce(c.bit, false) as bit
        from sl b join el e on e.series_id = b.series_id join el d on d.series_id = b.nun_id and d.i = e.i
        left join bt c on c.series_id = b.series_id and c.slot = b.slot and c.b = e.i - b.start * 4),
 js as (select ed.series_id, ed.slot, ed.start, ed.nun_label, m.label, sum((ed.v - m.v) * (ed.v - m.v)) as d
        from ed join mean m on m.i = ed.i group by all),
 je as (select *, exp(-160 * (d - min(d) over (partition by series_id, slot))) as e from js),
 jp as (select *, e / sum(e) over (partition by series_id, slot) as p from je),
 jl as (select series_id, slot, start, max(case when label = nun_label then p end) as f1,
          arg_max(label, struct_pack(p := p, l := -label)) as label from jp group by all),
 jd as (select series_id, slot, sum(bit::int) / 32.0::double as f2, sqrt(sum((v - x) * (v - x))) as f3 from ed group by all),
 jd2 as (select l.series_id, l.slot, l.start, l.label, l.f1, d.f2, d.f3, 0.51::double - l.f1 as g
         from jl l join jd d using (series_id, slot))"""


ORACLES["evaluated_masks"] = f"""with {judged(4)} select series_id, slot, start::int as start, label, round(f1, 6) as f1,
 round(f2, 6) as f2, round(f3, 6) as f3, round(g, 6) as g from jd2"""
ORACLES["best_candidates"] = f"""with {judged(8)},
 bs as (select *, -0.4::double * round(f1, 9) + 0.6::double * round(f2, 9) as score from jd2),
 br as (select *, row_number() over (partition by series_id order by score desc, slot) as n from bs)
 select series_id, slot as pos, round(score, 6) as score from br where n = 1"""

# --- variation ---

POPULATION = f"""sl as (select vec_id as series_id, s::int as slot from embeddings, range(6) r(s)),
 bt as (select series_id, slot, b, ({draw(1, 1, 'series_id', 0, 'slot', 'b')} < 0.5)::int as bit
        from sl, range(12) r(b)),
 pop as (select series_id, slot, list(bit order by b) as mask, greatest(0.0::double, 6.0::double - sum(bit)) as cv
         from bt group by all)"""
PARENTS = f"""{POPULATION},
 td as (select e.vec_id as series_id, m::int as mating, s as side,
          floor({draw(1, 2, 'e.vec_id', 1, 'm * 2 + s', 0)} * 6)::int as a,
          floor({draw(1, 2, 'e.vec_id', 1, 'm * 2 + s', 1)} * 6)::int as b,
          {draw(1, 3, 'e.vec_id', 1, 'm * 2 + s', 0)} < 0.5 as toss
        from embeddings e, range(6) r(m), range(2) t(s)),
 tw as (select td.series_id, mating, side, case when p.cv < q.cv then a when q.cv < p.cv then b when toss then a else b end as w
        from td join pop p on p.series_id = td.series_id and p.slot = a join pop q on q.series_id = td.series_id and q.slot = b),
 tp as (select series_id, mating, max(case when side = 0 then w end) as first, max(case when side = 1 then w end) as second
        from tw group by all)"""
CROSSED = f"""{PARENTS},
 cu as (select tp.series_id, mating, p.mask as ma, q.mask as mb, 1 + floor({draw(1, 5, 'tp.series_id', 1, 'mating', 0)} * 11) as one,
          1 + floor({draw(1, 5, 'tp.series_id', 1, 'mating', 1)} * 10) as two0,
          {draw(1, 4, 'tp.series_id', 1, 'mating', 0)} < 0.8 as crossed
        from tp join pop p on p.series_id = tp.series_id and p.slot = first
        join pop q on q.series_id = tp.series_id and q.slot = second),
 cv as (select *, case when two0 >= one then two0 + 1 else two0 end as two from cu),
 cx as (select series_id, (mating + side * 6)::int as slot, b,
          case when crossed and b >= least(one, two) and b < greatest(one, two)
               then case when side = 0 then mb[(b + 1)::int] else ma[(b + 1)::int] end
               else case when side = 0 then ma[(b + 1)::int] else mb[(b + 1)::int] end end as bit
        from cv, range(2) r(side), range(12) t(b))"""
ORACLES["random_masks"] = f"with {POPULATION} select series_id, slot, array_to_string(mask, '') as mask from pop"
ORACLES["tournament_pairs"] = f"with {PARENTS} select series_id, mating, first, second from tp"
ORACLES["crossover_masks"] = f"""with {CROSSED} select series_id, slot, string_agg(bit::varchar, '' order by b) as mask
 from cx group by all"""
ORACLES["mutate_masks"] = f"""with {CROSSED},
 mu as (select series_id, slot, b, case when {draw(1, 6, 'series_id', 1, 'slot', 0)} < 0.9
          and {draw(1, 7, 'series_id', 1, 'slot', 'b')} < 1.0::double / 12 then 1 - bit else bit end as bit from cx)
 select series_id, slot, string_agg(bit::varchar, '' order by b) as mask from mu group by all"""

# --- fronts, ranks and niches ---

OFFERS = """o as (select l_suppkey as grp, l_partkey as row_id, min(l_extendedprice) as f0, 0 - max(l_discount) as f1,
   0 - sum(l_quantity) as f2, 10 - sum(l_quantity) as g from lineitem group by l_suppkey, l_partkey)"""
OFFER_FRONT = f"""{OFFERS}, fr as (select * from o a where not exists (select 1 from o b where b.grp = a.grp
   and b.f0 <= a.f0 and b.f1 <= a.f1 and b.f2 <= a.f2 and (b.f0 < a.f0 or b.f1 < a.f1 or b.f2 < a.f2)))"""
ORDERS = """o as (select o_custkey as grp, o_orderkey as row_id, o_totalprice as f0,
   date_diff('day', date '1992-01-01', o_orderdate::date)::double as f1, o_totalprice - 300000 as g from orders)"""


def order_ranks(source: str) -> str:
    """CTEs `dm`, `lv` and `rk (grp, row_id, rank)` of the longest domination chains of `source`."""
    return f"""dm as (select b.grp, b.row_id as dom, a.row_id as id from {source} a join {source} b on a.grp = b.grp
   and b.f0 <= a.f0 and b.f1 <= a.f1 and (b.f0 < a.f0 or b.f1 < a.f1)),
 lv as (select grp, row_id as id, 0 as lvl from {source} union select d.grp, d.id, lv.lvl + 1 from lv
   join dm d on d.dom = lv.id and d.grp = lv.grp),
 rk as (select grp, id as row_id, max(lvl) as rank from lv group by grp, id)"""


ORACLES["pareto_front"] = f"with {OFFER_FRONT} select grp, row_id, f0, f1, f2 from fr"
ORACLES["feasible_front"] = f"""with {ORDERS}, ok as (select * from o where g <= 0)
 select grp, row_id, f0, f1 from ok a where not exists (select 1 from ok b where b.grp = a.grp
   and b.f0 <= a.f0 and b.f1 <= a.f1 and (b.f0 < a.f0 or b.f1 < a.f1))"""
ORACLES["pareto_rank"] = f"with recursive {ORDERS}, {order_ranks('o')} select grp, row_id, rank::bigint as rank from rk"
ORACLES["pareto_front_global"] = """with o as (select l_orderkey * 10 + l_linenumber as row_id, l_extendedprice as f0,
   0 - l_quantity as f1, 0 - l_discount as f2 from lineitem),
 c as (select f1, f2, min(f0) as f0 from o group by f1, f2),
 fr as (select * from c a where not exists (select 1 from c b where b.f0 <= a.f0 and b.f1 <= a.f1 and b.f2 <= a.f2
   and (b.f0 < a.f0 or b.f1 < a.f1 or b.f2 < a.f2)))
 select row_id, f0, f1, f2 from o join fr using (f0, f1, f2)"""
# Peeling: in the order of both objectives a row is on the front if its second one is below all before.
ORACLES["pareto_rank_global"] = ORACLES["pareto_rank_grid"] = f"""with recursive {ORDERS},
 p as (select distinct f0, f1 from o),
 lv as (select f0, f1, 0::bigint as rank from p union all
   select f0, f1, rank + 1 from (select *, min(f1) over (order by f0, f1 rows between unbounded preceding and 1 preceding) as low
     from lv) where low <= f1),
 rk as (select f0, f1, max(rank) as rank from lv group by f0, f1)
 select row_id, rank from o join rk using (f0, f1)"""
ORACLES["violation"] = f"with {OFFERS} select grp, row_id, round(greatest(g, 0), 6) as cv, g <= 0 as ok from o"
PENALISED = """ws as (select grp, coalesce(max(case when g <= 0 then f0 end), max(f0)) as w0,
   coalesce(max(case when g <= 0 then f1 end), max(f1)) as w1 from o group by grp),
 pe as (select o.grp, row_id, case when g <= 0 then f0 else w0 + g end as f0, case when g <= 0 then f1 else w1 + g end as f1
   from o join ws using (grp))"""
ORACLES["penalise"] = f"with {ORDERS}, {PENALISED} select grp, row_id, round(f0, 6) as f0, round(f1, 6) as f1 from pe"
ORACLES["niche_null_groups"] = f"""with {ORDERS},
 n as (select case when grp % 4 <> 0 then grp % 4 end as grp, row_id, f0, f1, g from o),
 ws as (select grp, coalesce(max(case when g <= 0 then f0 end), max(f0)) as w0,
   coalesce(max(case when g <= 0 then f1 end), max(f1)) as w1 from n group by grp)
 select n.grp, row_id, round(case when g <= 0 then f0 else w0 + g end, 6) as f0,
   round(case when g <= 0 then f1 else w1 + g end, 6) as f1 from n join ws on n.grp is not distinct from ws.grp"""
ORACLES["ideal_point"] = f"""with {OFFERS} select grp, min(f0) as ideal0, min(f1) as ideal1, min(f2) as ideal2
 from o group by grp"""
W = "1000000::double"
EXTREMES = f"""{OFFER_FRONT}, id as (select grp, min(f0) as i0, min(f1) as i1, min(f2) as i2 from o group by grp),
 mv as (select fr.grp, row_id, f0, f1, f2, i0, i1, i2, f0 - i0 as d0, f1 - i1 as d1, f2 - i2 as d2 from fr join id using (grp)),
 ax as (select mv.*, a::int as axis, greatest(d0 * case when a = 0 then 1 else {W} end, d1 * case when a = 1 then 1 else {W} end,
          d2 * case when a = 2 then 1 else {W} end) as asf from mv, range(3) r(a)),
 ex as (select * from (select *, row_number() over (partition by grp, axis order by asf, row_id) as n from ax) where n = 1)"""
ORACLES["extreme_points"] = f"with {EXTREMES} select grp, axis, row_id, f0, f1, f2 from ex"


def _det(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_E = [[f"e{j}{k}" for k in range(3)] for j in range(3)]
_PLANE = [_det([["1" if k == j else _E[r][k] for k in range(3)] for r in range(3)]) for j in range(3)]
_PIVOT = ", ".join(f"max(case when axis = {j} then d{k} end) as e{j}{k}" for j in range(3) for k in range(3))
NADIR = f"""{EXTREMES}, em as (select grp, {_PIVOT} from ex group by grp),
 sh as (select grp, count(*) as size, max(f0) as m0, max(f1) as m1, max(f2) as m2 from fr group by grp),
 pl as (select em.grp, {_det(_E)} as det, {', '.join(f'{p} as n{j}' for j, p in enumerate(_PLANE))} from em),
 nd as (select pl.grp, i0, i1, i2, size, m0, m1, m2, det,
          {', '.join(f'case when det <> 0 then n{j} / det end as p{j}' for j in range(3))}
        from pl join sh using (grp) join id using (grp)),
 na as (select grp, i0, i1, i2, case when ok then i0 + 1 / p0 else m0 end as z0, case when ok then i1 + 1 / p1 else m1 end as z1,
          case when ok then i2 + 1 / p2 else m2 end as z2
        from (select *, det <> 0 and size >= 3 and coalesce(least(p0, p1, p2) >= 1e-14, false) as ok from nd))"""
ORACLES["nadir_point"] = f"""with {NADIR} select grp, round(z0, 6) as nadir0, round(z1, 6) as nadir1,
 round(z2, 6) as nadir2 from na"""
NICHES = f"""{NADIR},
 dr as (select row_number() over (order by i, j) - 1 as d, i / 3.0::double as u0, j / 3.0::double as u1,
          (3 - i - j) / 3.0::double as u2 from range(4) a(i), range(4) b(j) where i + j <= 3),
 nv as (select o.grp, row_id, (f0 - i0) / greatest(z0 - i0, 1e-12) as v0, (f1 - i1) / greatest(z1 - i1, 1e-12) as v1,
          (f2 - i2) / greatest(z2 - i2, 1e-12) as v2 from o join na using (grp)),
 ns as (select nv.*, d, u0, u1, u2, (v0 * u0 + v1 * u1 + v2 * u2) / (u0 * u0 + u1 * u1 + u2 * u2) as s from nv, dr),
 np as (select grp, row_id, d, round(sqrt((v0 - s * u0) * (v0 - s * u0) + (v1 - s * u1) * (v1 - s * u1)
          + (v2 - s * u2) * (v2 - s * u2)), 12) as dist from ns),
 ni as (select grp, row_id, arg_min(d, struct_pack(x := dist, d := d))::int as niche, min(dist) as niche_dist
        from np group by grp, row_id)"""
ORACLES["assign_niche"] = f"with {NICHES} select grp, row_id, niche, round(niche_dist, 6) as niche_dist from ni"


def niche_levels(candidates: str, counts: str, generation: int) -> str:
    """CTEs up to `lo`: candidates with their level and place in the order of the group."""
    return f"""cd as (select c.grp, c.row_id, c.niche, c.niche_dist, coalesce(k.members, 0) as members,
   row_number() over (partition by c.grp, c.niche order by c.niche_dist, c.row_id) as near
   from {candidates} c left join {counts} k on k.grp = c.grp and k.niche = c.niche),
 tu as (select *, case when members = 0 and near = 1 then -1 else {draw(1, 9, 'grp', generation, 'row_id', 0)} end as turn from cd),
 le as (select *, members + row_number() over (partition by grp, niche order by turn, row_id) - 1 as level from tu),
 lo as (select *, row_number() over (partition by grp order by level, lot, niche) as n
   from (select *, {draw(1, 8, 'grp', generation, 'niche', 'level')} as lot from le))"""


ORACLES["niche_select"] = f"""with {NICHES},
 ct as (select grp, niche, count(*) as members from ni semi join fr using (grp, row_id) group by all),
 re as (select * from ni anti join fr using (grp, row_id)), {niche_levels('re', 'ct', 2)}
 select grp, row_id, niche, level::bigint as level from lo where n <= 8"""
ORACLES["survivors"] = f"""with recursive {ORDERS}, {PENALISED}, {order_ranks('pe')},
 sz as (select grp, rank, count(*) as size, sum(count(*)) over (partition by grp order by rank) as upto from rk group by grp, rank),
 rm as (select grp, rank, upto, 5 - (upto - size) as room from sz where 5 - (upto - size) > 0),
 ra as (select o.*, rk.rank from o join rk using (grp, row_id)),
 fr as (select * from ra where rank = 0),
 id as (select grp, min(f0) as i0, min(f1) as i1 from o group by grp),
 mv as (select fr.grp, row_id, f0 - i0 as d0, f1 - i1 as d1, f0, f1 from fr join id using (grp)),
 ax as (select mv.*, a as axis, greatest(d0 * case when a = 0 then 1 else {W} end, d1 * case when a = 1 then 1 else {W} end) as asf
        from mv, range(2) r(a)),
 ex as (select * from (select *, row_number() over (partition by grp, axis order by asf, row_id) as n from ax) where n = 1),
 em as (select grp, max(case when axis = 0 then d0 end) as a, max(case when axis = 0 then d1 end) as b,
          max(case when axis = 1 then d0 end) as c, max(case when axis = 1 then d1 end) as d from ex group by grp),
 sh as (select grp, count(*) as size, max(f0) as m0, max(f1) as m1 from fr group by grp),
 nd as (select em.grp, i0, i1, m0, m1, size, a * d - b * c as det, case when a * d - b * c <> 0 then (d - b) / (a * d - b * c) end as p0,
          case when a * d - b * c <> 0 then (a - c) / (a * d - b * c) end as p1 from em join sh using (grp) join id using (grp)),
 na as (select grp, i0, i1, case when ok then i0 + 1 / p0 else m0 end as z0, case when ok then i1 + 1 / p1 else m1 end as z1
        from (select *, size >= 2 and coalesce(least(p0, p1) >= 1e-14, false) as ok from nd)),
 nv as (select ra.grp, row_id, ra.rank, upto, room, (f0 - i0) / greatest(z0 - i0, 1e-12) as v0,
          (f1 - i1) / greatest(z1 - i1, 1e-12) as v1 from ra join rm using (grp, rank) join na using (grp)),
 dr as (select i as d, i / 3.0::double as u0, (3 - i) / 3.0::double as u1 from range(4) r(i)),
 np as (select nv.*, d, round(sqrt((v0 - s * u0) * (v0 - s * u0) + (v1 - s * u1) * (v1 - s * u1)), 12) as dist
        from (select nv.*, d, u0, u1, (v0 * u0 + v1 * u1) / (u0 * u0 + u1 * u1) as s from nv, dr) nv),
 ni as (select grp, row_id, rank, upto, room, arg_min(d, struct_pack(x := dist, d := d)) as niche, min(dist) as niche_dist
        from np group by all),
 ct as (select grp, niche, count(*) as members from ni where upto <= 5 group by all),
 re as (select * from ni where upto > 5), {niche_levels('re', 'ct', 3)}
 select grp, row_id, rank::bigint as rank from ni where upto <= 5
 union all select lo.grp, lo.row_id, re.rank::bigint from lo join re using (grp, row_id) where lo.n <= re.room"""
