"""DuckDB SQL for the registered queries, put together from common table expressions."""

from __future__ import annotations

from weekloom.operators.smoothing import CANDIDATES
from weekloom.sources.driver_tables import FEEDS_SQL

AS_OF = "1998-06-01"
K = "item_id, region"


def frame(before: int, after: int, keys: str = K) -> str:
    ahead = f"{after} following" if after else "current row"
    return f"(partition by {keys} order by week rows between {before} preceding and {ahead})"


def med(col: str, before: int, after: int, least: int = 1, keys: str = K) -> str:
    return f"case when count({col}) over {frame(before, after, keys)} >= {least} then quantile_cont({col}, 0.5) over {frame(before, after, keys)} end"


def interpolated(src: str, name: str, col: str, out: str, keys: str = K) -> str:
    back, ahead = f"(partition by {keys} order by week rows between unbounded preceding and current row)", f"(partition by {keys} order by week rows between current row and unbounded following)"
    at = f"case when {col} is not null then _at end"
    return f"""
{name}_0 as (select *, row_number() over (partition by {keys} order by week) as _at from {src}),
{name}_1 as (select *, last_value({col} ignore nulls) over {back} as _p, first_value({col} ignore nulls) over {ahead} as _n,
  last_value({at} ignore nulls) over {back} as _pa, first_value({at} ignore nulls) over {ahead} as _na from {name}_0),
{name} as (select * exclude (_at, _p, _n, _pa, _na), case when {col} is not null then {col} when _p is null then _n when _n is null then _p
  else _p + (_n - _p) * (_at - _pa) / (_na - _pa)::double end as {out} from {name}_1)"""


def mad(src: str, name: str, col: str, out: str) -> str:
    return f"""
{name}_0 as (select *, quantile_cont({col}, 0.5) over (partition by {K}) as _c from {src}),
{name} as (select * exclude (_c), quantile_cont(abs({col} - _c), 0.5) over (partition by {K}) + 1e-9::double as {out} from {name}_0)"""


REPAIR = (
    """
j as (
  select p.item_id, p.region, p.week, p.units_sold, i.on_hand_units, coalesce(m.promo_flag, 0) as promo_flag
  from pos p left join inv i using (item_id, region, week) left join promo m using (item_id, region, week)
),
l0 as (select *, """
    + med("units_sold", 5, 5, 3)
    + """ as _lvl from j),"""
    + interpolated("l0", "l1", "_lvl", "expected")
    + """,
c0 as (select *, units_sold - expected as _dev from l1),"""
    + mad("c0", "c1", "_dev", "_mad")
    + """,
c2 as (select *, avg((on_hand_units is not null)::int) over (partition by item_id, region) > 0.5 as _has, """
    + med("on_hand_units", 7, 0)
    + """ as _trail from c1),
censored as (
  select *, coalesce(units_sold < 0.4::double * expected and (expected - units_sold > 3.5::double * 1.4826::double * _mad or (_has and coalesce(_trail > 0 and on_hand_units < 0.5::double * _trail, false))), false) as is_censored
  from c2
),
i0 as (select *, case when not is_censored then units_sold end as _open from censored),
i1 as (select * exclude (_lvl), """
    + med("_open", 5, 5, 2)
    + """ as _lvl from i0),"""
    + interpolated("i1", "i2", "_lvl", "_fill")
    + """,
imputed as (select *, case when is_censored then greatest(0, coalesce(_fill, units_sold)) else units_sold end as imputed from i2),
o0 as (select * exclude (_dev, _mad), imputed - expected as _dev from imputed),"""
    + mad("o0", "o1", "_dev", "_mad")
    + """,
o2 as (select *, abs(_dev) > 5.0::double * 1.4826::double * _mad as _far from o1),
o3 as (select *, coalesce(lag(_far) over (partition by item_id, region order by week), false) as _b, coalesce(lead(_far) over (partition by item_id, region order by week), false) as _a from o2),
damped as (
  select *, _far and not _b and not _a and promo_flag <= 0 and not is_censored as lone,
    case when _far and not _b and not _a and promo_flag <= 0 and not is_censored then greatest(0, expected) else imputed end as units_unconstrained
  from o3
),
p0 as (select * exclude (_lvl), case when promo_flag <= 0 then units_unconstrained end as _base from damped),
p1 as (select *, """
    + med("_base", 3, 3)
    + """ as _lvl from p0),"""
    + interpolated("p1", "p2", "_lvl", "_level")
    + """,
repaired as (
  select *, units_unconstrained - promo_uplift as base_units from (
    select *, case when promo_flag > 0 then case when _level is not null then greatest(0, units_unconstrained - _level) end when _level is not null then 0 end as promo_uplift from p2)
)"""
)

AXIS = """
axis as (select week, row_number() over (order by week) - 1 as idx from (select distinct week from repaired)),
origins as (select week as as_of, idx as origin from axis where idx >= greatest(8, (select count(*) from axis) - 27) and idx < (select count(*) from axis) - 1),
targets as (select as_of, (a.idx - origin)::int as lag, a.week as target from origins join axis a on a.idx > origin)"""

ONE_ORIGIN = f"origins as (select date '{AS_OF}' as as_of)"

STATE = (
    """
s0 as (select item_id, region, week, units_unconstrained as y, """
    + med("units_unconstrained", 8, 0)
    + """ as _m from repaired),
s1 as (select *, abs(y - _m) as _d from s0),
s2 as (select *, least(y, _m + 3.0::double * ("""
    + med("_d", 8, 0)
    + """ * 1.4826::double + 1e-9::double)) as capped, row_number() over (partition by item_id, region order by week) - 1 as ix from s1),
s3 as (select *, list(capped) over """
    + frame(127, 0)
    + """ as _l, case when ix >= 3 then regr_slope(capped, ix::double) over """
    + frame(9, 0)
    + """ else 0 end as trend from s2),
s4 as (select * exclude (_l), list_sum(list_transform(_l, lambda x, i: x * power(5.0::double / 7, len(_l) - i))) / list_sum(list_transform(_l, lambda x, i: power(5.0::double / 7, len(_l) - i))) as level from s3),
state as (select *, y - lag(level) over (partition by item_id, region order by week) as resid from s4)"""
)

FORECAST = (
    """
rows as (select s.*, o.as_of from state s join origins o on s.week <= o.as_of),
last as (
  select item_id, region, as_of, max(week) as last_week, max_by(y, week) as y, max_by(level, week) as level, max_by(trend, week) as trend, max_by(ix, week) as ix,
    quantile_cont(resid, 0.1) as q10, quantile_cont(resid, 0.9) as q90, count(resid) as residuals, stddev_pop(y) as sd
  from rows group by item_id, region, as_of
),
f0 as (select *, count(*) over (partition by item_id, region, as_of) as _n from rows),
f1 as (select *, """
    + med("capped", 26, 25, 26, "item_id, region, as_of")
    + """ as _l from f0 where _n >= 91),"""
    + interpolated("f1", "f2", "_l", "_level", "item_id, region, as_of")
    + """,
factors as (
  select item_id, region, as_of, ix % 52 as pos, 0.5::double * quantile_cont(case when _level > 0 then capped / _level else 1 end, 0.5) + 0.5::double as factor
  from f2 group by item_id, region, as_of, ix % 52
),
steps as (
  select l.*, unnest(range(1, 9))::int as lag, least(0, case when residuals < 5 then -1.2816::double * sd else q10 end) as lo, greatest(0, case when residuals < 5 then 1.2816::double * sd else q90 end) as hi from last l
),
points as (
  select s.*, case when s.ix < 1 then greatest(0, y) else greatest(0, (power(0.75::double, lag) * y + (1 - power(0.75::double, lag)) * (level + trend * (0.9::double * (1 - power(0.9::double, lag)) / 0.1::double))) * coalesce(factor, 1)) end as p50
  from steps s left join factors f on f.item_id = s.item_id and f.region = s.region and f.as_of = s.as_of and f.pos = (s.ix + s.lag) % 52
),
forecast as (
  select item_id, region, as_of, last_week, last_week + 7 * lag as week, lag, greatest(0, least(p50, p50 + case when ix < 1 then 0 else lo end * sqrt(lag))) as p10, p50,
    greatest(p50, p50 + case when ix < 1 then 0 else hi end * sqrt(lag)) as p90
  from points
)"""
)


def smoothed(best_only: bool = False) -> str:
    """The best smoothing model of each series and origin by a recursion over weeks, a row for each candidate; needs ``with recursive``."""
    grid = ", ".join(f"({i}, '{c.trend}', {str(c.seasonal).lower()}, {c.alpha!r}::double, {c.beta!r}::double, {c.phi!r}::double, {c.gamma!r}::double, {c.terms})" for i, c in enumerate(CANDIDATES))
    return f"""
cand(id, trend, seasonal, alpha, beta, phi, gamma, terms) as (values {grid}),
obs as (select item_id, region, week, units_unconstrained as y, (row_number() over (partition by item_id, region order by week))::int as n from repaired where units_unconstrained is not null),
begun as (
  select item_id, region, max(n) as size, avg(y) filter (n <= 10) as m, regr_slope(y, n) filter (n <= 10) as slope, avg(y) filter (n <= 52) as y1, avg(y) filter (n between 53 and 104) as y2, list(y order by n) filter (n <= 52) as ys from obs group by all
),
folds(item_id, region, id, n, l, b, s, sse) as (
  select item_id, region, id, 0::int, case when seasonal then y1 when trend = 'none' then m else m - 5.5::double * slope end, case when trend = 'none' then 0::double when seasonal then (y2 - y1) / 52 else slope end,
    case when seasonal then list_transform(ys, lambda x: x - y1) else []::double[] end, 0::double
  from begun, cand where size >= 10 and (size >= 104 or not seasonal)
  union all
  select item_id, region, id, n, mu + alpha * e, phi * b + beta * e, case when seasonal then list_append(s[2:], s[1] + gamma * e) else s end, sse + e * e
  from (
    select f.item_id, f.region, f.id, o.n, l + phi * b as mu, o.y - (l + phi * b + coalesce(s[1], 0)) as e, b, s, sse, alpha, beta, phi, gamma, seasonal
    from folds f join cand c on c.id = f.id join obs o on o.item_id = f.item_id and o.region = f.region and o.n = f.n + 1
  )
),
lengths as (select item_id, region, as_of, max(n) as n from obs join origins on week <= as_of group by all having max(n) >= 10),
tried as (
  select k.item_id, k.region, k.as_of, k.n as n_weeks, c.*, l, b, s, k.n * ln(greatest(sse / k.n, 1e-12::double)) + 2 * terms + 2.0::double * terms * (terms + 1) / (k.n - terms - 1) as aicc
  from lengths k join folds f on f.item_id = k.item_id and f.region = k.region and f.n = k.n join cand c on c.id = f.id where k.n >= 104 or not seasonal
),
best as (select * from tried qualify row_number() over (partition by item_id, region, as_of order by aicc, id) = 1)""" + ("" if best_only else """,
smooth as (
  select *, greatest(0, l + b * list_sum(list_transform(range(1, lag + 1), lambda i: power(phi, i))) + coalesce(s[(lag - 1) % 52 + 1], 0)) as pred from best, (select unnest(range(1, 9))::int as lag)
),
shown as (
  select p.item_id, p.region, p.as_of, p.last_week, p.lag, p.ix, p.lo, p.hi, coalesce(s.pred, p.p50) as p50 from points p left join smooth s on s.item_id = p.item_id and s.region = p.region and s.as_of = p.as_of and s.lag = p.lag
)""")


SMOOTHED_PRED = "select f.item_id, f.region, f.as_of, t.target as week, f.p50 as pred from shown f join targets t on t.as_of = f.as_of and t.lag = f.lag"

PLAN_AS_OF = """
vintages as (select item_id, region, week, as_of, max_by(plan_units, plan_version_date) as plan_units, max(plan_version_date) as plan_version_date from plan join origins on plan_version_date <= as_of group by all)"""

WEIGHT = "greatest(0.15::double, least(1.0::double, case when lag <= 2 then 0.9::double else 0.9::double - 0.7::double * (lag - 2) / 6.0::double end))"
BLEND = f"""
blended as (
  select f.item_id, f.region, f.week, f.lag, p10, p50, p90, plan_units, {WEIGHT} as w
  from forecast f left join vintages v on v.item_id = f.item_id and v.region = f.region and v.week = f.week and v.as_of = f.as_of
)"""

NAIVE = """
naive as (
  select item_id, region, as_of, greatest(0, max_by(units_unconstrained, week)) as v from repaired join origins on week <= as_of group by all
)"""


def scored(pred: str, method: str) -> str:
    """Tidy scores of forecasts given by (item_id, region, as_of, week, pred)."""
    return f"""
select p.item_id, p.region, t.lag, p.week, p.as_of, round(p.pred, 6) as pred, round(r.units_unconstrained, 6) as actual, '{method}' as method
from ({pred}) p join targets t on t.as_of = p.as_of and t.target = p.week join repaired r on r.item_id = p.item_id and r.region = p.region and r.week = p.week
where t.lag in (1, 2, 4, 8)"""


NAIVE_PRED = "select n.item_id, n.region, n.as_of, t.target as week, n.v as pred from naive n join targets t on t.as_of = n.as_of where t.lag <= 8"
STAT_PRED = "select f.item_id, f.region, f.as_of, t.target as week, f.p50 as pred from forecast f join targets t on t.as_of = f.as_of and t.lag = f.lag"
PLAN_PRED = "select item_id, region, as_of, week, plan_units as pred from vintages where week > as_of"

ROWS = f"""
known as (select * from repaired where week <= date '{AS_OF}'),
joined as (
  select r.item_id, r.region, r.week, r.units_unconstrained as s, r.is_censored, i.on_hand_units as oh, coalesce(i.in_transit_units, 0) as it, h.units_shipped as h
  from known r left join inv i using (item_id, region, week) left join ship h using (item_id, region, week)
)"""

USABLE = """
us as (select *, lag(oh) over (partition by item_id, region order by week) - oh as fall from joined),
ua as (
  select item_id, region, avg((oh is not null)::int) as share, count(oh) as n, avg(oh) as mean, stddev_pop(oh) as sd, count(case when fall is not null and s is not null then 1 end) as pairs,
    case when stddev_pop(case when s is not null then fall end) > 0 and stddev_pop(case when fall is not null then s end) > 0 then corr(s, fall) end as c
  from us group by all
),
usable as (
  select item_id, region, share >= 0.6 and n >= 4 and coalesce(mean > 0 and sd / nullif(mean, 0) >= 0.02, false) and case when pairs >= 6 and c is not null then c > 0 else true end as usable from ua
)"""

WOS = """
wa as (select *, avg(s) over (partition by item_id, region) as m from joined),
wb as (select *, oh is not null and not is_censored and s > 0 and m > 0 as clean from wa),
wos as (
  select item_id, region, case when count(case when clean then 1 end) >= 12 and quantile_cont(case when clean and oh > 0 then oh / m end, 0.5) is not null
    then greatest(1, least(12, quantile_cont(case when clean and oh > 0 then oh / m end, 0.5))) else 4.0::double end as target_wos
  from wb group by all
)"""

RECOVERY = """
ra as (select *, case when s > 0 then (oh - lag(oh) over (partition by item_id, region order by week) + s) / s end as r from joined),
recovery as (select item_id, region, case when count(*) >= 6 and quantile_cont(r, 0.5) is not null then greatest(0, least(1.5::double, quantile_cont(r, 0.5))) else 1 end as replenish from ra group by all)"""

def _solved(src: str, size: int, name: str) -> str:
    """Least squares from covariances a<i><j>, a<i>y, means m<i>, my of ``src`` by elimination, coefficients t0 (intercept) to t<size>."""
    out, last = [f"{name}_v as (select *, {', '.join(f'a{i}{i} as v{i}' for i in range(size))} from {src})"], f"{name}_v"
    rest = lambda k: range(k + 1, size)
    for k in range(size - 1):
        pivot = f"case when a{k}{k} > 1e-9::double * v{k} then a{k}{k} end"
        new = ", ".join(f"a{i}{j} - coalesce(a{k}{i} * a{k}{j} / ({pivot}), 0) as a{i}{j}" for i in rest(k) for j in [*range(i, size), "y"])
        out.append(f"{name}_{k} as (select * replace ({new}) from {last})")
        last = f"{name}_{k}"
    for k in reversed(range(size)):
        known = "".join(f" - a{k}{j} * t{j + 1}" for j in rest(k))
        out.append(f"{name}_b{k} as (select *, coalesce((a{k}y{known}) / case when a{k}{k} > 1e-9::double * v{k} then a{k}{k} end, 0) as t{k + 1} from {last})")
        last = f"{name}_b{k}"
    return ",\n".join([*out, f"{name}_c as (select *, my - {' - '.join(f't{k + 1} * m{k}' for k in range(size))} as t0 from {last})"])


_LAGGED = ("s", "l1", "l2", "l3")
TRANSFER = f"""
ta as (select *, {", ".join(f"lag(s, {k}) over (partition by item_id, region order by week) as l{k}" for k in (1, 2, 3))} from joined),
tb as (
  select item_id, region, count(*) as n, count(h) as kn, count(s) as sn, stddev_pop(s) as sd, avg(h) / nullif(avg(s), 0) as r, avg(h) filter (l3 is not null) as my,
    {", ".join(f"avg({x}) filter (l3 is not null and h is not null) as m{i}, covar_pop({x}, h) filter (l3 is not null) as a{i}y" for i, x in enumerate(_LAGGED))},
    {", ".join(f"covar_pop({x}, {y}) filter (l3 is not null and h is not null) as a{i}{j}" for i, x in enumerate(_LAGGED) for j, y in enumerate(_LAGGED) if i <= j)}
  from ta group by all
),
{_solved("tb", 4, "tc")},
transfer as (
  select item_id, region, n >= 10 and kn = n and sn = n and sd > 0 as fitted, {", ".join(f"case when n >= 10 and kn = n and sn = n and sd > 0 then t{k} end as t{k}" for k in range(5))}, case when r > 0 then r else 1 end as ratio from tc_c
)"""


def _both(x: str, y: str) -> str:
    """Correlation where both are known and vary."""
    return f"case when stddev_pop(case when {y} is not null then {x} end) > 0 and stddev_pop(case when {x} is not null then {y} end) > 0 then corr({x}, {y}) end"


_E = "item_id, region, e"
_XS = ("s", "l1", "l2", "l3")


def _orthogonal() -> str:
    """Least squares of h on s and its three lags for each history, by making each regressor orthogonal to those before it."""
    out, last = [f"o_ as (select {_E}, h, {', '.join(_XS)}, {', '.join(f'var_pop({x}) over (partition by {_E}) as v{i}' for i, x in enumerate(_XS))} from pre where l3 is not null and h is not null and s is not null)"], "o_"
    slope = lambda y, k: f"case when w{k} > 1e-9::double * v{k} then regr_slope({y}, q{k}) over (partition by {_E}) else 0 end"
    for k, x in enumerate(_XS):
        out.append(f"o_r{k} as (select *, {x} - avg({x}) over (partition by {_E}){''.join(f' - r{k}{j} * q{j}' for j in range(k))} as q{k} from (select *{''.join(f', {slope(x, j)} as r{k}{j}' for j in range(k))} from {last}))")
        out.append(f"o_q{k} as (select *, var_pop(q{k}) over (partition by {_E}) as w{k} from o_r{k})")
        last = f"o_q{k}"
    sums = ", ".join(f"any_value(r{k}{j}) as r{k}{j}" for k in range(4) for j in range(k))
    out.append(f"o_g as (select {_E}, avg(h) as my, {', '.join(f'avg({x}) as m{i}' for i, x in enumerate(_XS))}, {sums}, {', '.join(f'case when any_value(w{k}) > 1e-9::double * any_value(v{k}) then regr_slope(h, q{k}) else 0 end as g{k}' for k in range(4))} from {last} group by {_E})")
    last = "o_g"
    for k in reversed(range(4)):
        out.append(f"o_b{k} as (select *, g{k}{''.join(f' - b{j} * r{j}{k}' for j in range(k + 1, 4))} as b{k} from {last})")
        last = f"o_b{k}"
    return ",\n".join([*out, f"moves as (select {_E}, my{''.join(f' - b{k} * m{k}' for k in range(4))} as t0, {', '.join(f'b{k} as t{k + 1}' for k in range(4))} from {last})"])


#: Sell-in at every origin, from copies of each history: what a fit on the history alone gives.
TRANSLATED = f"""
q0 as (
  select r.item_id, r.region, r.week, r.units_unconstrained as s, r.is_censored, i.on_hand_units as oh, i.in_transit_units as it, h.units_shipped as h
  from mended r left join inv i using (item_id, region, week) left join ship h using (item_id, region, week)
),
q1 as (select *, row_number() over wk as ix, lead(week) over wk as until, lag(oh) over wk as before, {", ".join(f"lag(s, {k}) over wk as l{k}" for k in range(5))} from q0 window wk as (partition by item_id, region order by week)),
q as (select *, before - oh as fall, case when s > 0 then (oh - before + s) / s end as rec, before + coalesce(it, 0) - s as pos, oh is not null and not is_censored and s > 0 as clean from q1),
own as (select item_id, region, as_of as origin, ix from q join origins on week <= as_of and (until is null or as_of < until)),
asked as (select distinct item_id, region, unnest(range(greatest(1, ix - 7), ix + 1)) as e from own),
pre as (select q.*, a.e from asked a join q on q.item_id = a.item_id and q.region = a.region and q.ix <= a.e),
fit as (
  select {_E}, count(*) as n, count(h) as kn, count(s) as sn, avg(s) as mean, stddev_pop(s) as spread, avg(h) / nullif(avg(s), 0) as r,
    avg((oh is not null)::int) as share, count(oh) as held, avg(oh) as lev, stddev_pop(oh) as sd, count(case when fall is not null and s is not null then 1 end) as fn, {_both("s", "fall")} as cf,
    {", ".join(f"{_both(f'l{k}', 'h')} as c{k}" for k in range(5))}, count(case when clean then 1 end) as nc, quantile_cont(case when clean and oh > 0 then oh end, 0.5) as mc,
    quantile_cont(rec, 0.5) as mr, quantile_cont(oh, 0.5) as moh, quantile_cont(case when h > 0 then h end, 0.5) as usual, max_by(oh, case when oh is not null then week end) as last_oh, max_by(coalesce(it, 0), case when oh is not null then week end) as last_it,
    max_by(coalesce(oh, -1), week) as end_oh, max_by(coalesce(it, 0), week) as end_it, max(week) as week
  from pre group by {_E}
),
gaps as (select {_E}, count(*) as orders, quantile_cont(gap::double, 0.5) as gap from (
  select p.item_id, p.region, p.e, ix - lag(ix) over (partition by p.item_id, p.region, p.e order by ix) as gap from pre p join fit f using (item_id, region, e) where h > coalesce(0.05::double * usual, 0)) group by {_E}),
tries as ({" union all ".join(f"select {_E}, {k} as k, c{k} as c from fit where c{k} is not null and n - {k} >= 8" for k in range(5))}),
react as (select {_E}, arg_max(k, c - 1e-15::double * k) as k, max(c) as c from tries group by {_E}),
ra as (
  select {_E}, count(h) as rn, avg(h) as my, avg(s) as m1, avg(pos) as m2, covar_pop(s, s) as a11, covar_pop(pos, pos) as a22, covar_pop(s, pos) as a12, covar_pop(s, h) as y1, covar_pop(pos, h) as y2
  from pre where s is not null and pos is not null and h is not null group by {_E}
),
rb as (select *, (y1 * a22 - y2 * a12) / (a11 * a22 - a12 * a12) as b1, (y2 * a11 - y1 * a12) / (a11 * a22 - a12 * a12) as b2 from ra where rn >= 12 and a11 > 0 and a22 - a12 * a12 / a11 > 1e-9::double * a22),
response as (select {_E}, my - b1 * m1 - b2 * m2 as b0, b1, b2 from rb where b1 > 0),
{_orthogonal()},
fits as (
  select f.item_id, f.region, f.e, f.n, f.week, share >= 0.6 and held >= 4 and coalesce(lev > 0 and sd / nullif(lev, 0) >= 0.02, false) and case when fn >= 6 and cf is not null then cf > 0 else true end as usable,
    case when nc >= 12 and mean > 0 and mc is not null then greatest(1, least(12, mc / mean)) else 4.0::double end as wos, case when n >= 6 and mr is not null then greatest(0, least(1.5::double, mr)) else 1 end as rep,
    case when kn >= 12 and n >= 12 and t.c > 0 then t.k else 1 end as lagw, case when kn >= 12 and orders >= 3 then greatest(1, least(4, round_even(gap, 0)::int)) else 1 end as cad,
    b0, b1, b2, case when n >= 10 and kn = n and sn = n and spread > 0 then t0 end as t0, t1, t2, t3, t4, case when r > 0 then r else 1 end as ratio, moh, last_oh, last_it, case when end_oh >= 0 then end_oh end as end_oh, end_it
  from fit f left join gaps using (item_id, region, e) left join react t using (item_id, region, e) left join response using (item_id, region, e) left join moves using (item_id, region, e)
),
dates as (select distinct week as as_of from fits),
{STATE.replace("from repaired", "from mended").strip()},
{FORECAST.replace("join origins o", "join dates o").strip()},
ahead as (select f.item_id, f.region, f.e, p.lag, greatest(0, p.p50) as fc from fits f join forecast p on p.item_id = f.item_id and p.region = f.region and p.as_of = f.week),
means as (select {_E}, avg(fc) as fc from ahead group by {_E}),
around as (select {_E}, lag as j, fc as v from ahead union all select f.item_id, f.region, f.e, (q.ix - f.e)::int as j, q.s as v from fits f join q on q.item_id = f.item_id and q.region = f.region and q.ix between f.e - 2 and f.e),
other as (
  select a.item_id, a.region, a.e, a.lag, case when any_value(f.t0) is null then any_value(a.fc) * any_value(f.ratio) else greatest(0, any_value(f.t0) + sum(v.v * case a.lag - v.j when 0 then f.t1 when 1 then f.t2 when 2 then f.t3 else f.t4 end)) end as pred
  from ahead a join fits f using (item_id, region, e) left join around v on v.item_id = a.item_id and v.region = a.region and v.e = a.e and v.j between a.lag - 3 and a.lag group by a.item_id, a.region, a.e, a.lag
),
runs as (
  select o.item_id, o.region, o.origin, o.ix, f.e, f.e = o.ix as final, m.wos, m.cad, m.lagw, f.rep, f.b0, f.b1, f.b2, case when f.e = o.ix then 8 else least(4, o.ix - f.e) end as most,
    case when f.e = o.ix then coalesce(f.last_oh, m.wos * a.fc) else coalesce(f.end_oh, f.moh) end as oh0, case when f.e = o.ix then coalesce(f.last_it, 0) else f.end_it end as it0
  from own o join fits m on m.item_id = o.item_id and m.region = o.region and m.e = o.ix join fits f on f.item_id = o.item_id and f.region = o.region and f.e between o.ix - 7 and o.ix
  join means a on a.item_id = f.item_id and a.region = f.region and a.e = f.e
),
walk as (
  select *, 0 as lag, greatest(0, oh0)::double as held, 0::double as ord from runs
  union all
  select x.* exclude (lag, held, ord, fc, pos), lag + 1, greatest(0, pos + rep * fc), case when lag % cad = 0 then greatest(0, coalesce(b0 + b1 * fc + b2 * pos, fc + wos * fc - pos) + fc * (cad - 1)) else 0 end
  from (select w.*, a.fc, held + case when w.lag = lagw then greatest(0, it0) else 0 end - a.fc as pos from walk w join ahead a on a.item_id = w.item_id and a.region = w.region and a.e = w.e and a.lag = w.lag + 1 where w.lag < most) x
),
replayed as (select w.*, o.pred as ord_other, q.h as actual from walk w join other o on o.item_id = w.item_id and o.region = w.region and o.e = w.e and o.lag = w.lag left join q on q.item_id = w.item_id and q.region = w.region and q.ix = w.e + w.lag where w.lag > 0),
missed as (
  select item_id, region, origin, e, case when count(actual) = count(*) then case when sum(abs(actual)) > 0 then sum(abs(actual - ord)) / sum(abs(actual)) else 'infinity'::double end end as by_projection,
    case when count(actual) = count(*) then case when sum(abs(actual)) > 0 then sum(abs(actual - ord_other)) / sum(abs(actual)) else 'infinity'::double end end as by_transfer
  from replayed where not final group by item_id, region, origin, e
),
method as (
  select o.item_id, o.region, o.origin, case when not any_value(f.usable) or coalesce(any_value(f.n) >= 20 and avg(by_projection) > avg(by_transfer), false) then 'transfer' else 'projection' end as chosen
  from own o join fits f on f.item_id = o.item_id and f.region = o.region and f.e = o.ix left join missed m on m.item_id = o.item_id and m.region = o.region and m.origin = o.origin group by o.item_id, o.region, o.origin
),
translated as (
  select item_id, region, origin as as_of, lag, case chosen when 'transfer' then ord_other else ord end as pred from replayed join method using (item_id, region, origin) where final
)"""

TRANSLATED_PRED = "select f.item_id, f.region, f.as_of, t.target as week, f.pred from translated f join targets t on t.as_of = f.as_of and t.lag = f.lag"


PROJECTION = f"""
paths as (select item_id, region, lag, week, p50 from forecast),
seeds as (select item_id, region, max_by(on_hand_units, week) as oh, max_by(in_transit_units, week) as it from inv where week <= date '{AS_OF}' group by all),
params as (
  select u.item_id, u.region, case when usable then w.target_wos else 4.0::double end as wos, replenish, s.oh, coalesce(s.it, 0) as it
  from usable u join wos w using (item_id, region) join recovery using (item_id, region) left join seeds s using (item_id, region)
),
project as (
  select item_id, region, 0 as lag, null::date as week, greatest(0, coalesce(p.oh, (p.wos + 1) * (select avg(p50) from paths q where q.item_id = p.item_id and q.region = p.region)))::double as held, 0::double as target, 0::double as ord from params p
  union all
  select j.item_id, j.region, j.lag + 1, q.week, greatest(0, j.held + case when j.lag = 1 then greatest(0, p.it) else 0 end - greatest(0, q.p50) + p.replenish * greatest(0, q.p50)),
    p.wos * greatest(0, q.p50), greatest(0, greatest(0, q.p50) + p.wos * greatest(0, q.p50) - (j.held + case when j.lag = 1 then greatest(0, p.it) else 0 end - greatest(0, q.p50)))
  from project j join paths q on q.item_id = j.item_id and q.region = j.region and q.lag = j.lag + 1 join params p on p.item_id = j.item_id and p.region = j.region
),
projection as (select item_id, region, lag, week, held as projected_on_hand, target as target_position, ord as projected_order from project where lag > 0)"""

FORECAST_CHAIN = ",".join([FEEDS_SQL, REPAIR, ONE_ORIGIN, STATE, FORECAST, PLAN_AS_OF, BLEND])
BACKTEST_CHAIN = ",".join([FEEDS_SQL, REPAIR, AXIS])
SHIPPED_CHAIN = ",".join([
    FEEDS_SQL, REPAIR.replace("repaired as (", "mended as ("),
    "repaired as (select item_id, region, week, units_shipped as units_unconstrained from ship where (item_id, region) in (select item_id, region from mended))", AXIS,
])
PROJECTION_CHAIN = ",".join([FORECAST_CHAIN, ROWS, USABLE, WOS, RECOVERY, PROJECTION])
TIDY = " union all ".join([scored(NAIVE_PRED, "naive"), scored(STAT_PRED, "statistical"), scored(PLAN_PRED, "plan")])
FVA = f"""{BACKTEST_CHAIN}, {NAIVE}, {STATE}, {FORECAST}, {PLAN_AS_OF},
tidy as ({TIDY}),
by_lag as (select lag, method, sum(abs(actual - pred)) / nullif(sum(abs(actual)), 0) as wmape, sum(pred - actual) / nullif(sum(abs(actual)), 0) as bias from tidy group by all)"""


def pct(x: str) -> str:
    return f"printf('%.0f%%', round_even({x} * 100, 0))"


def signed(x: str) -> str:
    return f"printf('%+.0f%%', round_even({x} * 100, 0))"


def severity(ratio: str) -> str:
    return f"case when {ratio} >= 2 then 'high' when {ratio} >= 1 then 'medium' else 'low' end"


DEVIATION = f"""
with recursive {FORECAST_CHAIN},
d as (
  select *, (sensed - plan) / greatest(1, plan) as dev from (
    select item_id, region, min(week) as week, sum(case when plan_units is not null then p50 end) as sensed, sum(plan_units) as plan from blended group by all)
)
select {severity("abs(dev) / 0.15::double")} as severity, 'Sensed-vs-plan deviation' as alert_type, item_id, region, week,
  'Sensed demand is ' || {signed("dev")} || ' against plan over the horizon, ' || case when dev > 0 then 'above' else 'below' end || ' the 15% threshold.' as message
from d where abs(dev) >= 0.15::double"""

STOCKOUT = f"""
with recursive {PROJECTION_CHAIN},
n as (select *, projected_on_hand / greatest(1, target_position / 4.0::double) as cover from projection where lag between 2 and 3),
f as (select *, row_number() over (partition by item_id, region order by week) as k from n where cover <= 0.15::double)
select 'high' as severity, 'Projected retailer stockout' as alert_type, item_id, region, week,
  'Projected cover falls to ' || printf('%.1f', cover) || ' weeks by the 2-week lead time: stockout risk.' as message
from f where k = 1"""

CLIFF = f"""
with recursive {PROJECTION_CHAIN},
f as (
  select *, row_number() over (partition by item_id, region order by week) as k from projection
  where lag <= 2 and projected_order <= 0.05::double * target_position and projected_on_hand >= 1.30::double * target_position
)
select 'medium' as severity, 'Channel overstock / order-cliff' as alert_type, item_id, region, week,
  'Orders fall to about zero while cover is ' || {pct("case when target_position > 0 then projected_on_hand / target_position else 0 end")} || ' of target: overstocked channel.' as message
from f where k = 1"""

PROMO = f"""
with {FEEDS_SQL}, {REPAIR},
e as (select *, max(week) over (partition by item_id, region) as last from repaired where week <= date '{AS_OF}'),
r as (select *, promo_uplift / greatest(1, base_units) as ratio, row_number() over (partition by item_id, region order by week desc) as k from e where promo_uplift > 0),
s as (
  select item_id, region, count(*) as n, max(case when k = 1 then week end) as week, max(case when k = 1 then last end) as last, max(case when k = 1 then ratio end) as ratio, quantile_cont(case when k > 1 then ratio end, 0.5) as typical
  from r group by all
),
d as (select *, (ratio - typical) / typical as dev from s where n >= 3 and week >= last - 42 and typical > 1e-6)
select {severity("abs(dev) / 0.35::double")} as severity, 'Promo mid-flight variance' as alert_type, item_id, region, week,
  'Promo uplift is ' || {signed("dev")} || ' against what is typical here (' || case when dev > 0 then 'over' else 'under' end || '-performing).' as message
from d where abs(dev) >= 0.35::double"""

CENSORING = f"""
with {FEEDS_SQL}, {REPAIR},
e as (select *, max(week) over (partition by item_id, region) as last from repaired where week <= date '{AS_OF}'),
s as (select item_id, region, count(*) as n, max(week) as week from e where is_censored and week >= last - 56 group by all)
select case when n >= 3 then 'high' else 'medium' end as severity, 'Signal repair / censoring' as alert_type, item_id, region, week,
  n::varchar || ' recent week(s) de-censored before forecasting: verify availability.' as message
from s"""


def by_lag_of(*parts: str) -> str:
    """Accuracy by lag and method over queries of tidy scores, each with tables of its own, scores unrounded."""
    tidy = " union all ".join(f"select * from ({p.replace('round(p.pred, 6)', 'p.pred').replace('round(r.units_unconstrained, 6)', 'r.units_unconstrained')})" for p in parts)
    return f"""
with tidy as ({tidy})
select lag, method, round(sum(abs(actual - pred)) / nullif(sum(abs(actual)), 0), 6) as wmape, round(sum(pred - actual) / nullif(sum(abs(actual)), 0), 6) as bias from tidy group by all"""


FVA_ALL = by_lag_of(
    f"with {BACKTEST_CHAIN}, {NAIVE}, {STATE}, {FORECAST}, {PLAN_AS_OF} {TIDY}",
    f"with recursive {SHIPPED_CHAIN}, {TRANSLATED} {scored(TRANSLATED_PRED, 'translated')}",
)
