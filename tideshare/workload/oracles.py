"""SQL for DuckDB that computes the same results in another way."""

from __future__ import annotations

import math
import re

from tideshare.workload.bindings import ALPHA, BASELINE, COARSE_RATES, CONCENTRATIONS, PRIORITY_BASELINE, RATES, RATIOS, THETA, UNEVEN_RATES



def lag_weights(division: int = 1, tail: float = 0.99, pieces: int = 2000) -> list[float]:
    """Weights per lag by Simpson's rule on the gamma density, up to the first day that holds ``1 - tail`` or less beyond it."""

    def density(x: float) -> float:
        return x ** (ALPHA - 1) * math.exp(-x / THETA) / (math.gamma(ALPHA) * THETA**ALPHA)

    def area(a: float, b: float) -> float:
        h = (b - a) / pieces
        inner = sum((4 if i % 2 else 2) * density(a + i * h) for i in range(1, pieces))
        return (density(a) + inner + density(b)) * h / 3

    days = [area(0, 1)]
    while sum(days) < tail:
        days.append(area(len(days), len(days) + 1))
    steps = [area(m / division, (m + 1) / division) for m in range(len(days) * division)]
    return [x / sum(steps) for x in steps]


W = lag_weights()
# 95 % points of the chi-square distribution by degrees of freedom.
CHI2 = {1: 3.841458820694124, 2: 5.991464547107979, 4: 9.487729036781154, 6: 12.591587243743977, 8: 15.507313055865453}
NAMES = ["click", "error", "purchase", "signup", "view"]

RAW = {
    "segment": "select c_mktsegment as series_id, cast(ts as date) as d, event_type as variant "
               "from events join customer on user_id = c_custkey",
    "listed": "select c_mktsegment as series_id, cast(ts as date) as d, event_type as variant from events "
              "join customer on user_id = c_custkey where event_type in ('click', 'purchase', 'view') and cast(ts as date) between "
              "(select min(cast(ts as date)) from events) + 7 and (select max(cast(ts as date)) from events) - 7",
    "user": "select cast(user_id as varchar) as series_id, cast(ts as date) as d, event_type as variant from events",
    "all": "select 'all' as series_id, cast(ts as date) as d, event_type as variant from events",
    "region": "select r_name as series_id, cast(o_orderdate as date) as d, o_orderpriority as variant "
              "from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey "
              "join region on n_regionkey = r_regionkey",
    "type": "select l_returnflag as series_id, cast(l_shipdate as date) as d, p_type as variant "
            "from lineitem join part on l_partkey = p_partkey",
    "brand": "select l_returnflag as series_id, cast(l_shipdate as date) as d, p_brand as variant "
             "from lineitem join part on l_partkey = p_partkey",
}
EDGE = {
    "day": ("d", "d"),
    "week": ("cast(date_trunc('week', d) as date)", "cast(date_trunc('week', d) as date) + 6"),
    "month": ("cast(date_trunc('month', d) as date)", "last_day(d)"),
}
TEXT_BIN = "series_id, cast(date_from as varchar) as date_from, cast(date_till as varchar) as date_till"


def numbers(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def counts(kind: str, grain: str, p: str = "") -> str:
    """CTEs ending in ``{p}counts``."""
    lo, hi = EDGE[grain]
    return f"""
{p}daily as (select series_id, d, variant, count(*) as n from ({RAW[kind]}) group by all),
{p}span as (select series_id, min(d) as lo, max(d) as hi from {p}daily group by 1),
{p}days as (select series_id, lo, hi, cast(unnest(generate_series(cast(lo as timestamp), cast(hi as timestamp),
  interval 1 day)) as date) as d from {p}span),
{p}day_bin as (select series_id, d, greatest(lo, {lo}) as date_from, least(hi, {hi}) as date_till from {p}days),
{p}bins as (select distinct series_id, date_from, date_till from {p}day_bin),
{p}names as (select distinct series_id, variant from {p}daily),
{p}binned as (select x.series_id, b.date_from, x.variant, sum(x.n) as n from {p}daily x
  join {p}day_bin b on x.series_id = b.series_id and x.d = b.d group by all),
{p}counts as (select b.series_id, b.date_from, b.date_till, v.variant, cast(coalesce(x.n, 0) as bigint) as n
  from {p}bins b join {p}names v on b.series_id = v.series_id
  left join {p}binned x on x.series_id = b.series_id and x.date_from = b.date_from and x.variant = v.variant)"""


def shares(baseline: str) -> str:
    """CTEs ending in ``arr``: model rows (subjects, start shares, entry days) from ``counts``."""
    return f"""
ser as (select series_id, min(date_from) as t_start, max(date_till) as t_end,
  datediff('day', min(date_from), max(date_till)) + 1 as n_days from counts group by 1),
fs as (select series_id, variant, min(date_from) filter (where n > 0) as fd from counts group by all),
totals as (select series_id, date_from, cast(sum(n) as bigint) as total from counts group by all),
ss as (select c.series_id, c.variant, cast(sum(c.n) as double) / sum(t.total) as qt from counts c
  join fs on fs.series_id = c.series_id and fs.variant = c.variant
  join totals t on t.series_id = c.series_id and t.date_from = c.date_from
  where c.date_from >= fd and c.date_from < fd + 7 group by all),
arr as (select ss.series_id, any_value(t_start) as t_start, any_value(n_days) as n_days,
  list(ss.variant order by ss.variant) as subjects, list(qt order by ss.variant) as qt,
  list(datediff('day', t_start, fd) order by ss.variant) as intro
  from ss join fs on fs.series_id = ss.series_id and fs.variant = ss.variant
  join ser on ser.series_id = ss.series_id where ss.variant <> '{baseline}' group by ss.series_id)"""


RATES_SQL = f"""
means as (select c_mktsegment as series_id, event_type as variant, avg(value) as m
  from events join customer on user_id = c_custkey group by all),
rates as (select a.series_id, a.variant, a.m / b.m as k from means a
  join means b on a.series_id = b.series_id and b.variant = '{BASELINE}')"""

SEGMENT_SRC = f"""
src as (select a.series_id, 0 as candidate_id, n_days, intro, qt, subjects, t_start,
  list_transform(subjects, lambda v: list_extract(kl, list_position(vl, v))) as k
  from arr a join (select series_id, list(variant) as vl, list(k) as kl from rates group by 1) r
  on a.series_id = r.series_id)"""


def close(raw: str) -> str:
    return (f"case when list_sum({raw}) > 1 then list_append(list_transform({raw}, lambda x: x / list_sum({raw})), 0.0) "
            f"else list_append({raw}, 1.0 - list_sum({raw})) end")


def model(baseline: str, weights: str = numbers(W), lags: int = len(W), division: int = 1, future: int = 0,
          per_variant: bool = False) -> str:
    """Recursive CTE ``r`` of daily shares from ``src`` (series_id, candidate_id, n_days, k, qt, intro)."""
    pin = "i" if division == 1 else f"((i + 1) // {division})"
    g = "w[j][m]" if per_variant else f"({weights})[m]"
    extra = ", w" if per_variant else ""
    return f"""
r as (
  select series_id, candidate_id, n_days, intro, qt, kk{extra}, 1 as i, q1 as q,
    list_transform(range(1, {lags + 1}), lambda m: q1) as past
  from (select *, {close('raw')} as q1 from (
    select *, list_append(k, 1.0) as kk,
      list_transform(range(1, len(k) + 1), lambda j: case when intro[j] <= 0 then qt[j] else cast(0 as double) end) as raw
    from src))
  union all
  select series_id, candidate_id, n_days, intro, qt, kk{extra}, i + 1, q, list_prepend(q, past)[1:{lags}] from (
    select * exclude (q), {close('raw')} as q from (
      select *, list_transform(range(1, len(qt) + 1),
        lambda j: case when intro[j] = {pin} then qt[j] else nm[j] / tot end) as raw from (
        select *, list_sum(nm) as tot from (
          select *, list_transform(range(1, len(kk) + 1), lambda j: kk[j] * list_sum(list_transform(
            range(1, {lags + 1}), lambda m: {g} * past[m][j]))) as nm
          from r where i < (n_days + {future} - 1) * {division} + 1)))))
, long as (
  select series_id, candidate_id, t_start + cast((i - 1) // {division} as integer) as date, names[j] as variant, q[j] as q, j,
    (i - 1) // {division} + 1 as day
  from (select r.series_id, r.candidate_id, r.i, r.q, s.t_start, list_append(s.subjects, '{baseline}') as names,
      unnest(range(1, len(r.q) + 1)) as j
    from r join (select distinct series_id, t_start, subjects from src) s on r.series_id = s.series_id
    where (r.i - 1) % {division} = 0))"""


LONG_OUT = "select series_id, cast(date as varchar) as date, variant, round(q, 6) as q from long"


def length_rate(scale: int) -> str:
    return (f"src as (select *, 0 as candidate_id, list_transform(subjects, "
            f"lambda v: 1.0 + cast(len(v) as double) / {scale}) as k from arr)")


# --- grid --------------------------------------------------------------------------------

def grid_points(rates, name: str = "k") -> str:
    """Every combination of ``rates`` (values or pairs of them) over the subjects."""
    listed = numbers(rates) if not isinstance(rates[0], tuple) else "[" + ", ".join(numbers(r) for r in rates) + "]"
    return f"""
src as (select a.*, p as candidate_id, list_transform(range(1, len(subjects) + 1), lambda j:
    ({listed})[cast((p // cast(pow({len(rates)}, len(subjects) - j) as bigint)) % {len(rates)} as bigint) + 1]) as {name}
  from (select *, unnest(range(0, cast(pow({len(rates)}, len(subjects)) as bigint))) as p from arr) a)"""


POINT_TERM = "case when n[j] = 0 then 0.0 else n[j] * ln(greatest(q[j], 1e-300)) end"


def grid_fit(division: int = 1, term: str = f"list_sum(list_transform(range(1, len(n) + 1), lambda j: {POINT_TERM}))") -> str:
    """CTEs from the fold ``r`` to the best point and its parameters."""
    return f"""
obs as (select c.series_id, datediff('day', t_start, date_from) + 1 as day,
    list(n order by case when c.variant = '{BASELINE}' then 1 else 0 end, c.variant) as n
  from counts c join ser on c.series_id = ser.series_id group by all),
grid as (select r.series_id, r.candidate_id, sum({term}) as ll
  from r join obs on r.series_id = obs.series_id and r.i = (obs.day - 1) * {division} + 1 group by all),
top as (select series_id, max(ll) as top from grid group by 1),
best as (select g.series_id, min(g.candidate_id) as candidate_id, any_value(g.ll) as ll
  from grid g join top t on g.series_id = t.series_id and g.ll = t.top group by 1),
gp as (select s.series_id, s.candidate_id, subjects[j] as variant, k[j] as k, qt[j] as qt, j
  from (select *, unnest(range(1, len(k) + 1)) as j from src) s)"""


# one bin of the Dirichlet-multinomial with concentration d; categories of share 0 left out
KEPT = "list_filter(range(1, len(n) + 1), lambda j: q[j] > 0)"
DIRICHLET_BIN = f"""case when list_sum(list_transform({KEPT}, lambda j: n[j])) = 0 then 0.0 else
  lgamma(list_sum(list_transform({KEPT}, lambda j: n[j])) + 1) + lgamma(list_sum(list_transform({KEPT}, lambda j: q[j] * d)))
  - lgamma(list_sum(list_transform({KEPT}, lambda j: n[j] + q[j] * d)))
  + list_sum(list_transform({KEPT}, lambda j: lgamma(n[j] + q[j] * d) - lgamma(q[j] * d) - lgamma(n[j] + 1))) end"""

SEGMENTS = f"with recursive {counts('segment', 'day')}, {shares(BASELINE)}"
GRID = f"{SEGMENTS}, {grid_points(RATES)}, {model(BASELINE)}, {grid_fit()}"
BEST_RATES = ("gp.series_id, round(ll, 4) as ll, variant, gp.k from gp join best b on gp.series_id = b.series_id "
              "and gp.candidate_id = b.candidate_id")

def report(grid: str = "grid", top: str = "top", best: str = "best") -> str:
    """CTEs ending in ``est``, the estimates report of a grid fit."""
    return f"""
inside as (select g.series_id, g.candidate_id from {grid} g join {top} t on g.series_id = t.series_id
  where ll >= t.top - {CHI2[1] / 2!r}),
rng as (select gp.series_id, gp.variant, min(k) as k_lb, max(k) as k_ub, min(qt) as qt_lb, max(qt) as qt_ub
  from gp join inside i on gp.series_id = i.series_id and gp.candidate_id = i.candidate_id group by all),
est as (
  select gp.series_id, gp.variant, fd as date, cast(1 as double) as c, cast(1 as double) as c_lb,
    cast(1 as double) as c_ub, gp.k, k_lb, k_ub, gp.qt, qt_lb, qt_ub
  from gp join {best} b on gp.series_id = b.series_id and gp.candidate_id = b.candidate_id
  join rng on rng.series_id = gp.series_id and rng.variant = gp.variant
  join fs on fs.series_id = gp.series_id and fs.variant = gp.variant
  union all
  select ser.series_id, '{BASELINE}', t_start, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1 - s, 1 - s, 1 - s
  from ser join (select fs.series_id, sum(case when fd <= t_start then qt else 0 end) as s from fs
    join ss on ss.series_id = fs.series_id and ss.variant = fs.variant
    join ser on ser.series_id = fs.series_id where fs.variant <> '{BASELINE}' group by 1) x
  on ser.series_id = x.series_id)"""


ESTIMATES = f"{GRID}, {report()}"


def floor3(x: str) -> str:
    return f"floor(({x}) * 1000) / 1000"


CI_LABEL = f"printf('%.3f—%.3f', {floor3('k_lb')}, {floor3('k_ub')})"


def first_label(a: str, places: str) -> str:
    """Labels by first appearance, as a list expression over a list."""
    return (f"list_transform({a}, lambda x: list_position(list_transform(list_filter({places}, "
            f"lambda i: list_position({a}, {a}[i]) = i), lambda i: {a}[i]), x) - 1)")


BLOCKS = f"""
pattern as (select series_id, ['{BASELINE}'] || subjects as names, [cast(1 as double)] || k as ks
  from (select s.* from src s join best b on s.series_id = b.series_id and s.candidate_id = b.candidate_id)),
blk as (select series_id, names[j] as variant, {first_label('ks', 'range(1, len(ks) + 1)')}[j] as block
  from (select *, unnest(range(1, len(ks) + 1)) as j from pattern))"""

GROUPED = ("select *, row_number() over (partition by series_id order by k desc, variant) as place from ("
           f"select series_id, string_agg(variant, ',' order by variant) as variant, {floor3('k')} as k, "
           f"{CI_LABEL} as k_ci_95 from est group by series_id, {floor3('k')}, {CI_LABEL})")

# --- partitions --------------------------------------------------------------------------

LABELS = """
lab as (select o_custkey as series_id, o_orderpriority as variant, count(*) as orders, max(o_orderstatus) as status
  from orders group by all),
item as (select series_id, list(orders order by variant) as o, list(status order by variant) as st,
  list(orders || '/' || status order by variant) as bo from lab group by 1)"""

PARTS = f"""with {LABELS},
part_of as (select series_id, {first_label('o', 'range(1, len(o) + 1)')} as by_orders,
  {first_label('st', 'range(1, len(st) + 1)')} as by_status,
  {first_label('bo', 'range(1, len(bo) + 1)')} as by_both from item)"""


def key(a: str) -> str:
    return f"array_to_string({a}, '-')"


def together(a: str, n: str) -> str:
    """Position pairs that share a block, as text."""
    return (f"flatten(list_transform(range(1, len({a}) + 1), lambda i: list_transform(list_filter("
            f"range(1, len({a}) + 1), lambda j: j > i and {a}[i] = {a}[j]), lambda j: i || ',' || j)))")


def coarser(y: str, x: str) -> str:
    """x's pairs are all pairs of y."""
    return f"list_has_all({together(y, 'y')}, {together(x, 'x')})"


def blocks_text(a: str) -> str:
    return (f"array_to_string(list_transform(range(0, list_max({a}) + 1), lambda v: array_to_string(list_filter("
            f"range(1, len({a}) + 1), lambda i: {a}[i] = v), ',')), '|')")


def all_rgs(n: int) -> str:
    """Every label string of length 1..n as ``rgs(a, n)``."""
    return f"""rgs(a, n) as (select [0]::bigint[], 1 union all
  select list_append(a, x), n + 1 from (select a, n, unnest(range(0, list_max(a) + 2)) as x from rgs where n < {n}))"""


#: Position of a label string ``a`` among those of its series.
PLACE = "row_number() over (partition by series_id order by a) as place"


def merged(a: str) -> str:
    return f"list_transform({a}, lambda x: case when x = t then s when x > t then x - 1 else x end)"


def children(src: str, a: str) -> str:
    return f"""(select *, {merged(a)} as child from (select *, unnest(range(s + 1, list_max({a}) + 1)) as t
  from (select *, unnest(range(0, list_max({a}) + 1)) as s from {src})))"""


USED = "used as (select series_id, count(*) as n from (select distinct o_custkey as series_id, o_orderpriority from orders) group by 1)"

# --- search on the grid -------------------------------------------------------------------

SCORES = f"""{GRID},
pat as (select g.series_id, {first_label('ks', 'range(1, len(ks) + 1)')} as pattern, max(ll) as ll
  from (select g.series_id, ll, [cast(1 as double)] || s.k as ks from grid g
    join src s on g.series_id = s.series_id and g.candidate_id = s.candidate_id) g group by all),
{all_rgs(5)},
cnt as (select series_id, len(subjects) as m from arr),
cand as (select series_id, a, m from cnt join rgs on rgs.n = m + 1),
sc0 as (select c.series_id, c.a, any_value(m) as m, max(p.ll) as ll from cand c join pat p
  on c.series_id = p.series_id and {coarser('p.pattern', 'c.a')} group by all),
sc as (select series_id, len(a) - list_max(a) as level, a, ll, list_max(a) + m as num_pars,
  -2.0 * ll + 2.0 * (list_max(a) + m) as AIC from sc0)"""


def search(width: int, levels: int = 5) -> str:
    """Unrolled levels: children of the survivors, minus those that coarsen a pruned grouping."""
    out = [f"""{SCORES},
l1 as (select *, AIC - 2.0 * list_max(a) as lb, true as chance, AIC as best from sc where level = 1),
p1 as (select series_id, a from l1 where false),
s1 as (select series_id, a, best from l1)"""]
    for i in range(2, levels + 1):
        old = "false" if i == 2 else (
            f"exists (select 1 from p{i - 1} p where p.series_id = c.series_id and {coarser('c.a', 'p.a')})")
        out.append(f"""
c{i} as (select distinct series_id, child as a, best from {children(f's{i - 1}', 'a')}),
k{i} as (select sc.*, c.best as before from c{i} c join sc on sc.series_id = c.series_id and sc.a = c.a where not {old}),
f{i} as (select *, least(min(AIC) over (partition by series_id), before) as best from k{i}),
l{i} as (select * exclude (before, best), AIC - 2.0 * list_max(a) as lb,
  not (AIC - 2.0 * list_max(a) > best + 1e-6) as chance, best from f{i}),
p{i} as (select series_id, a from p{i - 1} union all select series_id, a from l{i} where not chance),
s{i} as (select series_id, a, best from (select *, rank() over (partition by series_id order by AIC) as rk
  from l{i} where chance) where rk <= {width})""")
    parts = " union all ".join(
        f"select series_id, cast(level as bigint) as level, a, ll, num_pars, AIC, lb, chance from l{i}"
        for i in range(1, levels + 1))
    return ",".join(out) + f", ledger as ({parts}), pruned as (select * from p{levels})"


def dirichlet(rows: str, dd: str) -> str:
    """Log-likelihood per series of (series_id, day, n, q) with categories of share 0 left out."""
    return f"""select series_id, sum(case when tot = 0 then 0.0 else lgamma(tot + 1) + lgamma(aa) - lgamma(tot + aa) + t end) as ll
  from (select series_id, day, sum(n) as tot, sum(q * {dd}) as aa,
    sum(case when n = 0 then 0.0 else lgamma(n + q * {dd}) - lgamma(q * {dd}) - lgamma(n + 1) end) as t
    from ({rows}) where q > 0 group by all) group by 1"""


DAILY_CELLS = """select l.series_id, l.day, c.n, l.q from long l join counts c
  on l.series_id = c.series_id and l.date = c.date_from and l.variant = c.variant"""

GAMMA_CDF = (f"case when z <= 0 then 0.0 else least(1.0, list_sum(list_transform(range(0, 200), "
             f"lambda n: exp(({ALPHA} + n) * ln(z) - z - lgamma({ALPHA} + n + 1))))) end")

COLS_LEDGER = ("series_id, level, array_to_string(a, '-') as rgs, sha1(array_to_string(a, '-')) as sha1, "
               "round(ll, 4) as ll, cast(num_pars as bigint) as num_pars, round(AIC, 4) as AIC, "
               "round(lb, 4) as lb_agg_AIC, chance as has_chance")
COLS_SCORE = ("series_id, array_to_string(a, '-') as rgs, round(ll, 4) as ll, "
              "cast(num_pars as bigint) as num_pars, round(AIC, 4) as AIC, cast(level as bigint) as level")

# shares that stay constant: pooled counts, log-likelihood at the pooled shares
CONSTANT = f"""with recursive {counts('segment', 'day')},
p as (select *, sum(n) over (partition by series_id) as total
  from (select series_id, variant, cast(sum(n) as double) as n from counts group by all)),
lls as (select a.series_id, a.ll + b.f - c.f as ll from
  (select series_id, sum(n * ln(n / total)) as ll from p group by 1) a
  join (select series_id, sum(lgamma(t + 1)) as f from (select series_id, date_from, sum(n) as t from counts group by all) group by 1) b
    on a.series_id = b.series_id
  join (select series_id, sum(lgamma(n + 1)) as f from counts group by 1) c on a.series_id = c.series_id)"""


def constant_ends(df: int) -> str:
    """Both ends of the profile interval of each pooled share by bisection, baseline at those points."""
    return f"""
side as (select series_id, variant, n, total, n / total as q, unnest([-1, 1]) as s from p where variant <> '{BASELINE}'),
step as (select *, 0 as i, case when s < 0 then 1e-12 else q end as lo, case when s < 0 then q else 1 - 1e-12 end as hi from side
  union all select series_id, variant, n, total, q, s, i + 1,
    case when (g >= 0) = (s > 0) then mid else lo end, case when (g >= 0) = (s > 0) then hi else mid end
  from (select *, n * ln(mid / q) + (total - n) * ln((1 - mid) / (1 - q)) + {CHI2[df] / 2!r} as g
    from (select *, (lo + hi) / 2 as mid from step where i < 70))),
e as (select *, (lo + hi) / 2 as x from step where i = 70),
both_ends as (select series_id, variant, q, x from e union all
  select e.series_id, b.variant, b.n / b.total, (1 - x) * b.n / (e.total - e.n) from e
  join p b on e.series_id = b.series_id and b.variant = '{BASELINE}')"""


# the best point and the extreme ones of the joint region, with their shares and mean rates
REGION = f"""{GRID}, inside as (select g.* from grid g join top t on g.series_id = t.series_id
        join arr a on a.series_id = g.series_id
        where ll >= t.top - ({numbers(CHI2[2 * n] / 2 for n in (1, 2, 3, 4))})[len(subjects)]),
      ranked as (select gp.series_id, gp.candidate_id,
        row_number() over (partition by gp.series_id, j order by k, ll desc, gp.candidate_id) as low,
        row_number() over (partition by gp.series_id, j order by k desc, ll desc, gp.candidate_id) as high
        from gp join inside i on gp.series_id = i.series_id and gp.candidate_id = i.candidate_id),
      chosen as (select series_id, candidate_id from ranked where low = 1 or high = 1
        union select series_id, candidate_id from best),
      x as (select l.*, case when l.variant = '{BASELINE}' then 1.0 else s.k[l.j] end as kj from long l
        join chosen i on l.series_id = i.series_id and l.candidate_id = i.candidate_id
        join src s on s.series_id = l.series_id and s.candidate_id = l.candidate_id),
      m as (select series_id, candidate_id, date, sum(q * kj) as a from x group by all),
      mb as (select series_id, date, min(a) as lo, max(a) as hi from m group by all)"""

# --- one subject against the baseline: zoom search and halving, in lists ----------------------

PAIR = f"""with {counts('segment', 'day')},
  pair as (select series_id, min(date_from) as t_start, list(n::DOUBLE order by date_from) filter (variant = 'click') as nv,
    list(n::DOUBLE order by date_from) filter (variant = '{BASELINE}') as nb, count(distinct date_from) as t from counts
    where variant in ('click', '{BASELINE}') group by 1),
  con as (select *, list_sum(list_transform(nv, lambda a, i: lgamma(a + nb[i] + 1) - lgamma(a + 1) - lgamma(nb[i] + 1))) as con from pair)"""


def rounds(n: int, start: str, step: str) -> str:
    """``step`` of the list ``c``, ``n`` times from ``start``."""
    return f"list_reduce(list_prepend({start}, list_transform(range({n}), lambda u: []::DOUBLE[])), lambda c, v: {step})"


def pair_days(k: str, q: str, w: str = numbers(W)) -> str:
    """Daily shares of the subject; days before the first count as the first."""
    lag = lambda g: f"list_sum(list_transform({g}, lambda g, m: g * h[greatest(len(h) + 1 - m, 1)]))"
    new = f"list_transform([[{k} * {lag(w)}, 1 - {lag(numbers(W))}]], lambda x: x[1] / (x[1] + x[2]))[1]"
    return (f"list_reduce(list_prepend([{q}], list_transform(range(t - 1), lambda u: []::DOUBLE[])), "
            f"lambda h, v: list_append(h, {new}))")


def pair_ll(k: str, q: str, w: str = numbers(W)) -> str:
    return f"(con + list_sum(list_transform({pair_days(k, q, w)}, lambda p, d: nv[d] * ln(p) + nb[d] * ln(1 - p))))"


#: From [ln k, ln q, width] to the best of 25 points around, again and again; the width halves where the centre wins.
PAIR_OFFSETS = str([[i / 2, j / 2] for i in range(-2, 3) for j in range(-2, 3)]) + "::DOUBLE[][]"
PAIR_TRIED = f"""list_transform({PAIR_OFFSETS}, lambda e: list_transform([[c[1] + c[3] * e[1], least(c[2] + c[3] * e[2], -1e-6)]],
  lambda x: [{pair_ll('exp(x[1])', 'exp(x[2])')}, if(e[1] = 0 and e[2] = 0, 1, 0), x[1], x[2]])[1])"""
PAIR_ZOOM = rounds(80, "[0.0::DOUBLE, ln(0.5), 0.5]", f"""list_transform([list_sort({PAIR_TRIED}, 'DESC')[1]],
  lambda x: [x[3], x[4], if(x[2] = 1, c[3] / 2, c[3])])[1]""")
PAIR_BEST = f"""{PAIR}, z as materialized (select *, {PAIR_ZOOM} as z from con),
  pair_best as materialized (select *, {pair_ll('exp(z[1])', 'exp(z[2])')} as top from z)"""


PAIR_BEST_ALL = PAIR_BEST.replace(counts("segment", "day"), counts("all", "day"))


def pair_inner(place: int) -> str:
    """[ll, other] with parameter ``place`` at ``f`` and the other one zoomed in on, from that of the best point."""
    k, q = ("exp(f)", "exp(y)") if place == 1 else ("exp(y)", "exp(f)")
    tried = (f"list_transform([-1.0, -1 / 3, 0.0, 1 / 3, 1.0]::DOUBLE[], lambda e: list_transform([least(c[2] + c[3] * e, "
             f"{'-1e-9' if place == 1 else '5.0'})], lambda y: [{pair_ll(k, q)}, if(e = 0, 1, 0), y])[1])")
    return rounds(16, f"[0.0::DOUBLE, z[{3 - place}], 0.3]", f"""list_transform([list_sort({tried}, 'DESC')[1]],
      lambda x: [x[1], x[3], if(x[2] = 1, c[3] / 3, c[3])])[1]""")


def pair_ends(half: float) -> str:
    """CTE ``pe`` (series_id, param, side, f, other): bisection of each parameter where the profile falls by ``half``."""
    parts = []
    for place, side, far in ((1, -1, "z[1] - 1"), (1, 1, "z[1] + 1"), (2, -1, "z[2] - 4"), (2, 1, "-1e-7")):
        middle = "(b[1] + b[2]) / 2"
        halving = (f"list_reduce(list_prepend([z[{place}], {far}], list_transform(range(26), lambda u: []::DOUBLE[])), lambda b, o: "
                   f"list_transform([{middle}], lambda f: if({pair_inner(place)}[1] >= top - {half!r}, [f, b[2]], [b[1], f]))[1])")
        parts.append(f"select *, {place - 1} as param, {side} as side, ({halving})[1] as f from pair_best")
    inner = f"case when param = 0 then {pair_inner(1)} else {pair_inner(2)} end"
    return (f"ends as materialized ({' union all '.join(parts)}), "
            f"pe as materialized (select *, {inner} as o from ends)")


# --- concentration of given shares ----------------------------------------------------------

def at_concentration(v: str) -> str:
    """Log-likelihood of the bins ``bins`` [[counts, shares]] of a series at the logarithm ``v``."""
    one = DIRICHLET_BIN.replace("q[j] * d", f"q[j] * exp({v})")
    for name, place in (("n", 1), ("q", 2)):
        one = re.sub(rf"\b{name}(?=\[|\))", f"b[{place}]", one)
    return f"list_sum(list_transform(bins, lambda b: {one}))"


def concentration_sql(source: str, cut: float) -> str:
    """Best concentration by zooming in on its logarithm, ends by halving; ``source`` has (series_id, day, variant, n, q)."""
    low, high = math.log(1e-10), math.log(1e5)
    tried = (f"list_transform([-1.0, -1 / 3, 0.0, 1 / 3, 1.0]::DOUBLE[], lambda e: list_transform([least(greatest(c[2] + c[3] * e, {low!r}), {high!r})], "
             f"lambda y: [{at_concentration('y')}, if(e = 0, 1, 0), y])[1])")
    zoom = rounds(50, "[0.0::DOUBLE, ln(10.0), 3.0]", f"""list_transform([list_sort({tried}, 'DESC')[1]],
      lambda x: [x[1], x[3], if(x[2] = 1, c[3] / 3, c[3])])[1]""")

    def end(far: float) -> str:
        halving = (f"list_reduce(list_prepend([z[2], {far!r}], list_transform(range(45), lambda u: []::DOUBLE[])), lambda b0, o: "
                   f"list_transform([(b0[1] + b0[2]) / 2], lambda f: if({at_concentration('f')} >= top - {cut!r}, [f, b0[2]], [b0[1], f]))[1])[1]")
        return f"case when {at_concentration(repr(far))} >= top - {cut!r} then {far!r} else {halving} end"

    return f"""cells as (select series_id, day, list(n::DOUBLE order by variant) as n, list(q order by variant) as q from ({source}) group by all),
      per as (select series_id, list([n, q]) as bins from cells group by 1),
      dz as materialized (select *, {zoom} as z from per), dt as materialized (select *, {at_concentration('z[2]')} as top from dz)
      select series_id, round(log10(exp(z[2])), 4) as log10_D, round(log10(exp({end(low)})), 4) as log10_D_lb,
        round(log10(exp({end(high)})), 4) as log10_D_ub from dt"""


ORACLES = {
    "daily_counts": f"with {counts('segment', 'day')} select {TEXT_BIN}, variant, n from counts",
    "weekly_counts": f"with {counts('user', 'week')} select {TEXT_BIN}, variant, n from counts",
    "monthly_counts": f"with {counts('region', 'month')} select {TEXT_BIN}, variant, n from counts",
    "day_bins": "select cast(cast(o_orderdate as date) as varchar) as date_from, "
                "cast(cast(o_orderdate as date) as varchar) as date_till, count(*) as total from orders group by all",
    "wide_counts": f"with {counts('segment', 'day')} select {TEXT_BIN}, " + ", ".join(
        f"max(n) filter (where variant = '{v}') as {v}" for v in NAMES) + " from counts group by all",
    "read_write_counts": f"with {counts('all', 'day')} select f as series_id, cast(date_from as varchar) as date_from, "
                         "cast(date_till as varchar) as date_till, variant, n from counts, "
                         "(select unnest(['csv', 'parquet']) as f)",
    "read_write_reports": f"with {counts('all', 'day')}, {shares('')}, "
                          "t as (select variant, cast(sum(n) as double) as s from counts group by 1) "
                          "select 'params' as source, variant, round(qt, 6) as value from ss union all "
                          "select 'estimates', variant, round(qt, 6) from ss union all "
                          "select 'scores', cast(cast(s as bigint) as varchar), round(2.5 * s + 2 * s, 6) from t",
    "variant_violations": "select distinct l_returnflag as series_id, p_brand as variant from lineitem "
                          "join part on l_partkey = p_partkey where p_brand not in (select p_type from part)",
    "window_violations": f"""with d as ({RAW['user']}), t as (select min(d) as lo, max(d) as hi from d),
      s as (select series_id, min(d) = (select lo from t) as has_start, max(d) = (select hi from t) as has_end,
        true as ordered from d group by 1)
      select * from s where not (has_start and has_end)""",
    "bin_width_violations": f"""with {counts('segment', 'week')}, {counts('region', 'month', 'm')},
      u as (select * from counts union all select * from mcounts)
      select series_id, max(datediff('day', date_from, date_till)) as max_width from u group by 1
      having max(datediff('day', date_from, date_till)) >= 7""",
    "block_violations": f"""with {LABELS}, x as (select series_id, list_transform(o, lambda v: v - 1) as a from item),
      y as (select series_id, a, case when len(a) <> 5 then 'length' when list_max(a) > 4 then 'too many blocks'
        when list_min(a) <> 0 then 'lowest label'
        when a[1] <> 0 or len(list_filter(range(2, 6), lambda i: a[i] > 1 + list_max(a[1:i-1]))) > 0 then 'label order'
        end as problem from x)
      select series_id, {key('a')} as rgs, problem from y where problem is not null""",
    "keep_subjects": f"with {counts('segment', 'day')} select {TEXT_BIN}, variant, n from counts "
                     "where variant in ('click', 'purchase')",
    "clip_window": f"""with {counts('user', 'week')}, t as (select series_id, date_from, sum(n) as s from counts group by all)
      select c.series_id, cast(c.date_from as varchar) as date_from, cast(date_till as varchar) as date_till, variant, n
      from counts c join t on c.series_id = t.series_id and c.date_from = t.date_from
      where s > 0 and date_till >= date '2024-01-10' and c.date_from <= date '2024-01-24'""",
    "variant_index": f"""with {counts('brand', 'month')}, idx as (select series_id, variant, row_number() over (
        partition by series_id order by variant = 'Brand#1', variant) as idx from names)
      select c.series_id, cast(date_from as varchar) as date_from, cast(date_till as varchar) as date_till, c.variant, n, idx
      from counts c join idx on c.series_id = idx.series_id and c.variant = idx.variant""",
    "baseline_first_index": f"""with b as ({RAW['brand']}), u as (select distinct series_id, variant from b)
      select series_id, variant, row_number() over (partition by series_id order by variant <> 'Brand#1', variant) - 1 as idx from u""",
    "date_bounds": f"with u as ({RAW['user']}) select series_id, cast(min(d) as varchar) as t_start, "
                   "cast(max(d) as varchar) as t_end from u group by 1",
    "first_seen": f"""with u as ({RAW['user']}), f as (select series_id, variant, min(d) as d from u group by all)
      select series_id, variant, cast(d as varchar) as first_date,
        cast(min(d) over (partition by series_id) as varchar) as assumed_date from f""",
    "bin_totals": f"with {counts('region', 'month')} select {TEXT_BIN}, cast(sum(n) as bigint) as total from counts group by all",
    "observed_share": f"with {counts('region', 'month')} select {TEXT_BIN}, variant, n, "
                      "round(n / nullif(sum(n) over (partition by series_id, date_from), 0), 6) as share from counts",
    "start_share": f"with {counts('user', 'day')}, {shares(BASELINE)} select series_id, variant, round(qt, 6) as qt from ss",
    "first_appearance": """with f as (select user_id as series_id, event_type, min(ts) as m from events group by all)
      select series_id, event_type, row_number() over (partition by series_id order by m, event_type) - 1 as label from f""",
    "log_gamma_values": f"""with {counts('segment', 'day')}, s as (select *, n / sum(n) over (
        partition by series_id, date_from) as share from counts)
      select series_id, cast(date_from as varchar) as date_from, variant, round(lgamma(n + 1), 6) as ln_factorial,
        round(lgamma(share), 6) as ln_gamma from s where n > 0""",
    "day_numbers": f"""with {counts('region', 'month')}, s as (select *, round(n / nullif(sum(n) over (
        partition by series_id, date_from), 0), 6) as k, min(date_from) over (partition by series_id) as t0 from counts)
      select series_id, cast(date_from as varchar) as date_from, variant, datediff('day', t0, date_from) + 1 as day,
        {floor3('k')} as k, printf('%.3f—%.3f', {floor3('0.5 / (n + 1)')}, {floor3('k')}) as label, round(cast(2 * n + 18 as double), 6) as AIC,
        round(cast(2 * n + 10 as double), 6) as bound, cast(4 + 5 + 5 + 1 as bigint) as num_pars from s""",
    "generation_weights": f"""with {RATES_SQL},
      z as (select series_id, variant, m, m / (k * {THETA}) as z from rates, (select unnest(range(0, {len(W) + 1})) as m)),
      f as (select series_id, variant, m, {GAMMA_CDF} as f from z)
      select b.series_id, b.variant, cast(b.m as bigint) as lag, round((b.f - a.f) / l.f, 6) as weight
      from f b join f a on a.series_id = b.series_id and a.variant = b.variant and a.m = b.m - 1
      join f l on l.series_id = b.series_id and l.variant = b.variant and l.m = {len(W)}""",
    "normalised_shares": f"""with {RATES_SQL} select series_id, variant,
      round(k / sum(k) over (partition by series_id), 6) as share from rates""",
    "truncation": f"""with {RATES_SQL},
      z as (select series_id, variant, m, m / (k * {THETA}) as z from rates, (select unnest(range(1, 100)) as m)),
      y as (select series_id, variant, m, m / (k * {20 * THETA}) as z from rates, (select unnest(range(1, 2000)) as m)),
      a as (select series_id, variant, cast(min(m) as bigint) as days from z where {GAMMA_CDF} >= 0.99 group by all),
      b as (select series_id, variant, cast(min(m) as bigint) as long_days from y where z < 40 and {GAMMA_CDF} >= 0.99 group by all)
      select * from a join b using (series_id, variant)""",
    "labels_to_partition": f"""{PARTS} select series_id, {key('by_orders')} as rgs_key, sha1({key('by_orders')}) as sha1,
      true as ok, cast(list_max(by_orders) as bigint) as blocks from part_of""",
    "labels_to_long": f"""with {LABELS}, f as (select series_id, orders, min(variant) as v from lab group by all),
      l as (select series_id, orders, row_number() over (partition by series_id order by v) - 1 as label from f)
      select lab.series_id, variant, label from lab join l on lab.series_id = l.series_id and lab.orders = l.orders""",
    "partition_predicates": f"""{PARTS} select series_id, true as both_is_rgs, false as flipped_is_rgs,
      true as orders_coarser, {coarser('by_orders', 'by_status')} as orders_coarser_than_status,
      {coarser('by_orders', 'by_status')} as status_finer_than_orders, true as status_is_partition,
      len(by_status) = 5 as covers_five,
      list_max(by_status) <= list_max(by_orders) as labels_subset from part_of""",
    "partition_blocks": f"""{PARTS} select series_id, {blocks_text('by_both')} as blocks, {blocks_text('by_both')} as sorted_blocks,
      {key('range(1, len(by_both) + 1)')} as elements, {key('by_both')} as rgs, {key('by_both')} as parsed from part_of""",
    "merge_once": f"""{PARTS}, x as (select series_id, by_both as rgs from part_of)
      select series_id, {key('rgs')} as rgs, s, t, {key('child')} as child, {blocks_text('child')} as blocks
      from {children('x', 'rgs')}""",
    "all_coarsenings": PARTS.replace("with ", "with recursive ", 1) + f""", {all_rgs(5)},
      d as (select by_both as x, count(*) as customers from part_of group by 1)
      select {key('a')} as coarser, cast(sum(customers) as bigint) as customers, count(*) as finer
      from d join rgs on rgs.n = len(x) and {coarser('a', 'x')} group by 1""",
    "common_children": f"""{PARTS}, e as (select * from part_of where list_max(by_orders) = list_max(by_status)),
      x as (select distinct series_id, {key('child')} as child from {children('(select series_id, by_orders as v from e)', 'v')}),
      y as (select distinct series_id, {key('child')} as child from {children('(select series_id, by_status as v from e)', 'v')})
      select * from x intersect select * from y""",
    "finest_common": PARTS.replace("with ", "with recursive ", 1) + f""",
      el as (select series_id, i, by_orders[i] as a, by_status[i] as b from
        (select *, unnest(range(1, len(by_orders) + 1)) as i from part_of)),
      edge as (select x.series_id, x.i, y.i as j from el x join el y on x.series_id = y.series_id and (x.a = y.a or x.b = y.b)),
      reach as (select series_id, i, i as j from el union
        select r.series_id, r.i, e.j from reach r join edge e on r.series_id = e.series_id and r.j = e.i),
      root as (select series_id, i, min(j) as m from reach group by all),
      lbl as (select series_id, i, dense_rank() over (partition by series_id order by m) - 1 as l from root)
      select series_id, string_agg(l, '-' order by i) as rgs from lbl group by 1""",
    "finest_common_long": """with recursive el as (select o_custkey as series_id, o_orderpriority as pos, count(*) as a,
        max(o_orderstatus) as b, count(*) > 2 as c from orders group by all),
      edge as (select x.series_id, x.pos as i, y.pos as j from el x join el y
        on x.series_id = y.series_id and (x.a = y.a or x.b = y.b or x.c = y.c)),
      reach as (select series_id, pos as i, pos as j from el union
        select r.series_id, r.i, e.j from reach r join edge e on r.series_id = e.series_id and r.j = e.i),
      root as (select series_id, i, min(j) as m from reach group by all)
      select series_id, i as pos, cast(dense_rank() over (partition by series_id order by m) - 1 as int) as block from root""",
    "enumerate_all": f"with recursive {all_rgs(5)}, {USED} select series_id, used.n, {key('a')} as rgs, {PLACE} from used join rgs on rgs.n = used.n",
    "enumerate_at_most": f"with recursive {all_rgs(5)}, {USED} select series_id, used.n, {key('a')} as rgs, {PLACE} from used "
                         "join rgs on rgs.n = used.n where list_max(a) <= 2",
    "enumerate_exactly": f"with recursive {all_rgs(5)}, {USED} select series_id, used.n, {key('a')} as rgs, {PLACE} from used "
                         "join rgs on rgs.n = used.n where list_max(a) = 1",
    "enumerate_reverse": f"with recursive {all_rgs(5)}, {USED}, c as (select n, count(*) as customers from used group by 1) "
                         f"select c.n, customers, {key('a')} as rgs, row_number() over (partition by c.n order by a desc) as place "
                         "from c join rgs on rgs.n = c.n",
    "drop_dominated": f"""{PARTS}, x as (select series_id, by_both as v, by_orders from part_of),
      c as (select distinct series_id, by_orders, child from {children('x', 'v')})
      select series_id, {key('child')} as rgs from c where not {coarser('child', 'by_orders')}""",
    "trajectory": f"with recursive {counts('segment', 'day')}, {shares(BASELINE)}, {RATES_SQL}, {SEGMENT_SRC}, {model(BASELINE)} {LONG_OUT}",
    "trajectory_late": f"with recursive {counts('user', 'day')}, {shares(BASELINE)}, {length_rate(100)}, {model(BASELINE)} {LONG_OUT}",
    "trajectory_substep": f"with recursive {counts('user', 'day')}, {shares(BASELINE)}, {length_rate(100)}, "
                          f"{model(BASELINE, numbers(lag_weights(4)), 4 * len(W), 4)} {LONG_OUT}",
    "trajectory_time_scale": f"""with recursive {counts('segment', 'day')}, {shares(BASELINE)}, {RATES_SQL},
      {SEGMENT_SRC.replace('src as', 'src0 as', 1)},
      zz as (select series_id, j, m, m / (case when j <= len(k) then sqrt(k[j]) else 1.0 end * {THETA}) as z from
        (select *, unnest(range(1, len(k) + 2)) as j from src0), (select unnest(range(0, {len(W) + 1})) as m)),
      cdf as (select series_id, j, list({GAMMA_CDF} order by m) as f from zz group by all),
      ww as (select series_id, list(list_transform(range(1, {len(W) + 1}), lambda m: (f[m + 1] - f[m]) / f[{len(W) + 1}]) order by j) as w
        from cdf group by 1),
      src as (select src0.*, w from src0 join ww on src0.series_id = ww.series_id),
      {model(BASELINE, per_variant=True)} {LONG_OUT}""",
    "forecast": f"""with recursive {counts('segment', 'day')}, {shares(BASELINE)}, {RATES_SQL}, {SEGMENT_SRC}, {model(BASELINE, future=14)},
      m as (select l.series_id, date, sum(q) as c, sum(q * case when l.variant = '{BASELINE}' then 1 else r.k end) as k
        from long l join rates r on l.series_id = r.series_id and l.variant = r.variant group by all)
      select l.series_id, cast(l.date as varchar) as date, variant, round(q, 6) as q, round(c, 6) as average_c,
        round(k, 6) as average_k from long l join m on l.series_id = m.series_id and l.date = m.date""",
    "population_mean": f"""with recursive {counts('segment', 'day')}, {shares(BASELINE)}, {RATES_SQL}, {SEGMENT_SRC}, {model(BASELINE)}
      select l.series_id, cast(date as varchar) as date, round(sum(q), 6) as average_c,
        round(sum(q * case when l.variant = '{BASELINE}' then 1 else r.k end), 6) as average_k
      from long l join rates r on l.series_id = r.series_id and l.variant = r.variant group by all""",
    "scenario_trajectory": f"""with recursive {counts('user', 'day')}, {shares(BASELINE)},
      src as (select * exclude (n_days), datediff('day', t_start, (select max(cast(ts as date)) from events)) + 1 as n_days, 0 as candidate_id,
        list_transform(subjects, lambda v: 1.0 + cast(len(v) as double) / 100) as k from arr), {model(BASELINE)}
      select series_id, cast(date as varchar) as date, variant, round(q, 6) as q, round(1000 * q, 6) as expected from long""",
    "bin_share": f"""with recursive {counts('region', 'month')}, {shares(PRIORITY_BASELINE)}, {length_rate(10000)}, {model(PRIORITY_BASELINE)}
      select c.series_id, cast(date_from as varchar) as date_from, cast(date_till as varchar) as date_till, c.variant, c.n,
        round(greatest(0, avg(q)), 6) as p
      from counts c join long l on c.series_id = l.series_id and c.variant = l.variant and l.date between date_from and date_till
      group by all""",
    "lag_sum": f"""with {counts('all', 'day')}, s as (select series_id, date_from as date, variant,
        n / sum(n) over (partition by date_from) as q, min(date_from) over () as d0 from counts),
      g as (select unnest(range(1, {len(W) + 1})) as m), x as (select a.series_id, a.date, a.variant,
        sum(1.05 * ({numbers(W)})[m] * b.q) as num from s a, g, s b
        where b.variant = a.variant and b.date = greatest(a.d0, a.date - cast(m as integer)) group by all)
      select series_id, cast(date as varchar) as date, variant, round(num, 6) as num,
        round(sum(num) over (partition by date), 6) as total from x""",
    "lag_sum_gaps": f"""with {counts('all', 'day')}, s as (select series_id, date_from as date, variant,
        n / sum(n) over (partition by date_from) as q, min(date_from) over () as d0 from counts where dayofweek(date_from) not in (0, 3)),
      g as (select unnest(range(1, {len(W) + 1})) as m), x as (select a.series_id, a.date, a.variant,
        sum(1.05 * ({numbers(W)})[m] * coalesce(b.q, 0)) as num from s a cross join g left join s b
        on b.variant = a.variant and b.date = greatest(a.d0, a.date - cast(m as integer)) group by all)
      select series_id, cast(date as varchar) as date, variant, round(num, 6) as num,
        round(sum(num) over (partition by date), 6) as total from x""",
    "chart_table": f"""with recursive {counts('segment', 'day')}, {shares(BASELINE)}, {RATES_SQL}, {SEGMENT_SRC}, {model(BASELINE)}
      select l.series_id, cast(date as varchar) as date, l.variant, round(n / nullif(t.total, 0), 6) as observed, round(q, 6) as fitted
      from long l join counts c on l.series_id = c.series_id and l.date = c.date_from and l.variant = c.variant
      join totals t on t.series_id = c.series_id and t.date_from = c.date_from""",
    "loglik_multinomial": f"""with recursive {counts('segment', 'week')}, {shares(BASELINE)}, {length_rate(1000)}, {model(BASELINE)},
      p as (select c.series_id, c.date_from, c.variant, c.n, greatest(0, avg(q)) as p from counts c join long l
        on c.series_id = l.series_id and c.variant = l.variant and l.date between date_from and date_till group by all),
      t as (select series_id, sum(case when n = 0 then 0 else n * ln(p) end) as ll from p group by 1),
      f as (select series_id, sum(lgamma(total + 1)) as a from totals group by 1),
      h as (select series_id, sum(lgamma(n + 1)) as b from counts group by 1)
      select t.series_id, round(ll + a - b, 4) as ll, round(a - b, 4) as ln_coef, round(ll, 4) as ll_terms
      from t join f on t.series_id = f.series_id join h on t.series_id = h.series_id""",
    "loglik_dirichlet": f"""with recursive {counts('segment', 'day')}, {shares(BASELINE)}, {length_rate(1000)}, {model(BASELINE)}
      select series_id, cast(10 as double) as D, round(ll, 4) as ll from ({dirichlet(DAILY_CELLS, '10.0')}) union all
      select series_id, cast(200 as double), round(ll, 4) from ({dirichlet(DAILY_CELLS, '200.0')})""",
    "loglik_dirichlet_terms": f"""with recursive {counts('segment', 'week')}, {shares(BASELINE)}, {length_rate(1000)}, {model(BASELINE)},
      p as (select c.series_id, c.date_from as day, c.variant, c.n, greatest(0, avg(q)) as q from counts c join long l
        on c.series_id = l.series_id and c.variant = l.variant and l.date between date_from and date_till group by all)
      select series_id, round(ll, 4) as ll, round(ll, 4) as ll_terms from ({dirichlet('select * from p', '50.0')})""",
    "loglik_zero_probability": f"""with recursive {counts('user', 'day')}, {shares(BASELINE)},
      src as (select series_id, 0 as candidate_id, n_days, t_start, subjects,
        list_transform(subjects, lambda v: 0) as intro, list_transform(subjects, lambda v: cast(1 as double)) as k,
        list_transform(subjects, lambda v: case when v = 'signup' then cast(0 as double) else 0.2 end) as qt from arr),
      {model(BASELINE)}, x as ({dirichlet(DAILY_CELLS, '10.0')}),
      y as (select series_id, max(n) filter (where variant = 'signup') > 0 as impossible from counts group by 1)
      select x.series_id, coalesce(impossible, false) as impossible, round(ll, 4) as ll_dirichlet
      from x join y on x.series_id = y.series_id""",
    "fit_grid": f"{GRID} select {BEST_RATES}",
    "fit_grid_window": f"""with recursive {counts('listed', 'day')}, {shares(BASELINE)}, {grid_points(RATES)}, {model(BASELINE)}, {grid_fit()}
      select {BEST_RATES}""",
    "fit_grid_substep": f"""{SEGMENTS}, {grid_points(COARSE_RATES)},
      {model(BASELINE, numbers(lag_weights(2)), 2 * len(W), 2)}, {grid_fit(2)} select {BEST_RATES}""",
    "fit_grid_time_scale": f"""{SEGMENTS}, {grid_points(COARSE_RATES).replace('src as', 'src0 as', 1)},
      ratio as (select unnest({numbers(RATIOS)}) as c, unnest(range(0, {len(RATIOS)})) as place),
      ww as (select c, place, list_transform(range(1, {len(W) + 1}), lambda m: (f[m + 1] - f[m]) / f[{len(W) + 1}]) as w
        from (select c, place, list({GAMMA_CDF} order by m) as f from
          (select c, place, m, m / (c * {THETA}) as z from ratio, (select unnest(range(0, {len(W) + 1})) as m)) group by all)),
      one as (select w as w1 from ww where c = 1.0),
      src as (select src0.* replace (candidate_id * {len(RATIOS)} + place as candidate_id), c,
        list_append(list_transform(subjects, lambda v: w), w1) as w from src0, ww, one),
      {model(BASELINE, per_variant=True)}, {grid_fit()}
      select s.c, {BEST_RATES} join src s on s.series_id = b.series_id and s.candidate_id = b.candidate_id""",
    "fit_grid_scales": f"""with recursive {counts('listed', 'day')}, {shares(BASELINE)}, {grid_points([(k, c) for k in UNEVEN_RATES for c in RATIOS], 'k0').replace('src as', 'src0 as', 1)},
      ratio as (select unnest({numbers(RATIOS)}) as c),
      ww as (select c, list_transform(range(1, {len(W) + 1}), lambda m: (f[m + 1] - f[m]) / f[{len(W) + 1}]) as w
        from (select c, list({GAMMA_CDF} order by m) as f from
          (select c, m, m / (c * {THETA}) as z from ratio, (select unnest(range(0, {len(W) + 1})) as m)) group by all)),
      wl as (select list(c order by c) as cl, list(w order by c) as wl from ww),
      src as (select src0.* exclude (k0), list_transform(k0, lambda x: x[1]) as k, list_transform(k0, lambda x: x[2]) as c,
        list_append(list_transform(k0, lambda x: wl[list_position(cl, x[2])]), wl[list_position(cl, 1.0)]) as w from src0, wl),
      {model(BASELINE, per_variant=True)}, {grid_fit()}
      select s.c[gp.j] as c, {BEST_RATES} join src s on s.series_id = b.series_id and s.candidate_id = b.candidate_id""",
    "fit_grid_dirichlet": f"""{SEGMENTS}, {grid_points(COARSE_RATES).replace('src as', 'src0 as', 1)},
      src as (select * replace (candidate_id * {len(CONCENTRATIONS)} + place as candidate_id), d from src0,
        (select unnest({numbers(CONCENTRATIONS)}) as d, unnest(range(0, {len(CONCENTRATIONS)})) as place)),
      {model(BASELINE).replace('qt, kk,', 'qt, d, kk,')}, {grid_fit(term=DIRICHLET_BIN)}
      select s.d as "D", {BEST_RATES} join src s on s.series_id = b.series_id and s.candidate_id = b.candidate_id""",
    "grid_loglik": f"{GRID} select series_id, candidate_id, round(ll, 4) as ll from grid",
    "profile_ci_grid": f"{ESTIMATES} select series_id, variant, k_lb, k_ub from rng",
    "region_bands_grid": f"""{REGION}
      select x.series_id, cast(x.date as varchar) as date, variant, round(min(q), 6) as q_lb, round(max(q), 6) as q_ub,
        round(any_value(lo), 6) as average_k_lb, round(any_value(hi), 6) as average_k_ub
      from x join mb on x.series_id = mb.series_id and x.date = mb.date group by all""",
    "frequency_report_bounds": f"""{REGION},
      band as (select series_id, date, variant, min(q) as lo, max(q) as hi from x group by all)
      select l.series_id, cast(l.date as varchar) as date, """ + ", ".join(
        f"round(max(l.q) filter (where l.variant = '{v}'), 6) as {v}, round(max(band.lo) filter (where l.variant = '{v}'), 6) as {v}_lb, "
        f"round(max(band.hi) filter (where l.variant = '{v}'), 6) as {v}_ub" for v in NAMES) + f""",
      cast(1 as double) as average_c, cast(1 as double) as average_c_lb, cast(1 as double) as average_c_ub,
      round(sum(l.q * case when l.variant = '{BASELINE}' then 1.0 else s.k[l.j] end), 6) as average_k,
      round(any_value(mb.lo), 6) as average_k_lb, round(any_value(mb.hi), 6) as average_k_ub
      from long l join best b on l.series_id = b.series_id and l.candidate_id = b.candidate_id
      join src s on s.series_id = l.series_id and s.candidate_id = l.candidate_id
      join band on band.series_id = l.series_id and band.date = l.date and band.variant = l.variant
      join mb on mb.series_id = l.series_id and mb.date = l.date group by l.series_id, l.date""",
    "baseline_range_grid": f"""with {counts('user', 'week')}, t as (select series_id, date_from, sum(n) as s, from counts group by all),
      f as (select series_id, variant, min(date_from) filter (where n > 0) as fd from counts group by all),
      b as (select series_id, min(date_from) as t0 from counts group by 1),
      p as (select c.series_id, c.date_from, 1 - sum(case when fd <= t0 then n / s else 0 end) as q from counts c
        join t on t.series_id = c.series_id and t.date_from = c.date_from
        join f on f.series_id = c.series_id and f.variant = c.variant join b on b.series_id = c.series_id
        where s > 0 and c.variant <> '{BASELINE}' group by all)
      select series_id, round(min(q), 6) as qt_lb, round(max(q), 6) as qt_ub from p group by 1""",
    "blocks_report": f"{GRID}, {BLOCKS} select series_id, variant, cast(block as bigint) as block from blk",
    "warm_start": f"""{GRID}, {BLOCKS}, {RATES_SQL} select blk.series_id, cast(block as bigint) as block, round(avg(k), 6) as k
      from blk join rates on blk.series_id = rates.series_id and blk.variant = rates.variant where block > 0 group by all""",
    "shared_rates": f"""{GRID}, {BLOCKS}, {RATES_SQL} select blk.series_id, blk.variant, cast(block as bigint) as block,
      round(case when block = 0 then 1 else avg(k) over (partition by blk.series_id, block) end, 6) as k
      from blk join rates on blk.series_id = rates.series_id and blk.variant = rates.variant""",
    "estimates_report": f"{ESTIMATES} select series_id, variant, cast(date as varchar) as date, c, c_lb, c_ub, k, k_lb, k_ub, "
                        "round(qt, 6) as qt, round(qt_lb, 6) as qt_lb, round(qt_ub, 6) as qt_ub from est",
    "group_report": f"{ESTIMATES} {GROUPED}",
    "rate_report": f"{ESTIMATES} select series_id, variant, {floor3('k')} as k, {CI_LABEL} as k_ci_95, "
                   "row_number() over (partition by series_id order by est.k desc, variant) as place from est",
    "order_by_rate": f"with {RATES_SQL} select series_id || ':' || variant as variant, round(k, 6) as k, "
                     "row_number() over (partition by series_id order by round(rates.k, 6) desc, rates.variant) as place from rates",
    "score_report": f"""{GRID} select b.series_id, round(ll, 4) as maxll, cast(2 * len(subjects) as bigint) as num_pars,
      round(-2 * ll + 4 * len(subjects), 4) as AIC from best b join arr on b.series_id = arr.series_id""",
    "frequency_report": f"""{GRID} select l.series_id, cast(date as varchar) as date, """ + ", ".join(
        f"round(max(q) filter (where variant = '{v}'), 6) as {v}" for v in NAMES) + f""",
      round(sum(q), 6) as average_c, round(sum(q * case when variant = '{BASELINE}' then 1.0 else s.k[l.j] end), 6) as average_k
      from long l join best b on l.series_id = b.series_id and l.candidate_id = b.candidate_id
      join src s on s.series_id = l.series_id and s.candidate_id = l.candidate_id group by all""",
    "partition_scores": f"{SCORES} select {COLS_SCORE} from sc",
    "beam": f"""{SCORES} select {COLS_SCORE} from (select *, rank() over (partition by series_id, level order by AIC) as rk from sc)
      where rk <= 2""",
    "running_best": f"""{SCORES} select series_id, cast(level as bigint) as level, rgs, round(AIC, 4) as AIC, round(min(AIC) over (
        partition by series_id order by level, rgs rows between unbounded preceding and 1 preceding), 4) as best_before
      from (select *, {key('a')} as rgs from sc)""",
    "best_partition": f"""{SCORES} select series_id, rgs, round(AIC, 4) as AIC, round(AIC, 4) as best_AIC from (select *, {key('a')} as rgs,
      row_number() over (partition by series_id order by AIC, {key('a')}) as rn from sc) where rn = 1""",
    "search_grid": f"{search(1)} select {COLS_LEDGER} from ledger",
    "pruned_grid": f"{search(2)} select series_id, {key('a')} as rgs from pruned",
    "level_summary": f"{search(2)} select series_id, level, count(*) as analysed, count(*) filter (where chance) as with_chance "
                     "from ledger group by all",
    "search_stored": f"{search(2)} select {COLS_LEDGER} from ledger",
    "refit_report": f"""{search(1)},
      chosen as (select series_id, a from (select *, row_number() over (partition by series_id order by AIC, {key('a')}) as rn
        from ledger) where rn = 1),
      grid2 as (select g.* from grid g join src s on g.series_id = s.series_id and g.candidate_id = s.candidate_id
        join chosen c on c.series_id = g.series_id where not list_contains(list_transform(range(1, len(a) + 1),
          lambda j: ([cast(1 as double)] || k)[j] = ([cast(1 as double)] || k)[list_position(a, a[j])]), false)),
      top2 as (select series_id, max(ll) as top from grid2 group by 1),
      best2 as (select g.series_id, min(g.candidate_id) as candidate_id from grid2 g
        join top2 t on g.series_id = t.series_id and g.ll = t.top group by 1),
      {report('grid2', 'top2', 'best2')} {GROUPED}""",
    "pending_candidates": f"""{PARTS} select series_id, 'run' as config_hash, sha1({key('by_orders')}) as sha1, {key('by_orders')} as rgs
      from part_of where {key('by_orders')} <> {key('by_status')}""",
    "fit_constant": f"""{CONSTANT}
      select p.series_id, variant, cast(1 as double) as k, round(n / total, 4) as qt, round(ll, 4) as maxll,
        (select count(*) - 1 from p x where x.series_id = p.series_id) as num_pars,
        round(-2 * ll + 2 * (select count(*) - 1 from p x where x.series_id = p.series_id), 4) as AIC
      from p join lls on p.series_id = lls.series_id where variant <> '{BASELINE}'""",
    "profile_ci_constant": f"""{CONSTANT}, {constant_ends(1)}
      select series_id, variant, round(any_value(q), 4) as qt, round(min(x), 4) as qt_lb, round(max(x), 4) as qt_ub
      from both_ends group by all""",
    "region_bands_constant": f"""{CONSTANT}, {constant_ends(4)},
      r as (select series_id, variant, min(x) as lo, max(x) as hi from both_ends group by all),
      cal as (select series_id, cast(unnest(generate_series(cast(min(date_from) as timestamp),
        cast(max(date_till) as timestamp) + interval 3 day, interval 1 day)) as date) as d from counts group by 1)
      select cal.series_id, cast(d as varchar) as date, variant, round(lo, 4) as q_lb, round(hi, 4) as q_ub,
        cast(1 as double) as average_k_lb, cast(1 as double) as average_k_ub
      from cal join r on cal.series_id = r.series_id""",
    "fit_pair": f"""{PAIR_BEST} select series_id, round(exp(z[1]), 4) as k, round(exp(z[2]), 4) as qt, round(top, 4) as maxll,
      cast(2 as bigint) as num_pars, round(-2 * top + 4, 4) as AIC, true as converged from pair_best""",
    "profile_ci_pair": f"""{PAIR_BEST_ALL}, {pair_ends(CHI2[1] / 2)} select series_id, cast(param as int) as param, cast(side as int) as side,
      round(exp(f), 3) as value, round(o[1], 3) as ll from pe""",
    "region_bands_pair": f"""{PAIR_BEST_ALL}, {pair_ends(CHI2[2] / 2)},
      sol as (select series_id, t_start, t, exp(z[1]) as k, exp(z[2]) as q from pair_best union all
        select series_id, t_start, t, exp(if(param = 0, f, o[2])), exp(if(param = 0, o[2], f)) from pe),
      path as (select series_id, t_start, unnest({pair_days('k', 'q')}) as q, unnest(range(t)) as i from sol),
      shown as (select series_id, t_start, i, 'click' as variant, q from path union all select series_id, t_start, i, '{BASELINE}', 1 - q from path)
      select series_id, cast(t_start + cast(i as int) as varchar) as date, variant, round(min(q), 3) as q_lb, round(max(q), 3) as q_ub
      from shown group by series_id, t_start, i, variant""",
    "dirichlet_report": f"""with recursive {counts('segment', 'week')}, {shares(BASELINE)}, {length_rate(100)}, {model(BASELINE)},
      p as (select c.series_id, c.date_from as day, c.variant, c.n, greatest(0, avg(q)) as q from counts c join long l
        on c.series_id = l.series_id and c.variant = l.variant and l.date between date_from and date_till group by all),
      {concentration_sql('select * from p', CHI2[1] / 2)}""",
}
