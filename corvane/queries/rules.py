"""Rule classification, votes and context over parts and order lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from corvane.operators import rules as R
from corvane.plans.grains import read, retail
from corvane.plans.storage import dealt

from .base import query

RULES = [
    R.Rule("steel", "metal", "steel", {"token": ("p_type", "economy")}),
    R.Rule("brass", "metal", "brass", {"all": [{"contains": ("p_type", "SMALL")}, {"below": ("p_size", 40)}]}, "name"),
    R.Rule("any_metal", "metal", "other", {"regex": ("p_type", "(MEDIUM|PROMO)$")}, "inferred"),
    R.Rule("plain", "metal", "none", {"present": "p_type"}, "default"),
    R.Rule("small", "size", "small", {"below": ("p_size", 15)}),
    R.Rule("large", "size", "large", {"count": {"of": [{"above": ("p_size", 35)}, {"is": ("metal", "steel")}, {"prefix": ("p_brand", "brand#1")}], "least": 2}}, "inferred"),
]
_METAL = "case when list_contains(regexp_split_to_array(lower(p_type), '[^a-z0-9#]+'), 'economy') then 'steel' when contains(lower(p_type), 'small') and p_size < 40 then 'brass' when regexp_matches(p_type, '(MEDIUM|PROMO)$') then 'other' when p_type is not null then 'none' end"
_METAL_RULE = "case when list_contains(regexp_split_to_array(lower(p_type), '[^a-z0-9#]+'), 'economy') then 'steel' when contains(lower(p_type), 'small') and p_size < 40 then 'brass' when regexp_matches(p_type, '(MEDIUM|PROMO)$') then 'any_metal' when p_type is not null then 'plain' end"
_SIZE = "case when p_size < 15 then 'small' when (p_size > 35)::int + (metal = 'steel')::int + starts_with(lower(p_brand), 'brand#1')::int >= 2 then 'large' end"
_PARTS = f"p as (select *, {_METAL} as metal, {_METAL_RULE} as rule from part), c as (select *, {_SIZE} as size from p)"


def _classified(spark, d, rules=RULES, pins=None):
    return R.classify(read(spark, d, "part"), rules, pins)


@query("cls_1_predicates", "select p_partkey from part where (contains(lower(p_type), 'st') and not (p_size = 7)) or starts_with(lower(p_brand), 'brand#5')")
def predicates(spark, d):
    return read(spark, d, "part").filter(R.predicate({"any": [{"all": [{"contains": ("p_type", "ST")}, {"not": {"equals": ("p_size", 7)}}]}, {"prefix": ("p_brand", "Brand#5")}]})).select("p_partkey")


@query("cls_2_ordered_rules_3_basis", f"with {_PARTS} select p_partkey, metal, rule, case rule when 'steel' then 0.95 when 'brass' then 0.8 when 'any_metal' then 0.6 else 0.3 end::double as confidence, case rule when 'steel' then 'header' when 'brass' then 'name' when 'any_metal' then 'inferred' else 'default' end as basis, size from c")
def ordered_rules(spark, d):
    return _classified(spark, d).select("p_partkey", F.col("metal.value").alias("metal"), "metal.rule", "metal.confidence", "metal.basis", F.col("size.value").alias("size"))


#: A hundred rules of three predicates each over eight axes.
_MANY = [(f"r{n}", f"axis{n % 8}", n * 7 % 49, n * 13 % 97, "ANR"[n % 3]) for n in range(100)]


def _many_sql(axis: int) -> str:
    whens = [f"when l_quantity > {low} and l_suppkey < {high} and l_returnflag = '{flag}' then '{name}'" for name, own, low, high, flag in _MANY if own == f"axis{axis}"]
    return f"case {' '.join(whens)} end as axis{axis}"


@query("cls_2_many_rules", f"select l_orderkey, l_linenumber, {', '.join(_many_sql(i) for i in range(8))} from lineitem")
def many_rules(spark, d):
    rules_ = [R.Rule(name, axis, name, {"all": [{"above": ("l_quantity", low)}, {"below": ("l_suppkey", high)}, {"equals": ("l_returnflag", flag)}]}) for name, axis, low, high, flag in _MANY]
    return R.classify(read(spark, d, "lineitem"), rules_).select("l_orderkey", "l_linenumber", *[F.col(f"axis{i}.value").alias(f"axis{i}") for i in range(8)])


@query("cls_4_votes", "select p_partkey, unnest([x for x in [case when list_contains(regexp_split_to_array(lower(p_type), '[^a-z0-9#]+'), 'economy') then 'steel' end, case when contains(lower(p_type), 'small') and p_size < 40 then 'brass' end, case when regexp_matches(p_type, '(MEDIUM|PROMO)$') then 'any_metal' end, case when p_type is not null then 'plain' end] if x is not null]) as rule from part")
def votes(spark, d):
    return R.votes(read(spark, d, "part"), "p_partkey", [r for r in RULES if r.axis == "metal"]).select("p_partkey", "rule")


@query("cls_5_pins", f"with q as (select *, case when p_partkey % 10 = 0 then 'steel' else {_METAL} end as metal from part) select p_partkey, metal, {_SIZE} as size from q")
def pins(spark, d):
    return _classified(spark, d, pins={"metal": F.when(F.col("p_partkey") % 10 == 0, "steel")}).select("p_partkey", F.col("metal.value").alias("metal"), F.col("size.value").alias("size"))


@query("cls_6_disposition", f"with {_PARTS} select p_partkey, case when metal = 'steel' and size = 'large' then 'keep' when size is null then 'look' else 'leave' end as disposition from c")
def disposition(spark, d):
    c = _classified(spark, d)
    out = F.when((F.col("metal.value") == "steel") & (F.col("size.value") == "large"), "keep").when(F.col("size").isNull(), "look").otherwise("leave")
    return c.select("p_partkey", out.alias("disposition"))


_U = "('0x' || substr(md5('h:' || k), 1, 8))::bigint / 4294967296.0"
_BINNED = f"""select *, {_U} as u from (select l_orderkey * 8 + l_linenumber as k, case when l_quantity > 0 then ceil(l_quantity / 2)::bigint else -2147483648 end as q, case when l_extendedprice = 0 then -2147483648 else round_even(l_extendedprice / 2000, 0)::bigint end as c,
'p' || l_suppkey % 4 as part, (l_linenumber % 2)::varchar as subj, l_returnflag as a, l_linestatus, l_suppkey % 4 as p from lineitem)"""


def _vote_sql(asked: str, pool: str, scope: str, out: str) -> str:
    """CTEs that end in `out`: the vote of the distinct bins in `asked` over the counts in `pool`."""
    same, by = ("and p.part = s.part" if scope == "scoped" else ""), "q, c, part, subj"
    return f"""{out}_f as (select s.q, s.c, s.part, s.subj, step, p.a, sum(n)::bigint as n from {asked} s, o, {pool} p where p.q = s.q + x and p.c = s.c + y {same} and (x = 0 or (s.q > -2147483648 and s.q + x >= 0)) and (y = 0 or (s.c > -2147483648 and s.c + y >= 0)) group by all),
{out}_m as (select * from {out}_f qualify step = min(step) over (partition by {by})),
{out}_r as (select *, not (subj = '0' and a = 'R') as fit, row_number() over w as i, lead(n) over w as nx, sum(n) over (partition by {by})::bigint as total from {out}_m window w as (partition by {by} order by n desc, a)),
{out}_t as (select * from {out}_r where fit qualify row_number() over (partition by {by} order by i) = 1),
{out}_n as (select {by}, any_value(total) as total from {out}_r group by all),
{out} as (select {by}, case when n.total is null then 'no_match' when t.a is null then 'no_compatible_match' when t.n < 3 then 'insufficient_matches' when t.nx = t.n then 'tie' when step = 0 then 'exact_bin' when step = 1 then 'expanded_single' else 'expanded_multi' end as method, a, coalesce(t.n, 0)::bigint as matches, coalesce(n.total, 0)::bigint as neighbours, '{scope}' as scope from {asked} left join {out}_n n using ({by}) left join {out}_t t using ({by}))"""


_OFFSETS = "o as (select x, y, (x <> 0)::int + (y <> 0)::int as step from (values (0), (-1), (1)) v(x), (values (0), (-1), (1)) w(y))"
_NEAR = f"""with b as ({_BINNED}), {_OFFSETS}, pool as (select q, c, part, a, count(*) as n from b where l_linestatus = 'F' and p < 3 group by all), whole as (select q, c, a, sum(n)::bigint as n from pool group by all),
asked as (select distinct q, c, part, subj from b where l_linestatus = 'O'), near_by as (select * from asked where part in (select part from pool)), {_vote_sql("near_by", "pool", "scoped", "one")},
again as (select q, c, part, subj from asked where part not in (select part from pool) union all select q, c, part, subj from one where method in ('no_match', 'insufficient_matches', 'tie', 'no_compatible_match') and part <> 'p1'), {_vote_sql("again", "whole", "global", "two")},
every as (select * from one where not (method in ('no_match', 'insufficient_matches', 'tie', 'no_compatible_match') and part <> 'p1') union all select * from two)
select k, case when starts_with(method, 'expanded') or method = 'exact_bin' then every.a end as voted, matches, neighbours, method, scope from b join every using (q, c, part, subj) where l_linestatus = 'O'"""
_VOTE_DIMS = {"l_quantity": ("ceil", 2), "l_extendedprice": 2000}


def _units(spark, d):
    return read(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") * 8 + F.col("l_linenumber"))


@query("cls_7_neighbour_vote", _NEAR)
def neighbour_vote(spark, d):
    u = _units(spark, d).withColumn("part", F.concat(F.lit("p"), F.col("l_suppkey") % 4)).withColumn("subj", F.col("l_linenumber") % 2)
    fits = lambda subject, answer: ~((subject == "0") & (answer == "R"))
    return R.neighbour_vote(u.filter("l_linestatus = 'O'"), u.filter("l_linestatus = 'F' and l_suppkey % 4 < 3"), "k", _VOTE_DIMS, "l_returnflag", partition="part", alone=["p1"], subject="subj", fits=fits)


@query("cls_8_siblings", "with b as (select l_orderkey, l_linenumber, case when l_linenumber % 3 = 0 then null else l_returnflag end as a, l_linestatus, l_shipmode_proxy from (select *, l_discount > 0.05 as l_shipmode_proxy from lineitem)) select l_orderkey, l_linenumber, case when a is null and l_linestatus <> 'F' and sum(l_shipmode_proxy::int) over (partition by l_orderkey) - l_shipmode_proxy::int > 0 then 'S' else a end as a from b")
def siblings(spark, d):
    u = _units(spark, d).withColumn("a", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag")))
    return R.from_siblings(u, "k", "l_orderkey", "a", F.col("l_discount") > 0.05, "S", F.col("l_linestatus") == "F").select("l_orderkey", "l_linenumber", "a")


def _place_sql(w: str) -> str:
    f, l = f"min(case when s = 1 and t is not null and ok then t end) over {w}", f"max(case when s = -1 and t is not null and ok then t end) over {w}"
    fn = f"arg_min(case when s = 1 and t is not null and ok then n end, case when s = 1 and t is not null and ok then {{'t': t, 'n': n}} end) over {w}"
    ln = f"arg_max(case when s = -1 and t is not null and ok then n end, case when s = -1 and t is not null and ok then {{'t': t, 'n': n}} end) over {w}"
    return f"""case when not ok or t is null then 'no_trusted_time' when count(s) over {w} = 0 then 'no_answer' when coalesce({f} <= {l}, false) then 'crossed' when coalesce(t > {f}, false) and coalesce(n > {fn}, true) then 'post'
 when coalesce(t < {l}, false) and coalesce(n < {ln}, true) then 'pre' when coalesce(t > {f}, false) or coalesce(t < {l}, false) then 'series_number' when {f} is not null and {l} is not null then 'window' when {f} is not null then 'post_only_before_first' else 'pre_only_after_last' end"""


def _of_edge(which: str, what: str) -> str:
    """A value of the first positive or last negative row of a group."""
    sign, pick = (1, "arg_min") if which == "first" else (-1, "arg_max")
    c = f"case when s = {sign} and t is not null and ok then"
    return f"{pick}({c} {what} end, {c} {{'t': t, 'n': n}} end) over w"


_BRACKET = f"""with o as (select *, o_orderkey % 61 = 0 as derived, case when o_orderkey % 37 > 0 then datediff('day', date '1990-01-01', cast(o_orderdate as date)) end as t from orders),
r as (select o_orderkey as n, o_custkey // 2 as g, o_custkey // 6 as subj, o_orderkey // 64 as series, derived, t, t - o_orderkey % 3 as fi, t + o_orderkey % 7 * 30 as la, o_orderkey % 59 = 0 as stale,
  case when derived then null when o_custkey % 3 = 0 and o_orderkey % 4 = 0 and year(o_orderdate) >= 1997 then 1 when o_custkey % 3 <= 1 and o_orderkey % 4 = 1 and year(o_orderdate) <= 1996 then -1 when o_orderkey % 97 = 0 then 1 end as s,
  o_custkey // 2 % 7 > 0 as ok, o_custkey % 5 = 0 and o_orderkey % 9 = 0 as bolus, case when o_custkey % 8 = 0 then case when o_orderkey % 3 = 0 then 'spine' else 'head' end when o_orderkey % 2 = 0 then 'head' end as region, o_custkey % 11 // 10 * (o_orderkey % 2) as day, o_orderkey % 41 = 0 as untimed, o_orderkey % 2 = 0 as model, o_orderkey % 53 = 0 as tagged from o),
e as (select *, min(case when bolus and t is not null and ok then t end) over (partition by g, series) as ev, min(t) over (partition by g) as st from r),
u as (select subj, g, min(st) as st from e where st is not null group by all),
v2 as (select g, coalesce(st - lag(st) over k < 30, false) or coalesce(lead(st) over k - st < 30, false) as second from u window k as (partition by subj order by st, g)),
p as (select *, {_place_sql('w')} as base, {_place_sql('v')} as exam, min(case when s = 1 and t is not null and ok then t end) over w as f, max(case when s = -1 and t is not null and ok then t end) over w as l, min(case when bolus and t is not null and ok then t end) over w as b, max(ev) over w as bt, min(case when bolus and t is not null then n end) over w as bn,
  {_of_edge('first', 'fi')} as ffi, {_of_edge('last', 'fi')} as lfi, {_of_edge('first', 'stale')} as fst, {_of_edge('last', 'stale')} as lst,
  len(list_distinct(list(region) filter (region is not null and not derived) over w)) as regions, len(list_distinct(list(day) filter (not derived) over w)) as days, count(case when s = 1 then 1 end) over w as others from e window w as (partition by g), v as (partition by g, region)),
q as (select *, coalesce(b < l, false) as early, s is null and base in ('pre', 'post') as labelled, max(case when s = 1 and coalesce(t = f, false) then model::int end) over w as fm, max(case when tagged and coalesce(t >= f, false) then 1 end) over w as tag from p window w as (partition by g)),
a as (select *, s is null and not early and base in ('window', 'pre_only_after_last', 'no_answer', 'post_only_before_first') and coalesce(t > b, false) and coalesce(n > bn, true) and not bolus as added, labelled and not early and coalesce(regions, 0) > 1 and region is not null and exam <> base as other, ok and (coalesce(bt - b >= 400, false) or coalesce(b > f, false)) as split from q),
z0 as (select *, added or (labelled and base = 'post') as post, labelled and base = 'pre' as pre, case when (labelled or added) and early then 'C3_bolus_before_last' when other then 'C2_exam' when (labelled or added) and coalesce(days, 0) > 1 then 'C5_midnight' when (labelled or added) and untimed then 'C5_no_time' end as why0, case when s = 1 then 'post' when s = -1 then 'pre' end as own from a),
z1 as (select *, stale or (why0 is null and ((post and coalesce(fst, false)) or (pre and coalesce(lst, false)))) as content from z0),
z2 as (select *, coalesce(why0, case when (labelled or added) and content then 'C5_content' end) as why1 from z1),
z3 as (select *, why1 is null and ((pre and coalesce(la >= lfi, false)) or (post and not added and coalesce(fi <= ffi, false))) as straddle from z2),
z as (select *, case when derived then case when not bolus then 'C6_derived' end else coalesce(why1, case when straddle then 'C5_straddle' end) end as why from z3),
y as (select *, case when not (derived and not bolus) then coalesce(own, case when why is null then case when added then 'post' when labelled then base end end) end as label from z)
select n as o_orderkey, label, case when label is null then coalesce(why, base) end as reason, concat_ws(',', case when early and not derived then 'C3_bolus_before_last' end, case when added then 'C3_bolus_post_added' end, case when coalesce(regions, 0) > 1 then 'C2_multi_region' end, case when other then 'C2_exam' end, case when split then 'C4_split_session' end,
  case when split and f is not null and coalesce(t > least(b, f) and t < greatest(b, f), false) then 'C4_split' end, case when coalesce(days, 0) > 1 and not derived then 'C5_midnight' end, case when untimed and not derived then 'C5_no_time' end, case when content and not derived then 'C5_content' end, case when straddle and not derived then 'C5_straddle' end, case when s is null and base = 'series_number' then 'C5_number_guard' end, case when derived then 'C6_derived' end, case when second then 'C2_second_study' end) as flags,
  coalesce(fm = 1, false) and others = 1 and tag is null and not coalesce(b <= f, false) as weak_first from y left join v2 using (g)"""


@query("cls_9_bracket", _BRACKET)
def bracket(spark, d):
    o, k, c = retail(spark, d).scan("session"), F.col("o_orderkey"), F.col("o_custkey")
    sign = F.when((c % 3 == 0) & (k % 4 == 0) & (F.year("day") >= 1997), 1).when((c % 3 <= 1) & (k % 4 == 1) & (F.year("day") <= 1996), -1).when(k % 97 == 0, 1)
    region = F.when(c % 8 == 0, F.when(k % 3 == 0, "spine").otherwise("head")).when(k % 2 == 0, "head")
    rows = o.select("o_orderkey", c, F.floor(c / 2).alias("g"), F.when(k % 37 > 0, F.datediff("day", F.lit("1990-01-01").cast("date"))).alias("t"), sign.alias("s"), region.alias("region"), (F.floor(c % 11 / 10) * (k % 2)).alias("on"))
    rows = rows.withColumns({"subject": F.floor(c / 6), "series": F.floor(k / 64), "begins": F.col("t") - k % 3, "ends": F.col("t") + k % 7 * 30})
    more = dict(series="series", images=("begins", "ends"), content_early=k % 59 == 0, derived=k % 61 == 0, study=("subject", "t", 30))
    how = dict(trusted=F.col("g") % 7 > 0, bolus=(c % 5 == 0) & (k % 9 == 0), untimed=k % 41 == 0, model=k % 2 == 0, tagged=k % 53 == 0, split_gap=400)
    rows = dealt(rows, o.count(), "g")
    return R.bracket(rows, "g", "t", "s", "o_orderkey", region="region", day="on", **how, **more).select("o_orderkey", "label", "reason", "flags", "weak_first")


@query("cls_10_carry_over", "select a.event_id, round(min(epoch(a.ts) - epoch(b.ts)) / 3600, 4) as hours from events a join events b on a.user_id = b.user_id and b.event_type = 'purchase' and (epoch(a.ts) - epoch(b.ts)) / 3600 between 24 and 72 group by 1")
def carry_over(spark, d):
    return R.carried(read(spark, d, "events"), "event_id", "user_id", "ts", F.col("event_type") == "purchase", 24, 72)


_CLOCK = """with e as (select user_id || ':' || cast(ts as date) as g, user_id % 3 * 10 + hour(ts) // 2 as series, case when event_id % 53 > 0 then hour(ts) * 3600 + minute(ts) * 60 end as s, case when event_id % 3 > 0 then event_id end as k from events),
p as (select g, series, min(s) as t, min(k) as k from e group by all), q as (select *, t is not null and k is not null as b from p),
r as (select *, rank() over (partition by g, b order by t) + (count(*) over (partition by g, b, t) - 1) / 2.0 as x, rank() over (partition by g, b order by k) + (count(*) over (partition by g, b, k) - 1) / 2.0 as y from q),
f as (select g, count(*) as n, count(t) as timed, count(case when t % 86400 = 0 then 1 end) as midnight, max(t) - min(t) as span, count(distinct t) as times, case when count(case when b then 1 end) >= 3 and count(distinct case when b then x end) > 1 and count(distinct case when b then y end) > 1 then round(corr(case when b then x end, case when b then y end), 6) end as rho from r group by 1)
select g, n, rho, coalesce(n >= 2 and timed = n and midnight = 0 and span between 120 and 43200 and times >= 0.5 * n and coalesce(rho >= 0.3, true), false) as trusted from f"""


@query("cls_11_clock_trust", _CLOCK)
def clock_trust(spark, d):
    e = read(spark, d, "events").withColumn("g", F.concat_ws(":", "user_id", F.to_date("ts"))).withColumn("series", (F.col("user_id") % 3 * 10 + F.floor(F.hour("ts") / 2)).cast("long"))
    e = e.withColumn("s", F.when(F.col("event_id") % 53 > 0, F.hour("ts") * 3600 + F.minute("ts") * 60)).withColumn("k", F.when(F.col("event_id") % 3 > 0, F.col("event_id")))
    return R.clock_trust(e, "g", "series", "s", "k", most_span=43_200, floor=0.3)


@query("cls_12_scoped_rules", f"select p_partkey, case when contains(lower(p_type), 'standard') and p_brand = 'Brand#11' then 'scoped' else {_METAL} end as metal from part")
def scoped(spark, d):
    own = R.Rule("site", "metal", "scoped", {"contains": ("p_type", "STANDARD")}, scope={"equals": ("p_brand", "Brand#11")})
    return _classified(spark, d, [own, *RULES]).select("p_partkey", F.col("metal.value").alias("metal"))


_EFFECT = f"with b as (select p_partkey, {_METAL} as f, case when contains(lower(p_type), 'standard') then 'tin' else {_METAL} end as t, case when p_partkey % 2 = 0 then {_METAL} end as truth from part)"


@query("cls_13_effect", f"{_EFFECT} select 'metal' as axis, f as \"from\", t as \"to\", count(*) as n, count(case when f = truth and t is distinct from truth then 1 end) as made_wrong from b where f is distinct from t group by all")
def effect(spark, d):
    before = _classified(spark, d).select("p_partkey", F.col("metal.value").alias("metal"))
    after = _classified(spark, d, [R.Rule("tin", "metal", "tin", {"contains": ("p_type", "standard")}), *RULES]).select("p_partkey", F.col("metal.value").alias("metal"))
    truth = before.filter("p_partkey % 2 = 0").select("p_partkey", F.lit("metal").alias("axis"), F.col("metal").alias("truth"))
    return R.effect(before, after, "p_partkey", ["metal"], truth)


@query("cls_14_rehearsal", "select p_partkey from part order by md5('s1:' || p_partkey), p_partkey limit 100")
def rehearsal(spark, d):
    return R.rehearsal(read(spark, d, "part").select("p_partkey"), "p_partkey", 100, "s1")


@query("cls_15_signals", f"""with {_PARTS}, v as (select p_partkey, metal, rule as won, unnest([x for x in [case when list_contains(regexp_split_to_array(lower(p_type), '[^a-z0-9#]+'), 'economy') then 'steel/header' end, case when contains(lower(p_type), 'small') and p_size < 40 then 'brass/name' end, case when regexp_matches(p_type, '(MEDIUM|PROMO)$') then 'other/inferred' end, 'none/default'] if x is not null]) as t from c)
select 'metal' as axis, split_part(t, '/', 1) as value, split_part(t, '/', 2) as tier, count(*) as votes, count(case when split_part(t, '/', 1) <> metal then 1 end) as shadowed, min(case won when 'steel' then 0.95 when 'brass' then 0.8 when 'any_metal' then 0.6 else 0.3 end)::double as lo, max(case won when 'steel' then 0.95 when 'brass' then 0.8 when 'any_metal' then 0.6 else 0.3 end)::double as hi from v group by all""")
def signals(spark, d):
    metal = [r for r in RULES if r.axis == "metal"]
    decided = _classified(spark, d, metal).select("p_partkey", F.lit("metal").alias("axis"), "metal.value", "metal.confidence")
    return R.signals(R.votes(read(spark, d, "part"), "p_partkey", metal), decided, "p_partkey")


_LOST = f"with {_PARTS}, v as (select p_partkey, metal, p_type, p_brand, unnest([x for x in [case when list_contains(regexp_split_to_array(lower(p_type), '[^a-z0-9#]+'), 'economy') then 'steel' end, case when contains(lower(p_type), 'small') and p_size < 40 then 'brass' end, case when regexp_matches(p_type, '(MEDIUM|PROMO)$') then 'other' end, 'none'] if x is not null]) as value from c), w as (select value, unnest(list_distinct([x for x in regexp_split_to_array(lower(p_type || ' ' || p_brand), '[^a-z0-9#]+') if x <> ''])) as word from v where value <> metal), n as (select value, word, count(*) as units from w group by all)"


@query("cls_15_override_words", f"{_LOST} select 'metal' as axis, value, word, units from n qualify row_number() over (partition by value order by units desc, word) <= 5")
def override_words(spark, d):
    metal = [r for r in RULES if r.axis == "metal"]
    decided = _classified(spark, d, metal).select("p_partkey", F.lit("metal").alias("axis"), "metal.value")
    parts = read(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_type", "p_brand").alias("text"))
    return R.override_words(R.votes(read(spark, d, "part"), "p_partkey", metal), decided, parts, "p_partkey", "text", 5)


@query("cls_16_texts", f"with {_PARTS} select p_type, count(case when size is not null then 1 end) as resolved, count(case when size is null then 1 end) as unresolved from c group by 1 order by unresolved desc, resolved desc, p_type limit 20")
def texts(spark, d):
    return R.texts(_classified(spark, d), "p_type", F.col("size").isNotNull(), 20)


_HUES = "h as (select p_partkey, x.rule, x.value, x.tier, x.place from part, (values ('g', 'one', 'name', 0), ('s', 'big', 'name', 1), ('t', 'econ', 'name', 2), ('u', 'plain', 'default', 3)) x(rule, value, tier, place) where case x.rule when 'g' then contains(lower(p_name), '1') when 's' then p_size > 20 when 't' then contains(lower(p_type), 'economy') else true end)"


def _hues(spark, d):
    hue = [R.Rule("g", "hue", "one", {"contains": ("p_name", "1")}, "name"), R.Rule("s", "hue", "big", {"above": ("p_size", 20)}, "name"), R.Rule("t", "hue", "econ", {"contains": ("p_type", "economy")}, "name"), R.Rule("u", "hue", "plain", {"present": "p_type"}, "default")]
    return R.votes(read(spark, d, "part"), "p_partkey", hue)


@query("cls_17_disagreements", f"with {_HUES} select 'hue' as axis, x.tier, x.rule as a, y.rule as b, count(*) as n from h x join h y on x.p_partkey = y.p_partkey and x.tier = y.tier and x.rule < y.rule and x.value <> y.value group by all")
def disagreements(spark, d):
    return R.disagreements(_hues(spark, d), "p_partkey")


@query("cls_17_who_beat_whom", f"with {_HUES}, w as (select * from h qualify place = min(place) over (partition by p_partkey)) select 'hue' as axis, w.rule as winner, h.rule as loser, count(*) as n from w join h on h.p_partkey = w.p_partkey and h.rule <> w.rule and h.value <> w.value group by all")
def who_beat_whom(spark, d):
    order = F.create_map(*[F.lit(x) for i, r in enumerate("gstu") for x in (r, i)])
    return R.beaten(_hues(spark, d), "p_partkey", order[F.col("rule")])


@query("cls_18_illegal", f"with {_PARTS} select p_partkey, metal, size from c where size is not null and (metal, size) not in (('steel', 'small'), ('steel', 'large'), ('none', 'small'))")
def illegal(spark, d):
    c = _classified(spark, d).select("p_partkey", F.col("metal.value").alias("metal"), F.col("size.value").alias("size"))
    allowed = spark.createDataFrame([("steel", "small"), ("steel", "large"), ("none", "small")], "metal string, size string")
    return R.illegal(c, "p_partkey", allowed, ("metal", "size")).select("p_partkey", "metal", "size")


@query("cls_19_tally", "with r as (select p_brand, p_size, p_partkey, row_number() over (partition by p_brand, p_size order by p_partkey) as r from part) select p_brand, p_size, count(*) as n, string_agg(case when r <= 3 then p_partkey::varchar end, ',' order by p_partkey) as samples from r group by all")
def tally(spark, d):
    return R.tally(read(spark, d, "part"), "p_brand", "p_size", "p_partkey")


_HOLDOUT = f"""with b as (select * replace ('' as part, '' as subj) from ({_BINNED})), {_OFFSETS}, whole as (select q, c, a, count(*) as n from b where u >= 0.2 group by all), asked as (select distinct q, c, part, subj from b where u < 0.2), {_vote_sql("asked", "whole", "global", "one")}
select method, count(*) as asked, count(case when starts_with(method, 'expanded') or method = 'exact_bin' then 1 end) as answered, count(case when (starts_with(method, 'expanded') or method = 'exact_bin') and one.a = b.a then 1 end) as "right" from b join one using (q, c, part, subj) where u < 0.2 group by 1"""


@query("cls_20_holdout", _HOLDOUT)
def holdout(spark, d):
    return R.holdout(_units(spark, d), "k", _VOTE_DIMS, "l_returnflag", 0.2, "h")


_ORDERED = f"""with b as (select * replace ('' as part, '' as subj) from ({_BINNED})), {_OFFSETS}, whole as (select q, c, a, count(*) as n from b where l_linestatus = 'F' group by all), asked as (select distinct q, c, part, subj from b where l_linestatus = 'O'), {_vote_sql("asked", "whole", "global", "one")}
select count(*) as units, count(case when starts_with(method, 'expanded') or method = 'exact_bin' then 1 end) as answered, 0::bigint as differ from b join one using (q, c, part, subj) where l_linestatus = 'O'"""


@query("cls_21_order_independence", _ORDERED)
def order_independence(spark, d):
    """The vote taken part by part, forward and backward, over a reference that the parts' answers do not join: no answer differs."""
    u = _units(spark, d).withColumn("id", F.xxhash64("k", "l_partkey", "l_suppkey", "l_extendedprice"))
    asked, reference = u.filter("l_linestatus = 'O'"), u.filter("l_linestatus = 'F'")
    return R.order_independence(asked, reference, "id", _VOTE_DIMS, "l_returnflag", parts=4)
