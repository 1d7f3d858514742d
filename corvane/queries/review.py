"""Picks, review, sampling and certification over order lines, orders and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from corvane.operators import picks as P
from corvane.operators import review as R
from corvane.plans.grains import read, retail
from corvane.plans.storage import dealt, stored

from .base import query


def _lines(spark, d):
    return read(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") * 8 + F.col("l_linenumber")).withColumn("x", F.col("l_partkey"))


def _orders(spark, d):
    return retail(spark, d).scan("session")


@query("pick_1_shares", "select l_returnflag as value, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share from lineitem group by 1")
def shares(spark, d):
    return P.shares(_lines(spark, d), "l_returnflag")


def _at(q: float) -> str:
    return f"min(case when i = round({q} * (n - 1)) then l_extendedprice end)"


@query("pick_1_percentiles", f"with r as (select l_returnflag, l_extendedprice, row_number() over (partition by l_returnflag order by l_extendedprice) - 1 as i, count(*) over (partition by l_returnflag) as n from lineitem) select l_returnflag, {_at(0.05)} as p05, {_at(0.25)} as p25, {_at(0.5)} as p50, {_at(0.75)} as p75, {_at(0.95)} as p95 from r where n >= 3 group by 1")
def percentiles(spark, d):
    return P.percentiles(_lines(spark, d), "l_returnflag", "l_extendedprice")


_SCORE = "round(greatest(0, least(1, (2 * round(case l_returnflag when 'A' then 1.0 when 'N' then 0.6 else 0.0 end, 9) + round(l_quantity / 50, 9) + round(case when l_discount > 0.05 then 1.0 else 0.0 end, 9)) / 4.0 * case when l_linestatus = 'F' then 0.9 else 1.0 end)), 9)::double"


def _scored(spark, d):
    parts = {"flag": (2, F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 0.6).otherwise(0.0)), "size": (1, F.col("l_quantity") / 50), "discount": (1, F.when(F.col("l_discount") > 0.05, 1.0))}
    return P.score(_lines(spark, d), parts, F.when(F.col("l_linestatus") == "F", 0.9).otherwise(1.0))


@query("pick_2_score", f"select l_orderkey, l_linenumber, {_SCORE} as score, round(l_quantity / 50, 9)::double as s_size from lineitem")
def score(spark, d):
    return _scored(spark, d).select("l_orderkey", "l_linenumber", "score", "s_size")


@query("pick_3_families", f"select l_orderkey, l_returnflag, arg_max(k, (score, -k)) as k, max(score) as score, count(*) as members from (select *, l_orderkey * 8 + l_linenumber as k, {_SCORE} as score from lineitem) group by 1, 2")
def families(spark, d):
    return P.families(_scored(spark, d), ["l_orderkey", "l_returnflag"], "k", "score")


_CHOOSE = f"""with s as (select *, l_orderkey * 8 + l_linenumber as k, {_SCORE} as score from lineitem), n as (select *, coalesce(round((max(score) over w - score) / nullif(max(score) over w, 0), 9), 0) <= 0.02 as near from s window w as (partition by l_orderkey)),
r as (select *, row_number() over (partition by l_orderkey order by near desc, case when near then l_quantity end asc nulls last, score desc, k) as r from n),
c as (select l_orderkey, max(case when r = 1 then k end) as k, max(case when r = 1 then score end) as score, max(case when r = 2 then k end) as runner_up, coalesce(round((max(case when r = 1 then score end) - coalesce(max(case when r = 2 then score end), 0)) / nullif(max(case when r = 1 then score end), 0), 9), 0)::double as margin, count(*) as candidates from r group by 1)"""


def _chosen(spark, d):
    rows = _scored(spark, d).select("l_orderkey", "k", "score", "l_quantity")
    return P.choose(dealt(rows, _lines(spark, d).count(), "l_orderkey"), ["l_orderkey"], "k", steps=[F.col("l_quantity")])


@query("pick_4_winner", f"{_CHOOSE} select * from c")
def winner(spark, d):
    return _chosen(spark, d)


@query("pick_5_borders", f"{_CHOOSE} select l_orderkey, concat_ws(',', case when abs(margin) <= 0.02 then 'too_close' end, case when candidates = 1 then 'alone' end, case when score < 0.3 then 'rare' end) as borders from c")
def borders(spark, d):
    return P.borders(_chosen(spark, d), {"too_close": F.abs("margin") <= 0.02, "alone": F.col("candidates") == 1, "rare": F.col("score") < 0.3}).select("l_orderkey", "borders")


_MORE = """with l as (select distinct on (l_orderkey, l_linenumber) *, l_orderkey * 8 + l_linenumber as k from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice),
a as (select *, round(l_quantity / 50, 9)::double as score, l_suppkey % 3 as family, case when l_partkey % 9 > 0 then l_returnflag end as dim, case l_linestatus when 'F' then ['a', 'b'] else ['b', 'c'] end[1 + l_partkey % 2:2] as tokens, 'v' || l_partkey % 40 as val, l_suppkey % 50 as fall from l),
s as (select * from a where l_quantity > 20),
sh as (select val, count(*) / sum(count(*)) over () as share from s group by 1),
rk as (select dim, l_extendedprice as x, row_number() over (partition by dim order by l_extendedprice) - 1 as i, count(*) over (partition by dim) as n from s),
pt as (select dim, min(case when i = round(0.05 * (n - 1)) then x end) as p05, min(case when i = round(0.95 * (n - 1)) then x end) as p95 from rk where n >= 3 and dim is not null group by 1),
w as (select *, count(*) over (partition by l_orderkey) as candidates, lead(score) over (partition by l_orderkey order by score desc, k) as second from s qualify row_number() over (partition by l_orderkey order by score desc, k) = 1),
f as (select w.l_orderkey, count(distinct case when s.family = w.family then s.l_shipdate end) as takes, bool_or(s.k <> w.k and round(s.score - 0.9 * w.score, 9) >= 0 and not list_has_any(s.tokens, w.tokens)) as twin, bool_or(s.k <> w.k and not list_contains(s.tokens, 'c') and round((w.score - s.score) / w.score, 9) <= 0.2 and w.family = 1) as rival from w join s using (l_orderkey) group by 1)
select o_orderkey as l_orderkey, w.k, concat_ws(',', case when w.k is null then 'nothing' end, case when candidates > 1 and round((w.score - coalesce(second, 0)) / w.score, 9) <= 0.02 then 'too_close' end, case when w.k is not null and coalesce(share, 0) < 0.0245 then 'rare' end, case when takes > 1 then 'retake' end, case when w.k is not null and w.dim is null then 'unknown_dim' end,
 case when w.l_extendedprice < p05 or w.l_extendedprice > p95 then 'slice_outlier' end, case when twin then 'pre_post_twin' end, case when w.fall in (3, 9) then 'fallback' end, case when rival then 'rival' end) as borders from orders left join w on w.l_orderkey = o_orderkey left join f on f.l_orderkey = o_orderkey left join sh on sh.val = w.val left join pt on pt.dim = w.dim"""


@query("pick_5_all_borders", _MORE)
def all_borders(spark, d):
    first = F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_linestatus", "l_returnflag", "l_shipdate")).alias("r")
    rows = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(first).select("l_orderkey", "l_linenumber", "r.*")
    tokens = F.slice(F.when(F.col("l_linestatus") == "F", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("c"))), F.col("l_partkey").cast("int") % 2 + 1, F.lit(2))
    rows = rows.select("*", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), F.round(F.col("l_quantity") / 50, 9).alias("score"), (F.col("l_suppkey") % 3).alias("family"), F.when(F.col("l_partkey") % 9 > 0, F.col("l_returnflag")).alias("dim"), tokens.alias("tokens"), F.concat(F.lit("v"), F.col("l_partkey") % 40).alias("val"), (F.col("l_suppkey") % 50).alias("fall")).filter("l_quantity > 20")
    rows = stored(rows.select("l_orderkey", "k", "score", "family", "dim", "tokens", "val", "fall", "l_extendedprice", "l_shipdate"))  # read five times
    lines = dealt(rows, rows.count(), "l_orderkey")
    groups = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    how = dict(close=0.02, shares_=P.shares(rows, "val"), rare_of="val", rare=0.0245, dim="dim", slices="l_extendedprice", points=P.percentiles(rows.filter("dim is not null"), "dim", "l_extendedprice"), family="family", moment="l_shipdate", tokens="tokens", twin_at=0.9, fallback=("fall", [3, 9]), rival=(1, "c", 0.2))
    return P.more_borders(groups, lines, P.choose(lines, ["l_orderkey"], "k"), "l_orderkey", "k", "score", **how)


@query("pick_6_eligible", """with r(scope, ref, kind, place) as (values ('pack', 'all', 'A', 1), ('pack', 'all', 'N', 2), ('dataset', 'O', 'N', 1), ('dataset', 'F', 'A', null)), l as (select l_orderkey * 8 + l_linenumber as k, row_number() over () as id, l_returnflag as kind, l_linestatus as ds from lineitem),
h as (select l.id, l.k, l.kind, l.ds, r.place, case scope when 'pack' then 0 else 1 end as rank from l join r on r.kind = l.kind and (scope = 'pack' or ref = l.ds))
select k, kind, place from h qualify row_number() over (partition by id order by rank desc) = 1 and place is not null""")
def eligible(spark, d):
    rules = spark.createDataFrame([("pack", "all", "A", 1), ("pack", "all", "N", 2), ("dataset", "O", "N", 1), ("dataset", "F", "A", None)], "scope string, ref string, kind string, place int")
    rows = _lines(spark, d).select("k", F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("ds"))
    return P.eligible(rows, rules, [("pack", F.lit("all")), ("dataset", F.col("ds"))], "kind").select("k", "kind", "place")


@query("pick_7_overridden", f"{_CHOOSE} select l_orderkey, case when l_orderkey % 100 = 0 then -1 else k end as k, l_orderkey % 100 = 0 as by_person from c")
def overridden(spark, d):
    c = _chosen(spark, d)
    own = c.filter("l_orderkey % 100 = 0").select("l_orderkey", F.lit(-1).cast("long").alias("k"))
    return P.overridden(c, own, ["l_orderkey"], "k").select("l_orderkey", "k", "by_person")


@query("pick_7_rekey", f"{_CHOOSE} select case when l_orderkey % 10 = 1 then l_orderkey + 1000000 else l_orderkey end as l_orderkey, k from c where l_orderkey % 10 <> 2")
def rekey(spark, d):
    c = _chosen(spark, d).select("l_orderkey", "k")
    moved = c.filter("l_orderkey % 10 in (1, 2)").select("l_orderkey", F.when(F.col("l_orderkey") % 10 == 1, F.col("l_orderkey") + 1000000).alias("to"))
    return P.rekey(c, moved, "l_orderkey").select("l_orderkey", "k")


@query("pick_8_kind_map", "with l as (select o_orderstatus, o_custkey, string_agg(o_orderpriority[1:1], '>' order by o_orderdate, o_orderpriority[1:1]) as kinds from orders group by 1, 2) select o_orderstatus, kinds, count(*) as subjects from l group by 1, 2")
def kind_map(spark, d):
    o = read(spark, d, "orders").withColumn("kind", F.substring("o_orderpriority", 1, 1))
    return P.kind_map(o, "o_orderstatus", "o_custkey", "o_orderdate", "kind")


@query("rev_1_questions", "with r as (select o_orderstatus, o_orderpriority, o_orderkey, row_number() over (partition by o_orderstatus, o_orderpriority order by o_orderkey) as r from orders) select o_orderstatus, o_orderpriority, count(*) as members, string_agg(case when r <= 5 then o_orderkey::varchar end, ',' order by o_orderkey) as first from r group by 1, 2")
def questions(spark, d):
    return R.grouped_questions(read(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "o_orderkey")


_DECISIONS = "select l_orderkey as unit, l_returnflag as axis, l_linestatus as value, case l_linenumber % 3 when 0 then 'person' when 1 then 'model' else 'agent' end as author, case l_partkey % 4 when 0 then 'stack' when 1 then 'group' when 2 then 'series' else 'subject' end as scope, cast(l_shipdate as date) as decided_at, l_orderkey * 8 + l_linenumber as decision_id, l_suppkey % 5 > 0 as committed, l_partkey % 7 = 0 as withdrawn from lineitem"


def _decisions(spark, d):
    m = lambda c, n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col(c) % n + 1).cast("int"))
    return _lines(spark, d).select(F.col("l_orderkey").alias("unit"), F.col("l_returnflag").alias("axis"), F.col("l_linestatus").alias("value"), m("l_linenumber", 3, "person", "model", "agent").alias("author"), m("l_partkey", 4, "stack", "group", "series", "subject").alias("scope"), F.to_date("l_shipdate").alias("decided_at"), F.col("k").alias("decision_id"), (F.col("l_suppkey") % 5 > 0).alias("committed"), (F.col("l_partkey") % 7 == 0).alias("withdrawn"))


@query("rev_2_precedence", f"select unit, axis, value, author, decision_id from ({_DECISIONS}) where committed and not withdrawn qualify row_number() over (partition by unit, axis order by case author when 'person' then 3 when 'agent' then 2 else 1 end desc, case scope when 'stack' then 4 when 'group' then 3 when 'series' then 2 else 1 end desc, decided_at desc, decision_id desc) = 1")
def precedence(spark, d):
    return R.in_force(_decisions(spark, d), "unit", "axis")


@query("rev_3_bulk_commit", f"select axis, count(*) as n from ({_DECISIONS}) where not committed and author = 'model' group by 1")
def bulk_commit(spark, d):
    return _decisions(spark, d).filter("not committed and author = 'model'").groupBy("axis").agg(F.count(F.lit(1)).alias("n"))


@query("rev_4_bands", "select l_suppkey, l_returnflag, count(*) as members, round(min(1 - l_discount), 4) as confidence, case when round(min(1 - l_discount), 4) >= 0.99 then '0.99' when round(min(1 - l_discount), 4) >= 0.95 then '0.95' when round(min(1 - l_discount), 4) >= 0.9 then '0.90' when round(min(1 - l_discount), 4) >= 0.85 then '0.85' else 'below' end as band from lineitem where l_quantity > 45 group by 1, 2")
def bands(spark, d):
    rows = _lines(spark, d).filter("l_quantity > 45").withColumn("p", F.round(1 - F.col("l_discount"), 4))
    return R.grouped_proposals(rows, ["l_suppkey", "l_returnflag"], "p", 0.85)


@query("rev_5_gate", "with o as (select l_orderkey * 8 + l_linenumber as k, case when l_partkey % 9 > 0 then l_returnflag end as rule, l_suppkey % 11 = 0 as decided, case l_linenumber % 3 when 0 then 'A' when 1 then l_returnflag end as answer, case when l_partkey % 6 > 0 then l_discount end as p, case when l_suppkey % 5 > 0 then l_tax end as r from lineitem) select k, case when decided then 'decided' when p is null then 'unsure' when answer is distinct from rule then 'disagree' when p >= 0.04 and r >= 0.02 then 'accepted' else 'unsure' end as gate from o")
def gate(spark, d):
    answer = F.when(F.col("l_linenumber") % 3 == 0, "A").when(F.col("l_linenumber") % 3 == 1, F.col("l_returnflag"))
    word = R.gate(F.when(F.col("l_partkey") % 9 > 0, F.col("l_returnflag")), F.col("l_suppkey") % 11 == 0, answer, F.when(F.col("l_partkey") % 6 > 0, F.col("l_discount")), F.when(F.col("l_suppkey") % 5 > 0, F.col("l_tax")), 0.04, 0.02)
    return _lines(spark, d).select("k", word.alias("gate"))


@query("rev_6_audit_draw", "select o_orderkey from orders qualify row_number() over (order by sha256('7:audit:' || o_orderkey), o_orderkey) <= (select ceil(0.03 * count(*)) from orders)")
def audit_draw(spark, d):
    return R.draw(read(spark, d, "orders").select("o_orderkey"), "7", "audit", "o_orderkey", share=0.03)


_U = "('0x' || substr(sha256({}), 1, 13))::bigint / 4503599627370496.0"


@query("rev_7_bernoulli", f"select o_orderkey from orders where {_U.format(repr('9:') + ' || o_orderkey')} < 0.1")
def bernoulli(spark, d):
    return R.bernoulli(read(spark, d, "orders").select("o_orderkey"), "9", "o_orderkey", 0.1)


@query("rev_8_plant", """with w(truth, wrong) as (values ('F', 'P'), ('O', 'F'), ('P', 'O')), c as (select o_orderkey from orders qualify row_number() over (order by sha256('5:plant:' || o_orderkey), o_orderkey) <= (select ceil(0.05 * count(*)) from orders))
select o_orderkey, o_orderkey in (select o_orderkey from c) as planted, case when o_orderkey in (select o_orderkey from c) then wrong else o_orderstatus end as shown from orders join w on truth = o_orderstatus""")
def plant(spark, d):
    confusions = spark.createDataFrame([("F", "P", 9), ("F", "O", 2), ("O", "F", 5), ("P", "O", 4), ("P", "F", 1)], "truth string, answer string, n int")
    return R.plant(read(spark, d, "orders"), "5", "o_orderkey", "o_orderstatus", 0.05, confusions).select("o_orderkey", "planted", "shown")


@query("rev_9_catch_rate", "select coalesce(o_orderpriority, 'all') as reader, count(*) as planted, count(case when o_totalprice > 90000 then 1 end) as caught, count(case when o_totalprice > 90000 then 1 end) / count(*) >= 0.7 as meets from orders where o_orderkey % 20 = 0 group by grouping sets ((o_orderpriority), ())")
def catch_rate(spark, d):
    return R.catch_rate(read(spark, d, "orders"), "o_orderpriority", F.col("o_orderkey") % 20 == 0, F.col("o_totalprice") > 90000, 0.7)


_VOTES = "select l_orderkey as unit, l_linestatus as axis, case when l_linenumber = 3 then 'cannot_tell' else l_returnflag end as value from lineitem"


def _votes(spark, d):
    return _lines(spark, d).select(F.col("l_orderkey").alias("unit"), F.col("l_linestatus").alias("axis"), F.when(F.col("l_linenumber") == 3, "cannot_tell").otherwise(F.col("l_returnflag")).alias("value"))


_COMPARED = f"select unit, axis, count(*) as voters, count(distinct nullif(value, 'cannot_tell')) as values, case when count(distinct nullif(value, 'cannot_tell')) > 1 then 'split' when count(distinct nullif(value, 'cannot_tell')) = 1 then 'agree' else 'none' end as state from ({_VOTES}) group by 1, 2"


@query("rev_10_compare_voters", _COMPARED)
def compare_voters(spark, d):
    return R.compare_voters(_votes(spark, d), "unit", "axis", "value")


_PLAN = f"""with c as ({_COMPARED}), k as (select unit, bool_or(state = 'split') as s from c group by 1), a as (select unit from k where not s),
f as (select unit from a qualify row_number() over (order by sha256('v:audit:' || unit), unit) <= (select greatest(1, ceil(0.01 * count(*))) from a)),
o as (select *, row_number() over (partition by axis order by sha256('v:audit:' || unit), unit) as r from c where state = 'agree' and unit in (select unit from a)),
t as (select unit from f union select unit from o where r <= 60)"""


def _planned(spark, d):
    return R.voter_plan(_votes(spark, d), "unit", "axis", "value", "v", 0.01, 60)


@query("rev_10_audit_plan", f"{_PLAN} select unit, 'split' as kind from k where s union all select unit, 'audit' from t")
def audit_plan(spark, d):
    return _planned(spark, d)[0]


@query("rev_10_cells", f"{_PLAN} select c.axis, count(case when state = 'split' then 1 end) as split, count(case when state = 'agree' and not s then 1 end) as agree, count(case when state = 'agree' and not s and t.unit is not null then 1 end) as audit, greatest(0, 60 - count(case when state = 'agree' and not s and t.unit is not null then 1 end)) as short from c join k using (unit) left join t using (unit) group by 1")
def audit_cells(spark, d):
    return _planned(spark, d)[1]


@query("rev_11_voter_summary", "select o_orderpriority as voter, o_orderstatus as value, count(*) as answers, count(case when o_totalprice > 100000 then 1 end) as chosen, round(median(o_totalprice), 6) as median, quantile_disc(o_totalprice, 0.9) as p90 from orders group by 1, 2")
def voter_summary(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("voter"), F.col("o_orderstatus").alias("value"), "o_totalprice")
    return R.voter_summary(o, "voter", "value", F.col("o_totalprice") > 100000, "o_totalprice")


_PAIRS = f"select o_orderkey as pair, case when {_U.format(repr('p:') + ' || o_orderkey')} < 0.5 then o_custkey else o_orderkey + 1000000 end as \"left\", case when {_U.format(repr('p:') + ' || o_orderkey')} < 0.5 then o_orderkey + 1000000 else o_custkey end as \"right\", case o_orderstatus when 'F' then 'left' when 'O' then 'right' else 'same' end as answer from orders"


@query("rev_12_pairs", f'with p as ({_PAIRS}) select "left" as unit, case answer when \'same\' then \'same\' when \'left\' then \'yes\' else \'no\' end as value from p union all select "right", case answer when \'same\' then \'same\' when \'right\' then \'yes\' else \'no\' end from p')
def pairs(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("pair"), "o_custkey", (F.col("o_orderkey") + 1000000).alias("other"), F.when(F.col("o_orderstatus") == "F", "left").when(F.col("o_orderstatus") == "O", "right").otherwise("same").alias("answer"))
    return R.pair_values(R.pair_sides(o, "p", "pair", "o_custkey", "other"), "answer")


def _anchor_sql(side: str) -> str:
    pool = f"(select * from o where side = '{side}')"
    return f"""{side}_s as (select c.o_orderkey, min(b.o_orderkey) as k from c join {pool} b on b.o_custkey = c.o_custkey and b.s = c.s and b.o_orderkey <> c.o_orderkey group by 1),
{side}_f as (select c.o_orderkey, b.o_orderkey as k from c join {pool} b on b.o_custkey = c.o_custkey and b.t = c.t where c.o_orderkey not in (select o_orderkey from {side}_s) qualify row_number() over (partition by c.o_orderkey order by abs(datediff('day', c.day, b.day)), b.day, b.o_orderkey) = 1),
{side}_a as (select o_orderkey, k, false as other from {side}_s union all select o_orderkey, k, true from {side}_f)"""


_ANCHORED = f"""with o as (select o_orderkey, o_custkey, cast(o_orderdate as date) as day, year(o_orderdate) as s, o_orderpriority as t, o_orderstatus, case o_orderkey % 5 when 1 then 'pre' when 2 then 'post' end as side from orders), c as (select * from o where side is null),
{_anchor_sql("pre")}, {_anchor_sql("post")}
select c.o_orderkey, p.k as pre, p.other as pre_other, q.k as post, q.other as post_other from c join pre_a p using (o_orderkey) join post_a q using (o_orderkey)"""


@query("rev_13_anchored", _ANCHORED)
def anchored(spark, d):
    k = F.col("o_orderkey") % 5
    o = _orders(spark, d).withColumn("s", F.year("day")).withColumn("side", F.when(k == 1, "pre").when(k == 2, "post"))
    return R.anchored(o.filter("side is null"), o.filter("side is not null"), "o_orderkey", "s", "o_custkey", "o_orderpriority", "day", "side")


@query("rev_13_panels", f"select panels, count(*) as n from (select (['anchor_before,candidate,anchor_after', 'anchor_before,anchor_after,candidate', 'candidate,anchor_before,anchor_after', 'candidate,anchor_after,anchor_before', 'anchor_after,anchor_before,candidate', 'anchor_after,candidate,anchor_before'])[(floor({_U.format(repr('q:') + ' || o_orderkey')} * 6) + 1)::int] as panels from orders) group by 1")
def panels(spark, d):
    return R.panel_order(read(spark, d, "orders"), "q", "o_orderkey").groupBy("panels").agg(F.count(F.lit(1)).alias("n"))


_REASONS = "select l_orderkey, min(case when l_linenumber = 1 then l_returnflag end) as va, min(case when l_linenumber = 2 then l_returnflag end) as vb, list(distinct l_partkey % 5) filter (l_linenumber % 2 = 1) as ra, list(distinct l_partkey % 5) filter (l_linenumber % 2 = 0) as rb from lineitem group by 1"


@query("rev_14_two_raters", f"select l_orderkey, va = vb as agree, list_aggregate(list_transform(list_sort(list_distinct(list_concat(ra, rb))), lambda x: x::varchar), 'string_agg', ',') as parts, len(list_intersect(ra, rb))::int as shared, len(list_intersect(ra, rb)) > 0 as overlap from ({_REASONS}) where ra is not null and rb is not null")
def two_raters(spark, d):
    n, p = F.col("l_linenumber"), (F.col("l_partkey") % 5).cast("string")
    g = _lines(spark, d).groupBy("l_orderkey").agg(F.min(F.when(n == 1, F.col("l_returnflag"))).alias("va"), F.min(F.when(n == 2, F.col("l_returnflag"))).alias("vb"), F.collect_set(F.when(n % 2 == 1, p)).alias("ra"), F.collect_set(F.when(n % 2 == 0, p)).alias("rb"))
    return g.filter("size(ra) > 0 and size(rb) > 0").select("l_orderkey", *R.check_pair(F.col("va"), F.col("vb"), F.col("ra"), F.col("rb")))


@query("rev_15_settle_list", f"select o_orderkey from orders where o_orderstatus = 'P' or {_U.format(repr('z:') + ' || o_orderkey')} < 0.1")
def settle_list(spark, d):
    return R.settle_list(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") != "P", "z", "o_orderkey").select("o_orderkey")


_GRADE = "select case when grouping(o_orderpriority) = 0 then 'o_orderpriority' when grouping(yr) = 0 then 'yr' else 'total' end as dimension, coalesce(o_orderpriority, yr::varchar) as value, count(*) as read, count(case when o_orderstatus <> 'P' and o_totalprice < 10000 then 1 end) as wrong, count(case when o_orderstatus = 'P' and o_custkey % 9 <> 0 then 1 end) as unsettled, count(case when o_custkey % 9 = 0 then 1 end) as cannot_tell from (select *, year(o_orderdate) as yr from orders) group by grouping sets ((o_orderpriority), (yr), ())"


def _graded(spark, d):
    o = read(spark, d, "orders").withColumn("yr", F.year("o_orderdate"))
    return R.grade(o, ["o_orderpriority", "yr"], F.col("o_totalprice") < 10000, F.col("o_orderstatus") != "P", F.col("o_custkey") % 9 == 0)


@query("rev_16_grade", _GRADE)
def grade(spark, d):
    return _graded(spark, d)


@query("rev_17_exact_bound")
def exact_bound(spark, d):
    return _graded(spark, d).select("dimension", "value", "wrong", "read", R.upper_bound(F.col("wrong"), F.col("read")).alias("bound"))


@query("rev_18_pooled")
def pooled(spark, d):
    return R.pooled(_graded(spark, d), "dimension")


@query("rev_19_suggestions", "with n as (select l_orderkey as item, l_suppkey % 4 as author, arg_max(l_returnflag, (l_shipdate, l_linenumber)) as v, max((l_shipdate, l_linenumber)) as newest from lineitem group by 1, 2) select item, arg_max(v, (newest, author)) as shown, count(distinct v) > 1 as disagree from n group by 1")
def suggestions(spark, d):
    """Of an author's lines of one day and number the first of the table counts, as in arg_max."""
    first = (-F.col("_metadata.row_index")).alias("first")
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_suppkey") % 4).alias("author"), F.col("l_returnflag").alias("v"), F.struct("l_shipdate", "l_linenumber").alias("at"), first)
    return R.suggestions(rows, "item", "author", "v", "at", "first")


@query("rev_20_unsealed", "select o_orderkey from orders where o_orderkey not in (select o_orderkey from orders qualify row_number() over (order by sha256('s:seal:' || o_orderkey), o_orderkey) <= 50)")
def unsealed(spark, d):
    o = read(spark, d, "orders").select("o_orderkey")
    return R.unsealed(o, R.draw(o, "s", "seal", "o_orderkey", count=50), "o_orderkey")


@query("rev_21_certainty", "select o_orderpriority, count(case when o_orderkey in (select l_orderkey from lineitem where l_quantity > 48) then 1 end) as look, count(case when o_orderkey not in (select l_orderkey from lineitem where l_quantity > 48) then 1 end) as sure from orders group by 1")
def certainty(spark, d):
    return R.certainty(read(spark, d, "orders"), "o_orderpriority", _lines(spark, d).filter("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("rev_22_agreement", "with p as (select l_orderkey, count(distinct l_returnflag) as v, count(*) as n from lineitem group by 1) select (select count(*) from p) as items, (select count(*) from p where v = 1 and n > 1) as agreed, count(*) as answers, round(median(l_quantity), 6) as median, quantile_disc(l_quantity, 0.9) as p90 from lineitem")
def agreement(spark, d):
    return R.agreement(_lines(spark, d), "l_orderkey", "l_returnflag", "l_quantity")


@query("rev_23_error_budget", "select ceil(0.01 * (select count(*) from orders where o_totalprice > 50000) + 0.02 * (select count(*) from orders where o_orderstatus = 'O') - 1e-9)::bigint as budget")
def error_budget(spark, d):
    o = read(spark, d, "orders")
    bounds = spark.createDataFrame([("price", 0.01), ("status", 0.02)], "axis string, bound double")
    entering = reduce(lambda a, b: a.union(b), [o.filter(c).agg(F.lit(n).alias("axis"), F.count(F.lit(1)).alias("rows")) for n, c in (("price", "o_totalprice > 50000"), ("status", "o_orderstatus = 'O'"))])
    return R.error_budget(bounds, entering, "axis")


_YIELD = [("all", "true"), ("large", "o_totalprice > 100000"), ("open", "o_totalprice > 100000 and o_orderstatus = 'O'")]


@query("rev_24_yield_funnel", " union all ".join(f"select coalesce(yr::varchar, 'total') as value, '{n}' as step, count(*) as rows, count(distinct o_custkey) as subjects from (select *, year(o_orderdate) as yr from orders) where {c} group by grouping sets ((yr), ()) having count(*) > 0" for n, c in _YIELD))
def yield_funnel(spark, d):
    o = read(spark, d, "orders").withColumn("yr", F.year("o_orderdate"))
    return R.yield_funnel(o, "o_custkey", "yr", {"large": F.col("o_totalprice") > 100000, "open": F.col("o_orderstatus") == "O"})


@query("rev_25_certificate")
def certificate(spark, d):
    return R.certificate(_graded(spark, d).select("dimension", "value", "wrong", "read"), 0.05, {"1-URGENT": 0.5})


@query("rev_26_waiting", "with p as (select median(l_quantity) as pace from lineitem where l_linestatus = 'F') select o_orderpriority, o_orderstatus, count(distinct o_orderkey) as units, round(count(distinct o_orderkey) * any_value(pace), 6)::double as seconds from orders, p where o_totalprice > 150000 group by 1, 2")
def waiting(spark, d):
    pace = R.pace(_lines(spark, d).withColumn("closed", F.col("l_linestatus") == "F"), "l_quantity")
    return R.waiting(read(spark, d, "orders").filter("o_totalprice > 150000"), ["o_orderpriority", "o_orderstatus"], "o_orderkey", pace)
