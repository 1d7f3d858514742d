"""Set primitives over customers, orders, lines and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import sets as S
from corvane.plans.grains import read, retail

from .base import query

_MEMBERS = """members as (select c_custkey, c_nationkey as cohort, case when c_custkey % 7 = 0 then date '2000-01-01' end as left_at from customer
  union all select c_custkey, (c_nationkey + 1) % 25, case when c_custkey % 5 = 0 then date '2001-01-01' end from customer where c_custkey % 3 = 0)"""


def _members(spark, d):
    c = read(spark, d, "customer")
    one = c.select("c_custkey", F.col("c_nationkey").alias("cohort"), F.when(F.col("c_custkey") % 7 == 0, F.lit("2000-01-01").cast("date")).alias("left_at"))
    two = c.filter("c_custkey % 3 = 0").select("c_custkey", ((F.col("c_nationkey") + 1) % 25).alias("cohort"), F.when(F.col("c_custkey") % 5 == 0, F.lit("2001-01-01").cast("date")).alias("left_at"))
    return one.union(two)


def _orders(spark, d):
    return retail(spark, d).scan("session").drop("o_orderdate")


@query("src_1_grain_scan", "select l_orderkey * 8 + l_linenumber as line_key, l_orderkey, cast(l_shipdate as date) as day, l_returnflag, l_quantity from lineitem where l_quantity > 0")
def grain_scan(spark, d):
    return retail(spark, d).scan("unit", "l_returnflag", "l_quantity")


@query("set_1_from_handle", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def from_handle(spark, d):
    frozen = _orders(spark, d).filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return S.among(read(spark, d, "customer"), frozen, "c_custkey").select("c_custkey", "c_name")


@query("set_2_of", "select o_orderkey, o_custkey, c_mktsegment as segment from orders join customer on c_custkey = o_custkey where c_acctbal > 5000")
def of_ancestor(spark, d):
    rich = read(spark, d, "customer").filter("c_acctbal > 5000")
    return S.of(_orders(spark, d), rich, "o_custkey", "c_custkey", {"c_mktsegment": "segment"}).select("o_orderkey", "o_custkey", "segment")


@query("set_3_of_cohort", f"with {_MEMBERS} select c_custkey, c_nationkey from customer where c_custkey in (select c_custkey from members join nation on cohort = n_nationkey where left_at is null and n_regionkey in (1, 2))")
def of_cohort(spark, d):
    cohorts = read(spark, d, "nation").filter("n_regionkey in (1, 2)").select(F.col("n_nationkey").alias("cohort"))
    return S.in_cohorts(read(spark, d, "customer"), _members(spark, d), cohorts, "c_custkey", "cohort", "left_at").select("c_custkey", "c_nationkey")


@query("set_4_union", "select distinct c_custkey, c_nationkey, c_acctbal from (select c_custkey, c_nationkey, c_acctbal from customer where c_acctbal > 0 union all select c_custkey, c_nationkey, null from customer where c_nationkey < 5)")
def union(spark, d):
    c = read(spark, d, "customer")
    return S.union(c.filter("c_acctbal > 0").select("c_custkey", "c_nationkey", "c_acctbal"), c.filter("c_nationkey < 5").select("c_custkey", "c_nationkey"))


@query("set_5_union_tag", "select o_orderkey, 'large' as part from orders where o_totalprice > 200000 union all select o_orderkey, 'open' from orders where o_orderstatus = 'O'")
def union_tag(spark, d):
    o = _orders(spark, d)
    return S.union_tag("part", {"large": o.filter("o_totalprice > 200000").select("o_orderkey"), "open": o.filter("o_orderstatus = 'O'").select("o_orderkey")})


@query("set_6_intersect_except", "select o_orderkey, o_totalprice from orders where o_totalprice > 100000 and o_orderstatus = 'O' and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def intersect_except(spark, d):
    o = _orders(spark, d)
    both = S.intersect("o_orderkey", o.filter("o_totalprice > 100000").select("o_orderkey", "o_totalprice"), o.filter("o_orderstatus = 'O'"))
    return S.except_("o_orderkey", both, read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")))


@query("set_7_where_8_bind", "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) as gross from lineitem where l_extendedprice * (1 - l_discount) > 40000")
def where_bind(spark, d):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = S.bind(read(spark, d, "lineitem"), {"net": net, "gross": F.col("net") * (1 + F.col("l_tax"))}).filter("net > 40000")
    return rows.select("l_orderkey", "l_linenumber", F.round("net", 4).alias("net"), F.round("gross", 6).alias("gross"))


@query("set_9_group", """select c_nationkey, c_mktsegment, count(*) as _rows, count(distinct c_custkey) as _subjects, row_number() over (order by c_nationkey nulls last, c_mktsegment nulls last) as _group, round(avg(c_acctbal), 6) as mean_balance
from (select nullif(c_nationkey, 3) as c_nationkey, c_mktsegment, c_custkey, c_acctbal from customer) group by 1, 2""")
def group(spark, d):
    c = read(spark, d, "customer").withColumn("c_nationkey", F.nullif("c_nationkey", F.lit(3)))
    return S.group(c, ["c_nationkey", "c_mktsegment"], "c_custkey", mean_balance=F.round(F.avg("c_acctbal"), 6))


@query("set_10_group_list", """with l as (select o.o_orderkey, o.o_custkey, string_agg(distinct l_returnflag, ',' order by l_returnflag) as flags from orders o left join lineitem on l_orderkey = o_orderkey group by 1, 2)
select flags, count(*) as _rows, count(distinct o_custkey) as _subjects, row_number() over (order by flags nulls last) as _group from l group by flags""")
def group_list(spark, d):
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return S.group(S.as_list(_orders(spark, d), lines, "o_orderkey", "l_returnflag", "flags"), ["flags"], "o_custkey")


@query("set_10_group_each", """select l_returnflag as flag, count(*) as _rows, count(distinct o_custkey) as _subjects, row_number() over (order by l_returnflag nulls last) as _group
from (select distinct o_orderkey, o_custkey, l_returnflag from orders left join lineitem on l_orderkey = o_orderkey) group by 1""")
def group_each(spark, d):
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return S.group(S.each(_orders(spark, d), lines, "o_orderkey", "l_returnflag", "flag"), ["flag"], "o_custkey")


@query("set_11_having_12_totals", "select o_custkey, count(*) as _rows, count(distinct o_custkey) as _subjects, row_number() over (order by o_custkey nulls last) as _group, max(o_totalprice) as hi, min(o_totalprice) as lo, round(max(o_totalprice) - min(o_totalprice), 4) as spread from orders group by o_custkey qualify max(o_totalprice) - min(o_totalprice) > 100000")
def having_totals(spark, d):
    g = S.group(_orders(spark, d), ["o_custkey"], "o_custkey", hi=F.max("o_totalprice"), lo=F.min("o_totalprice"))
    return S.bind(g, {"spread": F.round(F.col("hi") - F.col("lo"), 4)}).filter("spread > 100000")


@query("set_13_group_count", "with g as (select o_orderpriority, o_orderstatus from orders group by all having avg(o_totalprice) > 150000) select (select count(*) from g) as groups, (select count(distinct o_custkey) from orders where (o_orderpriority, o_orderstatus) in (select (o_orderpriority, o_orderstatus) from g)) as subjects")
def group_count(spark, d):
    return S.group_members(_orders(spark, d), ["o_orderpriority", "o_orderstatus"], "o_custkey", F.col("mean") > 150000, mean=F.avg("o_totalprice"))[1]


@query("set_14_cross_set_aggregate", "select c_custkey, coalesce(n, 0) as n_orders, hi, coalesce(k, 0) as n_status, round(total, 2) as total from customer left join (select o_custkey, count(*) as n, max(o_totalprice) as hi, count(distinct o_orderstatus) as k, sum(o_totalprice) as total from orders group by 1) on o_custkey = c_custkey")
def cross_set(spark, d):
    out = S.linked(read(spark, d, "customer").select("c_custkey"), _orders(spark, d), "c_custkey", "o_custkey", n_orders=F.count(F.lit(1)), hi=F.max("o_totalprice"), n_status=F.countDistinct("o_orderstatus"), total=F.sum("o_totalprice"))
    return out.withColumn("total", F.round("total", 2))


@query("set_15_list_aggregate", "select o_custkey, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as priorities from orders group by 1")
def list_aggregate(spark, d):
    return _orders(spark, d).groupBy("o_custkey").agg(S.listed(F.col("o_orderpriority")).alias("priorities"))


@query("set_16_attach", "select c_custkey, o_orderkey as top_o_orderkey, o_totalprice as top_o_totalprice from customer left join (select * from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1) on o_custkey = c_custkey")
def attach(spark, d):
    top = S.pick(_orders(spark, d), "o_custkey", [F.desc("o_totalprice")], "o_orderkey").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return S.attach(read(spark, d, "customer").select("c_custkey"), top, "c_custkey", "top", optional=True)


@query("set_17_has", "select c_custkey, coalesce(n, 0) as n_open from customer left join (select o_custkey, count(*) as n from orders where o_orderstatus = 'O' group by 1) on o_custkey = c_custkey where coalesce(n, 0) between 2 and 5 and c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT') and c_custkey not in (select o_custkey from orders where o_totalprice > 400000)")
def has(spark, d):
    o, c = _orders(spark, d), read(spark, d, "customer").select("c_custkey")
    out = S.has(c, o.filter("o_orderstatus = 'O'"), "c_custkey", "o_custkey", 2, 5, "n_open")
    out = S.has(out, o.filter("o_orderpriority = '1-URGENT'"), "c_custkey", "o_custkey")
    return S.has(out, o.filter("o_totalprice > 400000"), "c_custkey", "o_custkey", 0, 0)


_HAS_WITHIN = "select a.o_orderkey, count(b.o_orderkey) as n_near from orders a left join orders b on a.o_custkey = b.o_custkey and datediff('day', cast(a.o_orderdate as date), cast(b.o_orderdate as date)) between 1 and 90 group by 1"


@query("set_18_has_within", _HAS_WITHIN)
def has_within(spark, d):
    o = _orders(spark, d)
    return S.has_within(o.select("o_orderkey", "o_custkey", "day"), o, "o_orderkey", "o_custkey", "day", "day", 1, 90, "n_near").select("o_orderkey", "n_near")


@query("set_18_has_within_bucketed", _HAS_WITHIN)
def has_within_bucketed(spark, d):
    o = _orders(spark, d)
    return S.has_within(o.select("o_orderkey", "o_custkey", "day"), o, "o_orderkey", "o_custkey", "day", "day", 1, 90, "n_near").select("o_orderkey", "n_near")


def _near_sql(order: str, window: str, join: str = "join") -> str:
    return f"""with e as (select event_id, user_id, event_type, value, cast(ts as date) as day from events),
c as (select a.event_id, b.event_id as near_key, b.day as near_date, datediff('day', a.day, b.day) as near_offset, b.value as v, count(*) over (partition by a.event_id) as near_candidates, rank() over (partition by a.event_id order by {order}) as r
  from e a join e b on a.user_id = b.user_id and b.event_type = 'purchase' and {window} where a.event_type = 'error'),
p as (select *, count(*) over (partition by event_id, r) > 1 as near_tied from c qualify row_number() over (partition by event_id order by r, near_key) = 1)
select a.event_id, p.near_key, p.near_date, p.near_offset::int as near_offset, p.near_tied, p.near_candidates from e a {join} p on p.event_id = a.event_id where a.event_type = 'error'"""


def _near(spark, d, **how):
    e = retail(spark, d).scan("event")
    out = S.near(e.filter("event_type = 'error'").select("event_id", "user_id", "day"), e.filter("event_type = 'purchase'"), key="event_id", subject="user_id", day="day", partner_key="event_id", partner_day="day", **how)
    return out.select("event_id", "near_key", "near_date", "near_offset", "near_tied", "near_candidates")


_FIVE = "datediff('day', a.day, b.day) between -5 and 5"


@query("set_19_near_20_nearest", _near_sql("abs(datediff('day', a.day, b.day)), b.day", _FIVE))
def near_nearest(spark, d):
    return _near(spark, d, lo=-5, hi=5)


@query("set_19_near_bucketed", _near_sql("abs(datediff('day', a.day, b.day)), b.day desc", _FIVE))
def near_bucketed(spark, d):
    return _near(spark, d, lo=-5, hi=5, tie="later", bucket=5)


@query("set_21_near_first_26_unbounded", _near_sql("b.day", "datediff('day', a.day, b.day) >= 0"))
def near_first(spark, d):
    return _near(spark, d, lo=0, hi=None, policy="first")


@query("set_21_near_last_23_optional", _near_sql("b.day desc", "datediff('day', a.day, b.day) between -1 and 0", "left join"))
def near_last(spark, d):
    return _near(spark, d, lo=-1, hi=0, policy="last", optional=True)


@query("set_22_near_best", _near_sql("b.value desc", _FIVE))
def near_best(spark, d):
    return _near(spark, d, lo=-5, hi=5, policy="best", best=[("value", True)])


def _coarse_sql(inside: str) -> str:
    return f"""with o as (select o_orderkey, o_custkey, cast(o_orderdate as date) as day, case o_orderkey % 3 when 0 then 'day' when 1 then 'month' else 'year' end as prec from orders),
b as (select *, case prec when 'day' then day when 'month' then date_trunc('month', day)::date else date_trunc('year', day)::date end as lo, case prec when 'day' then day when 'month' then last_day(day) else make_date(year(day), 12, 31) end as hi from o where o_orderkey % 2 = 1),
c as (select a.o_orderkey, b.o_orderkey as near_key, case when datediff('day', a.day, b.lo) > 0 then datediff('day', a.day, b.lo) when datediff('day', a.day, b.hi) < 0 then datediff('day', a.day, b.hi) else 0 end as near_offset, b.day
  from o a join b on a.o_custkey = b.o_custkey and {inside} where a.o_orderkey % 2 = 0)
select o_orderkey, near_key, near_offset::int as near_offset, n as near_candidates from (select *, count(*) over (partition by o_orderkey) as n from c) qualify row_number() over (partition by o_orderkey order by abs(near_offset), day, near_key) = 1"""


def _coarse(spark, d, strict):
    o = _orders(spark, d).withColumn("prec", F.when(F.col("o_orderkey") % 3 == 0, "day").when(F.col("o_orderkey") % 3 == 1, "month").otherwise("year"))
    out = S.near(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), key="o_orderkey", subject="o_custkey", day="day", partner_key="o_orderkey", partner_day="day", lo=-200, hi=200, precision="prec", strict=strict)
    return out.select("o_orderkey", "near_key", "near_offset", "near_candidates")


@query("set_24_near_forgiving_25_edge_offset", _coarse_sql("datediff('day', a.day, b.hi) >= -200 and datediff('day', a.day, b.lo) <= 200"))
def near_forgiving(spark, d):
    return _coarse(spark, d, False)


@query("set_24_near_strict", _coarse_sql("datediff('day', a.day, b.lo) >= -200 and datediff('day', a.day, b.hi) <= 200"))
def near_strict(spark, d):
    return _coarse(spark, d, True)


_PICK = "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderpriority, o_orderkey)::int as pick_rank, count(*) over (partition by o_custkey) as pick_candidates, count(*) over (partition by o_custkey, o_orderpriority) > 1 as pick_tied from orders qualify pick_rank <= 2"


@query("set_27_pick", _PICK)
def pick(spark, d):
    return S.pick(_orders(spark, d), "o_custkey", [F.asc("o_orderpriority")], "o_orderkey", 2).select("o_custkey", "o_orderkey", "pick_rank", "pick_candidates", "pick_tied")


@query("set_27_pick_refuse_ties", f"select * from ({_PICK}) where not pick_tied")
def pick_refuse(spark, d):
    return S.pick(_orders(spark, d), "o_custkey", [F.asc("o_orderpriority")], "o_orderkey", 2, "refuse").select("o_custkey", "o_orderkey", "pick_rank", "pick_candidates", "pick_tied")


@query("set_28_same", "select o_custkey as c_custkey, max(n) as same_largest, count(*) as same_groups from (select o_custkey, o_orderstatus, o_orderpriority, count(*) as n from orders group by all) group by 1 having max(n) >= 2")
def same(spark, d):
    return S.same(read(spark, d, "customer").select("c_custkey"), _orders(spark, d), "c_custkey", "o_custkey", ["o_orderstatus", "o_orderpriority"], 2)


@query("set_29_every", "select c_custkey from customer where c_custkey in (select o_custkey from orders) and c_custkey not in (select o_custkey from orders where o_totalprice <= 50000)")
def every(spark, d):
    o = _orders(spark, d)
    return S.every(read(spark, d, "customer").select("c_custkey"), o, o.filter("o_totalprice > 50000"), "c_custkey", "o_custkey", "o_orderkey")


@query("set_30_pairs", """with o as (select o_orderkey, o_custkey, cast(o_orderdate as date) as day from orders),
c as (select a.o_orderkey, b.o_orderkey as later_key, datediff('day', a.day, b.day)::int as later_offset, b.day from o a join o b on a.o_custkey = b.o_custkey and datediff('day', a.day, b.day) between 1 and 365)
select o_orderkey, later_key, later_offset from c qualify row_number() over (partition by o_orderkey order by later_offset, later_key) = 1""")
def pairs(spark, d):
    return S.pairs(_orders(spark, d), "o_orderkey", "o_custkey", "day", 1, 365).select("o_orderkey", "later_key", "later_offset")


def _change_sql(cond: str) -> str:
    return f"""with o as (select o_custkey, o_orderkey, cast(o_orderdate as date) as day, o_orderstatus as s from orders),
w as (select *, {cond} as from_date from o window w as (partition by o_custkey order by day nulls last, o_orderkey)),
h as (select * from w where s = 'F' and from_date is not null qualify row_number() over (partition by o_custkey order by day, o_orderkey) = 1)
select o_custkey, day as to_date, o_orderkey as to_key, from_date, datediff('day', from_date, day)::int as gap_days from h"""


@query("set_31_change_adjacent", _change_sql("case when lag(s) over w = 'O' then lag(day) over w end"))
def change_adjacent(spark, d):
    return S.change(_orders(spark, d), "o_custkey", "day", "o_orderkey", "o_orderstatus", "O", "F")


@query("set_31_change_any", "with o as (select o_custkey, o_orderkey, cast(o_orderdate as date) as day, o_orderstatus as s from orders), w as (select *, max(case when s = 'O' then day end) over (partition by o_custkey order by day nulls last, o_orderkey rows between unbounded preceding and 1 preceding) as from_date from o), h as (select * from w where s = 'F' and from_date is not null qualify row_number() over (partition by o_custkey order by day, o_orderkey) = 1) select o_custkey, day as to_date, o_orderkey as to_key, from_date, datediff('day', from_date, day)::int as gap_days from h")
def change_any(spark, d):
    return S.change(_orders(spark, d), "o_custkey", "day", "o_orderkey", "o_orderstatus", "O", "F", adjacent=False)


@query("set_32_picked", "select o_orderkey, o_totalprice from orders where o_orderkey in (select o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1)")
def picked(spark, d):
    o = _orders(spark, d)
    stored = S.pick(o, "o_custkey", [F.desc("o_totalprice")], "o_orderkey").select("o_orderkey", F.lit("largest").alias("role"))
    return S.picked(o.select("o_orderkey", "o_totalprice"), stored, "o_orderkey", "largest")


@query("set_33_pipeline", "select c_mktsegment, count(*) as n from customer where c_acctbal > 0 and c_custkey in (select o_custkey from orders where o_orderstatus = 'P') group by 1")
def pipeline(spark, d):
    o = _orders(spark, d).filter("o_orderstatus = 'P'")
    return S.pipeline(read(spark, d, "customer"), lambda x: x.filter("c_acctbal > 0"), lambda x: S.has(x, o, "c_custkey", "o_custkey"), lambda x: x.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")))


@query("set_34_parameters", "select o_orderkey, o_totalprice from orders where o_totalprice >= 250000 and o_orderpriority = '2-HIGH'")
def parameters(spark, d):
    return spark.sql("select o_orderkey, o_totalprice from {orders} where o_totalprice >= :least and o_orderpriority = :priority", args={"least": 250000.0, "priority": "2-HIGH"}, orders=read(spark, d, "orders"))


@query("set_35_keep", "select 'customers' as name, count(*) as rows, count(distinct c_custkey) as subjects from customer where c_acctbal > 0 union all select 'orders', count(*), count(distinct o_custkey) from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0)")
def keep(spark, d):
    rich = read(spark, d, "customer").filter("c_acctbal > 0")
    kept = {"customers": (rich, "c_custkey"), "orders": (S.of(_orders(spark, d), rich, "o_custkey", "c_custkey"), "o_custkey")}
    return S.union_tag("name", {n: df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(s).alias("subjects")) for n, (df, s) in kept.items()})


@query("flagship_demographics", "select n_name, count(distinct c_custkey) as customers, round(count(distinct c_custkey) / (select count(distinct c_custkey) from customer), 9) as share, round(avg(c_acctbal), 6) as mean, min(c_acctbal) as lo, max(c_acctbal) as hi from customer join nation on n_nationkey = c_nationkey group by 1")
def demographics(spark, d):
    m = retail(spark, d)
    rows = S.of(m.scan("subject", "c_acctbal"), m.scan("cohort", "n_name"), "c_nationkey", "n_nationkey", {"n_name": "n_name"})
    all_ = rows.agg(F.countDistinct("c_custkey").alias("m"))
    per = rows.groupBy("n_name").agg(F.countDistinct("c_custkey").alias("customers"), F.round(F.avg("c_acctbal"), 6).alias("mean"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    return per.crossJoin(F.broadcast(all_)).select("n_name", "customers", F.round(F.try_divide(F.col("customers").cast("double"), F.col("m")), 9).alias("share"), "mean", "lo", "hi")
