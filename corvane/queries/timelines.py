"""Sessions and time lines of customers' orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import dates as DT
from corvane.operators import sets as S
from corvane.operators import timelines as T
from corvane.plans.grains import read, retail

from .base import query


def _orders(spark, d):
    return retail(spark, d).scan("session").drop("o_orderdate")


#: Bounded sessions of 60 days as a recursive query: the next session starts at the first day past the window.
_SESSIONS = """days as (select o_custkey, cast(o_orderdate as date) as day, count(*) as n from orders group by all),
heads as (select o_custkey, min(day) as f from days group by 1 union all
  select h.o_custkey, (select min(x.day) from days x where x.o_custkey = h.o_custkey and datediff('day', h.f, x.day) > 60) from heads h where exists (select 1 from days x where x.o_custkey = h.o_custkey and datediff('day', h.f, x.day) > 60)),
spans as (select o_custkey, f, lead(f) over (partition by o_custkey order by f) as g from heads),
s as (select d.o_custkey, f as session_first, max(day) as session_last, sum(n)::bigint as n from days d join spans p on p.o_custkey = d.o_custkey and d.day >= f and (g is null or d.day < g) group by 1, 2)"""


def _sessions(spark, d):
    return T.sessions(_orders(spark, d), "o_custkey", "day", 60)


@query("time_1_bounded_sessions", f"with recursive {_SESSIONS} select * from s")
def bounded(spark, d):
    return _sessions(spark, d)


@query("time_2_three_valued", "select o_custkey, case when bool_or(f) then true when count(case when f is null then 1 end) > 0 then null else false end as flag from (select o_custkey, case when o_orderstatus = 'P' then null else o_totalprice > 300000 end as f from orders) group by 1")
def three_valued(spark, d):
    flag = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") > 300000)
    return _orders(spark, d).withColumn("f", flag).groupBy("o_custkey").agg(T.any_yes(F.col("f")).alias("flag"))


@query("time_3_names", f"with recursive {_SESSIONS} select o_custkey, session_first, strftime(session_first, '%Y%m%d') as by_date, lpad((row_number() over (partition by o_custkey order by session_first))::varchar, 2, '0') as by_place from s")
def names(spark, d):
    return T.named(_sessions(spark, d), "o_custkey", "session_first").select("o_custkey", "session_first", "by_date", "by_place")


_CADENCE = f"""{_SESSIONS}, a as (select o_custkey, min(session_first) + 30 as anchor from s group by 1),
b as (select s.o_custkey, session_first, anchor, least(anchor, session_first) as lo, greatest(anchor, session_first) as hi from s join a using (o_custkey)),
w as (select *, ((year(hi) * 12 + month(hi)) - (year(lo) * 12 + month(lo)))::int as r from b),
v as (select *, r - ((lo + to_months(r))::date > hi)::int as k from w),
m as (select o_custkey, session_first, (case when session_first < anchor then -1 else 1 end) * (k + datediff('day', (lo + to_months(k))::date, hi) / 30.44::double) as months from v),
p as (select o_custkey, session_first, months, round(abs(months))::int as month, (select min((abs(c - months), c)) from (values (0), (6), (12), (18), (24), (36), (48), (60), (72)) v(c)) as b from m)"""


@query("time_4_cadence", f"with recursive {_CADENCE} select o_custkey, session_first, round(months, 4) as months, case when months < 0 and month <> 0 then null when month = 0 then 0 when b[1] <= 1.5 then b[2]::int end as point, case when months < 0 and month <> 0 then 'PRE' || lpad(month::varchar, 2, '0') when month = 0 then 'M00' when b[1] <= 1.5 then 'M' || lpad(b[2]::varchar, 2, '0') else 'M' || lpad(month::varchar, 2, '0') end as label from p")
def cadence(spark, d):
    s = _sessions(spark, d)
    rows = s.join(T.anchors(s, "o_custkey", "session_first"), "o_custkey").withColumn("anchor", F.date_add("anchor", 30))
    return T.cadence_names(rows, "session_first", "anchor", [0, 6, 12, 18, 24, 36, 48, 60, 72], 1.5).select("o_custkey", "session_first", "months", "point", "label")


@query("time_5_anchors", f"with recursive {_SESSIONS} select c.o_custkey, coalesce(case when c.o_custkey % 50 = 0 then date '1996-01-01' end, e, c.f) as anchor from (select o_custkey, min(session_first) as f from s group by 1) c left join (select o_custkey, min(cast(o_orderdate as date)) as e from orders where o_orderstatus = 'P' group by 1) x on x.o_custkey = c.o_custkey")
def anchors(spark, d):
    o = _orders(spark, d)
    explicit = read(spark, d, "customer").filter("c_custkey % 50 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("1996-01-01").cast("date").alias("anchor"))
    return T.anchors(_sessions(spark, d), "o_custkey", "session_first", o.filter("o_orderstatus = 'P'"), "day", explicit)


@query("time_6_source_labels", "with p as (select page_id % 40 as site, nullif(regexp_extract(split_part(url, '/', 4), '([a-z]+)', 1), '') as l from pages) select site, case when min(l) = max(l) then min(l) end as label, min(l) <> max(l) as flagged from p group by 1")
def source_labels(spark, d):
    return T.source_labels(read(spark, d, "pages").withColumn("site", F.col("page_id") % 40), "site", "url", 3, "([a-z]+)")


def _exact(spark, d):
    s = _sessions(spark, d)
    rows = s.join(T.anchors(s, "o_custkey", "session_first"), "o_custkey").withColumn("anchor", F.date_add("anchor", 30))
    return rows.select("o_custkey", "session_first", F.round(T.months_exact(F.col("anchor"), F.col("session_first")), 6).alias("months"))


# sessions that share a month's label: three policies that no order of demotion decides
_SETTLE = f"""{_CADENCE}, g as (select o_custkey, session_first, round(months, 6) as months, month, b[1] as gap, b[2]::int as pt from p),
q as (select *, case when months < 0 and month <> 0 then 'PRE' || lpad(month::varchar, 2, '0') when month = 0 then 'M00' when gap <= 3.5 then 'M' || lpad(pt::varchar, 2, '0') else 'M' || lpad(month::varchar, 2, '0') end as want from g),
n as (select *, count(*) over (partition by o_custkey, want) as n from q)"""


@query("time_7_settle_date", f"with recursive {_SETTLE} select o_custkey, session_first, round(months, 4) as months, case when n = 1 then want end as label, n > 1 as flagged from n")
def settle_date(spark, d):
    return T.settle(_exact(spark, d), "o_custkey", "session_first", "months", [0, 6, 12, 18, 24, 36, 48, 60, 72], 3.5, "date", relax=False).withColumn("months", F.round("months", 4))


@query("time_7_settle_merge", f"with recursive {_SETTLE} select o_custkey, session_first, round(months, 4) as months, want as label, false as flagged from n")
def settle_merge(spark, d):
    return T.settle(_exact(spark, d), "o_custkey", "session_first", "months", [0, 6, 12, 18, 24, 36, 48, 60, 72], 3.5, "merge", relax=False).withColumn("months", F.round("months", 4))


@query("time_7_settle")
def settle(spark, d):
    return T.settle(_exact(spark, d), "o_custkey", "session_first", "months", [0, 6, 12, 18, 24, 36, 48, 60, 72], 3.5, "suffix")


@query("time_8_refresh", f"with recursive {_SESSIONS} select * from s")
def refreshed(spark, d):
    o = _orders(spark, d)
    before = o.filter("not (o_custkey % 97 = 0 and o_orderkey % 2 = 0)")
    old, old_digests = T.sessions(before, "o_custkey", "day", 60), T.digest(before, "o_custkey", "o_custkey", "day")
    return T.refresh(old, old_digests, o, "o_custkey", "day", 60)[0]


@query("time_8_refresh_states", "select o_custkey, case when count(case when not (o_custkey % 97 = 0 and o_orderkey % 2 = 0) then 1 end) = 0 then 'new' else 'changed' end as state from orders group by 1 having count(case when o_custkey % 97 = 0 and o_orderkey % 2 = 0 then 1 end) > 0")
def refresh_states(spark, d):
    o = _orders(spark, d)
    before = o.filter("not (o_custkey % 97 = 0 and o_orderkey % 2 = 0)")
    return T.refresh(T.sessions(before, "o_custkey", "day", 60), T.digest(before, "o_custkey", "o_custkey", "day"), o, "o_custkey", "day", 60)[1]


@query("time_9_nearest_event", """with e as (select event_id, user_id, cast(ts as date) as day from events where event_type = 'signup'), v as (select event_id, user_id, cast(ts as date) as day from events where event_type = 'view')
select v.event_id, e.event_id as near_key, datediff('day', v.day, e.day)::int as near_offset from v join e using (user_id) qualify row_number() over (partition by v.event_id order by abs(datediff('day', v.day, e.day)), e.day, e.event_id) = 1""")
def nearest_event(spark, d):
    e = retail(spark, d).scan("event")
    out = S.near(e.filter("event_type = 'view'").select("event_id", "user_id", "day"), e.filter("event_type = 'signup'"), key="event_id", subject="user_id", day="day", partner_key="event_id", partner_day="day", lo=None, hi=None)
    return out.select("event_id", "near_key", "near_offset")


_VOTE = """with c as (select l_orderkey, case when l_suppkey % 4 = 0 then date_trunc('year', l_shipdate)::date else cast(l_shipdate as date) end as day, 1.0 + l_linenumber % 2 as w from lineitem union all select o_orderkey, cast(o_orderdate as date), 2.5 from orders union all select o_orderkey, date '1900-01-01', 9.0 from orders),
s as (select l_orderkey, day, round(sum(w), 9)::double as w, month(day) = 1 and day(day) = 1 as new_year from c where day <> date '1900-01-01' group by 1, 2),
b as (select * from s qualify row_number() over (partition by l_orderkey order by new_year, w desc, day) = 1)
select b.l_orderkey, b.day as voted, b.w as weight, round(b.w - coalesce((select max(s.w) from s where s.l_orderkey = b.l_orderkey and s.day <> b.day), 0), 9) as margin from b"""


@query("time_10_date_vote", _VOTE)
def date_vote(spark, d):
    lines = read(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_suppkey") % 4 == 0, F.trunc("l_shipdate", "year")).otherwise(F.to_date("l_shipdate")).alias("day"), (F.lit(1.0) + F.col("l_linenumber") % 2).alias("w"))
    o = _orders(spark, d)
    c = lines.union(o.select("o_orderkey", "day", F.lit(2.5))).union(o.select("o_orderkey", F.lit("1900-01-01").cast("date"), F.lit(9.0)))
    return T.vote_dates(c, "l_orderkey", "day", "w")


_MINED = """with d as (select *, cast(l_shipdate as date) as day from lineitem),
t as (select l_orderkey, case l_linenumber % 3 when 0 then strftime(day, '%Y%m%d') when 1 then '00000000' else strftime(day, '%Y-01-01') end as value, '1.2.840.' || l_suppkey || '.' || strftime(day - (l_partkey % 3)::int, '%Y%m%d') || '.' || ((day - date '1970-01-01') * 86400::bigint + 3600 * (l_partkey % 40)) || '.' || (19900000 + l_partkey * 7 % 90000) as uid, '/in/' || strftime(day + 9, '%Y%m%d') || '/' || strftime(day, '%Y%m%d') || l_linenumber as path from d),
r as (select l_orderkey, value, regexp_extract_all(uid, '[0-9]+') as u, regexp_extract_all(path, '[0-9]+') as p from t),
c as (select l_orderkey, try_strptime(replace(value, '-', ''), '%Y%m%d')::date as day, 'stated' as source, 4.0 as w from r union all
select l_orderkey, try_strptime(x, '%Y%m%d')::date, 'uid', 1.0 from (select l_orderkey, unnest(u) as x from r) where length(x) = 8 union all
select l_orderkey, to_timestamp(x::bigint)::date, 'uid_epoch', 1.0 from (select l_orderkey, unnest(u) as x from r) where length(x) = 10 union all
select l_orderkey, try_strptime(x, '%Y%m%d')::date, 'path', 2.0 from (select l_orderkey, unnest(p) as x from r) where length(x) = 8),
s as (select l_orderkey, day, sum(w)::double as w, first(source order by w desc, source) as source, month(day) = 1 and day(day) = 1 as new_year from c where year(day) between 1980 and 2100 group by 1, 2),
b as (select * from s qualify row_number() over (partition by l_orderkey order by new_year, w desc, day) = 1)
select b.l_orderkey, b.day as voted, b.w as weight, b.w - coalesce((select max(s.w) from s where s.l_orderkey = b.l_orderkey and s.day <> b.day), 0) as margin, b.source from b"""


@query("time_10_mined_dates", _MINED)
def mined_dates(spark, d):
    rows = read(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    digits = lambda c: F.date_format(c, "yyyyMMdd")
    third, part = F.col("l_linenumber") % 3, F.col("l_partkey")
    value = F.when(third == 0, digits("day")).when(third == 1, "00000000").otherwise(F.date_format("day", "yyyy-01-01"))
    seconds = F.unix_date("day").cast("long") * 86400 + 3600 * (part % 40)
    uid = F.concat_ws(".", F.lit("1.2.840"), "l_suppkey", digits(F.date_sub("day", (part % 3).cast("int"))), seconds, 19900000 + part * 7 % 90000)
    path = F.concat(F.lit("/in/"), digits(F.date_add("day", 9)), F.lit("/"), digits("day"), "l_linenumber")
    readings = [DT.Reading("stated", 4, value), DT.Reading("uid", 1, uid, "days"), DT.Reading("uid_epoch", 1, uid, "epochs"), DT.Reading("path", 2, path, "days")]
    return T.vote_dates(DT.candidates(rows, "l_orderkey", readings), "l_orderkey", "day", "weight", source="source")


@query("time_11_history", "select *, (row_number() over (partition by object order by day nulls last, kind))::int as place from (select o_orderkey as object, cast(o_orderdate as date) as day, 'ordered' as kind from orders union all select l_orderkey, cast(l_shipdate as date), 'shipped' from lineitem)")
def history(spark, d):
    m = retail(spark, d)
    return T.history({"ordered": (m.scan("session"), "o_orderkey", "day"), "shipped": (m.scan("unit"), "l_orderkey", "day")})


_FEED = "with r as (select c_nationkey as cohort, o_custkey, cast(o_orderdate as date) as day, bool_or(o_orderstatus <> 'F') as joins from orders join customer on c_custkey = o_custkey group by all), w as (select *, lag(joins) over (partition by cohort, o_custkey order by day) as b from r), k as (select *, lead(day) over (partition by cohort, o_custkey order by day) as left_at from w where b is null or b <> joins), f as (select cohort, o_custkey, day as joined_at, left_at from k where joins)"


def _feed(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("cohort"))
    rows = _orders(spark, d).join(c, "o_custkey").groupBy("cohort", "o_custkey", "day").agg(F.bool_or(F.col("o_orderstatus") != "F").alias("joins"))
    return T.feed(rows, "cohort", "o_custkey")


@query("time_12_membership", f"{_FEED} select * from f")
def membership(spark, d):
    return _feed(spark, d)


@query("time_12_open_at", f"{_FEED} select cohort, count(distinct o_custkey) as members from f where joined_at <= date '1998-01-01' and (left_at is null or left_at > date '1998-01-01') group by 1")
def open_at(spark, d):
    return T.open_at(_feed(spark, d), "cohort", "o_custkey", "joined_at", "left_at", "1998-01-01")


@query("time_13_promotion", f"{_FEED} select distinct o_custkey, 3 as cohort, date '2002-01-01' as joined_at, null::date as left_at from orders where o_totalprice > 200000 and o_custkey not in (select o_custkey from f where cohort = 3 and left_at is null)")
def promotion(spark, d):
    return T.promote(_orders(spark, d).filter("o_totalprice > 200000"), _feed(spark, d), "o_custkey", 3, "2002-01-01")
