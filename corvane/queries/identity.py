"""Identity, release planning, reconciliation and summaries."""

from __future__ import annotations

import datetime as dt
from pyspark.sql import functions as F

from corvane.functions.scalars import safe_age
from corvane.operators import identity as I
from corvane.operators import reconcile as C
from corvane.operators import release as L
from corvane.operators import review as R
from corvane.plans.grains import read, retail

from .base import query


def _orders(spark, d):
    return retail(spark, d).scan("session")


@query("id_1_identity_rule", "select c_custkey, case when regexp_extract(c_name, '#0*([0-9]*[05])$', 1) <> '' then regexp_extract(c_name, '#0*([0-9]*[05])$', 1) when c_mktsegment <> 'BUILDING' then c_mktsegment else c_custkey::varchar end as id, case when regexp_extract(c_name, '#0*([0-9]*[05])$', 1) <> '' then 'c_name' when c_mktsegment <> 'BUILDING' then 'seg' else 'fallback' end as type from customer")
def identity(spark, d):
    c = read(spark, d, "customer").withColumn("seg", F.nullif("c_mktsegment", F.lit("BUILDING")))
    value, kind = I.identity([("c_name", "#0*([0-9]*[05])$"), ("seg", None)], "c_custkey")
    return c.select("c_custkey", value.alias("id"), kind.alias("type"))


@query("id_2_probe", """with r as (select c_mktsegment, 'name' as rule, coalesce(nullif(regexp_extract(c_name, '#0*([1-9][0-9]*)$', 1), ''), c_custkey::varchar) as id, regexp_extract(c_name, '#0*([1-9][0-9]*)$', 1) <> '' as ok from customer union all select c_mktsegment, 'segment', coalesce(nullif(trim(c_mktsegment), ''), c_custkey::varchar), nullif(trim(c_mktsegment), '') is not null from customer)
select c_mktsegment, rule, count(case when ok then 1 end) as answered, count(case when not ok then 1 end) as fell_through, count(distinct id) as subjects, count(distinct regexp_replace(regexp_replace(regexp_replace(id, '[0-9]', '9', 'g'), '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g')) as shapes, count(distinct id) = 1 as constant from r group by 1, 2""")
def probe(spark, d):
    return I.probe(read(spark, d, "customer").withColumn("segment", F.col("c_mktsegment")), "c_mktsegment", {"name": [("c_name", "#0*([1-9][0-9]*)$")], "segment": [("segment", None)]}, "c_custkey")


@query("id_3_keyed_code", "select c_custkey, substr(sha256('k1' || sha256('k1' || c_custkey)), 1, 16) as code from customer")
def keyed_code(spark, d):
    return read(spark, d, "customer").select("c_custkey", I.code("k1", F.col("c_custkey")).alias("code"))


@query("id_3_blake_code")
def blake_code(spark, d):
    return read(spark, d, "customer").select("c_custkey", I.blake_code("k1", F.col("c_custkey")).alias("code"))


_MAPPED = """m as (select c_custkey as r, case when c_custkey % 41 > 0 then c_nationkey || ':' || c_custkey // 3 end as a, case when c_custkey % 41 > 0 and c_custkey % 3 = 0 then 'b' || c_custkey // 7 end as b, case when c_custkey % 5 > 0 then 'c' || c_custkey // 6 end as code from customer),
ids as (select r, code, 'a' as t, a as v from m where a is not null union all select r, code, 'b', b from m where b is not null),
f as (select t, v, min(r) as f, arg_min(coalesce(code, '~'), r) as fcode from ids group by 1, 2), e as (select distinct f as a, r as b from ids join f using (t, v) where r <> f union select distinct r, f from ids join f using (t, v) where r <> f),
w as (select r, r as c from m union select w.r, e.b from w join e on e.a = w.c), s as (select r, min(c) as subject from w group by 1),
filed as (select 'a' as t, c_nationkey || ':' || c_custkey // 3 as v, 'c' || c_custkey // 6 as s from customer where c_custkey % 4 = 0 union select 'b', 'b' || c_custkey // 7, 'c' || c_custkey // 5 from customer where c_custkey % 30 = 0),
k as (select r, any_value(code) as code, count(distinct filed.s) as n, min(filed.s) as lo, max(filed.s) as hi from ids left join filed using (t, v) group by 1),
x as (select r as row, 'empty' as reason from m where a is null and b is null union select r, 'repeated' from ids join f using (t, v) where r <> f and code is not null and fcode <> '~' and code <> fcode
  union select r, 'unresolved' from k where n = 0 and code is null union select r, 'two subjects' from k where n > 1 union select r, 'mapped' from k where code is not null and n > 0 and (lo <> code or hi <> code) union select r, 'merged' from m where code in ('c3', 'c9'))"""


def _identified(spark, d):
    c, k, third = read(spark, d, "customer"), F.col("c_custkey"), lambda n: F.floor(F.col("c_custkey") / n).cast("long").cast("string")
    a, b, code = F.concat_ws(":", "c_nationkey", third(3)), F.concat(F.lit("b"), third(7)), lambda n: F.concat(F.lit("c"), third(n))
    rows = c.select(k, F.when(k % 41 > 0, a).alias("a"), F.when((k % 41 > 0) & (k % 3 == 0), b).alias("b"), F.when(k % 5 > 0, code(6)).alias("code"))
    known = c.filter(k % 4 == 0).select(F.lit("a").alias("type"), a.alias("value"), code(6).alias("subject")).union(c.filter(k % 30 == 0).select(F.lit("b"), b, code(5))).distinct()
    gone = spark.createDataFrame([("c3", "c1"), ("c9", "c8")], "code string, into string")
    return I.identifier_map(rows, "c_custkey", ["a", "b"], "code", known, gone)


@query("id_4_identifier_map", f"with recursive {_MAPPED} select r as row, subject from s")
def identifier_map(spark, d):
    return _identified(spark, d)[0]


@query("id_4_conflicts", f"with recursive {_MAPPED} select row, reason from x")
def conflicts(spark, d):
    return _identified(spark, d)[1]


@query("id_4_report", f"with recursive {_MAPPED} select (select count(distinct subject) from s) as subjects, (select count(distinct subject) from s join k using (r) where n > 0) as known, (select count(distinct row) from x) as conflicts, (select count(*) from x) = 0 as applies")
def map_report(spark, d):
    return _identified(spark, d)[2]


@query("id_4_all_orders", "select o_orderkey as row, min(o_orderkey) over (partition by o_custkey) as subject from orders")
def linked_orders(spark, d):
    """Orders of one customer are one subject, over all of them."""
    return I.identifier_map(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", ["o_custkey"])[0]


@query("id_5_merge", "select o_orderkey, case when o_custkey % 10 = 3 then o_custkey - 1 else o_custkey end as o_custkey from orders")
def merge(spark, d):
    mapping = read(spark, d, "customer").filter("c_custkey % 10 = 3").select(F.col("c_custkey").alias("alias"), (F.col("c_custkey") - 1).alias("canonical"))
    return I.merged(read(spark, d, "orders").select("o_orderkey", "o_custkey"), mapping, "o_custkey").select("o_orderkey", "o_custkey")


_FLAT = """with i as (select o_custkey, cast(o_orderdate as date) as a, case when o_orderkey % 9 > 0 then cast(o_orderdate as date) + 100 end as b from orders), j as (select o_custkey, a, coalesce(b, date '9999-12-31') as e from i),
r as (select *, max(e) over (partition by o_custkey order by a, e rows between unbounded preceding and 1 preceding) as reach from j), g as (select *, sum((reach is null or a > reach)::int) over (partition by o_custkey order by a, e rows unbounded preceding) as g from r)
select o_custkey, min(a) as a, nullif(max(e), date '9999-12-31') as b from g group by o_custkey, g"""


@query("id_5_flattened_intervals", _FLAT)
def flattened(spark, d):
    i = _orders(spark, d).select("o_custkey", F.col("day").alias("a"), F.when(F.col("o_orderkey") % 9 > 0, F.date_add("day", 100)).alias("b"))
    return I.flattened(i, ["o_custkey"], "a", "b")


_NUMBERS = """with o as (select o_orderkey, case when o_orderkey % 7 = 0 then '19991332-1234' when o_orderkey % 11 = 0 then strftime(o_orderdate, '%Y%m%d') || '-' || lpad((o_orderkey % 10000)::varchar, 4, '0')
  else lpad(((year(cast(o_orderdate as date)) + 30) % 100)::varchar, 2, '0') || strftime(o_orderdate, '%m') || lpad((day(cast(o_orderdate as date)) + case when o_orderkey % 3 = 0 then 60 else 0 end)::varchar, 2, '0') || case when o_orderkey % 5 = 0 then '+' else '-' end || lpad((o_orderkey % 10000)::varchar, 4, '0') end as raw from orders),
d as (select *, regexp_replace(raw, '[-+]', '', 'g') as x from o), p as (select *, left(x, length(x) - 4) as dt, right(x, 10) as ten from d),
q as (select *, right(dt, 6)[1:2]::int as yy, right(dt, 4)[1:2]::int as mm, right(dt, 2)::int as wd, case when right(dt, 2)::int > 60 then right(dt, 2)::int - 60 else right(dt, 2)::int end as dd from p),
y as (select *, 2024 - ((2024 - yy) % 100 + 100) % 100 as latest from q),
z as (select *, case when length(x) = 12 then dt[1:4]::int when contains(raw, '+') or (latest = 2024 and mm * 100 + dd > 615) then latest - 100 else latest end as yr from y),
w as (select *, list_sum([case when i % 2 = 1 then case when ten[i]::int * 2 > 9 then ten[i]::int * 2 - 9 else ten[i]::int * 2 end else ten[i]::int end for i in range(1, 11)]) as total, mm between 1 and 12 and dd between 1 and case when mm in (4, 6, 9, 11) then 30 when mm = 2 then case when yr % 4 = 0 and (yr % 100 <> 0 or yr % 400 = 0) then 29 else 28 end else 31 end as real from z),
r as (select o_orderkey, raw, yr, x, case when not real then 'date' when total % 10 <> 0 then 'check digit' end as reason from w)
select o_orderkey, raw, case when reason is null then lpad(yr::varchar, 4, '0') || right(x, 8) end as number, reason from r"""


@query("id_6_number_check", _NUMBERS)
def number_check(spark, d):
    k, two = F.col("o_orderkey"), lambda c, n=2: F.lpad(c.cast("string"), n, "0")
    day = F.dayofmonth("day") + F.when(k % 3 == 0, 60).otherwise(0)
    short = F.concat(two((F.year("day") + 30) % 100), F.date_format("day", "MM"), two(day), F.when(k % 5 == 0, "+").otherwise("-"), two(k % 10000, 4))
    long = F.concat(F.date_format("day", "yyyyMMdd"), F.lit("-"), two(k % 10000, 4))
    rows = _orders(spark, d).withColumn("raw", F.when(k % 7 == 0, "19991332-1234").when(k % 11 == 0, long).otherwise(short))
    number, reason = I.check_number(F.col("raw"), dt.date(2024, 6, 15))
    return rows.select("o_orderkey", "raw", number.alias("number"), reason.alias("reason"))


@query("id_7_natural_order", "select p_partkey, (dense_rank() over (partition by p_size order by p_type[1:4], p_partkey % 120))::int as place from part")
def natural_order(spark, d):
    p = read(spark, d, "part").withColumn("label", F.concat(F.substring("p_type", 1, 4), F.lit("-"), (F.col("p_partkey") % 120).cast("string")))
    return I.natural_places(p, "p_size", "label").select("p_partkey", "place")


_PART = "lpad(('0x' || substr(sha256('u|' || p_name || p_partkey), {0}, 14))::bigint::varchar, 17, '0')"


@query("id_8_uid", f"select p_partkey, '2.25.1' || {_PART.format(1)} || {_PART.format(15)} as uid from part")
def uid(spark, d):
    return read(spark, d, "part").select("p_partkey", I.uid("u", F.concat("p_name", F.col("p_partkey").cast("string"))).alias("uid"))


@query("id_9_scrub", "select c_custkey, replace(replace(c_name || ' of ' || c_mktsegment || ' is ' || c_name, c_name, '[removed]'), c_mktsegment, '[removed]') as text from customer")
def scrub(spark, d):
    text = F.concat("c_name", F.lit(" of "), "c_mktsegment", F.lit(" is "), "c_name")
    return read(spark, d, "customer").select("c_custkey", I.scrub(text, [F.lower("c_mktsegment"), F.col("c_name"), F.lit("of")]).alias("text"))


@query("id_10_age", "select o_orderkey, case when a between 0 and 150 then a end as age from (select o_orderkey, (year(o_orderdate) - (1800 + o_orderkey % 250) - (strftime(o_orderdate, '%m%d') < '0701')::int)::int as a from orders)")
def age(spark, d):
    birth = F.make_date((F.lit(1800) + F.col("o_orderkey") % 250).cast("int"), F.lit(7), F.lit(1))
    return _orders(spark, d).select("o_orderkey", safe_age(birth, F.col("day")).cast("int").alias("age"))


_SAFE = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"


@query("rel_1_names", f"select p_partkey, {_SAFE.format('p_brand')} || '_' || {_SAFE.format('p_type')} as name from part")
def names(spark, d):
    return read(spark, d, "part").select("p_partkey", L.descriptive([F.col("p_brand"), F.col("p_type")]).alias("name"))


@query("rel_2_standard_names", "select l_orderkey * 8 + l_linenumber as k, case when l_returnflag = 'N' then null when l_linestatus is null then null else 'std-' || lower(l_returnflag) end as name, case when l_returnflag = 'N' then 'no mapping' end as reason from lineitem")
def standard_names(spark, d):
    mapping = spark.createDataFrame([("A", "std-a"), ("R", "std-r")], "l_returnflag string, name string")
    rows = read(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return L.standard_name(rows, mapping, ["l_returnflag"], ["l_linestatus"]).select("k", "name", "reason")


_DISAMBIGUATE = """with l as (select distinct on (l_orderkey, l_linenumber) * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey),
r as (select l_orderkey, l_linenumber, l_linestatus as nm, case when l_orderkey % 3 = 0 and l_linenumber % 2 = 0 then l_linenumber // 4 end as echo, case when l_orderkey % 3 = 1 then l_quantity end as ti, lower(l_returnflag) as flag, case when l_linenumber % 3 > 0 then l_suppkey % 2 end as side from l),
a as (select *, case when count(*) over (partition by l_orderkey, nm) > 1 and echo is not null then nm || '_e' || echo else nm end as u from r),
b as (select *, count(*) over w as n, count(ti) over w = count(*) over w and len(list_distinct(list(ti) over w)) = count(*) over w as timed, row_number() over (partition by l_orderkey, u order by ti) as k, len(list_distinct(list(coalesce(flag, '')) over w)) as f, len(list_distinct(list(coalesce(side::varchar, '')) over w)) as s, row_number() over (partition by l_orderkey, u order by l_linenumber) as run from a window w as (partition by l_orderkey, u)),
c as (select * replace (case when n = 1 then u when timed then u || '_ti' || k when f > 1 then u || '_f' || flag when s > 1 then u || coalesce('_s' || side, '') else u || '_' || run end as u) from b),
d as (select * exclude (n, timed, k, s, run, f), count(*) over w as n, count(ti) over w = count(*) over w and len(list_distinct(list(ti) over w)) = count(*) over w as timed, row_number() over (partition by l_orderkey, u order by ti) as k, len(list_distinct(list(coalesce(side::varchar, '')) over w)) as s, row_number() over (partition by l_orderkey, u order by l_linenumber) as run from c window w as (partition by l_orderkey, u)),
e as (select * replace (case when n = 1 then u when timed then u || '_ti' || k when s > 1 then u || coalesce('_s' || side, '') else u || '_' || run end as u) from d),
f as (select *, count(*) over w as n2, count(ti) over w = count(*) over w and len(list_distinct(list(ti) over w)) = count(*) over w as t2, row_number() over (partition by l_orderkey, u order by ti) as k2, row_number() over (partition by l_orderkey, u order by l_linenumber) as run2 from e window w as (partition by l_orderkey, u))
select l_orderkey, l_linenumber, case when n2 = 1 then u when t2 then u || '_ti' || k2 else u || '_' || run2 end as unique_name from f"""


@query("rel_3_disambiguate", _DISAMBIGUATE)
def disambiguate(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")).alias("r")).select("l_orderkey", "l_linenumber", "r.*")
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    rows = rows.select(o, n, F.col("l_linestatus").alias("nm"), F.when((o % 3 == 0) & (n % 2 == 0), F.floor(n / 4).cast("int")).alias("echo"), F.when(o % 3 == 1, F.col("l_quantity")).alias("ti"), F.col("l_returnflag").alias("flag"), F.when(n % 3 > 0, F.col("l_suppkey") % 2).alias("side"))
    return L.disambiguate(rows, ["l_orderkey"], "nm", "l_linenumber", "echo", "ti", [("flag", "f"), ("side", "s")]).select("l_orderkey", "l_linenumber", "unique_name")


_REPEAT = "select l_partkey, l_returnflag, count(*) as members, concat_ws(',', case when max(l_quantity) - min(l_quantity) > 0.5 * greatest(abs(max(l_quantity)), abs(min(l_quantity))) then 'l_quantity' end, case when max(l_discount) - min(l_discount) > 0.045 then 'l_discount' end, case when count(distinct l_linestatus) > 1 then 'l_linestatus' end) as differing, count(m) < count(*) or count(distinct m) = count(*) as once from (select *, case when l_suppkey % 50 > 0 then l_suppkey % 4 end as m from lineitem) group by 1, 2"


@query("rel_4_repeats", f"select * exclude (once), members > 1 and differing = '' and once as repeat, members > 1 and differing = '' and not once as written_twice from ({_REPEAT})")
def repeats(spark, d):
    rows = read(spark, d, "lineitem").withColumn("m", F.when(F.col("l_suppkey") % 50 > 0, F.col("l_suppkey") % 4))
    return L.repeats(rows, ["l_partkey", "l_returnflag"], {"l_quantity": 0.5}, {"l_discount": 0.045}, ["l_linestatus"], "m")


@query("rel_5_separator", "select l_orderkey, count(*) as members, case when count(distinct l_returnflag) = count(*) then 'l_returnflag' when count(distinct l_quantity) = count(*) then 'l_quantity' when count(distinct l_partkey) = count(*) then 'l_partkey' end as separator from lineitem group by 1 having count(*) > 1")
def separator(spark, d):
    return L.separator(read(spark, d, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_quantity", "l_partkey"])


@query("rel_6_route", "select o_orderkey, case when o_orderstatus = 'P' then 'left out' when o_totalprice > 200000 then 'written' when o_orderpriority = '1-URGENT' then 'source' else 'derivative' end as route, case when o_orderstatus = 'P' then 'pending' when o_totalprice > 200000 then 'large' when o_orderpriority = '1-URGENT' then 'urgent' else 'rest' end as reason from orders")
def route(spark, d):
    rules = [(F.col("o_orderstatus") == "P", "left out", "pending"), (F.col("o_totalprice") > 200000, "written", "large"), (F.col("o_orderpriority") == "1-URGENT", "source", "urgent")]
    return L.route(read(spark, d, "orders"), rules, ("derivative", "rest")).select("o_orderkey", "route", "reason")


def _two(spark, d):
    """Two versions of the orders, the second perturbed by rule."""
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey")
    k = F.col("o_orderkey")
    old = o.filter(k % 10 != 1)
    new = o.filter(k % 10 != 2).withColumn("o_totalprice", F.when(k % 10 == 3, F.col("o_totalprice") + 1).when(k % 10 == 6, F.col("o_totalprice") + 0.001).otherwise(F.col("o_totalprice"))).withColumn("o_orderpriority", F.when(k % 10 == 4, F.concat(F.lit(" "), F.lower("o_orderpriority"))).when(k % 10 == 5, F.lit(None)).otherwise(F.col("o_orderpriority"))).withColumn("o_orderstatus", F.when(k % 100 == 7, "X").otherwise(F.col("o_orderstatus")))
    return old, new


_TWO = """a as (select * from orders where o_orderkey % 10 <> 1), b as (select o_orderkey, case when o_orderkey % 100 = 7 then 'X' else o_orderstatus end as o_orderstatus, case when o_orderkey % 10 = 4 then ' ' || lower(o_orderpriority) when o_orderkey % 10 = 5 then null else o_orderpriority end as o_orderpriority, case when o_orderkey % 10 = 3 then o_totalprice + 1 when o_orderkey % 10 = 6 then o_totalprice + 0.001 else o_totalprice end as o_totalprice, o_custkey from orders where o_orderkey % 10 <> 2)"""


@query("rel_7_versions", f"with {_TWO} select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when a.o_orderkey is null then 'added' when b.o_orderkey is null then 'removed' when a.o_totalprice is distinct from b.o_totalprice then 'rewritten' when a.o_orderpriority is distinct from b.o_orderpriority then 'moved' else 'unchanged' end as change from a full join b on a.o_orderkey = b.o_orderkey")
def versions(spark, d):
    old, new = _two(spark, d)
    return L.versions(old, new, "o_orderkey", "o_totalprice", "o_orderpriority")


@query("rel_8_named_by", "with n as (select c_custkey, case when c_custkey % 9 > 0 then 'n' || (c_custkey - c_custkey % 50 % 2) end as name from customer) select c_custkey, name, case when name is null then 'missing' when count(c_custkey) over (partition by name) > 1 then 'collision' else 'clean' end as state from n")
def named_by(spark, d):
    c = read(spark, d, "customer").select("c_custkey")
    names_ = c.filter("c_custkey % 9 > 0").withColumn("v", F.concat(F.lit(" n"), (F.col("c_custkey") - F.col("c_custkey") % 50 % 2).cast("string")))
    return L.named_by(c, names_, "c_custkey", "v")


@query("rel_9_quality_bars", f"with {_TWO} select 'placed or accounted for' as bar, (select count(*) from orders where o_orderkey % 10 = 2) as failing union all select 'unique names', (select count(*) from (select o_custkey from b group by 1 having count(*) > 1)) union all select 'unchanged re-run', (select count(*) from a full join b on a.o_orderkey = b.o_orderkey where a.o_orderkey is null or b.o_orderkey is null or a.o_totalprice is distinct from b.o_totalprice or a.o_orderpriority is distinct from b.o_orderpriority) union all select 'picks present', (select count(*) from orders where o_orderkey % 5 = 2 and o_orderkey % 10 = 2) union all select 'dates join the events', (select count(*) from (select user_id % 300 as o_custkey, cast(ts as date) - (2500 + event_id % 5000)::int as day from events) e where o_custkey in (select o_custkey from orders) and not exists (select 1 from orders o where o.o_custkey = e.o_custkey and abs(datediff('day', e.day, cast(o.o_orderdate as date))) <= 30))")
def quality_bars(spark, d):
    return L.quality_bars(*_release(spark, d))


@query("rel_9_failing_rows", f"with {_TWO} select 'placed or accounted for' as bar, o_orderkey::varchar as row from orders where o_orderkey % 10 = 2 union all select 'unique names', o_custkey::varchar from b group by o_custkey having count(*) > 1 union all select 'unchanged re-run', coalesce(a.o_orderkey, b.o_orderkey)::varchar from a full join b on a.o_orderkey = b.o_orderkey where a.o_orderkey is null or b.o_orderkey is null or a.o_totalprice is distinct from b.o_totalprice or a.o_orderpriority is distinct from b.o_orderpriority union all select 'picks present', o_orderkey::varchar from orders where o_orderkey % 5 = 2 and o_orderkey % 10 = 2 union all select 'dates join the events', concat(o_custkey, '|', day) from (select user_id % 300 as o_custkey, cast(ts as date) - (2500 + event_id % 5000)::int as day from events) e where o_custkey in (select o_custkey from orders) and not exists (select 1 from orders o where o.o_custkey = e.o_custkey and abs(datediff('day', e.day, cast(o.o_orderdate as date))) <= 30)")
def failing_rows(spark, d):
    return L.failing_rows(*_release(spark, d))


def _release(spark, d):
    old, new = _two(spark, d)
    orders = read(spark, d, "orders")
    events = read(spark, d, "events").select((F.col("user_id") % 300).alias("o_custkey"), F.date_sub(F.to_date("ts"), (F.col("event_id") % 5000).cast("int") + 2500).alias("day"))
    sessions = _orders(spark, d).select("o_custkey", "day")
    return (orders.select("o_orderkey"), new, "o_orderkey", "o_custkey", L.versions(old, new, "o_orderkey", "o_totalprice", "o_orderpriority"), orders.filter("o_orderkey % 5 = 2"), sessions, events, "o_custkey", "day", 30)


_FIELD = "select '{f}' as field, count(*) as compared, count(case when x is null and y is null then 1 end) as both_null, count(case when (x is null) <> (y is null) then 1 end) as one_null, count(case when x = y then 1 end) as equal, count(case when x <> y and {s} then 1 end) as alike, count(case when x <> y and not ({s}) then 1 end) as different from (select a.{f} as x, b.{f} as y from a join b on a.o_orderkey = b.o_orderkey)"
_ALIKE = "lower(trim(x::varchar)) = lower(trim(y::varchar))"


@query("rec_1_fields", f"with {_TWO} {_FIELD.format(f='o_orderstatus', s=_ALIKE)} union all {_FIELD.format(f='o_orderpriority', s=_ALIKE)} union all {_FIELD.format(f='o_totalprice', s='abs(x - y) <= 0.01')}")
def fields(spark, d):
    old, new = _two(spark, d)
    return C.fields(old, new, "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_totalprice"], {"o_totalprice": 0.01})


_MASK = "regexp_replace(regexp_replace(regexp_replace({0}, '[0-9]', '9', 'g'), '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g')"


@query("rec_2_shapes", f"with {_TWO} select 'o_orderpriority' as field, {_MASK.format('a.o_orderpriority')} as shape_a, {_MASK.format('b.o_orderpriority')} as shape_b, count(*) as n, min(a.o_orderkey) as sample from a join b on a.o_orderkey = b.o_orderkey where a.o_orderpriority <> b.o_orderpriority group by all")
def shapes(spark, d):
    old, new = _two(spark, d)
    return C.shapes(old, new, "o_orderkey", ["o_orderpriority"])


_PARTS = """with p as (select o_orderkey, o_custkey as g, case when o_custkey % 20 = 0 then o_custkey * 10 + o_orderkey % 2 else -o_custkey end as h from orders),
a as (select ms, count(*) as n from (select g, list_sort(list(o_orderkey)) as ms from p group by 1) group by 1), b as (select ms, count(*) as n from (select h, list_sort(list(o_orderkey)) as ms from p group by 1) group by 1)
select sum(least(coalesce(a.n, 0), coalesce(b.n, 0)))::bigint as matched, sum(greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0))::bigint as only_first, sum(greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0))::bigint as only_second from a full join b using (ms)"""


@query("rec_3_partitions", _PARTS)
def partitions(spark, d):
    o = read(spark, d, "orders").withColumn("h", F.when(F.col("o_custkey") % 20 == 0, F.col("o_custkey") * 10 + F.col("o_orderkey") % 2).otherwise(-F.col("o_custkey")))
    return C.partitions(o, o, "o_orderkey", "o_custkey", "h")


@query("rec_4_presence", f"with {_TWO} select side, reason, count(*) as n from (select case when b.o_orderkey is null then 'first' when a.o_orderkey is null then 'second' else 'both' end as side, case when b.o_orderkey is null then a.o_orderstatus when a.o_orderkey is null then b.o_orderpriority end as reason from a full join b on a.o_orderkey = b.o_orderkey) group by 1, 2")
def presence(spark, d):
    old, new = _two(spark, d)
    return C.presence(old, new, "o_orderkey", F.col("o_orderstatus"), F.col("o_orderpriority"))


@query("rec_5_subject_partitions", "select count(distinct o_custkey) as matched, 0::bigint as only_first, 0::bigint as only_second from orders")
def subject_partitions(spark, d):
    o = read(spark, d, "orders")
    return C.partitions(o, o.withColumn("code", F.md5(F.col("o_custkey").cast("string"))), "o_orderkey", "o_custkey", "code")


@query("rec_6_matrix", f"with {_TWO} select a.o_orderstatus as first, b.o_orderstatus as second, count(*) as n from a join b on a.o_orderkey = b.o_orderkey group by 1, 2")
def matrix(spark, d):
    old, new = _two(spark, d)
    return C.matrix(old, new, "o_orderkey", "o_orderstatus")


@query("sum_1_registry", "with o as (select *, 'cohort ' || c_nationkey as cohort, 'version ' || o_orderkey % 3 as version, o_orderdate >= date '2000-01-01' as since from orders join customer on c_custkey = o_custkey) select case when grouping(cohort) = 0 then cohort when grouping(version) = 0 then version else 'all' end as what, count(distinct o_custkey) as subjects, count(*) as units, count(case when since then 1 end) as units_since from o group by grouping sets ((cohort), (version), ())")
def registry(spark, d):
    o = _orders(spark, d).join(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("cohort "), F.col("c_nationkey")).alias("cohort")), "o_custkey")
    rows = o.select("o_custkey", "cohort", F.concat(F.lit("version "), F.col("o_orderkey") % 3).alias("version"), (F.col("day") >= F.lit("2000-01-01").cast("date")).alias("since"))
    return C.registry(rows, "o_custkey", "cohort", "version", F.col("since"))


@query("sum_2_dataset", "select c_mktsegment, count(distinct c_custkey) as subjects, count(distinct o_orderkey) as visits, count(l_orderkey) as units, count(distinct l_returnflag) as kinds, count(distinct c_nationkey) as regions from customer left join orders on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey group by 1")
def dataset(spark, d):
    rows = read(spark, d, "customer").join(_orders(spark, d).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", "left").join(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag"), "o_orderkey", "left")
    return C.dataset(rows, "c_mktsegment", distinct={"subjects": "c_custkey", "visits": "o_orderkey", "kinds": "l_returnflag", "regions": "c_nationkey"}, counts={"units": "l_returnflag"})


@query("sum_2_files", "with f as (select page_id % 7 as ds, case when page_id % 5 = 0 then 'refused' when page_id % 3 = 0 then 'held' else 'filed' end as status, case when page_id % 5 = 0 then case when page_id % 2 = 0 then 'no identity' else 'damaged' end end as reason from pages) select ds, status, reason, count(*) as n from f group by all")
def dataset_files(spark, d):
    k = F.col("page_id")
    status = F.when(k % 5 == 0, "refused").when(k % 3 == 0, "held").otherwise("filed")
    rows = read(spark, d, "pages").select((k % 7).alias("ds"), status.alias("status"), F.when(k % 5 == 0, F.when(k % 2 == 0, "no identity").otherwise("damaged")).alias("reason"))
    return C.files(rows, "ds", "status", "reason")


@query("sum_3_holding", "select l_suppkey, count(distinct o_orderkey) as units, count(distinct o_custkey) as subjects from orders join lineitem on l_orderkey = o_orderkey group by 1")
def holding(spark, d):
    bridge = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return C.holding(read(spark, d, "orders").select("o_orderkey", "o_custkey"), bridge, "o_orderkey", "l_suppkey", "o_custkey")


@query("sum_4_accept_grid", "select l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 as k, l_orderkey, l_linenumber, l_discount from lineitem where l_returnflag = 'A' and l_discount >= 0.08 and l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 > 100000 and l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P') order by k, l_discount, l_partkey limit 200")
def accept_grid(spark, d):
    rows = read(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_suppkey") % 100)
    exceptions = read(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    page = C.accept_grid(rows, "l_orderkey", exceptions, F.col("l_returnflag") == "A", F.col("l_discount") >= 0.08, "k", 100_000, 200, ["l_discount", "l_partkey"])
    return page.select("k", "l_orderkey", "l_linenumber", "l_discount")


@query("sum_5_cohort", "select c_nationkey, count(*) as members, count(case when c_acctbal < 0 then 1 end) as questions, round(avg(c_acctbal), 6) as mean from customer group by 1")
def cohort(spark, d):
    return C.cohort_review(read(spark, d, "customer"), "c_nationkey", F.col("c_acctbal") < 0, "c_acctbal")
