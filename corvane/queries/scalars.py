"""Scalar and window functions, output levels, disclosure control and diagnosis."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import scalars as X
from corvane.functions import windows as W
from corvane.operators import outputs as O
from corvane.plans.grains import read, retail

from .base import query


def _orders(spark, d):
    return retail(spark, d).scan("session")


@query("fn_1_compare_2_about", "select o_orderkey from orders where o_totalprice <> 1 and o_totalprice >= 100000 and o_orderkey <= 9000000 and abs(o_totalprice - 150000) <= 20000 and abs(datediff('day', cast(o_orderdate as date), date '1998-01-01')) <= 400")
def compare(spark, d):
    o, p = _orders(spark, d), F.col("o_totalprice")
    return o.filter((p != 1) & (p >= 100000) & (F.col("o_orderkey") <= 9000000) & X.about(p, F.lit(150000), 20000) & X.about_days(F.col("day"), F.lit("1998-01-01").cast("date"), 400)).select("o_orderkey")


@query("fn_3_in_lists", "select o_orderkey, o_custkey from orders where o_custkey in (select unnest(range(0, 3000, 2))) and o_orderstatus not in ('P')")
def in_lists(spark, d):
    return X.among(X.among(_orders(spark, d), "o_custkey", list(range(0, 3000, 2))), "o_orderstatus", ["P"], negate=True).select("o_orderkey", "o_custkey")


@query("fn_4_has_5_null", "with l as (select l_orderkey, list(distinct l_returnflag) as flags from lineitem group by 1) select l_orderkey from l where list_contains(flags, 'R') and flags is not null")
def has_member(spark, d):
    flags = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    return flags.filter(F.array_contains("flags", "R") & F.col("flags").isNotNull()).select("l_orderkey")


@query("fn_6_text_7_logic", "select p_partkey from part where contains(lower(p_type), 'st') and not starts_with(lower(p_name), 'p') or p_size = 7")
def text_tests(spark, d):
    return read(spark, d, "part").filter(X.contains(F.col("p_type"), "ST") & ~X.starts_with(F.col("p_name"), "P") | (F.col("p_size") == 7)).select("p_partkey")


@query("fn_8_arithmetic_9_round", "select l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity - 10, 0), 8) as ratio, round(abs(l_discount - l_tax), 6) as gap, cast(round(l_discount * 1000) as bigint) as key from lineitem")
def arithmetic(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(X.divide(F.col("l_extendedprice"), F.col("l_quantity") - 10), 8).alias("ratio"), F.round(F.abs(F.col("l_discount") - F.col("l_tax")), 6).alias("gap"), X.round_key(F.col("l_discount"), 3).alias("key"))


@query("fn_10_case_11_least", "select c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as seg, case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'some' else 'much' end as level, c_name || '/' || nullif(c_mktsegment, 'BUILDING') as joined, least(c_acctbal, case when c_custkey % 2 = 0 then 100.0 end) as lo, greatest(c_acctbal, case when c_custkey % 2 = 0 then 100.0 end) as hi from customer")
def cases(spark, d):
    bal, seg, odd = F.col("c_acctbal"), F.nullif("c_mktsegment", F.lit("BUILDING")), F.when(F.col("c_custkey") % 2 == 0, 100.0)
    return read(spark, d, "customer").select("c_custkey", F.coalesce(seg, F.lit("none")).alias("seg"), F.when(bal < 0, "debt").when(bal < 5000, "some").otherwise("much").alias("level"), F.concat("c_name", F.lit("/"), seg).alias("joined"), F.least(bal, odd).alias("lo"), F.greatest(bal, odd).alias("hi"))


_DAYS = "with t as (select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then cast(l_shipdate as date) else cast(o_orderdate as date) end as a, case when l_linenumber % 2 = 0 then cast(o_orderdate as date) else cast(l_shipdate as date) end as b from lineitem join orders on o_orderkey = l_orderkey)"


def _two_days(spark, d):
    o = _orders(spark, d).select(F.col("o_orderkey").alias("l_orderkey"), F.col("day").alias("a"))
    days = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("b")).join(o, "l_orderkey")
    back = F.col("l_linenumber") % 2 == 0
    return days.select("l_orderkey", "l_linenumber", F.when(back, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(back, F.col("a")).otherwise(F.col("b")).alias("b"))


def _whole(unit: str) -> str:
    return {
        "months": "((year(b) * 12 + month(b)) - (year(a) * 12 + month(a)) - (day(b) < day(a))::int)::int",
        "years": "(year(b) - year(a) - (strftime(b, '%m%d') < strftime(a, '%m%d'))::int)::int",
    }[unit]


@query("fn_12_days_13_months_years", f"{_DAYS} select l_orderkey, l_linenumber, datediff('day', a, b)::int as days, {_whole('months')} as months, {_whole('years')} as years from t")
def spans(spark, d):
    a, b = F.col("a"), F.col("b")
    return _two_days(spark, d).select("l_orderkey", "l_linenumber", F.datediff(b, a).alias("days"), X.months_between(a, b).cast("int").alias("months"), X.years_between(a, b).cast("int").alias("years"))


@query("fn_14_shift_15_age", "select o_orderkey, cast(o_orderdate as date) + 62 as later, cast(o_orderdate as date) - 366 as earlier, (year(cast(o_orderdate as date)) - 1960 - (strftime(o_orderdate, '%m%d') < '0229')::int)::int as age from orders")
def shift_age(spark, d):
    return _orders(spark, d).select("o_orderkey", X.shift(F.col("day"), 2, "month").alias("later"), X.shift(F.col("day"), -1, "year").alias("earlier"), X.safe_age(F.lit("1960-02-29").cast("date"), F.col("day")).cast("int").alias("age"))


@query("fn_16_bucket_part", "select strftime(o_orderdate, '%Y-%m') as month, dayofweek(o_orderdate)::int as dow, count(*) as n from orders group by 1, 2")
def buckets(spark, d):
    return _orders(spark, d).groupBy(X.bucket(F.col("day"), "month").alias("month"), X.part(F.col("day"), "dow").cast("int").alias("dow")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_17_json", "select k, count(*) as n from (select json_extract_string(props, '$.k') as k from events) group by 1")
def json_key(spark, d):
    return read(spark, d, "events").select(X.json_text(F.col("props"), "k").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


_COARSE = """with o as (select o_orderkey, cast(o_orderdate as date) as day, case o_orderkey % 3 when 0 then 'day' when 1 then 'month' else 'year' end as prec from orders),
c as (select *, case prec when 'day' then day when 'month' then date_trunc('month', day)::date else date_trunc('year', day)::date end as lo, case prec when 'day' then day when 'month' then last_day(day) else make_date(year(day), 12, 31) end as hi, date '1998-06-15' as x, case o_orderkey % 2 when 0 then date '1998-06-01' else date '1998-06-15' end as xlo, case o_orderkey % 2 when 0 then date '1998-06-30' else date '1998-06-15' end as xhi, case o_orderkey % 2 when 0 then 'month' else 'day' end as xprec from o)"""


@query("fn_18_coarse_dates", f"{_COARSE} select o_orderkey, lo < x as lt, hi >= x as ge, lo <= x and hi >= x as eq, hi < x as lt_all, prec = 'day' and lo = x as eq_all, lo <> x as ne_all, not (lo <= x and hi >= x) as ne, lo < xhi as lt2, not (lo <= xhi and hi >= xlo) as ne2, hi <= xlo as le2_all, prec = 'day' and xprec = 'day' and lo = xlo as eq2_all, lo <> xlo as ne2_all from c")
def coarse(spark, d):
    o = _orders(spark, d).withColumn("prec", F.when(F.col("o_orderkey") % 3 == 0, "day").when(F.col("o_orderkey") % 3 == 1, "month").otherwise("year"))
    c = lambda op, strict=False: X.coarse_compare(op, F.col("day"), F.col("prec"), F.lit("1998-06-15").cast("date"), strict)
    other = (F.when(F.col("o_orderkey") % 2 == 0, F.lit("1998-06-10")).otherwise(F.lit("1998-06-15")).cast("date"), F.when(F.col("o_orderkey") % 2 == 0, "month").otherwise("day"))
    both = lambda op, strict=False: X.coarse_compare(op, F.col("day"), F.col("prec"), other[0], strict, other[1])
    two = [c("<>").alias("ne"), both("<").alias("lt2"), both("<>").alias("ne2"), both("<=", True).alias("le2_all"), both("=", True).alias("eq2_all"), both("<>", True).alias("ne2_all")]
    return o.select("o_orderkey", *two, c("<").alias("lt"), c(">=").alias("ge"), c("=").alias("eq"), c("<", True).alias("lt_all"), c("=", True).alias("eq_all"), c("<>", True).alias("ne_all"))


@query("fn_19_instant_day", "select event_id from events where cast(ts as date) = date '2024-01-15'")
def instant(spark, d):
    return read(spark, d, "events").filter(X.utc_day(F.col("ts")) == F.lit("2024-01-15").cast("date")).select("event_id")


@query("fn_20_keys_22_signature", "select l_orderkey, l_linenumber, cast(round(l_discount * 1000) as bigint) || 'x' || cast(round(l_tax * 1000) as bigint) as key, l_returnflag || '|' || l_linestatus || '|' || cast(round(l_quantity / 5) as bigint) as sig, greatest(l_discount, l_tax) as hi from lineitem")
def keys(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.joined_key(F.col("l_discount"), F.col("l_tax")).alias("key"), X.signature(["l_returnflag", "l_linestatus"], {"l_quantity": 5}).alias("sig"), F.greatest("l_discount", "l_tax").alias("hi"))


@query("fn_21_derived", "select o_orderkey, coalesce(nullif(o_orderpriority, '3-MEDIUM'), o_orderstatus) as kind, datediff('day', min(cast(o_orderdate as date)) over (partition by o_custkey), cast(o_orderdate as date))::int as study_day from orders")
def derived(spark, d):
    first = F.min("day").over(Window.partitionBy("o_custkey"))
    return _orders(spark, d).select("o_orderkey", F.coalesce(F.nullif("o_orderpriority", F.lit("3-MEDIUM")), "o_orderstatus").alias("kind"), F.datediff("day", first).alias("study_day"))


@query("fn_23_course", "select o_custkey, arg_max(o_orderstatus, (cast(o_orderdate as date), o_orderkey)) as course from orders group by 1")
def course(spark, d):
    return _orders(spark, d).groupBy("o_custkey").agg(X.newest("o_orderstatus", "day", "o_orderkey").alias("course"))


@query("fn_24_synonyms", "select name, count(*) as n from (select case c_mktsegment when 'BUILDING' then 'construction' when 'MACHINERY' then 'construction' else c_mktsegment end as name from customer) group by 1")
def synonyms(spark, d):
    return X.synonyms(read(spark, d, "customer"), "c_mktsegment", {"BUILDING": "construction", "MACHINERY": "construction"}, "name").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("fn_25_shape", "with s as (select regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[0-9]', '9', 'g'), '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g') as m from documents) select case when length(m) > 40 then m[1:40] || '~' else m end as shape, count(*) as n from s group by 1")
def shapes(spark, d):
    return read(spark, d, "documents").select(X.shape(F.coalesce("text", F.lit(""))).alias("shape")).groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


@query("win_1_ordinal_2_prev_next", "select o_orderkey, (row_number() over w)::int as ordinal, lag(o_totalprice) over w as prev, lead(o_totalprice) over w as next from orders window w as (partition by o_custkey order by cast(o_orderdate as date) nulls last, o_orderkey)")
def ordinal(spark, d):
    w = W.timeline("o_custkey", "day", "o_orderkey")
    return _orders(spark, d).select("o_orderkey", W.ordinal(w).alias("ordinal"), W.prev("o_totalprice", w).alias("prev"), W.next_("o_totalprice", w).alias("next"))


@query("win_3_rank_ties", "select o_orderkey, (rank() over (partition by o_custkey order by o_orderpriority))::int as rank, count(*) over (partition by o_custkey) as candidates, count(*) over (partition by o_custkey, o_orderpriority) > 1 as tied from orders")
def rank_ties(spark, d):
    w = Window.partitionBy("o_custkey")
    return _orders(spark, d).select("o_orderkey", F.rank().over(w.orderBy("o_orderpriority")).alias("rank"), F.count(F.lit(1)).over(w).alias("candidates"), (F.count(F.lit(1)).over(Window.partitionBy("o_custkey", "o_orderpriority")) > 1).alias("tied"))


@query("win_4_running_flag", "select o_orderkey, coalesce(bool_or(o_orderstatus = 'P') over (partition by o_custkey order by cast(o_orderdate as date) nulls last, o_orderkey rows between unbounded preceding and 1 preceding), false) as seen from orders")
def running_flag(spark, d):
    return _orders(spark, d).select("o_orderkey", W.ever_before(F.col("o_orderstatus") == "P", W.timeline("o_custkey", "day", "o_orderkey")).alias("seen"))


@query("win_5_line_sums", "with g as (select o_orderstatus, o_orderpriority, count(*) as n from orders group by all) select *, sum(n) over (partition by o_orderstatus)::bigint as of_status, sum(n) over (partition by o_orderpriority)::bigint as of_priority from g")
def line_sums(spark, d):
    g, keys_ = _orders(spark, d).groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")), ["o_orderstatus", "o_orderpriority"]
    return g.select("*", W.line_sum("n", keys_, "o_orderpriority").alias("of_status"), W.line_sum("n", keys_, "o_orderstatus").alias("of_priority"))


@query("win_6_breakdowns", "select case when grouping(o_orderstatus) = 0 then 'o_orderstatus' when grouping(o_orderpriority) = 0 then 'o_orderpriority' else 'total' end as dimension, coalesce(o_orderstatus, o_orderpriority) as value, count(*) as n, count(distinct o_custkey) as subjects from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
def breakdowns(spark, d):
    return W.breakdowns(_orders(spark, d), ["o_orderpriority", "o_orderstatus"], n=F.count(F.lit(1)), subjects=F.countDistinct("o_custkey"))


@query("out_1_boolean", "select count(*) > 0 as answer from orders where o_totalprice > 10000000")
def boolean(spark, d):
    return O.any_row(_orders(spark, d).filter("o_totalprice > 10000000"))


@query("out_2_count", "select count(*) as rows, count(distinct o_custkey) as subjects from orders where o_orderstatus = 'O'")
def counted(spark, d):
    return O.counts(_orders(spark, d).filter("o_orderstatus = 'O'"), "o_custkey")


@query("out_3_record_4_page", "select o_orderkey, o_custkey, cast(o_orderdate as date) as day from orders where o_orderkey > 500 order by o_orderkey limit 50")
def page(spark, d):
    return O.page(_orders(spark, d).select("o_orderkey", "o_custkey", "day"), "o_orderkey", 500, 50)


@query("out_5_share", "select n, m, round(n / nullif(m, 0), 9) as share from (select (select count(distinct o_custkey) from orders where o_orderstatus = 'P') as n, (select count(distinct c_custkey) from customer) as m)")
def share(spark, d):
    return O.share(_orders(spark, d).filter("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey"), read(spark, d, "customer"), "c_custkey")


@query("out_6_share_expression", "select c_mktsegment, count(*) as n, round(count(*) / (select count(*) from customer), 9) as share from customer group by 1")
def share_expression(spark, d):
    c = read(spark, d, "customer")
    per, all_ = c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")), c.agg(F.count(F.lit(1)).alias("m"))
    return per.crossJoin(F.broadcast(all_)).select("c_mktsegment", "n", F.round(X.divide(F.col("n"), F.col("m")), 9).alias("share"))


@query("out_7_to_9_scalars", "select round(stddev_pop(o_totalprice), 6) as stddev, round(median(o_totalprice), 6) as median, quantile_disc(o_totalprice, 0.9) as percentile from orders")
def whole_scalars(spark, d):
    return _orders(spark, d).agg(*O.scalars("o_totalprice"))


@query("out_10_group_scalars", "select o_orderpriority, round(stddev_pop(o_totalprice), 6) as stddev, round(median(o_totalprice), 6) as median, quantile_disc(o_totalprice, 0.9) as percentile from orders group by 1")
def group_scalars(spark, d):
    return _orders(spark, d).groupBy("o_orderpriority").agg(*O.scalars("o_totalprice"))


_GRID = "select c_nationkey, c_mktsegment, count(distinct case when c_acctbal > 6000 and c_nationkey % 4 > 0 then c_custkey end) as n from customer group by all"


def _grid(spark, d):
    return read(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.countDistinct(F.when((F.col("c_acctbal") > 6000) & (F.col("c_nationkey") % 4 > 0), F.col("c_custkey"))).alias("n"))


@query("disc_1_threshold", f"select c_nationkey, c_mktsegment, case when n = 0 or n >= 5 then n end as shown from ({_GRID})")
def threshold(spark, d):
    return _grid(spark, d).select("c_nationkey", "c_mktsegment", O.held(F.col("n")).alias("shown"))


@query("disc_2_boolean", f"select c_nationkey, c_mktsegment, case when n = 0 then false when n >= 5 then true end as shown from ({_GRID})")
def held_boolean(spark, d):
    return _grid(spark, d).select("c_nationkey", "c_mktsegment", O.held_flag(F.col("n")).alias("shown"))


def _suppress_sql() -> str:
    ctes = [f"g0 as (select *, (n between 1 and 4)::int as p, (n between 1 and 4)::int as h from ({_GRID}))"]
    one = "(sum(h) over w{0} >= 1 and (sum(h) over w{0} = 1 or sum(case when p = 0 then h else 0 end) over w{0} = 0) and row_number() over (w{0} order by h, n = 0, n, c_nationkey, c_mktsegment) = 1)"
    for i in range(6):
        ctes.append(f"g{i + 1} as (select c_nationkey, c_mktsegment, n, p, case when h = 1 or {one.format(1)} or {one.format(2)} then 1 else 0 end as h from g{i} window w1 as (partition by c_mktsegment), w2 as (partition by c_nationkey))")
    return f"with {', '.join(ctes)} select c_nationkey, c_mktsegment, n, case when h = 0 then n end as shown from g6"


@query("disc_3_complementary", _suppress_sql())
def complementary(spark, d):
    return O.suppress(_grid(spark, d), ["c_nationkey", "c_mktsegment"], "n", "shown")


@query("disc_4_remainder", "select c_nationkey, case when (n = 0 or n >= 5) and (m - n = 0 or m - n >= 5) then n end as shown from (select c_nationkey, count(*) as m, count(case when c_acctbal > 9000 then 1 end) as n from customer group by 1)")
def remainder(spark, d):
    g = read(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("m"), F.count(F.when(F.col("c_acctbal") > 9000, 1)).alias("n"))
    return g.select("c_nationkey", O.held_part(F.col("n"), F.col("m")).alias("shown"))


@query("disc_5_guarded_mean", "select c_nationkey, c_mktsegment, case when count(distinct case when c_acctbal > 7000 then c_custkey end) >= 5 then round(avg(case when c_acctbal > 7000 then c_acctbal end), 6) end as mean from customer group by all")
def guarded_mean(spark, d):
    c = read(spark, d, "customer").withColumn("v", F.when(F.col("c_acctbal") > 7000, F.col("c_acctbal")))
    return c.groupBy("c_nationkey", "c_mktsegment").agg(O.guarded(F.round(F.avg("v"), 6), "c_custkey", "v").alias("mean"))


@query("disc_6_list_guard", "with a as (select c_custkey, 'many' as list from customer where c_acctbal > 5000), b as (select c_custkey, 'few' as list from customer where c_custkey < 4) select * from a where (select count(distinct c_custkey) from a) >= 5 union all select * from b where (select count(distinct c_custkey) from b) >= 5")
def list_guard(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_acctbal")
    return O.list_guard(c.filter("c_acctbal > 5000").select("c_custkey", F.lit("many").alias("list")), "c_custkey").union(O.list_guard(c.filter("c_custkey < 4").select("c_custkey", F.lit("few").alias("list")), "c_custkey"))


@query("disc_7_shapes", "select c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[0-9]', '9', 'g'), '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g') as c_name from customer")
def masked(spark, d):
    return read(spark, d, "customer").select("c_custkey", X.shape(F.col("c_name")).alias("c_name"))


@query("disc_8_held_report", f"select 'shown' as \"column\", count(*) as held from ({_GRID}) where not (n = 0 or n >= 5)")
def held_report(spark, d):
    return O.held_report(_grid(spark, d).select("c_nationkey", O.held(F.col("n")).alias("shown")), ["shown"])


_STEPS = [("large", "o_totalprice > 100000"), ("open", "o_orderstatus <> 'F'"), ("urgent", "o_orderpriority in ('1-URGENT', '2-HIGH')"), ("late", "cast(o_orderdate as date) >= date '1998-01-01'")]


def _steps():
    return {n: F.expr(c.replace("cast(o_orderdate as date)", "day").replace("<>", "!=")) for n, c in _STEPS}


def _funnel_sql() -> str:
    parts, conds = [], []
    for i, (n, c) in enumerate(_STEPS):
        conds.append(f"({c})")
        parts.append(f"select {i + 1} as step, '{n}' as name, count(*) as rows, count(distinct o_custkey) as subjects from orders where {' and '.join(conds)}")
    return " union all ".join(parts)


@query("diag_1_funnel", _funnel_sql())
def funnel(spark, d):
    return O.funnel(_orders(spark, d), "o_custkey", _steps())


@query("diag_2_drops_5_leave_one_out", " union all ".join(f"select '{n}' as clause, count(case when not ({c}) then 1 end) as failed, count(case when ({c}) is null then 1 end) as missing, count(case when {' and '.join(f'({x})' for m, x in _STEPS if m != n)} then 1 end) as without from orders" for n, c in _STEPS))
def drops(spark, d):
    return O.drops(_orders(spark, d), _steps())


@query("diag_3_falls_at", "select * from (select o_orderkey, case " + " ".join(f"when not ({c}) then '{n}'" for n, c in _STEPS) + " end as step from orders) where step is not null")
def falls_at(spark, d):
    return O.falls_at(_orders(spark, d), "o_orderkey", _steps())


@query("diag_4_ties_and_gaps", "select (select count(*) from (select o_custkey from orders qualify row_number() over (partition by o_custkey order by o_orderpriority, o_orderkey) = 1 and count(*) over (partition by o_custkey, o_orderpriority) > 1 and rank() over (partition by o_custkey order by o_orderpriority) = 1)) as tied_picks, (select count(*) from lineitem join orders on o_orderkey = l_orderkey where l_shipdate < o_orderdate) as reversed_gaps, (select count(*) from orders where o_orderkey % 3 = 2) as too_coarse, (select count(*) from (select 'Customer#' || lpad((c_custkey * 3)::varchar, 9, '0') as v from customer where c_custkey % 50 = 1) where v not in (select c_name from customer)) as unresolved")
def ties(spark, d):
    from corvane.operators.sets import pick

    o = _orders(spark, d)
    tied = pick(o, "o_custkey", [F.asc("o_orderpriority")], "o_orderkey").agg(F.count(F.when(F.col("pick_tied"), 1)).alias("tied_picks"))
    days = read(spark, d, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    gaps = days.agg(F.count(F.when(F.col("l_shipdate") < F.col("o_orderdate"), 1)).alias("reversed_gaps"))
    coarse_ = o.agg(F.count(F.when(F.col("o_orderkey") % 3 == 2, 1)).alias("too_coarse"))
    c = read(spark, d, "customer")
    named = c.filter("c_custkey % 50 = 1").select(F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") * 3).cast("string"), 9, "0")).alias("c_name"))
    return tied.crossJoin(gaps).crossJoin(coarse_).crossJoin(O.unresolved(named, c, "c_name"))


@query("diag_6_folded_funnel", f"select *, lag(rows) over (order by step) - rows as lost from ({_funnel_sql()})")
def folded(spark, d):
    return O.folded(O.funnel(_orders(spark, d), "o_custkey", _steps()))


@query("diag_7_diff", "select count(case when not b then 1 end) as only_before, count(case when not a then 1 end) as only_after, count(case when a and b then 1 end) as both from (select o_totalprice > 100000 as a, o_orderstatus = 'O' as b from orders) where a or b")
def diff(spark, d):
    o = _orders(spark, d)
    return O.diff(o.filter("o_totalprice > 100000"), o.filter("o_orderstatus = 'O'"), "o_orderkey")
