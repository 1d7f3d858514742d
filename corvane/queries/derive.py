"""Derived facts over order lines, parts, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import derive as D
from corvane.operators import diffusion as DF
from corvane.plans.grains import read, retail

from .base import query


def _lines(spark, d):
    return read(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate"))


_KEY = "md5(l_returnflag || '|' || l_linestatus || '|' || cast(round(l_discount * 100) as bigint) || '|' || cast(round(l_tax * 10) as bigint))"


@query("der_1_signature_units", f"select l_orderkey, l_linenumber, {_KEY} as unit_key, (dense_rank() over (partition by l_orderkey order by {_KEY}))::int as unit_index from lineitem")
def signature_units(spark, d):
    return D.units(_lines(spark, d), "l_orderkey", D.signature_key(["l_returnflag", "l_linestatus"], {"l_discount": 2, "l_tax": 1})).select("l_orderkey", "l_linenumber", "unit_key", "unit_index")


_ORIENT = """with v as (select vec_id, case when vec_id % 4 = 0 then 1.0::double else embedding[1]::double end as a1, case when vec_id % 4 = 0 then 1.0::double else embedding[2]::double end as a2, case when vec_id % 4 = 0 then 0.0::double else embedding[3]::double end as a3, case when vec_id % 4 = 0 then 0.0::double else embedding[4]::double end as b1, case when vec_id % 4 = 0 then 1.0::double else embedding[5]::double end as b2, case when vec_id % 4 = 0 then 1.0::double else embedding[6]::double end as b3 from embeddings),
n as (select vec_id, abs(a2 * b3 - a3 * b2) as x, abs(a3 * b1 - a1 * b3) as y, abs(a1 * b2 - a2 * b1) as z from v)
select vec_id, case when greatest(x, y, z) = x then 'sagittal' when greatest(x, y, z) = y then 'coronal' else 'axial' end as orientation, round(greatest(x, y, z) / sqrt(x * x + y * y + z * z), 6) as orientation_confidence from n where x + y + z > 0"""


@query("der_2_orientation", _ORIENT)
def orientation(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", *[F.when(F.col("vec_id") % 4 == 0, F.lit(tied)).otherwise(F.element_at("embedding", i + 1).cast("double")).alias(f"v{i}") for i, tied in enumerate((1.0, 1.0, 0.0, 0.0, 1.0, 1.0))])
    return D.orientation(e, ["v0", "v1", "v2"], ["v3", "v4", "v5"]).filter("orientation is not null").select("vec_id", "orientation", "orientation_confidence")


@query("der_3_split_fold", """with b as (select l_orderkey, l_linestatus, l_returnflag, case when l_partkey % 13 > 0 then l_suppkey % 2 end as p, case when l_orderkey % 3 = 0 then 1 when l_orderkey % 3 = 1 and l_linenumber % 2 = 0 then 1 when l_orderkey % 3 = 2 then l_linenumber end as m from lineitem),
s as (select l_orderkey, l_linestatus, l_returnflag, list_sort(list(p)) as ps, count(*) = count(p) as known, count(m) > 0 as timed from b group by 1, 2, 3),
f as (select l_orderkey, l_linestatus, count(*) as v, count(distinct ps) = 1 and bool_and(known) and bool_and(timed) as apart from s group by 1, 2),
m as (select l_orderkey, l_linestatus, count(distinct m) as ms from b group by 1, 2)
select l_orderkey, l_linestatus, v >= 2 and ms < 2 and not apart as merged from f join m using (l_orderkey, l_linestatus)""")
def split_fold(spark, d):
    third = F.col("l_orderkey") % 3
    moment = F.when((third == 0) | ((third == 1) & (F.col("l_linenumber") % 2 == 0)), 1).when(third == 2, F.col("l_linenumber"))
    b = _lines(spark, d).select("l_orderkey", "l_returnflag", "l_linestatus", F.when(F.col("l_partkey") % 13 > 0, F.col("l_suppkey") % 2).alias("p"), moment.alias("m"))
    return D.merge_split(b, "l_orderkey", ["l_linestatus"], "l_returnflag", "m", "p").select("l_orderkey", "l_linestatus", "merged").distinct()


@query("der_4_fingerprint", "select l_orderkey, arg_min(p_brand, (l_linenumber, l_partkey, l_suppkey)) as first_brand, arg_min(s_name, (l_linenumber, l_partkey, l_suppkey)) as first_supplier, count(*) as n_rows, max(l_quantity) as hi_quantity, round(sum(l_extendedprice), 2) as total, min(o_orderstatus) as status from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey group by 1")
def fingerprint(spark, d):
    rows = _lines(spark, d).join(read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    rows = rows.join(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").join(read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    first = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    return rows.groupBy("l_orderkey").agg(F.min_by("p_brand", first).alias("first_brand"), F.min_by("s_name", first).alias("first_supplier"), F.count(F.lit(1)).alias("n_rows"), F.max("l_quantity").alias("hi_quantity"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.min("o_orderstatus").alias("status"))


_POS = """with recursive p as (select distinct l_partkey as k, l_quantity::double as x from lineitem),
h as (select k, min(x) as x from p group by 1 union all select h.k, (select min(q.x) from p q where q.k = h.k and q.x - h.x > 3) from h where exists (select 1 from p q where q.k = h.k and q.x - h.x > 3))"""


@query("der_5_positions", f"{_POS} select h.k as l_partkey, count(*)::int as n_positions, any_value(r.span) as span, any_value(r.centre) as centre from h join (select k, round(max(x) - min(x), 2) as span, round((max(x) + min(x)) / 2, 2) as centre from p group by 1) r using (k) group by 1")
def positions(spark, d):
    return D.positions(_lines(spark, d), "l_partkey", "l_quantity", 3.0)


@query("der_6_coverage", "with a as (select l_orderkey, max(l_quantity) - min(l_quantity) as span, (max(l_quantity) + min(l_quantity)) / 2 as c, case when l_orderkey % 5 > 0 then count(*) end as n from lineitem group by 1) select x.l_orderkey, case when x.n is null or y.n is null then false when x.n <> y.n then true else abs(x.span - y.span) > greatest(1, 0.2 * greatest(x.span, y.span)) end as differs, coalesce(abs(x.c - y.c) > 5, false) as moved from a x join a y on y.l_orderkey = x.l_orderkey + 1")
def coverage(spark, d):
    a = _lines(spark, d).groupBy("l_orderkey").agg((F.max("l_quantity") - F.min("l_quantity")).alias("span"), ((F.max("l_quantity") + F.min("l_quantity")) / 2).alias("c"), F.count(F.lit(1)).alias("n")).withColumn("n", F.when(F.col("l_orderkey") % 5 > 0, F.col("n")))
    b = a.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("span").alias("span2"), F.col("c").alias("c2"), F.col("n").alias("n2"))
    differs, moved = D.coverage_differs(F.col("n"), F.col("n2"), F.col("span"), F.col("span2"), F.col("c"), F.col("c2"), 0.2, 5)
    return a.join(b, "l_orderkey").select("l_orderkey", differs.alias("differs"), moved.alias("moved"))


_SCALE = """with g(s, w) as (values (0.5::double, 0.15::double), (1.0, 0.15), (1.5, 0.15), (3.0, 0.3), (7.0, 0.5)), u(rank, unit, ratio) as (values (1, 'tesla', 1), (2, 'gauss', 10000), (3, 'milli', 1000)),
x as (select c_custkey, case when c_custkey % 3 = 0 then c_acctbal / 1000 when c_custkey % 3 = 1 then c_acctbal * 4 else c_acctbal end as x from customer),
h as (select c_custkey, x / ratio as t, s, unit from x, u, g where x > 0 and abs(x / ratio - s) <= w qualify row_number() over (partition by c_custkey order by rank, s) = 1)
select c_custkey, case when x > 0 then round(coalesce(t, x), 6) end as tesla, s as normalized, case when x > 0 then coalesce(unit, 'tesla') end as unit from x left join h using (c_custkey)"""


@query("der_7_scale", _SCALE)
def scale(spark, d):
    x = F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") / 1000).when(F.col("c_custkey") % 3 == 1, F.col("c_acctbal") * 4).otherwise(F.col("c_acctbal"))
    rows = read(spark, d, "customer").select("c_custkey", D.field_strength(x).alias("f"))
    return rows.select("c_custkey", F.round("f.tesla", 6).alias("tesla"), "f.normalized", "f.unit")


@query("der_8_fill_with_source", "select p_partkey, case when contains(p_type, 'PROMO') then 'metal' when regexp_matches(p_name, '(?i)green|blue') then 'paint' when p_size > 25 then 'big' end as kind, case when contains(p_type, 'PROMO') then 'type' when regexp_matches(p_name, '(?i)green|blue') then 'name' when p_size > 25 then 'size' end as source from part")
def fill(spark, d):
    kind, source = D.first_of((F.when(F.col("p_type").contains("PROMO"), "metal"), "type"), (F.when(F.col("p_name").rlike("(?i)green|blue"), "paint"), "name"), (F.when(F.col("p_size") > 25, "big"), "size"))
    return read(spark, d, "part").select("p_partkey", kind.alias("kind"), source.alias("source"))


@query("der_9_role", "select p_partkey, case when list_contains(string_split(p_type, ' '), 'ECONOMY') then 'primary' when list_contains(string_split(p_type, ' '), 'SMALL') then 'derived' else 'other' end as role from part")
def role(spark, d):
    return read(spark, d, "part").select("p_partkey", D.role(F.split("p_type", " "), [("ECONOMY", "primary"), ("SMALL", "derived")], "other").alias("role"))


_SHELLS = """with r as (select l_orderkey, cast(round(l_quantity / 20) * 20 as bigint) as q, round(l_discount - 0.05, 2) + 0.0 as x, round(l_tax - 0.04, 2) + 0.0 as y, case when l_suppkey % 4 > 0 then l_linestatus end as ph from lineitem where l_returnflag <> 'N'),
d as (select *, coalesce(case when x <> 0 then sign(x) end, case when y <> 0 then sign(y) end, 1) as g from r)
select l_orderkey, array_to_string(list_transform(list_sort(list(distinct q)), lambda v: v::varchar), ',') as shells, count(distinct case when q <> 0 then (round(x * g, 2) + 0.0)::varchar || ',' || (round(y * g, 2) + 0.0)::varchar end) as directions, case when count(distinct ph) = 1 then min(ph) end as encoding from d group by 1"""


@query("der_10_shells", _SHELLS)
def shells(spark, d):
    rows = _lines(spark, d).withColumns({"x": F.col("l_discount") - 0.05, "y": F.col("l_tax") - 0.04, "ph": F.when(F.col("l_suppkey") % 4 > 0, F.col("l_linestatus"))})
    return D.shells(rows, "l_orderkey", "l_quantity", 20, F.col("l_returnflag") != "N", ["x", "y"], "ph")


_COSINES = ["1\\0\\0\\0\\1\\0", "0,1,0,0,0,-1", "0.9\\0.1\\0.42\\-0.2\\0.93\\-0.3", "1\\0\\0\\0\\-0.6\\0.8", "1\\0", "-1\\0\\0\\0\\0.5\\0.5"]
_NAMES = ["ep2d_b1000_AP", "dwi b=800 32dir PA", "isob1000 dir_12", "B0-500-1000 RL", "t1 mprage", "slab1000 LR", "b1000mm 300dir", "dti 6 riktningar", "*ep_b700t", "ax_grappa 1dir 12 dir"]
_DIFFUSION = rf"""with r as (select l_orderkey as u, case when l_suppkey % 4 = 0 then l_quantity::int // 10 * 200 end as a, case when l_suppkey % 4 = 1 then l_quantity::int // 25 * 500 || '\' || l_quantity::int * 400 end as std, case when l_suppkey % 4 = 2 then round(l_discount * 100)::int || '\' || round(l_tax * 100)::int || '\0' end as grad, case l_linenumber % 3 when 0 then 'NONE' when 1 then 'DIRECTIONAL' end as kind, case when l_orderkey % 17 = 0 then l_partkey % 30 end as counted,
{_COSINES}[1 + l_orderkey % 7] as iop, case l_orderkey % 3 when 0 then 'COL' when 1 then 'ROW' end as plane, case when l_orderkey % 5 < 4 then (case when l_orderkey % 13 = 0 then l_linenumber else l_orderkey // 2 end) % 2 end as pos, {_NAMES}[1 + (l_orderkey + case when l_orderkey % 19 = 0 then l_linenumber else 0 end) % 11] as t from lineitem),
s as (select *, coalesce(a::varchar, std, grad, kind) is not null as said, list_transform(string_split(grad, '\'), lambda v: round(v::double * 10000)::bigint) as v, list_filter(list_transform(string_split(replace(iop, ',', '\'), '\'), lambda x: try_cast(trim(x) as double)), lambda x: x is not null) as c,
nullif(regexp_extract(t, '(?i)(?:^|[^0-9a-z])(AP|PA|RL|LR)(?:[^0-9a-z]|$)', 1), '') as tw,
coalesce(list_filter(list_transform(regexp_extract_all(t, '(?i)([0-9]+) *(?:dir|rikt)', 1), lambda x: x::int), lambda x: x between 2 and 256)[1], try_cast(nullif(regexp_extract(t, '(?i)dir[ _]*([0-9]+)', 1), '') as int)) as tc from r),
q as (select *, case plane when 'COL' then c[4:6] when 'ROW' then c[1:3] end as p from s),
w as (select *, case when len(c) >= 6 and pos is not null then case when abs(p[3]) >= greatest(abs(p[1]), abs(p[2])) then case when (p[3] >= 0) = (pos = 1) then 'IS' else 'SI' end when abs(p[2]) >= abs(p[1]) then case when (p[2] >= 0) = (pos = 1) then 'AP' else 'PA' end when abs(p[1]) > 0 then case when (p[1] >= 0) = (pos = 1) then 'RL' else 'LR' end end end as way from q),
b as (select u, a as b, 'p' as k from r where a between 0 and 10000 union select u, unnest(string_split(std, '\'))::int, 's' from r),
b2 as (select distinct * from b where b between 0 and 10000),
e as (select distinct u, unnest(regexp_extract_all(t, '(?i)(?:^|[_ =\-:/*]|iso)b[ =\-]?([0-9]{{1,4}}(?:[-/_][0-9]{{1,4}})*)t?(?:[^0-9a-z]|$)', 1)) as run from r),
x as (select distinct u, unnest(string_split(replace(run, '_', '-'), '-'))::int as b from e),
m as (select u from b2 group by u having max(b) > 0),
f as (select * from b2 union select u, b, 't' from x where u not in (select u from m)),
sh as (select u, max(b) as shell, array_to_string(list_transform(list_sort(list(distinct b)), lambda y: y::varchar), ',') as shells, concat_ws(',', case when bool_or(k = 'p') then 'private' end, case when bool_or(k = 's') then 'standard' end, case when bool_or(k = 't') then 'text' end) as shell_source from f group by u),
g as (select u, bool_or(said) as said, count(counted) as counts, case when min(case when counted between 1 and 1024 then counted end) = max(case when counted between 1 and 1024 then counted end) then max(case when counted between 1 and 1024 then counted end) end as counted, count(distinct case when coalesce(kind, '') <> 'NONE' and (v[1] <> 0 or v[2] <> 0) then v end) as vectors, min(way) as w1, max(way) as w2, min(tw) as t1, max(tw) as t2, case when min(tc) = max(tc) then min(tc) end as tc from w group by u),
j as (select *, said or counts > 0 or shell is not null as on_, said and w1 is not null as geo from g left join sh using (u))
select u as l_orderkey, shell, shells, shell_source, case when on_ then case when geo then case when w1 = w2 then w1 end when t1 = t2 then t1 end end as way, case when on_ then case when geo then case when w1 = w2 then 'geometry' else 'conflict' end when t1 = t2 then 'text' when t1 <> t2 then 'conflict' end end as way_source,
case when on_ then coalesce(counted, nullif(vectors, 0), tc) end::bigint as directions, case when on_ then case when counted is not null then 'vendor_count' when vectors > 0 then 'gradients' when tc is not null then 'text' end end as directions_source from j"""


@query("der_10_diffusion_facts", _DIFFUSION.replace("\\\\", "\\"))
def diffusion_facts(spark, d):
    order, supplier, n = F.col("l_orderkey"), F.col("l_suppkey") % 4, F.col("l_quantity").cast("int")
    one_of = lambda texts, at: F.get(F.array(*map(F.lit, texts)), at.cast("int"))
    slashed = lambda *parts: F.concat_ws("\\", *parts)
    rows = read(spark, d, "lineitem").select(
        "l_orderkey",
        F.when(supplier == 0, F.floor(n / 10).cast("int") * 200).alias("private"),
        F.when(supplier == 1, slashed(F.floor(n / 25) * 500, n * 400)).alias("standard"),
        F.when(supplier == 2, slashed(F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int"), F.lit("0"))).alias("gradient"),
        F.when(F.col("l_linenumber") % 3 == 0, "NONE").when(F.col("l_linenumber") % 3 == 1, "DIRECTIONAL").alias("kind"),
        F.when(order % 17 == 0, F.col("l_partkey") % 30).alias("counted"),
        one_of(_COSINES, order % 7).alias("cosines"),
        F.when(order % 3 == 0, "COL").when(order % 3 == 1, "ROW").alias("plane"),
        F.when(order % 5 < 4, F.when(order % 13 == 0, F.col("l_linenumber")).otherwise(F.floor(order / 2)) % 2).alias("positive"),
        one_of(_NAMES, (order + F.when(order % 19 == 0, F.col("l_linenumber")).otherwise(0)) % 11).alias("name"),
    )
    return DF.facts(rows, "l_orderkey", DF.Fields(("private",), "standard", "gradient", ("kind",), "counted", "cosines", "plane", "positive", "name"))


_SECONDS = "select user_id, event_type || user_id % 3 || hour(ts) // 12 as event_type, cast(ts as date) as day, epoch(ts)::double as s, case when user_id % 10 = 0 then 60.0 end as stated from events where event_type in ('view', 'click')"


@query("der_11_frame_interval", f"with p as (select user_id, event_type, min(s) as a, max(s) as b, count(distinct s) as n, count(distinct day) as days, max(stated) as st from ({_SECONDS}) group by 1, 2) select user_id, round(coalesce(max(st), median(case when n > 1 and days <= 1 then (b - a) / (n - 1) end)), 4) as frame_interval, case when max(st) > 0 then 'stated' when median(case when n > 1 and days <= 1 then (b - a) / (n - 1) end) is not null then 'derived' end as interval_source from p group by 1")
def frame_interval(spark, d):
    e = read(spark, d, "events").filter("event_type in ('view', 'click')").select("user_id", F.concat("event_type", F.col("user_id") % 3, F.floor(F.hour("ts") / 12)).alias("event_type"), F.to_date("ts").alias("day"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"), F.when(F.col("user_id") % 10 == 0, 60.0).alias("stated"))
    return D.frame_interval(e, "user_id", "event_type", "s", "stated", "day")


@query("der_12_earliest", "select user_id, min(cast(ts as date)) as day, strftime(min(ts), '%H:%M:%S') as time from events group by 1")
def earliest(spark, d):
    e = retail(spark, d).scan("event").withColumn("time", F.date_format("ts", "HH:mm:ss"))
    return D.earliest(e, "user_id", "day", "time")


@query("der_13_normal_text", "select doc_id, length(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))) as n from documents where text is not null")
def normal_text(spark, d):
    return read(spark, d, "documents").filter("text is not null").select("doc_id", F.length(D.normal_text(F.col("text"))).cast("long").alias("n"))


@query("der_14_wide_model", "select l_orderkey, string_agg(distinct l_returnflag, ',' order by l_returnflag) as flag, string_agg(distinct l_linestatus, ',' order by l_linestatus) as status from lineitem group by 1")
def wide_model(spark, d):
    rows = _lines(spark, d)
    long = rows.select("l_orderkey", F.lit("flag").alias("axis"), F.col("l_returnflag").alias("value")).union(rows.select("l_orderkey", F.lit("status"), "l_linestatus"))
    return D.wide(long, "l_orderkey", "axis", "value", ["flag", "status"])


@query("der_14_stale_rows", "select l_orderkey, string_agg(distinct l_returnflag, ',' order by l_returnflag) || case when l_orderkey % 50 = 0 then '?' else '' end as flag from lineitem group by 1 having l_orderkey % 50 = 0")
def stale_rows(spark, d):
    long = _lines(spark, d).select("l_orderkey", F.lit("flag").alias("axis"), F.col("l_returnflag").alias("value"))
    now = D.wide(long, "l_orderkey", "axis", "value", ["flag"])
    kept = now.withColumn("flag", F.when(F.col("l_orderkey") % 50 == 0, F.concat("flag", F.lit("?"))).otherwise(F.col("flag")))
    return D.stale(kept, now)


@query("der_15_childless", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def childless(spark, d):
    return D.childless(read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").filter("o_orderstatus = 'P'"), "c_custkey", "o_custkey")


@query("der_16_header_health", """with t as (select p_size as ds, nullif(p_name, p_brand) as name, p_brand from part),
f as (select ds, (coalesce(name, '') = '')::int as a, (not list_has_any(regexp_split_to_array(lower(coalesce(name, '')), '[^a-z0-9]+'), ['red', 'green', 'small', 'part']))::int as b, (p_brand not in ('Brand#11', 'Brand#12', 'Brand#13'))::int as c from t)
select ds, round(avg(a), 6) as nameless, round(avg(b), 6) as unknown_words, round(avg(c), 6) as unseen_maker, greatest(round(avg(a), 6), round(avg(b), 6), round(avg(c), 6)) > 0.9 as damaged from f group by 1""")
def header_health(spark, d):
    p = read(spark, d, "part").withColumnRenamed("p_size", "ds")
    return D.header_health(p, "ds", "p_name", "p_brand", ["red", "green", "small", "part"], ["Brand#11", "Brand#12", "Brand#13"], 0.9)
