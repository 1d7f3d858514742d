"""Sources, sinks, streams and model-side work."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators import models as M
from corvane.plans.grains import read, retail
from corvane.plans.storage import dealt, fresh_path
from corvane.sources import tables as S
from corvane.streaming import arrivals as A

from .base import query
from .review import _DECISIONS


@query("src_2_arrivals", """with f as (select url as path, min(page_id) as p from pages group by 1 having count(*) = 1)
select path, case when p % 10 = 0 then 'new' when p % 10 = 1 then 'vanished' when p % 25 = 7 then 'quarantined' when p % 10 = 2 then 'changed' else 'unchanged' end as state from f""")
def arrivals(spark, d):
    pages = read(spark, d, "pages").groupBy(F.col("url").alias("path")).agg(F.min("page_id").alias("p"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    rows = pages.select("path", (F.col("p") * 3 + 1).alias("size"), F.col("p").alias("mtime"), F.when(F.col("p") % 25 == 7, "quarantined").otherwise("ok").alias("status"), "p")
    now = rows.filter("p % 10 != 1").select("path", F.when(F.col("p") % 10 == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime")
    return S.arrivals(rows.filter("p % 10 != 0").drop("p"), now)


@query("src_3_copies", "select event_id, event_id <> first_value(event_id) over (partition by user_id, event_type, cast(ts as date) order by ts, event_id) as is_copy from events")
def copies(spark, d):
    e = retail(spark, d).scan("event").select("event_id", "user_id", "event_type", "day", "ts")
    return S.copies(e, ["user_id", "event_type", "day"], "ts", "event_id").select("event_id", "is_copy")


@query("src_4_merged_rows", "select l_orderkey, min(l_returnflag) as l_returnflag, min(l_linestatus) as l_linestatus from lineitem group by 1")
def merged(spark, d):
    return S.merged_rows(read(spark, d, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])[0]


@query("src_4_disagreements", "select l_orderkey, 'l_returnflag' as field, count(distinct l_returnflag) as values from lineitem group by 1 having count(distinct l_returnflag) > 1 union all select l_orderkey, 'l_linestatus', count(distinct l_linestatus) from lineitem group by 1 having count(distinct l_linestatus) > 1")
def disagreements(spark, d):
    return S.merged_rows(read(spark, d, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])[1]


SPEC = S.Import({"subject": ("c_custkey", "bigint", None), "day": ("when", "date", "dd.MM.yyyy"), "number": ("value", "double", None)}, ["subject"], "update")
_RAW = "select c_custkey as subject, case when c_custkey % 11 = 0 then null else date '2020-01-01' + (c_custkey % 100)::int end as day, case when c_custkey % 13 = 0 then null else c_acctbal end as number, case when c_custkey % 11 = 0 then 'bad day' when c_custkey % 13 = 0 then 'bad number' end as refused from customer"


def _raw(spark, d):
    when = F.when(F.col("c_custkey") % 11 == 0, "2020-01-01").otherwise(F.date_format(F.date_add(F.lit("2020-01-01"), (F.col("c_custkey") % 100).cast("int")), "dd.MM.yyyy"))
    return read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), when.alias("when"), F.when(F.col("c_custkey") % 13 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("value"))


def _held(spark, d):
    return read(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("subject"), F.date_add(F.lit("2020-01-01"), (F.col("c_custkey") % 100).cast("int")).alias("day"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).otherwise(F.lit(0.0)).alias("number"))


@query("src_5_import_preview", f"select subject, case when refused is not null then 'refused' when subject % 2 = 1 then 'inserted' when subject % 3 = 0 or number = 0 then 'unchanged' else 'updated' end as action from ({_RAW})")
def import_preview(spark, d):
    return S.preview(S.parsed(_raw(spark, d), SPEC), _held(spark, d), SPEC).select("subject", "action")


@query("src_5_imported", f"select subject, case when subject % 2 = 0 and refused is not null then date '2020-01-01' + (subject % 100)::int else day end as day, case when subject % 2 = 0 and refused is not null then (case when subject % 3 = 0 then (select c_acctbal from customer where c_custkey = subject) else 0 end) else number end as number from ({_RAW}) where refused is null or subject % 2 = 0")
def imported(spark, d):
    return S.imported(S.parsed(_raw(spark, d), SPEC), _held(spark, d), SPEC)


@query("src_6_checked_events", "select event_id, case when event_type not in ('click', 'view', 'purchase') then 'unknown kind' when event_type = 'click' and value < 50 then 'below' when event_type = 'purchase' and value > 90 then 'above' end as refused from events")
def checked_events(spark, d):
    kinds = spark.createDataFrame([("click", 50.0, 1e9), ("view", 0.0, 1e9), ("purchase", 0.0, 90.0)], "kind string, lo double, hi double")
    e = read(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), F.col("value").alias("number"))
    return S.checked_events(e, kinds).select("event_id", "refused")


def _values(spark, d):
    return read(spark, d, "orders").filter("o_orderkey % 50 = 3").select(F.col("o_orderkey").alias("position"), F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0")).alias("value"))


_LIST = "(select o_orderkey as position, 'Customer#' || lpad((o_custkey * 2)::varchar, 9, '0') as value from orders where o_orderkey % 50 = 3)"


@query("src_7_resolved", f"select position, value, c_custkey from {_LIST} join customer on c_name = value")
def resolved(spark, d):
    return S.resolved(_values(spark, d), read(spark, d, "customer"), "c_name", "c_custkey")[0]


@query("src_7_unresolved", f"select position, value from {_LIST} where value not in (select c_name from customer)")
def unresolved(spark, d):
    return S.resolved(_values(spark, d), read(spark, d, "customer"), "c_name", "c_custkey")[1]


@query("src_8_selection", "select distinct c_custkey from customer where c_nationkey = 4 or c_custkey % 100 = 5 or c_custkey in (select o_custkey from orders where o_orderkey % 1000 = 9) or c_custkey in (select o_custkey from orders join lineitem on l_orderkey = o_orderkey where l_partkey % 500 = 77)")
def selection(spark, d):
    c, o, li = read(spark, d, "customer"), read(spark, d, "orders"), read(spark, d, "lineitem")
    of = o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    units = li.select("l_orderkey", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("unit"), "l_partkey").join(of, "l_orderkey").distinct()
    wanted = spark.createDataFrame([("cohort", "4")], "grain string, ref string").union(c.filter("c_custkey % 100 = 5").select(F.lit("subject"), F.col("c_custkey").cast("string"))).union(o.filter("o_orderkey % 1000 = 9").select(F.lit("session"), F.col("o_orderkey").cast("string"))).union(units.filter("l_partkey % 500 = 77").select(F.lit("unit"), "unit"))
    grains = {"cohort": (c, "c_nationkey", "c_custkey"), "subject": (c, "c_custkey", "c_custkey"), "session": (o, "o_orderkey", "o_custkey"), "unit": (units, "unit", "o_custkey")}
    return S.selection(wanted, grains, "c_custkey")[0]


@query("src_8_not_found", "select 'subject' as grain, (c_custkey + 100000000)::varchar as ref from customer where c_custkey % 500 = 1")
def not_found(spark, d):
    c = read(spark, d, "customer")
    wanted = c.filter("c_custkey % 500 = 1").select(F.lit("subject").alias("grain"), (F.col("c_custkey") + 100000000).cast("string").alias("ref")).union(c.filter("c_custkey = 7").select(F.lit("subject"), F.lit("7")))
    return S.selection(wanted, {"subject": (c, "c_custkey", "c_custkey")}, "c_custkey")[1]


def _frozen(spark, d):
    return S.freeze(read(spark, d, "orders").filter("o_totalprice > 250000").select("o_orderkey", "o_custkey"), "o_orderkey", page_rows=100, epoch=7)


@query("src_9_handle", "select o_orderkey, o_custkey, row_number() over (order by o_orderkey) - 1 as _position, (row_number() over (order by o_orderkey) - 1) // 100 as _page from orders where o_totalprice > 250000")
def handle(spark, d):
    return _frozen(spark, d)[0]


@query("src_9_handle_row", "with r as (select sha256(concat_ws('|', o_custkey, o_orderkey)) as h from orders where o_totalprice > 250000) select 'o_orderkey,o_custkey' as columns, count(*) as rows, (count(*) + 99) // 100 as pages, 7::bigint as epoch, sha256(concat_ws('|', count(*), coalesce(sum(('0x' || substr(h, 1, 8))::bigint), 0), coalesce(sum(('0x' || substr(h, 9, 8))::bigint), 0))) as hash from r")
def handle_row(spark, d):
    return _frozen(spark, d)[1]


@query("src_10_content_hash", "with r as (select sha256(concat_ws('|', o_custkey, o_orderkey, o_orderstatus)) as h from orders) select count(*) as rows, sha256(concat_ws('|', count(*), sum(('0x' || substr(h, 1, 8))::bigint), sum(('0x' || substr(h, 9, 8))::bigint))) as hash from r")
def content_hash(spark, d):
    return S.content_hash(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))


@query("src_11_saved_selection", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000)")
def saved(spark, d):
    s = S.Selections()
    s.save("rich", lambda use: read(spark, d, "customer").filter("c_acctbal > 9000"))
    s.save("rich", lambda use: read(spark, d, "customer").filter("c_acctbal > 5000"))
    s.save("orders", lambda use: read(spark, d, "orders").join(use("rich").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey"))
    return s.run("orders")


def _label_decisions(spark, d):
    from .review import _decisions

    return _decisions(spark, d).withColumn("blind", F.col("decision_id") % 3 > 0)


_IN_FORCE = f"select unit, axis, value, author, decision_id from ({_DECISIONS}) where committed and not withdrawn qualify row_number() over (partition by unit, axis order by case author when 'person' then 3 when 'agent' then 2 else 1 end desc, case scope when 'stack' then 4 when 'group' then 3 when 'series' then 2 else 1 end desc, decided_at desc, decision_id desc) = 1"


@query("src_12_label_set", _IN_FORCE)
def label_set(spark, d):
    return S.label_set(_label_decisions(spark, d), "unit", "axis", ["unit", "axis", "decision_id"])[0]


@query("src_12_training_set", f"select * from ({_IN_FORCE}) where decision_id % 3 > 0 and unit % 10 <> 0")
def training_set(spark, d):
    rows = _label_decisions(spark, d)
    return S.label_set(rows, "unit", "axis", ["unit", "axis", "decision_id"], rows.filter("unit % 10 = 0").select("unit").distinct(), training=True)[0]


@query("src_13_vote_matrix", "select p_partkey, unnest(['size', 'brand']) as rule, unnest([p_size::varchar, p_brand]) as value from part")
def vote_matrix(spark, d):
    return S.vote_matrix(read(spark, d, "part"), "p_partkey", {"size": "p_size", "brand": "p_brand"})


_MEASURE = "with c as (select * from lineitem where l_linestatus = (select max(l_linestatus) from lineitem)), r as (select * from c qualify row_number() over (partition by l_orderkey order by l_linenumber desc, l_partkey desc) = 1), m as (select l_orderkey, 'quantity' as name, l_quantity::double as number from r union all select l_orderkey, 'discount', l_discount::double from r)"


def _measures(spark, d):
    runs = read(spark, d, "lineitem").select("l_orderkey", "l_linestatus", F.struct("l_linenumber", "l_partkey").alias("run"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    return S.measures(runs, "l_orderkey", "l_linestatus", "run", ["quantity", "discount"])


@query("src_14_measures", f"{_MEASURE} select name, count(*) as n, round(sum(number), 4) as total from m where number is not null group by 1")
def measures(spark, d):
    return _measures(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("number"), 4).alias("total"))


@query("src_14_breaches", f"{_MEASURE} select name, l_orderkey, number from m where name = 'quantity' and (number < 5 or number > 45)")
def breaches(spark, d):
    checks = spark.createDataFrame([("quantity", 5.0, 45.0)], "name string, lo double, hi double")
    return S.breaches(_measures(spark, d), checks).select("name", "l_orderkey", "number")


def _dataset(spark, d):
    return S.manifests(retail(spark, d).scan("session"), "o_custkey", "day", "o_orderkey")


@query("src_15_manifest", "select o_custkey, count(distinct cast(o_orderdate as date)) as sessions, count(distinct o_orderkey) as scans from orders group by 1")
def manifest(spark, d):
    return _dataset(spark, d)["participants"]


@query("src_15_sessions", "select o_custkey, cast(o_orderdate as date) as day, count(distinct o_orderkey) as scans from orders group by 1, 2")
def manifest_sessions(spark, d):
    return _dataset(spark, d)["sessions"]


@query("src_15_scans", "select distinct o_custkey, cast(o_orderdate as date) as day, o_orderkey from orders")
def manifest_scans(spark, d):
    return _dataset(spark, d)["scans"]


def _stream(spark, d, name, files=4):
    """A table as files that arrive one after the other, a batch for each."""
    rows, folder = read(spark, d, name), fresh_path(spark, f"arriving-{name}")
    rows.repartition(files).write.parquet(folder)
    return A.read_stream(spark, rows, folder, files_per_batch=1)


@query("str_1_first_seen", "select count(distinct (user_id, event_type)) as n from events")
def first_seen(spark, d):
    out = A.first_seen(_stream(spark, d, "events"), ["user_id", "event_type"], "ts", "3650 days")
    return A.to_table(out.select("user_id", "event_type")).agg(F.count(F.lit(1)).alias("n"))


@query("str_1_copies_counted", "select user_id, event_type, min(ts)::timestamp as first_seen, max(ts)::timestamp as last_seen, count(*) - 1 as copies from events where ts is not null group by all")
def copies_counted(spark, d):
    out = A.count_copies(_stream(spark, d, "events"), ["user_id", "event_type"], "ts", "3650 days")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})


_DAYS60 = """with recursive days as (select o_custkey, cast(o_orderdate as date) as day, count(*) as n from orders group by all),
heads as (select o_custkey, min(day) as f from days group by 1 union all
  select h.o_custkey, (select min(x.day) from days x where x.o_custkey = h.o_custkey and datediff('day', h.f, x.day) > 60) from heads h where exists (select 1 from days x where x.o_custkey = h.o_custkey and datediff('day', h.f, x.day) > 60)),
spans as (select o_custkey, f, lead(f) over (partition by o_custkey order by f) as g from heads)
select d.o_custkey, f as session_first, max(day) as session_last, sum(n)::bigint as n from days d join spans p on p.o_custkey = d.o_custkey and d.day >= f and (g is null or d.day < g) group by 1, 2"""


@query("str_2_session_rebuild", _DAYS60)
def session_rebuild(spark, d):
    return A.keep_sessions(_stream(spark, d, "orders"), "o_custkey", "o_orderdate", 60, "10000 days")


@query("str_3_running_report", "select event_type, count(*) as rows from events group by 1")
def running_report(spark, d):
    return A.to_table(A.running_report(_stream(spark, d, "events"), ["event_type"]), "complete")


def _prompts(spark, d):
    e = read(spark, d, "embeddings")
    means = e.groupBy("label").agg(*[F.avg(F.element_at("embedding", i + 1).cast("double")).alias(f"v{i}") for i in range(64)])
    return means.select("label", F.array(*[F.round(f"v{i}", 6) for i in range(64)]).alias("prompt"))


def _scores(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.col("label").alias("truth"), F.col("embedding").alias("v"))
    return e, M.zero_shot(e, _prompts(spark, d), "vec_id", "v", 5.0)


_MEANS = ", ".join(f"round(avg(embedding[{i}]::double), 6)" for i in range(1, 65))
_ZERO = f"""with m as (select label, [{_MEANS}] as p from embeddings group by 1), v as (select vec_id, label as truth, list_transform(embedding, lambda x: x::double) as e from embeddings),
s as (select vec_id, truth, label, exp(list_cosine_similarity(e, p) * 5) as x from v, m), t as (select *, sum(x) over (partition by vec_id) as a, row_number() over (partition by vec_id order by x desc, label desc) as r, lead(x) over (partition by vec_id order by x desc, label desc) as nx from s),
z as (select vec_id, truth, label, round(x / a, 6) as probability, round((x - nx) / a, 6) as margin from t where r = 1)"""


@query("ml_1_zero_shot", f"{_ZERO} select vec_id, label, round(probability, 3) as probability, round(margin, 3) as margin from z")
def zero_shot(spark, d):
    return _scores(spark, d)[1].select("vec_id", "label", F.round("probability", 3).alias("probability"), F.round("margin", 3).alias("margin"))


@query("ml_2_gate", "with g as (select *, count(case when l_quantity >= 48 then 1 end) over (partition by l_orderkey) as p, count(*) over (partition by l_orderkey) as n, row_number() over (partition by l_orderkey order by l_quantity desc, l_orderkey * 8 + l_linenumber, l_partkey) as r from lineitem) select l_orderkey, count(*) as kept from g where case when p >= least(2, n) then l_quantity >= 48 else r <= least(2, n) end group by 1")
def gated(spark, d):
    rows = read(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), "l_orderkey", "l_quantity")
    return M.threshold_gate(rows, "l_orderkey", "l_quantity", 48, 2).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("kept"))


_DIVERSE = """with recursive u as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
f as (select vec_id, e from u order by md5('0:' || vec_id), vec_id limit 1),
r as (select 0 as place, vec_id, [e] as es, false as over from f
  union all select place + 1, k, list_append(es, (select e from u where vec_id = k)), g <= 0 from (
    select any_value(place) as place, any_value(es) as es, arg_min(vec_id, (-gap, vec_id)) as k, max(gap) as g from (
      select r.place, r.es, u.vec_id, round(list_min(list_transform(r.es, lambda p: 1 - list_cosine_similarity(u.e, p))), 9) as gap from r, u where not over and r.place < 19) group by place))
select vec_id, place::int as place from r where not over"""


@query("ml_3_diverse", _DIVERSE)
def diverse(spark, d):
    return M.diverse(read(spark, d, "embeddings"), "vec_id", "embedding", 20)


_POOLS = """with b as (select o_orderkey, o_orderpriority, case when o_orderstatus <> 'P' then o_totalprice end as s from orders),
c as (select *, count(s) over (partition by o_orderpriority) as n1, count(*) over (partition by o_orderpriority) - count(s) over (partition by o_orderpriority) as n0, row_number() over (partition by o_orderpriority, s is not null order by s desc nulls last, o_orderkey) as r from b),
t as (select *, least(n1, 24 + greatest(0, 40 - 24 - n0)) as t1 from c) select o_orderkey from t where r <= case when s is not null then t1 else least(n0, 40 - t1) end"""


@query("ml_4_pools", _POOLS)
def pools(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("s"))
    return M.pools(rows, "o_orderpriority", "s", "o_orderkey", 0.6, 40).select("o_orderkey")


@query("ml_5_stratified", "with r as (select o_orderkey, count(*) over (partition by o_orderstatus, o_orderpriority) as n, row_number() over (partition by o_orderstatus, o_orderpriority order by md5('m:' || o_orderkey), o_orderkey) as r from orders) select o_orderkey from r where r <= greatest(1, round(n * 200 / (select count(*) from orders)))")
def stratified(spark, d):
    return M.stratified(read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey", 200, "m").select("o_orderkey")


_SLICES = """with l as (select *, l_suppkey % 40 + 1 as a, l_partkey % 40 + 1 as b, l_quantity as c, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as i, count(*) over (partition by l_orderkey) as n from lineitem),
s as (select *, case when l_orderkey % 3 = 0 then 'Axial' when l_orderkey % 3 = 1 then 'coronal' end as o from l),
x as (select l_orderkey, i, n, o, unnest([{'label': 'brain', 'p': case when o = 'Axial' and l_orderkey % 2 = 0 and i < n / 2 then 0.9 else a / (a + b + c) end}, {'label': 'spine', 'p': case when o = 'Axial' and l_orderkey % 2 = 0 and i >= n / 2 then 0.8 else b / (a + b + c) end}, {'label': 'both', 'p': c / (a + b + c)}], recursive := true) from s),
p as (select l_orderkey, label, any_value(o) as o, any_value(n) as n, round(sum(p * w) / sum(w), 9) as m, round(avg(case when i < g then p end), 9) as f, round(avg(case when i >= n - g then p end), 9) as z from (select *, greatest(1, n * 2 // 5) as g, case when o = 'coronal' and i = n // 2 then 2.0 else 1.0 end as w from x) group by 1, 2),
u as (select l_orderkey, any_value(o) as o, any_value(n) as n, arg_min(label, (-m, label)) as ml, max(m) as mp, arg_min(label, (-f, label)) as fl, max(f) as fp, arg_min(label, (-z, label)) as zl, max(z) as zp from p group by 1),
k as (select *, coalesce(o = 'Axial' and n >= 4 and fl = 'brain' and zl = 'spine', false) as composed from u)
select l_orderkey, case when composed then 'both' else ml end as answer, round(round(case when composed then least(fp, zp) else mp end, 6) + 1e-7, 3)::double as p, case when composed then 'composed' when o = 'coronal' then 'centre' else 'mean' end as rule from k"""


@query("ml_6_unit_answer", _SLICES)
def unit_answer(spark, d):
    w = Window.partitionBy("l_orderkey")
    a, b, c = F.col("l_suppkey") % 40 + 1, F.col("l_partkey") % 40 + 1, F.col("l_quantity")
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = dealt(lines, 3 * lines.count(), "l_orderkey").withColumn("i", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    rows = rows.withColumn("o", F.when(F.col("l_orderkey") % 3 == 0, "Axial").when(F.col("l_orderkey") % 3 == 1, "coronal"))
    split, early = (F.col("o") == "Axial") & (F.col("l_orderkey") % 2 == 0), F.col("i") < F.col("n") / 2
    one = lambda name, p: F.struct(F.lit(name).alias("label"), p.cast("double").alias("p"))
    labels = F.array(one("brain", F.when(split & early, 0.9).otherwise(a / (a + b + c))), one("spine", F.when(split & ~early, 0.8).otherwise(b / (a + b + c))), one("both", c / (a + b + c)))
    return M.unit_answer(rows.select("l_orderkey", "i", "o", F.inline(labels)), "l_orderkey", "i", "label", "p", "o", "brain", "spine", "both").withColumn("p", F.round(F.col("p") + 1e-7, 3))


@query("ml_7_head")
def head(spark, d):
    from pyspark.ml.functions import array_to_vector

    e = read(spark, d, "embeddings")
    model = M.head(e, "embedding", "label", [8, 16])
    out = model.transform(e.select("vec_id", F.col("label").cast("double").alias("truth"), array_to_vector(F.col("embedding").cast("array<double>")).alias("x")))
    return out.select("vec_id", "truth", "prediction")


_LOGITS = "select vec_id, label, list_transform(embedding, lambda x: x::double) as z from embeddings"


@query("ml_8_temperature", f"with l as ({_LOGITS}), g as (select unnest([0.25, 0.5, 1.0, 2.0, 4.0])::double as t) select t as temperature, round(avg(ln(list_sum(list_transform(z, lambda x: exp(x / t)))) - z[label + 1] / t), 6) as loss from l, g group by 1")
def temperature(spark, d):
    e = read(spark, d, "embeddings").withColumn("z", F.col("embedding"))
    return M.temperature(e, "z", "label", [0.25, 0.5, 1.0, 2.0, 4.0]).withColumn("loss", F.round("loss", 6))


@query("ml_9_calibration", "with b as (select least(floor(o_totalprice / 500000 * 15), 14) as b, count(*) as n, avg(o_totalprice / 500000) as p, avg((o_orderstatus = 'O')::int) as r from orders group by 1) select sum(n)::bigint as n, round(sum(n * abs(p - r)) / sum(n), 6) as ece from b")
def calibration(spark, d):
    o = read(spark, d, "orders").withColumn("p", F.col("o_totalprice") / 500000)
    return M.calibration_error(o, "p", F.col("o_orderstatus") == "O").withColumn("ece", F.round("ece", 6))


@query("ml_9_brier", f"with l as ({_LOGITS}) select round(avg(list_sum([(z[i + 1] - (label = i)::int) ** 2 for i in range(0, 64)])), 6) as brier from l")
def brier(spark, d):
    return M.brier(read(spark, d, "embeddings").withColumn("z", F.col("embedding")), "z", "label").select(F.round("brier", 6).alias("brier"))


def _sites(spark, d):
    return read(spark, d, "orders").select("o_orderpriority", ((F.col("o_totalprice") - 150000) / 50000).alias("s"), (F.col("o_orderstatus") == "O").cast("int").alias("y"))


_PLATT = """with recursive o as (select o_orderpriority, ((o_totalprice - 150000) / 50000)::double as s, (o_orderstatus = 'O')::int as y from orders),
n as (select o_orderpriority, sum(y) as pos, sum(1 - y) as neg, count(*) as rows from o group by 1 having sum(y) >= 20 and sum(1 - y) >= 20),
x as (select o_orderpriority, s, case when y = 1 then (pos + 1) / (pos + 2) else 1 / (neg + 2) end::double as t from o join n using (o_orderpriority)),
r as (select o_orderpriority, 0 as i, 0.0::double as a, 0.0::double as b from n
  union all select o_orderpriority, i + 1, a - (h00 * g1 - h10 * g0) / (h11 * h00 - h10 * h10), b - (h11 * g0 - h10 * g1) / (h11 * h00 - h10 * h10) from (
    select o_orderpriority, i, a, b, sum((p - t) * s) as g1, sum(p - t) as g0, sum(p * (1 - p) * s * s) as h11, sum(p * (1 - p) * s) as h10, sum(p * (1 - p)) as h00
    from (select r.*, s, t, 1 / (1 + exp(-(a * s + b))) as p from r join x using (o_orderpriority) where i < 12) group by 1, 2, 3, 4))
select o_orderpriority, round(a, 4) as a, round(b, 4) as b, rows, true as converged from r join n using (o_orderpriority) where i = 12"""


@query("ml_10_platt", _PLATT)
def platt(spark, d):
    fitted = M.platt(_sites(spark, d), "o_orderpriority", "s", "y")[0]
    return fitted.withColumn("a", F.round("a", 4)).withColumn("b", F.round("b", 4))


@query("ml_11_fused", "select l_orderkey * 8 + l_linenumber as k, round(-1 + case when l_quantity > 10 then l_quantity * 0.05 else 0.2 end + case when l_discount > 0.02 then l_discount * 3 else -0.1 end, 6)::double as logit from lineitem")
def fused(spark, d):
    rows = read(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("double")).alias("a"), F.when(F.col("l_discount") > 0.02, F.col("l_discount").cast("double")).alias("b"))
    return rows.select("k", F.round(M.fused(rows, {"a": (0.05, 0.2), "b": (3.0, -0.1)}, -1.0), 6).alias("logit"))


@query("ml_12_to_do", "select doc_id from documents where doc_id not in (select doc_id from labels where toxic = 0 and quality = 1)")
def to_do(spark, d):
    done = read(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("rejected"), (F.col("quality") == 0).alias("replaced"))
    return M.to_do(read(spark, d, "documents").select("doc_id"), done, ["doc_id"])


@query("ml_12_reuse", "with r as (select o_custkey % 700 as k, o_orderkey as result, cast(o_orderdate as date) as made from orders where o_orderstatus <> 'P' and o_orderpriority <> '5-LOW') select c_custkey, (select arg_max(result, (made, result)) from r where r.k = c_custkey) as result from customer")
def reuse(spark, d):
    results = read(spark, d, "orders").select((F.col("o_custkey") % 700).alias("k"), F.col("o_orderkey").alias("result"), F.to_date("o_orderdate").alias("made"), (F.col("o_orderstatus") == "P").alias("rejected"), (F.col("o_orderpriority") == "5-LOW").alias("replaced"))
    return M.reusable(read(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("k")), results, "k").select("c_custkey", "result")
