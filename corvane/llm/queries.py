"""The registered queries of this package and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, exact_dedup, hard_negatives, histogram_packing, katz, mixing, ngram_join, packing, pseudonyms, quality, sharding, toxicity, whitening
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"), repetition=2.0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"), width=4, percent=85)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"))


#: The key of the registered query only; users bring their own, from a secret store.
DEMO_KEY = "demonstration"


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY).select("doc_id", "text", "n_replaced")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_packing.pack(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), anchor=F.col("vec_id") % 100 == 0, label=label)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_toxicity, op3_quality_classifier, op4_quality_rules, op5_ngram_jaccard, op6_exact_dedup, op7_pseudonyms, op8_sharding, op9_packing, op10_katz, op11_best_fit_packing, op12_hard_negatives, op13_whitening)}

SQL = {
    "op12_hard_negatives": r"""
with r as (
  select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end) as label, list_transform(embedding, lambda x: floor(256 * x::double)) as x
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, other_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, p.positive_id, (row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id))::int as rank, s.other_id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score
qualify rank <= 5""",
    "op8_sharding": r"""
with r as (select doc_id, coalesce(octet_length(encode(text)), 0) as n_bytes, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || chr(31) || md5(coalesce(text, ''))), 1, 15))::bigint as k from documents),
d as (select unnest(range(0, 41)) as d),
s as (select d, k >> (60 - d)::int as p, sum(n_bytes)::bigint as b from r, d group by all),
l as (select r.doc_id, r.n_bytes, r.k, min(s.d) as depth from r, s where s.p = r.k >> (60 - s.d)::int and s.b <= 1048576 group by all)
select l.doc_id, l.n_bytes, right(lpad(bin(l.k >> (60 - l.depth)::int), 64, '0'), l.depth::int) as shard, l.depth::int as depth, s.b as shard_bytes, true as fits
from l join s on s.d = l.depth and s.p = l.k >> (60 - l.depth)::int""",
    "op6_exact_dedup": r"""
with t as (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
g as (select norm, count(*) as group_size, arg_min(doc_id, (-length(text), doc_id)) as keep_id from t group by norm)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256 from t join g using (norm)""",
    "op5_ngram_jaccard": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents where text is not null),
s as (select distinct doc_id, unnest(case when len(ws) < 4 then [array_to_string(ws, ' ')] else [array_to_string(ws[i:i + 3], ' ') for i in range(1, len(ws) - 2)] end) as g from w where len(ws) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b using (g) where a.doc_id <> b.doc_id group by all),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= 85 * (a.n + b.n - shared)),
r as (select doc_id as x, doc_id as y from documents union select r.x, e.y from r join e on r.y = e.x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(r.y) from r where r.x = d.doc_id) as component_id from documents d left join n using (doc_id)""",
}
