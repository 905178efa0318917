"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.plans.scratch import stored

from . import external_shuffle, html_layout, lm_score, near_dup, quality_rank, robust_outliers, secrets, source_mix, toxicity, wu_manber
from .common import crc_share


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lm_score.score_documents(docs, crc_share(docs["doc_id"], 10, 0))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract(_table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, ~crc_share(F.col("doc"), 4, 2))
    found = toxicity.score(docs, model)
    return found.select("doc_id", crc_share(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = source_mix.plan(_table(spark, sf_dir, "documents"))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    times = F.col("whole") + (F.col("copy") <= F.col("extra")).cast("int")
    return each.select("doc_id", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    found = external_shuffle.shuffle(docs, key=F.xxhash64("doc_id", "text"), size=size)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return found.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit(external_shuffle.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    x = stored(quality_rank.vectors(docs), "quality-vectors")
    found = quality_rank.score_vectors(x, quality_rank.fit_all(x, labels, ~crc_share(F.col("doc"), 3, 1)))
    return found.select("doc_id", crc_share(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = wu_manber.scan(docs, _table(spark, sf_dir, "benchmark"), prefix="")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = robust_outliers.assess(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, threshold_pct=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_lm_scoring, op2_html_extraction, op3_toxicity, op4_source_mixing, op5_sharding, op6_quality_classifier, op7_benchmark_decontamination, op8_secret_scan, op9_quality_rules, op10_minhash_near_dedup)}
ORACLE_SQL: dict[str, str] = {
    "op4_source_mixing": r"""
with recursive
d as (select doc_id, source, text, len(regexp_extract_all(coalesce(text,''),'[^\x20\x09-\x0D]+')) size from documents),
s as (select source, sum(size)::bigint n, [5,2,1][((row_number() over (order by source nulls last)-1)%3+1)::int] w from d group by source),
r(round, source, n, w, share, target, done) as (
  select 0, source, n, w, 1.5::double*sum(n) over (), 0::double, false from s
  union all
  select round+1, source, n, w, case when any_full then share-coalesce(sum(case when now then 2.0::double*n end) over (),0) else 0 end,
    case when done then target when now then 2.0::double*n when any_full then 0 else w*unit end, done or now or not any_full
  from (select *, not done and w*unit>=2.0::double*n now, bool_or(not done and w*unit>=2.0::double*n) over () any_full
        from (select *, share/sum(case when not done then w end) over () unit, bool_and(done) over () over_ from r) where not over_)),
t as (select source, n source_size, target, case when n>0 then floor(target/n)::int else 0 end whole from r where round=(select max(round) from r)),
k as (select doc_id, source, size, text, -ln((('0x'||md5('11|'||coalesce(doc_id::varchar,'null')||'|'||md5(coalesce(text,'')))[1:12])::ubigint::double+0.5)/281474976710656.0::double)
  / greatest(coalesce(pow(1-(length(text)-length(regexp_replace(text,'[#*$%&|<>!]','','g')))::double/greatest(length(text),1),2.0),0.01),0.01) key from d),
o as (select k.*, sum(size) over (partition by source order by key, doc_id, text rows unbounded preceding) upto from k)
select doc_id, size, source_size, target, (least(whole + case when target-whole*source_size>0 and upto-size/2.0<=target-whole*source_size then 1 else 0 end, 2)*size)::bigint taken
from o join t on o.source is not distinct from t.source
""",
    "op7_benchmark_decontamination": r"""
with
d as (select doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
iw as (select distinct item_id, len(x) n, array_to_string(x,' ') x from (select item_id, unnest(case when len(w)=0 then [] when len(w)<10 then [w] else [w[k:k+9] for k in range(1,len(w)-8)] end) x from i)),
sizes as (select distinct n from iw),
dw as (select doc_id, n, k, array_to_string(w[k:k+n-1],' ') x from (select doc_id, w, n, unnest(range(1,len(w)-n+2)) k from d, sizes where len(w)>=n)),
o as (select doc_id, item_id, k, dw.n from dw join iw on dw.x=iw.x and dw.n=iw.n),
h as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(k,k+n)) p from o) group by 1),
t as (select doc_id, count(*) n_items, sha256(string_agg(item_id,',' order by item_id)) s from (select distinct doc_id, item_id::varchar item_id from o) group by 1)
select d.doc_id, len(w) n_words, coalesce(n_hit,0) n_hit, coalesce(n_items,0) n_items, coalesce(s,sha256('')) items_sha256, coalesce(n_hit,0)>0 contaminated
from d left join h using(doc_id) left join t using(doc_id)
""",
    "op10_minhash_near_dedup": r"""
with recursive
d as (select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[\x20\x09-\x0D]+') if x<>''] w from documents),
s as (select doc_id, case when len(w)=0 then [] when len(w)<3 then [array_to_string(w,' ')] else list_distinct([array_to_string(w[i:i+2],' ') for i in range(1,len(w)-1)]) end g from d),
e as (select doc_id, unnest(g) x from s),
n as (select doc_id, len(g) n from s),
p as (select a.doc_id a, b.doc_id b, count(*) c from e a join e b on a.x=b.x and a.doc_id<b.doc_id group by 1,2),
l as (select a,b from p join n na on na.doc_id=a join n nb on nb.doc_id=b where 100*c >= 85*(na.n+nb.n-c)),
u as (select a,b from l union all select b,a from l),
r(a,b) as (select doc_id, doc_id from n union select r.a,u.b from r join u on r.b=u.a)
select n.doc_id, n.n n_shingles, c.c component_id, n.doc_id=c.c kept from n join (select a, min(b) c from r group by 1) c on c.a=n.doc_id
""",
}
