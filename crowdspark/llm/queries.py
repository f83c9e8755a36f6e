"""Queries op1 ... op13 over the whole tables, with their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import decode_documents, encode_documents
from .common import WORDS, table
from .embedding_dedup import embedding_groups
from .exact_dedup import exact_dedup
from .langid import identify_language
from .lm import score_documents
from .mixing import mix_sources
from .packing import pack_documents
from .periodic_runs import periodic_runs
from .quality import grade_documents
from .resampling import resample
from .sharding import shard_documents
from .simhash import simhash_groups
from .suffix_dedup import remove_repeats


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = r"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
  from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(concat_ws('/', '17', cast(doc_id as varchar), coalesce(text, ''))) as key
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by 1),
w as (select *, [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w,
             source_size::double * 2 as cap from s),
c as (select *, sum(cap) over (order by cap / w, source nulls last rows unbounded preceding) as cap_sum,
             sum(w) over (order by cap / w, source nulls last rows unbounded preceding) as w_sum,
             sum(w) over () as all_w, (sum(source_size) over ())::double * 1.5 as goal from w),
k as (select *, cap_sum + cap / w * (all_w - w_sum) < goal as capped from c),
t as (select source, source_size, case when capped then cap else least(cap,
        (goal - sum(case when capped then cap else 0 end) over ())
        / nullif(sum(case when capped then 0.0::double else w end) over (), 0) * w) end as target from k),
p as (select d.doc_id, d.size, t.source_size, t.target,
             case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs,
             coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id
               rows between unbounded preceding and 1 preceding), 0)::bigint as before
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(floor(target - epochs * source_size + 0.5)::bigint - before, size)))::bigint as taken
from p
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row_key", "score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where every tenth document by h = crc32(doc_id) repeats a stretch of its words
    to its end: from word a = g % n on with period 1 + floor((n - a) / (3 + g % 8)), g = floor(h / 10)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    tail = F.col("n") - F.col("a")
    rows = rows.withColumn("p", (1 + F.floor(tail / (3 + F.col("g") % 8))).cast("int"))
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    repeated = F.slice(F.flatten(F.array_repeat(period, F.ceil(tail / F.col("p")).cast("int"))), F.lit(1), tail)
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), repeated), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    # runs come by start, then period, so the first of equal exponents stays
    best = F.aggregate("runs", F.element_at("runs", 1), lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"),
                        F.when(F.size("runs") > 0, best).alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), F.col("best.period")
    return rows.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
                       F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode_documents(encode_documents(table(spark, sf_dir, "documents")))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


# CRC-32 byte by byte from a table of its 256 steps, made by eight shifts each.
OP13_SQL = r"""
with recursive step(i, k, c) as (
  select i, 0, i from range(256) r(i)
  union all
  select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from step where k < 8),
crc as (select list(c order by i) as tab from step where k = 8),
d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
dw as (select doc_id, unnest(w) as w from d),
dn as (select w, count(*) as n from dw group by 1),
bn as (select w, count(*) as n from (select unnest(w) as w from b) group by 1),
bytes as (
  select w, list_transform(range(octet_length(encode(w))), lambda k: ('0x' || substr(hex(encode(w)), 2 * k + 1, 2))::bigint) as v
  from (select w from dn union select w from bn)),
hashed as (
  select w, xor(list_reduce(list_prepend(4294967295::bigint, v),
                            lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 10000 as bucket
  from bytes, crc),
counts as (
  select bucket, sum(coalesce(dn.n, 0)) as s, sum(coalesce(bn.n, 0)) as t
  from hashed left join dn using (w) left join bn using (w) group by 1),
gain as (
  select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double
                                 / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as g from counts),
weights as (
  select doc_id, floor(sum(g)::double / count(*))::bigint as weight
  from dw join hashed using (w) join gain using (bucket) group by 1),
scored as (
  select d.doc_id, len(w)::bigint as n_features, coalesce(weight, 0) as weight,
         ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint as h
  from d left join weights using (doc_id)),
final as (
  select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score, n_features >= 20 as able from scored),
placed as (
  select *, row_number() over (partition by able order by score desc, doc_id) as place,
         count(*) over (partition by able) as n from final)
select doc_id, n_features, weight, score, case when able and place <= n * 10 // 100 then place end as rank from placed
"""

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_sharding": op2_sharding,
    "op3_lm_scores": op3_lm_scores,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_quality": op8_quality,
    "op9_language_id": op9_language_id,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_resampling": op13_resampling,
}
ORACLE = {
    "op1_exact_dedup": OP1_SQL,
    "op6_mixing": OP6_SQL,
    "op13_resampling": OP13_SQL,
}
