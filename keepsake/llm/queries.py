"""The numbered queries over the given tables, and their SQL where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm import (
    decontaminate,
    filter_audit,
    hard_negatives,
    html_text,
    jaccard,
    languages,
    licenses,
    packing,
    quality,
    token_counts,
    topk,
    warc,
    wavelet,
)
from keepsake.llm.common import crc_rest, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """A public tokenizer's file: in the folder PUBLIC_TOKENIZERS names, else of the package."""
    folder = os.environ.get("PUBLIC_TOKENIZERS")
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack(docs, tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=0)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


#: Where a document would stand in a source tree: every tenth is a licence file of its folder,
#: every hundredth of its language's folder, every thousandth of its source's.
PATH_SQL = """
case when doc_id % 1000 = 0 then concat(coalesce(source, ''), '/LICENSE-', cast(doc_id as string))
     when doc_id % 100 = 0 then concat(coalesce(source, ''), '/', coalesce(lang, ''), '/LICENSE-', cast(doc_id as string))
     when doc_id % 10 = 0 then concat(coalesce(source, ''), '/', coalesce(lang, ''), '/d', cast(doc_id % 7 as string), '/LICENSE-', cast(doc_id as string))
     else concat(coalesce(source, ''), '/', coalesce(lang, ''), '/d', cast(doc_id % 7 as string), '/', cast(doc_id as string), '.txt') end
"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(PATH_SQL).alias("path"))
    return licenses.scan(docs).drop("text")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rest = crc_rest(F.col("doc_id"), 5)
    model = languages.train(docs, rest > 0)
    return languages.predict(docs.drop("lang"), model).select(
        "doc_id", (rest == 0).alias("held_out"), "lang_pred", "score"
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rest = crc_rest(F.col("doc_id"), 3)
    network = quality.train(docs, table(spark, sf_dir, "labels"), rest.isin(0, 2))
    return quality.score(docs, network).select(
        "doc_id", (rest == 1).alias("held_out"), "score", "predicted"
    )


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    vectors = given.filter(topk.usable(F.col("embedding"))).select(
        "vec_id", topk.quantised(F.col("embedding")).alias("vector")
    )
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5).select(
        "query_id", "rank", "vec_id", "score"
    )


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_groups(table(spark, sf_dir, "documents"), jaccard.Spec(3, 90))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    files = wavelet.write_shards(docs, tokenizer("word_bpe_49k.json"), end_id=1)
    read = wavelet.read_shards(files, kind)
    return read.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    read = warc.read_archives(warc.write_archives(pages))
    return read.select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), size=13)
    return scanned.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.prefix_tables(docs, tokenizer("piece_bpe_32k.model"))
    return counted.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit")
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings").filter(topk.usable(F.col("embedding")))
    label = F.col("label")
    rows = given.select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        topk.quantised(F.col("embedding")).alias("vector"),
    )
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return filter_audit.audit(spark, f"{sf_dir.rstrip('/')}/documents.parquet", labels)


def queries() -> dict[str, Query]:
    found = (
        op1_best_fit_packing,
        op2_license_scan,
        op3_html_extraction,
        op4_language_id,
        op5_quality_classifier,
        op6_exact_top_k,
        op7_ngram_jaccard_join,
        op8_token_files,
        op9_warc,
        op10_decontamination,
        op11_token_counts,
        op12_hard_negatives,
        op13_filter_audit,
    )
    return {f.__name__: f for f in found}


def _op2_sql() -> str:
    rows = ", ".join(
        f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(licenses.TEMPLATES)
    )
    named = f"regexp_matches(split_part(path, '/', -1), '{licenses.LICENCE_NAMES}')"
    return f"""
with f as materialized (select doc_id, text, {PATH_SQL} as path from documents),
u as materialized (
  select distinct path, notice from (
    select path, unnest(string_split(text, chr(10))) as notice from f
    union all select path, text from f where {named})
  where regexp_matches(lower(notice), '{licenses.NOTICE_WORDS}')),
terms as materialized (
  select path, notice, word, count(*) as tf from (
    select path, notice, unnest(regexp_extract_all(lower(notice), '[a-z0-9]+')) as word from u)
  group by all),
t(template, license, notice) as (values {rows}),
tw as materialized (
  select template, license, word, count(*) as tf from (
    select template, license, unnest(regexp_extract_all(lower(notice), '[a-z0-9]+')) as word from t)
  group by all),
n as materialized (select count(*) as units from u),
idf as materialized (
  select word, ln((1.0::double + units) / (1.0::double + coalesce(df, 0))) + 1.0::double as idf
  from (select distinct word from tw) v left join (select word, count(*) as df from terms group by 1) d
  using (word), n),
m as materialized (
  select template, license, word, tf * idf as model,
         sqrt(sum((tf * idf) ** 2) over (partition by template)) as size
  from tw join idf using (word)),
w as materialized (
  select path, notice, word, tf * coalesce(idf, ln(1.0::double + units) + 1.0::double) as weight
  from terms left join idf using (word), n),
s as (
  select path, license, round(sum(weight * model / size) / any_value(length), 6) as similarity
  from w join m using (word)
  join (select path, notice, sqrt(sum(weight ** 2)) as length from w group by all) l using (path, notice)
  group by path, notice, template, license),
own as materialized (
  select path, license as own_license, similarity from s where similarity >= 0.5
  qualify row_number() over (partition by path order by similarity desc, license) = 1),
stated as materialized (
  select regexp_replace(path, '/?[^/]*$', '') as above, own_license as stated from own where {named}
  qualify row_number() over (partition by above order by similarity desc, own_license) = 1),
folders as (
  select distinct path, regexp_replace(path, '/?[^/]*$', '') as folder from f),
near as (
  select path, above, stated from folders join stated
    on above = '' or folder = above or starts_with(folder, above || '/')
  qualify row_number() over (partition by path order by strlen(above) desc) = 1)
select doc_id, path, own_license, similarity, coalesce(own_license, stated) as license,
       case when own_license is null then above end as inherited_from
from f left join own using (path) left join near using (path)
"""


OP6_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256.0::double * x::double) as bigint)) as e
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e)
  where q.vec_id % 50 = 0)
select query_id, cast(rank as int) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank
  from scored) where rank <= 5
"""

OP9_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as payload_bytes,
         sha256(coalesce(html, '')) as payload_digest
  from pages),
firsts as (
  select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, p.payload_digest,
       case when first is null or first is not distinct from page_id then 'response'
            else 'revisit' end as record_type,
       case when first is not distinct from page_id then null else first end as refers_to
from p left join firsts on firsts.payload_digest = p.payload_digest and payload_bytes >= 100
"""


OP12_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256.0::double * x::double) as bigint)) as e
  from embeddings
  where embedding is not null and vec_id is not null and label is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as materialized (
  select a.vec_id as anchor_id, c.vec_id, c.label = a.label as same,
         cast(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v a join v c on c.vec_id <> a.vec_id and len(c.e) = len(a.e)
  where a.vec_id % 100 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score
from (
  select anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
         row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank
  from positives join scored using (anchor_id)
  where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
where rank <= 10
"""


OP13_SQL = r"""
with t as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents),
firsts as (select text, min(doc_id) as first from t group by text),
known as (
  select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels
  where doc_id is not null group by doc_id),
d as materialized (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
         case when len(words) < 50 then 'A' else '' end
         || case when 100 * len(list_distinct(words)) < 65 * len(words) then 'B' else '' end
         || case when 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 5 * length(t.text)
                 then 'C' else '' end
         || case when regexp_matches(t.text, '[#$%&*|]') then 'D' else '' end
         || case when t.doc_id > first then 'E' else '' end as fails,
         count(*) as n
  from t join firsts on firsts.text = t.text left join known on known.doc_id = t.doc_id
  group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order
  from letters a join letters b on b.x <> a.x join letters c on c.x not in (a.x, b.x)
  join letters d on d.x not in (a.x, b.x, c.x) join letters e on e.x not in (a.x, b.x, c.x, d.x)),
steps as (
  select filter_order, step, substr(filter_order, step, 1) as own,
         '[' || left(filter_order, step - 1) || '0]' as earlier
  from orders, unnest([1, 2, 3, 4, 5]) as u(step)),
placed as (
  select part, filter_order, step, own, n, good, toxic, fails,
         contains(fails, own) as hit, regexp_matches(fails, earlier) as gone
  from d, steps),
figures as (
  select part, filter_order, step, own,
         coalesce(sum(n) filter (not hit and not gone), 0) as kept,
         coalesce(sum(n) filter (hit and not gone), 0) as removed,
         coalesce(sum(n) filter (hit and gone), 0) as redundant,
         coalesce(sum(n) filter (fails = own), 0) as unique_fails,
         coalesce(sum(n) filter (hit and not gone and good), 0) as good_lost,
         coalesce(sum(n) filter (hit and not gone and toxic), 0) as toxic_lost
  from placed group by all)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept,
       cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
       cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
       cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, own) as bigint) as shapley
from figures
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": _op2_sql(),
        "op6_exact_top_k": OP6_SQL,
        "op9_warc": OP9_SQL,
        "op12_hard_negatives": OP12_SQL,
        "op13_filter_audit": OP13_SQL,
    }
