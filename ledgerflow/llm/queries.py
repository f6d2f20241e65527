"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, language, licenses, quality, shared, simhash, token_store, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(_table(spark, sf_dir, "documents"), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.write_tokens(_table(spark, sf_dir, "documents"))
    out = token_store.read_tokens(spark, folder)
    return out.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", (shared.crc_bucket("doc_id") == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language.predict(docs, language.fit(docs))
    return out.select("doc_id", (shared.crc_bucket("doc_id") == 2).alias("held_out"), "lang_pred", "score")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = quality.grade(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", (shared.crc_bucket("doc_id") == 2).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("kept"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, runs = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_records(warc.capture_index(spark, folder, runs), folder)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_token_store, op3_toxicity, op4_licenses, op5_language, op6_decontaminate, op7_exact_dedup, op8_quality, op9_warc, op10_simhash)}

ORACLES = {
    "op4_licenses": licenses.scan_sql(),
    "op7_exact_dedup": """
        with rows as (
          select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as norm
          from documents),
        groups as (
          select norm, arg_min(doc_id, (-n, doc_id)) as keep_id, count(*) as group_size from rows group by norm)
        select r.doc_id, g.keep_id, g.group_size, r.doc_id = g.keep_id as kept, sha256(r.norm) as text_sha256
        from rows r join groups g using (norm)
    """,
    "op9_warc": """
        with rows as (select page_id, coalesce(html, '') as payload from pages),
        best as (select payload, max(page_id) as top, count(*) as n, sha1(payload) as hex, strlen(payload) as bytes from rows group by payload),
        coded as (
          select *, array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, g * 5 + 1, 5))::bigint >> s) & 31)::bigint + 1, 1)), '')), '') as digest
          from best)
        select r.page_id, c.bytes::bigint as payload_bytes, c.digest as payload_digest,
          case when r.page_id = c.top then 'response' else 'revisit' end as record_type,
          case when r.page_id <> c.top then c.top end as refers_to
        from rows r join coded c using (payload)
    """,
}
