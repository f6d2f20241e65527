"""Licence scan by canonical digests.

A text is made canonical line by line: lower case, copyright lines dropped,
equivalent spellings replaced, everything but letters and numbers one space;
empty lines vanish and the rest is joined by spaces. The digest of the whole
canonical text, and of each canonical line taken as an entire text (notices
stand on lines of their own), is hash-joined to the digests of known texts.
JVM expressions only. The known side is broadcast only below BROADCAST rows.

Null and empty texts have the digest of the empty string and no licence.
Repeated rows are reported each. An empty table gives an empty result; known
texts that share a digest count as the first id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import known_texts

BROADCAST = 100_000
# Spellings that count as one.
SPELLINGS = (("licence", "license"), ("sub license", "sublicense"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("non commercial", "noncommercial"), ("https", "http"), ("copyright holder", "copyright owner"))


def canonical_line(line):
    """A Column's canonical form; a line that opens with copyright and a year or sign is empty."""
    x = F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}©]+", " "))
    x = F.when(x.rlike(r"^(©|copyright( c| ©)? ?[0-9]{4}|copyright (c|©) |c [0-9]{4})"), F.lit("")).otherwise(x)
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def canonical_lines(text):
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical_line), lambda x: x != "")


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license) of known texts; the built-in ones unless given."""
    rows = spark.createDataFrame(texts if texts is not None else known_texts(), "license string, text string")
    whole = rows.select(F.md5(F.array_join(canonical_lines(F.col("text")), " ")).alias("digest"), "license")
    return whole.where(F.col("digest") != F.md5(F.lit(""))).groupBy("digest").agg(F.min("license").alias("license"))


def scan(df: DataFrame, known: DataFrame | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a row of df: key, text_digest, whole_license (or null), line_licenses (sorted, joined by commas), license_lines."""
    known = known if known is not None else known_digests(df.sparkSession)
    if known.count() <= BROADCAST:
        known = F.broadcast(known)
    rows = df.select(F.col(key).alias("_id"), canonical_lines(F.col(text)).alias("_lines"))
    units = rows.select("_id", F.md5(F.array_join("_lines", " ")).alias("text_digest"), F.transform("_lines", lambda x: F.md5(x)).alias("_digests"))
    units = units.select("_id", "text_digest", F.posexplode(F.concat(F.array("text_digest"), "_digests")).alias("_unit", "digest"))
    found = (
        units.join(known, "digest", "left")
        .groupBy("_id", "text_digest")
        .agg(
            F.max(F.when(F.col("_unit") == 0, F.col("license"))).alias("whole_license"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("_unit") > 0, F.col("license")))), ",").alias("line_licenses"),
            F.count(F.when(F.col("_unit") > 0, F.col("license"))).alias("_matched"),
            F.count(F.when(F.col("_unit") == 0, F.lit(1))).alias("_rows"),
        )
    )
    each = found.select("*", F.explode(F.expr("sequence(1, _rows)")).alias("_copy"))
    return each.select(F.col("_id").alias(key), "text_digest", "whole_license", "line_licenses", (F.col("_matched") / F.col("_rows")).cast("long").alias("license_lines"))


def canonical_sql(line: str) -> str:
    """canonical_line in DuckDB SQL."""
    x = f"trim(regexp_replace(lower({line}), '[^\\p{{L}}\\p{{N}}©]+', ' ', 'g'))"
    x = f"case when regexp_matches({x}, '^(©|copyright( c| ©)? ?[0-9]{{4}}|copyright (c|©) |c [0-9]{{4}})') then '' else {x} end"
    for a, b in SPELLINGS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def scan_sql() -> str:
    """scan over documents in DuckDB SQL, with the built-in texts."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in known_texts())
    lines = lambda text: f"list_filter(list_transform(string_split(coalesce({text}, ''), chr(10)), lambda l: {canonical_sql('l')}), lambda x: x <> '')"
    return f"""
        with texts(license, text) as (values {values}),
        known as (select digest, min(license) as license from (select license, md5(array_to_string({lines('text')}, ' ')) as digest from texts) where digest <> md5('') group by digest),
        rows as (select doc_id, {lines('text')} as ls from documents),
        units as (select doc_id, md5(array_to_string(ls, ' ')) as text_digest, unnest(list_transform(ls, lambda x: md5(x))) as digest from rows),
        line_hits as (select doc_id, text_digest, array_to_string(list_sort(list_distinct(list(license))), ',') as line_licenses, count(*) as license_lines
          from units join known using (digest) group by doc_id, text_digest)
        select r.doc_id, md5(array_to_string(r.ls, ' ')) as text_digest, k.license as whole_license,
          coalesce(h.line_licenses, '') as line_licenses, coalesce(h.license_lines, 0) as license_lines
        from rows r left join known k on k.digest = md5(array_to_string(r.ls, ' '))
        left join line_hits h on h.doc_id = r.doc_id and h.text_digest = md5(array_to_string(r.ls, ' '))
    """
