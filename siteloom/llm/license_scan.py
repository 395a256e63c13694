"""Licence scan by canonical digests.

An entire text is brought to a canonical form: lower case, lines that only state a copyright taken out, equivalent
spellings made one, and everything but letters and digits made single spaces. The SHA-256 of that form is looked up
among the digests of known licences by a hash join. Built of DataFrame functions only.

Defined results: null and empty texts have the digest of the empty form and no licence; repeated rows are answered each;
null doc_ids pass; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import small, table
from siteloom.llm.license_texts import whole_texts

#: Spellings that count as the same, the left one becoming the right one.
SPELLINGS = [
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("favour", "favor"), ("fulfil ", "fulfill "), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("merchantibility", "merchantability"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("optimise", "optimize"), ("organisation", "organization"),
    (" owner ", " holder "), ("practise", "practice"), ("programme ", "program "), ("recognise", "recognize"), ("signalling", "signaling"), ("sub license", "sublicense"), ("utilisation", "utilization"), (" while ", " whilst "), ("wilful", "willful"), ("https", "http"),
]
COPYRIGHT_LINE = r"(?m)^[ \t*#/;-]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|<|\[)|\(c\)|©|all rights reserved\.?[ \t]*$)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, COPYRIGHT_LINE.replace("(?m)", "(?md)"), " ")
    t = F.concat(F.lit(" "), F.regexp_replace(t, NOT_WORD, " "), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, " +", " "))


def known_licenses(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """license_id, license_digest of known texts (those of :func:`whole_texts` by default), each digest once."""
    rows = spark.createDataFrame(whole_texts() if known is None else known, "license_id string, text string")
    return rows.groupBy(F.sha2(canonical(F.col("text")), 256).alias("license_digest")).agg(F.min("license_id").alias("license_id"))


def scanned(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text_digest, license_id (null: none) for each document of ``docs`` (doc_id, text)."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(canonical(F.col("text").cast("string")), 256).alias("text_digest"))
    return marked.join(small(known), F.col("text_digest") == F.col("license_digest"), "left").select("doc_id", "text_digest", "license_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every one of the ``documents`` with its canonical digest and the licence that it is, if any."""
    return scanned(table(spark, sf_dir, "documents"), known_licenses(spark))


def _sql_canonical(text: str) -> str:
    t = f"lower(coalesce({text}, ''))"
    t = f"regexp_replace({t}, '{COPYRIGHT_LINE}', ' ', 'g')"
    t = f"concat(' ', regexp_replace({t}, '{NOT_WORD}', ' ', 'g'), ' ')"
    for a, b in SPELLINGS:
        t = f"replace({t}, '{a}', '{b}')"
    return f"trim(regexp_replace({t}, ' +', ' ', 'g'))"


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP9_SQL = f"""
WITH k AS (SELECT sha256({_sql_canonical('text')}) AS d, min(license_id) AS license_id FROM (VALUES {", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in whole_texts())}) AS v(license_id, text) GROUP BY d),
     c AS (SELECT doc_id, sha256({_sql_canonical('text')}) AS text_digest FROM documents)
SELECT doc_id, text_digest, license_id FROM c LEFT JOIN k ON k.d = c.text_digest
"""
