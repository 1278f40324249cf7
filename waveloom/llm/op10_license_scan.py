"""Licence scan by canonical digest lookup.

A text is canonicalised (case, punctuation, copyright lines, equivalent
spellings, white space), its SHA-256 digest is taken over the *entire* canonical text, and the
digest is hash-joined to the table of known licence digests. The same is done for each line that
mentions a licence, against the digests of known one-line notices.

The known table is a constant of this module (a few dozen rows): short licences as texts, long ones (GNU, Mozilla, Apache,
CC0 and others) as digests of their public texts, with and without the part on how to apply them. So it is
broadcast; the scan of the documents has no exchange of text.

Defined cases: null text has null digest and no licence; a text that is empty
once canonicalised has the digest of the empty string and no licence; repeated
rows get a row each; a very long text is canonicalised whole in its task (about 10 times its size); equal digests of two licences go to the name first in order; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.llm.common import keyed_documents, table
from waveloom.llm.licence_texts import DIGESTS, NOTICES, SPELLINGS, TEXTS

COPYRIGHT = r"(?im)^[^\p{L}\n]*(?:copyright[ \t]*(?:\([Cc]\)|©|[0-9\[<{])|\([Cc]\)[ \t]*[0-9\[<{]|©|all rights reserved)[^\n]*$"


def canonical(text: Column) -> Column:
    """Lower case; copyright lines go (neither a sentence that goes on with the word in a new line nor an item "(c)" of a list is one); every run of other than letters and digits is one space; one spelling."""
    out = F.regexp_replace(text, COPYRIGHT, " ")
    out = F.concat(F.lit(" "), F.regexp_replace(F.lower(out), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(out)


def known(spark: SparkSession) -> DataFrame:
    rows = [("text", k, t) for k, ts in TEXTS.items() for t in ts] + [("notice", k, t) for k, ts in NOTICES.items() for t in ts]
    return spark.createDataFrame(rows, "kind string, licence string, text string").select("kind", "licence", F.sha2(canonical(F.col("text")), 256).alias("digest")).union(
        spark.createDataFrame([("text", k, d) for k, ds in DIGESTS.items() for d in ds], "kind string, licence string, digest string")).distinct()


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, digest, licence (of the entire text) and notices (licences of its lines, sorted, joined by commas)."""
    table_ = known(docs.sparkSession)
    whole = F.broadcast(table_.filter("kind = 'text'").groupBy("digest").agg(F.min("licence").alias("licence")))
    notices = table_.filter("kind = 'notice'").groupBy().agg(F.map_from_entries(F.collect_list(F.struct("digest", "licence"))).alias("m"))
    by_line = notices.first()["m"]  # a constant of this module
    pairs = F.create_map(*[F.lit(x) for kv in sorted(by_line.items()) for x in kv])
    lines = F.filter(F.split("text", r"[\r\n]+"), lambda x: x.rlike(r"(?i)licen[sc]e|public domain|spdx"))
    found = F.array_sort(F.array_distinct(F.filter(F.transform(lines, lambda x: F.try_element_at(pairs, F.sha2(canonical(x), 256))), lambda x: x.isNotNull())))
    return (
        keyed_documents(docs)
        .select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), F.when(F.col("text").rlike(r"(?i)licen[sc]e|public domain|spdx"), F.array_join(found, ",")).otherwise("").alias("notices"))
        .join(whole, "digest", "left").select("doc_id", "digest", "licence", "notices")
    )


def _sql_canonical(text: str) -> str:
    out = f"""concat(' ', regexp_replace(lower(regexp_replace({text}, '{COPYRIGHT}', ' ', 'g')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"""
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"sha256(trim({out}))"


def _sql_values(kinds: dict) -> str:
    return ", ".join(f"('{k}', '{t.replace(chr(39), chr(39) * 2)}')" for k, ts in kinds.items() for t in ts)


SQL = f"""WITH texts AS (SELECT {_sql_canonical('t')} AS digest, min(k) AS licence FROM (VALUES {_sql_values(TEXTS)}) v(k, t) GROUP BY 1 UNION ALL SELECT t, k FROM (VALUES {_sql_values(DIGESTS)}) v(k, t)),
marks AS (SELECT DISTINCT {_sql_canonical('t')} AS digest, k AS licence FROM (VALUES {_sql_values(NOTICES)}) v(k, t)),
lines AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[\r\n]+')) AS line FROM documents WHERE regexp_matches(text, '(?i)licen[sc]e|public domain|spdx')),
seen AS (SELECT DISTINCT doc_id, licence FROM lines JOIN marks ON marks.digest = {_sql_canonical('line')} WHERE regexp_matches(line, '(?i)licen[sc]e|public domain|spdx')),
notes AS (SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS notices FROM seen GROUP BY 1),
d AS (SELECT doc_id, CASE WHEN text IS NOT NULL THEN {_sql_canonical('text')} END AS digest FROM documents)
SELECT d.doc_id, d.digest, licence, coalesce(notices, '') AS notices FROM d LEFT JOIN texts ON texts.digest = d.digest LEFT JOIN notes ON notes.doc_id = d.doc_id"""


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
