"""Line dedup (operator 9): lines that many documents share stay in one document only.

Lines are exploded to hashes of their normalised form, distinct documents are counted for each hash, and lines over the
threshold are dropped from all documents but the one with the largest doc_id; what stays is joined by position. Counts are
summed before the shuffle, so a line of a third of all documents is a few rows there. Only hashes and positions travel, not
lines; two 64-bit hashes make a key. A text's positions are taken away as a set, in time that grows with its lines.

Null and empty texts are one empty line. Rows with equal doc_ids are one document for counting, and each keeps or loses
lines alike. A null doc_id is a document of its own that is never the one to keep a line. Other columns pass through;
those named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import persisted

MIN_CHARS, MIN_DOCS = 20, 3
#: ASCII white space: \\x20 and \\x09-\\x0D.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. lower() is quicker and does the same to pure ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def _hashes(line: Column) -> Column:
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def _copy() -> Column:
    """Tells different texts of one doc_id apart: their positions differ."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, copy, pos) of every long line, and (key, keeper) of the keys that at least min_docs documents have."""
    every = docs.select("doc_id", _copy().alias("copy"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    long_lines = every.filter(F.char_length(F.btrim("line", F.lit(BLANK))) >= min_chars)
    keys = persisted(long_lines.select("doc_id", "copy", "pos", _hashes(F.col("line")).alias("key")), "line_keys")
    held = keys.groupBy("key", "doc_id").agg(F.count(F.lit(1)))
    shared = held.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")).filter(F.col("n_docs") >= min_docs)
    return keys, shared


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """`docs` (doc_id, text, ...) with shared lines gone from text, and n_lines, n_dropped."""
    keys, shared = shared_lines(docs, min_chars, min_docs)
    # Stored, the few shared keys reach the join unordered: then Spark can split a key that most documents have.
    shared = persisted(shared, "shared_lines")
    doomed = keys.join(shared, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    by_doc = doomed.groupBy(F.col("doc_id").alias("__id"), F.col("copy").alias("__copy")).agg(F.collect_set("pos").alias("__gone"))
    lines, gone = F.col("__lines"), F.col("__gone")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.when(gone.isNull(), lines).otherwise(F.transform(stay, lambda i: F.get(lines, i)))
    same = docs["doc_id"].eqNullSafe(by_doc["__id"]) & (_copy() == by_doc["__copy"])
    joined = docs.join(by_doc, same, "left").withColumn("__lines", lines_of(F.col("text"))).withColumn("__kept", kept)
    out = joined.withColumns({"text": F.concat_ws("\n", "__kept"), "n_lines": F.size("__lines").cast("long"), "n_dropped": (F.size("__lines") - F.size("__kept")).cast("long")})
    return out.drop("__id", "__copy", "__gone", "__lines", "__kept")


ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), s AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.pos, k.line, (s.key IS NOT NULL AND k.doc_id <> s.keeper) AS gone FROM k LEFT JOIN s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
