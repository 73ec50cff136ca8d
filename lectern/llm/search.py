"""Ranked lexical search (operator 11): postings joined with items' terms, scored in whole numbers, summed, and ranked.

Postings are a table in buckets of terms: a row for each document and term, with how often it has the term and how many
terms it has. Items' terms meet postings by term; each match is scored by itself, (item, document) is summed over, and
row_number keeps each item's best. No part holds all postings of a term: a bucket is dealt out by document as well.

Contributions are dealt by document before they meet the items. So all that is summed for a pair is already in one part,
and what crosses the network grows with the postings of the items' terms, not with pairs of items and documents. Items
are taken in blocks of BLOCK_TERMS terms, whose table is small enough for every task; more items are more blocks.

Terms are runs of ASCII letters and digits, lower-cased, and of anything not ASCII. Each row of the documents is a document
of its own; equal scores stand by doc_id, null first. Rows of one item_id are one item. Null and empty texts have no terms,
are not counted and are never found; items without terms that any document has give no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import persisted, text_bytes
from lectern.llm.words import words

TOP, B_PERCENT, K1_TENTHS = 10, 75, 8
#: Buckets of terms, and how many ways a bucket is dealt by document.
BUCKETS, WAYS = 4096, 32
#: Terms that are looked for while texts are read, at most; beyond that a join picks them.
SHIPPED_TERMS = 500_000
#: Rows (item, term) that every task holds at a time.
BLOCK_TERMS = 200_000
#: Rows of one Arrow batch.
BATCH = 200_000
COUNTED = "row long, id long, n long, term string, tf long"


def counted_terms(texts: DataFrame, only: frozenset[bytes] | None = None) -> DataFrame:
    """COUNTED rows of `texts` (row, id, text): one without a term for each row, with the number n of its terms, and one for
    each different term, or each of `only`."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keys, ends = [], [0]
            terms: list[bytes | None] = []
            counts: list[int] = []

            def rows(keys=keys, ends=ends, terms=terms, counts=counts):
                times = np.diff(ends)
                key = [np.repeat(np.array([k[i] for k in keys], np.int64), times) for i in (0, 2)]
                ids = pa.array([k[1] for k in keys], pa.int64()).take(pa.array(np.repeat(np.arange(len(keys)), times)))
                out = [pa.array(key[0]), ids, pa.array(key[1]), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())]
                for c in (keys, terms, counts):
                    c.clear()
                ends[:] = [0]
                return pa.RecordBatch.from_arrays(out, ["row", "id", "n", "term", "tf"])

            for row, key, text in zip(batch.column("row").to_pylist(), batch.column("id").to_pylist(), text_bytes(batch.column("text")), strict=True):
                said = words(text)
                found = Counter(said)
                wanted = found if only is None else found.keys() & only
                terms.append(None)
                counts.append(0)
                terms += wanted
                counts += map(found.__getitem__, wanted)
                keys.append((row, key, len(said)))
                ends.append(len(terms))
                if len(terms) >= BATCH:
                    yield rows()
            if keys:
                yield rows()

    return texts.select("row", "id", "text").mapInArrow(work, COUNTED)


@dataclass
class Index:
    """Postings (bucket, term, row, doc_id, n, tf), the number of documents with terms, and of all their terms."""

    postings: DataFrame
    docs: int
    terms: int


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of `items` (item_id, text), stored."""
    counted = counted_terms(items.select(F.lit(0).cast("long").alias("row"), F.col("item_id").cast("long").alias("id"), "text"))
    return persisted(counted.filter("term IS NOT NULL").groupBy(F.col("id").alias("item_id"), "term").agg(F.sum("tf").alias("times")), "item_terms")


def index(docs: DataFrame, asked: DataFrame | None = None) -> Index:
    """The index of all rows of `docs` (doc_id, text), of all terms, or of those that `asked` (term, ...) has: others need
    not be sorted to answer it. All documents count either way."""
    only, wanted = None, None
    if asked is not None:
        wanted = asked.select("term").distinct()
        if wanted.count() <= SHIPPED_TERMS:
            only = frozenset(r.term.encode() for r in wanted.collect())
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("id"), "text")
    counted = counted_terms(texts, only)
    if wanted is not None and only is None:
        counted = counted.join(wanted.withColumn("wanted", F.lit(True)), "term", "left").filter("term IS NULL OR wanted").drop("wanted")
    bucket = F.when(F.col("term").isNotNull(), F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    dealt = counted.withColumns({"bucket": bucket, "way": F.pmod(F.xxhash64("row"), F.lit(WAYS))}).repartition("bucket", "way").drop("way")
    stored = persisted(dealt.sortWithinPartitions("bucket", "term", "row").withColumnRenamed("id", "doc_id"), "postings")
    size = stored.filter("term IS NULL AND n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    return Index(stored.filter("term IS NOT NULL").select("bucket", "term", "row", "doc_id", "n", "tf"), size[0], size[1] or 0)


def weights(of: Index, asked: DataFrame) -> DataFrame:
    """(term, weight) of the terms that documents and `asked` have, as long as they add anything."""
    rare = F.lit(2.0 * of.docs + 2) / (2 * F.col("df") + 1)
    df = of.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(asked.select("term").distinct(), "term", "left_semi")
    return df.select("term", F.floor(1000 * F.ln(rare)).alias("weight")).filter("weight > 0")


def added(of: Index) -> Column:
    """What a posting adds to a document's score: whole numbers, divided rounding down."""
    length = f"{100 - B_PERCENT} + ({B_PERCENT} * n * {of.docs}L) div {max(of.terms, 1)}L"
    return F.expr(f"weight * ((1000000000L * tf) div (1000L * tf + {K1_TENTHS}L * ({length})))")


def search(of: Index, asked: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the best `top` documents of each item of `asked` (item_id, term, times)."""
    rated = persisted(weights(of, asked), "weights")
    n_asked = asked.count()
    rated = F.broadcast(rated) if n_asked <= BLOCK_TERMS else rated
    # Stored once for all blocks, each document's contributions together.
    given = of.postings.join(rated, "term").select("row", "doc_id", "term", added(of).alias("added")).repartition("row")
    blocks = -(-n_asked // BLOCK_TERMS) or 1
    if blocks > 1:
        given = persisted(given, "contributions").repartition("row")
    best = []
    for block in range(blocks):
        those = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        # A block may be larger only where one item is; then Spark joins as it sees fit.
        those = F.broadcast(those) if blocks == 1 or those.count() <= 2 * BLOCK_TERMS else those
        pairs = given.join(those, "term").groupBy("item_id", "row", "doc_id").agg(F.sum(F.col("added") * F.col("times")).alias("score"))
        order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
        found = pairs.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
        best.append(found if blocks == 1 else persisted(found, f"found_{block}"))
    out = best[0]
    for more in best[1:]:
        out = out.unionByName(more)
    return out


def _terms_sql(table: str, key: str) -> str:
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"(SELECT {key}, term, count(*) AS c FROM (SELECT {key}, unnest(regexp_extract_all({low}, '{pattern}')) AS term FROM {table}) GROUP BY ALL)"


ORACLE_SQL = f"""
WITH p AS MATERIALIZED {_terms_sql("documents", "doc_id")}, q AS MATERIALIZED {_terms_sql("benchmark", "item_id")},
d AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n FROM p GROUP BY doc_id),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY term, docs),
a AS (SELECT p.doc_id, p.term, weight * ((1000000000 * c) // (1000 * c + 8 * (25 + (75 * n * docs) // terms))) AS added FROM p JOIN d ON d.doc_id = p.doc_id JOIN w ON w.term = p.term, s),
f AS (SELECT item_id, doc_id, CAST(sum(added * c) AS BIGINT) AS score FROM q JOIN a ON a.term = q.term GROUP BY item_id, doc_id HAVING sum(added * c) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10
"""
