"""Benchmark decontamination (operator 6): a prefix-filtered join of documents with windows of benchmark items.

A window is SIZE consecutive words of an item, or all words of a shorter one. Its tokens are its runs of two words (the word
itself where there is one only). A document that contains a window contains each of its tokens, so any one token is a
sufficient prefix at full containment: tokens are ordered by how often the whole input has them, and only the rarest one of
each window is joined. A match gives the window's place by the token's place in it; it must lie inside the document, and then
all its words are compared.

Everything is a Spark join, so both sides may be of any size. Two passes over the documents, one counting tokens and one
looking for prefixes, emit only tokens that pass a filter, of which some 1.4 % of foreign tokens do; those find no partner
in the join. The filter has TOKEN_BITS bits for each token, counted before, and at most 2^MOST_BITS (16 MB): with more
tokens than those are for, each pass goes in turns, one for each part of the tokens. Around a prefix the SIZE - 1 words on either side travel along, which is all a comparison needs:
texts are never shuffled. Equal surroundings are compared once, so a passage of a third of all documents is a few rows
there, and copies of a text count once. A window stands for its set of items, told by two 64-bit sums of them; sets are
looked up once for each different list of sets that a text has. What was found is joined with the documents by two 64-bit hashes of the text.

Null texts have no words. Items without words have no window and never occur. Repeated rows are judged each by itself;
items of equal item_id count once. A null item_id is reported as the string 'null'. Other columns pass through; those
with names of the result's columns are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import persisted, text_bytes
from lectern.llm.words import word_count, word_hashes, words

SIZE = 10
#: Bits of the filter for each token, and the most and the least that it has in all, as powers of two.
TOKEN_BITS, MOST_BITS, LEAST_BITS = 16, 27, 12
#: Places that a task holds before it hands them on.
HELD = 50_000


def windows_of(item_words: list[bytes], size: int = SIZE) -> list[list[bytes]]:
    size = min(size, len(item_words))
    return [item_words[i : i + size] for i in range(len(item_words) - size + 1)] if size else []


def tokens_of(text_words: list[bytes], single: bool):
    """Hashes of runs of two words; with `single`, of single words too, as a second array. Hashes of words are uniform
    already, so a sum is enough here; a collision costs a comparison, no more."""
    import numpy as np

    one = np.fromiter(map(word_hashes().__getitem__, text_words), np.uint64, len(text_words))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
    return (two, one) if single else (two,)


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(item, window) once each; a window is its words with blanks between, and `tokens` their hashes by place."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), text_bytes(batch.column("text")), strict=True):
                cuts = windows_of(words(text), size)
                tokens = [tokens_of(w, True)[len(w) == 1].view("int64").tolist() for w in cuts]
                columns = pa.array([item] * len(cuts), pa.string()), pa.array([b" ".join(w) for w in cuts], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(tokens, pa.list_(pa.int64()))], ["item", "window", "tokens"])

    given = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(cut, "item string, window string, tokens array<long>").dropDuplicates(["item", "window"])


def token_filter(tokens: DataFrame, log2_bits: int):
    """Bits set at two places for each token, and whether a token is a single word. `tokens` (token, window): at most
    2^log2_bits / 64 rows of two numbers reach the driver, as Arrow columns."""
    import numpy as np

    mask = (1 << log2_bits) - 1
    places = F.array(F.col("token").bitwiseAND(mask), F.shiftrightunsigned("token", 32).bitwiseAND(mask))
    slots = tokens.select((~F.col("window").contains(" ")).alias("single"), F.explode(places).alias("slot"))
    row_bits = F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("set")
    rows = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(row_bits, F.max("single").alias("single")).toArrow()
    at, held, single = (rows.column(c).to_numpy() for c in ("at", "set", "single"))
    bits = np.zeros(max(1, (mask + 1) // 64), np.uint64)
    bits[at] = held.astype(np.int64).view(np.uint64)
    return bits, bool(single.any())


def in_turns(tokens: DataFrame, log2_bits: int | None, most_bits: int = MOST_BITS) -> list[tuple[DataFrame, int]]:
    """Parts of `tokens` (token, ...) by token, and the bits of a filter for each, as a power of two: one part, unless its
    filter were larger than most_bits. With log2_bits given there is one part with a filter of so many."""
    if log2_bits is not None:
        return [(tokens, log2_bits)]
    n = max(1, tokens.select("token").distinct().count() * TOKEN_BITS)
    turns = -(-n // (1 << most_bits))
    bits = min(most_bits, max(LEAST_BITS, (n - 1).bit_length()))
    # Of bits that the filter's places don't use.
    turn = F.expr(f"(shiftrightunsigned(token, 59) * 32 + (shiftrightunsigned(token, {MOST_BITS}) & 31)) % {turns}")
    return [(tokens if turns == 1 else tokens.filter(turn == k), bits) for k in range(turns)]


def passing(hashes, bits):
    """Places of the hashes that have both bits set."""
    import numpy as np

    mask, low, six, unit = np.uint64(len(bits) * 64 - 1), np.uint64(63), np.uint64(6), np.uint64(1)
    at = None
    for shift in (np.uint64(0), np.uint64(32)):
        slot = ((hashes if at is None else hashes[at]) >> shift) & mask
        there = np.flatnonzero((bits[slot >> six] >> (slot & low)) & unit)
        at = there if at is None else at[there]
    return at


def occurrences(docs: DataFrame, tokens: DataFrame, log2_bits: int) -> DataFrame:
    """(token, n): how often the documents have each token that passes the filter of `tokens`."""
    held = docs.sparkSession.sparkContext.broadcast(token_filter(tokens, log2_bits))

    def count(batches):
        import numpy as np
        import pyarrow as pa

        bits, single = held.value
        for batch in batches:
            found = [h[passing(h, bits)] for text in text_bytes(batch.column("text")) if (w := words(text)) for h in tokens_of(w, single)]
            values, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n, pa.int64())], ["token", "n"])

    return docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, docs: DataFrame, log2_bits: int | None, most_bits: int) -> DataFrame:
    """(token, place, window, length): the rarest token of each window of which the documents have every token."""
    tokens = windows.dropDuplicates(["window"]).select("window", F.posexplode("tokens").alias("place", "token"))
    counted = [t.join(occurrences(docs, t, bits), "token", "left") for t, bits in in_turns(tokens, log2_bits, most_bits)]
    tokens = reduce(DataFrame.union, counted).withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = tokens.groupBy("window").agg(F.min(F.struct("n", "token", "place")).alias("r"))
    return rarest.filter("r.n > 0").select("r.token", "r.place", "window", F.size(F.split("window", " ")).alias("length"))


def surroundings(docs: DataFrame, tokens: DataFrame, size: int, log2_bits: int) -> DataFrame:
    """(a, b, at, token, before, around): places of the documents' prefixes, with the words around and how many of them are
    before. Equal texts of a batch give theirs once."""
    held = docs.sparkSession.sparkContext.broadcast(token_filter(tokens, log2_bits))

    def look(batches):
        import numpy as np
        import pyarrow as pa

        bits, single = held.value
        names = ["a", "b", "at", "token", "before", "around"]
        out: list[list] = [[] for _ in names]

        def taken():
            columns = [pa.array(x, pa.int64()) for x in out[:5]]
            for x in out[:5]:
                x.clear()
            around = pa.array(out[5], pa.binary()).cast(pa.string())
            out[5].clear()
            return pa.RecordBatch.from_arrays([*columns, around], names)

        for batch in batches:
            seen = set()
            for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), text_bytes(batch.column("text")), strict=True):
                if (a, b) in seen or not (w := words(text)):
                    continue
                seen.add((a, b))
                for hashes in tokens_of(w, single):
                    places = passing(hashes, bits)
                    for at, token in zip(places.tolist(), hashes[places].view(np.int64).tolist(), strict=True):
                        start = max(0, at - size + 1)
                        for column, value in zip(out, (a, b, at, token, at - start, b" ".join(w[start : at + size])), strict=True):
                            column.append(value)
                        if len(out[0]) >= HELD:
                            yield taken()
        yield taken()

    return docs.select("a", "b", "text").mapInArrow(look, "a long, b long, at long, token long, before long, around string")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _counted(batches):
    """Appends n_words."""
    import pyarrow as pa

    for batch in batches:
        n = pa.array([word_count(text) for text in text_bytes(batch.column("text"))], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, n], [*batch.schema.names, "n_words"])


def _summed(batches):
    """Spans merged, and the words in them counted."""
    import pyarrow as pa

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        hits = [merged([(s["start"], s["end"]) for s in spans]) for spans in batch.column("spans").to_pylist()]
        n = pa.array([sum(e - s for s, e in x) for x in hits], pa.int64())
        spans = pa.array([[{"start": s, "end": e} for s, e in x] for x in hits], pa.list_(span))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), n, spans, batch.column("items")], ["a", "b", "n_hit", "hits", "items"])


def _text_key() -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def item_sets(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(window, of), its set of items as two sums and their number; (of, item), the items of each set once. A window's items
    are summed up before the shuffle and gathered nowhere."""
    key = F.struct(F.bit_xor(F.xxhash64("item")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("y"), F.count(F.lit(1)).alias("n"))
    of = persisted(windows.groupBy("window").agg(key.alias("of")), "sets")
    first = of.groupBy("of").agg(F.min("window").alias("window"))
    return of, windows.select("window", "item").join(first, "window").select("of", "item")


def found_windows(docs: DataFrame, windows: DataFrame, size: int, log2_bits: int | None, most_bits: int) -> DataFrame:
    """(a, b, n_hit, hits, items) of each text with a window; `docs` has a, b and text."""
    chosen = persisted(prefixes(windows, docs, log2_bits, most_bits), "prefixes")
    turns = [surroundings(docs, t, size, bits).join(t.select("token"), "token", "left_semi") for t, bits in in_turns(chosen, log2_bits, most_bits)]
    places = persisted(reduce(DataFrame.unionByName, turns), "surroundings")
    inside = (F.col("place") <= F.col("before")) & (F.col("before") - F.col("place") + F.col("length") <= F.size("near"))
    there = F.array_join(F.slice("near", (F.col("before") - F.col("place") + 1).cast("int"), F.col("length")), " ")
    each = places.select("token", "before", "around").distinct().withColumn("near", F.split("around", " ")).join(chosen, "token").filter(inside).filter(there == F.col("window"))
    of, items = item_sets(windows)
    each = each.join(of, "window")
    # For each surrounding its windows' spans, counted from the prefix, and their sets of items: at most some for each of the
    # places that a window can have around a prefix.
    span = F.struct((-F.col("place")).cast("long").alias("start"), (F.col("length") - F.col("place")).cast("long").alias("end"))
    known = persisted(each.groupBy("token", "before", "around").agg(F.collect_set(span).alias("near"), F.collect_set("of").alias("of")), "known")
    moved = F.transform("near", lambda s: F.struct((s.start + F.col("at")).alias("start"), (s.end + F.col("at")).alias("end")))
    hits = places.join(known, ["token", "before", "around"]).select("a", "b", moved.alias("spans"), "of")
    sets = F.sort_array(F.array_distinct(F.flatten(F.collect_set("of"))))
    whole = persisted(hits.groupBy("a", "b").agg(F.flatten(F.collect_set("spans")).alias("spans"), sets.alias("sets")), "whole")
    lists = whole.select("sets").distinct().select("sets", F.explode("sets").alias("of")).join(items, "of")
    named = lists.groupBy("sets").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return whole.join(named, "sets").select("a", "b", "spans", "items").mapInArrow(_summed, "a long, b long, n_hit long, hits array<struct<start:long,end:long>>, items array<string>")


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, log2_bits: int | None = None, most_bits: int = MOST_BITS) -> DataFrame:
    """`docs` (text, ...) with n_words, n_hit, hits (spans of words), items (ids) and contaminated. The filter's bits follow
    from the items, in turns of at most 2^most_bits; log2_bits fixes them. Neither changes the result."""
    plain = docs.drop("n_words", "n_hit", "hits", "items", "contaminated").withColumn("text", F.col("text").cast("string"))
    a, b = _text_key()
    windows = persisted(item_windows(items, size), "windows")
    found = persisted(found_windows(plain.select(a.alias("a"), b.alias("b"), "text"), windows, size, log2_bits, most_bits), "hits").withColumnsRenamed({"a": "__a", "b": "__b"})
    counted = plain.mapInArrow(_counted, T.StructType([*plain.schema.fields, T.StructField("n_words", T.LongType())]))
    # Stored, its size is known: Spark sends it to the tasks where it is below its threshold, and shuffles otherwise.
    out = counted.withColumns({"__a": a, "__b": b}).join(found, ["__a", "__b"], "left")
    none = F.array().cast("array<string>"), F.array().cast("array<struct<start:long,end:long>>")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "hits": F.coalesce("hits", none[1]), "items": F.coalesce("items", none[0])})
    return out.drop("__a", "__b").withColumn("contaminated", F.col("n_hit") > 0)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS s FROM bw),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, w, unnest(range(len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k),
ds AS (SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS s FROM dw),
m AS (SELECT doc_id, item_id, ds.k, i FROM ds JOIN win ON ds.k = win.k AND ds.s = win.s),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
