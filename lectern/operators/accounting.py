"""What synthesis would cost: cache keys, hits and misses, billing, least-recently-used eviction, look-ahead, voices.

Nothing is synthesised. A cache is a table (key, bytes, created_at, last_used, model, voice_id); a play log is a table of
requests in order. Caches may be many: functions take the columns that tell them apart, and windows run inside those. Where
one cache is the whole table, running totals are taken in ranges that are summed first, so no window has one partition.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import clamp
from lectern.plans.storage import stored

#: Dollars a million bytes by model.
PRICES = {"free": 0.0, "pro": 15.0, "standard": 15.0, "legacy": 15.0}
BUDGET = 250 * 1024 * 1024
KEPT_IN_MEMORY = 6
MOST_AHEAD = 8


def json_string(text: Column) -> Column:
    """The text as a JSON string, escaped as web pages' scripts do."""
    out = F.regexp_extract(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    for letter in "ABCDEF":
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u00([01]){letter}", f"$1\\\\u00$2{letter.lower()}")
    return out


def json_number(value: Column) -> Column:
    """Whole numbers without a fraction."""
    number = value.cast("double")
    return F.when(number == F.floor(number), F.floor(number).cast("long").cast("string")).otherwise(number.cast("string"))


def cache_key(text: Column, voice_id: Column, model: Column, speed: Column | float = 1, volume: Column | float = 0) -> Column:
    """Hex SHA-256 of the JSON list of all that shapes the audio."""
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    parts = [json_string(text), json_string(voice_id), json_string(model), json_number(column(speed)), json_number(column(volume))]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def hits_and_misses(log: DataFrame, key: str, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """`log` with hit: a request is a miss the first time its key is seen in its cache. `order` tells rows apart; rows that
    tie for the first are all misses. A null key is a key. The first of a key is found before anything is shuffled, so a
    key of most rows is no single task's."""
    keys = [*by, key]
    firsts = log.groupBy(*[F.col(c).alias(f"__{c}") for c in keys]).agg(F.min(F.struct(*order)).alias("__first"))
    same = functools.reduce(operator.and_, [log[c].eqNullSafe(firsts[f"__{c}"]) for c in keys])
    return log.join(firsts, same).withColumn("hit", F.struct(*order) > F.col("__first")).drop("__first", *[f"__{c}" for c in keys])


def against_cache(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """`requests` with hit: the key is in the cache. A cached key counts once however often it is stored."""
    known = cache.select("key").filter("key IS NOT NULL").distinct().withColumn("__in", F.lit(True))
    return requests.join(known, "key", "left").withColumn("hit", F.coalesce("__in", F.lit(False))).drop("__in")


def has(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache, "key", "left_semi")


def missing(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache, "key", "left_anti")


def billed(log: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Sums over a log with hit and bytes: bytes of misses are billed, hits are reused."""
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.sum(F.when(F.col("hit"), 0).otherwise(F.col("bytes"))).cast("long").alias("bytes_billed"), F.sum(F.col("hit").cast("long")).alias("cache_hits"))


def with_cost(sums: DataFrame, prices: dict[str, float] | None = None) -> DataFrame:
    """Dollars by model; unknown models cost nothing. The price list is a constant, so it is part of the plan."""
    table = prices or PRICES
    price = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return sums.withColumn("price", F.coalesce(F.try_element_at(price, F.col("model")), F.lit(0.0))).withColumn("cost", F.col("bytes_billed") / 1e6 * F.col("price"))


def put(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The cache after storing `rows`: of each key the row stored last, by created_at, then last_used."""
    whole = cache.unionByName(rows, allowMissingColumns=True)
    latest = F.max_by(F.struct(*whole.columns), F.struct("created_at", "last_used", "bytes"))
    return whole.groupBy("key").agg(latest.alias("row")).select("row.*")


def touched(cache: DataFrame, reads: DataFrame) -> DataFrame:
    """The cache after reads (key, at): last_used is the latest of them."""
    last = reads.groupBy("key").agg(F.max("at").alias("__at"))
    return cache.join(last, "key", "left").withColumn("last_used", F.greatest("last_used", "__at")).drop("__at")


def size(cache: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return cache.groupBy(*by).agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), F.count(F.lit(1)).alias("entries"))


def running_total(rows: DataFrame, value: str, order: list[str], by: tuple[str, ...] = (), name: str = "cum") -> DataFrame:
    """`rows` with the sum of `value` up to and with each row in order, ties by all of `order` in row order."""
    if by:
        window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(name, F.sum(value).over(window))
    ranged = stored(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy("__part").agg(F.sum(value).alias("__sum"))
    # One row a range: the only window without partitions runs over these.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(bases), "__part").withColumn(name, F.sum(value).over(inside) + F.col("__base")).drop("__part", "__base")


def evicted(cache: DataFrame, budget: int = BUDGET, by: tuple[str, ...] = ()) -> DataFrame:
    """Entries to delete, oldest use first (ties by key), until what is left fits the budget."""
    totals = cache.groupBy(*by).agg(F.sum("bytes").alias("__total"))
    placed = running_total(cache, "bytes", ["last_used", "key"], by)
    whole = placed.join(totals, list(by)) if by else placed.crossJoin(F.broadcast(totals))  # one row
    return whole.filter(F.col("__total") - (F.col("cum") - F.col("bytes")) > budget).drop("__total", "cum")


def put_over_quota(cache: DataFrame, rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """A store that failed for space evicts down to half the budget first."""
    gone = evicted(cache, budget // 2).select("key")
    return put(cache.join(gone, "key", "left_anti"), rows)


def look_ahead(utterances: DataFrame, by: str, order: str, ahead: int = 2) -> DataFrame:
    """`utterances` with window_seqs: the play head and up to `ahead` next ones, `ahead` bound to 0..MOST_AHEAD."""
    ahead = max(0, min(ahead, MOST_AHEAD))
    frame = Window.partitionBy(by).orderBy(order).rowsBetween(0, ahead)
    return utterances.withColumn("window_seqs", F.collect_list(order).over(frame))


def out_of_memory(held: DataFrame, by: str, index: str, head: str, keep: int = KEPT_IN_MEMORY) -> DataFrame:
    """Of held clips, those to drop: all but the `keep` nearest to the head; of two as near, the one behind goes first."""
    near = Window.partitionBy(by).orderBy(F.abs(F.col(index) - F.col(head)), F.col(index).desc())
    return held.withColumn("__k", F.row_number().over(near)).filter(F.col("__k") > keep).drop("__k")


def progress(utterances: DataFrame, by: str, order: str) -> DataFrame:
    window = Window.partitionBy(by)
    return utterances.withColumn("progress", F.row_number().over(window.orderBy(order)) / F.count(F.lit(1)).over(window))


def queue_signature(utterances: DataFrame, by: str, voice_id: Column, model: Column) -> DataFrame:
    """count:bytes:voice:model per document; equal signatures keep what was billed so far."""
    sums = utterances.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    return sums.select(by, F.concat_ws(":", F.col("n").cast("string"), F.col("b").cast("string"), voice_id, model).alias("signature"))


def in_flight(requests: DataFrame, by: str, index: str) -> DataFrame:
    """One request for each clip."""
    return requests.dropDuplicates([by, index])


def retryable(status: Column) -> Column:
    return (status == 429) | status.between(500, 599)


def error_hint(status: Column) -> Column:
    """What kind of trouble a status is."""
    out = F.when(status == 401, "key").when(status == 402, "balance").when(status == 429, "rate")
    return out.when(status.between(500, 599), "server").otherwise("other")


def voices(catalogue: DataFrame, page_size: int = 40, page: int = 1) -> DataFrame:
    """A page of usable voices: of type 'tts' and trained, by score (ties by id), 1 to 100 a page."""
    n = max(1, min(page_size, 100))
    usable = catalogue.filter("type = 'tts' AND state = 'trained'")
    return usable.orderBy(F.desc_nulls_last("score"), "id").offset((max(1, page) - 1) * n).limit(n)


def normalized_voices(raw: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return raw.select("id", F.coalesce("title", F.lit("Untitled")).alias("title"), F.coalesce("languages", empty).alias("languages"), F.coalesce("tags", empty).alias("tags"), count("likes"), count("tasks"), text("author"), text("description"), text("sample_url"))


def safe_sample(url: Column) -> Column:
    return F.when(url.rlike("^https?://"), url)


def merged_voices(probes: DataFrame) -> DataFrame:
    """Union of probes' results (probe, seq, id, ...) by id: attributes of the first probe that found it, all probes
    that did in order, most liked first."""
    rest = [c for c in probes.columns if c not in ("probe", "seq", "id")]
    first = F.min_by(F.struct(*rest), F.struct("seq", "probe"))
    found = F.transform(F.array_sort(F.collect_set(F.struct("seq", "probe"))), lambda x: x["probe"])
    merged = probes.groupBy("id").agg(first.alias("a"), found.alias("matched_by"))
    return merged.select("id", "a.*", "matched_by").orderBy(F.desc("likes"), "id")


def bounded_ahead(ahead: Column) -> Column:
    return clamp(ahead, 0, MOST_AHEAD)
