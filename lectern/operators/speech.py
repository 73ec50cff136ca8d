"""From blocks to utterances and statistics.

Everything stays in a page's row until its blocks are exploded: which block opens the document, and so gets the small
first chunk, is found among the page's array, without a window or a shuffle. Then utterances are numbered by a window over
their page, the one shuffle there is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.sentences import chunked, hard_wrap
from lectern.functions.text import BREAK, JUNK_CAPTION, LONG_BREAK, is_speakable, linearize_table, normalize_prose, speakable_code, strip_brackets, tidy, utf8_bytes, whitespace_words
from lectern.settings import Settings

WORDS_A_MINUTE = 155
UTTERANCE_COLUMNS = ("page_id", "utt_seq", "id", "block_id", "block_seq", "uid", "kind", "text", "bytes")


def _emits(kind: Column, text: Column, cfg: Settings) -> Column:
    """Whether a block of normalised text gives any utterance."""
    said = text != ""
    return (
        F.when(kind == "heading", said & F.lit(cfg.read_headings))
        .when(kind == "list-item", said)
        .when(kind.isin("code", "table", "math"), F.lit(True))
        .when(kind == "figure", ~_figure_skipped(text, cfg))
        .when(kind == "quote", said)
        .otherwise(is_speakable(text))
    )


def _figure_skipped(text: Column, cfg: Settings) -> Column:
    return F.lit(not cfg.read_figures) | (whitespace_words(text) < 3) | text.rlike(JUNK_CAPTION)


def _said(cfg: Settings) -> Column:
    """Texts of an exploded block's utterances before tidying; columns kind, level, raw, norm, meta, chunks."""
    kind, norm, meta, chunks = F.col("kind"), F.col("norm"), F.col("meta"), F.col("chunks")
    text = lambda *parts: F.array(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    none = F.array().cast("array<string>")
    lines = F.coalesce(F.nullif(meta["lines"], F.lit(0)), F.size(F.split(F.col("raw"), "\n", -1)))
    n = F.size(chunks)
    quoted = F.transform(chunks, lambda c, i: F.concat(F.when(i == 0, "Quote, ").otherwise(""), c, F.when(i == n - 1, " End quote.").otherwise("")))
    heading = text(F.when(F.coalesce(F.nullif(F.col("level"), F.lit(0)), F.lit(2)) <= 2, LONG_BREAK).otherwise(""), " ", norm, ".", BREAK)
    if cfg.skip_code:
        code = text("Code block, ", lines.cast("string"), F.when(lines == 1, " line").otherwise(" lines"), ", skipped.", BREAK)
    else:
        code = text("Code block. ", speakable_code(strip_brackets(F.col("raw"))), BREAK)
    count = lambda x: F.coalesce(x, F.lit(0)).cast("string")
    if cfg.skip_tables:
        table = text("Table with ", count(meta["rows"]), " rows and ", count(meta["cols"]), " columns, skipped.", BREAK)
    else:
        cells = meta["cells"] if cfg.pair_tables else F.lit(None).cast("array<array<string>>")
        table = text(linearize_table(norm, cells), BREAK)
    return (
        F.when(kind == "code", code)
        .when(kind == "table", table)
        .when(kind == "math", F.when(norm != "", text(norm, BREAK)).otherwise(text("Equation, skipped.", BREAK)))
        .when(kind == "figure", F.when(_figure_skipped(norm, cfg), none).otherwise(text("Figure: ", norm, BREAK)))
        .when(norm == "", none)
        .when(kind == "heading", heading if cfg.read_headings else none)
        .when(kind == "list-item", text(norm, BREAK))
        .when(kind == "quote", quoted)
        .when(kind == "paragraph", chunks)
        .otherwise(F.array(norm))
    )


def speechify(extractions: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """Utterances of `extractions` (page_id, blocks array): UTTERANCE_COLUMNS, numbered from 0 in each page."""
    cfg = cfg or Settings()
    norm = F.transform("blocks", lambda b: normalize_prose(F.coalesce(b["text"], F.lit(""))))
    rows = extractions.select("page_id", "blocks").withColumn("norms", norm)
    emits = F.transform(F.arrays_zip("blocks", "norms"), lambda x: _emits(x["blocks"]["kind"], x["norms"], cfg))
    rows = rows.withColumn("opens", F.array_position(emits, True))  # from 1; 0 if nothing is said
    each = rows.select("page_id", "opens", F.posexplode(F.arrays_zip("blocks", "norms")).alias("at", "x"))
    b = F.col("x.blocks")
    each = each.select("page_id", "at", "opens", b["id"].alias("block_id"), F.coalesce(b["seq"], F.col("at")).alias("block_seq"), b["uid"].alias("uid"), b["kind"].alias("kind"), b["level"].alias("level"), F.coalesce(b["text"], F.lit("")).alias("raw"), b["meta"].alias("meta"), F.col("x.norms").alias("norm"))
    early = (F.col("opens") == 0) | (F.col("at") < F.col("opens"))
    cap = F.when(early, cfg.first_chunk_chars).otherwise(cfg.max_chunk_chars)
    read = each.withColumn("chunks", F.when(F.col("kind").isin("paragraph", "quote"), chunked(F.col("norm"), cfg.max_chunk_chars, cap, cfg.sentences)))
    clean = F.filter(F.transform(_said(cfg), tidy), lambda s: (s != "") & is_speakable(s))
    pieces = read.withColumn("pieces", F.flatten(F.transform(clean, lambda s: hard_wrap(s, cfg.hard_wrap_chars))))
    said = pieces.select("page_id", "at", "block_id", "block_seq", "uid", "kind", F.posexplode("pieces").alias("piece", "text"))
    return _numbered(said).select("page_id", "utt_seq", F.concat(F.lit("u"), F.col("utt_seq").cast("string")).alias("id"), "block_id", "block_seq", "uid", "kind", "text", utf8_bytes(F.col("text")).cast("long").alias("bytes"))


def _numbered(said: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("page_id").orderBy("at", "piece")
    return said.withColumn("utt_seq", F.row_number().over(order) - 1)


def skip_counts(blocks: Column, cfg: Settings | None = None) -> Column:
    """Struct of skipped code, tables, figures and math in a page's blocks."""
    cfg = cfg or Settings()
    norm = lambda b: normalize_prose(F.coalesce(b["text"], F.lit("")))
    count = lambda test: F.size(F.filter(blocks, test))
    return F.struct(
        count(lambda b: (b["kind"] == "code") & F.lit(cfg.skip_code)).alias("code"),
        count(lambda b: (b["kind"] == "table") & F.lit(cfg.skip_tables)).alias("tables"),
        count(lambda b: (b["kind"] == "figure") & _figure_skipped(norm(b), cfg)).alias("figures"),
        count(lambda b: (b["kind"] == "math") & (norm(b) == "")).alias("math"),
    )


def est_seconds(words: Column, speed: float = 1.0) -> Column:
    return F.floor(words / WORDS_A_MINUTE * 60 / (speed or 1.0) + 0.5).cast("long")


def stats(extractions: DataFrame, utterances: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """A row per page: utterances, total_bytes, words (marks count), est_seconds, skipped_*. Pages that say nothing count 0."""
    cfg = cfg or Settings()
    sums = utterances.groupBy("page_id").agg(F.count(F.lit(1)).alias("utterances"), F.sum("bytes").alias("total_bytes"), F.sum(whitespace_words(F.col("text"))).alias("words"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    skipped = skip_counts(F.col("blocks"), cfg)
    whole = extractions.select("page_id", skipped.alias("s")).join(sums, "page_id", "left")
    return whole.select("page_id", zero("utterances"), zero("total_bytes"), zero("words"), est_seconds(F.coalesce("words", F.lit(0)), cfg.speed).alias("est_seconds"), *[F.col(f"s.{k}").cast("long").alias(f"skipped_{k}") for k in ("code", "tables", "figures", "math")])
