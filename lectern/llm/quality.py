"""Quality rules as weak supervision (operator 8), in DataFrame operations alone.

Each rule looks at one property of a text and votes good (1) or bad (-1) or abstains (0). Nobody's labels are used:
expectation-maximisation over the counts of vote patterns estimates, for each rule, how often it votes good on good
and on bad documents, and how common good ones are. A document's posterior probability of being good then decides,
rather than all rules having to pass. There are at most 3 to the number of rules patterns, so iterations run over a
small table whatever the input's size; counts are over all documents.

A text's measures need no shuffle: words and lines are arrays of its own row. Null and empty texts have no words and
fail. Repeated rows and equal doc_ids are judged each by itself. Other columns pass through; those with names of the
result's columns are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import persisted

BLANK = " \t\n\x0b\x0c\r"
BLANK_CLASS = "[\\x20\\x09-\\x0D]"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
ROUNDS = 12
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_letters", "n_marks", "n_bare", "n_distinct")


def let(value: Column, use) -> Column:
    """use(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANK))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_CLASS + "+"))


def repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text, the first one included."""
    hashes = let(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW)))))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = let(placed, lambda p: F.transform(F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))
        return let(F.array_sort(same), lambda s: F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) > WINDOW, counted).otherwise(F.lit(0))


def measure(docs: DataFrame) -> DataFrame:
    """`docs` with a column for each measure, without text."""
    text, words, lines = F.col("__text"), F.col("__words"), F.col("__lines")
    got = {
        "n_words": F.size(words),
        "word_chars": F.char_length(F.concat_ws("", words)),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(words),
        "n_upper": F.regexp_count(text, F.lit("\\p{Lu}")),
        "n_letters": F.regexp_count(text, F.lit("\\p{L}")),
        "n_marks": F.regexp_count(text, F.lit("[!?]{2}")),
        "n_bare": F.size(F.filter(words, lambda w: ~w.rlike("[\\p{L}\\p{N}]"))),
        "n_distinct": F.size(F.array_distinct(words)),
    }
    lines_with_words = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    return (
        docs.withColumn("__text", F.coalesce(F.col("text"), F.lit("")))
        .withColumns({"__words": words_of(F.col("__text")), "__lines": lines_with_words})
        .withColumns({k: v.cast("long") for k, v in got.items()})
        .drop("__text", "__words", "__lines")
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by rule. A document without words gets no good vote. Each kind of junk is in view of two rules or more, as
    estimation learns how good a rule is from those that agree with it."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    some = F.col("n_words") > 0
    share = lambda name, of: F.col(name) / of
    return {
        "symbols": _vote(some & (share("n_symbols", chars) < 0.01), share("n_symbols", chars) > 0.05),
        "capitals": _vote(share("n_upper", chars) < 0.15, share("n_upper", F.greatest(F.col("n_letters"), F.lit(1))) > 0.5),
        "repeats": _vote(some & (share("n_repeat_words", n) < 0.05), share("n_repeat_words", n) > 0.2),
        "lines": _vote(some & (share("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1))) < 0.1), share("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1))) > 0.4),
        "marks": _vote(some & (share("n_marks", n) < 0.02), share("n_marks", n) > 0.1),
        "separators": _vote(some & (share("n_symbols", n) < 0.05), share("n_symbols", n) > 0.2),
        "bare": _vote(some & (share("n_bare", n) < 0.05), share("n_bare", n) > 0.25),
        "letters": _vote(share("n_letters", chars) > 0.85, share("n_letters", chars) < 0.75),
        "length": _vote(F.col("n_words") >= 30, F.col("n_words") < MIN_WORDS),
        "variety": _vote((F.col("n_words") >= 30) & (share("n_distinct", n) > 0.25), (F.col("n_words") >= 30) & (share("n_distinct", n) < 0.12)),
    }


def estimate(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[float, dict[str, tuple[float, float]]]:
    """Prior of good, and for each rule P(good vote | it votes, good) and P(good vote | it votes, bad), by
    expectation-maximisation over (vote columns, n). It starts from rules that seldom accuse a good document and accuse a
    bad one now and then, so one bad vote outweighs the good votes of rules that look at other defects; counts are
    smoothed the same way."""
    prior, rates = 0.85, {r: (0.997, 0.8) for r in names}
    for _ in range(rounds):
        p = posterior(prior, rates)
        sums = [F.sum("n").alias("all"), F.sum(p * F.col("n")).alias("good")]
        for r in names:
            for vote, tag in ((1, "up"), (-1, "down")):
                here = F.when(F.col(r) == vote, F.col("n")).otherwise(0)
                sums += [F.sum(p * here).alias(f"{r}_{tag}_good"), F.sum((1 - p) * here).alias(f"{r}_{tag}_bad")]
        got = {k: float(v or 0) for k, v in patterns.agg(*sums).first().asDict().items()}
        prior = min(0.99, max(0.01, (got["good"] + 1) / (got["all"] + 2)))
        for r in names:
            up, down = got[f"{r}_up_good"], got[f"{r}_down_good"]
            up_bad, down_bad = got[f"{r}_up_bad"], got[f"{r}_down_bad"]
            rates[r] = ((up + 199) / (up + down + 200), (up_bad + 8) / (up_bad + down_bad + 10))
    return prior, rates


def posterior(prior: float, rates: dict[str, tuple[float, float]]) -> Column:
    """P(good | votes): log-odds add up over the rules that vote."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for r, (good, bad) in rates.items():
        odds = odds + F.when(F.col(r) == 1, math.log(good / bad)).when(F.col(r) == -1, math.log((1 - good) / (1 - bad))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """`docs` (doc_id, text, ...) without text, with the measures, base_failed, quality (posterior) and kept."""
    votes = rules()
    measured = persisted(measure(docs).drop("text").withColumns(votes), "measures")
    names = list(votes)
    patterns = persisted(measured.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "patterns")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = measured.withColumn("base_failed", failed).withColumn("quality", posterior(*estimate(patterns, names, rounds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
