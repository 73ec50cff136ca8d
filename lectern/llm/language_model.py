"""A hidden Markov language model (operator 4): scores texts by exact sequence likelihood.

Tokens are runs of non-blank bytes, A-Z lower-cased, and one end per text. Word counts of all training texts are summed
across partitions. The FREQUENT most common words are symbols of the model by themselves; any other word belongs to one
of RARE classes by its last bytes, and its probability inside the class is its add-one share of the class's training
tokens. So a text's probability is that of its symbols under the hidden Markov model, times that of its rare words in
their classes, which a join with the table of all counts gives: the vocabulary is nowhere held whole.

Baum-Welch runs over all training texts, in windows of WINDOW tokens for bounded memory: each task returns the expected
counts of its rows, groups of tasks are summed, and the driver, which sees at most SUMS such sums whatever the input, takes
the next parameters from them. Scores come from the scaled forward recursion over whole texts, many texts at a time.

Null texts count as empty: they have the end token alone. Rows are scored each by itself. Without training texts all
words are unknown and the model's emissions are uniform. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import persisted, text_bytes

FREQUENT, RARE, SUFFIX = 24_000, 256, 2
STATES, ROUNDS, WINDOW, SUMS = 6, 4, 256, 16
#: Distinct words one task counts before it passes them on.
COUNTED = 400_000
WINDOWS_AT_ONCE = 2048
#: Texts that a task turns to symbols at a time.
TEXTS_AT_ONCE = 500
SMOOTHING = 50.0


def tokens(text: bytes) -> list[bytes]:
    """Words; the end token is not among them."""
    return text.lower().split()


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of `texts` (text)."""

    def work(batches):
        import pyarrow as pa

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([*seen], pa.binary()), pa.array([*seen.values()], pa.int64())], ["word", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for text in text_bytes(batch.column("text")):
                seen.update(tokens(text))
                if len(seen) >= COUNTED:
                    yield rows()
                    seen = Counter()
        yield rows()

    return texts.mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rare_class(word: Column) -> Column:
    return F.pmod(F.crc32(F.substring(word, -SUFFIX, SUFFIX)), F.lit(RARE))


@dataclass
class Counts:
    """What is known of the words: counts of the frequent ones, tokens and words of the rare classes, totals."""

    frequent: dict[bytes, int]
    symbol_counts: list[int]
    class_tokens: list[int]
    class_words: list[int]
    train_tokens: int
    train_words: int
    ends: int

    @property
    def n_symbols(self) -> int:
        return FREQUENT + RARE + 1


def summarise(counts: DataFrame, ends: int) -> Counts:
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    all_n, all_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = {bytes(r.word): k for k, r in enumerate(top)}
    class_tokens, class_words = [0] * RARE, [0] * RARE
    for r in counts.groupBy(rare_class(F.col("word")).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        class_tokens[r.c], class_words[r.c] = r.n, r.words
    for r in top:
        c = zlib.crc32(bytes(r.word)[-SUFFIX:]) % RARE
        class_tokens[c] -= r.n
        class_words[c] -= 1
    symbols = [r.n for r in top] + [0] * (FREQUENT - len(top)) + class_tokens + [ends]
    return Counts(frequent, symbols, class_tokens, class_words, all_n + ends, all_words + (ends > 0), ends)


class Symbols(dict):
    """Symbol numbers of words."""

    def __missing__(self, word: bytes) -> int:
        return FREQUENT + zlib.crc32(word[-SUFFIX:]) % RARE


def encoded(rows: DataFrame, counts: Counts) -> DataFrame:
    """(doc_id, held_out, symbols as unsigned 16-bit, rare words and their numbers) for rows (doc_id, held_out, text)."""
    sent = rows.sparkSession.sparkContext.broadcast(counts.frequent)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        number = Symbols(sent.value).__getitem__
        # Few texts at a time: their words are objects until they are numbers.
        for batch in (b.slice(at, TEXTS_AT_ONCE) for b in batches for at in range(0, b.num_rows, TEXTS_AT_ONCE)):
            symbols, rare = [], []
            for text in text_bytes(batch.column("text")):
                found = tokens(text)
                codes = np.empty(len(found) + 1, np.uint16)
                codes[:-1] = [number(w) for w in found] if len(found) < 4 else np.fromiter(map(number, found), np.uint16, len(found))
                codes[-1] = FREQUENT + RARE
                symbols.append(codes.tobytes())
                rare.append(Counter(found[k] for k in np.flatnonzero((codes >= FREQUENT) & (codes < FREQUENT + RARE)).tolist()))
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(symbols, pa.binary())]
            arrays += [pa.array([[*r] for r in rare], pa.list_(pa.binary())), pa.array([[*r.values()] for r in rare], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "symbols", "rare", "rare_n"])

    return rows.mapInArrow(work, "doc_id long, held_out boolean, symbols binary, rare array<binary>, rare_n array<int>")


@dataclass
class Model:
    start: object  # (K,)
    move: object  # (K, K)
    emit: object  # (symbols, K)


def first_model(counts: Counts, states: int) -> Model:
    """States that stay, with emissions scattered around the words' shares."""
    import numpy as np

    noise = np.random.default_rng(7).normal(0, 1.0, (counts.n_symbols, states))
    emit = (np.array(counts.symbol_counts, float) + 1)[:, None] * np.exp(noise)
    move = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    if states > 1:
        np.fill_diagonal(move, 0.9)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def next_model(model: Model, counts: Counts, start, move, emit) -> Model:
    """Parameters from expected counts; emissions are smoothed towards the words' shares."""
    import numpy as np

    share = np.array(counts.symbol_counts, float) + 1
    emit = emit + SMOOTHING * (share / share.sum())[:, None]
    start, move = start + 1, move + 1
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def expected(model: Model, texts: list) -> tuple:
    """Expected counts of starts, moves and emissions in `texts`, arrays of symbols, cut into windows."""
    import numpy as np

    start, move, emit = (np.asarray(x, np.float32) for x in (model.start, model.move, model.emit))
    k = len(start)
    got_start, got_move, got_emit = np.zeros(k), np.zeros((k, k)), np.zeros(emit.shape)
    windows = sorted((t[i : i + WINDOW] for t in texts for i in range(0, len(t), WINDOW)), key=len, reverse=True)
    for at in range(0, len(windows), WINDOWS_AT_ONCE):
        part = windows[at : at + WINDOWS_AT_ONCE]
        lengths = np.array([len(w) for w in part])
        grid = np.zeros((lengths[0], len(part)), np.uint16)
        for j, w in enumerate(part):
            grid[: len(w), j] = w
        active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(lengths[0])]  # windows longer than t
        alphas, emits = [], []
        alpha = None
        for t, n in enumerate(active):
            e = emit[grid[t, :n]]
            alpha = (np.broadcast_to(start, (n, k)) if t == 0 else alpha[:n] @ move) * e
            alpha = alpha / alpha.sum(axis=1, keepdims=True)
            alphas.append(alpha)
            emits.append(e)
        gammas = [None] * len(active)
        beta = np.zeros((0, k), np.float32)
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            if len(beta) < n:
                beta = np.concatenate([beta, np.ones((n - len(beta), k), np.float32)])
            gamma = alphas[t] * beta
            gamma /= gamma.sum(axis=1, keepdims=True)
            gammas[t] = gamma
            if t:
                ahead = emits[t] * beta
                back = ahead @ move.T
                norm = (alphas[t - 1][:n] * back).sum(axis=1, keepdims=True)
                got_move += move * (alphas[t - 1][:n].T @ (ahead / norm))
                beta = back / back.sum(axis=1, keepdims=True)
        got_start += gammas[0].sum(axis=0)
        codes = np.concatenate([grid[t, :n] for t, n in enumerate(active)])
        weights = np.concatenate(gammas)
        for state in range(k):
            got_emit[:, state] += np.bincount(codes, weights=weights[:, state], minlength=len(got_emit))
    return got_start, got_move, got_emit


def likelihoods(model: Model, texts: list):
    """Natural log likelihood of each of `texts`, by the scaled forward recursion."""
    import numpy as np

    order = sorted(range(len(texts)), key=lambda j: -len(texts[j]))
    lengths = np.array([len(texts[j]) for j in order])
    flat = np.concatenate([texts[j] for j in order])
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left").tolist()
    logs, alpha = np.zeros(len(order)), None
    for t, n in enumerate(active):
        e = model.emit[flat[begins[:n] + t]]
        alpha = (model.start if t == 0 else alpha[:n] @ model.move) * e
        scale = alpha.sum(axis=1)
        logs[:n] += np.log(scale)
        alpha = alpha / scale[:, None]
    out = np.empty(len(order))
    out[order] = logs
    return out


def _unpacked(column) -> list:
    import numpy as np

    return [np.frombuffer(x, np.uint16) for x in column.to_pylist()]


def train(codes: DataFrame, counts: Counts, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all rows of `codes` (symbols)."""
    import numpy as np

    model = first_model(counts, states)
    shape = (counts.n_symbols + states + 1, states)
    for _ in range(rounds):
        sent = codes.sparkSession.sparkContext.broadcast(model)

        def work(batches, sent=sent):
            import pyarrow as pa

            total = np.zeros(shape)
            for batch in batches:
                texts = _unpacked(batch.column("symbols"))
                if texts:
                    start, move, emit = expected(sent.value, texts)
                    total += np.concatenate([start[None, :], move, emit])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "part"])

        def add(batches):
            import pyarrow as pa

            total: dict[int, object] = {}
            for batch in batches:
                for slot, part in zip(batch.column("slot").to_pylist(), batch.column("part").to_pylist(), strict=True):
                    total[slot] = total.get(slot, 0) + np.frombuffer(part)
            yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slot", "part"])

        sums = codes.select("symbols").mapInArrow(work, "slot int, part binary").repartition(SUMS, "slot").mapInArrow(add, "slot int, part binary")
        total = np.zeros(shape)
        for row in sums.collect():
            total += np.frombuffer(row.part).reshape(shape)
        model = next_model(model, counts, total[0], total[1 : states + 1], total[states + 1 :])
        sent.unpersist()
    return model


def score(docs: DataFrame, held_out: Column, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Scores of all `docs` (doc_id, text) by a model of those where held_out is false: doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score."""
    import math

    import numpy as np

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    training = rows.filter(~F.col("held_out"))
    vocabulary = persisted(count_words(training.select("text")), "counts")
    counts = summarise(vocabulary, training.count())
    codes = persisted(encoded(rows, counts).withColumn("row", F.monotonically_increasing_id()), "codes")
    model = train(codes.filter(~F.col("held_out")), counts, states, rounds)

    uses = codes.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("k"))
    known = uses.join(vocabulary, "word", "left")
    rare = known.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + 1.0)).alias("rare_log"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("rare_known"))

    ones = np.log10(np.array(counts.symbol_counts[:FREQUENT] + [0] * RARE + [counts.ends], float) + 1)
    in_class = np.zeros(counts.n_symbols)
    in_class[FREQUENT : FREQUENT + RARE] = np.log10(np.array(counts.class_tokens) + np.array(counts.class_words) + 1.0)
    seen = np.array([n > 0 for n in counts.symbol_counts[:FREQUENT]] + [False] * RARE + [counts.ends > 0])
    base_log = math.log10(counts.train_tokens + counts.train_words + 1)
    sent = docs.sparkSession.sparkContext.broadcast((model, ones, in_class, seen))

    def work(batches):
        import pyarrow as pa

        model, ones, in_class, seen = sent.value
        for batch in batches:
            texts = _unpacked(batch.column("symbols"))
            if not texts:
                continue
            logs = likelihoods(model, texts) / math.log(10)
            arrays = [[len(t) for t in texts], [int(seen[t].sum()) for t in texts], [float(ones[t].sum()) for t in texts], [float(x - in_class[t].sum()) for x, t in zip(logs, texts, strict=True)]]
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("held_out"), *map(pa.array, arrays, types)], ["row", "doc_id", "held_out", "n_tokens", "known", "base", "symbols"])

    scored = codes.select("row", "doc_id", "held_out", "symbols").mapInArrow(work, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, symbols double")
    whole = scored.join(rare, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(counts.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log - F.col("n_tokens") * base_log).alias("base_score"),
        (F.col("symbols") + rare_log).alias("score"),
    )
