"""Toxicity of noisy text (operator 5): restore disguised words, then score the restored text.

Spans that may be disguised (a sign or digit touching a letter, doubled letters, three or more single characters set apart)
are lattices of the letters each character may stand for. Repeated letters are optional; a run of separators, or a sign,
either ends a word or doesn't. One or two MASKS inside a word may stand for any letters with which it can still be one of
the common words. Viterbi decoding under a character trigram model takes the likeliest words; it is exact, as states are the
last two letters and, for beginnings of common words, the word. Words that are Latin but for look-alikes of other scripts are
written in Latin letters before. As doubled
letters are common in plain text, dropping them also has to outweigh DISGUISED; the gains of pairs don't depend on each
other, so pairs are weighed for a whole text at once, and only words that change are decoded. Exclamation marks that
follow a word and are followed by no letter are punctuation. The model's counts are over all documents and use no labels.
Words and word beginnings of the restored text are features of a logistic regression.

It is fitted on at most SAMPLE labelled rows, those of least hash, so the few rows travel to the documents and no text is
shuffled; with fewer labelled rows all of them are used. Its features are those that occur more often in toxic rows by a
likelihood ratio of LEAST_RATIO or more, the best FEATURES of them, and their weights are not negative: a text gets more
toxic by what it says, never less. Scoring covers whole texts of all rows, each by itself.

Null and empty texts score by the intercept alone; so does everything if only one label occurs or none. Repeated rows and
equal doc_ids are scored alike; equal doc_ids in the labels count once, as toxic if any of their rows is. Other columns pass
through; those named score, predicted or held_out are replaced.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import persisted, text_bytes
from lectern.llm.words import words

SAMPLE, FEATURES = 20_000, 4_000
LEAST_DOCS, LEAST_RATIO = 3, 25.0
BEGINNINGS = (4, 5, 6)
#: Letters that a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
SEPARATORS, MASKS = " .-_*/,#", "*#"
#: Letters of other scripts that look like a Latin one.
LOOK_ALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "А": "a", "В": "b", "Е": "e", "К": "k", "М": "m", "Н": "h", "О": "o", "Р": "p", "С": "c", "Т": "t", "Х": "x", "У": "y", "І": "i", "Ј": "j", "Ѕ": "s", "ο": "o", "Ο": "o"}
_LOOK_ALIKE = str.maketrans(LOOK_ALIKES)
_SCRIPTS_MEET, _RUN = re.compile(rb"[a-z][\xce\xd0\xd1]|(?:[\xce\xd0\xd1][\x80-\xbf])[a-z]"), re.compile(rb"[a-z\x80-\xff]+")
ALPHABET = 28  # edges of words, a-z, any other letter's byte
_LEET, _SEP = re.escape("".join(SIGNS)).encode(), re.escape(SEPARATORS).encode()
_ONE, _WORD = rb"[a-z" + _LEET + rb"]", rb"[a-z\x80-\xff" + _LEET + rb"]"
_SPACED = rb"(?<!" + _WORD[:-1] + rb"])" + _ONE + rb"(?:[" + _SEP + rb"]+" + _ONE + rb"(?!" + _WORD + rb")){2,}"
_TOUCHED = rb"[a-z](?:[*#" + _LEET.replace(b"!", b"") + rb"]|!+[a-z])|[*#" + _LEET + rb"][a-z]"
#: What makes a span worth a look.
SPACED, SUSPECT = re.compile(_SPACED), re.compile(_SPACED + rb"|" + _TOUCHED + rb"|([a-z])\1")
#: Log probabilities of the channel.
KEPT, DROPPED_REPEAT, DROPPED_PAIR, STOOD_FOR = math.log(0.9), math.log(0.5), math.log(0.1), math.log(0.4)
ENDED_BY_SIGN, ENDED_BY_MARK, MORE_SIGNS = math.log(0.005), math.log(0.9), math.log(0.05)
JOINED, PARTED, PARTED_OTHERWISE, MASKED = math.log(0.9), math.log(0.1), math.log(0.99), math.log(0.1)
#: Masked letters in a row.
MASKED_RUN = 2
#: Of a word whose letters are doubled on purpose.
DISGUISED = math.log(1e-6)
#: Of a word that is none of the common ones.
UNKNOWN = math.log(0.01)
REMEMBERED = 100_000
#: Longer spans are decoded in parts of at most so many characters, which are remembered like spans.
PART = 1_000
#: Words whose counts the model has, and the longest of them.
VOCABULARY, LONGEST = 20_000, 20


def code(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27


class CharModel:
    """Log probabilities of a letter after two others, from trigram counts with shorter ones mixed in, and of common words."""

    def __init__(self, counts, frequent: dict[str, int] | None = None):
        import numpy as np

        three = np.asarray(counts, float).reshape((ALPHABET,) * 3)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        share = (one + 1) / (one.sum() + ALPHABET)
        pair = (two + 20 * share) / (two.sum(axis=1, keepdims=True) + 20)
        triple = (three + 20 * pair[None]) / (three.sum(axis=2, keepdims=True) + 20)
        log = np.log(triple)
        self.log = log.tolist()
        # What dropping the second x of w x x y gains.
        x = np.arange(ALPHABET)
        self.gain = DROPPED_REPEAT + log - log[:, x, x][:, :, None] - log[x, x, :][None]
        self.known: dict[bytes, bytes] = {}
        # Words end once each, so pairs that end in an edge count all words.
        self.frequent = {w: math.log(n / max(two[:, 0].sum(), n, 1)) for w, n in (frequent or {}).items()}

    def restore(self, span: bytes) -> bytes:
        """The likeliest words behind a span. Spans of more than PART characters are decoded part by part, cut behind the
        last separators of each if there are any: no disguised word is that long, and long runs of signs recur."""
        if len(span) > PART:
            return b"".join(self.restore(part) for part in _parts(span))
        got = self.known.get(span)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[span] = self.decode(span.decode("ascii"))[1].encode()
        return got

    @functools.cached_property
    def letters_after(self) -> dict[str, str]:
        """The letters that follow each beginning of a common word in any of them; none after a whole one."""
        after: dict[str, set[str]] = {}
        for word in self.frequent:
            for k, letter in enumerate(word):
                after.setdefault(word[:k], set()).add(letter)
            after.setdefault(word, set())
        return {word: "".join(sorted(letters)) for word, letters in after.items()}

    def decode(self, span: str) -> tuple[float, str]:
        """The likeliest words behind a span, and their log probability."""
        log, frequent, after = self.log, self.frequent, self.letters_after
        # Dropped letters of a span without signs and separators need a reason, as such spans are common in plain text.
        plain = span.isalpha()
        # States are the open word if it begins a common one, else None; the codes of its last two letters, 0 for none; and,
        # in plain spans, whether any letter was dropped. Each has its best log probability, that at the word's start with the
        # channel's since then, and what it came from, as nested pairs. The same word makes the same difference of both.
        best: dict[tuple, tuple[float, float, tuple | None]] = {("", 0, 0, False): (0.0, 0.0, None)}
        parts = [m[0] for m in re.finditer(rf"[{re.escape(SEPARATORS)}]+|(.)\1*", span, re.DOTALL)]
        usual = Counter(r for r in parts if r[0] in SEPARATORS).most_common(1)

        def ended(word, a, b, p, before):
            return max(p + log[a][b][0] + UNKNOWN, before + frequent.get(word, -math.inf)) if b else p

        for k, run in enumerate(parts):
            c, apart = run[0], run[0] in SEPARATORS
            masks = len(run) if apart and len(run) <= MASKED_RUN and 0 < k < len(parts) - 1 and not run.strip(MASKS) else 0
            for _ in range(1 if apart else len(run)):
                now: dict[tuple, tuple[float, float, tuple | None]] = {}

                def offer(word, a, b, dropped, p, before, path, now=now):
                    key = (word, a, b, dropped)
                    if key not in now or p > now[key][0]:
                        now[key] = (p, before, path)

                for (word, a, b, dropped), (p, before, path) in best.items():
                    if apart:
                        offer(word, a, b, dropped, p + JOINED, before + JOINED, path)
                        end = ended(word, a, b, p, before) + (PARTED if run == usual[0][0] else PARTED_OTHERWISE)
                        offer("", 0, 0, dropped, end, end, (path, " "))
                        filled = [(word, a, b, p, before, path)] if masks and word is not None else []
                        for _ in range(masks):
                            filled = [(w + x, j, code(x), q + log[i][j][code(x)] + MASKED, start + MASKED, (way, x)) for w, i, j, q, start, way in filled for x in after.get(w, "")]
                        for w, i, j, q, start, way in filled:
                            offer(w, i, j, dropped, q, start, way)
                        continue
                    for letter in SIGNS.get(c, c):
                        x = code(letter)
                        cost = 0.0 if plain else KEPT if letter == c else STOOD_FOR
                        longer = word + letter if word is not None and word + letter in after else None
                        offer(longer, b, x, dropped, p + log[a][b][x] + cost, before + cost, (path, letter))
                        if x == b and len(run) > (letter != c) + 1:
                            cost = (DROPPED_REPEAT if plain or len(run) > 2 else DROPPED_PAIR) + (DISGUISED if plain and not dropped else 0.0)
                            offer(word, a, b, plain, p + cost, before + cost, path)
                    if c in SIGNS:
                        end = ended(word, a, b, p, before) + (ENDED_BY_MARK if c == "!" else ENDED_BY_SIGN if b else MORE_SIGNS)
                        offer("", 0, 0, dropped, end, end, (path, c))
                best = now
        total, path = max(((ended(word, a, b, p, before), path) for (word, a, b, _), (p, before, path) in best.items()), key=lambda x: x[0])
        out: list[str] = []
        while path:
            path, letter = path
            out.append(letter)
        return total, "".join(reversed(out))

    def restored(self, text: bytes) -> bytes:
        """`text` lower-cased in ASCII, with disguised spans restored."""
        low = latin(text.lower())
        if set_apart(low):
            low = SPACED.sub(lambda m: self.restore(m[0]) if any(97 <= x < 123 for x in m[0]) else m[0], low)
        out, at = [], 0
        for start, end in self._words_to_decode(low):
            word = low[start:end]
            new = self.restore(word)
            if new != word:
                out += low[at:start], new
                at = end
        return b"".join([*out, low[at:]]) if out else low

    def _words_to_decode(self, low: bytes):
        """Starts and ends of runs of letters and signs that decoding may change."""
        import numpy as np

        x = np.frombuffer(b"  " + low + b"  ", np.uint8)
        touched, same = _touched(x), _same(x)
        pairs = np.flatnonzero(same)
        if not len(pairs) and not touched.any():
            return []
        edge = np.diff((_letter(x) | _SIGN_TABLE[x]).view(np.int8))
        starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        codes = _CODE_TABLE[x]
        gain = np.maximum(self.gain[codes[pairs - 1], codes[pairs], codes[pairs + 2]], 0)
        # Letters that stand three times in a row are always looked at.
        gain[same[pairs + 1] | same[pairs - 1]] = np.inf
        total = np.bincount(np.searchsorted(starts, pairs, "right") - 1, gain, len(starts)).astype(float)
        total[np.searchsorted(starts, np.flatnonzero(touched), "right") - 1] = np.inf
        chosen = np.flatnonzero(total > UNKNOWN - DISGUISED)
        return zip((starts[chosen] - 2).tolist(), (ends[chosen] - 2).tolist(), strict=True)


def latin(low: bytes) -> bytes:
    """`low` with look-alikes replaced in words that are Latin but for them."""
    if not _SCRIPTS_MEET.search(low):
        return low

    def written(m):
        word = m[0].decode("utf-8", "replace").translate(_LOOK_ALIKE)
        return word.encode() if word.isascii() else m[0]

    return _RUN.sub(written, low)


def _parts(span: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(span):
        part = span[at : at + PART]
        if at + PART < len(span):
            bare = part.rstrip(SEPARATORS.encode())
            ends = [bare.rfind(c) for c in SEPARATORS.encode()]
            part = part[: max(ends) + 1] or part
        out.append(part)
        at += len(part)
    return out


def _letter(x):
    return _CODE_TABLE[x] > 0


def _same(x):
    """Where a letter stands before itself."""
    return (x[1:] == x[:-1]) & _letter(x[1:])


def _touched(x):
    """Which letters have a sign beside them; marks after words don't count."""
    import numpy as np

    letter, sign = _letter(x), _SIGN_TABLE[x]
    out = np.zeros(len(x), bool)
    out[1:] |= letter[1:] & sign[:-1]
    out[:-1] |= letter[:-1] & sign[1:] & (x[1:] != 33)
    return out


def set_apart(low: bytes) -> bool:
    """Whether three single characters in a row have only separators between them."""
    import numpy as np

    x = np.frombuffer(b" " + low + b" ", np.uint8)
    one = _ONE_TABLE[x]
    word = one | (x > 127)
    lone = np.flatnonzero(one[1:-1] & ~word[:-2] & ~word[2:]) + 1
    if len(lone) < 3:
        return False
    other = ~_SEPARATOR_TABLE[x]
    other[lone] = False
    others = np.cumsum(other)[lone]
    return bool((others[2:] == others[:-2]).any())


def suspicious(low: bytes) -> bool:
    """Whether any span could match SUSPECT; quicker than the pattern."""
    import numpy as np

    x = np.frombuffer(b" " + low + b" ", np.uint8)
    return bool(_same(x).any()) or bool(_touched(x).any()) or set_apart(low)


def _table(signs):
    import numpy as np

    table = np.zeros(256, bool)
    table[[ord(c) for c in signs]] = True
    return table


def _codes():
    import numpy as np

    table = np.zeros(256, np.int64)
    table[97:123] = np.arange(1, 27)
    return table


_SIGN_TABLE, _ONE_TABLE, _SEPARATOR_TABLE = _table([*SIGNS, *MASKS]), _table([*SIGNS, *map(chr, range(97, 123))]), _table(SEPARATORS)
_CODE_TABLE = _codes()


def char_model(docs: DataFrame) -> CharModel:
    """Trigram counts, and those of the most common words, VOCABULARY at most, over all `docs` (text): summed in each task, then
    across tasks."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        def rows(keys, n):
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(n, pa.int64())], ["key", "n"])

        table = np.zeros(256, np.int64)
        table[97:123] = np.arange(1, 27)
        table[65:91] = np.arange(1, 27)
        table[128:] = 27
        total, seen = np.zeros(ALPHABET**3, np.int64), Counter()
        for batch in batches:
            for text in text_bytes(batch.column("text")):
                x = table[np.frombuffer(b"  " + text + b"  ", np.uint8)]
                # Of a run of edges only the one before a word and the one after it count.
                first = np.where(x[1:-1] == 0, 0, x[:-2])
                use = (x[2:] > 0) | (x[1:-1] > 0)
                total += np.bincount(((first * ALPHABET + x[1:-1]) * ALPHABET + x[2:])[use], minlength=len(total))
                seen.update(words(text))
            if len(seen) > REMEMBERED:
                yield rows(*worth(seen))
                seen.clear()
        yield rows(*worth(seen))
        at = np.flatnonzero(total)
        yield rows([f"{k}" for k in at.tolist()], total[at])

    def worth(seen):
        kept = [(w, n) for w, n in seen.items() if len(w) <= LONGEST and w.isalpha()]
        return [w.decode() for w, _ in kept], [n for _, n in kept]

    import numpy as np

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(work, "key string, n long")
    rows = persisted(rows.groupBy("key").agg(F.sum("n").alias("n")), "toxicity_counts")
    # Words of about the same count are taken all or none; few numbers tell from which count on.
    size, word = F.floor(F.log("n") * 100), F.col("key") >= "a"
    taken, least = 0, math.inf
    for r in sorted(rows.filter(word).groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"]):
        taken += r["count"]
        if taken > VOCABULARY:
            break
        least = r["size"]
    counts, frequent = np.zeros(ALPHABET**3), {}
    # Trigrams, whose keys are numbers, and VOCABULARY words at most.
    for r in rows.filter(~word | (size >= least)).collect():
        if r.key.isdigit():
            counts[int(r.key)] = r.n
        else:
            frequent[r.key] = r.n
    return CharModel(counts, frequent)


def features(restored: bytes) -> set[bytes]:
    """Words, and beginnings of words marked with a star."""
    whole = {*words(restored)}
    out = set(whole)
    for k in BEGINNINGS:
        out.update([w[:k] + b"*" for w in whole if len(w) > k])
    return out


@dataclass
class ToxicityModel:
    letters: CharModel
    intercept: float = -3.0
    weights: dict[bytes, float] = field(default_factory=dict)

    def score(self, text: bytes) -> float:
        z = self.intercept
        if text and self.weights:
            z += sum(map(self.weights.__getitem__, features(self.letters.restored(text)) & self.weights.keys()))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def regression(rows: list[tuple[list[int], int]], n: int, rounds: int = 1500, ridge: float = 0.002) -> tuple[float, list[float]]:
    """Intercept and weights of a logistic regression on sets of features, by accelerated gradient descent with steps
    scaled to each feature's frequency."""
    import numpy as np

    owner = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    which = np.array([x for f, _ in rows for x in f], np.int64)
    label = np.array([y for _, y in rows], float)
    often = np.bincount(which, minlength=n).astype(float)
    w, last, b, last_b = np.zeros(n), np.zeros(n), math.log((label.sum() + 1) / (len(label) - label.sum() + 1)), 0.0
    last_b = b
    most = max(1.0, float(np.bincount(owner, minlength=len(rows)).max(initial=0)))
    for k in range(rounds):
        speed = k / (k + 3)
        v, c = w + speed * (w - last), b + speed * (b - last_b)
        z = c + np.bincount(owner, weights=v[which], minlength=len(rows))
        off = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - label
        slope = np.bincount(which, weights=off[owner], minlength=n) + ridge * v
        last, last_b = w, b
        w = np.maximum(0, v - 4 * slope / ((often + ridge) * (most + 1)))
        b = c - 4 * off.sum() / (len(rows) * (most + 1))
    return b, w.tolist()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FEATURES) -> ToxicityModel:
    """A model from `docs` (doc_id, text) and `labels` (doc_id, toxic), which hold the rows to learn from."""
    letters = char_model(docs)
    one = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` rows of two numbers.
    sent = docs.sparkSession.sparkContext.broadcast({r.doc_id: r.toxic for r in chosen.collect()})
    model = docs.sparkSession.sparkContext.broadcast(letters)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def labelled(batches):
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                label = sent.value.get(doc_id)
                if label is not None:
                    yield doc_id, label, features(model.value.restored((text.as_py() or "").encode()))

    def count(batches):
        import pyarrow as pa

        pos, neg, n = Counter(), Counter(), [0, 0]
        for _, label, found in labelled(batches):
            n[label] += 1
            (pos if label else neg).update(found)
        keys = [*(pos | neg)]
        arrays = [pa.array([*keys, b""], pa.binary()), pa.array([*(pos[k] for k in keys), n[1]], pa.int64()), pa.array([*(neg[k] for k in keys), n[0]], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["feature", "pos", "neg"])

    counts = rows.mapInArrow(count, "feature binary, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = counts.filter((F.col("pos") + F.col("neg") >= LEAST_DOCS) | (F.length("feature") == 0))
    total = counts.filter(F.length("feature") == 0).first()
    if not total or not total.pos or not total.neg:
        return ToxicityModel(letters)
    # Twice the log-likelihood ratio of a feature's label shares against those of all rows.
    rate, both = total.pos / (total.pos + total.neg), F.col("pos") + F.col("neg")
    part = lambda n, share: F.when(n > 0, n * F.log(n / (both * share))).otherwise(0.0)
    best = counts.filter(F.length("feature") > 0).withColumn("gain", 2 * (part(F.col("pos"), rate) + part(F.col("neg"), 1 - rate)))
    best = best.filter((F.col("pos") > rate * both) & (F.col("gain") >= LEAST_RATIO))
    names = [bytes(r.feature) for r in best.orderBy(F.desc("gain"), "feature").limit(most).collect()]
    known = docs.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(names)})

    def vectors(batches):
        import pyarrow as pa

        out = [(label, [known.value[f] for f in found & known.value.keys()]) for _, label, found in labelled(batches)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.list_(pa.int32()))], ["label", "found"])

    # At most `sample` rows of at most `most` small numbers.
    fitted = [(r.found, r.label) for r in rows.mapInArrow(vectors, "label int, found array<int>").collect()]
    if not names:
        return ToxicityModel(letters, math.log((total.pos + 1) / (total.neg + 1)))
    intercept, weights = regression(fitted, len(names))
    return ToxicityModel(letters, intercept, {f: w for f, w in zip(names, weights, strict=True) if w})


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """`docs` (text, ...) with score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.drop("score", "predicted").withColumn("text", F.col("text").cast("string"))
    names = plain.columns
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            scores = [sent.value.score(text) for text in text_bytes(batch.column("text"))]
            arrays = [*(batch.column(c) for c in names), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "score", "predicted"])

    return plain.mapInArrow(work, schema)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """`docs` with held_out, score and predicted; labels of held-out rows are not looked at."""
    model = fit(docs, labels.filter(~held_out))
    return score(docs.withColumn("held_out", held_out), model)
