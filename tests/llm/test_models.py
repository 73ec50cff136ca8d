"""Operators 4 and 5: exact values where there are any, held-out accuracy elsewhere."""

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from lectern.llm import language_model as lm
from lectern.llm import toxicity as tox
from lectern.llm.common import crc_of_id, table
from lectern.llm.queries import op4_language_model, op5_toxicity

SMALL = "/root/testdata/sf0.01"


def tiny_model(states=3, symbols=5):
    rng = np.random.default_rng(1)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return lm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


def paths(model, text):
    for path in itertools.product(range(len(model.start)), repeat=len(text)):
        p = model.start[path[0]] * model.emit[text[0], path[0]]
        for t in range(1, len(text)):
            p *= model.move[path[t - 1], path[t]] * model.emit[text[t], path[t]]
        yield path, p


def test_forward_is_the_sum_over_paths():
    model = tiny_model()
    texts = [np.array(x, np.uint16) for x in ([0], [1, 4, 2], [3, 3, 0, 1, 2, 4], [2, 2])]
    want = [math.log(sum(p for _, p in paths(model, t))) for t in texts]
    assert np.allclose(lm.likelihoods(model, texts), want)


def test_expected_counts_are_posterior_sums():
    model = tiny_model()
    texts = [np.array(x, np.uint16) for x in ([0], [1, 4, 2], [3, 3, 0, 1])]
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for t in texts:
        whole = sum(p for _, p in paths(model, t))
        for path, p in paths(model, t):
            start[path[0]] += p / whole
            for k, s in enumerate(path):
                emit[t[k], s] += p / whole
                if k:
                    move[path[k - 1], s] += p / whole
    for got, want in zip(lm.expected(model, texts), (start, move, emit), strict=True):
        assert np.allclose(got, want, atol=1e-4)


def check_scores(docs, rows):
    split = lambda t: [*(t or "").encode().lower().split(), b" "]
    counts = Counter(w for d, t in docs if zlib.crc32(str(d).encode()) % 7 != 2 for w in split(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((d, zlib.crc32(str(d).encode()) % 7 == 2, len(split(t)), sum(w in counts for w in split(t)), n) for d, t in docs)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in rows) == want
    base = sorted((d, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in split(t))) for d, t in docs)
    assert np.allclose([b for _, b in base], [b for _, b in sorted((r.doc_id, r.base_score) for r in rows)])
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)


def test_language_model(spark):
    rows = op4_language_model(spark, SMALL).collect()
    check_scores([(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()], rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_edges(edges, nothing):
    docs = edges.withColumn("row", edges.lang).withColumn("rare", edges.lang)
    rows = lm.score(docs, crc_of_id("doc_id") % 7 == 2, rounds=1).collect()
    check_scores([(r.doc_id, r.text) for r in edges.collect()], rows)
    assert lm.score(nothing, crc_of_id("doc_id") % 7 == 2, rounds=1).count() == 0


def test_model_is_a_distribution(spark):
    """Symbols' probabilities given any history, and words' in a class with one unseen word, sum to one."""
    docs = spark.createDataFrame([(1, "a b c a"), (2, "b b dd")], "doc_id long, text string")
    counts = lm.summarise(lm.count_words(docs), 2)
    model = lm.train(lm.encoded(docs.selectExpr("doc_id", "false AS held_out", "text"), counts), counts, rounds=2)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)


def test_toxicity_on_held_out_rows(spark):
    rows = op5_toxicity(spark, SMALL).join(table(spark, SMALL, "labels"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


@pytest.fixture(scope="module")
def letters(spark):
    return tox.char_model(table(spark, SMALL, "documents"))


@pytest.mark.parametrize("word", ["moron", "idiot", "scum", "loser", "clown", "trash"])
def test_disguises_are_undone(letters, word):
    forms = [" ".join(word), "-".join(word), word[:2] + word[2] * 4 + word[3:], word.replace("a", "4").replace("o", "0"), word.replace("s", "$")]
    for form in forms:
        assert letters.restored(f"the {form.upper()} of".encode()) == f"the {word} of".encode()


@pytest.mark.parametrize("word", ["moron", "idiot", "scum", "loser", "clown", "trash"])
def test_wide_disguises_are_undone(letters, word):
    spaced, doubled = " ".join(word), "".join(c * 2 for c in word)
    signs = word.replace("i", "1").replace("o", "0").replace("s", "$")
    forms = ["  ".join(word), "--".join(word), doubled, signs, " ".join(signs), signs + "!!"]
    for form in forms:
        assert letters.restored(f"the {form} of".encode()).replace(b"!", b"") == f"the {word} of".encode(), form
    for one in ("a", "t h a t"):
        assert letters.restored(f"the {one} {spaced} of".encode()) == f"the {one.replace(' ', '')} {word} of".encode()


@pytest.mark.parametrize("unit", ["1", "!", "|", "a1", "a ", "a.-", "a", "abc1", "-", "x" + "-" * 40])
def test_long_runs_take_linear_time(letters, unit):
    began = time.time()
    out = letters.restored((unit * 400_000)[:400_000].encode() + b" and he said so")
    assert out.endswith(b" and he said so") and time.time() - began < 10


def test_parts_of_long_spans_are_the_span():
    rng = random.Random(6)
    for _ in range(50):
        span = "".join(rng.choices("ab1 -_", [5, 5, 1, rng.choice([0, 2]), 1, 1], k=rng.randint(1, 5000))).encode()
        parts = tox._parts(span)
        assert b"".join(parts) == span and all(0 < len(p) <= tox.PART for p in parts)


def test_signs_at_the_ends(spark):
    """Words of which the corpus has the plain form."""
    docs = spark.createDataFrame([("you are a moron, an ass and an idiot of no worth, a diot, a shit, as it is and as he was",)] * 50, "text string")
    letters = tox.char_model(docs)
    for form, word in (("idi07", "idiot"), ("a$$", "ass"), ("5h17", "shit"), ("d107", "diot"), ("1 d i o t", "idiot"), ("1d10t", "idiot"), ("4ss", "ass")):
        assert letters.restored(f"you {form} of".encode()) == f"you {word} of".encode(), form
    assert letters.restored(b"y o u a r e a m o r o n") == b"you are a moron"
    assert letters.restored(b"1 2 3 4 and worth! 17") == b"1 2 3 4 and worth! 17"


@pytest.mark.parametrize("word", ["moron", "idiot", "clown", "trash"])
def test_masked_letters_are_restored(letters, word):
    """Other words may fit a mask too; then the likeliest of those that do."""
    fits = lambda form: [w for w in letters.frequent if re.fullmatch(form.replace("*", "(.)").replace("#", "(.)"), w)]
    for at in range(1, len(word) - 1):
        for mask in "*#":
            form = word[:at] + mask + word[at + 1 :]
            got = letters.restored(f"you {form} of".encode()).decode().split()[1]
            assert got == max(fits(form), key=letters.frequent.get), form
    form = word[0] + "**" + word[3:]
    assert letters.restored(form.encode()).decode() == max(fits(form), key=letters.frequent.get)
    for sign in "/,":
        assert letters.restored(f"you {sign.join(word)} of".encode()) == f"you {word} of".encode()


def test_look_alikes(letters):
    for form in ("mоron", "мoron", "MОRОN", "mοron"):
        want = "мoron" if form[0] == "м" else "moron"
        assert letters.restored(f"you {form} of".encode()).decode() == f"you {want} of"
    assert letters.restored("x\u0440 漢字a der Öl".encode()).decode() == "xp 漢字a der Öl"
    assert letters.restored("он сказал, о Москве".encode()) == "он сказал, о Москве".encode()


def likeliest(model, span):
    """The score and texts of the best of all paths through a span's lattice, each scored by its whole words."""
    plain = span.isalpha()
    parts = [m[0] for m in re.finditer(r"[ .\-_*/,#]+|(.)\1*", span)]
    apart = [r for r in parts if r[0] in " .-_*/,#"]
    usual = max(apart, key=lambda r: (apart.count(r), -apart.index(r))) if apart else ""
    steps = [(k, r, c) for k, r in enumerate(parts) for c in ([r] if r in apart else r)]
    begins = {w[:k] for w in model.frequent for k in range(len(w) + 1)}

    def worth(word):
        x = [0, 0, *map(tox.code, word), 0]
        return max(sum(model.log[a][b][c] for a, b, c in zip(x, x[1:], x[2:])) + tox.UNKNOWN, model.frequent.get(word, -math.inf)) if word else 0.0

    def paths(at, word, dropped, out, cost):
        if at == len(steps):
            yield cost + worth(word), out
            return
        k, run, c = steps[at]
        if run in apart:
            yield from paths(at + 1, word, dropped, out, cost + tox.JOINED)
            yield from paths(at + 1, "", dropped, out + " ", cost + worth(word) + (tox.PARTED if run == usual else tox.PARTED_OTHERWISE))
            if len(run) <= 2 and set(run) <= {"*", "#"} and 0 < k < len(parts) - 1:
                for new in itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=len(run)):
                    if word + "".join(new) in begins:
                        yield from paths(at + 1, word + "".join(new), dropped, out + "".join(new), cost + tox.MASKED * len(run))
            return
        for letter in tox.SIGNS.get(c, c):
            yield from paths(at + 1, word + letter, dropped, out + letter, cost + (0.0 if plain else tox.KEPT if letter == c else tox.STOOD_FOR))
            if word[-1:] == letter and len(run) > (letter != c) + 1:
                why = tox.DROPPED_REPEAT if plain or len(run) > 2 else tox.DROPPED_PAIR
                yield from paths(at + 1, word, plain, out, cost + why + (tox.DISGUISED if plain and not dropped else 0.0))
        if c in tox.SIGNS:
            yield from paths(at + 1, "", dropped, out + c, cost + worth(word) + (tox.ENDED_BY_MARK if c == "!" else tox.ENDED_BY_SIGN if word else tox.MORE_SIGNS))

    every = list(paths(0, "", False, "", 0.0))
    most = max(p for p, _ in every)
    return most, {out for p, out in every if p > most - 1e-9}


def test_decoding_takes_the_best_of_all_paths(spark):
    docs = spark.createDataFrame([("you are a moron, an ass and an idiot of no worth, a diot, a shoot, as it is and as he was",)] * 50, "text string")
    letters = tox.char_model(docs)
    rng = random.Random(12)
    for _ in range(1500):
        kind = rng.choice(["aos", "aaosst0$1", "aisd1!|", "as o-*#", "mor*o#n0", "idot1*"])
        span = "".join(rng.choices(kind, k=rng.randint(1, 8)))
        total, out = letters.decode(span)
        most, best = likeliest(letters, span)
        assert abs(total - most) < 1e-9 and out in best, span


def test_plain_text_stays(letters):
    for text in ("a plain text, with 1234 and 12:30! all good... pass", "Zu wenig Ä Öl 漢字", "", "!!! ???"):
        assert letters.restored(text.encode()) == text.encode().lower()


def test_suspicion_covers_the_pattern(letters):
    import random

    random.seed(3)
    for _ in range(5000):
        text = "".join(random.choices("ab1$!* .-", k=random.randint(0, 14))).encode()
        assert tox.suspicious(text) or not tox.SUSPECT.search(text)


def test_toxicity_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 13)] + [(5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    docs = edges.withColumn("score", edges.lang)
    rows = tox.toxicity(docs, labels, crc_of_id("doc_id") % 5 == 0).collect()
    assert len(rows) == edges.count() and all(0 < r.score < 1 for r in rows)
    assert tox.toxicity(nothing, labels, crc_of_id("doc_id") % 5 == 0).count() == 0
    assert tox.toxicity(docs, labels.limit(0), crc_of_id("doc_id") % 5 == 0).count() == len(rows)
