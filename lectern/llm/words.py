"""Words of a text as bytes: runs of ASCII letters and digits, lower-cased, and of anything not ASCII."""

from __future__ import annotations

import functools

_UPPER = bytes(range(0x41, 0x5B))
_BETWEEN = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes.maketrans(_UPPER + _BETWEEN, _UPPER.lower() + b" " * len(_BETWEEN))
#: Words whose hashes one worker remembers; the table is emptied when full, which changes speed only.
REMEMBERED = 400_000


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def word_count(text: bytes) -> int:
    """How many words a text has, by where they begin."""
    import numpy as np

    inside = np.frombuffer(b" " + text.translate(_TABLE), np.uint8) != 32
    return int(np.count_nonzero(inside[1:] > inside[:-1]))


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


@functools.cache
def word_hashes() -> WordHashes:
    return WordHashes()


def mix(x):
    """A bijective scrambling of 64-bit numbers (splitmix64's finaliser)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text_words: list[bytes], size: int):
    """Hashes of runs of `size` words; of all words as one run if there are fewer, of none if there are none."""
    import numpy as np

    n = len(text_words)
    if not n:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(word_hashes().__getitem__, text_words), np.uint64, n)
    size = min(size, n)
    out = one[: n - size + 1].copy()
    for k in range(1, size):
        out = mix(out) + one[k : n - size + 1 + k]
    return mix(out)


def labelled(keys):
    """`keys` with the number of earlier equal ones mixed in."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    if fresh.all():
        return keys
    at = np.arange(len(keys))
    seen = np.empty(len(keys), np.uint64)
    seen[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return np.where(seen > 0, mix(keys + seen * np.uint64(0x9E3779B97F4A7C15)), keys)
