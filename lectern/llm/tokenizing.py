"""Tokenizing whole texts inside Arrow batches.

`WordEncoder` serves tokenizers that drop white space and never join text across it: each run of non-space bytes
has its ids wherever it stands, so the ids of a text are those of its words in order. Words recur, so they are
looked up in a bounded table, and only new ones are encoded. Words of Latin-1 letters, with or without punctuation
after them, are the same after normalising but for their case, and need the tokenizer's model alone.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterable

#: Words remembered by one worker; the table is emptied when it is full, which changes speed only.
REMEMBERED_WORDS = 300_000
PUNCTUATION = b",.;:!?"
#: Letters A-Z of either case and those of Latin-1, as UTF-8.
LATIN = re.compile("(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+".encode("latin-1"))
#: A byte-level tokenizer writes the bytes that don't print as the letters from U+0100 on, in order.
UNPRINTED = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
BYTE_LETTERS = {byte: 0x100 + k for k, byte in enumerate(UNPRINTED)}
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder(dict):
    """Ids of words, packed, learned as they are met; `encode` gives those of texts.

    With `specials`, special tokens that a text holds literally get their own ids, as is the library's default.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS, specials: bool = False):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not specials
        self._tokenize = self._tokenizer.model.tokenize
        self._remembered = remembered
        if self._ids("a b, c") != [*self._ids("a"), *self._ids("b"), *self._ids(","), *self._ids("c")]:
            raise ValueError("this tokenizer joins text across spaces or doesn't drop them")
        self._tails = {PUNCTUATION[k : k + 1]: packed(self._ids(chr(PUNCTUATION[k]))) for k in range(len(PUNCTUATION))} | {b"": b""}

    def _ids(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self._remembered:
            self.clear()
        core = word.rstrip(PUNCTUATION)
        tail = self._tails.get(word[len(core) :])
        if tail and (core.isalpha() or LATIN.fullmatch(core)):
            ids = self[core] + tail
        elif word.isalpha():
            ids = packed([t.id for t in self._tokenize(word.lower().decode())])
        elif LATIN.fullmatch(word):
            ids = packed([t.id for t in self._tokenize(word.decode().lower().encode().decode("latin-1").translate(BYTE_LETTERS))])
        else:
            ids = packed(self._ids(word.decode()))
        self[word] = ids
        return ids

    def encode(self, texts: Iterable[bytes]) -> list[bytes]:
        """Packed ids of each text. Empty texts have none."""
        of = self.__getitem__
        return [b"".join(map(of, (text.lower() if text.isascii() and b"<|" not in text else text).split())) for text in texts]


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One encoder a worker process, which later tasks find filled."""
    return WordEncoder(path, specials=True)
