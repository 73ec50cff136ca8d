"""Chat formatting at token level (operator 2).

A turn is `<|turn|>` role `<|body|>` text `<|end|>`. Role and text are encoded each by itself and the three marks are
spliced in as reserved ids, so no text can produce a mark's id. The same output also has a readable form, in which
control strings of this template and of others must not occur inside texts: a backslash goes after the first character
of each one found and backslashes are doubled, which undoes exactly. The loss mask comes from prefix sums over +1 and
-1 at the ends of the trained segments: the texts of assistant turns, without marks.

Turns of a conversation are sorted by turn, then role and text (nulls first), and streamed, so that a conversation of
any length needs the memory of one piece of output. Null text and null role count as empty; rows with a null conv_id
are one conversation; repeated rows are turns of their own. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: This template's marks, whose ids follow the vocabulary's.
MARKS = ("<|turn|>", "<|body|>", "<|end|>")
#: Control strings of other public templates, escaped as well.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
TRAINED_ROLE = "assistant"
PIECE_IDS = 1 << 16
PIECE_SCHEMA = "conv_id long, piece long, n_turns long, ids array<int>, loss_mask array<boolean>"
DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long, loss_ids long"

_STARTS = re.compile(r"\\|[<\[](?=" + "|".join(re.escape(s[1:]) for s in (*MARKS, *FOREIGN)) + ")")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """`text` without any control string in it."""
    return _STARTS.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class ChatCodec:
    """Encodes segments with a byte-level tokenizer file and reads ids back."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        from lectern.llm.tokenizing import BYTE_LETTERS

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self.turn, self.body, self.end = range(n := self._tokenizer.get_vocab_size(), n + 3)
        letters = {chr(BYTE_LETTERS.get(b, b)): b for b in range(256)}
        self._bytes = {i: bytes(letters[c] for c in token) for token, i in self._tokenizer.get_vocab().items() if all(c in letters for c in token)}

    def encode(self, text: str) -> list[int]:
        return self._tokenizer.encode(escape(text), add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        """The escaped text of a segment."""
        return b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8")

    def encode_turn(self, role: str, text: str) -> tuple[list[int], list[int]]:
        """Ids of a turn, and where its trained segment starts and ends (equal: none)."""
        head = [self.turn, *self.encode(role), self.body]
        ids = head + self.encode(text)
        span = [len(head), len(ids)] if role == TRAINED_ROLE else [0, 0]
        return [*ids, self.end], span


@functools.cache
def codec(path: str) -> ChatCodec:
    """One codec a worker process."""
    return ChatCodec(path)


def loss_mask(n: int, spans: list[tuple[int, int]]):
    """True inside the spans: prefix sums over +1 at each start and -1 at each end."""
    import numpy as np

    steps = np.zeros(n + 1, dtype=np.int32)
    for start, end in spans:
        steps[start] += 1
        steps[end] -= 1
    return np.cumsum(steps)[:n] > 0


def format_conversations(turns: DataFrame, tokenizer_path: str, piece_ids: int = PIECE_IDS) -> DataFrame:
    """Token form of `turns` (conv_id, turn, role, text): rows of whole turns, about `piece_ids` ids each, numbered by
    `piece` within a conversation and in that order within a partition, which holds whole conversations."""

    def encode(batches):
        import pyarrow as pa

        chat = codec(tokenizer_path)
        for batch in batches:
            done = [chat.encode_turn(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            arrays = [*batch.columns, pa.array([d[0] for d in done], pa.list_(pa.int32())), pa.array([d[1] for d in done], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "turn", "role", "text", "ids", "span"])

    def assemble(batches):
        import pyarrow as pa

        now, piece, ids, spans, n, rows = (), 0, [], [], 0, []

        def flush():
            nonlocal ids, spans, n, piece
            if n:
                rows.append({"conv_id": now, "piece": piece, "n_turns": n, "ids": ids, "loss_mask": loss_mask(len(ids), spans)})
                ids, spans, n, piece = [], [], 0, piece + 1

        for batch in batches:
            for conv, turn_ids, (start, end) in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "span")), strict=True):
                if conv != now:
                    flush()
                    now, piece = conv, 0
                elif len(ids) >= piece_ids:
                    flush()
                spans.append((len(ids) + start, len(ids) + end))
                ids += turn_ids
                n += 1
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        flush()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    import pyarrow as pa

    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("n_turns", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_()))])
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    encoded = rows.mapInArrow(encode, "conv_id long, turn long, role string, text string, ids array<int>, span array<int>")
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "ids", "span").mapInArrow(assemble, PIECE_SCHEMA)


def read_back(pieces: DataFrame, tokenizer_path: str) -> DataFrame:
    """A row per conversation of what its ids and mask say, from rows as format_conversations leaves them."""

    def read(batches):
        import numpy as np
        import pyarrow as pa

        chat = codec(tokenizer_path)
        now, row, out = (), None, []

        def close():
            if row:
                out.append({"conv_id": now, "n_turns": row["n"], "turns_sha256": row["turns"].hexdigest(), "loss_chars": row["chars"], "loss_sha256": row["loss"].hexdigest(), "formatted_chars": row["all"], "n_ids": row["ids"], "loss_ids": row["loss_ids"]})

        for batch in batches:
            for conv, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "loss_mask")), strict=True):
                if conv != now:
                    close()
                    now, row = conv, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0, "ids": 0, "loss_ids": 0}
                row["ids"] += len(ids)
                row["loss_ids"] += sum(mask)
                trained = np.flatnonzero(np.diff(np.array([False, *mask, False], dtype=np.int8))).tolist()
                for start, end in zip(trained[::2], trained[1::2], strict=True):
                    said = unescape(chat.decode(ids[start:end]))
                    row["chars"] += len(said)
                    row["loss"].update(said.encode("utf-8"))
                at = 0
                while at < len(ids):
                    body = ids.index(chat.body, at)
                    end = ids.index(chat.end, body)
                    role, text = chat.decode(ids[at + 1 : body]), chat.decode(ids[body + 1 : end])
                    row["all"] += len(role) + len(text) + sum(map(len, MARKS))
                    row["turns"].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                    row["n"] += 1
                    at = end + 1
            if out:
                yield pa.RecordBatch.from_pylist(out)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out)

    return pieces.mapInArrow(read, DIGEST_SCHEMA)
