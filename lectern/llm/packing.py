"""Hierarchical multi-length packing (operator 1).

Documents are routed by their number of ids to the smallest context size (tier) that holds them whole; longer ones
first give off full windows of the largest tier. In each tier a window starts with one document, and its gap is filled
with the longest pieces of shorter tiers that fit whole; only what is then left is filled by cutting a piece. So every
window of a tier ends full. Windows that can't be filled yet return their pieces to the pool, and what is left at a
task's end becomes full windows of descending sizes, powers of two down to 1.

All of it is local to a task: a block of documents of a bounded number of ids is packed at a time, no row is shuffled,
and a document's group, source or copies play no part. Windows are dealt to step groups of about equal cost, where a
window's cost has a linear and a quadratic part, the heaviest window first to the lightest group.

Null texts count as empty and give their end id alone. Repeated rows and equal doc_ids are packed each by itself.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import text_bytes

TIERS = (512, 1024, 2048, 4096)
#: Sizes below the smallest tier that close a task: at most one small window of each, and nothing is padded.
CLOSING = (256, 128, 64, 32, 16, 8, 4, 2, 1)
BLOCK_IDS = 1 << 20
STEP_IDS = 64 * 4096
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"

# A piece is (length, order, doc, start); order keeps pieces of one length apart and in order.


def pack_block(lengths: list[int], pool: list[tuple], tiers=TIERS, last: bool = False, first_doc: int = 0) -> tuple[list[tuple[int, list[tuple]]], list[tuple]]:
    """Windows of (tier, pieces), and the pieces left for the next block. `lengths` are new documents', numbered from
    first_doc; `pool` has pieces left before."""
    top, windows, pool = tiers[-1], [], sorted(pool)
    for doc, n in enumerate(lengths, first_doc):
        start = 0
        while n - start >= top:
            windows.append((top, [(top, 0, doc, start)]))
            start += top
        if n > start:
            pool.append((n - start, 0, doc, start))
    pool.sort()

    def fill(pieces: list[tuple], gap: int) -> int:
        while gap and pool:
            k = bisect_right(pool, (gap, float("inf")))
            if k:
                piece = pool.pop(k - 1)
                pieces.append(piece)
                gap -= piece[0]
            else:
                n, order, doc, start = pool.pop(0)
                pieces.append((gap, order, doc, start))
                insort(pool, (n - gap, order, doc, start + gap))
                gap = 0
        return gap

    left: list[tuple] = []
    for tier, below in zip(tiers[::-1], [*tiers[-2::-1], 0], strict=True):
        while pool and pool[-1][0] > below:
            piece = pool.pop()
            pieces = [piece]
            if fill(pieces, tier - piece[0]):
                left += pieces
            else:
                windows.append((tier, pieces))
    if last:
        for size in (*tiers[::-1], *CLOSING):
            while sum(p[0] for p in left) >= size:
                pieces, room = [], size
                while room:
                    n, order, doc, start = left.pop()
                    pieces.append((min(n, room), order, doc, start))
                    if n > room:
                        left.append((n - room, order, doc, start + room))
                    room -= min(n, room)
                windows.append((size, pieces))
    return windows, left


def step_groups(sizes: list[int], step_ids: int = STEP_IDS, context: int = TIERS[-1]) -> list[int]:
    """A group number for each window, so that groups have about equal cost."""
    cost = [n + n * n / context for n in sizes]
    heap = [(0.0, g) for g in range(max(1, round(sum(sizes) / step_ids)))]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-cost[k], k)):
        total, g = heapq.heappop(heap)
        out[k] = g
        heapq.heappush(heap, (total + cost[k], g))
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, tiers=TIERS, block_ids: int = BLOCK_IDS, step_ids: int = STEP_IDS) -> DataFrame:
    """A row per piece of `docs` (doc_id, text; other columns are ignored)."""
    tiers = tuple(sorted(tiers))

    def pack(batches):
        import struct

        import pyarrow as pa

        from lectern.llm.tokenizing import encoder

        encode, end = encoder(tokenizer_path).encode, struct.pack("<I", end_id)
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        held: dict[int, tuple[int | None, bytes]] = {}
        fresh: list[int] = []
        state = {"docs": 0, "ids": 0, "sequence": 0, "group": 0, "left": []}

        def packed(last: bool):
            windows, state["left"] = pack_block(fresh, state["left"], tiers, last, state["docs"] - len(fresh))
            groups = step_groups([sum(p[0] for p in pieces) for _, pieces in windows], step_ids, tiers[-1])
            cols: list[list] = [[] for _ in range(9)]
            for (tier, pieces), group in zip(windows, groups, strict=True):
                offset = 0
                for n, _, doc, start in pieces:
                    doc_id, ids = held[doc]
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)])
                    for col, value in zip(cols, (doc_id, start, n, crc, len(ids) // 4, task + state["sequence"], offset, tier, task + state["group"] + group), strict=True):
                        col.append(value)
                    offset += n
                state["sequence"] += 1
            state["group"] += max(groups, default=-1) + 1
            state["ids"] = 0
            fresh.clear()
            kept = {p[2] for p in state["left"]}
            for doc in [d for d in held if d not in kept]:
                del held[doc]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True):
                ids = encode([text])[0] + end
                held[state["docs"]] = (doc_id, ids)
                state["docs"] += 1
                fresh.append(len(ids) // 4)
                state["ids"] += len(ids) // 4
                if state["ids"] >= block_ids:
                    yield packed(False)
        if fresh or state["left"]:
            yield packed(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, PIECE_SCHEMA)
