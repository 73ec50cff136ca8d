"""Repeated substrings by merging shards' suffix orders (operator 10).

A byte goes if some LENGTH-byte string that covers it also starts earlier: in a document of smaller doc_id, or earlier in
its own. Strings are judged on the input, over whole texts as UTF-8, and never cross documents.

Suffixes are sampled so that nothing is lost: the anchor of a string is its least GRAM-byte substring by hash, the
leftmost of equals. Equal strings have equal anchors at equal places, so only suffixes around one anchor have to be
merged, and the strings with one anchor are consecutive: a run of starts. About one byte in 39 is an anchor.

1. Every task is a shard. It orders its runs by anchor and by the bytes they span; of equal runs only the first can stay.
2. Shards' runs meet by anchor, in that order. Again all but the first of equal runs go whole, and anchors that occur with
   one run only are done. After this a run that thousands of documents share is one row.
3. For runs that share an anchor but not all bytes, the bytes are fetched, and the suffixes at all their starts are merged
   by iterative interleave refinement, as Burrows-Wheeler transforms of shards are: suffixes of one anchor and place start
   as one block, each round splits blocks by the next eight bytes, keeping shard order inside, and a suffix alone in its
   block is done. The round at which suffixes part is their common prefix; blocks still whole after LENGTH bytes are the
   repeated intervals, of which all but the first suffix start a string that goes. Suffixes outside these blocks are never
   sorted. Anchors with more than BLOCK such runs, which would be a large group, send their suffixes' hashes to a count
   with partial sums instead.

Null texts are empty. Rows with equal doc_id and text are one document and fare alike; rows with equal doc_id and other
text are ordered by a hash of it; a null doc_id comes before all others. Other columns pass through; those named n_bytes,
n_removed, n_spans are replaced. Texts that are cut inside a character are decoded with replacement marks; the digest is
of the bytes.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import persisted, text_bytes
from lectern.llm.words import mix

LENGTH, GRAM = 100, 24
SPAN = LENGTH - GRAM + 1
#: Bytes looked at together, and runs a task orders at once.
CHUNK, SORTED = 1 << 20, 1 << 20
BLOCK = 20_000
#: Suffixes merged together.
MERGED = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1


def gram_hashes(x, size: int = GRAM):
    """A hash of the `size` bytes at each place of the array x, by doubling; size is 8 times a number below 4."""
    import numpy as np

    powers = {1: x.astype(np.uint64) + np.uint64(1)}
    width = 1
    factor = BASE
    while width * 2 <= size:
        h = powers[width]
        powers[width * 2] = h[:-width] * np.uint64(factor) + h[width:]
        factor = factor * factor % (1 << 64)
        width *= 2
    out, done = powers[width], width
    for step in sorted((w for w in powers if w < width), reverse=True):
        if done + step <= size:
            n = len(x) - done - step + 1
            out = out[:n] * np.uint64(pow(BASE, step, 1 << 64)) + powers[step][done : done + n]
            done += step
    return mix(out)


def least_places(h, span: int = SPAN):
    """For each place, where the least of the next `span` values of h is, the leftmost of equals."""
    import numpy as np

    ranked = (h & np.uint64(~((1 << 24) - 1) & 0xFFFFFFFFFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    width, low = 1, ranked
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    n = len(h) - span + 1
    low = np.minimum(low[:n], low[span - width : span - width + n])
    return (low & np.uint64((1 << 24) - 1)).astype(np.int64)


def runs_of(text: bytes):
    """Anchor hashes, hashes of spanned bytes, anchor places, first and last starts of the runs of one text."""
    import numpy as np

    parts = []
    for at in range(0, max(0, len(text) - LENGTH + 1), CHUNK):
        x = np.frombuffer(text, np.uint8, offset=at)[: CHUNK + LENGTH - 1]
        if len(x) < LENGTH:
            break
        h = gram_hashes(x)
        place = least_places(h)
        begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([begin[1:], [len(place)]]) - 1
        anchor = place[begin]
        # Hashes of [first, last + LENGTH): two grams' hashes chains would overlap, so sums of powers are used.
        y = x.astype(np.uint64) + np.uint64(1)
        up = _powers(len(x))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(y * up[0][: len(x)])])
        spanned = (sums[last + LENGTH] - sums[begin]) * up[1][begin]
        spanned = mix(mix(spanned + np.uint64(1)) + ((anchor - begin) * 1024 + (last - anchor + 512)).astype(np.uint64))
        parts.append((h[anchor], spanned, anchor + at, begin + at, last + at))
    if not parts:
        return None
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


_POWERS: list = []


def _powers(n: int):
    """Powers of the base, and of its inverse, modulo 2**64."""
    import numpy as np

    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        base, inverse = np.full(size, np.uint64(BASE)), np.full(size, np.uint64(pow(BASE, -1, 1 << 64)))
        base[0] = inverse[0] = 1
        _POWERS[:] = [np.multiply.accumulate(base), np.multiply.accumulate(inverse)]
    return _POWERS


# A run is packed in one number: the anchor's place, the distance from the first start to it, the number of starts less one.
def pack(anchor, first, last):
    return (anchor << 14) | ((anchor - first) << 7) | (last - first)


def unpack(run):
    """Anchor's place, first and last start."""
    anchor = run >> 14
    first = anchor - ((run >> 7) & 127)
    return anchor, first, first + (run & 127)


def merged_spans(starts, ends):
    """Maximal runs of the intervals [start, end)."""
    import numpy as np

    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    at = np.flatnonzero(new)
    return starts[at], ends[np.concatenate([at[1:], [len(ends)]]) - 1] if len(at) else ends


#: Rows between steps: runs to go on with have an anchor, spans of bytes to remove have start and size.
STEP_SCHEMA = "anchor long, spanned long, doc long, run long, start long, size long"


def shard_runs(texts: DataFrame) -> DataFrame:
    """Runs of `texts` (doc, text), of equal ones in a task's share only the first; and spans that go already."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        def ordered(held):
            doc, anchor, spanned, run, first, last = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((run, doc, spanned, anchor))
            doc, anchor, spanned, run, first, last = (c[order] for c in (doc, anchor, spanned, run, first, last))
            again = np.concatenate([[False], (anchor[1:] == anchor[:-1]) & (spanned[1:] == spanned[:-1])])
            yield _rows(anchor=anchor[~again], spanned=spanned[~again], doc=doc[~again], run=run[~again])
            if again.any():
                doc, first, last = doc[again], first[again], last[again]
                order = np.lexsort((first, doc))
                doc, first, last = doc[order], first[order], last[order]
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (first[1:] > last[:-1] + 1)])
                at = np.flatnonzero(new)
                ends = last[np.concatenate([at[1:], [len(doc)]]) - 1] + LENGTH
                yield _rows(doc=doc[at], start=first[at], size=ends - first[at])

        held, n = [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), text_bytes(batch.column("text")), strict=True):
                got = runs_of(text)
                if got is not None:
                    anchor, spanned, place, first, last = got
                    held.append((np.full(len(place), doc), anchor.view(np.int64), spanned.view(np.int64), pack(place, first, last), first, last))
                    n += len(place)
                    if n >= SORTED:
                        yield from ordered(held)
                        held, n = [], 0
        if held:
            yield from ordered(held)
        yield pa.RecordBatch.from_pylist([], schema=_arrow_schema())

    return texts.mapInArrow(work, STEP_SCHEMA)


def _arrow_schema():
    import pyarrow as pa

    return pa.schema([(name, pa.int64()) for name in ("anchor", "spanned", "doc", "run", "start", "size")])


def _rows(**columns):
    import pyarrow as pa

    n = len(columns["doc"])
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name]) if f.name in columns else pa.nulls(n, pa.int64()) for f in _arrow_schema()], schema=_arrow_schema())


def meet(runs: DataFrame) -> DataFrame:
    """Merges shards' runs: spans of all but the first of equal runs, and first runs whose anchor has several."""

    def work(batches):
        import numpy as np

        last_anchor = last_spanned = None
        waiting = None  # the only first run so far of the anchor read last: doc, run
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, spanned, doc, run = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "spanned", "doc", "run"))
            same = np.concatenate([[anchor[0] == last_anchor], anchor[1:] == anchor[:-1]])
            again = same & np.concatenate([[spanned[0] == last_spanned], spanned[1:] == spanned[:-1]])
            if again.any():
                _, first, last = unpack(run[again])
                yield _rows(doc=doc[again], start=first, size=last - first + LENGTH)
            lead = np.flatnonzero(~again)
            if len(lead):
                leads = anchor[lead]
                open_before = leads == last_anchor
                alike = np.concatenate([[False], leads[1:] == leads[:-1]])
                alike[:-1] |= alike[1:].copy()
                use = alike | open_before
                if waiting is not None and open_before.any():
                    yield _rows(anchor=np.array([last_anchor]), doc=np.array([waiting[0]]), run=np.array([waiting[1]]))
                if use.any():
                    k = lead[use]
                    yield _rows(anchor=anchor[k], doc=doc[k], run=run[k])
                waiting = None if use[-1] else (doc[lead[-1]], run[lead[-1]])
            last_anchor, last_spanned = anchor[-1], spanned[-1]

    placed = runs.filter("anchor IS NOT NULL").repartition("anchor").sortWithinPartitions("anchor", "spanned", "doc", "run")
    return placed.mapInArrow(work, STEP_SCHEMA)


def fetched(runs: DataFrame, texts: DataFrame) -> DataFrame:
    """(anchor, doc, run, bytes): the bytes that each run spans."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for doc, text, wanted in zip(batch.column("doc").to_pylist(), text_bytes(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
                spans = [unpack(w["run"])[1:] for w in wanted]
                arrays = [pa.array([w["anchor"] for w in wanted], pa.int64()), pa.array([doc] * len(wanted), pa.int64()), pa.array([w["run"] for w in wanted], pa.int64()), pa.array([text[a : b + LENGTH] for a, b in spans], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["anchor", "doc", "run", "bytes"])

    wanted = runs.groupBy("doc").agg(F.collect_list(F.struct("anchor", "run")).alias("wanted"))
    return texts.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(work, "anchor long, doc long, run long, bytes binary")


def interleave(group, flat, begin, first_gap, count):
    """For suffixes in shard order: whether an equal one of the same block comes before.

    `group`, `begin`, `first_gap` and `count` are of runs: their anchor's number, where their bytes begin in `flat`, the
    distance from the first start to the anchor, and the number of starts. Returns the runs and starts that go."""
    import numpy as np

    run = np.repeat(np.arange(len(group)), count)
    k = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    gap = first_gap[run] - k  # from the suffix to its anchor: part of what makes a block
    at = begin[run] + k
    block = group[run] * 128 + gap
    order = np.argsort(block, kind="stable")
    run, k, at, block = run[order], k[order], at[order], block[order]
    eight = np.lib.stride_tricks.as_strided(flat, (len(flat) - 7, 8), (1, 1))
    for depth in (-1, *range(0, LENGTH - 8, 8), LENGTH - 8):
        if depth >= 0:
            symbol = np.ascontiguousarray(eight[at + depth]).view(np.uint64).ravel()
            inside = np.argsort(symbol, kind="stable")
            order = inside[np.argsort(block[inside], kind="stable")]
            run, k, at, block, symbol = run[order], k[order], at[order], block[order], symbol[order]
            new = np.concatenate([[True], (block[1:] != block[:-1]) | (symbol[1:] != symbol[:-1])])
        else:
            new = np.concatenate([[True], block[1:] != block[:-1]])
        block = np.cumsum(new) - 1
        alone = new & np.concatenate([new[1:], [True]])
        run, k, at, block = run[~alone], k[~alone], at[~alone], block[~alone]
        if not len(run):
            break
    later = np.concatenate([[False], block[1:] == block[:-1]]) if len(run) else np.zeros(0, bool)
    return run[later], k[later]


def merge(rows: DataFrame) -> DataFrame:
    """Spans to remove of runs (anchor, doc, run, bytes), by merging the suffixes of each anchor."""

    def work(batches):
        import numpy as np

        held, n, suffixes = [], 0, 0

        def spans(rows):
            anchor = np.array([r[0] for r in rows], np.int64)
            doc, run = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
            group = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]]))
            sizes = np.array([len(r[3]) for r in rows])
            place, first, last = unpack(run)
            which, k = interleave(group, np.frombuffer(b"".join(r[3] for r in rows), np.uint8), np.cumsum(sizes) - sizes, place - first, last - first + 1)
            if not len(which):
                return None
            order = np.lexsort((k, which))
            which, k = which[order], k[order]
            new = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (k[1:] != k[:-1] + 1)]))
            ends = k[np.concatenate([new[1:], [len(k)]]) - 1]
            return _rows(doc=doc[which[new]], start=first[which[new]] + k[new], size=ends - k[new] + LENGTH)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "run", "bytes")), strict=True):
                if suffixes >= MERGED and row[0] != held[-1][0]:
                    if (found := spans(held)) is not None:
                        yield found
                    held, suffixes = [], 0
                held.append(row)
                suffixes += (row[2] & 127) + 1
        if held and (found := spans(held)) is not None:
            yield found

    placed = rows.repartition("anchor").sortWithinPartitions("anchor", "doc", "run")
    return placed.mapInArrow(work, STEP_SCHEMA).select("doc", "start", "size")


def counted(rows: DataFrame) -> DataFrame:
    """The same for anchors with very many runs: by hashes of the suffixes' LENGTH bytes, summed before the shuffle."""

    def work(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            out = [[], [], [], []]
            for doc, run, data in zip(*(batch.column(c).to_pylist() for c in ("doc", "run", "bytes")), strict=True):
                _, first, last = unpack(run)
                for k in range(last - first + 1):
                    whole = xxhash.xxh3_128_intdigest(data[k : k + LENGTH])
                    for col, value in zip(out, ((whole >> 64) - (1 << 63), (whole & ((1 << 64) - 1)) - (1 << 63), doc, first + k), strict=True):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["h1", "h2", "doc", "start"])

    suffixes = persisted(rows.mapInArrow(work, "h1 long, h2 long, doc long, start long"), "suffixes")
    firsts = persisted(suffixes.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "firsts")
    later = suffixes.join(firsts, ["h1", "h2"]).filter("doc <> f.doc OR start <> f.start")
    return later.select("doc", "start", F.lit(LENGTH).cast("long").alias("size"))


def ordered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`docs` with doc, a number that orders documents: doc_id, unless some are null or repeat; and (doc, text) once."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").limit(1)
    if odd.isEmpty():
        return docs.withColumn("doc", F.col("doc_id")), docs.select(F.col("doc_id").alias("doc"), "text")
    hashed = docs.withColumn("__h", F.xxhash64(F.coalesce("text", F.lit(""))))
    keys = hashed.select(F.col("doc_id").alias("__id"), F.col("__h").alias("__k")).distinct().sort(F.col("__id").asc_nulls_first(), "__k")
    keys = persisted(keys.withColumn("doc", F.monotonically_increasing_id()), "order")
    placed = hashed.join(keys, hashed["doc_id"].eqNullSafe(keys["__id"]) & (F.col("__h") == F.col("__k"))).drop("__h", "__id", "__k")
    return placed, placed.select("doc", "text").dropDuplicates(["doc"])


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc, start, size) of bytes to remove from documents (doc, text)."""
    texts = docs.select("doc", F.col("text").cast("binary").alias("text"))
    shards = persisted(shard_runs(texts), "shards")
    met = persisted(meet(shards), "met")
    gone = shards.filter("start IS NOT NULL").union(met.filter("start IS NOT NULL")).select("doc", "start", "size")
    runs = met.filter("anchor IS NOT NULL").select("anchor", "doc", "run")
    crowded = persisted(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select("anchor"), "crowded")
    if crowded.isEmpty():
        return gone.union(merge(fetched(runs, texts)))
    whole = persisted(fetched(runs, texts), "fetched")
    return gone.union(merge(whole.join(crowded, "anchor", "left_anti"))).union(counted(whole.join(crowded, "anchor", "left_semi")))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, ...) without repeated strings, with n_bytes, n_removed, n_spans and kept_sha256."""
    placed, once = ordered(docs.drop("doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
    return _cut(placed, removed_spans(once))


def _cut(placed: DataFrame, spans: DataFrame) -> DataFrame:
    gone = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("__gone"))
    joined = placed.join(gone, "doc", "left").drop("doc")
    names = [c for c in joined.columns if c != "__gone"]
    added = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType()}
    schema = T.StructType([*(f for f in joined.schema.fields if f.name != "__gone"), *(T.StructField(n, k) for n, k in added.items())])

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = [[], [], [], [], []]
            gone = batch.column("__gone")
            for row, text in enumerate(text_bytes(batch.column("text"))):
                cut = gone[row].values
                if cut is None or not len(cut):
                    kept, n, spans = text, 0, 0
                else:
                    begin = cut.field("start").to_numpy(zero_copy_only=False)
                    starts, ends = merged_spans(begin, begin + cut.field("size").to_numpy(zero_copy_only=False))
                    n, spans = int((ends - starts).sum()), len(starts)
                    kept = b"".join(text[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(text)], strict=True))
                for col, value in zip(out, (kept.decode("utf-8", "replace"), len(text), n, spans, hashlib.sha256(kept).hexdigest()), strict=True):
                    col.append(value)
            new = dict(zip(("text", *added), (pa.array(c, k) for c, k in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)), strict=True))
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in (*names, *added)], [*names, *added])

    return joined.mapInArrow(work, schema)
