"""Near-duplicate documents by Order MinHash (operator 7).

A text is the sequence of its words (runs of letters and digits, lower-cased). Two texts of n1 and n2 words are near copies
if m / (n1 + n2 - m) >= SIMILARITY, m being their longest common subsequence of words, found by banded alignment: one
changed word costs one word, wherever it stands.

Candidates come from Order MinHash. A text's k-mers are its runs of SHINGLE words, later occurrences labelled by their
number. For each of BANDS hash functions the KEEP least labelled k-mers are taken and put back in text order; two texts are
candidates if any band's tuple is the same in both. So both content and order count, as edits do. A pair that shares 0.46
of its k-mers in order is a candidate with probability 0.992, one that shares 0.38, as texts of similarity 0.8 with
changes at random places do, with 0.94. Texts of at most SHORT words, of which one change spoils most runs of five, use
runs of SHORT_SHINGLE words and the SHORT_KEEP least; those within reach of the border have both sketches.

Texts with equal words are one node from the start, so groups of copies count once. In a bucket of candidates each node
is first compared with the one that shares most buckets with others, as an original does with its copies; links merge
nodes to classes. What is left are buckets with members in different classes, mostly texts around a common passage. Their
members are joined by prefix: near copies share at least (n1 + n2) / 3 - 1 pairs of neighbouring words, so with pairs
ordered by rarity among those members, the first third of the shorter text's and the first two fifths of the longer one's
must have one in common. A common passage's pairs are the most frequent and come last, so texts meet by what is their own.
Texts of which a common passage is so much that it reaches into that part are joined by their rarest words in the same way,
of which the first ninth and the first fifth do; so they meet by their own words unless they are hardly more than a passage.
A common key must leave enough words behind it in both texts, which parts those that are.

Before texts are fetched, counts of words by hash value bound m from above. All these bounds are exact, so no candidate is
lost and no bucket is cut off; pairs inside a class need no comparison.

Null, empty and wordless texts are like nothing and have a class of their own. Rows of equal doc_id are one document: their
texts share a class, and each is compared. A null doc_id gets a null class. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import persisted, text_bytes
from lectern.llm.components import components
from lectern.llm.words import labelled, mix, shingles, words

SHINGLE, BANDS, KEEP = 5, 48, 3
SHORT, SHORT_SHINGLE, SHORT_KEEP = 40, 2, 2
SIMILARITY = (4, 5)
#: Bins of words' counts: about half as many as words, between these.
LEAST_BINS, MOST_BINS = 16, 4096
#: Pairs of words that more open texts have don't make texts meet by themselves.
COMMON = 32
#: Common keys that every task is told.
RANKED = 1 << 16
#: Numbers held at once while one text is sketched.
SKETCH_CELLS = 1 << 16


def enough(n1: int, n2: int) -> int:
    """The least number of matches m with m / (n1 + n2 - m) >= SIMILARITY."""
    p, q = SIMILARITY
    return -(-p * (n1 + n2) // (p + q))


def sketch(keys, keep: int = KEEP, first: int = 0, bands: int = BANDS):
    """A number for each band: the tuple of its `keep` least labelled k-mers in text order. Bands count from `first`."""
    import numpy as np

    marked = labelled(keys)
    factors = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    keep = min(keep, len(marked))
    total = np.arange(first, first + bands, dtype=np.uint64)
    together = max(1, SKETCH_CELLS // max(1, len(marked)))
    for k in range(0, bands, together):
        ranks = marked[None, :] * factors[k : k + together, None]
        rows, found = np.arange(len(ranks)), []
        for _ in range(keep):
            found.append(ranks.argmin(axis=1))
            ranks[rows, found[-1]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        for column in marked[np.sort(np.stack(found), axis=0)]:
            total[k : k + together] = mix(total[k : k + together] + column)
    return total


def sketched(found: list[bytes]):
    """All bands of a text's words."""
    import numpy as np

    p, q = SIMILARITY
    parts = []
    if len(found) > SHORT:
        parts.append(sketch(shingles(found, SHINGLE)))
    if p * len(found) <= q * SHORT:
        parts.append(sketch(shingles(found, SHORT_SHINGLE), SHORT_KEEP, BANDS))
    return np.concatenate(parts)


def profile(keys) -> bytes:
    """Counts of words by hash value, in one byte each if they fit, in two otherwise; none where a count is larger."""
    import numpy as np

    bins = bins_for(len(keys))
    counts = np.bincount((keys & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    most = counts.max()
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint16).tobytes() if most < 1 << 16 else b""


def bins_for(n: int) -> int:
    return min(MOST_BINS, max(LEAST_BINS, 1 << (max(1, n // 2) - 1).bit_length()))


def may_match(n1: int, one: bytes, n2: int, two: bytes) -> bool:
    """Whether texts of these numbers of words and profiles can have enough words in common."""
    import numpy as np

    need = enough(n1, n2)
    if need > min(n1, n2):
        return False
    if not one or not two:
        return True
    x, y = (np.frombuffer(p, np.uint8 if len(p) == bins_for(n) else np.uint16) for n, p in ((n1, one), (n2, two)))
    if len(x) != len(y):
        bins = min(len(x), len(y))
        x, y = (v.reshape(-1, bins).sum(axis=0, dtype=np.int64) for v in (x, y))
    return int(np.minimum(x, y).sum(dtype=np.int64)) >= need


def common_in_band(a, b, need: int) -> int:
    """Length of the longest common subsequence of a and b inside the band that `need` matches cannot leave.

    Rows are elements of b; the set bits of a number stand for the columns of a at which the row's count doesn't grow,
    shifted along with the band. So are those of each element's places, which enter the band one by one."""
    n, m = len(a), len(b)
    left, right = m - need, n - need  # unmatched elements that either side can have
    if left < 0 or right < 0:
        return 0
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    masks = dict.fromkeys(places, (0, 0, 0))  # set bits, the column of bit 0, places that have entered
    width = left + right + 1
    full = (1 << width) - 1
    low, row, done = -left, full, 0  # column `low` is bit 0
    for j, y in enumerate(b):
        if j:
            done += 1 - (row & 1) if low >= 0 else 0
            row = (row >> 1) | (1 << (width - 1))
            low += 1
        if y in places:
            here, at, entered = masks[y]
            here = here >> (low - at) if low >= at else here << (at - low)
            of = places[y]
            while entered < len(of) and of[entered] < low + width:
                if of[entered] >= low:
                    here |= 1 << (of[entered] - low)
                entered += 1
            masks[y] = here, low, entered
            if here:
                hit = row & here
                row = ((row + hit) | (row & ~here)) & full
    return done + width - row.bit_count()


def alike(a, b) -> bool:
    """Whether two arrays of words match well enough."""
    import numpy as np

    n1, n2 = len(a), len(b)
    if not n1 or not n2:
        return False
    need, short = enough(n1, n2), min(n1, n2)
    if need > short:
        return False
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[n1 - short + head :][::-1] != b[n2 - short + head :][::-1])
    tail = int(differ[0]) if len(differ) else short - head
    need -= head + tail
    if need <= 0:
        return True
    x, y = a[head : n1 - tail].tolist(), b[head : n2 - tail].tolist()
    if len({*x} & {*y}) == 0:
        return False
    return common_in_band(x, y, need) >= need


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, n, profile, sig) per row of docs with words; h1 and h2 identify the words, n counts them."""
    schema = "doc_id long, h1 long, h2 long, n int, profile binary, sig array<long>"

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            ids, h1, h2, ns, profiles, sigs = [], [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True):
                found = words(text)
                if found:
                    whole = xxhash.xxh3_128_intdigest(b" ".join(found))
                    ids.append(doc_id)
                    h1.append((whole >> 64) - (1 << 63))
                    h2.append((whole & ((1 << 64) - 1)) - (1 << 63))
                    ns.append(len(found))
                    profiles.append(profile(shingles(found, 1)))
                    sigs.append(sketched(found).view(np.int64))
            ends = np.cumsum([0, *map(len, sigs)])
            flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sigs) if sigs else [], pa.int64()))
            arrays = [pa.array(ids, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(ns, pa.int32()), pa.array(profiles, pa.binary()), flat]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "h1", "h2", "n", "profile", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def _chosen(batch, keep):
    """The pairs (a, b) of a batch for which `keep` is true."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])


def possible(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The pairs (a, b) that profiles (node, n, profile) don't rule out."""
    side = lambda x: profiles.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("profile").alias(f"p_{x}"))

    def work(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("n_a", "p_a", "n_b", "p_b"))
            yield _chosen(batch, [may_match(*row) for row in zip(*columns, strict=True)])

    joined = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    return joined.select("a", "n_a", "p_a", "b", "n_b", "p_b").mapInArrow(work, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) match. Pairs without a text on either side don't; repeated pairs come out
    as often as they came in."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))

    def work(batches):
        held: dict[bytes, object] = {}

        def of(text):
            if text not in held:
                if len(held) >= 64:
                    held.clear()
                held[text] = shingles(words(text), 1)
            return held[text]

        for batch in batches:
            both = zip(text_bytes(batch.column("text_a")), text_bytes(batch.column("text_b")), strict=True)
            yield _chosen(batch, [alike(of(x), of(y)) for x, y in both])

    joined = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    return joined.select("a", "text_a", "b", "text_b").mapInArrow(work, "a long, b long")


def of_nodes(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts (node, text) of the nodes in `ids` (node)."""
    return texts.join(ids.select("node").distinct(), "node", "left_semi")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def tallied(texts: DataFrame, words_together: int) -> DataFrame:
    """(key, often, lo, hi) of labelled runs of so many words in each batch of texts (root, text): how many texts have one,
    and the least and the largest root of those."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            each = [labelled(shingles(words(text), words_together)).view(np.int64) for text in text_bytes(batch.column("text"))]
            root = np.repeat(batch.column("root").to_numpy(zero_copy_only=False).astype(np.int64), [len(k) for k in each])
            keys, at, often = np.unique(np.concatenate([*each, np.empty(0, np.int64)]), return_inverse=True, return_counts=True)
            lo, hi = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
            np.minimum.at(lo, at, root)
            np.maximum.at(hi, at, root)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (keys, often, lo, hi))], ["key", "often", "lo", "hi"])

    return texts.select("root", "text").mapInArrow(work, "key long, often long, lo long, hi long")


def runs_of(texts: DataFrame, words_together: int, without: dict[int, int]) -> DataFrame:
    """(node, root, said, n, key, keys) for each labelled run of so many words of texts (node, root, text), but for those in
    `without`, and once for each text with a null key: n counts words, keys runs, and `said` tells texts of a node apart."""
    import numpy as np

    sent = texts.sparkSession.sparkContext.broadcast(np.array(sorted(without), np.int64))

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for node, root, text in zip(batch.column("node").to_pylist(), batch.column("root").to_pylist(), text_bytes(batch.column("text")), strict=True):
                found = words(text)
                keys = labelled(shingles(found, words_together)).view(np.int64)
                left = keys[~np.isin(keys, sent.value)]
                same = lambda x, n=len(left) + 1: pa.array(np.full(n, x, np.int64))
                yield pa.RecordBatch.from_arrays([same(node), same(root), same(xxhash.xxh32_intdigest(text)), same(len(found)), pa.array([*left.tolist(), None], pa.int64()), same(len(keys))], ["node", "root", "said", "n", "key", "keys"])

    return texts.mapInArrow(work, "node long, root long, said long, n long, key long, keys long")


def prefixes(given: DataFrame, words_together: int, shorter: str, longer: str, least: str) -> tuple[DataFrame, DataFrame, DataFrame, dict[int, int]]:
    """The rarest keys, which are runs of so many words, of each text of `given` (node, root, text), so many as two matching
    texts need to have one in common: (key, node, root, n, left, first) of those that at most COMMON texts have; the texts
    (node, root, said, n, keys, cold) whose part reaches into the common ones; the keys (node, said, key) that are not
    common; and counts of the RANKED most common ones.

    The longer one of two texts needs `longer`; `first` tells whether a key is among the `shorter` of the shorter one, and
    `left` counts it and those after it. Keys that no other class has come first, then rare ones; `cold` counts both. A text
    with fewer than `least` keys that other classes have matches nothing. Common keys leave before texts are sorted, most of
    them before they are exploded."""
    counts = tallied(given, words_together).groupBy("key").agg(F.sum("often").alias("often"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi")
    counts = persisted(counts.select("key", "often"), "shared")
    common = persisted(counts.filter(F.col("often") > COMMON), "common")
    # At most RANKED rows of two numbers, which only save rows and put keys in order.
    ranks = {r.key: r.often for r in common.orderBy(F.desc("often"), "key").limit(RANKED).collect()}
    rows = persisted(runs_of(given, words_together, ranks), "runs")
    plain = rows.filter("key IS NOT NULL").join(common.select("key"), "key", "left_anti")
    cold = plain.join(counts.filter(F.col("often") <= COMMON), "key", "left")
    one = Window.partitionBy("node", "said")
    cold = cold.withColumn("unshared", F.count(F.when(F.col("often").isNull(), 1)).over(one)).withColumn("cold", F.count(F.lit(1)).over(one))
    nth = F.col("unshared") + F.row_number().over(one.orderBy(F.col("often").asc_nulls_last(), "key"))
    cold = persisted(cold.withColumn("nth", nth).filter(f"nth <= {longer} AND keys - unshared >= {least} OR nth = unshared + 1").select("key", "often", "node", "root", "said", "n", "keys", "unshared", "cold", "nth"), "cold")
    texts = rows.filter("key IS NULL").select("node", "root", "said", "n", "keys").distinct()
    known = cold.filter("nth = unshared + 1").select("node", "said", "cold", "unshared")
    whole = texts.join(known, ["node", "said"], "left").fillna(0, ["cold", "unshared"])
    crowd = persisted(whole.filter(f"cold < {longer} AND keys - unshared >= {least}").select("node", "root", "said", "n", "keys", "cold"), "crowd")
    fine = cold.filter(f"often IS NOT NULL AND nth <= {longer} AND keys - unshared >= {least}")
    return _placed(fine, shorter), crowd, plain.select("node", "said", "key"), ranks


def _placed(rows: DataFrame, shorter: str) -> DataFrame:
    return rows.select("key", "node", "root", "n", F.expr("keys - nth + 1 AS left"), F.expr(f"nth <= {shorter}").alias("first"))


def spared(texts: DataFrame, often: dict[int, int]) -> DataFrame:
    """(key, node, root, n, left, first) as of prefixes(), of words of texts (node, root, text, said) that are not among
    `cold`, of which there are fewer than the prefix holds. Words in `often`, the most common ones, come last, by their
    counts; any order does that is the same in all texts."""
    import numpy as np

    known = np.array(sorted(often), np.int64)
    sent = texts.sparkSession.sparkContext.broadcast((known, np.array([often[k] for k in known.tolist()], np.int64)))

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        p, q = SIMILARITY
        names = ("node", "root", "said", "cold")
        for batch in batches:
            for node, root, said, cold, text in zip(*(batch.column(c).to_pylist() for c in names), text_bytes(batch.column("text")), strict=True):
                if xxhash.xxh32_intdigest(text) != said:
                    continue
                found, cold = words(text), cold or []
                n, keys = len(found), labelled(shingles(found, 1)).view(np.int64)
                known, counts = sent.value
                at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
                count = np.where(known[at] == keys, counts[at], 0) if len(known) else np.zeros(n, np.int64)
                order = np.lexsort((keys, count))
                order = order[~np.isin(keys[order], np.array(cold, np.int64))]
                longer, shorter = n + 1 + (-p * n // q), n + 1 + (-2 * p * n // (p + q))
                nth = np.arange(len(cold) + 1, longer + 1)[: len(order)]
                same = lambda x, k=len(nth): pa.array(np.full(k, x, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys[order[: len(nth)]]), same(node), same(root), same(n), pa.array(n - nth + 1), pa.array(nth <= shorter)], ["key", "node", "root", "n", "left", "first"])

    return texts.mapInArrow(work, "key long, node long, root long, n long, left long, first boolean")


def meeting(prefix: DataFrame, together: str) -> DataFrame:
    """Pairs (a, b) of different classes and near lengths with a key in common after which either has enough keys left, if
    matching texts x and y share so many keys as `together` says. The first key that they share is one such."""
    p, q = SIMILARITY
    x, y = prefix.filter("first").alias("x"), prefix.alias("y")
    near = F.expr(f"(x.n < y.n OR x.n = y.n AND x.node < y.node) AND {p} * y.n <= {q} * x.n AND x.root <> y.root AND least(x.left, y.left) >= {together}")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & near)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def remaining_pairs(members: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes in buckets (band, node) of several classes that differ in class and may still match.

    With m = p (n1 + n2) / (p + q) common words, n1 <= n2 and p n2 <= q n1, the prefixes follow from the numbers of words,
    m, and of pairs of neighbours, 3 m - n1 - n2 - 1, that both must share."""
    placed = members.select("band", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = persisted(placed, "placed")
    mixed = persisted(placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("band"), "mixed")
    ids = persisted(placed.join(mixed, "band").select("node", "root").distinct(), "open")
    own = persisted(of_nodes(texts, ids).join(ids, "node"), "open_texts")
    p, q = SIMILARITY
    prefix, crowd, _, _ = prefixes(own, 2, f"n - ceil({2 * (2 * p - q)} * n / {p + q}) + 1", f"n - ceil({2 * p - q} * n / {q}) + 1", f"ceil({2 * p - q} * n / {q}) - 1")
    met = meeting(prefix, f"{2 * p - q} * (x.n + y.n) / {p + q} - 1")
    # Texts that are common passages for the most part meet by their rarest words, and by common ones if few are left.
    crowded = persisted(of_nodes(own, crowd), "crowded")
    shorter, longer, together = f"n - ceil({2 * p} * n / {p + q}) + 1", f"n - ceil({p} * n / {q}) + 1", f"{p} * (x.n + y.n) / {p + q}"
    rare, plain, cold, ranks = prefixes(crowded, 1, shorter, longer, f"ceil({p} * n / {q})")
    cold = cold.join(plain, ["node", "said"], "left_semi").groupBy("node", "said").agg(F.collect_list("key").alias("cold"))
    spare = crowded.join(plain.select("node", "said").join(cold, ["node", "said"], "left"), "node")
    last = persisted(spared(spare.select("node", "root", "text", "said", "cold"), ranks), "last")
    return met.union(meeting(rare, together)).union(meeting(last, together)).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for every row of `docs` (doc_id, text, ...); class_id is the least doc_id of its class."""
    rows = persisted(sketches(docs), "sketches")
    known = rows.filter("doc_id IS NOT NULL")
    # Stored, the least ids reach the join unordered: then Spark can split a text that very many documents have.
    copies = persisted(known.groupBy("h1", "h2").agg(F.min("doc_id").alias("node")), "copies")
    # A text's node is its least doc_id. One doc_id with several texts stands for all of them.
    placed = persisted(known.join(copies, ["h1", "h2"]), "placed")
    firsts = placed.filter("doc_id = node").dropDuplicates(["h1", "h2"])
    same = placed.filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
    bands = firsts.select("node", "n", F.explode("sig").alias("band"))
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = persisted(bands.join(persisted(sizes, "buckets"), "band"), "members")

    # All later steps read these texts and profiles alone, so all documents' texts are shuffled once, at any size in the
    # same way.
    inside = members.select("node").distinct()
    profiles = persisted(firsts.select("node", "n", "profile").join(inside, "node", "left_semi"), "profiles")
    every = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    texts = persisted(of_nodes(every.hint("merge"), members).distinct(), "candidates")
    busy = members.groupBy("node").agg(F.sum("size").alias("meets"))
    ranked = persisted(members.join(busy, "node"), "busy")
    chief = ranked.groupBy("band").agg(F.max(F.struct("meets", (-F.col("node")).alias("m"), "n")).alias("chief"))
    p, q = SIMILARITY
    near = q * F.least("n", "chief.n") >= p * F.greatest("n", "chief.n")
    other = (-F.col("chief.m")).alias("other")
    asked = ranked.join(persisted(chief, "chiefs"), "band").filter(near).select("node", other).filter("node <> other")
    asked = persisted(asked.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "pairs")
    able = persisted(possible(asked, profiles), "possible")
    links = persisted(verified(able, of_nodes(texts, ends_of(able))), "links")
    roots = persisted(components(links), "roots")

    rest = persisted(remaining_pairs(members, roots, texts).join(asked, ["a", "b"], "left_anti"), "pairs")
    able = persisted(possible(rest, profiles), "possible")
    more = persisted(verified(able, of_nodes(texts, ends_of(able))), "links")
    classes = persisted(components(links.union(more).union(same)), "classes")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each class: that of the least doc_id, in one row. Of rows that share this doc_id the one
    of the least text stays (a null one last), then that of the least hash of its columns. Rows with a null doc_id stay."""
    firsts = near_duplicates(docs).filter("doc_id = class_id").select("doc_id").distinct()
    named = docs.filter("doc_id IS NOT NULL").join(firsts, "doc_id", "left_semi").select(docs.columns)
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind]
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), F.xxhash64(*hashed))
    named = named.withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").drop("__nth")
    return named.union(docs.filter("doc_id IS NULL"))
