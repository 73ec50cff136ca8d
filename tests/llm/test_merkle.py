"""Operator 13, against a tree built at once."""

import hashlib
from collections import defaultdict

import pytest
from lectern.llm.merkle import Range, digest, fold, manifest, proof, proven, tree
from pyspark.sql import functions as F

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r):
    return h("".join("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in COLS))


def grow(leaves):
    """Root, and each leaf's (left, right) by level."""
    levels, paths = [leaves], [[] for _ in leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        for k, path in enumerate(paths):
            at = k // 16 ** (len(levels) - 1)
            run = now[at // 16 * 16 : at // 16 * 16 + 16]
            path.append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
        levels.append([h("".join(now[i : i + 16])) for i in range(0, len(now), 16)])
    return levels[-1][0], paths


def whole(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    if not groups:
        return []
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [grow([x[2] for x in sorted(groups[s])]) for s in order]
    root, above = grow([t[0] for t in trees])
    out = []
    for s, (subroot, paths), up in zip(order, trees, above, strict=True):
        for x, path in zip(sorted(groups[s]), paths, strict=True):
            out.append((x[2], subroot, root, h("".join(a + b for a, b in path + up))))
    return sorted(out)


def checked(docs):
    rows = docs.select("doc_id", "source", digest(*COLS).alias("digest"))
    p = proven(manifest(rows, "source", "doc_id"))
    return p.select("digest", "subroot", "root", proof(F.col("path")).alias("proof"), fold(F.col("digest"), F.col("path")).alias("folded")).collect()


@pytest.mark.parametrize("table", ["small", "edges", "nothing"])
def test_manifest(request, spark, table):
    docs = request.getfixturevalue(table)
    docs = docs.unionByName(docs.limit(3).withColumn("source", F.lit(None).cast("string"))).unionByName(docs.limit(1).withColumns({"source": F.lit(""), "doc_id": F.lit(None).cast("long"), "lang": F.lit(None).cast("string")}))
    got = checked(docs)
    assert sorted((r.digest, r.subroot, r.root, r.proof) for r in got) == whole([r.asDict() for r in docs.collect()])
    assert all(r.folded == r.root for r in got)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4097])
def test_sizes(spark, n):
    """Trees of one group and of many; each leaf folds to the root and no changed leaf does."""
    docs = spark.range(n, numPartitions=7).selectExpr("id AS doc_id", f"CASE WHEN {n} < 300 THEN concat('s', id) ELSE 's' END AS source", "'x' AS lang", "id AS n_chars", "concat('T', id) AS text")
    got = checked(docs)
    assert sorted((r.digest, r.subroot, r.root, r.proof) for r in got) == whole([r.asDict() for r in docs.collect()])
    rows = docs.select("doc_id", "source", digest(*COLS).alias("digest"))
    p = proven(manifest(rows, "source", "doc_id"))
    assert not p.filter(fold(F.sha2(F.col("digest"), 256), F.col("path")) == F.col("root")).count()


@pytest.mark.parametrize("cut", [(0, 40), (3, 300), (15, 17), (16, 32), (5, 5 + 4096)])
def test_a_part_gives_completed_nodes_and_peaks(cut):
    """Nodes are those whose leaves are all in the part; peaks cover the part once."""
    values = [h(str(k)) for k in range(cut[1])]
    part = Range("g", 10**6)
    for k in range(*cut):
        part.push(k, values[k])
    out = part.close()
    want, level, nodes = set(), 0, values
    while nodes:
        level += 1
        nodes = [h("".join(nodes[i : i + 16])) for i in range(0, len(nodes) - 15, 16)]
        want |= {(level, k, v) for k, v in enumerate(nodes) if k * 16**level >= cut[0]}
    assert {x[2:5] for x in out if not x[5]} == want
    covered = sorted((k * 16**lev, (k + 1) * 16**lev) for _, _, lev, k, _, peak in out if peak)
    assert covered[0][0] == cut[0] and covered[-1][1] == cut[1] and all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))
    assert len(covered) <= 2 * 15 * 4


def test_parts_merge_to_one_tree(spark):
    """However leaves are parted."""
    n = 1500
    roots = set()
    for parts in (1, 4, 13):
        leaves = spark.range(n, numPartitions=parts).selectExpr("'g' AS grp", f"{n}L AS size", "id AS k", "sha2(cast(id as string), 256) AS digest")
        roots.add(tree(leaves).filter("level = 3").collect()[0].digest)
    assert roots == {grow([h(str(k)) for k in range(n)])[0]}
