"""Merkle dataset manifest (operator 13): a hash tree over a table's rows, by group, and one over the groups' roots.

Rows of a group, numbered in order, are leaves; every FANOUT consecutive nodes of a level make one node of the next, the
last run with what is left, until one node remains. A task reads leaves in order and keeps a mountain range: an open run for
each level, which carries into the level above as it fills. It emits the nodes that it completes, and as peaks those of
runs that began before its part or end after it. Peaks are some tens for each part; they are merged level by level, run by
run, in Spark. A short last run is hashed as it is, without padding.

What proves a leaf is found from the root down: each node's siblings at its level, left and right of it, then its parent's.
Rows of one run share what is above it.

A null group is one of its own, before all others; rows of equal order stand by their digests; repeated rows are leaves
each. Null values are written '-', so they differ from empty ones. A group of one row has that leaf as its root, and no rows
have no root and no result. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.checksum_sql import CRC_TABLE, crc32_sql
from lectern.llm.common import persisted
from lectern.llm.numbering import number

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that numbers of 64 bits can need.
MOST_LEVELS = 16
EMITTED = "grp string, size long, level int, k long, digest string, peak boolean"
_STEP = "array<struct<left:string,right:string>>"


def digest(*columns: str | Column) -> Column:
    """Of a row's values, each with its length before it."""
    values = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def depth(size: Column) -> Column:
    """Levels above the leaves of a tree of `size` leaves."""
    return reduce(lambda a, b: a + b, [F.when(size > FANOUT**k, 1).otherwise(0) for k in range(MOST_LEVELS - 1)])


class Range:
    """The open runs of a stretch of consecutive nodes, a list for each level."""

    def __init__(self, group: str | None, size: int):
        self.group, self.size, self.next = group, size, 0
        self.runs: list[list[str]] = []
        self.begun: list[int | None] = []
        self.out: list[tuple] = []

    def push(self, k: int, value: str, level: int = 0) -> None:
        import hashlib

        while True:
            if level == len(self.runs):
                self.runs.append([])
                self.begun.append(None)
            run = self.runs[level]
            if not run:
                self.begun[level] = k
            run.append(value)
            if k % FANOUT < FANOUT - 1:
                return
            if self.begun[level] % FANOUT:
                self._give(level)  # its first nodes are in an earlier part
                return
            value = hashlib.sha256("".join(run).encode()).hexdigest()
            run.clear()
            k //= FANOUT
            level += 1
            self.out.append((self.group, self.size, level, k, value, False))

    def _give(self, level: int) -> None:
        at = self.begun[level]
        self.out += [(self.group, self.size, level, at + i, v, True) for i, v in enumerate(self.runs[level])]
        self.runs[level].clear()

    def close(self) -> list[tuple]:
        for level in range(len(self.runs)):
            self._give(level)
        return self.out


def climb(leaves: DataFrame) -> DataFrame:
    """EMITTED rows of leaves (grp, size, k, digest), which stand in order in each part: completed nodes, and peaks."""

    def work(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in EMITTED.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        now = Range(None, 0)
        for batch in batches:
            out = []
            for group, size, k, value in zip(*(batch.column(c).to_pylist() for c in ("grp", "size", "k", "digest")), strict=True):
                if group != now.group or k != now.next:
                    out += now.close()
                    now = Range(group, size)
                now.push(k, value)
                now.next = k + 1
            out += now.out
            now.out = []
            if out:
                yield batch_of(out)
        if out := now.close():
            yield batch_of(out)

    return leaves.select("grp", "size", "k", "digest").mapInArrow(work, EMITTED)


def runs_of(nodes: DataFrame) -> DataFrame:
    """(grp, size, level, k, run): of nodes (grp, size, level, k, digest, ...) those of one run, in order; level and k are
    their parent's."""
    rest = [c for c in nodes.columns if c not in ("grp", "size", "level", "k")]
    parent = nodes.groupBy("grp", "size", (F.col("level") + 1).alias("level"), F.floor(F.col("k") / FANOUT).cast("long").alias("parent"))
    return parent.agg(F.array_sort(F.collect_list(F.struct("k", *rest))).alias("run")).withColumnRenamed("parent", "k")


def tree(leaves: DataFrame) -> DataFrame:
    """All nodes above leaves (grp, size, k, digest), stored: (grp, size, level, k, digest)."""
    climbed = persisted(climb(leaves), "climbed")
    names = ("grp", "size", "level", "k", "digest")
    top = leaves.agg(F.max(depth(F.col("size")))).first()[0] or 0
    done, made = [climbed.filter("NOT peak").select(*names)], None
    for level in range(top):
        here = climbed.filter(f"peak AND level = {level}").select(*names)
        here = (here if made is None else here.unionByName(made)).filter(F.col("size") > FANOUT**level)
        made = runs_of(here).select("grp", "size", "level", "k", F.sha2(F.array_join(F.transform("run", lambda x: x["digest"]), ""), 256).alias("digest"))
        done.append(made)
    return persisted(reduce(DataFrame.unionByName, done), "tree_nodes")


def roots(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(grp, size, digest) of each group."""
    alone = leaves.filter("size = 1").select("grp", "size", "digest")
    return nodes.filter(F.col("level") == depth(F.col("size"))).select("grp", "size", "digest").unionByName(alone)


def sides(run: Column, at: Column) -> Column:
    """What stands left and right of a node in its run."""
    text = lambda part: F.array_join(F.transform(part, lambda x: x["digest"]), "")
    return F.struct(text(F.slice(run, 1, at)).alias("left"), text(F.slice(run, at + 2, FANOUT)).alias("right"))


def paths(leaves: DataFrame, nodes: DataFrame, begun: DataFrame) -> DataFrame:
    """`leaves` (grp, size, k, digest, ...) with path, their siblings from their own level up, and the further columns of
    `begun` (grp, path, ...), whose path goes on from the group's root. Goes down level by level from the roots."""
    extra = [c for c in begun.columns if c not in ("grp", "path")]
    carried = [c for c in leaves.columns if c not in ("grp", "size", "k", "digest")]
    sizes = leaves.filter("k = 0").select("grp", "size", depth(F.col("size")).alias("top"))
    start = persisted(begun.join(sizes, "grp"), "begun")
    top = start.agg(F.max("top")).first()[0] or 0
    now = None
    for level in range(top, 0, -1):
        here = start.filter(F.col("top") == level).select("grp", F.lit(0).cast("long").alias("k"), "path", *extra)
        here = here if now is None else here.unionByName(now)
        below = nodes.filter(F.col("level") == level - 1) if level > 1 else leaves.withColumn("level", F.lit(0))
        each = here.join(runs_of(below).drop("level"), ["grp", "k"]).select("grp", "size", "path", *extra, "run", F.posexplode("run").alias("at", "node"))
        path = F.concat(F.array(sides(F.col("run"), F.col("at"))), F.col("path")).alias("path")
        more = ["size", F.col("node.digest").alias("digest"), *[F.col("node")[c].alias(c) for c in carried]] if level == 1 else []
        now = each.select("grp", F.col("node.k").alias("k"), path, *more, *extra)
    alone = start.filter("top = 0").drop("top", "size").join(leaves.filter("size = 1"), "grp").select("grp", "k", "path", "size", "digest", *carried, *extra)
    return alone if now is None else now.unionByName(alone)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda now, step: F.sha2(F.concat(step["left"], now, step["right"]), 256))


def proof(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


@dataclass
class Manifest:
    #: (grp, size, k, digest, ...) and (grp, size, level, k, digest) of all groups' trees.
    leaves: DataFrame
    nodes: DataFrame
    #: (grp, size, digest): the groups' roots as leaves (grp, size, k, digest, of) of the tree over them, its nodes, its root.
    subroots: DataFrame
    top: DataFrame
    root: DataFrame


def manifest(rows: DataFrame, group: str, order: str) -> Manifest:
    """Of `rows` (group, order, digest, ...)."""
    # A key that isn't null and is ordered as the groups are, null first.
    marked = rows.withColumn("grp", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")))
    leaves = persisted(number(persisted(marked, "digests"), ["grp"], [order, "digest"], "k", "size").repartitionByRange("grp", "k").sortWithinPartitions("grp", "k"), "leaves")
    nodes = tree(leaves)
    under = roots(leaves, nodes).select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest")
    subroots = persisted(number(under, ["grp"], ["of"], "k", "size").repartitionByRange("k").sortWithinPartitions("k"), "subroots")
    top = tree(subroots)
    return Manifest(leaves, nodes, subroots, top, roots(subroots, top))


def proven(m: Manifest) -> DataFrame:
    """The leaves with their path to the root, subroot and root."""
    start = m.root.select("grp", F.array().cast(_STEP).alias("path"), F.col("digest").alias("root"))
    groups = paths(m.subroots, m.top, start).select(F.col("of").alias("grp"), "path", F.col("digest").alias("subroot"), "root")
    return paths(m.leaves, m.nodes, groups)


def _sql_levels(name: str, leaves: str, most: int) -> tuple[str, str]:
    """Tables name0 .. name<most> (g, k, h, n): a level's nodes, n of a tree, made while more than one remain; and the roots."""
    out = [f"{name}0 AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {leaves})"]
    for level in range(1, most + 1):
        out.append(
            f"{name}{level} AS (SELECT g, k // 16 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h, count(*) OVER (PARTITION BY g) AS n FROM {name}{level - 1} WHERE n > 1 GROUP BY g, k // 16)"
        )
    every = " UNION ALL ".join(f"SELECT g, h, n FROM {name}{level}" for level in range(most + 1))
    return ", ".join(out), f"(SELECT g, h FROM ({every}) WHERE n = 1)"


def _sql_walk(start: str, name: str, most: int, key: str) -> list[str]:
    """Tables that carry (key, g, k, h2, proof, n) up the levels of a tree."""
    out, now = [], start
    for level in range(most):
        side = lambda op: f"coalesce((SELECT string_agg(s.h, '' ORDER BY s.k) FROM {name}{level} s WHERE s.g = w.g AND s.k // 16 = w.k // 16 AND s.k {op} w.k), '')"  # noqa: E731, B023
        out.append(
            f"{name}w{level} AS (SELECT {key}, g, CASE WHEN n > 1 THEN k // 16 ELSE k END AS k, CASE WHEN n > 1 THEN sha256(l || h2 || r) ELSE h2 END AS h2, proof || l || r AS proof, coalesce(m, 1) AS n FROM ("
            f"SELECT w.{key}, w.g, w.k, w.h2, w.proof, w.n, CASE WHEN w.n > 1 THEN {side('<')} ELSE '' END AS l, CASE WHEN w.n > 1 THEN {side('>')} ELSE '' END AS r,"
            f" (SELECT any_value(u.n) FROM {name}{level + 1} u WHERE u.g = w.g) AS m FROM {now} w))"
        )
        now = f"{name}w{level}"
    return out


def _oracle(levels: int = 6, top_levels: int = 3) -> str:
    """Levels bound the SQL alone: 16^6 rows of a source, 16^3 sources."""
    value = lambda v: f"coalesce(strlen({v}) || ':' || {v}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(value(v) for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    trees, sub = _sql_levels("a", "(SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id, h) - 1 AS k, h, doc_id, h2 FROM d)", levels)
    tops, root = _sql_levels("b", "ub", top_levels)
    first = "start AS (SELECT doc_id, g, k, h2, '' AS proof, n FROM a0)"
    lower = _sql_walk("start", "a", levels, "doc_id")
    second = f"start2 AS (SELECT w.doc_id, '' AS g, u.k, w.h2, w.proof, (SELECT count(*) FROM ub) AS n FROM aw{levels - 1} w JOIN ub u ON u.of = w.g)"
    upper = _sql_walk("start2", "b", top_levels, "doc_id")
    return f"""
WITH RECURSIVE {CRC_TABLE}, d AS (
  SELECT doc_id, coalesce('=' || source, '-') AS g, {leaf("text")} AS h,
         CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf(low)} ELSE {leaf("text")} END AS h2
  FROM documents, crc_table
), {trees}, ua AS ({sub}), ub AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS k, h, g AS of FROM ua), {tops}, r AS ({root}),
{first}, {", ".join(lower)}, {second}, {", ".join(upper)}
SELECT d.doc_id, d.h AS leaf, ua.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.h2 AS folded_root, w.h2 = r.h AS verified
FROM d JOIN ua ON ua.g = d.g JOIN bw{top_levels - 1} w ON w.doc_id = d.doc_id, r
"""


ORACLE_SQL = _oracle()
