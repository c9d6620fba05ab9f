"""Merkle manifest of a dataset, with a witness for every row, by streaming aligned appends.

A row's leaf is the digest of its fields. Per tree (a source) the leaves are appended in order
of their key. A node that is appended takes the siblings before it as its partial witness, and
each later sibling that completes extends the witnesses of those before; a run of ARITY nodes
that is full becomes its digest and is appended one level higher. Runs are aligned, so a
source is cut in blocks of ARITY**LEVELS leaves that tasks append on their own; the roots of
blocks are then treated as further appends, block by block in rounds, until a tree has one
node, its subroot; and the subroots, in order of source, are appended to the root's tree in the
same way. On the way back each block hands its own witness to its nodes, which they append to
theirs. A tree may hold any share of the rows: no task has more than a block of them, and only
leaves' digests are sorted and dealt out, never texts.

Digests are lowercase hexadecimal SHA-256 texts. Fields that are null are ``-`` in a leaf,
others the count of their UTF-8 bytes, ``:`` and the value. Null keys come first in a tree, the
null source first in the root's tree; rows of one key are in order of their leaves, so equal
rows change places without any change in digests, each with the witness of its own place.
Other columns are not read. An empty table gives an empty manifest.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Staging, staged

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, LEVELS = 16, 3


def leaf(*values: Column) -> Column:
    """The leaf of a row with these fields."""
    as_text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in as_text]), 256)


def proof(witness: str = "witness") -> Column:
    """Digest of all siblings of a witness, level by level, left to right."""
    return F.sha2(F.array_join(witness, ""), 256)


def folded(start: Column, witness: str = "witness") -> Column:
    """The root to which a leaf leads with a witness: what stands left and right of the node, for each level."""
    w = F.col(witness)
    levels = F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: (i % 2 == 0) & (i < F.size(w)))
    return F.aggregate(levels, start, lambda h, i: F.sha2(F.concat(F.get(w, i), h, F.get(w, i + 1)), 256))


class Appends:
    """A tree that grows by appends: per level the open run, and what stands left and right of every node so far."""

    def __init__(self) -> None:
        self.runs: list[list[str]] = [[]]
        self.witness: list[list[tuple[list[str], list[str]]]] = [[]]

    def append(self, digest: str, level: int = 0) -> None:
        if level == len(self.runs):
            self.runs.append([])
            self.witness.append([])
        run, held = self.runs[level], self.witness[level]
        for _, right in held[len(held) - len(run) :]:
            right.append(digest)
        held.append((list(run), []))
        run.append(digest)
        if len(run) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        self.append(hashlib.sha256("".join(run).encode()).hexdigest(), level + 1)

    def close(self, levels: int) -> str:
        """Completes the runs that are still open; the one node of ``levels``."""
        for level in range(levels):
            if self.runs[level]:
                self._complete(level)
        return self.runs[levels][0]

    def path(self, place: int, levels: int) -> list[str]:
        out = []
        for level in range(levels):
            left, right = self.witness[level][place // ARITY**level]
            out += "".join(left), "".join(right)
        return out


def _grown(nodes: pa.Table, most: int) -> tuple[pa.Table, Appends, int]:
    """A block's nodes in order, appended, and the levels that it has: ``most`` where its tree has other blocks."""
    nodes, tree = nodes.sort_by("pos"), Appends()
    for digest in nodes.column("digest").to_pylist():
        tree.append(digest)
    levels, left = 0, nodes.num_rows
    while left > 1:
        levels, left = levels + 1, -(-left // ARITY)
    return nodes, tree, levels if nodes.column("n")[0].as_py() <= ARITY**most else most


NODE = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.string()), ("n", pa.int64())])


def _block_root(most: int):
    def run(nodes: pa.Table) -> pa.Table:
        nodes, tree, levels = _grown(nodes, most)
        first = nodes.slice(0, 1).to_pylist()[0]
        return pa.table({"tree": [first["tree"]], "pos": [first["pos"] // ARITY**most], "digest": [tree.close(levels)], "n": [-(-first["n"] // ARITY**most)]}, schema=NODE)

    return run


def _handed_down(most: int):
    """Each node's witness: its own within the block, and then the block's."""

    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes, tree, levels = _grown(nodes, most)
        tree.close(levels)
        block = above.slice(0, 1).to_pylist()[0]
        paths = pa.array([tree.path(i, levels) + block["witness"] for i in range(nodes.num_rows)], pa.list_(pa.string()))
        same = lambda name: pa.array([block[name]] * nodes.num_rows, pa.string())
        return nodes.drop_columns(["n"]).append_column("witness", paths).append_column("subroot", same("subroot")).append_column("root", same("root"))

    return run


def _rounds(nodes: DataFrame, levels: int, tables: Staging) -> list[DataFrame]:
    """``nodes`` (tree, pos, digest, n) and above them the roots of blocks, round by round, until each tree has one."""
    out = [nodes]
    while True:
        blocks = out[-1].select("tree", "pos", "digest", "n").groupBy("tree", F.expr(f"pos div {ARITY**levels}"))
        out.append(tables.put(blocks.applyInArrow(_block_root(levels), "tree string, pos long, digest string, n long"), "merkle-blocks"))
        if (out[-1].agg(F.max("n")).first()[0] or 1) == 1:
            return out


def _witnessed(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """``nodes`` with witness, subroot and root; ``above``: those of the blocks, by tree and pos."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields if f.name != "n")
    by = above.withColumn("block", F.col("pos")).groupBy("tree", "block")
    return nodes.groupBy("tree", F.expr(f"pos div {ARITY**levels}").alias("block")).cogroup(by).applyInArrow(_handed_down(levels), f"{fields}, witness array<string>, subroot string, root string")


def _placed(rows: DataFrame, order: list[str], tables: Staging) -> DataFrame:
    """``rows`` with ``pos``, their place in their tree, and ``n``, its size: sorted in ranges and numbered from their counts."""
    by = [F.col(c).asc_nulls_first() for c in order]
    ranged = tables.put(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("_at", 33).alias("_part")
    counts = ranged.groupBy("tree", part).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    return ranged.withColumn("_part", part).join(starts, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, source: str = "source", key: str = "doc_id", also: tuple[str, ...] = (), levels: int = LEVELS) -> DataFrame:
    """key, ``also``, leaf, witness, subroot, root of every row.

    ``witness`` has two texts for each level from the leaf's run up to the root: the digests
    left of the node and those right of it. A task appends ``ARITY**levels`` leaves at most.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))
    with Staging(docs.sparkSession) as tables:
        rows = tables.put(docs.select(F.col(key).alias("key"), *[F.col(c) for c in also], tree.alias("tree"), leaf(*[F.col(c) for c in fields]).alias("digest")), "merkle-leaves")
        leaves = staged(_placed(rows, ["tree", "key", "digest"], tables), "merkle-nodes")
        tables.drop(rows)
        rounds = _rounds(leaves, levels, tables)
        # '-' comes before '=': the null source first, then the others by their bytes
        subroots = _placed(rounds[-1].select("tree", "digest").withColumnsRenamed({"tree": "source", "digest": "subroot"}).withColumn("tree", F.lit("")), ["source"], tables)
        subroots = tables.put(subroots.withColumn("digest", F.col("subroot")), "merkle-subroots")
        upper = _rounds(subroots.select("tree", "pos", "digest", "n"), levels, tables)
        above = upper[-1].select("tree", "pos", F.array().cast("array<string>").alias("witness"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
        for nodes in reversed(upper[:-1]):
            above = tables.put(_witnessed(nodes, above, levels).drop("digest"), "merkle-above")
        above = subroots.drop("n", "digest").join(above.select("pos", "witness", "root"), "pos").select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("pos"), "witness", "subroot", "root")
        for nodes in reversed(rounds[1:-1]):
            above = tables.put(_witnessed(nodes, above, levels).drop("digest"), "merkle-above")
        above = staged(above, "merkle-above")
    return _witnessed(leaves, above, levels).select(F.col("key").alias(key), *also, F.col("digest").alias("leaf"), "witness", "subroot", "root")
