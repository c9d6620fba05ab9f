"""Ranked lexical search for many queries at once, with shared partial sums.

Items that share terms share work. The term sets of a batch of items are mined for pairs of
nodes (a term, or a set of terms already shared) that several items hold both of; the most
frequent pair becomes a node of its own, replaces the pair in all those items, and so on until no
pair is held twice. The result is a graph in which every node is a disjoint union of two
others and every item one of its nodes. A document's partial accumulators, one for each node,
are then computed once, children before parents, and each item adds up its few nodes; sums
of integers, so that the order of addition does not matter.

The documents are read once for each batch: a task leaves the terms of the batch that each
document holds, with their counts, in a staged table, from which document frequencies are
counted and scores computed. A task keeps the best of each item among its own documents,
and ranks are taken in two steps (a share of the documents, then all), so that no task orders
more than a bounded share. Batches are bounded in terms, whatever the number of items, and
only a batch's terms and plan go to the tasks; an item with more terms is a batch of its own.

Null text has no terms; an item without terms, or whose terms no document holds, gives no rows.
Repeated documents are ranked each, equal scores by id, null ids last. Repeated items are
ranked each. Other columns are not read. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Staging, staged

#: Terms of a batch of items, added up over its items.
BATCH_TERMS = 100_000
#: A node of an item is paired with so many of its next ones, most frequent first.
NEXT = 64
#: Accumulators that a task holds at once: documents times nodes.
CELLS = 2_000_000
#: Parts of the documents whose best are taken before the best of all.
SHARES = 64
FOUND = "doc_id long, n long, terms array<int>, times array<int>"
SCORED = "item int, doc_id long, score long"

#: Bytes of terms: digits, letters (capitals A-Z as a-z) and all that is not ASCII; others part them.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TERM).split() if text else []


def shared_nodes(items: list[list[int]], n_terms: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """The mined graph: the children of each node beyond the ``n_terms`` terms, in order of making, and the nodes of each item.

    Every item's nodes hold each of its terms once.
    """
    own, holders = [set(i) for i in items], defaultdict(set)
    for i, nodes in enumerate(own):
        for x in nodes:
            holders[x].add(i)
    pairs: Counter = Counter()
    for nodes in own:
        several = sorted((x for x in nodes if len(holders[x]) > 1), key=lambda x: (-len(holders[x]), x))
        pairs.update((a, b) for k, a in enumerate(several) for b in several[k + 1 : k + 1 + NEXT])
    queue = [(-n, p) for p, n in pairs.items() if n > 1]
    heapq.heapify(queue)
    made: list[tuple[int, int]] = []
    while queue:
        n, (a, b) = heapq.heappop(queue)
        both = holders[a] & holders[b]
        if len(both) != -n:  # fewer than when it was counted
            if len(both) > 1:
                heapq.heappush(queue, (-len(both), (a, b)))
            continue
        node = n_terms + len(made)
        made.append((a, b))
        holders[a] -= both
        holders[b] -= both
        holders[node] = both
        near: Counter = Counter()
        for i in both:
            own[i] -= {a, b}
            near.update(x for x in own[i] if len(holders[x]) > 1)
            own[i].add(node)
        for x, n in near.items():
            if n > 1:
                heapq.heappush(queue, (-n, (x, node)))
    return made, [sorted(x) for x in own]


class Plan:
    """A batch of items as a graph, ready to be evaluated over blocks of documents."""

    def __init__(self, items: list[list[int]], n_terms: int):
        made, self.items = shared_nodes(items, n_terms)
        self.n_terms, self.n_nodes = n_terms, n_terms + len(made)
        depth = [0] * self.n_nodes
        for k, (a, b) in enumerate(made):
            depth[n_terms + k] = 1 + max(depth[a], depth[b])
        level = np.array(depth[n_terms:], np.int64)
        children = np.array(made, np.int64).reshape(-1, 2)
        self.levels = [(n_terms + at, children[at, 0], children[at, 1]) for at in (np.flatnonzero(level == d) for d in range(1, int(level.max(initial=0)) + 1))]
        self.ends = np.cumsum([0, *map(len, self.items)])[:-1]
        self.nodes = np.array([x for i in self.items for x in i], np.int64)

    def scores(self, sums: np.ndarray) -> np.ndarray:
        """items x documents, from ``sums``, nodes x documents, of which the terms' rows are filled in."""
        for nodes, a, b in self.levels:
            sums[nodes] = sums[a] + sums[b]
        return np.add.reduceat(sums[self.nodes], self.ends, axis=0)


def _found(vocabulary: dict[bytes, int]):
    """doc_id, n, and the batch's terms with their counts, of every document with a term at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            ids, sizes, ends, terms, times = [], [], [0], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = terms_of(text.as_py())
                if words:
                    held = Counter(map(number, words))
                    held.pop(None, None)
                    ids.append(doc)
                    sizes.append(len(words))
                    terms += held.keys()
                    times += held.values()
                    ends.append(len(terms))
            of = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), of(terms), of(times)], names=["doc_id", "n", "terms", "times"])

    return run


def _best(plan: Plan, weights: np.ndarray, n_docs: int, length: int, k: int):
    """The task's ``k`` best documents of each item; ids as their place in order, null last."""
    last = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # per item a table of the best so far: scores and ids, best first
        score, doc = np.zeros((len(plan.items), 0), np.int64), np.zeros((len(plan.items), 0), np.int64)
        block = max(1, CELLS // plan.n_nodes)
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                batch = whole.slice(at, block)
                terms, times = batch.column("terms"), batch.column("times").flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(batch.num_rows), np.diff(terms.offsets.to_numpy()))
                m = np.array([50 + 50 * n * n_docs // length for n in batch.column("n").to_pylist()], np.int64)
                term = terms.flatten().to_numpy()
                sums = np.zeros((plan.n_nodes, batch.num_rows), np.int64)
                sums[term, row] = weights[term] * (1_000_000_000 * times // (1000 * times + 20 * m[row]))
                found = plan.scores(sums)
                ids = batch.column("doc_id").fill_null(last).to_numpy()
                score, doc = np.concatenate([score, found], 1), np.concatenate([doc, np.broadcast_to(ids, found.shape)], 1)
                if score.shape[1] > k:
                    order = np.lexsort((doc, -score), 1)[:, :k]
                    score, doc = np.take_along_axis(score, order, 1), np.take_along_axis(doc, order, 1)
        item, place = np.nonzero(score > 0)
        ids = doc[item, place]
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(ids, mask=ids == last), pa.array(score[item, place])], names=["item", "doc_id", "score"])

    return run


def _ranked(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` best rows of each item, in shares of the documents first."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = rows.withColumn("_share", F.expr(f"pmod(xxhash64(doc_id), {SHARES})"))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "_share").orderBy(*order))).filter(F.col("rank") <= k).drop("_share", "rank")
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(sets, pa.list_(pa.binary())), pa.array([len(s) for s in sets], pa.int64())], names=["item_id", "terms", "n"])

    with Staging(spark) as tables:
        asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
        asked = asked.mapInArrow(own, "item_id long, terms array<binary>, n long").filter("n > 0").withColumn("no", F.monotonically_increasing_id())
        asked = tables.put(asked, "lexical-items")
        n_batches = max(1, math.ceil((asked.agg(F.sum("n")).first()[0] or 0) / BATCH_TERMS))
        asked = tables.put(asked.withColumn("batch", F.expr(f"pmod(xxhash64(no), {n_batches})")).repartition("batch"), "lexical-batches")
        done = []
        for b in range(n_batches):  # each is bounded, and so is what comes to the driver of it
            batch = asked.filter(F.col("batch") == b).orderBy("no").collect()
            if not batch:
                continue
            vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in batch for t in r.terms}))}
            plan = Plan([[vocabulary[bytes(t)] for t in r.terms] for r in batch], len(vocabulary))
            found = tables.put(texts.mapInArrow(_found(vocabulary), FOUND), "lexical-found")
            n_docs, length = found.agg(F.count("*"), F.sum("n")).first()
            df = dict(found.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
            weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
            best = _ranked(found.mapInArrow(_best(plan, weights, n_docs, length or 1, k), SCORED), ["item"], k)
            names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(batch)], "item int, item_id long")
            done.append(staged(best.join(names, "item").select("item_id", "rank", "doc_id", "score"), "lexical-ranks"))
            tables.drop(found)
    if not done:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
