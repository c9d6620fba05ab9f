"""Exact top-k inner products by a three-phase uniform threshold.

Rows and queries are dealt into a grid of blocks of bounded size. A row's score is the sum
of its partial scores in SLICES lists, one per group of vector components.

1. Each query meets one block of rows and gathers the k best scores there. The k-th of
   them can't exceed its final k-th best: a safe cutoff, sent to all blocks.
2. A row that reaches the cutoff reaches a uniform share of it, the cutoff divided by the
   number of lists, in some list. A list is read only where it can: its rows stand in order
   of their norms there, and those whose norm times the query's stays below the share are
   left unread, as are rows whose bounds over all lists stay below the cutoff. Entries that
   reach their share make their row a candidate.
3. What is not known of a candidate is bounded by norms; where the sum may still reach the
   cutoff, its score is resolved exactly by its id, and the k best per query survive.

All scores are integers, so the result is exact; ties go to the smaller vec_id. Components
must be so small that no sum can pass 64 bits (length times the largest square below
2**63); a search of larger ones ends with an error. Vectors that are null, or hold null or
non-finite components, take no part, and neither does a row whose length differs from the
query's. Repeated query rows count once; repeated candidate rows count each. Rows with a
null id are no queries but are no use as results, and are left out. An empty table or no
query gives no rows. Other columns are not read.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Staging, staged

SLICES = 4
ROWS = 8192
QUERIES = 2048
#: Pairs whose scores are resolved at once.
RESOLVED = 65_536


def quantised(vectors: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v (array<long>): floor(scale * x) of each component; unusable vectors left out."""
    whole = F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    exact = F.forall(vector, lambda x: F.abs(scaled(x)) < 2.0**62)
    good = vectors.filter(whole & finite).select(F.col(key).cast("long").alias("vec_id"), exact.alias("exact"), F.transform(vector, lambda x: F.floor(scaled(x))).alias("v"))
    return good.select("vec_id", F.when(F.col("exact"), F.col("v")).otherwise(F.raise_error(F.lit("a component passes 64 bits"))).alias("v"))


def _matrices(group: pd.DataFrame):
    """Per vector length: query ids and components, row ids and components, and the queries' rows.

    Doubles hold the products exactly below 2**53; larger components use integers.
    """
    for width, part in group.groupby(group["v"].map(len)):
        top = max(abs(int(f(part["v"].map(f)))) for f in (np.min, np.max))
        if top * top * width >= 2**63:
            raise OverflowError("scores could pass 64 bits")
        kind = np.float64 if top * top * width < 2**53 else np.int64
        q, r = part[part["is_query"]], part[~part["is_query"]]
        if len(q) and len(r):
            yield q["vec_id"].to_numpy(np.int64), np.stack(list(q["v"])).astype(kind), r["vec_id"].to_numpy(np.int64), np.stack(list(r["v"])).astype(kind), q


def _slices(width: int) -> list[slice]:
    edges = [width * i // SLICES for i in range(SLICES + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def _best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _gather(k: int):
    """Phase 1: the k best scores of the one block that a query meets."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for qid, q, rid, r, _ in _matrices(group):
            for at in range(0, len(qid), 256):
                full = q[at : at + 256] @ r.T
                for i, row in enumerate(full):
                    other = np.flatnonzero(rid != qid[at + i])
                    out += [(int(qid[at + i]), int(rid[p]), int(row[p])) for p in other[_best_of(rid[other], row[other], k)]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def _norms(x: np.ndarray, slices: list[slice]) -> np.ndarray:
    return np.stack([np.sqrt((x[:, s].astype(np.float64) ** 2).sum(1)) for s in slices], 1)


def reached(q: np.ndarray, r: np.ndarray, cutoffs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query place, row place, score) of all pairs whose score reaches the query's cutoff, and how many products of components that took."""
    slices = _slices(q.shape[1])
    q_norm, r_norm = _norms(q, slices), _norms(r, slices)
    # bounds and cutoffs are doubles: so much may be lost in them
    loss = 1 + 1e-12 * float(q_norm.sum(1).max() * r_norm.sum(1).max())
    cut = cutoffs[:, None] - loss
    bound, candidate, products = q_norm @ r_norm.T, np.zeros((len(q), len(r)), bool), 0
    live = (bound >= cut).any(0)
    for j, s in enumerate(slices):
        share = cut[:, 0] / len(slices)
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(share <= 0, -np.inf, share / q_norm[:, j]).min()
        order = np.argsort(-r_norm[:, j], kind="stable")
        read = order[: np.searchsorted(-r_norm[order, j], -least, "right")]
        read = read[live[read]]
        part = q[:, s] @ r[read][:, s].T
        products += part.size * (s.stop - s.start)
        candidate[:, read] |= part >= share[:, None]
        bound[:, read] += part - q_norm[:, j : j + 1] * r_norm[read, j]
    which, place = np.nonzero(candidate & (bound >= cut))
    score = np.empty(len(which), q.dtype)
    for first in range(0, len(which), RESOLVED):
        part = slice(first, first + RESOLVED)
        score[part] = (q[which[part]] * r[place[part]]).sum(1)
    products += len(which) * q.shape[1]
    whole = score >= cutoffs[which]
    return which[whole], place[whole], score[whole], products


def _collect(k: int):
    """Phases 2 and 3: rows that reach the cutoff, with their scores, at most the k best of a block."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for qid, q, rid, r, rows in _matrices(group):
            cutoffs = rows["cutoff"].fillna(-np.inf).to_numpy(np.float64)
            for at in range(0, len(qid), 256):
                which, place, score, _ = reached(q[at : at + 256], r, cutoffs[at : at + 256])
                other = qid[at + which] != rid[place]
                which, place, score = which[other], place[other], score[other]
                edges = np.searchsorted(which, np.arange(min(256, len(qid) - at) + 1))
                for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    out += [(int(qid[at + i]), int(rid[place[a + p]]), int(score[a + p])) for p in _best_of(rid[place[a:b]], score[a:b], k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def _best(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query. Spark keeps only k rows per query and task before the shuffle (a window group limit)."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(queries: DataFrame, rows: DataFrame, k: int = 5, block_rows: int = ROWS, block_queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score. Both sides: vec_id, v (see ``quantised``)."""
    schema = "query_id long, vec_id long, score long"
    with Staging(rows.sparkSession) as tables:
        rows, queries = tables.put(rows, "topk-rows"), tables.put(queries.dropDuplicates(["vec_id", "v"]), "topk-queries")
        n_r, n_q = max(1, ceil(rows.count() / block_rows)), max(1, ceil(queries.count() / block_queries))
        # a vector that repeats is dealt by its place in the file too, so that no block can fill up with it
        deal = lambda n, *c: F.pmod(F.xxhash64("vec_id", *c), F.lit(n)).cast("int")
        right = tables.put(rows.withColumn("rb", deal(n_r, F.monotonically_increasing_id())), "topk-grid").withColumn("is_query", F.lit(False))
        left = queries.withColumns({"rb": deal(n_r), "qb": deal(n_q, F.lit(1)), "is_query": F.lit(True)})
        first = left.drop("qb").unionByName(right).groupBy("rb").applyInPandas(_gather(k), schema)
        cut = _best(first.distinct(), k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("cutoff")).filter(F.col("n") == k).drop("n")
        known = tables.put(left.drop("rb").join(cut, left["vec_id"] == cut["query_id"], "left").drop("query_id"), "topk-cutoffs")
        sides = known.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))))
        sides = sides.unionByName(right.withColumns({"cutoff": F.lit(None).cast("double"), "qb": F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))}))
        return staged(_best(sides.groupBy("rb", "qb").applyInPandas(_collect(k), schema), k), "topk-best")
