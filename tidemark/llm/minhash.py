"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

A document is the set of its distinct word n-grams. A first permutation of the feature domain
sends each feature to one of 2**DOMAIN_BITS places on a circle; coordinate ``k`` of a
signature is the least value of a second permutation of the circle, shifted by ``k`` places,
over the set. As the shifts are consecutive, a feature's part in all coordinates is one
contiguous window of the second permutation, and a signature is the minimum of windows: two
permutations serve all coordinates, where plain MinHash takes one for each.

Coordinates are cut in BANDS bands of ROWS; sets with equal coordinates in a band share a
bucket. Two sets at Jaccard similarity 0.8 agree in a band with probability 0.8**5 = 0.33, and in
fewer than AGREE of the 56 with probability 6e-9 (less above 0.8); shifts of one permutation have
no more variance than independent ones. Equal sets are one class (by 128 bits of hash) before
any bucket is made. A bucket with more than PAIRS classes sends each to the bucket's hub, its
smallest key; of smaller ones each pair is named, and stays if it shares AGREE buckets. Either
way no bucket is capped, and none is multiplied out. Texts then go to the hub's group, where
every set is compared with the hub and the others of the group on full sets, and star
contraction joins what is linked: see ``ngram_join``.

Null, empty or wordless text: empty set, linked with nothing, component is the document itself.
Rows with a null id take no part and get a null component; rows that share an id are one
document with several texts. Repeated rows give repeated rows. Other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngram_join
from .common import Staging, staged
from .ngram_join import ARROW_ROWS, ROWS as TEXTS, _mix, shingles

DOMAIN_BITS = 22
BANDS, ROWS = 56, 5
#: Buckets that a pair named by small buckets must share.
AGREE = 2
#: Buckets of at most so many classes name their pairs (six at most), others a hub.
PAIRS = 4
#: Features whose windows are taken at once.
PIECE = 2048
_FIRST, _SECOND = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


@cache
def circle(bits: int = DOMAIN_BITS, width: int = BANDS * ROWS) -> np.ndarray:
    """Row s: the second permutation at s and the ``width - 1`` places after it, around the circle."""
    order = np.argsort(_mix(np.arange(1 << bits, dtype=np.uint64) * _SECOND + _FIRST), kind="stable").astype(np.uint32)
    return sliding_window_view(np.concatenate([order, order[: width - 1]]), width)


def places(features: np.ndarray, bits: int = DOMAIN_BITS) -> np.ndarray:
    """Where the first permutation, a bijection of 64 bits of which the top ones count, puts the features."""
    return (_mix(features ^ _FIRST) >> np.uint64(64 - bits)).astype(np.int64)


def coordinates(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS * ROWS coordinates for each set; all of the empty set's are the largest number."""
    windows, out = circle(), np.full((len(sets), BANDS * ROWS), np.iinfo(np.uint32).max, np.uint32)
    for row, s in zip(out, sets, strict=True):
        at = places(s)
        for first in range(0, len(at), PIECE):
            np.minimum(row, windows[at[first : first + PIECE]].min(0), out=row)
    return out


def buckets(found: np.ndarray) -> np.ndarray:
    """64 bits for each band of each row of coordinates."""
    steps = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = _mix(found.astype(np.uint64) ^ steps).reshape(len(found), BANDS, ROWS)
    return _mix(mixed.sum(2, dtype=np.uint64))


def features(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, cls (128 bits of the set's hash; null for none) and sigs, the set's buckets, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                sets = shingles(batch.column("text").to_pylist(), n)
                cls = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
                held = np.array([len(s) > 0 for s in sets], bool)
                made = buckets(coordinates([s for s in sets if len(s)])).view(np.int64)
                ends = pa.array(np.concatenate([[0], np.cumsum(held) * BANDS]).astype(np.int32))
                sigs = pa.ListArray.from_arrays(ends, pa.array(made.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(s) for s in sets], pa.int64()), cls, sigs], names=["key", "n_shingles", "cls", "sigs"])

    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, n_shingles long, cls binary, sigs array<long>")


def candidates(classes: DataFrame, tables: Staging) -> DataFrame:
    """(rep, hub_rep): the classes to compare. ``classes``: rep, sigs.

    Buckets are counted in partial aggregates; only those with different classes are joined
    with their classes again, by a join that Spark can split where a bucket is large.
    """
    rows = classes.select("rep", F.explode("sigs").alias("sig"))
    shared = rows.groupBy("sig").agg(F.min("rep").alias("hub_rep"), F.max("rep").alias("last"), F.count("*").alias("n")).filter("hub_rep < last")
    shared = tables.put(shared.select("sig", "hub_rep", "n"), "minhash-shared")
    met = tables.put(rows.join(shared.hint("shuffle_hash"), "sig"), "minhash-met")
    tables.drop(shared)
    few = met.filter(F.col("n") <= PAIRS).groupBy("sig").agg(F.array_sort(F.collect_set("rep")).alias("d"))
    named = F.flatten(F.transform("d", lambda x, i: F.transform(F.slice("d", i + 2, F.lit(PAIRS)), lambda y: F.struct(x.alias("hub_rep"), y.alias("rep")))))
    near = few.select(F.explode(named).alias("p")).groupBy("p.rep", "p.hub_rep").agg(F.count("*").alias("n")).filter(F.col("n") >= AGREE).select("rep", "hub_rep")
    many = met.filter((F.col("n") > PAIRS) & (F.col("rep") != F.col("hub_rep"))).select("rep", "hub_rep")
    out = tables.put(near.union(many).distinct(), "minhash-candidates")
    tables.drop(met)
    return out


def components(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the component's smallest id) of every row of ``docs``.

    ``percent`` below 80 would need more bands than these.
    """
    if percent < 80:
        raise ValueError("the bands are made for a similarity of 0.8 or more")
    with Staging(docs.sparkSession, ARROW_ROWS) as tables:
        rows = tables.put(features(docs, n, key, text), "minhash-features")
        whole = rows.filter("key is not null and cls is not null").groupBy("cls").agg(F.min_by(F.struct("key", "n_shingles", "sigs"), "key").alias("c"))
        classes = tables.put(whole.select("cls", F.col("c.key").alias("rep"), "c.n_shingles", "c.sigs"), "minhash-classes")
        sizes = classes.groupBy("rep").agg(F.sum("n_shingles").alias("n_shingles"))
        own = candidates(classes.select("rep", "sigs"), tables).join(sizes, "rep")
        out = ngram_join.settled(docs, rows.drop("sigs"), classes.drop("sigs"), own, n, percent, tables, key, text)
        return staged(out.select(F.col("key").alias("doc_id"), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept")), "minhash-components")
