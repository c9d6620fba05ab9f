"""Word n-gram Jaccard join with PartEnum signatures, and the components it links.

A document is the set of its distinct word n-grams (64-bit hashes). Sets whose Jaccard
similarity reaches the threshold have sizes in the same or in adjacent size bands, and
within a band differ in at most ``k`` features. The feature domain is cut into parts, each
part in CUTS cells, and a signature is a part's features in a subset of KEEP of its cells,
for every such subset. ``k`` differences cannot break all subsets of all parts; with SPARE
more parts than that takes, linked sets share not one but ``common`` signatures.

Only counts travel before texts do. Signatures found in different sets only once are let
go; a set that shares fewer than ``common`` in a band has no partner there and leaves; of
the sets under a signature of at most PAIRS, each pair is named and stays if it shares half
of ``common``. Of its larger signatures in a band each set lets the most frequent go, as many
as the other half: those of a passage that many texts hold, mostly. Under one that is left,
the set with the smallest hash is the hub, and every other set is compared with its hubs, a
number of rows in proportion to the signatures. As
all sets under a signature share its hub, links among them are found among the differences
from it, which are short: sets farther from the hub than any set that the hub does not link
can reach are done, the rest of a group is compared in pairs of blocks, those that the hub
links with the others only. Groups are dealt
out in chunks bounded in features and rows. Every comparison is of exact set sizes.
Components then come from star contraction over the links found, a few rounds of
aggregations and joins over staged tables. Joins of signatures and of texts are by shuffle
at every size.

Null, empty or wordless text: empty set, linked with nothing, component is the document
itself. In ``components``, rows with a null id take no part and get a null component, and
rows that share an id are one document with several texts, and so one component. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import ceil, exp, factorial
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Staging, kept, staged, whole_row

if TYPE_CHECKING:  # workers that only hash texts do without it
    import pandas as pd

#: Cells of a part, and how many of them a signature covers.
CUTS, KEEP = 3, 2
#: Parts beyond those that the differences of linked sets can break.
SPARE = 1.25
BAND_BITS = 10
#: Bits of a set's hash that travel with its signatures. Two linked sets that agree in all of them, one pair in 2**40, are missed.
CLASS_BITS = 40
#: Signatures of at most so many sets name their pairs (six at most), others a hub.
PAIRS = 4
#: A hub's group is dealt out in tasks of at most about so many rows and features.
CHUNK = 512
FEATURES = 2_000_000
#: Rows of a block, when the rest of a large group is compared.
BLOCK = 1024
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Rows that a Python worker is given at once.
ARROW_ROWS = 1000
#: Rows and bytes that are hashed at once.
ROWS, PIECE = 64, 1 << 17
#: A word's hash is the sum of its bytes' codes times powers of an odd base; capitals A-Z have the codes of a-z.
_BASE = 0x9E3779B97F4A7C13
_CODES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_CODES[65:91] = _CODES[97:123]
_SPACES = np.isin(np.arange(256), [32, *range(9, 14)])


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``size`` powers of the base, and of its inverse, at least; a worker keeps those of a piece."""
    made = kept("powers", lambda: _series(2 * PIECE))
    return made if size <= len(made[0]) else _series(size)


def _series(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every word of the bytes."""
    space = np.concatenate([[True], _SPACES[data], [True]])
    start, end = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    up, down = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[data] * up[: len(data)], dtype=np.uint64)])
    return start, _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _runs(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(first, last, bytes): texts with a space between, or a piece of a long one, of about PIECE bytes."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE:
            yield first, i - 1, b" ".join(texts[first:i])
            first, size = i, 0
        size += len(t) + 1
        if len(t) > PIECE:
            at = 0
            while at < len(t):
                cut = len(t) if len(t) - at <= PIECE else max(t.rfind(b" ", at, at + PIECE), at)
                if cut == at:  # one word without end: up to the next space
                    cut = t.find(b" ", at + 1)
                    cut = len(t) if cut < 0 else cut
                yield i, i, t[at:cut]
                at = cut
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts) - 1, b" ".join(texts[first:])


def shingles(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; of fewer words than n, one for the whole sequence."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    hashes, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for first, last, data in _runs(raw):
        place, found = _words(np.frombuffer(data, np.uint8))
        ends = np.cumsum([len(t) + 1 for t in raw[first : last + 1]])
        hashes.append(found)
        owners.append(first + np.searchsorted(ends, place, "right") if last > first else np.full(len(found), first))
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    total = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        total += _mix(h[i : len(total) + i] ^ _MULTIPLIERS[i % len(_MULTIPLIERS)]) * _MULTIPLIERS[(i + 3) % len(_MULTIPLIERS)]
    whole = owner[: len(total)] == owner[n - 1 :]  # windows inside one text
    grams, starts = _mix(total[whole]), np.searchsorted(owner[: len(total)][whole], np.arange(len(texts) + 1))
    words = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        s = np.sort(grams[starts[i] : starts[i + 1]])
        if not len(s) and words[i] < words[i + 1]:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[words[i] : words[i + 1]].tobytes(), seed=1)], np.uint64))
        else:
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out


#: The subsets of a part's cells that are enumerated.
SUBSETS = tuple(combinations(range(CUTS), KEEP))


@cache
def bands(percent: int, largest: int = 1 << 31) -> dict[str, np.ndarray]:
    """Size bands and what holds in each.

    A band is as wide as two steps of the threshold, so that only the larger half of its
    sizes can have partners in the next. start: first size. k: differences that linked sets
    can have of which the larger lies in the band. parts: parts of the feature domain. weak:
    signatures with fewer features are dropped by a set that has at most ``spare`` of them.
    common: signatures that linked sets then still share.
    """
    start = [1]
    while start[-1] <= largest:
        start.append(max(start[-1] + 1, ceil(start[-1] * 10_000 / percent**2)))
    per_part = len(SUBSETS)
    out: dict[str, list[int]] = {"start": [], "k": [], "parts": [], "weak": [], "spare": [], "common": []}
    for low, after in zip(start, start[1:], strict=False):
        k = 2 * (after - 1) * (100 - percent) // (100 + percent)
        # each broken cell takes KEEP of a part's subsets first, and the last one second
        parts = ceil(SPARE * (k + 1) / KEEP)
        common = per_part * parts - 2 * k if k <= parts else 2 * parts - k
        spare = 2 * (common - 1) // 3
        mean = low * percent / 100 * KEEP / (CUTS * parts)
        few = [exp(-mean) * sum(mean**j / factorial(j) for j in range(t)) * per_part * parts for t in (1, 2, 3)]
        weak = max([1, *(t for t, x in zip((1, 2, 3), few, strict=True) if x <= spare / 2)])
        for name, value in zip(out, (low, k, parts, weak, spare, common - spare), strict=True):
            out[name].append(value)
    return {name: np.array(values, np.int64) for name, values in out.items()}


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of all sets, with their band in the top bits, and the place of the set that each belongs to.

    None of a set where only an equal one could be linked. All sets are worked on at once.
    """
    table, sizes = bands(percent), np.array([len(s) for s in sets], np.int64)
    features, own = np.concatenate([np.empty(0, np.uint64), *sets]), np.searchsorted(table["start"], sizes, "right") - 1
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for band in (own, own + 1):
        # the next band matters only if a set there can still be similar enough
        use = (sizes > 0) & (table["k"][band] > 0) & ((band == own) | (100 * sizes >= percent * table["start"][band]))
        which, b = np.flatnonzero(use), band[use]
        parts = table["parts"][b]
        first, total = np.cumsum(parts) - parts, int(parts.sum())
        f, owner = features[np.repeat(use, sizes)], np.repeat(np.arange(len(which)), sizes[use])
        place = _mix(f + (2 * b + 1).astype(np.uint64)[owner])
        part = first[owner] + ((place >> np.uint64(32)) % parts.astype(np.uint64)[owner]).astype(np.int64)
        cell = part * CUTS + ((place & np.uint64(0xFFFFFFFF)) % np.uint64(CUTS)).astype(np.int64)
        # sums in two halves, each exact in a double
        low, high = (np.bincount(cell, (f >> np.uint64(shift)) & np.uint64(0xFFFFFFFF), total * CUTS).astype(np.uint64) for shift in (0, 32))
        sums, held = _mix(low + (high << np.uint64(32))).reshape(total, CUTS), np.bincount(cell, minlength=total * CUTS).reshape(total, CUTS)
        by = np.repeat(np.arange(len(which)), parts)  # the set of each part
        label = (np.arange(total) - first[by]).astype(np.uint64)
        covered = np.stack([_mix(sums[:, list(c)].sum(1, dtype=np.uint64) + _mix(np.uint64(len(SUBSETS)) * label + np.uint64(i + (1 << 40)))) for i, c in enumerate(SUBSETS)], 1)
        found = (covered >> np.uint64(BAND_BITS)) | (b.astype(np.uint64) << np.uint64(64 - BAND_BITS))[by][:, None]
        strong = np.stack([held[:, list(c)].sum(1) for c in SUBSETS], 1) >= table["weak"][b][by][:, None]
        drops = np.bincount(by, (~strong).sum(1), len(which)) <= table["spare"][b]
        keep = strong | ~drops[by][:, None]
        out.append((found[keep], np.repeat(which[by], keep.sum(1))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _set_hash(s: np.ndarray) -> int | None:
    """64 bits that equal sets share, as a signed long; null for the empty set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else None


def features(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """``also``, key, n_shingles and cls (the set's hash) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                sets = shingles(batch.column("text").to_pylist(), n)
                sizes, hashes = pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_hash(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes, hashes], names=[*batch.schema.names[:-1], "n_shingles", "cls"])

    rows = docs.select(*also, docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, n_shingles long, cls long")


def signature_rows(docs: DataFrame, n: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(sig, cls) of every signature of each row with a key; ``cls`` in CLASS_BITS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                sets = shingles(whole.column(0).slice(at, ROWS).to_pylist(), n)
                found, owner = signatures(sets, percent)
                hashes = np.array([_set_hash(s) or 0 for s in sets], np.int64) & ((1 << CLASS_BITS) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(hashes[owner])], names=["sig", "cls"])

    return docs.filter(docs[key].isNotNull()).select(docs[text].cast("string").alias("text")).mapInArrow(run, "sig long, cls long")


def _labels(size: np.ndarray, linked: np.ndarray, diffs: list[np.ndarray], percent: int) -> np.ndarray:
    """Of a hub's members: -1 where one is in the hub's own component, else the place of the first that it reaches.

    Two members differ by the symmetric difference of their differences from the hub. Only
    elements that two members hold count, and they are multiplied out in blocks.
    """
    n, apart = len(size), np.array([len(d) for d in diffs], np.int64)
    label = np.where(linked, -1, np.arange(n))
    if linked.all() or n < 2:
        return label
    owner = np.repeat(np.arange(n), apart)
    _, element, count = np.unique(np.concatenate(diffs), return_inverse=True, return_counts=True)
    many = count >= 2
    place, use = np.cumsum(many) - 1, many[element]
    who, what, n_shared = owner[use], place[element[use]], int(many.sum())
    shared = np.zeros((n, n), np.float32)
    for first in range(0, n_shared, 4096):
        inside = (what >= first) & (what < first + 4096)
        block = np.zeros((n, min(4096, n_shared - first)), np.float32)
        block[who[inside], what[inside] - first] = 1
        shared += block @ block.T
    both = size[:, None] + size[None, :]
    differ = apart[:, None] + apart[None, :] - 2 * shared.astype(np.int64)
    links = 100 * (both - differ) >= percent * (both + differ)
    while True:  # smallest label over the links until nothing moves
        after = np.minimum(label, np.where(links, label[None, :], n).min(1))
        if (after == label).all():
            return label
        label = after


def _against_hub(percent: int, n: int):
    """A hub's group, or one chunk of a large one.

    A whole group is finished here: each member with the id that it is joined to (the hub's
    or another member's; its own for none). Of a chunk, members that are not the last word
    carry their difference from the hub on.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        hub, whole = int(group["hub"].iloc[0]), int(group["n_chunks"].iloc[0]) == 1
        # an id with several texts is a hub with several sets; the first serves as the origin of differences
        hub_sets = [s for s in shingles(sorted(set(group.loc[group["is_hub"], "text"].dropna())), n) if len(s)]
        others = group[group["key"] != hub]
        found = [(doc, s) for doc, s in zip(others["key"], shingles(others["text"].tolist(), n), strict=True) if len(s)]
        ids = np.array([doc for doc, _ in found], np.int64)
        size, linked, diffs = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool), []
        for i, (_, own) in enumerate(found):
            diffs.append(np.setxor1d(own, hub_sets[0], assume_unique=True))
            size[i] = len(own)
            for k, other in enumerate(hub_sets):
                both, apart = len(own) + len(other), len(diffs[-1]) if k == 0 else len(np.setxor1d(own, other, assume_unique=True))
                linked[i] |= 100 * (both - apart) >= percent * (both + apart)
        joined = np.where(linked, hub, ids)
        if whole and len(found):
            label = _labels(size, linked, diffs, percent)
            joined = np.where(label < 0, hub, ids[label])
        return pd.DataFrame({"hub": hub, "key": ids, "size": size, "linked": linked, "joined": joined, "apart": None if whole else [len(d) for d in diffs], "diff": None if whole else [d.view(np.int64) for d in diffs]})

    return run


def _pairs_within(percent: int):
    """A pair of blocks of a large group: each member with what it is joined to."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        ids, hub = group["key"].to_numpy(np.int64), int(group["hub"].iloc[0])
        label = _labels(group["size"].to_numpy(np.int64), group["linked"].to_numpy(bool), [np.asarray(d, np.int64) for d in group["diff"]], percent)
        return pd.DataFrame({"key": ids, "joined": np.where(label < 0, hub, ids[label])})

    return run


def _band(sig: str = "sig") -> Column:
    return F.shiftrightunsigned(sig, 64 - BAND_BITS).cast("int")


def candidates(rows: DataFrame, percent: int, tables: Staging) -> DataFrame:
    """(cls, hub): the pairs of sets to compare, from (sig, cls) rows.

    The rows are dealt out twice, first in partial aggregates for the signatures that
    different sets share, then to find who shares them; a signature that a large part of
    the sets share is combined before the first shuffle, and its join can be split.
    """
    shared = tables.put(rows.groupBy("sig").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a < b").select("sig"), "join-shared")
    met = tables.put(rows.join(shared.hint("shuffle_hash"), "sig"), "join-met")
    tables.drop(shared)
    found = tables.put(met.distinct(), "join-found")
    tables.drop(met)
    common = F.array(*[F.lit(int(x)) for x in bands(percent)["common"]])
    able = found.groupBy("cls", _band().alias("band")).agg(F.count("*").alias("n")).filter(F.col("n") >= F.get(common, F.col("band"))).select("cls", "band")
    left = tables.put(found.withColumn("band", _band()).join(able.hint("shuffle_hash"), ["cls", "band"], "left_semi"), "join-able")
    tables.drop(found)
    groups = left.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1")
    grouped = tables.put(left.join(groups.hint("shuffle_hash"), "sig").select("sig", "cls", "n"), "join-groups")
    tables.drop(left)
    # of `common` signatures that linked sets share, `named` are of few sets, or more than `let_go` are of many; each set
    # lets its most frequent ones go in an order that holds for all, so the rarest that two share stays with both
    named = F.array(*[F.lit(int(x) - int(x) // 2) for x in bands(percent)["common"]])
    let_go = F.array(*[F.lit(int(x) // 2) for x in bands(percent)["common"]])
    few = grouped.filter(F.col("n") <= PAIRS).groupBy("sig").agg(F.array_sort(F.collect_set("cls")).alias("d"))
    pairs = few.select("sig", F.explode(F.flatten(F.transform("d", lambda x, i: F.transform(F.slice("d", i + 2, F.lit(PAIRS)), lambda y: F.struct(x.alias("hub"), y.alias("cls")))))).alias("p"))
    near = pairs.groupBy("p.hub", "p.cls", _band().alias("band")).agg(F.count("*").alias("n")).filter(F.col("n") >= F.get(named, F.col("band"))).select("cls", "hub")
    order = Window.partitionBy("cls", "band").orderBy(F.desc("n"), "sig")
    large = grouped.filter(F.col("n") > PAIRS).withColumn("band", _band()).withColumn("at", F.row_number().over(order))
    large = tables.put(large.filter(F.col("at") > F.get(let_go, F.col("band"))).select("sig", "cls"), "join-large")
    hubs = large.groupBy("sig").agg(F.min("cls").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("sig", "hub")
    many = large.join(hubs.hint("shuffle_hash"), "sig").filter(F.col("cls") != F.col("hub")).select("cls", "hub")
    out = tables.put(near.union(many).distinct(), "join-candidates")
    tables.drop(grouped, large)
    return out


def paired(star: DataFrame, classes: DataFrame) -> DataFrame:
    """(hub_rep, rep, n_shingles): candidate pairs of sets by the keys that stand for them."""
    known = classes.withColumn("cls", F.col("cls").bitwiseAND(F.lit((1 << CLASS_BITS) - 1)))
    hubs = known.select(F.col("cls").alias("hub"), F.col("rep").alias("hub_rep"))
    return star.join(known, "cls").join(hubs, "hub").filter("rep <> hub_rep").select("hub_rep", "rep", "n_shingles")


def compared(docs: DataFrame, own: DataFrame, n: int, percent: int, key: str, text: str) -> DataFrame:
    """hub, key, size, linked, joined, apart, diff of every candidate pair of ``own`` (hub_rep, rep, n_shingles)."""
    parts = F.greatest(F.ceil(F.sum("n_shingles") / FEATURES), F.ceil(F.count("*") / CHUNK)).cast("int")
    chunks = own.groupBy("hub_rep").agg(parts.alias("n_chunks"))
    sized = own.join(chunks, "hub_rep").select(F.col("rep").alias("key"), F.col("hub_rep").alias("hub"), "n_chunks", F.expr("pmod(xxhash64(rep), n_chunks)").cast("int").alias("chunk"), F.lit(False).alias("is_hub"))
    hubs = chunks.select(F.col("hub_rep").alias("key"), F.col("hub_rep").alias("hub"), "n_chunks", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"), F.lit(True).alias("is_hub"))
    texts = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text"))
    dealt = texts.join(sized.unionByName(hubs).hint("shuffle_hash"), "key")
    return dealt.groupBy("hub", "chunk").applyInPandas(_against_hub(percent, n), "hub long, key long, size long, linked boolean, joined long, apart int, diff array<long>")


def links(docs: DataFrame, feats: DataFrame, classes: DataFrame, own: DataFrame, n: int, percent: int, tables: Staging, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b) rows that connect exactly what the similarity links among the candidates of ``own`` connect."""
    found = tables.put(compared(docs, own, n, percent, key, text), "join-compared")
    direct = found.select(F.col("key").alias("a"), F.col("joined").alias("b"))
    # groups of several chunks that hold sets which their hub does not link: those sets, and all that can reach one
    reach = F.floor(F.col("size") * (100 - percent) / percent)
    open_ = ~F.col("linked")
    # what is dealt out is settled without the differences, and these travel once, those that are compared only
    wide = found.filter("apart is not null")
    groups = wide.groupBy("hub").agg(F.min(F.when(open_, F.col("apart") - reach)).alias("lo"), F.max(F.when(open_, F.col("apart") + reach)).alias("hi")).filter("lo is not null")
    within = F.col("apart").between(F.col("lo"), F.col("hi"))
    # blocks of open sets first, then of linked ones, which are compared with open ones only
    parts = lambda what: F.ceil(F.count_if(what) / BLOCK).cast("int")
    blocks = wide.join(groups, "hub").filter(within).groupBy("hub").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), parts(open_).alias("n_open"), parts(F.col("linked")).alias("n_linked"))
    blocks = tables.put(blocks, "join-blocks")
    deal = lambda n: F.pmod(F.xxhash64("key", F.lit(7)), F.greatest(F.col(n), F.lit(1))).cast("int")
    rows = wide.join(blocks, "hub").filter(within).withColumn("block", F.when(open_, deal("n_open")).otherwise(F.col("n_open") + deal("n_linked")))
    last = F.col("n_open") + F.when(open_, F.col("n_linked")).otherwise(0) - 1
    # block pairs (i, j), i < j, or a block alone: a pair compares all that it holds, and a member goes to every pair that holds its block
    met = F.filter(F.sequence(F.lit(0), last), lambda j: (j != F.col("block")) | (last == 0))
    pair = F.transform(met, lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")))
    rows = rows.withColumn("at", F.explode(pair)).select("hub", "key", "size", "linked", "diff", "at.i", "at.j")
    inner = rows.groupBy("hub", "i", "j").applyInPandas(_pairs_within(percent), "key long, joined long").select(F.col("key").alias("a"), F.col("joined").alias("b"))
    # a document with several texts holds its classes together
    member = feats.filter("key is not null").join(classes, "cls").select("key", "rep").distinct()
    several = member.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("key")
    held_by = member.join(several, "key", "left_semi").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    out = tables.put(direct.union(inner).union(held_by).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "join-links")
    tables.drop(found, blocks)
    return out


def connected(edges: DataFrame, tables: Staging) -> DataFrame:
    """(a, component_id) of every id in ``edges`` (a, b; staged, dropped here; a > b): the smallest id reachable.

    Alternates large-star and small-star steps until the edges stop changing; each step
    is an aggregation and a join on the node, over a staged table.
    """
    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = None
    while (now := mark(edges)) != before and now[0]:
        before = now
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        after = tables.put(small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "join-stars")
        tables.drop(edges)
        edges = after
    return edges.groupBy("a").agg(F.min("b").alias("component_id"))


def settled(docs: DataFrame, feats: DataFrame, classes: DataFrame, own: DataFrame, n: int, percent: int, tables: Staging, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """``also``, key, n_shingles and component_id of every row of ``feats``, from the candidates of ``own``; valid while ``tables`` are."""
    found = connected(links(docs, feats, classes, own, n, percent, tables, key, text), tables)
    rows = feats.join(classes.select("cls", "rep"), "cls", "left").withColumn("rep", F.coalesce("rep", "key"))
    rows = rows.join(found.withColumnRenamed("a", "rep"), "rep", "left")
    return rows.select(*also, "key", "n_shingles", F.when(F.col("key").isNotNull(), F.coalesce("component_id", "rep")).alias("component_id"))


def resolved(docs: DataFrame, n: int, percent: int, tables: Staging, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """``also``, key, n_shingles and component_id of every row; valid while ``tables`` are."""
    feats = tables.put(features(docs, n, key, text, also), "join-features")
    classes = tables.put(feats.filter("key is not null and cls is not null").groupBy("cls").agg(F.min("key").alias("rep"), F.first("n_shingles").alias("n_shingles")), "join-classes")
    star = candidates(signature_rows(docs, n, percent, key, text), percent, tables)
    return settled(docs, feats, classes, paired(star, classes), n, percent, tables, key, text, also)


def components(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    with Staging(docs.sparkSession, ARROW_ROWS) as tables:
        return staged(resolved(docs, n, percent, tables, key, text).withColumnRenamed("key", "doc_id"), "join-components")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, the one with the smallest id, nulls last; rows without words are linked with nothing.

    Rows count as one where they agree in id and text: one of them stays, the same in every
    run. Rows with a null id, or with one id and different texts, are documents of their own.
    """
    keyed = docs.select(whole_row(docs).alias("_doc"), F.xxhash64("doc_id", "text").alias("_key"), F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    with Staging(docs.sparkSession, ARROW_ROWS) as tables:
        rows = resolved(keyed, n, percent, tables, "_key", "_text", ("_id",))
        rows = rows.groupBy("component_id", "key").agg(F.min("_id").alias("id"), F.count("*").alias("n"))
        best = rows.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key", "n")).alias("b"))
        kept = staged(best.select(F.col("b.key").alias("_key"), F.col("b.n").alias("_rows")), "join-kept")
    found = keyed.select("_key", "_doc").join(kept.hint("shuffle_hash"), "_key")
    single = found.filter("_rows = 1").select("_doc")
    repeated = found.filter("_rows > 1").groupBy("_key").agg(F.min_by("_doc", F.xxhash64(F.to_json("_doc"))).alias("_doc")).select("_doc")
    return single.union(repeated).select("_doc.*")
