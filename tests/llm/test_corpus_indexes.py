"""Near duplicates by MinHash, lexical search and the Merkle manifest: brute force, odd rows, large groups."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute
from test_operators import DATA, PROSE, SCHEMA, edge_rows

from tidemark.llm import lexical, merkle, minhash, ngram_join
from tidemark.llm.common import table
from tidemark.llm.queries import proven, queries


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA, "documents")


# 11


def test_near_duplicates_match_brute_force(spark, docs):
    want = brute.components([(r.doc_id, r.text) for r in docs.collect()], 2, 80)
    got = {r.doc_id: r for r in queries()["op11_minhash_near_dup"](spark, DATA).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_duplicates_of_odd_rows(spark, edge):
    rows = minhash.components(edge, n=2).collect()
    assert len(rows) == len(edge_rows())
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == by[5].component_id == 1 and by[8].component_id == 7 and not by[8].kept
    assert by[2].n_shingles == 0 and by[2].component_id == 2 and by[2].kept
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert minhash.components(edge.limit(0)).count() == 0
    with pytest.raises(ValueError):
        minhash.components(edge, percent=70)


def test_near_duplicates_link_large_groups(spark):
    """Copies, a chain of near copies and a group of near copies larger than a chunk, with unrelated texts."""
    made = random.Random(5)
    word = lambda: "".join(made.choices("abcdefghij", k=4))
    base, rows = [word() for _ in range(60)], []
    for i in range(900):  # all within a few words of one text
        own = list(base)
        for _ in range(made.randint(0, 2)):
            own[made.randrange(60)] = word()
        rows.append((i, " ".join(own)))
    chain = [word() for _ in range(80)]
    for i in range(900, 940):
        chain[(i * 7) % 80] = word()
        rows.append((i, " ".join(chain)))
    rows += [(i, " ".join(word() for _ in range(30))) for i in range(940, 1000)] + [(i, "the same text again and again") for i in range(1000, 1600)]
    made.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.components(spark.createDataFrame(rows, "doc_id long, text string"), n=2).collect()}
    assert got == brute.components(rows, 2, 80)


def test_signatures_are_shifts_of_one_permutation():
    windows, at = minhash.circle(12, 20), np.arange(1 << 12)
    assert len(set(windows[:, 0].tolist())) == 1 << 12
    for k in range(20):  # the k-th coordinate is the first, shifted by k around the circle
        assert (windows[at, k] == windows[(at + k) % (1 << 12), 0]).all()


def test_agreement_estimates_similarity():
    made = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8, 0.95):
        same = int(share * 2000)
        pool = made.integers(0, 1 << 63, 4000 - same, dtype=np.uint64)
        a, b = pool[:2000], pool[2000 - same : 4000 - same]
        real = same / (4000 - same)
        one, two = minhash.coordinates([a, b])
        assert abs(float((one == two).mean()) - real) < 4 * math.sqrt(real * (1 - real) / len(one)) + 0.01
        if real >= 0.8:
            one, two = minhash.buckets(np.stack([one, two]))
            assert (one == two).sum() >= minhash.AGREE


# 12


def ranked(docs, items, k=50):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df, out = Counter(t for _, c in held for t in c), []
    for item, text in items:
        scores = []
        for i, c in held:
            n = sum(c.values())
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // length))) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def test_search_matches_brute_force(spark, docs):
    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    got = queries()["op12_lexical_search"](spark, DATA)
    assert sorted([tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()], key=str) == ranked([(r.doc_id, r.text) for r in docs.collect()], items)


def test_search_in_batches_and_on_odd_rows(spark, edge, monkeypatch):
    monkeypatch.setattr(lexical, "BATCH_TERMS", 12)
    items = [(1, "the cat sat"), (2, None), (3, ""), (4, "THE DOG, the fire; été"), (4, "the dog"), (None, "w1x1 w2x2 zebra"), (6, "nothing_holds-this?"), (7, "straße 中文"), (8, PROSE)]
    schema = "item_id long, text string, doc_id string, score string"
    asked = spark.createDataFrame([(*i, "x", None) for i in items], schema)
    own = [(r[0], r[1]) for r in edge_rows()]
    for k in (3, 50):
        got = sorted([tuple(r) for r in lexical.search(edge, asked, k).select("item_id", "rank", "doc_id", "score").collect()], key=str)
        assert got == ranked(own, items, k)
    assert lexical.search(edge.limit(0), asked).count() == 0 and lexical.search(edge, asked.limit(0)).count() == 0


def test_shared_nodes_hold_every_term_once():
    made = random.Random(3)
    for n_items, n_terms in ((1, 5), (30, 40), (80, 300)):
        items = [sorted(made.sample(range(n_terms), made.randint(1, min(30, n_terms)))) for _ in range(n_items)]
        nodes, own = lexical.shared_nodes(items, n_terms)

        def spread(x, nodes=nodes, n_terms=n_terms):
            return [x] if x < n_terms else [t for c in nodes[x - n_terms] for t in spread(c)]

        assert [sorted(t for x in i for t in spread(x)) for i in own] == items
        plain, shared = sum(map(len, items)), len(nodes) + sum(map(len, own))
        assert shared <= plain
        below = lambda x, nodes=nodes, n_terms=n_terms: {x}.union(*(below(c) for c in nodes[x - n_terms])) if x >= n_terms else {x}
        reached = Counter(y for i in own for y in set().union(*map(below, i)))
        assert all(reached[n_terms + k] > 1 for k in range(len(nodes)))  # every mined node serves several items
        sums = np.zeros((lexical.Plan(items, n_terms).n_nodes, 7), np.int64)
        sums[:n_terms] = np.random.default_rng(0).integers(0, 100, (n_terms, 7))
        want = np.array([sums[i].sum(0) for i in items])
        assert (lexical.Plan(items, n_terms).scores(sums) == want).all()


# 13


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def up(nodes):
    """Root of a list of digests, and of each of them the siblings level by level as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            first = at[i] // 16 * 16
            p.append(("".join(nodes[first : at[i]]), "".join(nodes[at[i] + 1 : first + 16])))
        nodes, at = [sha(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], [x // 16 for x in at]
    return (nodes or [None])[0], paths


def manifest(rows):
    """doc_id, leaf, subroot, root, proof, folded root, verified of rows (doc_id, text, lang, source, n_chars)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha(*(field(v) for v in (r[0], r[3], r[2], r[4], text)))
    by = {}
    for r in rows:
        low = r[1] and re.sub("[A-Z]", lambda m: m[0].lower(), r[1])
        by.setdefault(r[3], []).append((r[0], leaf(r, r[1]), leaf(r, low) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else None))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for s in order}
    subroots = {s: up([x[1] for x in trees[s]]) for s in order}
    root, above = up([subroots[s][0] for s in order])
    out = []
    for s, path in zip(order, above, strict=True):
        for (i, own, other), below in zip(trees[s], subroots[s][1], strict=True):
            h = other or own
            for left, right in below + path:
                h = sha(left, h, right)
            out.append((i, own, subroots[s][0], root, sha(*(x for pair in below + path for x in pair)), h, h == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_matches_brute_force(spark, docs):
    got = queries()["op13_merkle_manifest"](spark, DATA).select(*COLUMNS).collect()
    assert sorted([tuple(r) for r in got], key=str) == manifest([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()])
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_of_odd_rows_and_sizes(spark, levels):
    """One block and several rounds of blocks; nulls, repeated rows, lone leaves, sources by code point, an empty table."""
    sizes = {None: 3, "": 1, "B": 16, "a": 17, "é": 257, "\U0001f600": 40, "hot": 700} | {f"s{i}": 1 + i % 3 for i in range(30)}
    rows = [(k * 10_000 + i, f"Text {i} Of {s}" if i % 7 else None, "en" if i % 3 else None, s, i) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(7, "Same", "en", "hot", 4)] * 3 + [(None, "No id", None, "hot", None), (None, "", "", "hot", 0)]
    random.Random(2).shuffle(rows)
    for own in (rows, []):
        made = spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long")
        got = proven(made, levels).select(*COLUMNS).collect()
        assert sorted([tuple(r) for r in got], key=str) == manifest(own)


def test_witness_folds_to_the_root_and_clashing_columns_stay_out(spark, edge):
    rows = merkle.manifest(edge.withColumns({"leaf": F.lit("x"), "pos": F.lit(1), "tree": F.lit("y"), "n": F.lit(2), "root": F.lit("z"), "digest": F.lit("w")}))
    rows = rows.withColumn("top", merkle.folded(F.col("leaf"))).collect()
    assert len(rows) == len(edge_rows()) and all(r.top == r.root for r in rows) and len({r.root for r in rows}) == 1


def test_appends_grow_like_a_whole_tree():
    digests = [sha(str(i)) for i in range(4200)]
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 4096):
        tree, levels, left = merkle.Appends(), 0, n
        for d in digests[:n]:
            tree.append(d)
        while left > 1:
            levels, left = levels + 1, -(-left // 16)
        root, paths = up(digests[:n])
        assert tree.close(levels) == root
        assert all(tree.path(i, levels) == [x for pair in paths[i] for x in pair] for i in range(0, n, 37))


def test_candidates_name_each_pair_of_small_buckets_once(spark):
    classes = spark.createDataFrame([(i, [100 + b * 10 + (i if b > 5 else 0) for b in range(8)]) for i in range(3)], "rep long, sigs array<long>")
    with ngram_join.Staging(spark) as tables:
        assert sorted(tuple(r) for r in minhash.candidates(classes, tables).collect()) == [(1, 0), (2, 0), (2, 1)]
