"""The pipeline, stage by stage, against what brute force keeps."""

import gc
import sys
import weakref
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute
import pyarrow as pa

import corpus_pipeline
from tidemark.llm import bpe, common, mixing, ngram_join, quality, secrets
from tidemark.llm.common import table

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, DATA, "documents")
    own = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in table(spark, DATA, "labels").collect()}
    steps = [f for _, f in corpus_pipeline.STAGES]
    kept = steps[0](spark, docs, DATA)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == own and not any(brute.quality(rows[i])["base_failed"] for i in ids)
    assert all(i in ids for i in rows if labels.get(i) == 1 and not brute.quality(rows[i])["base_failed"])
    single = steps[1](spark, kept, DATA)
    want = brute.components([(i, rows[i]) for i in ids], 5, 80)
    assert single.columns == own and {r.doc_id for r in single.collect()} == {c for _, c in want.values()}
    clean = steps[2](spark, single, DATA)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == own and not any(brute.base_spans(t) for t in texts.values())
    assert all(t == rows[i] for i, t in texts.items() if not brute.base_spans(rows[i]))
    mixed = steps[3](spark, clean, DATA)
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == own and max(times.values()) <= 2
    final = steps[4](spark, mixed, DATA)
    assert Counter(r.doc_id for r in final.collect()) == times
    assert {r.doc_id: r.decoded_sha256 for r in final.collect()} == {i: brute.sha(texts[i]) for i in times}


def test_run_agrees_with_its_stages(spark):
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    docs = table(spark, DATA, "documents")
    chained = mixing.mix_documents(secrets.redact(ngram_join.keep_one(quality.filter_documents(docs), 5, 80)))
    got = corpus_pipeline.run(spark, DATA)
    assert Counter(r.doc_id for r in got.select("doc_id").collect()) == Counter(r.doc_id for r in chained.select("doc_id").collect())


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, long and empty texts, and an empty table."""
    from test_operators import PROSE, edge_rows

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [r[:5] for r in edge_rows()] + [(None, None, None, None, None), (None, PROSE + " once more", None, None, None), (20, PROSE + " secret=abcdefgh", "en", "s1", 9)]
    for name, own in (("odd", rows), ("none", [])):
        spark.createDataFrame(own, schema).write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        got = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").collect()
        kept = [r for r in own if not brute.quality(r[1])["base_failed"]]
        assert {r.doc_id for r in got} <= {r[0] for r in kept} and bool(got) == bool(kept)


def test_columns_of_any_name_and_kind_go_through(spark):
    """Dots, blanks and backticks in names, maps, arrays and structs, repeated rows that differ in one of them."""
    from pyspark.sql import functions as F
    from test_operators import PROSE

    rows = [(i, PROSE + (f" w{i} x{i} y{i} z{i} a{i} b{i} c{i} d{i}" if i % 3 else ""), "en", "s", 9, {"k": str(i)}) for i in range(12)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, m map<string,string>")
    docs = docs.withColumns({"a.b": F.col("doc_id"), "c d`e": F.array("lang"), "s": F.struct("lang", "m"), "n": F.monotonically_increasing_id()})
    kept = ngram_join.keep_one(quality.filter_documents(docs))
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    want = brute.components([(r[0], r[1]) for r in rows[:12]], 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})
    mixed = mixing.mix_documents(secrets.redact(kept))
    assert mixed.columns == docs.columns and {r["a.b"] for r in mixed.collect()} <= {r["a.b"] for r in kept.collect()}


def test_mix_against_brute_force(spark):
    """Each source's words come within one document of its target, and none is taken more than twice."""
    docs = table(spark, DATA, "documents")
    words = {r.doc_id: (r.source, len(brute.WORD.findall(r.text or ""))) for r in docs.collect()}
    sizes = Counter()
    for source, n in words.values():
        sizes[source] += n
    want, taken = brute.targets(sizes), Counter()
    times = Counter(r.doc_id for r in mixing.mix_documents(docs).collect())
    for i, n in times.items():
        taken[words[i][0]] += n * words[i][1]
    assert max(times.values()) <= 2
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(n for s, n in words.values() if s == source), source


def test_workers_give_back_what_another_operator_kept():
    class Table:
        pass

    made, collecting = Table(), gc.isenabled()
    made.own, gone = made, weakref.ref(made)
    gc.disable()
    try:
        common.kept("test-a", lambda: made)
        del made
        common.kept("test-b", lambda: 1)
        assert gone() is None
    finally:
        common._IN_WORKER.clear()
        if collecting:
            gc.enable()


def test_a_worker_holds_the_ids_of_few_rows():
    coder = bpe.PrefixBPE({bytes([i]): i for i in range(256)} | {b"ab": 256}, r".+")
    texts = [None, ""] + ["ab" * (i % 5) for i in range(700)]
    out = list(bpe.encoded(pa.record_batch({"key": list(range(702)), "text": texts}), coder))
    assert max(b.num_rows for b in out) <= bpe.ROWS and [k for b in out for k in b.column(0).to_pylist()] == list(range(702))
    assert [ids for b in out for ids in b.column(1).to_pylist()] == [[256] * ((t or "").count("ab")) for t in texts]
