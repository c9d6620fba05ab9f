"""Quality classifier: interpolated modified Kneser-Ney over characters, ORDER at a time.

Trusted texts are split by a hash of their ids: one in HELD_OUT sets the thresholds, all
others are counted (no sample), so the counts grow with the corpus. Count tables are
sharded by n-gram; continuation counts, context totals and interpolated probabilities come
from joins and aggregates among them, order by order.

Documents are scored by sharded count joins too, in one form at every size. A batch is a
run of a file's documents, bounded in bytes; its distinct n-grams are joined with the model once for
all batches, shard by shard, and meet the batch's texts, packed, again by its key. The model is
neither broadcast nor collected; broadcast is where batches begin, a row for each BATCH bytes or file. A document's cross-entropy decides against a quantile of
the held-out trusted documents of its language, with an allowance for short texts; the
quantile is Spark's approximate one, off by one in ACCURACY of the ranks at most.

Characters are code points, those beyond 16 bits taken as one; runs of white space are
one space and digits are alike. Null text is empty; empty text has no perplexity and
isn't kept; a language without held-out documents, and a null one, take the quantile of
all held-out documents, or of all trusted ones where none is held out; without any counted
text nothing is scored and nothing kept. Repeated rows score alike; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import shared_path, written
from .common import Staging, staged

ORDER = 4
BITS = 16
#: One trusted document in so many sets thresholds and is not counted.
HELD_OUT = 5
QUANTILE, ACCURACY = 0.99, 10_000
#: Bits that a text of n characters may lie above the quantile: MARGIN + SHORT / sqrt(n).
MARGIN, SHORT = 0.15, 6.0
START, END = 2, 3
#: Bytes after which a batch of a file's texts ends, with the block of rows at hand.
BATCH = 1 << 25
BLOCK = 256
#: Texts of more bytes than the first are in batches of their own, of as many rows as BATCH allows; one beyond the last is a batch.
SIZES = (1 << 17, 1 << 21)
#: Rows that a Python worker is given at once.
ARROW_ROWS = 2000
#: n-grams that a worker gathers before it lets go of repeated ones, and distinct ones that it holds.
FRESH, HELD = 1 << 21, 1 << 22
#: Bytes of texts that are packed together.
PACK = 1 << 23


def symbols(text: str | None) -> np.ndarray:
    """16-bit symbols of a text between start marks and an end mark; empty for a text without words."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    c = np.frombuffer(" ".join(words).encode("utf-32-le", "replace"), np.uint32).copy()
    c[(c >= 48) & (c <= 57)] = 48
    c[c > 0xFFFF] = 0xFFFD
    return np.concatenate([np.full(ORDER - 1, START), c, [END]]).astype(np.uint64)


def grams(s: np.ndarray) -> np.ndarray:
    """Codes of all ORDER-grams, 16 bits a symbol."""
    n = len(s) - ORDER + 1
    code = np.zeros(max(n, 0), np.uint64)
    for i in range(ORDER if n > 0 else 0):
        code = (code << np.uint64(BITS)) | s[i : i + n]
    return code


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order, and where each begins among all of them, with the end."""
    s = np.sort(codes)
    first = np.flatnonzero(np.concatenate([np.ones(min(len(s), 1), bool), s[1:] != s[:-1]]))
    return s[first], np.append(first, len(s))


def count(docs: DataFrame, text: str = "text") -> DataFrame:
    """code, c: the ORDER-grams of all texts; batches combine before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                codes = [grams(symbols(t.as_py())) for t in batch.column(0).slice(at, 512)]
                found, first = distinct(np.concatenate(codes))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.diff(first))], names=["code", "c"])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


def _context(code: Column) -> Column:
    return F.shiftrightunsigned(code, BITS)


def _suffix(code: Column, order: int) -> Column:
    return code.bitwiseAND(F.lit((1 << BITS * order) - 1))


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from the counts of counts."""
    n = {r.c: r.n for r in counts.filter("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    made = [i - (i + 1) * y * b / a if a else i / 2 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(d, 0.05), i) for i, d in zip((1, 2, 3), made, strict=True)]


def model(trusted: DataFrame, tables: Staging, text: str = "text") -> DataFrame:
    """kind, code, value: 'p4'..'p1' interpolated probabilities, 'g4'..'g1' weights of contexts.

    The context of order 1 is empty (code 0); 'u' (code 0) is the uniform probability.
    """
    levels = {ORDER: tables.put(count(trusted, text), "kn-counts")}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = tables.put(levels[k + 1].groupBy(_suffix(F.col("code"), k).alias("code")).agg(F.count("*").alias("c")), f"kn-{k}")
    uniform = 1.0 / (levels[1].count() + 1)
    parts = [trusted.sparkSession.range(1).select(F.lit("u").alias("kind"), F.lit(0).cast("long").alias("code"), F.lit(uniform).alias("value"))]
    lower = None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(levels[k])
        c = F.col("c")
        discount = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        rows = levels[k].withColumn("h", _context(F.col("code")))
        context = rows.groupBy("h").agg(F.sum("c").alias("total"), (F.sum(discount) / F.sum("c")).alias("g"))
        rows = rows.join(context, "h")
        if lower is None:
            p = F.col("g") * F.lit(uniform)
        else:
            rows = rows.withColumn("s", _suffix(F.col("code"), k - 1)).join(lower.select(F.col("code").alias("s"), F.col("value").alias("below")), "s")
            p = F.col("g") * F.col("below")
        probability = tables.put(rows.select(F.lit(f"p{k}").alias("kind"), "code", (F.greatest(c - discount, F.lit(0.0)) / F.col("total") + p).alias("value")), f"kn-p{k}")
        parts += [probability, context.select(F.lit(f"g{k}").alias("kind"), F.col("h").alias("code"), F.col("g").alias("value"))]
        lower = probability
    return tables.put(reduce(DataFrame.unionByName, parts), "kn-model")


def bits_of(codes: DataFrame, table: DataFrame) -> DataFrame:
    """(code, bits) of distinct codes: minus log2 of the probability of each code's last symbol.

    The longest known n-gram counts, weighted down from there by the contexts; all that a
    code may need is looked up in one join. Null bits where the model is empty.
    """
    fixed = {r.kind: r.value for r in table.filter("kind in ('u', 'g1')").collect()}  # two rows
    wanted = []
    for k in range(ORDER, 0, -1):
        code = _suffix(F.col("code"), k) if k < ORDER else F.col("code")
        wanted.append(F.struct(F.lit(f"p{k}").alias("kind"), code.alias("code")))
        if k > 1:
            wanted.append(F.struct(F.lit(f"g{k}").alias("kind"), _context(code).alias("code")))
    rows = codes.select(F.col("code").alias("of"), F.explode(F.array(*wanted)).alias("w")).select("of", "w.*").join(table, ["kind", "code"])
    found = rows.groupBy("of").agg(*[F.max(F.when(F.col("kind") == f"{x}{k}", F.col("value"))).alias(f"{x}{k}") for k in range(1, ORDER + 1) for x in "pg"])
    p = F.coalesce("p1", F.lit(fixed.get("g1")) * F.lit(fixed["u"]))
    for k in range(2, ORDER + 1):
        p = F.coalesce(F.col(f"p{k}"), F.coalesce(F.col(f"g{k}"), F.lit(1.0)) * p)
    return codes.join(found, codes["code"] == found["of"], "left").select("code", (-F.log2(p)).alias("bits"))


def _batched(docs: DataFrame, tables: Staging) -> DataFrame:
    """doc_id, lang, text and batch, a key that any reading of the files gives the same rows."""
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")]
    place = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        rows = docs.select(*own, *place)
    except AnalysisException:  # not a file's rows
        rows = tables.put(docs.select(*own), "kn-docs").select(*own, *place)
    size, block = F.octet_length(F.coalesce("text", F.lit(""))), F.floor(F.col("row") / BLOCK)
    small = size <= SIZES[0]
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.filter(small).groupBy("file", block.alias("block")).agg(F.sum(size).alias("bytes"))
    number = F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / BATCH)
    runs = tables.put(sums.withColumn("number", number).groupBy("file", "number").agg(F.min("block").alias("lo"), F.max("block").alias("hi")), "kn-runs")
    rows = rows.join(F.broadcast(runs.withColumnRenamed("file", "_file")), (F.col("file") == F.col("_file")) & block.between(F.col("lo"), F.col("hi")), "left")
    width = reduce(lambda rest, most: F.when(size <= most, F.lit(BATCH // most)).otherwise(rest), reversed(SIZES[1:]), F.lit(1))
    key = F.when(small, F.xxhash64("file", F.lit(0), "number")).otherwise(F.xxhash64("file", width, F.floor(F.col("row") / width)))
    return rows.select("doc_id", "lang", "text", key.alias("batch"))


def _codes(rows: DataFrame) -> DataFrame:
    """(batch, code): the distinct n-grams of each batch, or of what a task holds of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        fresh: dict[int, list[np.ndarray]] = {}

        def merge() -> None:
            for key, codes in fresh.items():
                held[key], _ = distinct(np.concatenate([held.get(key, np.empty(0, np.uint64)), *codes]))
            fresh.clear()

        def let_go() -> Iterator[pa.RecordBatch]:
            for key, codes in held.items():
                for at in range(0, len(codes), FRESH):
                    found = codes[at : at + FRESH]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key, np.int64)), pa.array(found.view(np.int64))], names=["batch", "code"])
            held.clear()

        n = 0
        for part in batches:
            for key, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                codes = grams(symbols(text.as_py()))
                fresh.setdefault(key, []).append(codes)
                n += len(codes)
                if n >= FRESH:
                    merge()
                    n = 0
                    if sum(map(len, held.values())) >= HELD:
                        yield from let_go()
        merge()
        yield from let_go()

    return rows.select("batch", "text").mapInArrow(run, "batch long, code long")


def _packed(rows: DataFrame) -> DataFrame:
    """(batch, packed): the documents of each batch, or of what a task holds of it, as compressed tables of about PACK bytes."""

    def packed(key: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = pa.Table.from_batches(parts).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9))) as out:
            out.write_table(own)
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        size = 0
        for part in batches:
            places: dict[int, list[int]] = {}
            for i, key in enumerate(part.column("batch").to_pylist()):
                places.setdefault(key, []).append(i)
            for key, at in places.items():
                held.setdefault(key, []).append(part.select(["doc_id", "lang", "text"]).take(pa.array(at)))
            size += part.nbytes
            if size >= PACK:
                yield from (packed(*x) for x in held.items())
                held, size = {}, 0
        yield from (packed(*x) for x in held.items())

    return rows.mapInArrow(run, "batch long, packed binary")


def _scores(packed: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
    """doc_id, lang, n, bits of a batch's documents, from the bits of its n-grams."""
    keys = table["code"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, values = keys[order], table["bits"].to_numpy(np.float64)[order]
    docs = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in packed["packed"]]) if len(packed) else pa.table({"doc_id": [], "lang": [], "text": []})
    n, bits = [], []
    for text in docs["text"]:
        codes = grams(symbols(text.as_py()))
        n.append(len(codes))
        bits.append(float(values[np.searchsorted(keys, codes)].sum()) if len(codes) else 0.0)
    return pd.DataFrame({"doc_id": docs["doc_id"].to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get), "lang": docs["lang"].to_pandas(), "n": pd.Series(n, dtype="int64"), "bits": pd.Series(bits, dtype="float64")})


def score(docs: DataFrame, table: DataFrame, tables: Staging) -> DataFrame:
    """doc_id, lang, n (symbols), bits of every row; bits are NaN where the model is empty."""
    rows = _batched(docs, tables)
    codes = tables.put(_codes(rows), "kn-codes")
    known = tables.put(bits_of(codes.select("code").distinct(), table), "kn-bits")
    found = codes.join(known, "code").select("batch", "code", "bits")
    return _packed(rows).groupBy("batch").cogroup(found.groupBy("batch")).applyInPandas(_scores, "doc_id long, lang string, n long, bits double")


def classify(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, short: float = SHORT) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold (bits per symbol) and kept of every row of ``docs``.

    ``trusted_ids``: doc_id of the trusted documents.
    """
    with Staging(docs.sparkSession, ARROW_ROWS) as tables:
        held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
        trusted = tables.put(trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct().withColumn("held", held), "kn-trusted")
        counted = trusted.filter("not held")
        table = model(docs.join(counted, docs["doc_id"].cast("long") == counted["doc_id"], "left_semi"), tables)
        # twelve bytes a row or so: the scores, and per language two numbers
        rated = score(docs, table, tables).withColumn("rate", F.when((F.col("n") > 0) & ~F.isnan("bits"), F.col("bits") / F.col("n")))
        scored = written(rated, shared_path(docs.sparkSession, "kn-scores"), ARROW_ROWS)
        allowance = F.lit(short) / F.sqrt("n")
        known = scored.filter("rate is not null").join(trusted, "doc_id").withColumn("net", F.col("rate") - allowance)
        at = lambda c: F.percentile_approx(F.when(c, F.col("net")), F.lit(quantile), F.lit(ACCURACY))
        by_lang = staged(known.groupBy("lang").agg(at(F.col("held")).alias("own")), "kn-limits")
        overall = known.agg(F.coalesce(at(F.col("held")), at(F.lit(True))).alias("all")).first()["all"]
    out = scored.join(by_lang.withColumnRenamed("lang", "_l"), F.col("lang") == F.col("_l"), "left")
    limit = F.coalesce(F.col("own"), F.lit(overall).cast("double")) + margin + F.when(F.col("n") > 0, allowance)
    return out.select("doc_id", "lang", F.col("n").alias("n_symbols"), F.pow(F.lit(2.0), F.col("rate")).alias("perplexity"), limit.alias("threshold"), F.coalesce(F.col("rate") <= limit, F.lit(False)).alias("kept"))
