"""Mixing sources to target weights by capped water-filling.

The budget is shared among the sources in proportion to their weights; a source can
give at most ``max_epochs`` times its size, and what a clamped source cannot give goes
to the others by weight until no target lies above its cap. Each document is then taken
``floor(target / source size)`` times, and once more if its seeded hash lies under the
source's threshold. Thresholds come from two rounds of hash-bucket sums per source, so
no task ever orders a source's documents, and a source may hold any share of the rows.

The hash is of the id, the text and, among rows that agree in id, text and source, a
number, so that any of them can be split. Rows that agree in all three are taken alike but for
one repetition; which of them gives it is open where they differ in other columns. Null text
has size 0; a null source is a source of its own, last in order; null and repeated ids need
nothing else; an empty table gives an empty result.
Documents do not shuffle but for repeated rows: sizes are staged as a narrow table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Staging, staged, text_of, whole_row

WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
MAX_EPOCHS = 2
SEED = 42
FINE = 1024


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def weighted(sources: DataFrame, tables: Staging, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Sources in code-point order, null last, given the repeating weights.

    They are ordered in ranges, and numbered within them from the counts of the ranges before.
    """
    ranged = sources.withColumn("_null", F.col("source").isNull()).repartitionByRange("_null", "source").withColumn("_range", F.spark_partition_id())
    ranged = tables.put(ranged, "mix-ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = ranged.join(counts, "_range").withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy("_null", "source")) - 1)
    return ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))).select(*sources.columns, "weight")


def water_fill(sources: DataFrame, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target``. ``sources``: source, source_size, weight; staged, one row per source.

    Each round clamps every source whose share passes its cap and reshares the rest, and two
    sums come to the driver; there are as many rounds as steps in which sources are clamped.
    Totals are exact integers (hundredths of a word), so the level does not depend on the
    order of addition.
    """
    cap = 100 * max_epochs * F.col("source_size")
    total, weight = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (total * budget_percent, weight)
    while level[1]:
        above = cap * F.lit(float(level[1])) < F.col("weight") * F.lit(float(level[0]))
        clamped, free = sources.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if (after := (total * budget_percent - clamped, free)) == level:
            break
        level = after
    full = F.col("source_size").cast("double") * max_epochs
    if not level[1]:  # every source gives all it may
        return sources.withColumn("target", full)
    return sources.withColumn("target", F.least(F.lit(float(level[0])) * F.col("weight") / F.lit(float(level[1])) / F.lit(100.0), full))


def _limits(sizes: DataFrame, plan: DataFrame, tables: Staging) -> DataFrame:
    """_src -> ``_limit``: documents with a hash under it give one more repetition.

    The first round finds the bucket of hashes in which the wanted words are reached, the
    second the place inside it; what is taken ends within one fine bucket of the target.
    """
    def upto(by: str):
        return Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    bucket = F.expr(f"_u div {FINE}")
    sums = sizes.groupBy("source", bucket.alias("_b")).agg(F.sum("size").alias("_s")).withColumn("_cum", F.sum("_s").over(upto("_b")))
    crossed = sums.join(plan.select("_src", "_want"), sums["source"].eqNullSafe(plan["_src"])).filter("_cum > _want")
    edge = crossed.groupBy("_src").agg(F.min_by(F.struct("_b", (F.col("_cum") - F.col("_s")).alias("_below"), "_want"), "_b").alias("e"))
    edge = tables.put(edge.select("_src", "e.*"), "mix-edge")
    inside = sizes.join(edge, sizes["source"].eqNullSafe(edge["_src"]) & (bucket == F.col("_b")))
    inside = inside.groupBy("source", "_b", "_below", "_want", "_u").agg(F.sum("size").alias("_s")).withColumn("_cum", F.col("_below") + F.sum("_s").over(upto("_u")))
    nearer = F.col("_cum") - F.col("_s") / 2 <= F.col("_want")  # the hash that crosses goes in if that comes nearer
    last = inside.groupBy("source").agg(F.max(F.when(nearer, F.col("_u") + 1)).alias("_last"), F.min(F.col("_b") * FINE).alias("_first"))
    return last.select(F.col("source").alias("_src"), F.coalesce("_last", "_first").alias("_limit"))


def _keyed(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """``also``, doc_id, source, the text's digest ``_text`` and ``_row``, which rows share that agree in the three."""
    rows = docs.select(*also, "doc_id", F.col("source").cast("string").alias("source"), F.md5(text_of()).alias("_text"))
    return rows.withColumn("_row", F.xxhash64("doc_id", "source", "_text"))


def _numbered(rows: DataFrame, seed: int, repeated: DataFrame) -> DataFrame:
    """``rows`` of ``_keyed`` with ``_u``, twenty bits of an MD5 of seed, id, text and number: the same in any engine.

    Only rows of ``repeated`` (_row) are numbered, from 1: staged with the task that wrote them,
    they count within each task's share and by the shares before it, so that equal rows never
    meet in one task.
    """
    alike = staged(rows.join(repeated, "_row", "left_semi").withColumn("_share", F.spark_partition_id()), "mix-alike")
    within = F.row_number().over(Window.partitionBy("_row", "_share").orderBy(F.lit(0)))
    shares = alike.groupBy("_row", "_share").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_row").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1))
    alike = alike.withColumn("_within", within).join(shares.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n"), ["_row", "_share"])
    alike = alike.withColumn("_number", F.col("_within") + F.col("_before")).drop("_share", "_within", "_before")
    both = rows.join(repeated, "_row", "left_anti").withColumn("_number", F.lit(1).cast("long")).unionByName(alike)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_text", "_number"))
    return both.withColumn("_u", F.conv(F.substring(digest, 1, 5), 16, 10).cast("long")).drop("_number", "_text", "_row")


def _plan(docs: DataFrame, seed: int, budget_percent: int, max_epochs: int, weights: tuple[int, ...], tables: Staging) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The narrow table of sizes; per source _src, source_size, target, _whole, _limit; and the _row of repeated rows."""
    keyed = tables.put(_keyed(docs.withColumn("_size", word_count()), ("_size",)), "mix-keys")
    repeated = tables.put(keyed.groupBy("_row").agg(F.count("*").alias("n")).filter("n > 1").select("_row"), "mix-repeated")
    sizes = tables.put(_numbered(keyed, seed, repeated).withColumnRenamed("_size", "size"), "mix-sizes")
    tables.drop(keyed)
    sources = tables.put(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    filled = water_fill(tables.put(weighted(sources, tables, weights), "mix-weights"), budget_percent, max_epochs)
    whole = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size")))
    plan = filled.select(F.col("source").alias("_src"), "source_size", "target", whole.alias("_whole"))
    plan = tables.put(plan.withColumn("_want", F.col("target") - F.col("_whole") * F.col("source_size")), "mix-wants")
    limits = _limits(sizes, plan, tables).withColumnRenamed("_src", "_at")
    plan = plan.join(limits, plan["_src"].eqNullSafe(limits["_at"]), "left").select("_src", "source_size", "target", "_whole", F.coalesce("_limit", F.lit(0)).alias("_limit"))
    return sizes, staged(plan, "mix-plan"), repeated


def _times(max_epochs: int) -> Column:
    return F.least(F.col("_whole") + (F.col("_u") < F.col("_limit")).cast("long"), F.lit(max_epochs).cast("long"))


def repetitions(docs: DataFrame, seed: int = SEED, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target, times: how often the mix takes each document."""
    with Staging(docs.sparkSession) as tables:
        sizes, plan, _ = _plan(docs, seed, budget_percent, max_epochs, weights, tables)
        joined = sizes.join(plan, sizes["source"].eqNullSafe(plan["_src"]))
        return staged(joined.select("doc_id", "source", "size", "source_size", "target", _times(max_epochs).alias("times")), "mix-repetitions")


def mix_documents(docs: DataFrame, seed: int = SEED, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns only.

    Only the per-source plan is joined to the documents, which are read a second time.
    """
    with Staging(docs.sparkSession) as tables:
        _, plan, repeated = _plan(docs, seed, budget_percent, max_epochs, weights, tables)
        repeated = staged(repeated, "mix-repeated")
    whole = docs.select(whole_row(docs).alias("_doc"), *[F.col(c).alias(c) for c in ("doc_id", "source", "text")])
    rows = _numbered(_keyed(whole, ("_doc",)), seed, repeated)
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["_src"])).withColumn("_n", _times(max_epochs).cast("int")).filter("_n > 0")
    return joined.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy")).select("_doc.*")
