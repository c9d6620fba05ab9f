"""Validation rules. Each yields a reason column (null: passes); rejects keep their rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import values_equal
from ..sources.staging import small_rows


def first_reason(*reasons: Column) -> Column:
    return F.coalesce(*reasons)


def check_period(period: Column, expected: Column) -> Column:
    return F.when(period.isNull(), "no period").when(period < expected, "stale period").when(period > expected, "period ahead")


def check_bounds(value: Column, lo: Column | float, hi: Column | float) -> Column:
    return F.when(~value.between(lo, hi), "out of bounds")


def check_present(text: Column) -> Column:
    """Placeholders, blanks and NaN."""
    t = F.lower(F.trim(text))
    return F.when(t.isNull() | t.isin("", "-", "--", "n/a", "nan", "tbd", "pending"), "no value")


def check_source(df: DataFrame, allowed: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose source is on the list."""
    return df.join(allowed.select(*on), on, "left_semi")


def check_payload(obs: DataFrame, metrics: DataFrame, key: str = "release_id", metric: str = "source_id") -> DataFrame:
    """Per release: how many defined metrics are present once, and the first problem in definition order.

    Metrics are a bounded dimension; they are laid out as one array and matched inside the
    release's aggregate, so no release is joined with every definition.
    """
    defs = [(r[metric], r["priority"]) for r in sorted(small_rows(metrics.select(metric, "priority")), key=lambda r: r["priority"])]
    counts = obs.groupBy(key, metric).agg(F.count("*").alias("n"), F.count_if(F.col("actual").isNull()).alias("empty"))
    per = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(metric, F.struct("n", "empty")))).alias("m"))

    def reason(name: str) -> Column:
        m = F.try_element_at("m", F.lit(name))
        return F.when(m.isNull(), F.lit(f"{name} missing")).when(m["n"] > 1, F.lit(f"{name} repeated")).when(m["empty"] > 0, F.lit(f"{name} empty"))

    present = reduce(lambda a, b: a + b, (F.coalesce((F.try_element_at("m", F.lit(n))["n"] == 1).cast("int"), F.lit(0)) for n, _ in defs))
    return per.select(key, present.alias("n_present"), first_reason(*(reason(n) for n, _ in defs)).alias("reason"))


def completeness(obs: DataFrame, n_defined: int, key: str = "release_id", metric: str = "source_id") -> DataFrame:
    return obs.groupBy(key).agg(F.count_distinct(metric).alias("n_metrics")).withColumn("complete", F.col("n_metrics") == n_defined)


def single_valued(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Groups with one value of ``column`` only, from its extremes (no distinct count is kept)."""
    ends = df.groupBy(*keys).agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count_if(F.col(column).isNull()).alias("nulls"))
    return ends.select(*keys, ((F.col("lo") == F.col("hi")) & (F.col("nulls") == 0)).alias("consistent"))


# identity of a payload, against its definitions

#: A definition: what the metric of an event must say of itself. ``kind``: mom or yoy.
DEFINITION = "event_name string, row_label string, group_code string, item_code string, kind string, seasonality string, unit string, country string, table_name string, lo double, hi double"
#: How a figure may have been read.
DIRECT_METHODS = ("direct_table_value", "direct_pdf_value")


def _rules(methods: tuple[str, ...]) -> dict[str, Column]:
    """Rule -> whether a measure (``m.``) breaks it, by its definition (``d.``) and the payload's period and from_period; nulls differ from values."""
    m, d = (lambda c: F.col(f"m.{c}")), (lambda c: F.col(f"d.{c}"))
    other = lambda c: ~m(c).eqNullSafe(d(c))
    period, from_period, yearly = F.col("period"), F.col("from_period"), d("kind") == "yoy"
    column = F.when(yearly, C.yoy_label(period)).otherwise(C.mom_label(period))
    return {
        "country": other("country"), "table": other("table_name"), "unit": other("unit"), "period": ~m("period").eqNullSafe(period), "value method": ~F.coalesce(m("value_method").isin(*methods), F.lit(False)),
        "no value": m("actual").isNull() | F.isnan(m("actual")), "out of bounds": ~m("actual").between(d("lo"), d("hi")), "row": ~C.norm_label(m("row_label")).eqNullSafe(C.norm_label(d("row_label"))), "group": other("group_code"), "item": other("item_code"),
        "seasonality": other("seasonality"), "column": ~m("column_label").eqNullSafe(column), "from period": F.when(yearly, m("from_period").isNotNull()).otherwise(from_period.isNotNull() & ~m("from_period").eqNullSafe(from_period)), "no previous": ~yearly & m("previous").isNull(),
    }


def check_identity(payloads: DataFrame, measures: DataFrame, definitions: DataFrame, expected: Column | None = None, methods: tuple[str, ...] = DIRECT_METHODS, key: str = "release_id") -> DataFrame:
    """(key, violations): everything in which a payload is not what its definitions say, none for a good one.

    ``payloads``: key, period, from_period; ``measures``: a row per figure with event_name and the
    fields of a definition, period, from_period, column_label, value_method, actual, previous.
    All violations are listed, 'event: rule', in order of event and rule; 'missing' and 'repeated'
    are of events, 'not defined' of those without a definition, 'stale period' (with ``expected``) of the
    payload. The rules of a figure are one null-safe expression; the definitions, a bounded
    dimension, meet the figures in a join on the event, never each payload.
    """
    names = [r.event_name for r in small_rows(definitions.select("event_name"))]
    figures = measures.select(key, "event_name", F.struct(*[c for c in measures.columns if c not in (key, "event_name")]).alias("m"))
    known = definitions.select("event_name", F.struct(*[c for c in definitions.columns if c != "event_name"]).alias("d"))
    rows = figures.join(known, "event_name", "left").join(payloads.select(key, "period", "from_period"), key)
    rules = _rules(methods)
    broken = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(i).alias("i"), F.lit(name).alias("rule"))) for i, (name, cond) in enumerate(rules.items())]))
    none = F.array(F.struct(F.lit(len(rules)).alias("i"), F.lit("not defined").alias("rule")))
    each = rows.select(key, "event_name", F.when(F.col("d").isNull(), none).otherwise(broken).alias("broken"))
    # of an event's figures, however many: the rules that any breaks
    per = each.select(key, "event_name", F.explode_outer("broken").alias("b")).groupBy(key, "event_name", "b.i", "b.rule").agg(F.count("*").alias("n"))
    counts = measures.groupBy(key, "event_name").agg(F.count("*").alias("n")).select(key, "event_name", F.when(F.col("n") > 1, F.struct(F.lit(len(rules) + 1).alias("i"), F.lit("repeated").alias("rule"))).alias("b"))
    all_of = per.select(key, "event_name", "i", "rule").unionByName(counts.select(key, "event_name", "b.i", "b.rule"))
    seen = all_of.groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.col("rule").isNotNull(), F.struct("event_name", "i", "rule")))).alias("v"), F.collect_set("event_name").alias("events"))
    out = payloads.join(seen, key, "left")
    listed = F.transform(F.coalesce("v", F.array().cast("array<struct<event_name:string,i:int,rule:string>>")), lambda x: F.concat(x["event_name"], F.lit(": "), x["rule"]))
    missing = F.transform(F.array_except(F.array(*map(F.lit, sorted(names))), F.coalesce("events", F.array().cast("array<string>"))), lambda x: F.concat(x, F.lit(": missing")))
    stale = F.when(~F.col("period").eqNullSafe(expected), F.array(F.lit("stale period"))).otherwise(F.array().cast("array<string>")) if expected is not None else F.array().cast("array<string>")
    return out.select(key, F.concat(stale, listed, missing).alias("violations"))


# statements of one document about the same figure


def check_internal(published: Column, derived: Column, tolerance: float) -> Column:
    return F.when(~values_equal(published, derived, tolerance), "differs from the levels")


def check_document(value: Column, block_value: Column, sentence_period: Column, title_period: Column, page_period: Column, column_period: Column, published: Column, level_change: Column, exact: float = 1e-6, rounded: float = 0.05) -> Column:
    """All in which the parts of one document contradict each other; a part that the document lacks contradicts nothing.

    The sentence's figure and that of the metric block, the sentence's period and the title's, the
    page's period and the column's, the published change and the difference of the levels.
    """
    apart = lambda a, b: a.isNotNull() & b.isNotNull() & (a != b)
    rules = {
        "sentence and block differ": ~values_equal(value, block_value, exact), "sentence and title have other periods": apart(sentence_period, title_period),
        "page and column have other periods": apart(page_period, column_period), "change differs from the levels": ~values_equal(published, level_change, rounded),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), name) for name, cond in rules.items()]))


def grade(is_official: Column, is_fallback: Column, has_crosscheck: Column, has_expected: Column) -> Column:
    """HIGH, MEDIUM or LOW."""
    return F.when(~is_official, "LOW").when(is_fallback | ~has_crosscheck, "MEDIUM").when(~has_expected, "MEDIUM").otherwise("HIGH")


def check_schedule(releases: DataFrame, schedule: DataFrame, on: list[str]) -> DataFrame:
    """Releases with ``scheduled``: whether their time or date is published."""
    s = schedule.select(*on).distinct().withColumn("_there", F.lit(True))
    return releases.join(s, on, "left").withColumn("scheduled", F.coalesce("_there", F.lit(False))).drop("_there")
