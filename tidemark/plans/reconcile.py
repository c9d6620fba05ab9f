"""Reconciliation of the sources of a release: classification, value source, confirmation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import event_latency_ms, values_equal
from ..sources.staging import small_rows

TOLERANCE = 1e-6


def compare_payloads(a: DataFrame, b: DataFrame, keys: list[str], value: str = "actual", tolerance: float = TOLERANCE) -> DataFrame:
    """Full comparison by key: equal, differs, only_a, only_b."""
    left, right = a.select(*keys, F.col(value).alias("a")), b.select(*keys, F.col(value).alias("b"))
    outcome = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").when(values_equal(F.col("a"), F.col("b"), tolerance), "equal").otherwise("differs")
    return left.join(right, keys, "full_outer").withColumn("outcome", outcome)


def classify_confirmations(releases: DataFrame, obs: DataFrame, sources: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(release_id, source_id, status, detail) for every confirming source of every release.

    NOT_UPDATED without an observation, ERROR where there is one but no primary value, else
    CONFIRMED or MISMATCH against it. All observations of a release meet in one aggregate keyed by
    release; the sources are a small dimension whose ids become literals.
    """
    rows = [(r.source_id, r.is_primary) for r in sorted(small_rows(sources), key=lambda r: r.priority)]
    primary, others = next(s for s, p in rows if p), [s for s, p in rows if not p]
    per = obs.groupBy("release_id").agg(F.map_from_entries(F.collect_list(F.struct("source_id", "actual"))).alias("m"))
    each = releases.select("release_id").join(per, "release_id", "left").withColumn("source_id", F.explode(F.array(*map(F.lit, others))))
    p, v = F.try_element_at("m", F.lit(primary)), F.try_element_at("m", F.col("source_id"))
    status = F.when(v.isNull(), "NOT_UPDATED").when(p.isNull(), "ERROR").when(values_equal(p, v, tolerance), "CONFIRMED").otherwise("MISMATCH")
    detail = F.when(v.isNull(), "no observation").when(p.isNull(), "no primary value").otherwise(F.format_string("%.1f against %.1f", v, p))
    return each.select("release_id", "source_id", status.alias("status"), detail.alias("detail"))


def select_value_source(obs: DataFrame, sources: DataFrame, usable: Column | None = None) -> DataFrame:
    """The usable value of best priority per release, and a warning where it isn't the primary's."""
    rows = obs.join(sources.filter("is_value"), "source_id")
    rows = rows.filter(usable) if usable is not None else rows
    best = rows.groupBy("release_id").agg(F.min_by(F.struct("source_id", "actual", "is_primary"), F.struct("priority", "source_id")).alias("x"))
    return best.select("release_id", "x.source_id", "x.actual", F.when(~F.col("x.is_primary"), F.concat(F.lit("value from backup "), F.col("x.source_id"))).alias("warning"))


def fill_from_backup(primary: DataFrame, backup: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Missing values filled from the backup, with method and warnings."""
    b = backup.select(*keys, F.col(value).alias("_b"))
    joined = primary.join(b, keys, "left")
    missing = F.col(value).isNull() & F.col("_b").isNotNull()
    return joined.select(
        *keys, F.coalesce(value, "_b").alias(value), F.when(missing, "backup").when(F.col(value).isNotNull(), "primary").alias("value_method"),
        F.when(missing, F.array(F.lit(f"{value} filled from backup"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def collect_ordered(rows: DataFrame, order: str, value: str, key: str = "release_id", name: str = "matched_sources") -> DataFrame:
    """Unique values per release in priority order."""
    pairs = F.array_sort(F.collect_set(F.struct(F.col(order).alias("at"), F.col(value).alias("v"))))
    return rows.groupBy(key).agg(F.array_distinct(F.transform(pairs, lambda x: x["v"])).alias(name))


def confirm_releases(releases: DataFrame, obs: DataFrame, sources: DataFrame, scheduled: Column | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(release_id, status, reason, actual, matched_sources, warnings) of every release.

    The primary is mandatory, every source that has a value must agree, and the schedule,
    where given, must confirm. One aggregate per release; no row is compared with another.
    """
    seen = obs.join(sources, "source_id")
    one = lambda cond: F.max_by(F.when(cond, F.col("actual")), cond)
    per = seen.groupBy("release_id").agg(one(F.col("is_primary")).alias("actual"), F.array_sort(F.collect_list(F.struct("priority", "source_id", F.col("actual").alias("v"), "is_primary"))).alias("all"))
    per = releases.join(per, "release_id", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<priority:int,source_id:string,v:double,is_primary:boolean>>")))
    reason, matched, warnings = _outcome(scheduled, tolerance)
    out = per.withColumn("reason", reason)
    return out.select("release_id", F.when(F.col("reason").isNull(), "CONFIRMED").otherwise("NOT_CONFIRMED").alias("status"), "reason", "actual", matched.alias("matched_sources"), warnings.alias("warnings"))


def _outcome(scheduled: Column | None, tolerance: float) -> tuple[Column, Column, Column]:
    """Reason against, agreeing sources and warnings, from ``actual``, the primary's value, and ``all``: (priority, source_id, v, is_primary) of each source with one."""
    agree = F.filter("all", lambda x: values_equal(x["v"], F.col("actual"), tolerance))
    apart = F.filter("all", lambda x: ~values_equal(x["v"], F.col("actual"), tolerance))
    names = lambda rows: F.transform(rows, lambda x: x["source_id"])
    ok_time = scheduled if scheduled is not None else F.lit(True)
    reason = F.when(F.col("actual").isNull(), "primary missing").when(F.size(apart) > 0, F.concat(F.lit("differs: "), F.array_join(names(apart), ","))).when(~ok_time, "not scheduled").when(F.size(agree) < 2, "no confirming source")
    warnings = F.transform(F.filter(apart, lambda x: ~x["is_primary"]), lambda x: F.concat(x["source_id"], F.lit(" differs")))
    return reason, names(agree), warnings


def confirm_hits(hits: DataFrame, sources: DataFrame, scheduled: Column | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Each release from its sources' first hits (``detect.hits_of_versions``): status, reason, actual, matched sources, warnings, winner and its latency.

    One aggregate per release, in a table or a stream; sources without a hit are named as
    pending, and the primary's last error is kept where it has none.
    """
    names = [r.source_id for r in sorted(small_rows(sources), key=lambda r: (r.priority, r.source_id))]
    seen = hits.join(sources, "source_id")
    one = lambda value: F.max(F.when(F.col("is_primary"), value))
    found = F.when(F.col("hit.actual").isNotNull(), F.struct("priority", "source_id", F.col("hit.actual").alias("v"), "is_primary"))
    first = F.min(F.when(F.col("hit").isNotNull(), F.struct("hit.captured_at", "priority", "source_id")))
    per = seen.groupBy("release_id", "event_time", "closes").agg(one(F.col("hit.actual")).alias("actual"), one(F.col("last_error")).alias("last_error"), F.array_sort(F.collect_list(found)).alias("all"), first.alias("_first"))
    reason, matched, warnings = _outcome(scheduled, tolerance)
    pending = F.array_except(F.array(*map(F.lit, names)), F.transform("all", lambda x: x["source_id"]))
    out = per.withColumn("reason", reason)
    return out.select(
        "release_id", F.when(F.col("reason").isNull(), "CONFIRMED").otherwise("NOT_CONFIRMED").alias("status"), "reason", "actual", matched.alias("matched_sources"), warnings.alias("warnings"), pending.alias("pending_sources"),
        F.col("_first.source_id").alias("winner"), event_latency_ms(F.col("_first.captured_at"), F.col("event_time")).alias("latency_ms"), F.when(F.col("actual").isNull(), F.col("last_error")).alias("last_error"),
    )


def verify_third_party(official: DataFrame, rows: DataFrame, keys: list[str], value: str, tolerance: float, at: str) -> DataFrame:
    """Each official figure with its earliest third-party row within the tolerance, and the delay in ms."""
    r = rows.select(*keys, F.col(value).alias("_v"), F.unix_millis(F.col(at).cast("timestamp")).alias("_at"))
    joined = official.withColumn("_o", F.unix_millis(F.col(at).cast("timestamp"))).join(r, keys).filter((F.abs(F.col(value) - F.col("_v")) < tolerance) & (F.col("_at") >= F.col("_o")))
    return joined.groupBy(*keys).agg(F.min(F.col("_at") - F.col("_o")).alias("delay_ms"), F.count("*").alias("n_rows"))


#: Extractors by source kind: name of an output column -> its expression over a capture.
EXTRACTORS: dict[str, dict[str, Column]] = {}


def register_extractor(kind: str, extractor: dict[str, Column]) -> None:
    """Makes ``extractor`` the one for captures of a kind."""
    EXTRACTORS[kind] = extractor


def dispatch(captures: DataFrame, keep: list[str], extractors: dict[str, dict[str, Column]] | None = None, kind: str = "kind") -> DataFrame:
    """``keep``, the kind, all extractors' columns and ``reason`` of every capture, in one pass.

    A column that a kind's extractor does not give is null; a kind without one has the
    reason 'no extractor'.
    """
    known = EXTRACTORS if extractors is None else extractors
    k = F.col(kind)
    names = list(dict.fromkeys(name for e in known.values() for name in e))
    columns = [reduce(lambda rest, x, n=name: F.when(k == x[0], x[1][n]).otherwise(rest) if n in x[1] else rest, known.items(), F.lit(None)).alias(name) for name in names]
    there = reduce(lambda a, x: a | k.eqNullSafe(x), known, F.lit(False))
    return captures.select(*keep, kind, *columns, F.when(~there, "no extractor").alias("reason"))


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """Results of all sources under one schema; error rows stay rows."""
    out = None
    for name, df in parts.items():
        one = df.withColumn("source_id", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
