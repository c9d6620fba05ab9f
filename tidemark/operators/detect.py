"""Change detection over captures: windows, baselines, flags, first hits, ranks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import event_latency_ms

KEY = ("release_id", "source_id")


def _order():
    return Window.partitionBy(*KEY).orderBy("captured_at", "seq")


def in_window(captures: DataFrame, releases: DataFrame, lead: str = "2 seconds", window: str = "3 minutes") -> DataFrame:
    """Captures in [event - lead, event + window]; the release is an equality key of the range join."""
    return captures.join(releases, "release_id").filter(f"captured_at between event_time - interval {lead} and event_time + interval {window}")


def baseline_asof(captures: DataFrame, releases: DataFrame, before: str = "1 minute", fields: tuple[str, ...] = ("seq", "captured_at", "etag", "content_hash", "actual")) -> DataFrame:
    """Per release and source: the last capture at or before the event less ``before``."""
    past = captures.join(releases, "release_id").filter(f"captured_at <= event_time - interval {before}")
    return past.groupBy(*KEY).agg(F.max_by(F.struct(*fields), F.struct("captured_at", "seq")).alias("b")).select(*KEY, *[F.col(f"b.{f}").alias(f"base_{f}") for f in fields])


def join_baseline(captures: DataFrame, baselines: DataFrame) -> DataFrame:
    """Captures with their baseline; a missing one counts as changed."""
    changed = F.col("base_seq").isNull() | ~F.col("actual").eqNullSafe(F.col("base_actual"))
    return captures.join(baselines, list(KEY), "left").withColumn("changed", changed)


#: Per policy: fields compared, and whether a blank on either side hides a difference.
POLICY = "policy string, source_id string, use_status boolean, use_etag boolean, use_modified boolean, use_hash boolean, use_period boolean, use_value boolean, blank_is_same boolean"
#: That of a source which no policy names: every field counts. ``validity_only``, a column that policies may
#: have besides, makes a valid capture count whether it differs or not.
DEFAULT = {f: True for f in ("use_status", "use_etag", "use_modified", "use_hash", "use_period", "use_value", "blank_is_same")} | {"validity_only": False}
#: Fields of the headers and of the content, with the switch of each.
HEADERS = {"status_code": "use_status", "etag": "use_etag", "last_modified": "use_modified"}
CONTENT = {"content_hash": "use_hash", "period": "use_period", "actual": "use_value"}


def differs(now: Column, before: Column, blank_is_same: Column) -> Column:
    n, b = F.coalesce(now.cast("string"), F.lit("")), F.coalesce(before.cast("string"), F.lit(""))
    return F.when(blank_is_same, (n != "") & (b != "") & (n != b)).otherwise(n != b)


def detect_changes(captures: DataFrame, policies: DataFrame) -> DataFrame:
    """headers_changed and content_changed against the capture before, by each source's policy.

    The policy is a row of a small table, not a branch of code; a source without one has the
    default. Fields that the captures lack are not compared. A first capture has no
    predecessor and counts as unchanged.
    """
    fields = compared(captures)
    prev = with_policies(captures.withColumn("_p", F.lag(F.struct(*fields, F.lit(True).alias("_there"))).over(_order())), policies)
    there = F.col("_p._there").isNotNull()
    flags = {name: there & any_differs(of, fields, F.col, lambda c: F.col(f"_p.{c}")) for name, of in (("headers_changed", HEADERS), ("content_changed", CONTENT))}
    return prev.withColumns(flags).drop("_p")


def compared(captures: DataFrame) -> list[str]:
    """The fields of HEADERS and CONTENT that the captures have."""
    return [c for c in (*HEADERS, *CONTENT) if c in captures.columns]


def with_policies(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """``rows`` with the switches of their source, or the default."""
    known = rows.join(policies, "source_id", "left")
    return known.withColumns({c: F.coalesce(c, F.lit(v)) if c in policies.columns else F.lit(v) for c, v in DEFAULT.items()})


def any_differs(of: dict[str, str], fields: list[str], now: Callable[[str], Column], before: Callable[[str], Column]) -> Column:
    """Whether a field of ``of`` that counts differs."""
    parts = [F.col(use) & differs(now(c), before(c), F.col("blank_is_same")) for c, use in of.items() if c in fields]
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def changed_captures(captures: DataFrame, policies: DataFrame, valid: Column | None = None) -> DataFrame:
    """(release_id, source_id, seq, method) of the valid captures that differ from the one before, or need not by their policy."""
    rows = detect_changes(captures.withColumn("_valid", F.coalesce(valid if valid is not None else F.lit(True), F.lit(False))), policies)
    method = F.coalesce(detection_method(F.col("headers_changed"), F.col("content_changed")), F.when(F.col("validity_only"), "valid"))
    return rows.withColumn("method", method).filter(F.col("_valid") & F.col("method").isNotNull()).select(*KEY, "seq", "method")


# from captures to the first valid change of each source


def until_close(captures: DataFrame, window: str, lookback: str) -> DataFrame:
    """Captures from ``lookback`` before their event to ``window`` after it, with the end of the window, ``closes``."""
    rows = captures.withColumn("closes", F.expr(f"event_time + interval {window}"))
    return rows.filter(F.col("captured_at").between(F.expr(f"event_time - interval {lookback}"), F.col("closes")))


def versions(captures: DataFrame, good: Column, valid: Column, before: str = "1 minute", lead: str = "2 seconds") -> DataFrame:
    """One row per release, source and version of its document, that is, the fields that are compared.

    base_at: its last capture up to ``before`` the event, first_at: its first in the window; both
    (captured_at, seq). ``good``: the fetch gave a value; only such a version can be a baseline.
    However often a source is polled, what goes on from here has a row for each version. The
    captures have ``event_time`` and ``closes``; in a stream the latter is the event time.
    """
    at, known = F.struct("captured_at", "seq"), lambda c: F.coalesce(c, F.lit(False))
    early, inside = F.expr(f"captured_at <= event_time - interval {before}"), F.expr(f"captured_at >= event_time - interval {lead}")
    error = F.col("error") if "error" in captures.columns else F.lit(None).cast("string")
    return captures.groupBy(*KEY, "event_time", "closes", *compared(captures), known(good).alias("good"), known(valid).alias("valid")).agg(
        F.max(F.when(early, at)).alias("base_at"), F.min(F.when(inside, at)).alias("first_at"), F.count("*").alias("polls"), F.max(F.when(error.isNotNull(), F.struct("captured_at", "seq", error.alias("error")))).alias("failed"),
    )


def hits_of_versions(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """Per release and source: its last good baseline, and its first capture in the window that is valid and differs from it.

    Columns: release_id, source_id, event_time, closes, base (the fields, null without a good
    capture before the event), hit (captured_at, seq, actual, method; null without one), polls,
    last_error. Without a baseline every valid capture counts as changed.
    """
    fields = compared(rows)
    document = F.struct(*fields)
    seen = F.collect_list(F.when(F.col("first_at").isNotNull() & F.col("valid"), F.struct("first_at", document.alias("d"))))
    base = F.max(F.when(F.col("good") & F.col("base_at").isNotNull(), F.struct("base_at", document.alias("d"))))
    per = rows.groupBy(*KEY, "event_time", "closes").agg(base.alias("_b"), seen.alias("_seen"), F.sum("polls").alias("polls"), F.max("failed").alias("_failed"))
    per = with_policies(per, policies).withColumn("base", F.col("_b.d"))

    def method(x: Column) -> Column:
        flags = [any_differs(of, fields, lambda c: x["d"][c], lambda c: F.col("base")[c]) for of in (HEADERS, CONTENT)]
        return F.when(F.col("base").isNull(), "no baseline").otherwise(F.coalesce(detection_method(*flags), F.when(F.col("validity_only"), "valid")))

    hits = F.filter(F.transform("_seen", lambda x: F.struct(x["first_at"]["captured_at"].alias("captured_at"), x["first_at"]["seq"].alias("seq"), x["d"]["actual"].alias("actual"), method(x).alias("method"))), lambda x: x["method"].isNotNull())
    return per.select(*KEY, "event_time", "closes", "base", F.array_min(hits).alias("hit"), "polls", F.col("_failed.error").alias("last_error"))


def detection_method(headers: Column, content: Column) -> Column:
    return F.when(headers & content, "headers+content").when(headers, "headers").when(content, "content")


def content_checks(captures: DataFrame, n: int = 5) -> DataFrame:
    """Which polls read the content: every n-th, and at once those whose headers changed."""
    poll = F.row_number().over(_order())
    changed = ~F.col("etag").eqNullSafe(F.lag("etag").over(_order())) & F.lag("seq").over(_order()).isNotNull()
    return captures.withColumns({"poll_no": poll, "check_content": (poll % n == 0) | changed})


def first_hits(captures: DataFrame, fields: tuple[str, ...] = ("seq", "captured_at", "actual")) -> DataFrame:
    """First capture per release and source: an aggregate, so that partial results combine before the shuffle."""
    return captures.groupBy(*KEY).agg(F.min_by(F.struct(*fields), F.struct("captured_at", "seq")).alias("h")).select(*KEY, "h.*")


def latencies(hits: DataFrame, releases: DataFrame) -> DataFrame:
    return hits.join(releases, "release_id").withColumn("latency_ms", event_latency_ms(F.col("captured_at"), F.col("event_time")))


def leaderboard(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Rank of each source per release by time, then priority, then name."""
    by = Window.partitionBy("release_id").orderBy("captured_at", "priority", "source_id")
    return hits.join(sources, "source_id").withColumn("rank", F.row_number().over(by))


def winner(hits: DataFrame, sources: DataFrame) -> DataFrame:
    ranked = hits.join(sources, "source_id").groupBy("release_id").agg(F.min_by(F.struct("source_id", "captured_at"), F.struct("captured_at", "priority", "source_id")).alias("w"))
    return ranked.select("release_id", "w.*")


def pending_sources(releases: DataFrame, sources: DataFrame, hits: DataFrame) -> DataFrame:
    """Sources of each release without a hit; the sources are a bounded dimension, laid out as an array."""
    names = sources.agg(F.collect_list("source_id").alias("_s"))
    pairs = releases.select("release_id").join(F.broadcast(names)).select("release_id", F.explode("_s").alias("source_id"))
    return pairs.join(hits, list(KEY), "left_anti")


def poll_stats(captures: DataFrame, error: Column) -> DataFrame:
    e = captures.withColumn("_e", error)
    last = F.max_by(F.when(F.col("_e").isNotNull(), F.col("_e")), F.when(F.col("_e").isNotNull(), F.struct("captured_at", "seq")))
    return e.groupBy(*KEY).agg(F.count("*").alias("polls"), F.count("_e").alias("errors"), last.alias("last_error"))


def valid_updates(captures: DataFrame, baselines: DataFrame, expected: Column, lo: float, hi: float) -> DataFrame:
    """Captures of the expected period, within bounds, that differ from their baseline."""
    return join_baseline(captures, baselines).filter(expected & F.col("actual").between(lo, hi) & F.col("changed"))


def is_new_item(date: Column, url: Column, base_date: Column, base_url: Column, expected: Column) -> Column:
    """With an expected date: that date at another address; else a newer date, or the same at another address."""
    other = ~url.eqNullSafe(base_url)
    return F.when(expected.isNotNull(), (date == expected) & other).otherwise((date > base_date) | ((date == base_date) & other) | base_date.isNull())


def prefer_expected(snapshots: DataFrame, expected: Column, fields: tuple[str, ...]) -> DataFrame:
    """Per release and source: a snapshot of the expected period before any other, then the newest."""
    return snapshots.groupBy(*KEY).agg(F.max_by(F.struct(*fields), F.struct(expected.cast("int"), F.col("captured_at"), F.col("seq"))).alias("x")).select(*KEY, "x.*")


def best_by_kind(hits: DataFrame, kind: Column, kinds: list[str]) -> DataFrame:
    """One column per kind: the first hit's time in ms, null without one."""
    at = F.unix_millis(F.col("captured_at").cast("timestamp"))
    return hits.groupBy("release_id").agg(*[F.min(F.when(kind == k, at)).alias(k) for k in kinds])


def top2_agree(ranked: DataFrame, value: str = "actual") -> DataFrame:
    """Whether the two first sources of a release give the same value; null with fewer than two."""
    two = ranked.filter("rank <= 2").groupBy("release_id").agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return two.select("release_id", "n", F.when(F.col("n") == 2, F.col("lo") == F.col("hi")).alias("agree"))
