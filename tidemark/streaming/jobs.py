"""Structured Streaming jobs: change detection, first hits, races, deadlines, confirmations.

Streams carry release_id, source_id, seq, captured_at (timestamp), event_time and the fields of
captures. Every job goes by event time: captures may arrive in any order, up to ``delay`` behind
the newest, and the rows are those of the job's batch twin once the watermark has passed them.
Later ones are dropped, as watermarks do. First hits, releases and their confirmation are
streaming aggregations, closed by the watermark; change detection, races and deadlines keep a
state of their own, which timers empty.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..operators import detect as D
from ..plans import reconcile as R
from ..sources.epochs import EpochTable, stream_into
from ..sources.staging import settings, shared_path, small_rows

ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_once(stream: DataFrame, name: str, mode: str = "append", rocks: bool = False, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """The stream run to the end of what is there, written to the shared folder and read back.

    With the same ``checkpoint`` and ``out`` a later run goes on where the last one stopped.
    """
    spark = stream.sparkSession
    out, place = out or shared_path(spark, name), checkpoint or shared_path(spark, f"{name}-checkpoint")
    with settings(spark, ROCKS if rocks else {}):
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def millis(interval: str) -> int:
    """Milliseconds of an interval of fixed length, such as '3 days'."""
    unit = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
    words = interval.split()
    return sum(int(n) * unit[u.rstrip("s")] for n, u in zip(words[::2], words[1::2], strict=True))


def _between(at: str, window: str, lead: str = "2 seconds") -> Column:
    """Whether ``at`` lies in its event's window.

    Bounds of a row without an event are its own time: nothing that can be decided without
    ``at`` is left to decide, which Spark would do before the watermark sees the row.
    """
    return F.col(at).between(F.coalesce(F.expr(f"event_time - interval {lead}"), F.col(at)), F.coalesce(F.expr(f"event_time + interval {window}"), F.col(at)))


def _there(column: str, at: str) -> Column:
    """``column``, in a form that is evaluated behind the watermark of ``at``."""
    return F.when(F.col(at).isNotNull(), F.col(column))


# in order of time


class InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, and takes them in order of time.

    A timer at the end of each slice of time releases the rows up to it; none can arrive for
    that slice any more. A key without rows for ``idle`` after its last one loses its state.
    The rows of a batch are held as one packed value, since every row of a state is
    converted on its own on its way to the store and back.
    ``columns``: a schema that begins with at (microseconds) and seq.
    """

    def __init__(self, columns: str, slice_ms: int, idle_ms: int):
        self.columns, self.slice, self.idle = columns, max(1, slice_ms), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.last = handle.getValueState("last", self.columns)

    def end(self, at: int) -> int:
        """The end of the slice that holds ``at``, in milliseconds."""
        return -(-at // (1000 * self.slice)) * self.slice

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001
        new = [tuple(r[len(key) :]) for r in rows]
        self.held.appendValue((pickle.dumps(new),))
        for end in {self.end(r[0]) for r in new}:
            self.handle.registerTimer(end)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held, known = [r for (packed,) in self.held.get() for r in pickle.loads(packed)], self.last.get()  # each call goes to the store
        due = sorted((r for r in held if self.end(r[0]) <= now), key=lambda r: r[:2])
        last = due[-1] if due else known
        if due:
            yield from self.taken(key, known, due)
            if len(due) < len(held):
                self.held.put([(pickle.dumps([r for r in held if self.end(r[0]) > now]),)])
            else:
                self.held.clear()
        gone = self.end(last[0]) + self.idle if last else now
        if gone <= now and len(due) == len(held):
            if known:
                self.last.clear()
        elif due:
            self.last.update(last)
            self.handle.registerTimer(gone)

    def taken(self, key: tuple, last: tuple | None, due: list[tuple]) -> Iterator[Row]:
        """What comes of the rows ``due``, in order, after ``last``."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class ChangeDetector(InOrder):
    """A row for each valid capture that differs from the one before it, by its source's policy.

    ``policies``: source -> the switches of the fields, whether a blank on either side hides a
    difference, and whether validity alone decides. A source without one has the default.
    """

    def __init__(self, columns: str, fields: list[str], policies: dict[str, dict[str, bool]], slice_ms: int, idle_ms: int):
        super().__init__(columns, slice_ms, idle_ms)
        self.fields, self.policies = fields, policies

    def taken(self, key: tuple, last: tuple | None, due: list[tuple]) -> Iterator[Row]:
        policy = self.policies.get(key[1], D.DEFAULT)
        place = {f: 3 + i for i, f in enumerate(self.fields)}  # after at, seq, valid

        def differs(of: dict[str, str], now: tuple, before: tuple) -> bool:
            pairs = [("" if now[place[f]] is None else now[place[f]], "" if before[place[f]] is None else before[place[f]]) for f, use in of.items() if f in place and policy[use]]
            return any(n != b and not (policy["blank_is_same"] and "" in (n, b)) for n, b in pairs)

        for row in due:
            headers, content = (bool(last) and differs(of, row, last) for of in (D.HEADERS, D.CONTENT))
            if row[2] and (headers or content or policy["validity_only"]):
                yield Row(release_id=key[0], source_id=key[1], seq=row[1], method="headers+content" if headers and content else "headers" if headers else "content" if content else "valid")
            last = row


def detect_changes_stream(captures: DataFrame, policies: DataFrame | None = None, valid: Column | None = None, delay: str = "1 hour", idle: str = "60 days") -> DataFrame:
    """(release_id, source_id, seq, method): what ``detect.changed_captures`` finds in a table.

    Compared are the fields of ``detect.HEADERS`` and ``detect.CONTENT`` that the captures have.
    ``policies``: a row per source, a bounded dimension. A source that comes back after ``idle``
    counts as new.
    """
    fields = D.compared(captures)
    kinds = {f.name: f.dataType.simpleString() for f in captures.schema.fields}
    columns = ", ".join(["at long", "seq long", "valid boolean", *[f"{c} {kinds[c]}" for c in fields]])
    known = {}
    for r in small_rows(policies) if policies is not None else []:
        known[r.source_id] = D.DEFAULT | {k: v for k, v in r.asDict().items() if k in D.DEFAULT and v is not None}
    rows = captures.withWatermark("captured_at", delay).filter(_there("release_id", "captured_at").isNotNull())
    rows = rows.select("release_id", "source_id", F.unix_micros("captured_at").alias("at"), F.col("seq").cast("long").alias("seq"), F.coalesce(valid if valid is not None else F.lit(True), F.lit(False)).alias("valid"), *fields, "captured_at")
    detector = ChangeDetector(columns, fields, known, millis(delay), millis(idle))
    return rows.groupBy("release_id", "source_id").transformWithState(detector, "release_id long, source_id string, seq long, method string", "Append", "EventTime")


# closed by the watermark


def closing(captures: DataFrame, window: str, delay: str, lookback: str = "2 seconds") -> DataFrame:
    """Captures from ``lookback`` before their event to ``window`` after it, with ``closes``, the end of the window, as event time.

    A window's end lies at most ``lookback`` and ``window`` after any of its captures, so a watermark
    that much, and ``delay``, behind the newest end is behind every capture that may still arrive.
    Rows without a release only move the watermark on; their source is a blank, so that no join
    on it drops them before.
    """
    closes = F.coalesce(F.expr(f"event_time + interval {window}"), F.col("captured_at"))
    marked = captures.withColumns({"closes": closes, "source_id": F.coalesce("source_id", F.lit(""))}).withWatermark("closes", f"{millis(window) + millis(lookback) + millis(delay)} milliseconds")
    inside = F.col("captured_at").between(F.expr(f"closes - interval {window} - interval {lookback}"), F.col("closes"))
    return marked.filter(inside & _there("release_id", "closes").isNotNull())


def first_hit_stream(captures: DataFrame, window: str = "3 days", delay: str = "1 hour") -> DataFrame:
    """(release_id, source_id, seq, captured_at): the first capture in time of each release and source, out when its window is closed."""
    first = closing(captures, window, delay).groupBy("release_id", "source_id", "closes").agg(F.min(F.struct("captured_at", "seq")).alias("h"))
    return first.select("release_id", "source_id", "h.seq", "h.captured_at")


class Race(StatefulProcessor):
    """The first valid source of a release in time wins, as soon as no earlier capture can arrive."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "at long, source_id string, seq long, done boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001
        new = list(rows)
        first = min((r.at, r.source_id, r.seq) for r in new)
        known = self.best.get()
        if not known:
            self.handle.registerTimer(new[0].closes_ms)
        if not known or not known[3] and first < tuple(known[:3]):
            self.best.update((*first, False))
            self.handle.registerTimer(-(-first[0] // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001
        now = expiredTimerInfo.getExpiryTimeInMs()
        known = self.best.get()
        if known and not known[3] and known[0] <= 1000 * now:
            yield Row(release_id=key[0], source_id=known[1], seq=known[2])
            self.best.update((*known[:3], True))
        if known and now >= self._closes(key, known, timerValues, now):
            self.best.clear()

    def _closes(self, key, known, timerValues, now: int) -> int:  # noqa: ANN001
        """The last of the key's timers, which is that of its window's end."""
        return max([now, *self.handle.listTimers()])

    def close(self) -> None:
        pass


def race_stream(captures: DataFrame, valid: Column | None = None, window: str = "3 days", delay: str = "1 hour") -> DataFrame:
    """(release_id, source_id, seq): the winner of each release among its valid captures; its state goes when the window ends."""
    rows = captures.withWatermark("captured_at", delay)
    decided = F.when(F.col("captured_at").isNotNull(), valid if valid is not None else F.lit(True))
    rows = rows.filter(_between("captured_at", window) & decided & _there("release_id", "captured_at").isNotNull())
    rows = rows.select("release_id", "source_id", F.col("seq").cast("long").alias("seq"), F.unix_micros("captured_at").alias("at"), F.unix_millis(F.expr(f"event_time + interval {window}")).alias("closes_ms"), "captured_at")
    return rows.groupBy("release_id").transformWithState(Race(), "release_id long, source_id string, seq long", "Append", "EventTime")


class Deadline(StatefulProcessor):
    """Emits NOT_CONFIRMED for a release when its deadline passes without a hit of the primary source."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "hit boolean, at long, seq long, last_error string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001
        new = list(rows)
        known = self.seen.get()
        if not known:
            self.handle.registerTimer(new[0].deadline_ms)
        errors = [(r.at, r.seq, r.error) for r in new if r.error is not None] + ([tuple(known[1:])] if known and known[3] is not None else [])
        last = max(errors, key=lambda x: x[:2], default=(None, None, None))
        self.seen.update((bool(known and known[0]) or any(r.is_hit for r in new), *last))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001
        known = self.seen.get()
        if known and not known[0]:
            yield Row(release_id=key[0], status="NOT_CONFIRMED", last_error=known[3])
        self.seen.clear()

    def close(self) -> None:
        pass


def deadline_stream(captures: DataFrame, window: str = "3 days", primary: str = "purchase", error: Column | None = None, delay: str = "0 seconds") -> DataFrame:
    """Releases whose window ends without a primary hit, with the last error before its end; timers, so the watermark must move on."""
    at = F.col("captured_at")
    until = captures.withWatermark("captured_at", delay).filter((at <= F.coalesce(F.expr(f"event_time + interval {window}"), at)) & _there("release_id", "captured_at").isNotNull())
    hit = (F.col("source_id") == primary) & F.expr("captured_at >= event_time - interval 2 seconds")
    error = error if error is not None else F.when(F.col("source_id") == "error", F.col("etag"))
    rows = until.select("release_id", F.unix_micros("captured_at").alias("at"), F.col("seq").cast("long").alias("seq"), error.alias("error"), hit.alias("is_hit"), F.unix_millis(F.expr(f"event_time + interval {window}")).alias("deadline_ms"), "captured_at")
    return rows.groupBy("release_id").transformWithState(Deadline(), "release_id long, status string, last_error string", "Append", "EventTime")


def in_poll_window(captures: DataFrame, window: str = "3 days") -> DataFrame:
    return captures.filter(f"captured_at between event_time - interval 2 seconds and event_time + interval {window}")


def confirm_stream(captures: DataFrame, primary: str = "purchase", window: str = "3 days", delay: str = "1 hour") -> DataFrame:
    """Primary captures joined with later captures of other sources within the window.

    Left outer: a primary that the watermark passes without a partner comes out as
    NOT_UPDATED. Both sides carry watermarks and a time bound, so state is let go. Rows
    without an event only move the watermarks on.
    """
    at = F.col("captured_at")
    marked = captures.select(F.coalesce("release_id", F.lit(-1)).alias("release_id"), "source_id", "seq", "actual", "event_time", at.alias("l_at"), at.alias("r_at"))
    left = marked.drop("r_at").withWatermark("l_at", delay).filter(_between("l_at", window) & (_there("source_id", "l_at") == primary))
    right = marked.drop("l_at").withWatermark("r_at", delay).filter(_between("r_at", window) & (_there("source_id", "r_at") != primary))
    left = left.select(F.col("release_id").alias("l_release"), F.col("seq").alias("l_seq"), "l_at", F.col("actual").alias("l_actual"))
    right = right.select(F.col("release_id").alias("r_release"), F.col("source_id").alias("r_source"), F.col("seq").alias("r_seq"), "r_at", F.col("actual").alias("r_actual"))
    joined = left.join(right, F.expr(f"l_release = r_release and r_at >= l_at and r_at <= l_at + interval {window}"), "left_outer")
    status = F.when(F.col("r_seq").isNull(), "NOT_UPDATED").when(F.abs(F.col("l_actual") - F.col("r_actual")) < 1e-6, "CONFIRMED").otherwise("MISMATCH")
    return joined.select(F.col("l_release").alias("release_id"), "l_seq", "r_seq", F.col("r_source").alias("source_id"), status.alias("status"))


def release_stream(captures: DataFrame, sources: DataFrame, policies: DataFrame, good: Column, valid: Column, scheduled: Column | None = None, window: str = "3 days", lookback: str = "10 days", before: str = "1 minute", delay: str = "1 hour") -> DataFrame:
    """From captures to confirmed releases in one job: three streaming aggregations, each handing the window's end on as event time.

    Versions of each source's document, then its baseline and first hit, then the release; the
    expressions are those of ``detect.versions``, ``detect.hits_of_versions`` and
    ``reconcile.confirm_hits``, which run on a table as well.
    """
    inside = closing(captures, window, delay, lookback)
    hits = D.hits_of_versions(D.versions(inside, good, valid, before), policies)
    return R.confirm_hits(hits, sources, scheduled)


# tables kept up to date


HITS = "release_id long, source_id string, captured_at timestamp, seq long"


def _earliest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("release_id", "source_id").agg(F.min(F.struct("captured_at", "seq")).alias("h")).select("release_id", "source_id", "h.*")


def leaderboard_stream(captures: DataFrame, path: str | None = None, checkpoint: str | None = None, compact_after: int = 50) -> DataFrame:
    """First hits kept up to date batch by batch in an epoch table at ``path``; its rows, ranked per release.

    A hit is a minimum, so a batch adds the first hits among its own rows, and readers merge.
    With the same ``path`` and ``checkpoint`` a later run goes on where the last one stopped.
    """
    spark: SparkSession = captures.sparkSession
    path, checkpoint = path or shared_path(spark, "leaderboard"), checkpoint or shared_path(spark, "leaderboard-checkpoint")
    board = EpochTable(spark, path, HITS, _earliest, compact_after)
    stream_into(board, in_poll_window(captures).select("release_id", "source_id", "captured_at", "seq"), checkpoint, _earliest)
    by = Window.partitionBy("release_id").orderBy("captured_at", "source_id")
    return board.read().withColumn("rank", F.row_number().over(by))


DOCUMENTS = "release_id long, document string"


def document_stream(documents: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """A stream of (release_id, document) written epoch by epoch; the documents that are committed."""
    table = EpochTable(documents.sparkSession, path, DOCUMENTS)
    stream_into(table, documents.select("release_id", "document"), checkpoint)
    return table.read()
