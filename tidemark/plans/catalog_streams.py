"""Registered queries: streaming jobs over files of captures that come in no order of time, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators.detect import POLICY
from ..sources import fixtures as X
from ..sources import readers, sinks
from ..sources.fixtures import event_time
from ..sources.staging import shared_path
from ..streaming import jobs as J
from .reconcile import confirm_hits
from .registry import query, views

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
#: Captures of any age are waited for: each file holds some of the whole month.
DELAY = "40 days"


def log(spark, d, max_files=2):
    """The capture log in four files, each with a part of every day, and a heartbeat at the end."""
    return readers.stream_captures(spark, X.capture_files(spark, d), X.LOG, max_files)


def captures(spark, d):
    """Without failures: etag and value of every capture."""
    rows = readers.stream_captures(spark, f"{d}/event[s].parquet", EVENTS)
    rows = rows.select(F.col("user_id").alias("release_id"), F.col("event_type").alias("source_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("captured_at"), F.col("props").alias("etag"), F.floor(F.col("value") / 100).cast("double").alias("actual"))
    return rows.withColumn("event_time", event_time().cast("timestamp"))


@query("stream_scan", f"{views('captures')} select release_id, source_id, seq, actual from captures")
def stream_scan(spark, d):
    return J.run_once(captures(spark, d).select("release_id", "source_id", "seq", "actual"), "scan")


_LAG = "lag({0}) over (partition by release_id, source_id order by captured_at, seq)"


@query("stream_change_detect", f"""{views('log')}, f as (select *, {_LAG.format("seq")} is not null there, {_LAG.format("etag")} pe, {_LAG.format("actual")} pa from log), g as (select *, there and coalesce(etag <> pe, false) h, there and coalesce(actual <> pa, false) c from f)
select release_id, source_id, seq, case when h and c then 'headers+content' when h then 'headers' else 'content' end as "method" from g where h or c""")
def stream_change_detect(spark, d):
    rows = log(spark, d, 4).select("release_id", "source_id", "seq", "captured_at", "etag", "actual")
    return J.run_once(J.detect_changes_stream(rows, delay=DELAY), "changes", rocks=True)


@query("stream_change_policies", f"""{views('log')}, f as (select *, {_LAG.format("seq")} is not null there, {_LAG.format("etag")} pe, {_LAG.format("actual")} pa from log),
g as (select *, there and source_id <> 'error' and case when source_id = 'purchase' then coalesce(etag, '') <> coalesce(pe, '') else coalesce(etag <> pe, false) end h, there and source_id <> 'view' and case when source_id = 'purchase' then actual is distinct from pa else coalesce(actual <> pa, false) end c from f)
select release_id, source_id, seq, case when h and c then 'headers+content' when h then 'headers' else 'content' end as "method" from g where h or c""")
def stream_change_policies(spark, d):
    """Null etags and values, a source whose blanks count, one whose etag and one whose value doesn't, and sources without a policy."""
    on, off = True, False
    policies = [("strict", "purchase", off, on, off, off, off, on, off), ("value", "error", off, off, off, off, off, on, on), ("etag", "view", off, on, off, off, off, off, on)]
    rows = log(spark, d).select("release_id", "source_id", "seq", "captured_at", "etag", "actual")
    return J.run_once(J.detect_changes_stream(rows, spark.createDataFrame(policies, POLICY), delay=DELAY), "policies", rocks=True)


_CHANGED = f"""{views('log')}, f as (select *, period = 1 and coalesce(actual between 0 and 3, false) valid, {_LAG.format("seq")} is not null there, {_LAG.format("status_code")} ps, {_LAG.format("etag")} pe, {_LAG.format("period")} pp, {_LAG.format("actual")} pa from log),
g as (select *, there and case source_id when 'purchase' then false when 'view' then false when 'signup' then coalesce(etag <> pe, false) else status_code <> ps or coalesce(etag <> pe, false) end h,
there and case source_id when 'signup' then false when 'purchase' then actual is distinct from pa when 'view' then coalesce(actual <> pa, false) else period <> pp or coalesce(actual <> pa, false) end c from f)
select release_id, source_id, seq, case when h and c then 'headers+content' when h then 'headers' when c then 'content' else 'valid' end as "method" from g where valid and (h or c or source_id = 'view')"""


@query("changed_captures", _CHANGED)
def changed_captures(spark, d):
    return D.changed_captures(X.capture_log(spark, d), X.detection_policies(spark), X.valid())


@query("stream_changed_captures", _CHANGED)
def stream_changed_captures(spark, d):
    """Status, etag, period and value by policy, valid captures only, one source by validity alone."""
    return J.run_once(J.detect_changes_stream(log(spark, d), X.detection_policies(spark), X.valid(), DELAY), "changed", rocks=True)


@query("stream_first_hit", f"{views('first_hits')} select release_id, source_id, seq from first_hits")
def stream_first_hit(spark, d):
    return J.run_once(J.first_hit_stream(log(spark, d), delay=DELAY).select("release_id", "source_id", "seq"), "first-hit")


@query("stream_race", f"{views('first_hits')} select release_id, arg_min(source_id, (captured_at, source_id)) source_id, arg_min(seq, (captured_at, source_id)) seq from first_hits group by 1")
def stream_race(spark, d):
    return J.run_once(J.race_stream(log(spark, d), delay=DELAY), "race", rocks=True)


@query("stream_race_valid", f"{views('judged')} select release_id, arg_min(source_id, (captured_at, source_id)) source_id, arg_min(seq, (captured_at, source_id)) seq from judged where valid group by 1")
def stream_race_valid(spark, d):
    """Failed and stale captures do not win."""
    return J.run_once(J.race_stream(log(spark, d), X.valid(), delay=DELAY), "race", rocks=True)


@query("stream_deadline", f"""{views('log', 'polled')}, w as (select distinct release_id from polled where source_id = 'purchase'),
e as (select release_id, max_by(error, (captured_at, seq)) filter (error is not null) last_error from log where captured_at <= event_time + interval 3 day group by 1)
select release_id, 'NOT_CONFIRMED' status, last_error from e where release_id not in (select release_id from w)""")
def stream_deadline(spark, d):
    return J.run_once(J.deadline_stream(log(spark, d), error=F.col("error"), delay=DELAY), "deadline", rocks=True)


@query("stream_confirm", f"""{views('log')}, polled as (select * from log where captured_at between event_time - interval 2 second and event_time + interval 3 day)
select a.release_id, a.seq l_seq, b.seq r_seq, b.source_id, case when abs(a.actual - b.actual) < 1e-6 then 'CONFIRMED' else 'MISMATCH' end status
from polled a join polled b on a.release_id = b.release_id and a.source_id = 'purchase' and b.source_id <> 'purchase' and b.captured_at between a.captured_at and a.captured_at + interval 3 day
union all select release_id, seq, null, null, 'NOT_UPDATED' from polled a where source_id = 'purchase' and not exists (select 1 from polled b where b.release_id = a.release_id and b.source_id <> 'purchase' and b.captured_at between a.captured_at and a.captured_at + interval 3 day)""")
def stream_confirm(spark, d):
    """Pairs, and the primaries without a partner."""
    return J.run_once(J.confirm_stream(log(spark, d), delay=DELAY), "confirm")


@query("stream_leaderboard", f"{views('first_hits')} select release_id, source_id, seq, row_number() over (partition by release_id order by captured_at, source_id) \"rank\" from first_hits")
def stream_leaderboard(spark, d):
    return J.leaderboard_stream(log(spark, d), compact_after=3).select("release_id", "source_id", "seq", F.col("rank").cast("long").alias("rank"))


def texts(rows):
    return rows.withColumns({c: F.array_join(c, ",") for c in ("matched_sources", "warnings", "pending_sources")})


_RELEASED = f"{views('released')} select release_id, case when reason is null then 'CONFIRMED' else 'NOT_CONFIRMED' end status, reason, actual, matched_sources, warnings, pending_sources, winner, latency_ms, last_error from released"


@query("stream_releases", _RELEASED)
def stream_releases(spark, d):
    """From captures to confirmed releases in one stream: change, validity, first hit, confirmation."""
    rows = J.release_stream(log(spark, d), X.sources(spark), X.detection_policies(spark), X.good(), X.valid(), F.dayofmonth("event_time") % 3 != 0, delay=DELAY)
    return texts(J.run_once(rows, "releases"))


@query("stream_release_json", f"""{views('released')} select release_id, '{{"release_id":' || release_id || ',"status":"' || case when reason is null then 'CONFIRMED' else 'NOT_CONFIRMED' end || '"' || case when actual is null then '' else ',"actual":' || actual::bigint end ||
',"matched_sources":[' || case when matched_sources = '' then '' else '"' || replace(matched_sources, ',', '","') || '"' end || ']}}' document from released""")
def stream_release_json(spark, d):
    """Every release as a JSON document, written once by the epoch log."""
    rows = J.release_stream(log(spark, d), X.sources(spark), X.detection_policies(spark), X.good(), X.valid(), F.dayofmonth("event_time") % 3 != 0, delay=DELAY)
    rows = rows.withColumn("actual", F.col("actual").cast("long"))
    return J.document_stream(sinks.document_of(rows, ["status", "actual", "matched_sources"]), shared_path(spark, "documents"), shared_path(spark, "documents-checkpoint"))


# the batch twins of the detection path


def source_hits(spark, d):
    inside = D.until_close(X.capture_log(spark, d), "3 days", "10 days")
    return D.hits_of_versions(D.versions(inside, X.good(), X.valid()), X.detection_policies(spark))


@query("first_detection", f"{views('detected')} select release_id, source_id, h.seq seq, h.actual actual, h.m as \"method\" from detected")
def first_detection(spark, d):
    """The first capture of each source that is valid and differs from its last good baseline."""
    return source_hits(spark, d).filter("hit is not null").select("release_id", "source_id", "hit.seq", "hit.actual", "hit.method")


@query("detected_releases", _RELEASED)
def detected_releases(spark, d):
    return texts(confirm_hits(source_hits(spark, d), X.sources(spark), F.dayofmonth("event_time") % 3 != 0))
