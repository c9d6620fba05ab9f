"""Registered queries: captures, detection, validation, joins, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import asof as A
from ..operators import detect as D
from ..operators import validate as V
from ..sources import fixtures as X
from ..sources import readers, sinks
from ..sources.model import BOUNDS
from ..sources.staging import shared_path, table
from . import reconcile as R
from .registry import query, views

CAPTURES, OBS, HITS = views("captures"), views("obs", "sources"), views("first_hits", "sources")
STR = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def ms(c: str):
    return F.unix_millis(F.col(c).cast("timestamp"))


def hits(spark, d):
    return D.first_hits(X.in_poll_window(spark, d), ("seq", "captured_at", "actual", "event_time"))


@query("scan_captures", f"{CAPTURES} select release_id, source_id, seq, etag, content_hash from captures where source_id = 'purchase'")
def scan_captures(spark, d):
    return X.captures(spark, d).filter("source_id = 'purchase'").select("release_id", "source_id", "seq", "etag", "content_hash")


@query("dim_sources", f"{views('captures', 'sources')} select source_id, priority, is_primary, count(*) n_captures from captures join sources using (source_id) group by all")
def dim_sources(spark, d):
    return X.captures(spark, d).groupBy("source_id").agg(F.count("*").alias("n_captures")).join(X.sources(spark), "source_id").select("source_id", "priority", "is_primary", "n_captures")


@query("release_json", f"""{OBS}, m as (select release_id, max(actual) filter (is_primary) p from obs join sources using (source_id) group by 1),
j as (select o.*, s.priority, s.is_primary, m.p, abs(actual - p) < 1e-6 same from obs o join sources s using (source_id) join m using (release_id)),
k as (select release_id, string_agg('{{"source_id":"' || source_id || '","actual":' || actual::bigint || '}}', ',' order by priority) metrics, coalesce(string_agg('"' || source_id || '"', ',' order by priority) filter (same), '') matched,
coalesce(string_agg('"' || source_id || ' differs"', ',' order by priority) filter (not same), '') warnings, min(epoch_us(hit_at) // 1000) first_hit from j group by 1)
select release_id, '{{"release_id":' || release_id || ',"metrics":[' || metrics || '],"matched_sources":[' || matched || '],"warnings":[' || warnings || '],"latency":{{"total":' || (first_hit - epoch_us(event_time) // 1000)::bigint || '}}}}' document from k join releases using (release_id)""")
def release_json(spark, d):
    """Written by the sink as JSON lines, and read back."""
    obs, releases = X.obs(spark, d), X.releases(spark, d)
    rows = obs.join(X.sources(spark), "source_id").withColumn("actual", F.col("actual").cast("long"))
    first = obs.groupBy("release_id").agg(F.min("hit_at").alias("at")).join(releases, "release_id")
    latency = first.select("release_id", F.struct(C.event_latency_ms(F.col("at"), F.col("event_time")).alias("total")).alias("latency"))
    evidence = R.confirm_releases(releases, obs, X.sources(spark)).select("release_id", "matched_sources", "warnings").join(latency, "release_id")
    path = shared_path(spark, "releases")
    sinks.write_release_json(sinks.release_documents(rows, "priority", ["source_id", "actual"], evidence=evidence), path)
    return spark.read.text(path).select(F.get_json_object("value", "$.release_id").cast("long").alias("release_id"), F.col("value").alias("document"))


@query("capture_log", f"{CAPTURES} select release_id, source_id, seq, etag, content_hash from captures where source_id = 'purchase'")
def capture_log(spark, d):
    """Captures laid out by source as the log is, read with its schema; the filter prunes folders."""
    path = shared_path(spark, "capture-log")
    rows = X.captures(spark, d).select("release_id", "source_id", "seq", F.col("captured_at").cast("timestamp").alias("captured_at"), "etag", "content_hash")
    sinks.write_table(rows, path, "overwrite", "source_id")
    return readers.read_captures(spark, path).filter("source_id = 'purchase'").select("release_id", "source_id", "seq", "etag", "content_hash")


@query("snapshot_upsert", f"{CAPTURES} select release_id, source_id, max_by(seq, (captured_at, seq)) seq, max_by(actual, (captured_at, seq)) actual from captures group by all")
def snapshot_upsert(spark, d):
    """A stored snapshot of the first half of January, brought up to date with the rest."""
    rows = X.captures(spark, d).select("release_id", "source_id", "seq", "captured_at", "actual")
    newest = F.struct("captured_at", "seq")
    early, late = rows.filter("captured_at < '2024-01-15'"), rows.filter("captured_at >= '2024-01-15'")
    path = shared_path(spark, "snapshot")
    sinks.write_table(sinks.upsert_snapshot(early.limit(0), early, ["release_id", "source_id"], newest), path, "overwrite", None)
    return sinks.upsert_snapshot(spark.read.parquet(path), late, ["release_id", "source_id"], newest).select("release_id", "source_id", "seq", "actual")


@query("performance_table", f"{CAPTURES}, h as (select release_id, source_id, count(*) polls, min(epoch_us(captured_at) // 1000)::bigint first_ms from captures group by all) select release_id, source_id, polls, first_ms from h")
def performance_table(spark, d):
    """Polls and first capture per source, as a table by release."""
    rows = X.captures(spark, d).groupBy("release_id", "source_id").agg(F.count("*").alias("polls"), F.min(ms("captured_at")).alias("first_ms"))
    path = shared_path(spark, "performance")
    sinks.write_table(rows, path, "overwrite", None)
    return spark.read.parquet(path)


@query("snapshot_table", f"{CAPTURES} select release_id, source_id, max(seq) seq, count(*) n from captures group by all")
def snapshot_table(spark, d):
    snap = X.captures(spark, d).groupBy("release_id", "source_id").agg(F.max("seq").alias("seq"), F.count("*").alias("n"))
    path = shared_path(spark, "snapshot")
    sinks.write_table(snap, path, "overwrite", "source_id")
    return spark.read.parquet(path).select("release_id", "source_id", "seq", "n")


@query("window_range_join", f"{views('polled')} select release_id, source_id, seq from polled")
def window_range_join(spark, d):
    return D.in_window(X.captures(spark, d), X.releases(spark, d), "2 seconds", "3 days").select("release_id", "source_id", "seq")


@query("baseline_asof", f"{views('baselines')} select release_id, source_id, b.seq base_seq, b.actual base_actual, b.etag base_etag from baselines")
def baseline_asof(spark, d):
    return D.baseline_asof(X.captures(spark, d), X.releases(spark, d)).select("release_id", "source_id", "base_seq", "base_actual", "base_etag")


@query("join_baseline", f"{views('polled', 'baselines')} select release_id, source_id, seq, p.actual, b.actual base_actual, b is null or p.actual is distinct from b.actual changed from polled p left join baselines using (release_id, source_id)")
def join_baseline(spark, d):
    base = D.baseline_asof(X.captures(spark, d), X.releases(spark, d))
    return D.join_baseline(X.in_poll_window(spark, d), base).select("release_id", "source_id", "seq", "actual", "base_actual", "changed")


@query("valid_updates", f"{views('polled', 'baselines')} select release_id, source_id, seq, p.actual from polled p left join baselines using (release_id, source_id) where p.actual between -1 and 25 and (b is null or p.actual is distinct from b.actual) and month(captured_at) = 1")
def valid_updates(spark, d):
    base = D.baseline_asof(X.captures(spark, d), X.releases(spark, d))
    expected = F.month("captured_at") == 1
    return D.valid_updates(X.in_poll_window(spark, d), base, expected, *BOUNDS["policy_rate"]).select("release_id", "source_id", "seq", "actual")


_FLAGS = "(select *, row_number() over w n, lag(etag) over w pe, lag(content_hash) over w ph, lag(actual) over w pa from captures window w as (partition by release_id, source_id order by captured_at, seq))"


def _policies(spark, all_on: bool):
    rows = [("p", s, False, True, False, all_on, False, True, True) for s, *_ in X.SOURCES]
    return spark.createDataFrame(rows, D.POLICY)


@query("change_flags", f"{CAPTURES} select release_id, source_id, seq, n > 1 and etag <> pe headers_changed, n > 1 and (content_hash <> ph or actual <> pa) content_changed from {_FLAGS}")
def change_flags(spark, d):
    return D.detect_changes(X.captures(spark, d), _policies(spark, True)).select("release_id", "source_id", "seq", "headers_changed", "content_changed")


@query("change_policies", f"""{CAPTURES}, f as {_FLAGS} select release_id, source_id, seq, case when source_id in ('purchase', 'click') then n > 1 and etag <> pe else false end headers_changed,
case when source_id = 'error' then false when source_id = 'view' then n > 1 and content_hash <> ph else n > 1 and actual <> pa end content_changed from f""")
def change_policies(spark, d):
    on, off = True, False
    rows = [  # status, etag, modified, hash, period, value, blank is same
        ("value", "purchase", off, on, off, off, off, on, on), ("value", "click", on, on, off, off, off, on, on), ("value only", "signup", off, off, off, off, off, on, off),
        ("hash", "view", off, off, off, on, off, off, off), ("none", "error", off, off, off, off, off, off, on),
    ]
    return D.detect_changes(X.captures(spark, d), spark.createDataFrame(rows, D.POLICY)).select("release_id", "source_id", "seq", "headers_changed", "content_changed")


_FIELDS = """(select *, row_number() over w n, lag(m) over w pm, lag(p) over w pp, lag(a) over w pa, lag(e) over w pe from (select release_id, source_id, seq, captured_at, case when seq % 7 <> 0 then seq % 3 end m, (seq // 5) % 2 p, case when seq % 6 <> 0 then floor(actual) end a, case when seq % 11 <> 0 then etag end e from captures)
window w as (partition by release_id, source_id order by captured_at, seq))"""


@query("change_fields", f"""{CAPTURES} select release_id, source_id, seq, case when source_id = 'purchase' then n > 1 and coalesce(m::varchar, '') <> coalesce(pm::varchar, '') else n > 1 and (coalesce(m <> pm, false) or coalesce(e <> pe, false)) end headers_changed,
case when source_id = 'purchase' then n > 1 and p <> pp else n > 1 and (p <> pp or coalesce(a <> pa, false)) end content_changed from {_FIELDS}""")
def change_fields(spark, d):
    """Last-modified and period as fields, nulls among the values, and a policy for one source only: the others keep their captures."""
    s = F.col("seq")
    rows = X.captures(spark, d).select(
        "release_id", "source_id", "seq", "captured_at", F.when(s % 7 != 0, (s % 3).cast("string")).alias("last_modified"), (F.floor(s / 5) % 2).alias("period"),
        F.when(s % 6 != 0, F.floor("actual")).alias("actual"), F.when(s % 11 != 0, F.col("etag")).alias("etag"),
    )
    policies = spark.createDataFrame([("own", "purchase", False, False, True, False, True, False, False)], D.POLICY)
    return D.detect_changes(rows, policies).select("release_id", "source_id", "seq", "headers_changed", "content_changed")


@query("detection_method", f"{CAPTURES}, f as (select *, n > 1 and etag <> pe h, n > 1 and actual <> pa c from {_FLAGS}) select release_id, source_id, seq, case when h and c then 'headers+content' when h then 'headers' when c then 'content' end as \"method\" from f where h or c")
def detection_method(spark, d):
    rows = D.detect_changes(X.captures(spark, d), _policies(spark, False))
    return rows.select("release_id", "source_id", "seq", D.detection_method(F.col("headers_changed"), F.col("content_changed")).alias("method")).filter("method is not null")


@query("nth_poll", f"{CAPTURES} select release_id, source_id, seq, n poll_no, n % 5 = 0 or (n > 1 and etag <> pe) check_content from {_FLAGS}")
def nth_poll(spark, d):
    return D.content_checks(X.captures(spark, d)).select("release_id", "source_id", "seq", F.col("poll_no").cast("long").alias("poll_no"), "check_content")


@query("first_hit", f"{HITS} select release_id, source_id, seq, actual from first_hits")
def first_hit(spark, d):
    return hits(spark, d).select("release_id", "source_id", "seq", "actual")


@query("event_latency", f"{HITS} select release_id, source_id, (epoch_us(captured_at) // 1000 - epoch_us(event_time) // 1000)::bigint latency_ms, printf('%+.3fs', ((epoch_us(captured_at) // 1000) - (epoch_us(event_time) // 1000)) / 1000.0) display from first_hits")
def event_latency(spark, d):
    at = C.event_latency_ms(F.col("captured_at"), F.col("event_time"))
    return hits(spark, d).select("release_id", "source_id", at.alias("latency_ms"), C.fmt_latency(at).alias("display"))


@query("leaderboard", f"{HITS} select release_id, source_id, priority, row_number() over (partition by release_id order by captured_at, priority, source_id) \"rank\" from first_hits join sources using (source_id)")
def leaderboard(spark, d):
    return D.leaderboard(hits(spark, d), X.sources(spark)).select("release_id", "source_id", "priority", F.col("rank").cast("long").alias("rank"))


@query("winner", f"{HITS} select release_id, arg_min(source_id, (captured_at, priority, source_id)) source_id, epoch_us(min(captured_at)) // 1000 captured_ms from first_hits join sources using (source_id) group by 1")
def winner(spark, d):
    return D.winner(hits(spark, d), X.sources(spark)).select("release_id", "source_id", ms("captured_at").alias("captured_ms"))


@query("top2_agree", f"{HITS}, r as (select *, row_number() over (partition by release_id order by captured_at, priority, source_id) k from first_hits join sources using (source_id)) select release_id, count(*) n, case when count(*) = 2 then min(actual) = max(actual) end agree from r where k <= 2 group by 1")
def top2_agree(spark, d):
    return D.top2_agree(D.leaderboard(hits(spark, d), X.sources(spark)))


@query("best_by_kind", f"{HITS} select release_id, min(epoch_us(captured_at) // 1000) filter (source_id in ('purchase', 'signup')) official, min(epoch_us(captured_at) // 1000) filter (source_id = 'click') dataset, min(epoch_us(captured_at) // 1000) filter (source_id in ('view', 'error')) third_party from first_hits group by 1")
def best_by_kind(spark, d):
    kind = F.when(F.col("source_id").isin("purchase", "signup"), "official").when(F.col("source_id") == "click", "dataset").otherwise("third_party")
    return D.best_by_kind(hits(spark, d), kind, ["official", "dataset", "third_party"])


@query("pending_sources", f"{HITS} select r.release_id, s.source_id from releases r cross join sources s where not exists (select 1 from first_hits h where h.release_id = r.release_id and h.source_id = s.source_id)")
def pending_sources(spark, d):
    return D.pending_sources(X.releases(spark, d), X.sources(spark), hits(spark, d))


@query("poll_stats", f"{CAPTURES} select release_id, source_id, count(*) polls, count_if(value > 150)::bigint errors, max_by(etag, (captured_at, seq)) filter (value > 150) last_error from captures group by all")
def poll_stats(spark, d):
    return D.poll_stats(X.captures(spark, d), F.when(F.col("value") > 150, F.col("etag")))


@query("latency_rollup", f"{CAPTURES} select release_id, source_id, sum(seq % 97)::bigint ttfb, sum(seq % 31)::bigint body_read, sum(length(etag))::bigint parse, sum(seq % 97 + seq % 31 + length(etag))::bigint total from captures group by all")
def latency_rollup(spark, d):
    rows = X.captures(spark, d).select("release_id", "source_id", (F.col("seq") % 97).alias("ttfb"), (F.col("seq") % 31).alias("body_read"), F.char_length("etag").cast("long").alias("parse"))
    return rows.groupBy("release_id", "source_id").agg(*[F.sum(c).alias(c) for c in ("ttfb", "body_read", "parse")]).withColumn("total", F.expr("ttfb + body_read + parse"))


@query("prefer_expected", f"{CAPTURES} select release_id, source_id, max_by(seq, (case when value < 100 then 1 else 0 end, captured_at, seq)) seq, max_by(actual, (case when value < 100 then 1 else 0 end, captured_at, seq)) actual from captures group by all")
def prefer_expected(spark, d):
    return D.prefer_expected(X.captures(spark, d), F.col("value") < 100, ("seq", "actual"))


@query("group_consistency", f"{CAPTURES} select release_id, source_id, count(distinct month(captured_at)) = 1 and count(distinct date_trunc('day', captured_at)) = 1 consistent from captures group by all")
def group_consistency(spark, d):
    days = X.captures(spark, d).withColumn("day", F.to_date("captured_at"))
    return V.single_valued(days, ["release_id", "source_id"], "day")


@query("source_whitelist", f"{views('captures', 'sources')} select release_id, source_id, seq from captures where source_id in (select source_id from sources where is_value)")
def source_whitelist(spark, d):
    return V.check_source(X.captures(spark, d), X.sources(spark).filter("is_value"), ["source_id"]).select("release_id", "source_id", "seq")


@query("confidence_grade", f"{CAPTURES} select seq, case when source_id in ('view', 'error') then 'LOW' when source_id = 'click' or value <= 50 then 'MEDIUM' when month(captured_at) <> 1 then 'MEDIUM' else 'HIGH' end grade from captures")
def confidence_grade(spark, d):
    s = F.col("source_id")
    return X.captures(spark, d).select("seq", V.grade(~s.isin("view", "error"), s == "click", F.col("value") > 50, F.month("captured_at") == 1).alias("grade"))


@query("stale_filter", f"{OBS} select release_id, source_id, case when hit_at::date < event_time::date + 1 then 'stale period' when hit_at::date > event_time::date + 1 then 'period ahead' end reason from obs join releases using (release_id)")
def stale_filter(spark, d):
    rows = X.obs(spark, d).join(X.releases(spark, d), "release_id")
    return rows.select("release_id", "source_id", V.check_period(F.to_date("hit_at"), F.date_add(F.to_date("event_time"), 1)).alias("reason"))


@query("payload_complete", f"""{OBS}, m as (select release_id, list(source_id) l from obs group by 1) select release_id, len(l)::int n_present,
case when not list_contains(l, 'purchase') then 'purchase missing' when not list_contains(l, 'signup') then 'signup missing' when not list_contains(l, 'click') then 'click missing' when not list_contains(l, 'view') then 'view missing' when not list_contains(l, 'error') then 'error missing' end reason from m""")
def payload_complete(spark, d):
    return V.check_payload(X.obs(spark, d), X.sources(spark))


@query("completeness", f"{OBS} select release_id, count(distinct source_id) n_metrics, count(distinct source_id) = 5 complete from obs group by 1")
def completeness(spark, d):
    return V.completeness(X.obs(spark, d), len(X.SOURCES))


@query("schedule_confirmed", f"{views('releases')} select release_id, day(event_time) % 3 <> 0 scheduled from releases")
def schedule_confirmed(spark, d):
    releases = X.releases(spark, d)
    schedule = releases.filter(F.dayofmonth("event_time") % 3 != 0).select("event_time").distinct()
    return V.check_schedule(releases, schedule, ["event_time"]).select("release_id", "scheduled")


@query("tolerance_equal", f"{OBS} select a.release_id, b.source_id, abs(a.actual - b.actual) < 1e-6 exact, abs(a.actual - b.actual) < 1.5 near from obs a join obs b using (release_id) where a.source_id = 'purchase' and b.source_id <> 'purchase'")
def tolerance_equal(spark, d):
    o = X.obs(spark, d)
    p = o.filter("source_id = 'purchase'").select("release_id", F.col("actual").alias("p"))
    a, b = F.col("actual"), F.col("p")
    return o.filter("source_id <> 'purchase'").join(p, "release_id").select("release_id", "source_id", C.values_equal(a, b, 1e-6).alias("exact"), C.values_equal(a, b, 1.5).alias("near"))


@query("compare_payloads", f"{OBS} select coalesce(a.release_id, b.release_id) release_id, a.actual a, b.actual b, case when b.release_id is null then 'only_a' when a.release_id is null then 'only_b' when abs(a.actual - b.actual) < 1e-6 then 'equal' else 'differs' end outcome from (select * from obs where source_id = 'purchase') a full join (select * from obs where source_id = 'click') b on a.release_id = b.release_id")
def compare_payloads(spark, d):
    o = X.obs(spark, d)
    return R.compare_payloads(o.filter("source_id = 'purchase'"), o.filter("source_id = 'click'"), ["release_id"])


@query("theta_verify", f"{OBS} select a.release_id, (min(epoch_us(b.hit_at) // 1000 - epoch_us(a.hit_at) // 1000))::bigint delay_ms, count(*) n_rows from obs a join obs b using (release_id) where a.source_id = 'purchase' and b.source_id <> 'purchase' and abs(a.actual - b.actual) < 0.5 and b.hit_at >= a.hit_at group by 1")
def theta_verify(spark, d):
    o = X.obs(spark, d)
    return R.verify_third_party(o.filter("source_id = 'purchase'").select("release_id", "actual", "hit_at"), o.filter("source_id <> 'purchase'"), ["release_id"], "actual", 0.5, "hit_at")


_CLASS = "case when o.actual is null then 'NOT_UPDATED' when p.actual is null then 'ERROR' when abs(p.actual - o.actual) < 1e-6 then 'CONFIRMED' else 'MISMATCH' end"


@query("classify_confirmation", f"""{OBS} select r.release_id, s.source_id, {_CLASS} status,
case when o.actual is null then 'no observation' when p.actual is null then 'no primary value' else printf('%.1f against %.1f', o.actual, p.actual) end detail
from releases r cross join (select source_id from sources where not is_primary) s left join (select * from obs where source_id = 'purchase') p on p.release_id = r.release_id left join obs o on o.release_id = r.release_id and o.source_id = s.source_id""")
def classify_confirmation(spark, d):
    return R.classify_confirmations(X.releases(spark, d), X.obs(spark, d), X.sources(spark))


@query("select_source", f"""{OBS} select release_id, min_by(source_id, priority) source_id, min_by(actual, priority) actual, case when min(priority) > 1 then 'value from backup ' || min_by(source_id, priority) end warning from obs join sources using (source_id) where is_value group by 1""")
def select_source(spark, d):
    return R.select_value_source(X.obs(spark, d), X.sources(spark))


@query("matched_sources", f"{OBS} select release_id, string_agg(source_id, ',' order by priority) matched_sources from obs join sources using (source_id) group by 1")
def matched_sources(spark, d):
    rows = X.obs(spark, d).join(X.sources(spark), "source_id")
    return R.collect_ordered(rows, "priority", "source_id").withColumn("matched_sources", F.array_join("matched_sources", ","))


@query("confirmed_releases", f"""{OBS}, o as (select *, max(actual) filter (is_primary) over (partition by release_id) p from obs join sources using (source_id)),
a as (select release_id, max(p) p, string_agg(source_id, ',' order by priority) filter (abs(actual - p) < 1e-6) same, string_agg(source_id, ',' order by priority) filter (abs(actual - p) >= 1e-6) apart, count(*) filter (abs(actual - p) < 1e-6) n from o group by 1),
r as (select r.release_id, case when p is null then 'primary missing' when apart is not null then 'differs: ' || apart when day(event_time) % 3 = 0 then 'not scheduled' when n < 2 then 'no confirming source' end reason, p actual, coalesce(same, '') matched_sources, apart from releases r left join a using (release_id))
select release_id, case when reason is null then 'CONFIRMED' else 'NOT_CONFIRMED' end status, reason, actual, matched_sources, coalesce(replace(apart, ',', ' differs,') || ' differs', '') warnings from r""")
def confirmed_releases(spark, d):
    out = R.confirm_releases(X.releases(spark, d), X.obs(spark, d), X.sources(spark), F.dayofmonth("event_time") % 3 != 0)
    return out.withColumns({c: F.coalesce(F.array_join(c, ","), F.lit("")) for c in ("matched_sources", "warnings")})


@query("metric_signature", f"{OBS} select release_id, string_agg(source_id || '=' || actual::bigint, ', ' order by priority) signature, max(actual::bigint) filter (source_id = 'purchase') first_metric from obs join sources using (source_id) group by 1")
def metric_signature(spark, d):
    order = [s for s, *_ in X.SOURCES]
    per = X.obs(spark, d).groupBy("release_id").agg(F.map_from_entries(F.collect_list(F.struct("source_id", F.col("actual").cast("long")))).alias("m"))
    return per.select("release_id", C.signature(F.col("m"), order).alias("signature"), F.get(C.ordered_metrics(F.col("m"), order), F.lit(0)).alias("first_metric"))


@query("unique_strings", f"{CAPTURES}, u as (select release_id, source_id, min(seq) s from captures where source_id <> 'error' group by all) select release_id, string_agg(source_id, '|' order by s) names from u group by 1")
def unique_strings(spark, d):
    """Names in order of first appearance: their first places first, so that a release gathers names, not captures."""
    first = X.captures(spark, d).groupBy("release_id", "source_id").agg(F.min("seq").alias("seq"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "source_id"))), lambda x: F.when(x["source_id"] == "error", " ").otherwise(F.concat(F.lit(" "), x["source_id"])))
    out = first.groupBy("release_id").agg(F.array_join(C.unique_strings(listed), "|").alias("names"))
    return out.filter("names <> ''")


@query("source_order", f"{views('captures', 'sources')} select source_id, priority, count(*) n from captures join sources using (source_id) group by all order by priority, source_id")
def source_order(spark, d):
    return X.captures(spark, d).join(X.sources(spark), "source_id").groupBy("source_id", "priority").agg(F.count("*").alias("n")).orderBy("priority", "source_id")


@query("union_sources", "select event_id, value, case when event_type = 'error' then 'no value' end error, event_type source_id from events")
def union_sources(spark, d):
    """One scan: each source has its own columns, and rows of a failed one stay rows."""
    rows = table(spark, d, "events").select("event_id", "value", F.col("event_type").alias("source_id"))
    parts = {s: {"error": F.lit("no value")} if s == "error" else {} for s, *_ in X.SOURCES}
    return R.dispatch(rows, ["event_id", "value"], parts, "source_id").filter("reason is null").drop("reason")


@query("last_good_baseline", """with c as (select event_type source_id, event_id seq, ts captured_at, props etag, floor(value / 100) actual, event_id % 13 <> 0 and event_id % 3 <> 0 good from events),
m as (select distinct user_id release_id, timestamp '2024-01-10 12:30:00' + (user_id % 10) * interval 1 day - interval 1 minute moment from events), s as (select distinct event_type source_id from events)
select release_id, s.source_id, b.seq base_seq, b.actual base_actual from m cross join s left join lateral (select max_by({'seq': seq, 'actual': actual}, (captured_at, seq)) b from c where c.source_id = s.source_id and good and captured_at <= moment) on true""")
def last_good_baseline(spark, d):
    """Captures that carry no release: each source's last good one before every release's event, failures between them passed over."""
    log = X.captures(spark, d).drop("release_id").withColumn("good", (F.col("seq") % 13 != 0) & (F.col("seq") % 3 != 0))
    names = F.array(*[F.lit(s) for s, *_ in X.SOURCES])
    moments = X.releases(spark, d).select("release_id", F.explode(names).alias("source_id"), F.expr("event_time - interval 1 minute").alias("moment"))
    return A.last_good_asof(log, moments, F.col("good"), fields=("seq", "actual")).select("release_id", "source_id", "base_seq", "base_actual")


@query("window_interval_join", f"{views('captures', 'releases')} select r.release_id, c.source_id, c.seq from (select source_id, seq, captured_at from captures) c join releases r on c.captured_at between r.event_time - interval 2 second and r.event_time + interval 3 hour")
def window_interval_join(spark, d):
    """Captures that carry a source only, in the polling window of every release that was open."""
    windows = X.releases(spark, d).select("release_id", F.expr("event_time - interval 2 seconds").alias("opens"), F.expr("event_time + interval 3 hours").alias("closes"))
    points = X.captures(spark, d).select("source_id", "seq", "captured_at")
    return A.interval_join(points, windows, "captured_at", "opens", "closes", "3 hours").select("release_id", "source_id", "seq")


_EVENTS = "(0, 'Core PPI (MoM)', 'mom'), (1, 'Core PPI (YoY)', 'yoy'), (2, 'PPI (MoM)', 'mom'), (3, 'PPI (YoY)', 'yoy')"
_FAULTS = "['country', 'table', 'unit', 'period', 'value method', 'no value', 'out of bounds', 'row', 'group', 'item', 'seasonality', 'column', 'from period', 'no previous', 'repeated', 'missing', 'not defined']"


@query("payload_identity", f"""{views('releases')}, e as (select * from (values {_EVENTS}) t(i, name, kind)), f as (select release_id, release_id % 19 k, {_FAULTS}[(release_id % 19)::int] fault, (release_id // 19) % 4 i from releases)
select f.release_id, case when k = 18 then 'stale period' when k = 0 or (fault = 'no previous' and kind = 'yoy') then '' when fault = 'not defined' then 'Other PPI: not defined' else name || ': ' || fault end violations from f join e using (i)""")
def payload_identity(spark, d):
    """PPI payloads of four figures; of every release one figure breaks one rule, which is all that is said of it."""
    figures = X.payload_figures(spark, d)
    payloads = X.releases(spark, d).select("release_id", F.when(F.col("release_id") % 19 == 18, F.lit("2026-04-01")).otherwise(F.lit("2026-05-01")).cast("date").alias("period"), F.lit(None).cast("date").alias("from_period"))
    payloads = payloads.withColumn("from_period", F.add_months("period", -1))
    out = V.check_identity(payloads, figures, X.payload_definitions(spark), F.lit("2026-05-01").cast("date"))
    return out.select("release_id", F.array_join("violations", ", ").alias("violations"))


@query("document_crosscheck", """select event_id doc_id, ['', 'sentence and block differ', 'sentence and title have other periods', 'page and column have other periods', 'change differs from the levels', '', 'sentence and block differ, change differs from the levels'][(event_id % 7 + 1)::int] violations from events""")
def document_crosscheck(spark, d):
    """Extractions of one page held against each other."""
    x = X.crosscheck_parts(X.crosscheck_pages(spark, d))
    return x.select("doc_id", F.array_join(V.check_document(*[F.col(c) for c in ("value", "block_value", "sentence_period", "title_period", "page_period", "column_period", "published", "level_change")]), ", ").alias("violations"))


@query("extractor_dispatch", f"{CAPTURES} select seq, case source_id when 'purchase' then 'json' when 'click' then 'text' else 'other' end kind, case source_id when 'purchase' then regexp_extract(etag, '([0-9]+)', 1)::double when 'click' then actual end as value, case source_id when 'click' then 'LOW' end confidence, case when source_id not in ('purchase', 'click') then 'no extractor' end reason from captures")
def extractor_dispatch(spark, d):
    kind = F.when(F.col("source_id") == "purchase", "json").when(F.col("source_id") == "click", "text").otherwise("other")
    R.register_extractor("json", {"value": F.get_json_object("etag", "$.k").cast("double")})
    R.register_extractor("text", {"value": F.col("actual"), "confidence": F.lit("LOW")})
    return R.dispatch(X.captures(spark, d).withColumn("kind", kind), ["seq"])
