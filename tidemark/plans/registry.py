"""The registry of queries with their SQL, and the views that the SQL shares."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

VIEWS = {
    "captures": "select user_id release_id, event_type source_id, event_id seq, ts captured_at, props etag, sha256(props) content_hash, value, floor(value / 100) actual from events",
    "releases": "select distinct user_id release_id, timestamp '2024-01-10 12:30:00' + (user_id % 10) * interval 1 day event_time from events",
    "sources": "select * from (values ('purchase', 1, true, true), ('signup', 2, false, true), ('click', 3, false, true), ('view', 4, false, false), ('error', 5, false, true)) t(source_id, priority, is_primary, is_value)",
    "polled": "select * from captures join releases using (release_id) where captured_at between event_time - interval 2 second and event_time + interval 3 day",
    "obs": "select release_id, source_id, min_by(actual, captured_at) actual, min(captured_at) hit_at from polled group by all",
    "hits": "select release_id, source_id, min_by({'seq': seq, 'at': captured_at, 'actual': actual, 'event': event_time}, (captured_at, seq)) h from polled group by all",
    "first_hits": "select release_id, source_id, h.seq seq, h.at captured_at, h.actual actual, h.event event_time from hits",
    "series": "select o_orderpriority series_id, date_trunc('month', o_orderdate)::date period, sum(round(o_totalprice * 100)::bigint)::bigint as level from orders group by all",
    "baselines": "select release_id, source_id, max_by({'seq': seq, 'actual': actual, 'etag': etag}, (captured_at, seq)) b from captures join releases using (release_id) where captured_at <= event_time - interval 1 minute group by all",
    "log": """select user_id release_id, event_type source_id, event_id seq, ts captured_at, case when event_id % 13 = 0 then 500 else 200 end status_code, case when event_id % 13 <> 0 then props end etag, case when event_id % 7 = 0 then 0 else 1 end period,
case when event_id % 13 <> 0 then floor(value / 100) end actual, case when event_id % 13 = 0 then 'HTTP 500 at poll ' || event_id end error, timestamp '2024-01-10 12:30:00' + (user_id % 10) * interval 1 day event_time from events""",
    "good_base": "select release_id, source_id, max_by({'seq': seq, 'actual': actual, 'etag': etag, 'period': period}, (captured_at, seq)) b from log where status_code = 200 and actual is not null and captured_at between event_time - interval 10 day and event_time - interval 1 minute group by all",
    "judged": """select l.*, g.b, period = 1 and actual between 0 and 3 valid, case when b is null then 'no baseline' else case source_id when 'purchase' then case when actual <> b.actual then 'content' end when 'signup' then case when etag <> b.etag then 'headers' end
when 'view' then case when actual <> b.actual then 'content' else 'valid' end else case when etag <> b.etag and (period <> b.period or actual <> b.actual) then 'headers+content' when etag <> b.etag then 'headers' when period <> b.period or actual <> b.actual then 'content' end end end as m
from log l left join good_base g using (release_id, source_id) where captured_at between event_time - interval 2 second and event_time + interval 3 day""",
    "detected": "select release_id, source_id, min(b.seq) base_seq, min(event_time) event_time, min_by({'seq': seq, 'at': captured_at, 'actual': actual, 'm': m}, (captured_at, seq)) h from judged where valid and m is not null group by all",
    "outcome": """select release_id, max(h.actual) filter (is_primary) p, min(event_time) event_time, arg_min(source_id, (h.at, priority, source_id)) winner, (min(epoch_us(h.at)) // 1000 - min(epoch_us(event_time)) // 1000)::bigint latency_ms, list({'s': source_id, 'v': h.actual, 'f': is_primary} order by priority) l from detected join sources using (source_id) group by 1""",
    "released": """select k.release_id, case when p is null then 'primary missing' when len(apart) > 0 then 'differs: ' || array_to_string(apart, ',') when day(k.event_time) % 3 = 0 then 'not scheduled' when len(same) < 2 then 'no confirming source' end reason, p actual, coalesce(array_to_string(same, ','), '') matched_sources,
coalesce(array_to_string(list_transform(apart, lambda x: x || ' differs'), ','), '') warnings, array_to_string(list_filter(['purchase', 'signup', 'click', 'view', 'error'], lambda x: not list_contains(coalesce(list_transform(l, lambda y: y.s), []), x)), ',') pending_sources, winner, latency_ms, case when p is null then last_error end last_error
from (select release_id, min(event_time) event_time, max_by(error, (captured_at, seq)) filter (source_id = 'purchase' and error is not null) last_error from log where captured_at between event_time - interval 10 day and event_time + interval 3 day group by 1) k
left join (select *, case when p is null then [] else list_transform(list_filter(l, lambda x: abs(x.v - p) < 1e-6), lambda x: x.s) end same, case when p is null then [] else list_transform(list_filter(l, lambda x: abs(x.v - p) >= 1e-6), lambda x: x.s) end apart from outcome) o using (release_id)""",
}
_NEEDS = {"good_base": ["log"], "judged": ["good_base"], "detected": ["judged"], "outcome": ["detected", "sources"], "released": ["outcome"], "polled": ["captures", "releases"], "obs": ["polled"], "hits": ["polled"], "first_hits": ["hits"], "baselines": ["captures", "releases"]}


def views(*names: str) -> str:
    """A WITH clause of the views named and those they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "with " + ", ".join(f"{n} as ({VIEWS[n]})" for n in order)


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame and, where there is one, its SQL."""

    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register
