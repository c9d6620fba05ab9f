"""Registered queries: series readers, indicators, column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import series as S
from ..operators import validate as V
from ..sources import fixtures as X
from ..sources import readers as R
from ..sources.staging import table
from .reconcile import fill_from_backup
from .registry import query, views

_M = "strftime(period, '%Y-%m')"
_MOM = "lag(level) over w"
SERIES = views("series")
ROUND1 = "round(({}) * 10) / 10 + 0.0"


def month(c: str = "period"):
    return F.date_format(c, "yyyy-MM")


@query("mom_change", f"""{SERIES}, b as (select *, case when lag(period) over w = (period - interval 1 month)::date then lag(level) over w end previous from series window w as (partition by series_id order by period))
select series_id, {_M} period, level, previous, {ROUND1.format("(level::double / previous::double - 1) * 100")} mom from b""")
def mom_change(spark, d):
    return S.mom(X.series(spark, d)).withColumn("period", month())


@query("yoy_change", f"""{SERIES} select a.series_id, strftime(a.period, '%Y-%m') period, a.level as level, b.level year_ago, {ROUND1.format("(a.level::double / b.level::double - 1) * 100")} yoy
from series a left join series b on a.series_id = b.series_id and b.period = (a.period - interval 12 month)::date""")
def yoy_change(spark, d):
    return S.yoy(X.series(spark, d)).withColumn("period", month())


@query("level_diff", f"""{SERIES} select a.series_id, strftime(a.period, '%Y-%m') period, a.level - b.level diff, b.level - c.level previous_diff
from series a left join series b on a.series_id = b.series_id and b.period = (a.period - interval 1 month)::date left join series c on a.series_id = c.series_id and c.period = (a.period - interval 2 month)::date""")
def level_diff(spark, d):
    return S.level_diff(X.series(spark, d)).withColumn("period", month())


@query("latest_per_series", f"{SERIES} select series_id, strftime(max(period), '%Y-%m') period, max_by(level, period) as level from series group by 1")
def latest_per_series(spark, d):
    return S.latest(X.series(spark, d)).withColumn("period", month())


@query("latest_with_prev", f"""{SERIES}, r as (select *, row_number() over w n, lead(level) over w previous, lead(period) over w pp from series window w as (partition by series_id order by period desc))
select series_id, {_M} period, level, previous, strftime(pp, '%Y-%m') previous_period from r where n = 1""")
def latest_with_prev(spark, d):
    return S.latest_with_previous(X.series(spark, d)).select("series_id", month().alias("period"), "level", "previous", month("previous_period").alias("previous_period"))


@query("latest_n", f"{SERIES} select series_id, {_M} period, level, n from (select *, row_number() over (partition by series_id order by period desc) n from series) where n <= 6")
def latest_n(spark, d):
    return S.latest_n(X.series(spark, d), 6).withColumns({"period": month(), "n": F.col("n").cast("long")})


@query("join_prev_period", f"{SERIES} select a.series_id, strftime(a.period, '%Y-%m') period, a.level as level, b.level previous from series a left join series b on a.series_id = b.series_id and b.period = (a.period - interval 1 month)::date")
def join_prev_period(spark, d):
    return S.join_shifted(X.series(spark, d), 1, "previous").select("series_id", month().alias("period"), "level", "previous")


@query("duplicate_keys", f"{SERIES}, two as (select series_id, period from series union all select series_id, period from series where month(period) = 1) select series_id, {_M} period, count(*) n from two group by all having count(*) > 1")
def duplicate_keys(spark, d):
    s = X.series(spark, d).select("series_id", "period")
    return S.duplicate_keys(s.union(s.filter(F.month("period") == 1)), ["series_id", "period"]).withColumn("period", month())


@query("consecutive_periods", f"""{SERIES}, r as (select *, row_number() over w n, lead(period) over w pp from series window w as (partition by series_id order by period desc))
select series_id, {_M} period, strftime(pp, '%Y-%m') previous_period, pp = (period - interval 1 month)::date consecutive from r where n = 1""")
def consecutive_periods(spark, d):
    return S.not_consecutive(X.series(spark, d)).withColumns({"period": month(), "previous_period": month("previous_period")})


@query("direct_or_calc", f"""{SERIES}, b as (select *, case when lag(period) over w = (period - interval 1 month)::date then lag(level) over w end previous, case when month(period) % 3 = 0 then 0.5 end direct from series window w as (partition by series_id order by period)),
c as (select *, {ROUND1.format("(level::double / previous::double - 1) * 100")} calc from b)
select series_id, {_M} period, coalesce(direct::double, calc) mom, case when direct is not null then 'direct' when calc is not null then 'calculated_from_index' end value_method from c""")
def direct_or_calc(spark, d):
    s = X.series(spark, d).withColumn("direct_mom", F.when(F.month("period") % 3 == 0, F.lit(0.5)))
    return S.direct_or_calculated(s).withColumn("period", month())


@query("fill_backup", f"""{SERIES}, p as (select series_id, period, case when month(period) <> 4 then level end as level from series)
select p.series_id, strftime(p.period, '%Y-%m') period, coalesce(p.level, s.level) as level, case when p.level is null then 'backup' else 'primary' end value_method, case when p.level is null then 'level filled from backup' else '' end warnings
from p join series s using (series_id, period)""")
def fill_backup(spark, d):
    s = X.series(spark, d)
    primary = s.withColumn("level", F.when(F.month("period") != 4, F.col("level")))
    return fill_from_backup(primary, s, ["series_id", "period"], "level").withColumns({"period": month(), "warnings": F.array_join("warnings", ",")})


@query("internal_crosscheck", f"""{SERIES}, b as (select *, case when lag(period) over w = (period - interval 1 month)::date then level - lag(level) over w end diff from series window w as (partition by series_id order by period)),
p as (select *, case when month(period) = 7 then diff + 1 else diff end published from b) select series_id, {_M} period, diff, published, case when abs(published - diff) >= 0.05 then 'differs from the levels' end reason from p""")
def internal_crosscheck(spark, d):
    s = S.level_diff(X.series(spark, d)).withColumn("published", F.when(F.month("period") == 7, F.col("diff") + 1).otherwise(F.col("diff")))
    return s.select("series_id", month().alias("period"), "diff", "published", V.check_internal(F.col("published"), F.col("diff"), 0.05).alias("reason"))


@query("period_shift", f"{SERIES} select series_id, {_M} period, strftime(period - interval 1 month, '%Y-%m') previous_month, strftime(period - interval 12 month, '%Y-%m') year_ago from series")
def period_shift(spark, d):
    p = F.col("period")
    return X.series(spark, d).select("series_id", month().alias("period"), F.date_format(C.prev_month(p), "yyyy-MM").alias("previous_month"), F.date_format(C.prev_year(p), "yyyy-MM").alias("year_ago"))


@query("period_parse", f"""{SERIES} select series_id, {_M} iso, {_M} "long", {_M} compact, {_M} coded from series""")
def period_parse(spark, d):
    p = lambda fmt: F.date_format(C.to_period(F.date_format("period", fmt)), "yyyy-MM")
    return X.series(spark, d).select("series_id", p("yyyy-MM").alias("iso"), p("MMMM yyyy").alias("long"), p("yyyy MMM").alias("compact"), p("yyyy 'M'MM 'Results'").alias("coded"))


@query("period_labels", f"""{SERIES}, s as (select *, (period - interval 1 month)::date pm, (period - interval 12 month)::date py from series)
select series_id, strftime(period, '%B %Y') display, case when month(pm) = 5 then 'May' else strftime(pm, '%b') || '.' end || ' to ' || case when month(period) = 5 then 'May' else strftime(period, '%b') || '.' end || '(p)' mom_label,
strftime(py, '%b %Y') || ' to ' || strftime(period, '%b %Y') || '(p)' yoy_label from s""")
def period_labels(spark, d):
    p = F.col("period")
    return X.series(spark, d).select("series_id", C.display_period(p).alias("display"), C.mom_label(p).alias("mom_label"), C.yoy_label(p).alias("yoy_label"))


@query("period_words", """select event_id doc_id, case event_id % 6 when 0 then null when 1 then null when 2 then '2025-05' when 3 then '2026-06' when 4 then strftime(ts, '%Y-%m') else '2024-09' end period,
case event_id % 6 when 2 then 5 when 3 then 9 when 5 then 12 end::int as month from events""")
def period_words(spark, d):
    """Words that only begin like a month are none; of several months named, the last counts."""
    k = F.col("event_id") % 6
    text = F.when(k == 0, "It was decided 2026 targets stay").when(k == 1, "Mayor 2025 augmented 2024 marched").when(k == 2, "augmented 2025, of May 2025.").when(k == 3, "May 2025 to June 2026").when(k == 4, F.concat(F.lit("2019 JAN, revised; "), F.date_format("ts", "MMM. yyyy"))).otherwise("Sept. 2024 Results")
    word = F.when(k == 0, "decided").when(k == 1, "Mayor").when(k == 2, " MAY ").when(k == 3, "Sept.").when(k == 4, "").otherwise("december")
    return table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.date_format(C.to_period(text), "yyyy-MM").alias("period"), C.month_no(word).alias("month"))


# readers


@query("flat_series", f"{SERIES} select regexp_replace(series_id, '[^A-Z0-9]+', '_', 'g') series_id, {_M} period, level::double as value from series")
def flat_series(spark, d):
    return R.parse_flat_series(X.flat_lines(spark, d)).select("series_id", month().alias("period"), "value")


@query("bls_period", f"{SERIES}, l as (select distinct year(period) y, month(period) m from series union select distinct year(period), 13 from series) select y::int as year, 'M' || lpad(m::varchar, 2, '0') code, case when m <= 12 then y || '-' || lpad(m::varchar, 2, '0') end period from l")
def bls_period(spark, d):
    lines = X.flat_lines(spark, d)
    c = F.split(F.trim("line"), r"\s+")
    rows = lines.select(F.get(c, F.lit(1)).cast("int").alias("year"), F.get(c, F.lit(2)).alias("code")).distinct()
    return rows.withColumn("period", F.date_format(C.bls_period(F.col("year"), F.col("code")), "yyyy-MM"))


@query("json_series", f"{SERIES} select series_id, {_M} period, case when month(period) = 2 then '-' else level::varchar end as value from series where series_id not like '5%'")
def json_series(spark, d):
    return R.read_json_series(X.series_json(spark, d)).withColumn("period", month())


@query("missing_points", f"{SERIES} select series_id, {_M} period, case when month(period) <> 2 then level::double end as level, case when month(period) = 2 then 'missing' end problem from series where series_id not like '5%'")
def missing_points(spark, d):
    return S.clean_points(R.read_json_series(X.series_json(spark, d))).select("series_id", month().alias("period"), "level", "problem")


@query("json_keyed_obs", f"{SERIES} select series_id series_key, 'L ' || series_id label, strftime(max(period), '%Y-%m-%d') as date, max_by(level, period)::double as value from series group by series_id")
def json_keyed_obs(spark, d):
    return R.read_keyed_observations(X.keyed_json(spark, d)).withColumn("date", F.col("date").cast("string"))


@query("json_vector_points", f"""{SERIES}, r as (select *, row_number() over w n, lead(level) over w previous, lead(period) over w pp from series window w as (partition by series_id order by period desc))
select 14100287::bigint "productId", left(series_id, 1)::bigint "vectorId", {_M} period, level::double as value, previous::double previous, strftime(pp, '%Y-%m') previous_period from r where n = 1""")
def json_vector_points(spark, d):
    return R.read_vector_points(X.vector_json(spark, d)).select("productId", "vectorId", month().alias("period"), "value", "previous", month("previous_period").alias("previous_period"))


@query("wide_csv_unpivot", f"{SERIES} select series_id, {_M} period, level::double as value, '2026-05-14' release_date, '2026-06-12' next_release from series")
def wide_csv_unpivot(spark, d):
    rows = R.read_wide_series(X.wide_lines(spark, d))
    return rows.select("series_id", month().alias("period"), "value", F.col("release_date").cast("string").alias("release_date"), F.col("next_release").cast("string").alias("next_release"))


@query("header_rules", f"{SERIES}, s as (select distinct series_id from series) select series_id || ': GDP ' || h header, role from s, (values ('Index', 'index'), ('month-on-month growth, %', 'mom'), ('Year on Year growth', 'yoy'), ('contribution to month on month growth', null), ('3 month on 3 month growth', null)) t(h, role)")
def header_rules(spark, d):
    names = F.array(*map(F.lit, ("Index", "month-on-month growth, %", "Year on Year growth", "contribution to month on month growth", "3 month on 3 month growth")))
    heads = X.series(spark, d).select("series_id").distinct().select(F.explode(F.transform(names, lambda h: F.concat("series_id", F.lit(": GDP "), h))).alias("header"))
    return heads.withColumn("role", R.header_role(F.col("header")))


@query("series_columns", f"{SERIES}, s as (select distinct series_id from series), h as (select series_id doc_id, col_no, series_id || ': ' || h header, role from s, (values (1, 'GDP contribution to growth', null), (2, 'GDP Index', 'index'), (3, 'GDP month-on-month growth', 'mom'), (4, 'GDP index, second', 'index'), (5, 'Year on Year growth', 'yoy')) t(col_no, h, role)) select doc_id, role, min(col_no)::int col_no, arg_min(header, col_no) header from h where role is not null group by all")
def series_columns(spark, d):
    """The first column of each role, by the headers of every file."""
    names = F.array(*map(F.lit, ("GDP contribution to growth", "GDP Index", "GDP month-on-month growth", "GDP index, second", "Year on Year growth")))
    heads = X.series(spark, d).select(F.col("series_id").alias("doc_id")).distinct().select("doc_id", F.posexplode(F.transform(names, lambda h: F.concat("doc_id", F.lit(": "), h))).alias("pos", "header"))
    return R.resolve_series_columns(heads.select("doc_id", (F.col("pos") + 1).alias("col_no"), "header"))


@query("series_identity", "select s_suppkey, case when s_suppkey % 7 = 0 then 'not expected' when s_suppkey % 5 = 0 then 's_name differs' when s_suppkey % 3 = 0 then 's_nationkey differs' end reason from supplier")
def series_identity(spark, d):
    meta = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    k = F.col("s_suppkey")
    expected = meta.filter(k % 7 != 0).select(k, F.when(k % 5 == 0, "other").otherwise(F.col("s_name")).alias("s_name"), F.when(k % 3 == 0, F.lit(-1)).otherwise(F.col("s_nationkey")).alias("s_nationkey"))
    return R.check_series_identity(meta, expected, "s_suppkey").select("s_suppkey", "reason")


# column expressions


@query("month_number", "select event_id doc_id, month(ts)::int long_name, month(ts)::int short_name, month(ts)::int dotted from events")
def month_number(spark, d):
    n = lambda fmt: C.month_no(F.date_format("ts", fmt))
    return table(spark, d, "events").select(F.col("event_id").alias("doc_id"), n("MMMM").alias("long_name"), n("MMM").alias("short_name"), n("MMM'.'").alias("dotted"))


@query("expected_period", f"{views('releases')} select release_id, strftime(date_trunc('month', event_time) - interval 1 month, '%Y-%m') period from releases")
def expected_period(spark, d):
    return X.releases(spark, d).select("release_id", F.date_format(C.expected_period(F.col("event_time"), "America/New_York"), "yyyy-MM").alias("period"))


@query("bracket_period", "select o_orderkey, strftime(make_date((year(o_orderdate) - case when o_orderkey % 12 + 1 > month(o_orderdate) then 1 else 0 end)::int, (o_orderkey % 12 + 1)::int, 1), '%Y-%m') period from orders")
def bracket_period(spark, d):
    m = (F.col("o_orderkey") % 12 + 1).cast("int")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(C.bracket_period(F.to_date("o_orderdate"), m), "yyyy-MM").alias("period"))


@query("date_layouts", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') short_us, strftime(o_orderdate, '%Y-%m-%d') long_us, strftime(o_orderdate, '%Y-%m-%d') long_uk, strftime(o_orderdate, '%Y-%m-%d') numeric, strftime(o_orderdate, '%Y-%m-%d') slug from orders")
def date_layouts(spark, d):
    p = lambda fmt: C.parse_release_date(F.date_format("o_orderdate", fmt)).cast("string")
    return table(spark, d, "orders").select("o_orderkey", p("MMM d, yyyy").alias("short_us"), p("MMMM d, yyyy").alias("long_us"), p("d MMMM yyyy").alias("long_uk"), p("dd-MM-yyyy").alias("numeric"), p("'mp'yyMMdd").alias("slug"))


@query("tz_to_utc", "select o_orderkey, epoch_ms((o_orderdate + interval 12 hour) at time zone 'America/New_York') new_york, epoch_ms((o_orderdate + interval 12 hour) at time zone 'Europe/London') london, epoch_ms((o_orderdate + interval 12 hour) at time zone 'Asia/Kolkata') kolkata from orders")
def tz_to_utc(spark, d):
    noon = F.expr("o_orderdate + interval 12 hours")
    ms = lambda tz: F.unix_millis(C.to_utc(noon, tz).cast("timestamp"))
    return table(spark, d, "orders").select("o_orderkey", ms("America/New_York").alias("new_york"), ms("Europe/London").alias("london"), ms("Asia/Kolkata").alias("kolkata"))


@query("round1", "select event_id, round(value * 10) / 10 + 0.0 r1, round(value * 1000) / 1000 + 0.0 r3, round(-value / 100 * 10) / 10 + 0.0 negative from events")
def round1(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", C.round1(v).alias("r1"), C.round3(v).alias("r3"), C.round1(-v / 100).alias("negative"))


@query("fmt_value", "with e as (select event_id, floor(value) / 10 v from events) select event_id, printf('%.1f%%', v) percent, printf('%.2f%%', v) rate, round(v)::bigint || 'K' thousands, regexp_replace(printf('%.2f', v), '\\.?0+$', '') trimmed from e")
def fmt_value(spark, d):
    v = F.floor("value").cast("double") / 10
    return table(spark, d, "events").select("event_id", C.fmt_percent(v).alias("percent"), C.fmt_rate(v).alias("rate"), C.fmt_k(v).alias("thousands"), C.fmt_trimmed(v).alias("trimmed"))


@query("parse_value", "with e as (select event_id, floor(value) n from events) select event_id, case when event_id % 4 = 0 then null when event_id % 4 = 1 then n / 10 when event_id % 4 = 2 then n + 0.25 else n end percent, case when event_id % 3 = 0 then n when event_id % 3 = 1 then n * 1000 else -n end thousands from e")
def parse_value(spark, d):
    e = table(spark, d, "events").withColumn("n", F.floor("value"))
    k = F.col("event_id")
    text = F.when(k % 4 == 0, "--").when(k % 4 == 1, F.format_string("%.1f%%", F.col("n").cast("double") / 10)).when(k % 4 == 2, F.concat(F.col("n").cast("string"), F.lit("¼"))).otherwise(F.format_string("%,d", "n"))
    thousands = F.when(k % 3 == 0, F.concat(F.col("n").cast("string"), F.lit("K"))).when(k % 3 == 1, F.concat(F.col("n").cast("string"), F.lit("M"))).otherwise(F.concat(F.lit("−"), F.col("n").cast("string")))
    return e.select("event_id", C.parse_value(text).alias("percent"), (C.parse_value(thousands, "thousands") + F.lit(0.0)).alias("thousands"))


@query("content_hash", "select event_id, sha256(props) hash from events")
def content_hash(spark, d):
    return table(spark, d, "events").select("event_id", C.content_hash(F.col("props")).alias("hash"))


@query("pages_hash", "select user_id, event_type, strftime(ts, '%Y-%m-%d') \"day\", sha256(string_agg(props, '' order by event_id)) hash from events group by all")
def pages_hash(spark, d):
    """Documents of a release and source by day: a document's pages are few, whatever a release has."""
    return table(spark, d, "events").groupBy("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(C.pages_hash(F.col("event_id"), F.col("props")).alias("hash"))


@query("bounds_check", "select event_id, case when value / 20 not between -1 and 25 then 'out of bounds' end policy_rate, case when value / 20 not between 0 and 30 then 'out of bounds' end unemployment from events")
def bounds_check(spark, d):
    v = F.col("value") / 20
    return table(spark, d, "events").select("event_id", V.check_bounds(v, -1.0, 25.0).alias("policy_rate"), V.check_bounds(v, 0.0, 30.0).alias("unemployment"))


@query("placeholder_filter", "select event_id, case when event_id % 7 in (0, 1, 2) then 'no value' end reason from events")
def placeholder_filter(spark, d):
    k = F.col("event_id") % 7
    text = F.when(k == 0, "--").when(k == 1, " N/A ").when(k == 2, "NaN").otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", V.check_present(text).alias("reason"))
