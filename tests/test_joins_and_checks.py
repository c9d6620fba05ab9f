"""Joins on time, wide CSV, match places, character references, identity and cross-checks, on literal and random cases."""

import csv
import html
import io
import random
import time
from datetime import datetime, timedelta

import pytest
from html.entities import html5
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import asof as A
from tidemark.operators import extract as E
from tidemark.operators import validate as V
from tidemark.sources import fixtures as X
from tidemark.sources import readers, staging

DAY = datetime(2026, 6, 1)


def test_last_good_asof_matches_brute_force(spark):
    """Failures between good captures, ties in time, one source with most of the rows, keys and times that are null, moments without any capture."""
    made, rows = random.Random(7), []
    for i in range(3000):
        source = "hot" if i % 3 else made.choice(["a", "b", "c", None])
        rows.append((source, i, DAY + timedelta(minutes=made.randint(0, 400)) if i % 50 else None, made.random() < 0.1, f"e{i}", float(i)))
    moments = [(s, k, DAY + timedelta(minutes=m) if m is not None else None) for k, m in enumerate([-5, 0, 1, 100, 250, 399, 500, None]) for s in ("hot", "a", "b", "none", None)]
    captures = spark.createDataFrame(rows, "source_id string, seq long, captured_at timestamp, good boolean, etag string, actual double")
    want = []
    for s, k, m in moments:
        best = max(((r[2], r[1], r[5]) for r in rows if s is not None and r[0] == s and r[2] is not None and m is not None and r[3] and r[2] <= m), default=(None, None, None))
        want.append((s, k, m, best[1], best[2]))
    got = A.last_good_asof(captures, spark.createDataFrame(moments, "source_id string, release_id long, moment timestamp"), F.col("good"), fields=("seq", "actual"))
    assert sorted([tuple(r) for r in got.select("source_id", "release_id", "moment", "base_seq", "base_actual").collect()], key=str) == sorted(want, key=str)
    none = A.last_good_asof(captures.limit(0), spark.createDataFrame(moments, "source_id string, release_id long, moment timestamp"), F.col("good"), fields=("seq",))
    assert {r.base_seq for r in none.collect()} == {None} and none.count() == len(moments)


@pytest.mark.parametrize("width", ["5 minutes", "30 minutes", "2 days"])
def test_interval_join_meets_each_pair_once(spark, width):
    made = random.Random(1)
    points = [(i, DAY + timedelta(seconds=made.randint(0, 20_000))) for i in range(300)] + [(300, None)]
    windows = [(k, DAY + timedelta(seconds=s), DAY + timedelta(seconds=s + made.choice([0, 60, 1800, 9000]))) for k, s in enumerate(made.choices(range(0, 20_000), k=40))] + [(40, None, None)]
    got = A.interval_join(spark.createDataFrame(points, "p long, at timestamp"), spark.createDataFrame(windows, "w long, lo timestamp, hi timestamp"), "at", "lo", "hi", width).select("p", "w").collect()
    assert sorted(map(tuple, got)) == sorted((p, w) for p, at in points if at for w, lo, hi in windows if lo and lo <= at <= hi)


def test_interval_join_plans_no_nested_loop(spark):
    points, windows = spark.createDataFrame([(1, DAY)], "p long, at timestamp"), spark.createDataFrame([(1, DAY, DAY)], "w long, lo timestamp, hi timestamp")
    plan = A.interval_join(points, windows, "at", "lo", "hi", "1 hour")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_interval_join_unfolds_equal_windows(spark):
    """Windows of one start and end, some with a null id, some repeated; a column that must be equal; a map, which has no hash."""
    points = [(i, "ab"[i % 2], DAY + timedelta(minutes=i)) for i in range(200)] * 2 + [(900, None, DAY)]
    windows = [(k // 2 if k % 7 else None, "ab"[k // 3 % 2], DAY + timedelta(minutes=60 * (k % 3)), DAY + timedelta(minutes=60 * (k % 3) + 50), {"k": str(k % 5)}) for k in range(60)] + [(1, None, DAY, DAY, {})]
    got = A.interval_join(spark.createDataFrame(points, "p long, s string, at timestamp"), spark.createDataFrame(windows, "w long, s string, lo timestamp, hi timestamp, m map<string, string>"), "at", "lo", "hi", "1 hour", ("s",))
    assert got.columns == ["s", "p", "at", "w", "lo", "hi", "m"]
    want = [(s, p, at, w, lo, hi, m) for p, s, at in points for w, own, lo, hi, m in windows if s is not None and s == own and lo <= at <= hi]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_interval_join_deals_one_bin_to_many_tasks(spark):
    points = spark.range(2000).coalesce(1).select("id", F.lit(DAY).alias("at"))
    windows = spark.range(30).coalesce(1).select(F.col("id").alias("w"), F.lit(DAY).alias("lo"), F.lit(DAY).alias("hi"))
    tasks = A.interval_join(points, windows, "at", "lo", "hi", "1 hour").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 60_000


def test_interval_join_pairs_pack_when_written(spark, tmp_path):
    """A point with all 20,000 windows of its time in turn takes two bytes a row, since a page of Parquet then repeats nothing."""
    points = spark.range(200).select(F.col("id").alias("p"), F.lit(DAY).alias("at")).union(spark.range(50).select("id", F.lit(DAY - timedelta(days=9)).alias("at")))
    windows = spark.range(20_000).select((F.col("id") * 7 % 20_000).alias("w"), F.lit(DAY).alias("lo"), F.lit(DAY + timedelta(hours=1)).alias("hi"))
    A.interval_join(points, windows, "at", "lo", "hi", "1 hour").select("w", "p").write.option("compression", "snappy").parquet(str(tmp_path / "pairs"))
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.8 * 4_000_000
    got = spark.read.parquet(str(tmp_path / "pairs"))
    assert got.count() == 4_000_000 and got.select(F.sum(F.col("p") * 20_000 + F.col("w")), F.min("p"), F.max("p"), F.max("w")).first()[:] == (4_000_000 * 3_999_999 // 2, 0, 199, 19_999)


@pytest.mark.parametrize("n_points, n_windows", [(1, 1), (7, 2100), (520, 9), (600, 2020)])
def test_interval_join_unfolds_lists_of_any_length(spark, n_points, n_windows):
    points = spark.range(n_points).select(F.col("id").alias("p"), F.lit(DAY).alias("at"))
    windows = spark.range(n_windows).select(F.col("id").alias("w"), F.lit(DAY).alias("lo"), F.lit(DAY).alias("hi"))
    got = A.interval_join(points, windows, "at", "lo", "hi", "1 hour").select("p", "w")
    assert got.count() == got.distinct().count() == n_points * n_windows


# CSV


def cells(spark, line):
    return spark.createDataFrame([(line,)], "line string").select(readers.csv_cells(F.col("line")).alias("c")).first().c


def test_csv_cells_match_a_csv_reader(spark):
    made = random.Random(3)
    for _ in range(60):
        row = ["".join(made.choices('ab,"\n \x01\x02é', k=made.randint(1, 6))).strip() or "x" for _ in range(made.randint(1, 9))]
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL).writerow(row)
        assert cells(spark, out.getvalue().rstrip("\r\n")) == row
    assert cells(spark, 'Title, "a, b" ,, x ""y"",') == ["Title", "a, b", "", 'x "y"', ""]


def test_twenty_thousand_quoted_columns(spark):
    line = ",".join(f'"GDP, series ""{i}"""' for i in range(20_000))
    rows = spark.createDataFrame([(line,)], "line string").select(readers.csv_cells(F.col("line")).alias("c")).select(F.size("c").alias("n"), F.get("c", F.lit(19_999)).alias("last"))
    rows.first()
    start = time.perf_counter()
    assert tuple(rows.first()) == (20_000, 'GDP, series "19999"')
    assert time.perf_counter() - start < 5  # about 0.3 s on an idle machine


def test_records_with_line_breaks_in_quotes(spark):
    body = 'Title,"GDP\nmonthly","Index, ""2022"""\r\n\r\n"Release Date",14-05-2026,14-05-2026\r\n2026 MAR,1.5,\r\n2026 APR,-0.2,100.1'
    lines = readers.csv_records(spark.createDataFrame([(7, body)], "doc_id int, body string"))
    lines = lines.withColumn("line_no", F.dense_rank().over(readers.Window.partitionBy("doc_id").orderBy("line_no")) - 1)
    got = {(r.series_id, str(r.period), r.value, str(r.release_date)) for r in readers.read_wide_series(lines).collect()}
    assert got == {("GDP\nmonthly", "2026-03-01", 1.5, "2026-05-14"), ("GDP\nmonthly", "2026-04-01", -0.2, "2026-05-14"), ('Index, "2022"', "2026-04-01", 100.1, "2026-05-14")}


# places of matches


def test_contexts_match_slices_of_the_page(spark):
    made = random.Random(2)
    page = "".join(made.choice(["<a x>", "text ", "é", "中 ", "<b>"]) for _ in range(1500))
    got = spark.createDataFrame([(page,)], "p string").select(E.anchors_in_context(F.col("p"), "<a x>", 30, 50).alias("c"), E.match_places(F.col("p"), "(?i)<A X>").alias("at")).first()
    raw, at = page.encode(), []
    while (i := raw.find(b"<a x>", at[-1] + 1 if at else 0)) >= 0:
        at.append(i)
    assert [(m.start, m.stop) for m in got.at] == [(i, i + 5) for i in at]
    cut = lambda b: b.decode("utf-8", "ignore")
    assert [(c.before, c.hit, c.after) for c in got.c] == [(cut(raw[max(0, i - 30) : i]), "<a x>", cut(raw[i + 5 : i + 55])) for i in at]
    none = spark.createDataFrame([("no anchor",), ("",), (None,)], "p string").select(E.anchors_in_context(F.col("p"), "<a x>", 3, 3).alias("c")).collect()
    assert [r.c for r in none] == [[], [], None]


def test_many_anchors_take_linear_time(spark):
    def took(n):
        page = "".join(f"<p>June 3, 2026</p><a href='/x{i}'>t</a>" for i in range(n))
        rows = spark.createDataFrame([(page,)], "p string").select(F.size(E.match_places(F.col("p"), r"<a\s[^>]*>")).alias("n"))
        rows.first()
        start = time.perf_counter()
        assert rows.first().n == n
        return time.perf_counter() - start

    small, large = took(25_000), took(100_000)
    assert large < 9 * max(small, 0.2), (small, large)


# character references


def test_references_agree_with_the_standard(spark):
    """Every legacy name bare and before letters, names that begin with one, numbers of all kinds."""
    legacy = [n for n in html5 if not n.endswith(";")]
    cases = [f"&{n}" for n in legacy] + [f"&{n}zz 1" for n in legacy] + [f"x &{n};y" for n in legacy] + [f"&{n}" for n in list(html5)[::9]]
    cases += ["&#8722 x", "&#8722;", "&#x2212g", "&#65&#66;", "&copy 2026", "&amp c", "a&b", "&", "&;", "&#;", "&#x;", "&foo;", "&#38;lt;", "&notit; &notin; &notin", "no reference", ""]
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", C.decode_entities(F.col("c")).alias("d")).collect()
    assert [(r.c, r.d) for r in rows if r.d != html.unescape(r.c).replace("\xa0", " ")] == []  # no-break spaces are spaces here
    odd = spark.createDataFrame([("&#0; &#xD800 &#1114112; &#99999999999999999999;",)], "c string").select(C.decode_entities(F.col("c")).alias("d")).first().d
    assert odd == "� � � �"
    strict = spark.createDataFrame([("/a?x=1&copy=2&amp;y=3",)], "c string").select(C.decode_entities(F.col("c"), loose=False).alias("d")).first().d
    assert strict == "/a?x=1&copy=2&y=3"


# identity and cross-checks


def test_all_violations_of_a_payload_are_listed(spark):
    data = "/root/testdata/sf0.001"
    good = X.payload_figures(spark, data).filter("release_id = 0")
    payload = spark.createDataFrame([(0, DAY.date().replace(month=5), DAY.date().replace(month=4)), (1, None, None)], "release_id long, period date, from_period date")
    check = lambda figures: {r.release_id: r.violations for r in V.check_identity(payload, figures, X.payload_definitions(spark), F.lit("2026-05-01").cast("date")).collect()}
    missing = ["Core PPI (MoM): missing", "Core PPI (YoY): missing", "PPI (MoM): missing", "PPI (YoY): missing"]
    assert check(good) == {0: [], 1: ["stale period", *missing]}
    both = good.withColumns({"unit": F.when(F.col("event_name") == "PPI (MoM)", "index").otherwise(F.col("unit")), "actual": F.when(F.col("event_name") == "PPI (MoM)", F.lit(float("nan"))).otherwise(F.col("actual"))})
    assert check(both)[0] == ["PPI (MoM): unit", "PPI (MoM): no value", "PPI (MoM): out of bounds"]
    yearly = good.withColumn("from_period", F.lit("2025-05-01").cast("date"))
    assert check(yearly)[0] == ["Core PPI (MoM): from period", "Core PPI (YoY): from period", "PPI (MoM): from period", "PPI (YoY): from period"]
    assert check(good.limit(0))[0] == missing


def test_parts_that_a_document_lacks_contradict_nothing(spark):
    row = spark.range(1).select(*[F.lit(None).cast("double").alias(c) for c in "abcd"], *[F.lit(None).cast("date").alias(c) for c in "wxyz"])
    assert row.select(V.check_document(*[F.col(c) for c in "abwxyzcd"]).alias("v")).first().v == []


def test_dimensions_are_bounded(spark):
    assert len(staging.small_rows(spark.range(5), 5)) == 5
    with pytest.raises(ValueError, match="more than 4"):
        staging.small_rows(spark.range(5), 4)


def test_pages_of_one_small_file_are_parsed_by_all_cores(spark, tmp_path):
    import datetime as dt

    from tidemark.plans.catalog import QUERIES
    from tidemark.sources import fixtures as X

    rows = [(i, dt.datetime(2024, 1, 1 + i % 28), float(i % 100)) for i in range(500)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    for pages in (X.history_pages, X.crosscheck_pages):
        assert pages(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count() >= spark.sparkContext.defaultParallelism
    assert QUERIES["card_history_join"](spark, str(tmp_path)).filter("reason is null").count() == 500
