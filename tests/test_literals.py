"""Literal documents: published layouts and the figures that must come out of them."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import detect as D
from tidemark.operators import extract as E
from tidemark.operators import series as S
from tidemark.operators import validate as V
from tidemark.plans import reconcile as R
from tidemark.sources import readers


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_"))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("cell", "value"), [("(1)", None), ("(2)", None), (" (12) ", None), ("(p)", None), ("−0.3", -0.3), ("0.3(p)", 0.3), ("1,234.5", 1234.5), ("-", None), ("0.4%", 0.4)])
def test_number_from_cell(spark, cell, value):
    assert one(spark, C.number_from_cell(F.col("c")), c=cell) == value


@pytest.mark.parametrize(("text", "kind", "value"), [("2¼", "percent", 2.25), ("½", "percent", 0.5), ("0.4%", "percent", 0.4), ("N/A", "percent", None), ("123K", "thousands", 123.0), ("1.2M", "thousands", 1200.0), ("−4", "thousands", -4.0)])
def test_parse_value(spark, text, kind, value):
    assert one(spark, C.parse_value(F.col("c"), kind), c=text) == value


@pytest.mark.parametrize(("text", "value"), [("April 2026", date(2026, 4, 1)), ("2026-04", date(2026, 4, 1)), ("2026 APR", date(2026, 4, 1)), ("2026 M04 Results", date(2026, 4, 1)), ("Sept. 2025", date(2025, 9, 1)), ("n/a", None)])
def test_to_period(spark, text, value):
    assert one(spark, C.to_period(F.col("c")), c=text) == value


@pytest.mark.parametrize(("text", "value"), [("May 12, 2026", date(2026, 5, 12)), ("14 May 2026", date(2026, 5, 14)), ("14-05-2026", date(2026, 5, 14)), ("/mp260430.en.html", date(2026, 4, 30)), ("June 31, 2026", None)])
def test_release_dates(spark, text, value):
    assert one(spark, C.parse_release_date(F.col("c")), c=text) == value


@pytest.mark.parametrize(("v", "r"), [(0.25, 0.3), (-0.25, -0.3), (-0.04, 0.0), (0.05, 0.1)])
def test_round1(spark, v, r):
    got = one(spark, C.round1(F.col("c")), c=v)
    assert got == r and str(got) != "-0.0"


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("Monthly GDP is estimated to have grown. GDP grew by 0.3% in March 2026.", 0.3),
        ("Monthly GDP fell by 0.2% in April 2026.", -0.2),
        ("GDP showed no growth in May 2026.", 0.0),
        ("Nothing here.", None),
    ],
)
def test_signed_value(spark, text, value):
    assert one(spark, E.signed_value(F.col("c")), c=text) == value


def test_sentence_keeps_decimals(spark):
    text = "Published today. Monthly GDP grew by 0.3% in March. More later."
    assert one(spark, E.sentence_around(F.col("c"), "Monthly GDP"), c=text) == "Monthly GDP grew by 0.3% in March."


def test_rates_in_any_order(spark):
    text = "The interest rates on the main refinancing operations, the marginal lending facility and the deposit facility will be 3.10%, 3.35% and 2.95% respectively."
    got = one(spark, E.align_values_to_labels(F.col("c"), ["deposit facility", "main refinancing", "marginal lending"]), c=text)
    assert got == {"deposit facility": 2.95, "main refinancing": 3.1, "marginal lending": 3.35}


TABLE_1 = """<table><tr><td>All items less food and energy menu</td></tr></table><table><caption>Table 1. seasonally adjusted</caption>
<tr><th>All items</th><td>100.000</td><td>320.1</td><td>321.2</td><td>322.3</td><td>3.8</td><td>0.3</td><td>0.2</td><td>0.1</td><td>0.6</td></tr>
<tr><th>All items less food and energy(1)</th><td>79.5</td><td>325.1</td><td>326.2</td><td>327.3</td><td>2.8</td><td>0.2</td><td>0.2</td><td>0.3</td><td>0.4</td></tr></table>"""


def test_table_row_by_label_and_index(spark):
    docs = spark.createDataFrame([(1, TABLE_1), (2, TABLE_1 + TABLE_1)], "doc_id int, body string")
    targets = spark.createDataFrame([("core", "all items less food and energy")], "target string, label string")
    rows = {r.doc_id: r for r in E.lookup_labelled_row(docs, E.labelled_rows(docs), targets).collect()}
    assert rows[2].reason == "ambiguous row" and rows[2].cells is None
    numbers = spark.createDataFrame([(rows[1].cells,)], "c array<string>").select(F.transform("c", lambda x: C.number_from_cell(x)).alias("n"))
    got = numbers.select(E.pick(F.col("n"), F.lit(4)), E.pick(F.col("n"), F.lit(8)), E.pick(F.col("n"), F.lit(-1))).first()
    assert tuple(got) == (2.8, 0.4, 0.4)


def test_table_block_skips_navigation(spark):
    block = one(spark, E.select_table_block(F.col("c"), ["Table 1", "seasonally adjusted"]), c=TABLE_1)
    assert "menu" not in block and "325.1" in block


def test_text_row(spark):
    text = "Contents All items see page 4 for notes. All items 100.0 320.1 321.2 322.3 3.8 0.3 0.2 0.1 0.6 Food"
    shape = lambda n: (F.size(n) >= 9) & (F.get(n, F.lit(1)) >= 100)
    assert one(spark, E.pick(E.lookup_text_row(F.col("c"), "All items", 350, shape), F.lit(8)), c=text) == 0.6


def test_html_to_text(spark):
    page = "<html><script>var a='<p>no</p>';</script><p>One&nbsp;two</p><div>3 &amp;lt; 4</div><br/>end</html>"
    assert one(spark, C.html_to_text(F.col("c")), c=page) == "One two 3 &lt; 4 end"


def test_json_series_envelope(spark):
    good = '{"status":"REQUEST_SUCCEEDED","Results":{"series":[{"seriesID":"A","data":[{"year":"2026","period":"M04","periodName":"April","value":"321.5"},{"year":"2026","period":"M13","value":"1"},{"year":"2026","period":"M03","value":"-"}]}]}}'
    bad = '{"status":"REQUEST_NOT_PROCESSED","Results":{"series":[]}}'
    rows = readers.read_json_series(spark.createDataFrame([(good,), (bad,), ("{",), (None,)], "body string")).collect()
    assert {(r.series_id, r.period, r.value) for r in rows} == {("A", date(2026, 4, 1), "321.5"), ("A", date(2026, 3, 1), "-")}
    marked = {r.value: r.problem for r in S.clean_points(spark.createDataFrame([("1.5",), ("-",), ("x",), (None,)], "value string")).collect()}
    assert marked == {"1.5": None, "-": "missing", "x": "malformed", None: "missing"}


def test_indicators_respect_gaps(spark):
    s = spark.createDataFrame([("a", date(2026, 1, 1), 100), ("a", date(2026, 2, 1), 110), ("a", date(2026, 4, 1), 99), ("b", date(2026, 1, 1), 0), ("b", date(2026, 2, 1), 5)], "series_id string, period date, level long")
    mom = {(r.series_id, r.period.month): r.mom for r in S.mom(s).collect()}
    assert mom == {("a", 1): None, ("a", 2): 10.0, ("a", 4): None, ("b", 1): None, ("b", 2): None}
    diff = {(r.series_id, r.period.month): (r["diff"], r.previous_diff) for r in S.level_diff(s).collect()}
    assert diff["a", 2] == (10, None) and diff["a", 4] == (None, None)


def test_history_and_card(spark):
    text = "Latest Release May 12, 2026 Actual 0.6% Forecast 0.6% Previous 0.9% History Jun 10, 2026 (May) 08:30 0.5% 0.6% May 12, 2026 (Apr) 08:30 0.6% 0.6% 0.9% Jan 13, 2026 (Dec) 08:30 0.3%"
    docs = spark.createDataFrame([(1, text)], "doc_id int, body string")
    rows = {r.release_date: (r.period, r.actual, r.forecast, r.previous) for r in E.extract_history_rows(docs).collect()}
    assert rows == {
        date(2026, 6, 10): (date(2026, 5, 1), None, 0.5, 0.6),
        date(2026, 5, 12): (date(2026, 4, 1), 0.6, 0.6, 0.9),
        date(2026, 1, 13): (date(2025, 12, 1), 0.3, None, None),
    }
    card = E.extract_release_card(docs).first()
    assert (card.release_date, card.actual, card.forecast, card.previous) == (date(2026, 5, 12), 0.6, 0.6, 0.9)


def test_change_period(spark):
    got = one(spark, E.change_period(F.col("c")), c="Change from: Mar. 2026(p) - Apr. 2026(p)")
    assert (got.from_period, got.period) == (date(2026, 3, 1), date(2026, 4, 1))


def test_missing_baseline_counts_as_changed(spark):
    at = datetime(2026, 1, 1)
    caps = spark.createDataFrame([(1, "a", 1, at, 2.0), (1, "b", 2, at, 2.0)], "release_id long, source_id string, seq long, captured_at timestamp_ntz, actual double")
    base = spark.createDataFrame([(1, "a", 0, 2.0)], "release_id long, source_id string, base_seq long, base_actual double")
    assert {r.source_id: r.changed for r in D.join_baseline(caps, base).collect()} == {"a": False, "b": True}


def test_backup_that_differs_is_rejected(spark):
    sources = spark.createDataFrame([("p", 1, True, True), ("q", 2, False, True)], "source_id string, priority int, is_primary boolean, is_value boolean")
    releases = spark.createDataFrame([(1,), (2,), (3,), (4,)], "release_id long")
    obs = spark.createDataFrame([(1, "p", 2.25), (1, "q", 2.25), (2, "p", 2.25), (2, "q", 2.5), (3, "q", 1.0)], "release_id long, source_id string, actual double")
    got = {r.release_id: (r.status, r.reason) for r in R.confirm_releases(releases, obs, sources).collect()}
    assert got == {1: ("CONFIRMED", None), 2: ("NOT_CONFIRMED", "differs: q"), 3: ("NOT_CONFIRMED", "primary missing"), 4: ("NOT_CONFIRMED", "primary missing")}


def test_guards_and_grades(spark):
    docs = spark.createDataFrame([(1, "Table B-1 in thousands"), (2, "Access Denied"), (3, None)], "doc_id int, body string")
    ok, rejects = E.apply_guards(docs, F.col("body"), ["table b-1"], ["access denied"])
    assert [r.doc_id for r in ok.collect()] == [1]
    assert {r.doc_id: r.reason for r in rejects.collect()} == {2: "has access denied", 3: "no body"}
    assert one(spark, V.grade(F.lit(True), F.lit(False), F.lit(True), F.lit(True))) == "HIGH"


def test_wide_csv_with_quotes_and_short_rows(spark):
    lines = [(1, 0, 'Title,"GDP, index: CVM",GDP growth'), (1, 1, "CDID,ECYX,ECY2"), (1, 2, "Release Date,14-05-2026,14-05-2026"), (1, 3, "Next release,12 June 2026,12 June 2026"), (1, 4, "2026 FEB,100.1,0.2"), (1, 5, "2026 MAR,100.4"), (1, 6, "2026 Q1,1,2")]
    rows = readers.read_wide_series(spark.createDataFrame(lines, "doc_id int, line_no int, line string")).collect()
    assert {(r.series_id, r.period.month, r.value) for r in rows} == {("GDP, index: CVM", 2, 100.1), ("GDP growth", 2, 0.2), ("GDP, index: CVM", 3, 100.4)}
    assert {(r.release_date, r.next_release) for r in rows} == {(date(2026, 5, 14), date(2026, 6, 12))}


def test_links_are_absolute_and_first_of_each(spark):
    html = '<a href="/press/1.html">One</a> <A class=x HREF=\'b.html\'>Two</A><a href="https://o.org/">Out &amp; in</a><a href="/press/1.html">Again</a>'
    docs = spark.createDataFrame([(1, "https://e.org/dir/page?x=1", html)], "page_id int, url string, html string")
    got = {(r.url, r.text) for r in E.extract_links(docs).collect()}
    assert got == {("https://e.org/press/1.html", "One"), ("https://e.org/dir/b.html", "Two"), ("https://o.org/", "Out & in")}


def test_text_documents_are_one_row_each(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("three")
    rows = readers.read_documents(spark, f"file://{tmp_path}", "text").collect()
    assert {r.url.rsplit("/", 1)[1]: r.body for r in rows} == {"a.txt": "one\ntwo", "b.txt": "three"}


def test_leaderboard_goes_on_after_a_restart(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.streaming import jobs

    schema = "release_id long, source_id string, captured_at timestamp, seq long, event_time timestamp"
    rows = [(r, s, f"2024-01-10 12:{30 + (r * 7 + n * 5) % 20}:00", 10 * r + n) for r in range(20) for n, s in enumerate("abc")]
    batches = [rows[::2], rows[1::2]]
    for n, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "release_id long, source_id string, at string, seq long")
        df.select("release_id", "source_id", F.to_timestamp("at").alias("captured_at"), "seq", F.to_timestamp(F.lit("2024-01-10 12:30:00")).alias("event_time")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = readers.stream_captures(spark, f"file://{tmp_path}/in", schema)
        board = jobs.leaderboard_stream(stream, f"file://{tmp_path}/board", f"file://{tmp_path}/checkpoint")
        seen = sum(batches[: n + 1], [])
        assert sorted((r.release_id, r.source_id, r.seq) for r in board.collect()) == sorted((r, s, q) for r, s, _, q in seen)
    first = {r.release_id: r.source_id for r in board.filter("rank = 1").collect()}
    assert first == {r: min((at, s) for x, s, at, _ in rows if x == r)[1] for r in range(20)}


def test_stream_and_batch_find_the_same_changes_with_nulls(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.operators import detect
    from tidemark.streaming import jobs

    rows = [(1, s, n, f"2024-01-10 12:30:{n:02}", e, v) for s in "abc" for n, (e, v) in enumerate([("x", None), ("x", None), (None, 1.0), ("y", 1.0), ("y", None), ("", 2.0), ("z", 2.0)])]
    df = spark.createDataFrame(rows, "release_id long, source_id string, seq long, at string, etag string, actual double").withColumn("captured_at", F.to_timestamp("at")).drop("at")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    # a heartbeat, by which the watermark passes the captures
    spark.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes if c != "captured_at"], F.to_timestamp(F.lit("2024-02-10 00:00:00")).alias("captured_at")).write.mode("append").parquet(f"file://{tmp_path}/in")
    policies = spark.createDataFrame([("p", "a", False, True, False, False, False, True, False), ("p", "b", False, False, False, False, False, True, True)], detect.POLICY)
    batch = detect.detect_changes(df, policies).withColumn("method", detect.detection_method(F.col("headers_changed"), F.col("content_changed"))).filter("method is not null")
    stream = jobs.run_once(jobs.detect_changes_stream(readers.stream_captures(spark, f"file://{tmp_path}/in", df.schema.simpleString()[7:-1].replace(":", " ")), policies), "twin", rocks=True)
    got = sorted((r.source_id, r.seq, r.method) for r in stream.collect())
    assert got == sorted((r.source_id, r.seq, r.method) for r in batch.collect())
    assert {s for s, *_ in got} == {"a"} and ("a", 2, "headers+content") in got


def test_no_temporary_folder_on_a_cluster(spark):
    from tidemark.sources import staging

    class Cluster:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Cluster()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_path(Session(), "x")


def test_periods_and_dates_read_their_text_once(spark):
    """A derived text is evaluated once, whatever number of forms a date may have."""
    df = spark.range(1).select(F.col("id").cast("string").alias("t"))
    for read in (C.to_period, C.parse_release_date, C.decode_entities, C.html_to_text):
        plan = df.select(read(F.concat(F.col("t"), F.lit("-once-"))).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("-once-") == 1, read.__name__


def test_periods_dates_and_spaces_keep_their_forms(spark):
    periods = {"2026-04": "2026-04-01", " 2026-04-30 ": "2026-04-01", "2026-13": None, "2026 M04 Results": "2026-04-01", "March 2025, then Sept. 2026": "2026-09-01", "2026 APR": "2026-04-01", "12345 May": "2345-05-01", "Mayor 2026": None, "": None}
    assert {k: one(spark, C.to_period(F.col("c")).cast("string"), c=k) for k in periods} == periods
    dates = {"on Jan 2, 2006.": "2006-01-02", "2 January 2006": "2006-01-02", "31-01-2006": "2006-01-31", "x 2006-01-02": "2006-01-02", "/pr240131.htm": "2024-01-31", "/990131": "1999-01-31", "Feb 30, 2024": None, "none": None}
    assert {k: one(spark, C.parse_release_date(F.col("c")).cast("string"), c=k) for k in dates} == dates
    spaces = {" a  b\t\nc ": "a b c", "a b": "a b", "a   b": "a b", "a b": "a b", "": ""}
    assert {k: one(spark, C.squeeze(F.col("c")), c=k) for k in spaces} == spaces
