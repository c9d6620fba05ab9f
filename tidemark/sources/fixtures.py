"""Views of the driver tables in the shape of release data, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from .staging import shared_path, spread, table


def captures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("release_id"), F.col("event_type").alias("source_id"), F.col("event_id").alias("seq"), F.col("ts").alias("captured_at"),
        F.col("props").alias("etag"), F.sha2("props", 256).alias("content_hash"), "value", F.floor(F.col("value") / 100).cast("double").alias("actual"),
    )


def event_time(release: str = "release_id"):
    return F.expr(f"timestamp_ntz'2024-01-10 12:30:00' + make_dt_interval(cast({release} % 10 as int), 0, 0, 0)")


def releases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("release_id")).distinct().withColumn("event_time", event_time())


SOURCES = [("purchase", 1, True, True), ("signup", 2, False, True), ("click", 3, False, True), ("view", 4, False, False), ("error", 5, False, True)]


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "source_id string, priority int, is_primary boolean, is_value boolean")


def in_poll_window(spark: SparkSession, d: str) -> DataFrame:
    joined = captures(spark, d).join(releases(spark, d), "release_id")
    return joined.filter("captured_at between event_time - interval 2 seconds and event_time + interval 3 days")


def obs(spark: SparkSession, d: str) -> DataFrame:
    return in_poll_window(spark, d).groupBy("release_id", "source_id").agg(F.min_by("actual", "captured_at").alias("actual"), F.min("captured_at").alias("hit_at"))


def series(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series_id"), F.trunc("o_orderdate", "MM").alias("period")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("level"))


def html_tables(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, body: a navigation table, then one row (twice for every fifth part)."""
    row = F.format_string("<tr><th>%s (1)</th><td>%d</td><td>%.2f(p)</td></tr>", "p_brand", "p_size", "p_retailprice")
    rows = F.concat(row, F.when(F.col("p_partkey") % 5 == 0, row).otherwise(F.lit("")))
    body = F.concat(F.lit("<html><table><tr><td>Home</td><td>About 7</td></tr></table><p>Table 1</p><table class='data'>"), rows, F.lit("</table></html>"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), body.alias("body"))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and a sentence with a signed value and a month, between two others."""
    verb = F.when(F.col("event_type") == "error", "fell").when(F.col("event_type") == "view", "showed no growth").otherwise("grew")
    value = F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.format_string(" by %.1f%%", F.floor(F.col("value") / 10).cast("double") / 10))
    text = F.concat(F.lit("Statistics were published today. Monthly GDP "), verb, value, F.lit(" in "), F.date_format("ts", "MMMM yyyy"), F.lit(". More will follow."))
    return table(spark, d, "events").select(F.col("event_id").alias("doc_id"), text.alias("text"))


def series_json(spark: SparkSession, d: str) -> DataFrame:
    """body: one document per series; that of '5-LOW' has failed."""
    rows = series(spark, d).select("series_id", F.struct(F.date_format("period", "yyyy").alias("year"), F.concat(F.lit("M"), F.date_format("period", "MM")).alias("period"), F.date_format("period", "MMMM").alias("periodName"), F.when(F.month("period") == 2, "-").otherwise(F.col("level").cast("string")).alias("value")).alias("p"))
    docs = rows.groupBy("series_id").agg(F.collect_list("p").alias("data"))
    status = F.when(F.col("series_id").startswith("5"), "REQUEST_FAILED").otherwise("REQUEST_SUCCEEDED")
    inner = F.struct(F.array(F.struct(F.col("series_id").alias("seriesID"), "data")).alias("series"))
    return docs.select("series_id", F.to_json(F.struct(status.alias("status"), inner.alias("Results"))).alias("body"))


def keyed_json(spark: SparkSession, d: str) -> DataFrame:
    """series_key, body: observations in order of date, the last of them blank."""
    s = series(spark, d)
    point = F.concat(F.lit('{"d":"'), F.col("period").cast("string"), F.lit('","'), F.col("series_id"), F.lit('":{"v":"'), F.col("level").cast("string"), F.lit('"}}'))
    docs = s.groupBy("series_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("period", point.alias("p")))), lambda x: x["p"]), ",").alias("points"))
    blank = F.concat(F.lit(',{"d":"2030-01-01","'), F.col("series_id"), F.lit('":{"v":""}}'))
    body = F.concat(F.lit('{"seriesDetail":{"'), F.col("series_id"), F.lit('":{"label":"L '), F.col("series_id"), F.lit('","description":"x"}},"observations":['), F.col("points"), blank, F.lit("]}"))
    return docs.select(F.col("series_id").alias("series_key"), body.alias("body"))


def vector_json(spark: SparkSession, d: str) -> DataFrame:
    s = series(spark, d)
    points = F.collect_list(F.struct(F.col("period").cast("string").alias("refPer"), F.col("level").cast("double").alias("value"), F.lit(1).alias("decimals"), F.lit("x").alias("releaseTime")))
    docs = s.groupBy("series_id").agg(points.alias("p"))
    vector = F.substring("series_id", 1, 1).cast("long")
    obj = F.struct(F.lit(14100287).cast("long").alias("productId"), F.lit("1.7.1.1").alias("coordinate"), vector.alias("vectorId"), F.col("p").alias("vectorDataPoint"))
    return docs.select(F.to_json(F.array(F.struct(F.lit("SUCCESS").alias("status"), obj.alias("object")))).alias("body"))


def flat_lines(spark: SparkSession, d: str) -> DataFrame:
    """line: monthly rows and an annual average (M13) per year."""
    s = series(spark, d).withColumn("code", F.regexp_replace("series_id", "[^A-Z0-9]+", "_"))
    month = s.select(F.format_string("  %s  %d\tM%02d   %d  ", "code", F.year("period"), F.month("period"), "level").alias("line"))
    year = s.groupBy("code", F.year("period").alias("y")).agg(F.avg("level").cast("long").alias("a")).select(F.format_string("%s %d M13 %d A", "code", "y", "a").alias("line"))
    return month.union(year)


def wide_lines(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, line_no, line: header, metadata and one line per month, months missing at the end cut short."""
    s = series(spark, d)
    names = [r[0] for r in s.select("series_id").distinct().orderBy("series_id").collect()]
    wide = s.groupBy("period").pivot("series_id", names).agg(F.first("level"))
    cells = F.concat_ws(",", F.upper(F.date_format("period", "yyyy MMM")), *[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names])
    data = wide.select(F.lit(1).alias("doc_id"), (F.months_between("period", F.lit("1990-01-01")).cast("int") + 10).alias("line_no"), F.regexp_replace(cells, ",+$", "").alias("line"))
    head = [(1, 0, ",".join(["Title", *[f'"{n}"' for n in names]])), (1, 1, ",".join(["CDID", *[f"C{i}" for i, _ in enumerate(names)]])), (1, 2, ",".join(["Release Date", *["14-05-2026"] * len(names)])), (1, 3, ",".join(["Next release", *["12 June 2026"] * len(names)]))]
    return spark.createDataFrame(head, "doc_id int, line_no int, line string").union(data)


def event_pages(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, body: dates, a linked title and a rate sentence, from an event."""
    e = table(spark, d, "events")
    day = lambda n: F.date_format(F.date_add(F.to_date("ts"), n), "MMMM d, yyyy")
    rate = F.format_string("%.2f", F.floor(F.col("value")).cast("double") / 100)
    body = F.concat(F.lit("<p>"), day(-7), F.lit("</p><p>old</p><p>"), day(0), F.lit("</p><h3><a href='/press/"), F.col("event_id"), F.lit("'>Bank sets rate</a></h3><p>The target is now "), rate, F.lit("%.</p>"))
    return e.select(F.col("event_id").alias("doc_id"), body.alias("body"))


def history_pages(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, body: a card, then rows 'Mon d, yyyy (Mon)' with two or three values, from an event."""
    e = spread(table(spark, d, "events"), "event_id")
    day = lambda m: F.date_format(F.add_months(F.to_date("ts"), m), "MMM d, yyyy")
    month = lambda m: F.date_format(F.add_months(F.to_date("ts"), m), "MMM")
    v = F.format_string("%.1f%%", F.floor(F.col("value") / 10).cast("double") / 10)
    body = F.concat(
        F.lit("Latest Release "), day(0), F.lit(" Actual "), v, F.lit(" Forecast 0.6% Previous 0.9% History "),
        day(1), F.lit(" ("), month(0), F.lit(") 08:30 0.5% 0.6% "), day(0), F.lit(" ("), month(-1), F.lit(") 08:30 "), v, F.lit(" 0.6% 0.9% "), day(-1), F.lit(" ("), month(-2), F.lit(") 08:30 0.9% "),
    )
    return e.select(F.col("event_id").alias("doc_id"), body.alias("body"))


# captures with failures, stale documents and events; the same as files in no order of time

#: The capture log of the detection path: what a fetch returned, what was read from it, and the event it is for.
LOG = "release_id long, source_id string, seq long, captured_at timestamp, status_code int, etag string, period long, actual double, error string, event_time timestamp"
PERIOD, BOUNDS = 1, (0.0, 3.0)


def capture_log(spark: SparkSession, d: str) -> DataFrame:
    """Captures of which every 13th failed and every 7th shows another period than the expected one."""
    failed = F.col("seq") % 13 == 0
    return captures(spark, d).select(
        "release_id", "source_id", "seq", F.col("captured_at").cast("timestamp").alias("captured_at"), F.when(failed, 500).otherwise(200).alias("status_code"), F.when(~failed, F.col("etag")).alias("etag"),
        F.when(F.col("seq") % 7 == 0, 0).otherwise(PERIOD).cast("long").alias("period"), F.when(~failed, F.col("actual")).alias("actual"), F.when(failed, F.format_string("HTTP 500 at poll %d", "seq")).alias("error"), event_time().cast("timestamp").alias("event_time"),
    )


def good():
    return (F.col("status_code") == 200) & F.col("actual").isNotNull()


def valid():
    return (F.col("period") == PERIOD) & F.col("actual").between(*BOUNDS)


def detection_policies(spark: SparkSession) -> DataFrame:
    """A row of switches per source, none for 'error'."""
    on, off = True, False
    rows = [  # status, etag, modified, hash, period, value, blank is same, validity only
        ("value", "purchase", off, off, off, off, off, on, off, off), ("headers", "signup", off, on, off, off, off, off, on, off),
        ("all", "click", on, on, off, off, on, on, on, off), ("valid", "view", off, off, off, off, off, on, on, on),
    ]
    return spark.createDataFrame(rows, "policy string, source_id string, use_status boolean, use_etag boolean, use_modified boolean, use_hash boolean, use_period boolean, use_value boolean, blank_is_same boolean, validity_only boolean")


def capture_files(spark: SparkSession, d: str, files: int = 4) -> str:
    """A folder with the log in ``files`` files, each a random part of it, and a heartbeat long after, written last."""
    path = shared_path(spark, "capture-files")
    log = capture_log(spark, d)
    log.repartition(files, F.xxhash64("seq")).write.parquet(path)
    beat = log.agg(F.max("captured_at").alias("captured_at")).select(F.expr("captured_at + interval 400 days").alias("captured_at"))
    beat.select(*[F.col(c) if c == "captured_at" else F.lit(None).cast(kind).alias(c) for c, kind in log.dtypes]).coalesce(1).write.mode("append").parquet(path)
    return path


# payloads and pages that contradict their definitions or themselves

#: The figures of a published producer-price table, as event, row, group, item, kind, seasonality.
PPI = [
    ("Core PPI (MoM)", "Final demand less foods and energy", "FD", "49104", "mom", "seasonally adjusted"), ("Core PPI (YoY)", "Final demand less foods and energy", "FD", "49104", "yoy", "unadjusted"),
    ("PPI (MoM)", "Final demand", "FD", "4", "mom", "seasonally adjusted"), ("PPI (YoY)", "Final demand", "FD", "4", "yoy", "unadjusted"),
]


def payload_definitions(spark: SparkSession) -> DataFrame:
    rows = [(*x, "%", "United States", "Table 1", -50.0, 50.0) for x in PPI]
    return spark.createDataFrame(rows, "event_name string, row_label string, group_code string, item_code string, kind string, seasonality string, unit string, country string, table_name string, lo double, hi double")


def payload_figures(spark: SparkSession, d: str) -> DataFrame:
    """Four figures per release, one of which has the fault of the release's number (release_id modulo 19; none at 0 and 18)."""
    period = F.when(F.col("release_id") % 19 == 18, F.lit("2026-04-01")).otherwise(F.lit("2026-05-01")).cast("date")
    four = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(v).alias(n) for n, v in zip(("event_name", "row_label", "group_code", "item_code", "kind", "seasonality"), x, strict=True)]) for i, x in enumerate(PPI)])
    rows = releases(spark, d).select("release_id", period.alias("period"), F.explode(four).alias("x")).select("release_id", "period", "x.*")
    fault = F.when(F.col("i") == F.floor(F.col("release_id") / 19) % 4, F.col("release_id") % 19).otherwise(0)
    other = lambda n, wrong, value: F.when(fault == n, wrong).otherwise(value)
    yearly, label = F.col("kind") == "yoy", F.concat("row_label", F.lit(" (1)"))
    column = F.when(yearly, C.yoy_label(F.col("period"))).otherwise(C.mom_label(F.col("period")))
    before = F.when(~yearly, F.add_months("period", -1))
    rows = rows.select(
        "release_id", other(17, F.lit("Other PPI"), F.col("event_name")).alias("event_name"), other(1, F.lit(None), F.lit("United States")).alias("country"), other(2, F.lit("Table 2"), F.lit("Table 1")).alias("table_name"), other(3, F.lit("index"), F.lit("%")).alias("unit"),
        other(4, F.add_months("period", -1), F.col("period")).alias("period"), other(5, F.lit("calculated"), F.lit("direct_table_value")).alias("value_method"), F.when(fault == 6, F.lit(None)).when(fault == 7, 50.1).otherwise(0.4).alias("actual"),
        other(8, F.lit("Final demand less foods, energy, and trade services"), label).alias("row_label"), other(9, F.lit(None), F.col("group_code")).alias("group_code"), other(10, F.lit("49116"), F.col("item_code")).alias("item_code"), other(11, F.lit("other"), F.col("seasonality")).alias("seasonality"),
        other(12, F.lit("Mar. to Apr.(p)"), column).alias("column_label"), other(13, F.add_months("period", -2), before).alias("from_period"), F.when((fault == 14) | yearly, F.lit(None)).otherwise(0.2).alias("previous"), F.when(fault == 15, 2).when(fault == 16, 0).otherwise(1).alias("_n"),
    )
    # an event that is not defined stands in the place of one that is: that one is there besides
    rows = rows.withColumn("event_name", F.explode(F.when(F.col("event_name") == "Other PPI", F.array("event_name", F.element_at(F.array(*[F.lit(x[0]) for x in PPI]), (F.floor(F.col("release_id") / 19) % 4 + 1).cast("int")))).otherwise(F.array("event_name"))))
    return rows.withColumn("_c", F.explode(F.array_repeat(F.lit(1), F.col("_n")))).drop("_n", "_c")


def crosscheck_pages(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, body: a title, a sentence, a metric block, a change-from header and three levels; of seven pages five contradict themselves."""
    e, k = spread(table(spark, d, "events"), "event_id"), F.col("event_id") % 7
    month = lambda n, form: F.date_format(F.add_months(F.to_date("ts"), n), form)
    value = F.format_string("%.1f", F.floor(F.col("value") / 10).cast("double") / 10 + 0.1)
    last = F.format_string("%.1f", 100 + F.floor(F.col("value") / 10).cast("double") / 10 + 0.1 + F.when(k.isin(4, 6), 0.3).otherwise(0.0))
    body = F.concat(
        F.lit("<h1>Monthly estimate, "), month(0, "MMMM yyyy"), F.lit("</h1><p>Monthly GDP grew by "), value, F.lit("% in "), F.when(k == 2, month(-1, "MMMM yyyy")).otherwise(month(0, "MMMM yyyy")), F.lit(".</p><p>Headline figure: "),
        F.when(k.isin(1, 6), F.lit("9999.5")).otherwise(value), F.lit("%</p><p>Page of "), month(0, "MMM yyyy"), F.lit("</p><p>Change from: "), month(-1, "MMM yyyy"), F.lit(" - "), F.when(k == 3, month(-2, "MMM yyyy")).otherwise(month(0, "MMM yyyy")),
        F.lit("</p><p>Levels 99.5 100.0 "), last, F.lit(" change "), value, F.lit("</p>"),
    )
    return e.select(F.col("event_id").alias("doc_id"), body.alias("body"))


def crosscheck_parts(pages: DataFrame) -> DataFrame:
    """What a page of ``crosscheck_pages`` says in each of its places; the text, and the sentence, are made once."""
    from ..operators import extract as E

    read = pages.select("doc_id", E.extract_title(F.col("body")).alias("title"), C.html_to_text(F.col("body")).alias("text"))
    piece = lambda pattern: C.group(F.col("text"), pattern)
    read = read.withColumns({"sentence": piece(r"(Monthly GDP [^.]*\.[0-9][^.]*\.)"), "page": piece(r"Page of ([A-Z][a-z]+ \d{4})"), "header": piece(r"Change from: (.*?) Levels")})
    text, sentence = F.col("text"), F.col("sentence")
    number = lambda pattern: C.number(C.group(text, pattern))
    return read.select(
        "doc_id", E.signed_value(sentence).alias("value"), number(rf"Headline figure: ({C.NUMBER})%").alias("block_value"), C.to_period(sentence).alias("sentence_period"), C.to_period(F.col("title")).alias("title_period"),
        C.to_period(F.col("page")).alias("page_period"), E.change_period(F.col("header"))["period"].alias("column_period"),
        number(rf" change ({C.NUMBER})").alias("published"), (number(rf"Levels {C.NUMBER} {C.NUMBER} ({C.NUMBER})") - number(rf"Levels {C.NUMBER} ({C.NUMBER})")).alias("level_change"),
    )
