"""Extraction from document tables: cells, rows, sentences, links, schedules. Built-ins only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.staging import small_rows

_TABLE = r"(?is)(<table\b.*?</table>)"
_ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
_CELL = r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"


def cells_of(html: Column) -> Column:
    """array<array<string>>: the text of every cell of every row."""
    rows = F.regexp_extract_all(html, F.lit(_ROW), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(_CELL), F.lit(1)), lambda x: C.html_to_text(x)))


def html_table_cells(docs: DataFrame, key: str = "doc_id", html: str = "body") -> DataFrame:
    """(key, row_no, cell_no, text), both numbers from 0."""
    rows = docs.select(key, F.posexplode(cells_of(F.col(html))).alias("row_no", "cells"))
    return rows.select(key, "row_no", F.posexplode("cells").alias("cell_no", "text"))


def select_table_block(html: Column, keywords: list[str]) -> Column:
    """The first table that holds all keywords, else the whole document."""
    def fits(t: Column) -> Column:
        ok = F.lit(True)
        for k in keywords:
            ok = ok & F.contains(F.lower(t), F.lit(k.lower()))
        return ok

    return F.coalesce(F.get(F.filter(F.regexp_extract_all(html, F.lit(_TABLE), F.lit(1)), fits), F.lit(0)), html)


def labelled_rows(docs: DataFrame, key: str = "doc_id", html: str = "body") -> DataFrame:
    """(key, row_no, label, cells): rows with a normalised first cell and the texts after it."""
    rows = docs.select(key, F.posexplode(cells_of(F.col(html))).alias("row_no", "c")).filter(F.size("c") > 1)
    return rows.select(key, "row_no", C.norm_label(F.get("c", F.lit(0))).alias("label"), F.slice("c", F.lit(2), F.size("c") - 1).alias("cells"))


def lookup_labelled_row(docs: DataFrame, rows: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document and target: the row, if exactly one matches; else ``reason``: 'no row' or 'ambiguous row'.

    ``targets``: target, and the columns of ``rows`` (label, or label with group and item)
    on which they match exactly; a bounded dimension, laid out as an array per document.
    """
    on = [c for c in targets.columns if c != "target"]
    hits = rows.join(targets, on).groupBy(key, "target").agg(F.count("*").alias("n_matches"), F.min_by("cells", "row_no").alias("cells"))
    names = [r.target for r in small_rows(targets.select("target").distinct())]
    wanted = docs.select(key).distinct().withColumn("target", F.explode(F.array(*map(F.lit, names)).cast("array<string>")))
    out = wanted.join(hits, [key, "target"], "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    reason = F.when(F.col("n_matches") == 0, "no row").when(F.col("n_matches") > 1, "ambiguous row")
    return out.select(key, "target", "n_matches", F.when(F.col("n_matches") == 1, F.col("cells")).alias("cells"), reason.alias("reason"))


def lookup_text_row(text: Column, label: str, width: int, accept) -> Column:
    """Numbers that follow ``label`` within ``width`` characters, of the first place that ``accept`` lets pass."""
    after = F.regexp_extract_all(text, F.lit(rf"(?is)\b{label}\b([^a-z]{{1,{width}}})"), F.lit(1))
    return F.get(F.filter(F.transform(after, C.numbers_from_text), accept), F.lit(0))


def pick(numbers: Column, index: Column) -> Column:
    """The number at an index; a negative one counts from the end."""
    return F.try_element_at(numbers, F.when(index >= 0, index + 1).otherwise(index))


def pick_metrics(rows: DataFrame, metrics: DataFrame, keep: list[str]) -> DataFrame:
    """Long metrics from rows with ``label`` and ``numbers``: metric definitions joined on the row label."""
    m = metrics.select(F.col("row_label").alias("label"), "metric_id", "number_index")
    return rows.join(m, "label").select(*keep, "metric_id", pick(F.col("numbers"), F.col("number_index")).alias("value"))


#: Ordered patterns of a change in a sentence: words, sign (0: no change).
CHANGE_PATTERNS = (
    (r"(?i)\b(?:grew|rose|increased|up|growth of)(?: an estimated)?(?: by)? ([-−]?[0-9.]+)%", 1),
    (r"(?i)\b(?:fell|declined|decreased|contracted|down)(?: an estimated)?(?: by)? ([-−]?[0-9.]+)%", -1),
    (r"(?i)\b(showed no growth|was unchanged|remained flat|showed no change)\b", 0),
)


def signed_value(text: Column, patterns=CHANGE_PATTERNS) -> Column:
    """First pattern that fits: the parsed sign for rises, minus the size for falls, 0 for flat."""
    out = F.lit(None).cast("double")
    for pattern, sign in reversed(patterns):
        hit = C.group(text, pattern)
        value = {1: C.number(hit), -1: -F.abs(C.number(hit)) + F.lit(0.0), 0: F.lit(0.0)}[sign]
        out = F.when(hit.isNotNull(), value).otherwise(out)
    return out


def sentence_around(text: Column, pattern: str) -> Column:
    """The sentence with the pattern; a point before a digit does not end one."""
    inside = r"(?:[^.!?]|\.(?=[0-9]))*"
    return F.trim(C.group(text, rf"({inside}{pattern}{inside}[.!?]?)"))


def section_between(text: Column, start: str, ends: list[str]) -> Column:
    """From a marker to the nearest of the end markers, any case; to the end without one; null without start."""
    end = "|".join(rf"\Q{e}\E" for e in ends)
    return C.group(text, rf"(?is)(\Q{start}\E.*?)(?:{end}|\z)")


def align_values_to_labels(text: Column, labels: list[str]) -> Column:
    """label -> value, where labels and percents are listed in the same order ('respectively')."""
    places = F.filter(F.array(*[F.struct(F.locate(x, F.lower(text)).alias("at"), F.lit(x).alias("label")) for x in labels]), lambda s: s["at"] > 0)
    names = F.transform(F.array_sort(places), lambda s: s["label"])
    values = F.slice(F.transform(F.regexp_extract_all(text, F.lit(rf"({C.NUMBER})\s*%"), F.lit(1)), C.number), F.lit(1), F.size(names))
    return F.when(F.size(values) == F.size(names), F.map_from_arrays(names, values))


def candidate_blocks(docs: DataFrame, labels: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block_no, block, n_labels): lines that hold a label, the first of equal ones."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("block_no", "line"))
    found = F.size(F.filter(F.array(*map(F.lit, labels)), lambda x: F.contains(F.lower("line"), x)))
    hits = lines.withColumns({"block": C.squeeze(F.col("line")), "n_labels": found}).filter("n_labels > 0")
    return hits.groupBy(key, "block").agg(F.min("block_no").alias("block_no"), F.max("n_labels").alias("n_labels"))


_ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)["']?[^>]*>(.*?)</a>"""


def absolute(href: Column, base: Column) -> Column:
    """An address resolved against the page's."""
    origin = C.group(base, r"^([a-z]+://[^/?#]+)")
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(^[a-z]+://[^/]+.*)/[^/]*$", "$1")
    return (
        F.when(F.rlike(href, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), href)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(folder, F.lit("/"), href))
    )


def extract_links(docs: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", href_pattern: str = ".", text_pattern: str = "", loose: bool = True) -> DataFrame:
    """(key, pos, href, url, text) of anchors, the first of each address per document; ``loose``: of their texts, as in ``decode_entities``."""
    pair = F.arrays_zip(F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(2)).alias("text"))
    rows = docs.select(key, F.col(url).alias("_base"), F.posexplode(pair).alias("pos", "a"))
    rows = rows.select(key, "pos", C.decode_entities(F.col("a.href"), loose=False).alias("href"), C.html_to_text(F.col("a.text"), loose=loose).alias("text"), "_base")
    rows = rows.filter(F.rlike("href", F.lit(href_pattern)) & F.rlike("text", F.lit(text_pattern))).withColumn("url", absolute(F.col("href"), F.col("_base")))
    return rows.groupBy(key, "url").agg(F.min("pos").alias("pos"), F.min_by(F.struct("href", "text"), "pos").alias("x")).select(key, "pos", "x.href", "url", "x.text")


#: Matches whose places are added up in one go.
_RUN = 256


def match_places(text: Column, pattern: str) -> Column:
    """array<struct<start, stop>>: the bytes of each match, from 0, from the running lengths of matches and of what is between.

    Runs of matches are added up on their own, from the sums of the runs before, so that time is
    linear in the matches.
    """
    parts = F.struct(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    step = "struct<gap:bigint,hit:bigint>"

    def summed(first: Column, lengths: Column) -> Column:
        """Starts and stops of a run that begins at ``first``."""
        none = F.struct(first.cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("out"))

        def add(acc: Column, x: Column) -> Column:
            start, stop = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["hit"]
            return F.struct(stop.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), stop.alias("stop"))).alias("out"))

        return F.aggregate(lengths, none, add, lambda acc: acc["out"])

    def places(p: Column) -> Column:
        lengths = F.transform(p["hit"], lambda h, i: F.struct(F.octet_length(F.get(p["gap"], i)).cast("bigint").alias("gap"), F.octet_length(h).cast("bigint").alias("hit"))).cast(f"array<{step}>")
        runs = C.bound(lengths, lambda n: F.transform(F.filter(F.sequence(F.lit(0), F.size(n)), lambda i: (i % _RUN == 0) & (i < F.size(n))), lambda i: F.slice(n, i + 1, F.lit(_RUN))))

        def all_runs(r: Column) -> Column:
            sizes = F.transform(r, lambda run: F.aggregate(run, F.lit(0).cast("bigint"), lambda total, x: total + x["gap"] + x["hit"]))
            firsts = F.aggregate(sizes, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
            return C.bound(firsts, lambda f: F.flatten(F.transform(r, lambda run, i: summed(F.get(f, i), run))))

        return C.bound(runs, all_runs)

    return C.bound(parts, places)


def in_context(text: Column, anchor: str, before: int, after: int, body: Callable[[Column], Column]) -> Column:
    """``body`` of each match of an anchor with what surrounds it, a struct(before, hit, after), in order.

    Contexts are cut from the page's bytes where the match is (an incomplete character at an edge goes), one
    at a time, so a page with many anchors holds none of them longer than ``body`` takes.
    """
    def whole(cut: Column) -> Column:
        return F.regexp_replace(F.make_valid_utf8(cut.cast("string")), "^\ufffd+|\ufffd+$", "")

    def around(page: Column) -> Column:
        cut = lambda start, size: whole(F.substring(page["b"], (start + 1).cast("int"), size.cast("int")))
        return F.transform(page["at"], lambda m: C.bound(F.struct(
            cut(F.greatest(m["start"] - before, F.lit(0)), F.least(m["start"], F.lit(before))).alias("before"), cut(m["start"], m["stop"] - m["start"]).alias("hit"), cut(m["stop"], F.lit(after)).alias("after")), body))

    return C.bound(F.struct(text.cast("binary").alias("b"), match_places(text, rf"(?is){anchor}").alias("at")), around)


def anchors_in_context(text: Column, anchor: str, before: int, after: int) -> Column:
    """array<struct(before, hit, after)>: what surrounds each match of an anchor, in order; sizes in bytes."""
    return in_context(text, anchor, before, after, lambda x: x)


def first_that_parses(text: Column, anchor: str, before: int, after: int, parse: Callable[[Column], Column], *needed: str) -> Column:
    """The first context whose parsed struct has all of ``needed``: a listing's later items count where earlier ones don't parse."""
    parsed = in_context(text, anchor, before, after, parse)
    return F.get(F.filter(parsed, lambda x: reduce(lambda a, b: a & b, (x[n].isNotNull() for n in needed))), F.lit(0))


def last_match(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


#: Places of a title before the h1: a script's variable, a meta element.
SCRIPT_TITLE = r"""(?is)\btitle\s*[:=]\s*"([^"]+)\""""
META_TITLE = r"""(?is)<meta[^>]*(?:name|property)=["'](?:og:|dc\.)?title["'][^>]*content=["']([^"']*)["']"""


def extract_title(html: Column, first: tuple[str, ...] = (), preferred: str | None = None, loose: bool = True) -> Column:
    """By order: patterns of ``first``, an h1 that fits ``preferred``, an h1 that isn't a search page's, the title element; ``loose`` as in ``decode_entities``."""
    text = lambda x: C.html_to_text(x, loose=loose)
    heads = F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h1[^>]*>(.*?)</h1>"), F.lit(1)), text), lambda h: (h != "") & ~F.contains(F.lower(h), F.lit("search results")))
    fitting = [F.get(F.filter(heads, lambda h: F.rlike(h, F.lit(preferred))), F.lit(0))] if preferred else []
    title = text(C.group(html, r"(?is)<title[^>]*>(.*?)</title>"))
    return C.first_non_blank(*[text(C.group(html, p)) for p in first], *fitting, F.get(heads, F.lit(0)), title)


def guard_reason(text: Column, required: list[str], forbidden: list[str]) -> Column:
    """First reason to refuse a document, null for none."""
    out = F.lit(None).cast("string")
    for k in reversed(required):
        out = F.when(~F.contains(F.lower(text), F.lit(k)), F.lit(f"missing {k}")).otherwise(out)
    for k in reversed(forbidden):
        out = F.when(F.contains(F.lower(text), F.lit(k)), F.lit(f"has {k}")).otherwise(out)
    return F.when(text.isNull(), "no body").otherwise(out)


def apply_guards(docs: DataFrame, text: Column, required: list[str], forbidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted documents, and rejects with their reason."""
    marked = docs.withColumn("reason", guard_reason(text, required, forbidden))
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


_HEAD = r"[A-Z][a-z]{2} \d{1,2}, \d{4} \([A-Z][a-z]{2}\)"


def extract_history_rows(docs: DataFrame, key: str = "doc_id", text: str = "body") -> DataFrame:
    """(key, release_date, period, actual, forecast, previous) of third-party history rows.

    A header starts a row that ends before the next one. Three values are actual, forecast
    and previous; two are forecast and previous of a release to come; one is actual.
    """
    rows = docs.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(rf"({_HEAD}.*?)(?={_HEAD}|$)"), F.lit(1))).alias("row"))
    values = F.transform(F.regexp_extract_all("row", F.lit(rf"({C.NUMBER})%"), F.lit(1)), C.number)
    rows = rows.withColumns({"v": values, "release_date": C.parse_release_date(F.col("row")), "m": C.month_no(C.group(F.col("row"), r"\(([A-Z][a-z]{2})\)"))})
    n, at = F.size("v"), lambda i: F.get("v", F.lit(i))
    return rows.select(
        key, "release_date", C.bracket_period(F.col("release_date"), F.col("m")).alias("period"),
        F.when(n != 2, at(0)).alias("actual"), F.when(n >= 3, at(1)).when(n == 2, at(0)).alias("forecast"), F.when(n >= 3, at(2)).when(n == 2, at(1)).alias("previous"),
    )


def extract_release_card(docs: DataFrame, key: str = "doc_id", text: str = "body") -> DataFrame:
    """(key, release_date, actual, forecast, previous) of the card before the history."""
    card = section_between(F.col(text), "Latest Release", ["History"])
    value = lambda label: C.number(C.group(card, rf"{label}\s+({C.NUMBER})%"))
    return docs.select(key, C.parse_release_date(card).alias("release_date"), value("Actual").alias("actual"), value("Forecast").alias("forecast"), value("Previous").alias("previous"))


#: layout -> the row's pattern, groups of period, date and time; a time of its own where rows have none.
SCHEDULES = {
    "rows": (r"([A-Z][a-z]+ \d{4}) ([A-Z][a-z]{2,8}\.? \d{1,2}, \d{4}) (\d{1,2}:\d{2} [AP]M)", (1, 2, 3), None),
    "sentence": (r"for ([A-Z][a-z]+ \d{4}) (?:is|are) scheduled to be released on (?:[A-Z][a-z]+day, )?([A-Z][a-z]{2,8}\.? \d{1,2}, \d{4}),? at (\d{1,2}:\d{2} [AaPp]\.?[Mm])", (1, 2, 3), None),
    "dates": (r"\b((?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2})\b(?!, \d{4})", (None, 1, None), "9:45 AM"),
    "next": (r"(?:Released|Release date|Next release): (\d{1,2} [A-Z][a-z]+ \d{4})(?: at)? ?(\d{1,2}:\d{2} ?[ap]m)?", (None, 1, 2), "7:00 AM"),
}


def extract_schedule(docs: DataFrame, tz: str, key: str = "doc_id", text: str = "text", layout: str = "rows", year: str | None = None) -> DataFrame:
    """(key, reference_period, release_ts) of the rows of a layout, in the publisher's time, as UTC.

    ``year`` (a column) is that of a table whose dates have none; without a period of its
    own, a row's is the month before its release.
    """
    pattern, (period, date, time), usual = SCHEDULES[layout]
    part = lambda i: C.group(F.col("row"), pattern, i)
    keep = [key, *([year] if year else [])]
    rows = docs.select(*keep, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("row"))
    day = C.parse_release_date(F.concat_ws(", ", part(date), F.col(year).cast("string")) if year else F.regexp_replace(part(date), r"\.", ""))
    clock = F.upper(F.regexp_replace(part(time) if time else F.lit(usual), r"[.\s]", ""))
    clock = F.coalesce(clock, F.lit(usual.replace(" ", ""))) if usual else clock
    local = F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), clock), F.lit("yyyy-MM-dd h:mma")).cast("timestamp_ntz")
    return rows.select(key, (C.to_period(part(period)) if period else F.add_months(F.trunc(day, "MM"), -1)).alias("reference_period"), C.to_utc(local, tz).alias("release_ts"))


def extract_rate_table(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """First row with a year and at least six cells: year, date, deposit, fixed, variable, marginal."""
    rows = cells.groupBy(key, "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_no", "text"))), lambda x: x["text"]).alias("c"))
    good = rows.filter((F.size("c") >= 6) & F.rlike(F.get("c", F.lit(0)), F.lit(r"^\s*\d{4}\s*$"))).groupBy(key).agg(F.min_by("c", "row_no").alias("c"))
    at = lambda i: C.number_from_cell(F.get("c", F.lit(i)))
    date = C.parse_release_date(F.concat_ws(" ", F.regexp_replace(F.get("c", F.lit(1)), r"[.\s]+$", ""), F.trim(F.get("c", F.lit(0)))))
    return good.select(key, date.alias("effective"), at(2).alias("deposit"), F.coalesce(at(3), at(4)).alias("main"), at(5).alias("marginal"))


def change_period(text: Column) -> Column:
    """struct(from_period, period) of a 'Mon yyyy - Mon yyyy' header; preliminary marks go."""
    t = F.regexp_replace(text, r"\(p\)|\bp\b", "")
    pattern = r"([A-Z][a-z]+\.?\s+\d{4})\s*[-–]\s*([A-Z][a-z]+\.?\s+\d{4})"
    return F.struct(C.to_period(C.group(t, pattern, 1)).alias("from_period"), C.to_period(C.group(t, pattern, 2)).alias("period"))


def last_number(text: Column) -> Column:
    """The weak fallback: the last number of a row."""
    return F.try_element_at(C.numbers_from_text(text), F.lit(-1))
