"""Column expressions: periods, dates, numbers, text. All of them run in the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from html.entities import html5
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = r"\b(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\b\.?"
#: Named entities decoded, with the ampersand last.
ENTITIES = {"&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&minus;": "−", "&ndash;": "–", "&mdash;": "—", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
#: All named references, with their semicolon and, where they may go without it, bare.
_NAMED = {f"&{name}": text for name, text in html5.items()} | ENTITIES | {name[:-1]: text for name, text in ENTITIES.items() if name[1:-1] in html5}
#: They are looked up in one of so many small maps, since Spark searches a map key by key.
_SHELVES = 256
_SHELVED: list[dict[str, str]] = [{} for _ in range(_SHELVES)]
for _key, _text in _NAMED.items():
    _SHELVED[crc32(_key.encode()) % _SHELVES][_key] = _text
#: Lengths, with the ampersand, that names without semicolon have.
_BARE = sorted({len(name) for name in _NAMED if not name.endswith(";")}, reverse=True)
#: What browsers read for numbers 128 to 159.
_CONTROLS = bytes(range(128, 160)).decode("cp1252", "replace")
_REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"
#: Spaces that \s does not match.
ODD_SPACES = "   "
NUMBER = r"[-−]?[0-9][0-9,]*(?:\.[0-9]+)?"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def group(c: Column, pattern: str, index: int = 1) -> Column:
    """A regular expression's group, null (not empty) without a match."""
    return F.nullif(F.regexp_extract(c, pattern, index), F.lit(""))


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_match(c: Column, pattern: str, at: int = 1) -> Column:
    """The first match of a regular expression (``at`` -1: the last), null without one."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lit(at))


def first_non_blank(*cols: Column) -> Column:
    return F.coalesce(*map(blank_to_null, cols))


# periods


def month_no(c: Column) -> Column:
    """Month number of a full or three-letter English name, 'Sept' and a trailing dot included; null for any other word."""
    numbers = {name.lower(): i + 1 for i, m in enumerate(MONTHS) for name in (m, m[:3])} | {"sept": 9}
    names = [x for name, i in numbers.items() for x in (F.lit(name), F.lit(i))]
    return F.try_element_at(F.create_map(*names), F.regexp_replace(F.lower(F.trim(c)), r"\.$", ""))


def to_period(c: Column) -> Column:
    """First of the month named by '2026-04', 'April 2026', '2026 APR' or '2026 M04 Results', the last if a text names several; null if none fits."""
    made = lambda y, m: F.try_make_timestamp(y.cast("int"), m.cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    word = lambda m: month_no(F.regexp_extract(m, "[A-Za-z]+", 0))
    iso, coded = r"^\s*(\d{4})-(\d{2})(?:-\d{2})?\s*$", r"(\d{4})\s+M(0[1-9]|1[0-2])\b"
    # the text, and a match in it, are bound: what coalesce may skip would be evaluated wherever it is named
    return bound(c, lambda t: F.coalesce(
        made(group(t, iso, 1), group(t, iso, 2)),
        bound(first_match(t, coded), lambda m: made(F.left(m, F.lit(4)), F.right(m, F.lit(2)))),
        bound(first_match(t, rf"(?i){_MONTH}\s+(\d{{4}})", -1), lambda m: made(F.right(m, F.lit(4)), word(m))),
        bound(first_match(t, rf"(?i)(\d{{4}})\s+{_MONTH}", -1), lambda m: made(F.left(m, F.lit(4)), word(m))),
    ))


def bls_period(year: Column, code: Column) -> Column:
    """Period of a year and 'M01'..'M12'; the annual average M13 and years outside 1900-2200 give null."""
    good = F.rlike(code, F.lit("^M(0[1-9]|1[0-2])$")) & year.cast("int").between(1900, 2200)
    return F.when(good, F.make_date(year.cast("int"), F.substring(code, 2, 2).cast("int"), F.lit(1)))


def prev_month(p: Column) -> Column:
    return F.add_months(p, -1)


def prev_year(p: Column) -> Column:
    return F.add_months(p, -12)


def expected_period(event: Column, tz: str) -> Column:
    """The month before the event's month in the publisher's time zone; ``event`` is UTC."""
    return F.add_months(F.trunc(F.convert_timezone(F.lit("UTC"), F.lit(tz), event), "MM"), -1)


def bracket_period(release_date: Column, month: Column) -> Column:
    """Period of a bracketed month: in the release's year, or the year before if it lies after the release."""
    return F.make_date(F.year(release_date) - (month > F.month(release_date)).cast("int"), month, F.lit(1))


def parse_release_date(c: Column) -> Column:
    """Date of 'Jan 2, 2006', 'January 2, 2006', '2 January 2006', '02-01-2006', '2006-01-02' or a YYMMDD slug."""
    def found(t: Column, pattern: str, date: Callable[[Column], Column]) -> Column:
        return bound(first_match(t, pattern), lambda m: F.when(m.isNotNull(), date(m)))

    def named(t: Column, p: str, y: int, m: int, d: int) -> Column:
        parts = lambda x: (F.regexp_extract(x, p, y), F.lpad(month_no(F.regexp_extract(x, p, m)).cast("string"), 2, "0"), F.lpad(F.regexp_extract(x, p, d), 2, "0"))
        return found(t, p, lambda x: F.try_to_date(F.concat_ws("-", *parts(x)), "yyyy-MM-dd"))

    slug = r"(?:^|[^0-9])(\d{2})(\d{2})(\d{2})(?:[^0-9]|$)"
    century = lambda x: F.when(F.left(x, F.lit(2)).cast("int") >= 90, "19").otherwise("20")
    # bound as in to_period; a date is parsed only where one was found, since a failed parse is slow
    return bound(c, lambda t: F.coalesce(
        named(t, rf"(?i)\b{_MONTH}\s+(\d{{1,2}}),\s*(\d{{4}})", 3, 1, 2),
        named(t, rf"(?i)\b(\d{{1,2}})\s+{_MONTH}\s+(\d{{4}})", 3, 2, 1),
        found(t, r"\b(\d{2}-\d{2}-\d{4})\b", lambda x: F.try_to_date(x, "dd-MM-yyyy")),
        found(t, r"\b(\d{4}-\d{2}-\d{2})\b", lambda x: F.try_to_date(x, "yyyy-MM-dd")),
        found(t, slug, lambda x: bound(F.regexp_extract(x, r"\d{6}", 0), lambda n: F.try_to_date(F.concat(century(n), n), "yyyyMMdd"))),
    ))


def to_utc(local: Column, tz: str) -> Column:
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), local)


def display_period(p: Column) -> Column:
    return F.date_format(p, "MMMM yyyy")


def mom_label(p: Column, mark: str = "(p)") -> Column:
    """'Apr. to May(p)'; May has no dot."""
    short = lambda d: F.when(F.month(d) == 5, "May").otherwise(F.concat(F.date_format(d, "MMM"), F.lit(".")))
    return F.concat(short(prev_month(p)), F.lit(" to "), short(p), F.lit(mark))


def yoy_label(p: Column, mark: str = "(p)") -> Column:
    """'May 2025 to May 2026(p)'."""
    return F.concat(F.date_format(prev_year(p), "MMM yyyy"), F.lit(" to "), F.date_format(p, "MMM yyyy"), F.lit(mark))


# numbers


def round1(c: Column) -> Column:
    """One decimal, half away from zero on ten times the value, never minus zero."""
    return F.round(c * 10) / 10 + F.lit(0.0)


def round3(c: Column) -> Column:
    return F.round(c * 1000) / 1000 + F.lit(0.0)


def fmt_percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c + F.lit(0.0))


def fmt_rate(c: Column) -> Column:
    return F.format_string("%.2f%%", c + F.lit(0.0))


def fmt_k(c: Column) -> Column:
    """Thousands: '123K', '-4K'."""
    return F.concat(F.round(c).cast("long").cast("string"), F.lit("K"))


def fmt_trimmed(c: Column) -> Column:
    """Two decimals without trailing zeros."""
    return F.regexp_replace(F.format_string("%.2f", c + F.lit(0.0)), r"\.?0+$", "")


_FRACTIONS = {"¼": 0.25, "½": 0.5, "¾": 0.75}


def parse_value(c: Column, kind: str = "percent") -> Column:
    """Number of a published figure; '-', '--', 'N/A' and blanks are null.

    percent: sign, commas and '%' go, vulgar fractions add up. thousands: K is the base
    unit, M a thousand and B a million of it; a figure without suffix is in thousands.
    """
    t = F.replace(F.trim(c), F.lit("−"), F.lit("-"))
    t = F.when(~F.lower(t).isin("", "-", "--", "n/a", "na"), F.regexp_replace(t, r"[,%\s]", ""))
    if kind == "thousands":
        unit = F.upper(F.right(t, F.lit(1)))
        scale = F.when(unit == "M", 1000.0).when(unit == "B", 1_000_000.0).otherwise(1.0)
        return F.regexp_replace(t, "[KMBkmb]$", "").try_cast("double") * scale
    part = reduce(lambda rest, f: F.when(F.right(t, F.lit(1)) == f[0], F.lit(f[1])).otherwise(rest), _FRACTIONS.items(), F.lit(0.0))
    whole = F.when(part > 0, F.coalesce(F.nullif(F.regexp_replace(t, "[¼½¾]$", ""), F.lit("")), F.lit("0"))).otherwise(t)
    return whole.try_cast("double") + part


def values_equal(a: Column, b: Column, tolerance: Column | float) -> Column:
    return F.abs(a - b) < tolerance


def number(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(","), F.lit("")), F.lit("−"), F.lit("-")).try_cast("double")


def numbers_from_text(c: Column) -> Column:
    """All numbers of a text in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"({NUMBER})"), F.lit(1)), number)


def number_from_cell(c: Column) -> Column:
    """A cell's number; footnote marks after it go, and a cell that is only a footnote such as '(1)' is null."""
    t = F.translate(F.trim(c), ODD_SPACES, " " * len(ODD_SPACES))
    only = F.rlike(t, F.lit(r"^\s*\([0-9a-zA-Z]+\)\s*$"))
    bare = F.regexp_replace(t, r"\s*\([0-9a-zA-Z]+\)\s*$", "")
    return F.when(~only & F.rlike(bare, F.lit(rf"^\s*{NUMBER}\s*%?\s*$")), number(F.regexp_replace(bare, r"[\s%]", "")))


# text


def _referred(ref: Column) -> Column:
    """What a character reference stands for; itself if nothing. Of a name without semicolon the longest beginning that is a name counts."""
    shelves = F.from_json(F.lit(json.dumps(_SHELVED)), "array<map<string,string>>")
    named = lambda name: F.try_element_at(F.get(shelves, (F.crc32(name) % _SHELVES).cast("int")), name)
    begun = [F.concat(named(F.substring(ref, 1, n)), F.substring(ref, F.lit(n + 1), F.char_length(ref))) for n in _BARE]
    digits = F.regexp_replace(ref, "[&#xX;]", "")
    far = F.lit(0x110000)  # of numbers beyond a long
    number = F.when(F.rlike(ref, F.lit("^&#[0-9]")), F.coalesce(digits.try_cast("long"), far)).when(F.startswith(ref, F.lit("&#")), F.coalesce(F.conv(digits, 16, 10).try_cast("long"), far))

    def char(n: Column) -> Column:
        good = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        text = F.decode(F.unhex(F.lpad(F.hex(F.when(good, n).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
        return F.when(n.between(128, 159), F.substring(F.lit(_CONTROLS), n.cast("int") - 127, F.lit(1))).otherwise(text)

    return F.when(number.isNotNull(), bound(number, char)).otherwise(F.coalesce(named(ref), *begun, ref))


def decode_entities(c: Column, loose: bool = True) -> Column:
    """Named and numeric character references decoded, once each; ``loose``: without semicolon too, as in texts, not in addresses."""
    pattern = _REFERENCE + "?" if loose else _REFERENCE

    def decoded(t: Column) -> Column:
        parts = F.struct(F.split(t, pattern).alias("gaps"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("refs"))
        joined = bound(parts, lambda p: F.array_join(F.transform(p["gaps"], lambda g, i: F.concat(g, F.coalesce(_referred(F.get(p["refs"], i)), F.lit("")))), ""))
        return F.when(F.contains(t, F.lit("&")), joined).otherwise(t)

    return bound(c, decoded)


def squeeze(c: Column) -> Column:
    """Runs of spaces of any kind as one space, none at the ends."""
    # a single plain space is one already, and most are
    other = rf"\t\n\x0B\f\r{ODD_SPACES}"
    return F.trim(F.regexp_replace(c, f"(?: [ {other}]|[{other}])[ {other}]*", " "))


def html_to_text(c: Column, block: str = " ", loose: bool = True) -> Column:
    """Visible text: script and style dropped, blocks and breaks as ``block``, entities decoded; ``loose`` as in ``decode_entities``."""
    t = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<br[^>]*>|</?(?:p|div|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|title|td|th)(?:\s[^>]*)?>", block)
    t = decode_entities(F.regexp_replace(t, r"<[^>]*>", ""), loose)
    if "\n" not in block:
        return squeeze(t)
    t = F.regexp_replace(F.translate(t, ODD_SPACES, " " * len(ODD_SPACES)), r"[ \t\r]+", " ")
    return F.trim(F.regexp_replace(t, r"\s*\n\s*", "\n"))


def norm_label(c: Column) -> Column:
    """A row label without footnote marks and case."""
    return F.lower(squeeze(F.regexp_replace(c, r"\s*\([0-9a-zA-Z]\)", "")))


def norm_title(c: Column) -> Column:
    return F.replace(F.lower(squeeze(c)), F.lit("u.s."), F.lit("united states"))


def norm_url(c: Column) -> Column:
    """Lower case, without scheme and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^https?://", ""), r"/+$", "")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def pages_hash(order: Column, body: Column) -> Column:
    """Hash of a document's pages put together in order (an aggregate)."""
    pages = F.array_sort(F.collect_list(F.struct(order.alias("at"), body.alias("body"))))
    return F.sha2(F.array_join(F.transform(pages, lambda x: x["body"]), ""), 256)


def event_latency_ms(at: Column, event: Column) -> Column:
    return F.unix_millis(at.cast("timestamp")) - F.unix_millis(event.cast("timestamp"))


def fmt_latency(ms: Column) -> Column:
    """'+0.123s'."""
    return F.format_string("%+.3fs", ms / 1000.0)


def unique_strings(a: Column) -> Column:
    """Trimmed, non-blank, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != ""))


def ordered_metrics(metrics: Column, order: list[str]) -> Column:
    """A map's values in definition order, null where missing."""
    return F.transform(F.array(*map(F.lit, order)), lambda k: F.try_element_at(metrics, k))


def signature(metrics: Column, order: list[str]) -> Column:
    """'name=value, ...' of the metrics present, in definition order."""
    named = F.transform(F.array(*map(F.lit, order)), lambda k: F.when(F.map_contains_key(metrics, k), F.concat(k, F.lit("="), F.try_element_at(metrics, k).cast("string"))))
    return F.array_join(F.array_compact(named), ", ")


def release_url(base: str, p: Column) -> Column:
    """A release page's address by period: '<base>/april2026'."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.lower(F.date_format(p, "MMMMyyyy")))


def last_segment(url: Column) -> Column:
    path = F.rtrim(F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]*", ""), r"[?#].*$", ""), F.lit("/"))
    return blank_to_null(F.element_at(F.split(path, "/"), -1))
