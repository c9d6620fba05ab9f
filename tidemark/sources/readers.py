"""Scans and series readers. Every reader takes text columns or paths and yields long-form rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from .model import CAPTURE


def read_captures(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The capture log with its declared schema; stored by release_id and date, filters on them prune folders."""
    return spark.read.schema(CAPTURE).format(fmt).load(path)


def stream_captures(spark: SparkSession, path: str, schema: str = CAPTURE, max_files: int = 100) -> DataFrame:
    """The append-only stream of captures that a folder receives."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored pages or extracted PDF text; text files are one row each in ``body``."""
    if fmt == "text":
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("body"), F.input_file_name().alias("url"))
    return spark.read.format(fmt).load(path)


# wide CSV


def _cut_outside_quotes(text: Column, mark: str) -> Column:
    """``text`` cut at each ``mark`` that no quotes hold, in time linear in it: every second piece between quotes lies inside."""
    safe = F.replace(F.replace(text, F.lit("\x02"), F.lit("\x02b")), F.lit("\x01"), F.lit("\x02a"))
    pieces = F.transform(F.split(safe, '"'), lambda x, i: F.when(i % 2 == 0, F.replace(x, F.lit(mark), F.lit("\x01"))).otherwise(x))
    return F.transform(F.split(F.array_join(pieces, '"'), "\x01"), lambda x: F.replace(F.replace(x, F.lit("\x02a"), F.lit("\x01")), F.lit("\x02b"), F.lit("\x02")))


def csv_cells(line: Column) -> Column:
    """Cells of a CSV record; commas and line breaks inside quotes don't part cells, doubled quotes are one."""
    return F.transform(_cut_outside_quotes(line, ","), lambda x: F.trim(F.replace(F.regexp_replace(x, r'(?s)^\s*"|"\s*$', ""), F.lit('""'), F.lit('"'))))


def csv_records(docs: DataFrame, body: str = "body", key: str = "doc_id") -> DataFrame:
    """(key, line_no, line): the records of whole files, whose quoted cells may hold line breaks; empty lines go."""
    text = F.replace(F.replace(F.col(body), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return docs.select(key, F.posexplode(_cut_outside_quotes(text, "\n")).alias("line_no", "line")).filter("trim(line) <> ''")


def read_wide_series(lines: DataFrame) -> DataFrame:
    """doc_id, series_id, period, value, release_date, next_release from (doc_id, line_no, line).

    Line 0 names the series; the first column labels the rows. Metadata rows become
    columns; rows may be short. Headers and metadata are one row per column of a file.
    """
    cells = lines.select("doc_id", "line_no", csv_cells(F.col("line")).alias("c")).withColumn("label", F.upper(F.get("c", F.lit(0))))
    long = cells.select("doc_id", "line_no", "label", F.posexplode("c").alias("col_no", "cell")).filter("col_no > 0")
    head = long.filter("line_no = 0").select("doc_id", "col_no", F.col("cell").alias("series_id"))
    meta = long.filter("label in ('RELEASE DATE', 'NEXT RELEASE')").groupBy("doc_id", "col_no").agg(
        F.max(F.when(F.col("label") == "RELEASE DATE", F.col("cell"))).alias("release_date"), F.max(F.when(F.col("label") == "NEXT RELEASE", F.col("cell"))).alias("next_release")
    )
    data = long.filter(F.rlike("label", F.lit("^[0-9]{4} [A-Z]{3}$"))).select("doc_id", "col_no", C.to_period(F.col("label")).alias("period"), F.expr("try_cast(nullif(cell, '') as double)").alias("value"))
    at = ["doc_id", "col_no"]
    return data.filter("value is not null").join(head, at).join(meta, at, "left").select("doc_id", "series_id", "period", "value", C.parse_release_date(F.col("release_date")).alias("release_date"), C.parse_release_date(F.col("next_release")).alias("next_release"))


#: role -> words that a normalised header must and must not hold.
HEADER_RULES = {
    "index": (("index",), ("contribution", "3 month", "3m", "growth")),
    "mom": (("month on month", "growth"), ("contribution", "3 month", "3m")),
    "yoy": (("year on year", "growth"), ("contribution", "3 month", "3m")),
}


def header_role(header: Column, rules: dict = HEADER_RULES) -> Column:
    """Role of a column by its header, null for none."""
    t = C.squeeze(F.regexp_replace(F.lower(header), "[^a-z0-9]+", " "))
    out = F.lit(None).cast("string")
    for role, (need, refuse) in reversed(rules.items()):
        ok = F.lit(True)
        for w in need:
            ok = ok & F.contains(t, F.lit(w))
        for w in refuse:
            ok = ok & ~F.contains(t, F.lit(w))
        out = F.when(ok, F.lit(role)).otherwise(out)
    return out


def resolve_series_columns(headers: DataFrame, rules: dict = HEADER_RULES) -> DataFrame:
    """(doc_id, role, col_no, header): the first column of each role."""
    roles = headers.withColumn("role", header_role(F.col("header"), rules)).filter("role is not null")
    return roles.groupBy("doc_id", "role").agg(F.min_by(F.struct("col_no", "header"), "col_no").alias("c")).select("doc_id", "role", "c.*")


# flat text


def parse_flat_series(lines: DataFrame, line: str = "line") -> DataFrame:
    """series_id, period, value, footnote from white-space separated lines; annual averages (M13) go."""
    c = F.split(F.trim(F.col(line)), r"\s+")
    at = lambda i: F.get(c, F.lit(i))
    rows = lines.select(at(0).alias("series_id"), C.bls_period(at(1).try_cast("int"), at(2)).alias("period"), at(3).try_cast("double").alias("value"), at(4).alias("footnote"))
    return rows.filter("period is not null and value is not null")


def read_flat_series(spark: SparkSession, path: str, series_ids: list[str] | None = None) -> DataFrame:
    rows = parse_flat_series(spark.read.text(path), "value")
    return rows.filter(F.col("series_id").isin(series_ids)) if series_ids else rows


# JSON

JSON_SERIES = "status string, message array<string>, Results struct<series:array<struct<seriesID:string,data:array<struct<year:string,period:string,periodName:string,value:string>>>>>"
KEYED = "seriesDetail map<string,struct<label:string,description:string>>, observations array<map<string,string>>"
VECTORS = "array<struct<status:string,object:struct<productId:long,coordinate:string,vectorId:long,vectorDataPoint:array<struct<refPer:string,value:double,decimals:int,releaseTime:string>>>>>"


def json_envelope(body: Column) -> Column:
    """Reason for which a series document is refused, null if it isn't: status, and exactly one series."""
    j = F.from_json(body, JSON_SERIES)
    status = F.coalesce(j["status"], F.lit(""))
    return F.when(j["Results"].isNull(), "malformed").when(~status.isin("", "REQUEST_SUCCEEDED"), F.concat(F.lit("status "), status)).when(F.size(j["Results"]["series"]) != 1, "not one series")


def read_json_series(captures: DataFrame, body: str = "body") -> DataFrame:
    """series_id, period, value (text) of the documents that the envelope lets pass."""
    good = captures.filter(json_envelope(F.col(body)).isNull()).select(F.from_json(body, JSON_SERIES)["Results"]["series"].alias("s"))
    points = good.select(F.inline("s")).select("seriesID", F.inline("data"))
    return points.select(F.col("seriesID").alias("series_id"), C.bls_period(F.col("year").try_cast("int"), F.col("period")).alias("period"), "value").filter("period is not null")


def read_keyed_observations(captures: DataFrame, body: str = "body", key: str = "series_key") -> DataFrame:
    """Per document: its series' label and the last observation with a value."""
    j = captures.withColumn("_j", F.from_json(body, KEYED))
    rows = j.select(key, F.try_element_at(F.col("_j.seriesDetail"), F.col(key))["label"].alias("label"), F.posexplode(F.col("_j.observations")).alias("pos", "o"))
    rows = rows.select(key, "label", "pos", F.to_date(F.try_element_at("o", F.lit("d"))).alias("date"), C.blank_to_null(F.get_json_object(F.try_element_at("o", F.col(key)), "$.v")).alias("v"))
    last = rows.filter("label is not null and v is not null").groupBy(key, "label").agg(F.max_by(F.struct("date", "v"), "pos").alias("x"))
    return last.select(key, "label", "x.date", F.col("x.v").try_cast("double").alias("value"))


def read_vector_points(captures: DataFrame, body: str = "body") -> DataFrame:
    """Latest and previous point of each vector document whose status is SUCCESS."""
    first = captures.select(F.get(F.from_json(body, VECTORS), F.lit(0)).alias("x")).filter("x.status = 'SUCCESS'").select("x.object.*")
    points = first.select("productId", "vectorId", F.inline("vectorDataPoint")).select("productId", "vectorId", F.to_date("refPer").alias("period"), "value", "decimals").filter("value is not null")
    by = Window.partitionBy("vectorId").orderBy(F.col("period").desc())
    ranked = points.withColumns({"n": F.row_number().over(by), "previous": F.lead("value").over(by), "previous_period": F.lead("period").over(by)})
    return ranked.filter("n = 1").drop("n")


def check_series_identity(meta: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Metadata with the first reason for which it is not the expected series."""
    e = expected.select(key, *[F.col(c).alias(f"expected_{c}") for c in expected.columns if c != key])
    reason = F.lit(None).cast("string")
    for c in reversed([c for c in expected.columns if c != key]):
        reason = F.when(~F.col(c).eqNullSafe(F.col(f"expected_{c}")), F.lit(f"{c} differs")).otherwise(reason)
    joined = meta.join(e.withColumn("_there", F.lit(True)), key, "left")
    return joined.withColumn("reason", F.when(F.col("_there").isNull(), "not expected").otherwise(reason)).select(*meta.columns, "reason")
