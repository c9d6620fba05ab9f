"""Sinks: confirmed releases as JSON documents, snapshots as partitioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def release_documents(obs: DataFrame, order: str, fields: list[str], key: str = "release_id", evidence: DataFrame | None = None) -> DataFrame:
    """One JSON document per release with its metrics in definition order, and the columns of ``evidence``: matched sources, warnings, latency."""
    metrics = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), F.struct(*fields).alias("m"))))
    docs = obs.groupBy(key).agg(F.transform(metrics, lambda x: x["m"]).alias("metrics"))
    if evidence is not None:
        docs = docs.join(evidence, key, "left")
    return docs.select(key, F.to_json(F.struct(key, "metrics", *[c for c in docs.columns if c not in (key, "metrics")])).alias("document"))


def document_of(rows: DataFrame, fields: list[str], key: str = "release_id") -> DataFrame:
    """(key, document): each row of a table or a stream as a JSON document of its key and ``fields``."""
    return rows.select(key, F.to_json(F.struct(key, *fields)).alias("document"))


def write_release_json(docs: DataFrame, path: str) -> None:
    docs.select(F.col("document").alias("value")).write.text(path)


def write_table(df: DataFrame, path: str, mode: str = "append", by: str | None = "release_id") -> None:
    """A snapshot, baseline or performance table."""
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(path)


def upsert_snapshot(old: DataFrame, new: DataFrame, keys: list[str], newest: Column) -> DataFrame:
    """Rows of both with the newest per key."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*both.columns), newest).alias("_r")).select("_r.*")
