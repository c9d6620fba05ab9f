"""Tables staged in the folder that the whole cluster shares, and let go after their last use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession

#: Spark's own setting: shuffle files of a statement are deleted when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks for each core that ``spread`` deals rows to.
SPREAD = 4


def spread(df: DataFrame, *keys: str, each: int = SPREAD) -> DataFrame:
    """``df`` dealt evenly to all cores, ``each`` tasks a core, by its keys, before each row is made to much more work than its bytes tell.

    A file of a few megabytes is read in one task, and its pages would be parsed in that one.
    """
    return df.repartition(each * df.sparkSession.sparkContext.defaultParallelism, *keys)


def small_rows(df: DataFrame, most: int = 10_000) -> list[Row]:
    """The rows of a dimension that is bounded by what it describes; an error if it holds more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a dimension of more than {most} rows: {df.columns}")
    return rows


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder; on a cluster, whose
    executors could not see one, it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder}/tidemark/{name}-{uuid.uuid4().hex}"


#: Rows that go to a Python worker at once.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)


def written(df: DataFrame, path: str, arrow_rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet to ``path`` and read back; its shuffle files go when that has ended."""
    values = {SHUFFLE_CLEANUP: "true"} | ({ARROW_ROWS: str(arrow_rows)} if arrow_rows else {})
    with settings(df.sparkSession, values):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once in the shared folder and read back.

    Cuts the lineage, outlives lost executors, and gives Spark the table's true size, so
    that its own broadcast threshold decides on checked sizes.
    """
    return written(df, shared_path(df.sparkSession, name))


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Staging:
    """The staged tables of one job: each can be dropped after its last use, and the others go at its end."""

    def __init__(self, spark: SparkSession, arrow_rows: int | None = None):
        self.spark, self.arrow_rows = spark, arrow_rows
        self.held: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*(df for df, _ in list(self.held.values())))

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        out = written(df, path, self.arrow_rows)
        self.held[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the tables, which nothing may read any more."""
        for df in tables:
            delete(self.spark, self.held.pop(id(df))[1])
