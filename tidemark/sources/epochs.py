"""Tables that a stream writes one epoch at a time, each epoch visible whole or not at all.

A batch writes its own rows only, to a folder of its epoch, and then a manifest that names the
folders of the table as they now stand. A manifest is written beside its place and renamed into
it, so a reader sees the last whole version, and a batch that was killed at any point, or runs
again, leaves nothing behind that counts: its folder is written anew, and an epoch that a
manifest already names is not added twice. Epochs belong to the stream that writes them, by
the id that its checkpoint keeps; a new checkpoint is another writer and adds to the table.

Small epochs are merged once there are ``compact_after`` of them, by one pass over the table;
a batch's cost is otherwise in proportion to its rows, whatever the table holds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .staging import delete


class EpochTable:
    """A table at ``path``. ``merge``: rows of several epochs to rows of one, such as a minimum per key; it must not matter in which steps."""

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame] | None = None, compact_after: int = 50):
        self.spark, self.path, self.schema, self.merge, self.compact_after = spark, path, schema, merge, compact_after
        self._place = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._place(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        folder = self._place(f"{self.path}/manifest")
        names = [f.getPath().getName() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return sorted(n for n in names if n.startswith("v") and n.endswith(".json"))

    def _state(self) -> dict:
        """The newest manifest: its version, its folders, those that the last merge replaced, and the last epoch of each writer."""
        names = self._manifests()
        if not names:
            return {"version": 0, "folders": [], "replaced": [], "epochs": {}}
        found = self._files.open(self._place(f"{self.path}/manifest/{names[-1]}"))
        try:
            return json.loads(bytes(found.readAllBytes()).decode())
        finally:
            found.close()

    def _publish(self, state: dict) -> None:
        state = state | {"version": state["version"] + 1}
        name = f"v{state['version']:012d}.json"
        beside = self._place(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = self._files.create(beside, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._files.rename(beside, self._place(f"{self.path}/manifest/{name}")):
            self._files.delete(beside, False)
            raise RuntimeError(f"another writer has published {name}")
        for old in self._manifests()[:-2]:
            self._files.delete(self._place(f"{self.path}/manifest/{old}"), False)

    def commit(self, rows: DataFrame, epoch: int, writer: str) -> bool:
        """``rows`` as an epoch of ``writer``; false, and nothing done, if the table has it already."""
        state = self._state()
        if state["epochs"].get(writer, -1) >= epoch:
            return False
        folder = f"data/{writer}-{epoch:012d}"
        rows.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        self._publish(state | {"folders": [*state["folders"], folder], "epochs": state["epochs"] | {writer: epoch}})
        if self.merge and len(state["folders"]) + 1 >= self.compact_after:
            self.compact()
        return True

    def compact(self) -> None:
        """All folders as one; those that it replaces stay for who still reads them, until the next merge."""
        state = self._state()
        folder = f"data/merged-{state['version'] + 1:012d}"
        self._read(state["folders"]).write.mode("overwrite").parquet(f"{self.path}/{folder}")
        self._publish(state | {"folders": [folder], "replaced": state["folders"]})
        for old in state["replaced"]:
            delete(self.spark, f"{self.path}/{old}")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])
        return self.merge(rows) if self.merge else rows

    def read(self) -> DataFrame:
        """The table as its newest manifest has it."""
        return self._read(self._state()["folders"])

    def folders(self) -> list[str]:
        return self._state()["folders"]


def query_id(spark: SparkSession) -> str:
    """Inside foreachBatch: the id that the stream's checkpoint keeps over restarts."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def stream_into(table: EpochTable, stream: DataFrame, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch, mode: str = "append") -> None:
    """The stream, to the end of what is there, into ``table``: every batch once, however often the run is stopped and repeated."""

    def write(batch: DataFrame, epoch: int) -> None:
        table.commit(prepare(batch), epoch, query_id(batch.sparkSession))

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
