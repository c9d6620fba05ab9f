"""What the training-data operators share: the word pattern, staged tables, single evaluation."""

from __future__ import annotations

import gc
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import Staging, staged, table

__all__ = ["SPACE", "Staging", "WORD", "kept", "let", "staged", "table", "text_of", "whole_row"]

Held = TypeVar("Held")
_IN_WORKER: dict[str, object] = {}

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, whatever their names hold."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kept(name: str, make: Callable[[], Held]) -> Held:
    """What a Python worker keeps from task to task under ``name``; what it kept under another name is let go first.

    Workers outlive stages, and so would the tables of one operator while another runs. What
    hangs on a cycle goes with the collector only, and Arrow holds freed buffers until told.
    """
    if name not in _IN_WORKER:
        if _IN_WORKER:
            _IN_WORKER.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
        _IN_WORKER[name] = make()
    return _IN_WORKER[name]
