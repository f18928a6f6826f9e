"""What the operators of this subpackage share: reading, written tables, Arrow batches and the site of a url."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import forget, written  # noqa: F401 - used by the operators of this subpackage
from .kernel import blocks


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def site(url: Column) -> Column:
    """Host of an absolute url, lower-cased, without user, port and leading ``www.``; null for null and relative urls."""
    host = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@\s]*@)?([^/?#:\s]+)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def by_blocks(text: str, work: Callable[[list, pa.RecordBatch, int], Iterator[pa.RecordBatch]], limit: int | None = None) -> Callable:
    """A function for mapInArrow that hands blocks of rows to ``work(texts, rows of the block, offset)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for i, j in blocks(texts, *([limit] if limit else [])):
                yield from work(texts[i:j], batch.slice(i, j - i), i)

    return run


def strings(b, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The spans of a block as strings."""
    raw = b.cp.tobytes()
    return [raw[4 * s : 4 * e].decode("utf-32-le", "surrogatepass") for s, e in zip(starts.tolist(), ends.tolist())]
