"""Problem 1: the main body of a page, without the furniture of its site."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .body import Lines, model
from .common import by_blocks, strings
from .kernel import Block


def furniture(pages: DataFrame, key: str = "page_id", text: str = "content") -> DataFrame:
    """(key, line_no) of each non-blank line that is site furniture, by maximum-scoring runs of lines.

    One pass over the texts without a shuffle; line numbers count every line
    feed from 1.  Null and blank texts give no rows; rows with equal or null
    keys are treated each on its own; other columns are not read.
    """
    m = model()
    kind = pages.schema[key].dataType.simpleString()

    def work(texts, rows, _):
        x = Lines(Block(texts))
        at = np.flatnonzero(~m.body(x))
        ids = rows.column(key).take(pa.array(x.page[at]))
        yield pa.RecordBatch.from_arrays([ids, pa.array(x.no[at].astype(np.int32))], names=[key, "line_no"])

    return pages.select(key, text).mapInArrow(by_blocks(text, work), f"`{key}` {kind}, line_no int")


def bodies(texts: list[str | None], m) -> list[str]:
    """Main body of each text: its kept lines, trimmed at the end, joined by line feeds."""
    b = Block(texts)
    x = Lines(b)
    at = np.flatnonzero(m.body(x))
    out: list[list[str]] = [[] for _ in texts]
    for p, line in zip(x.page[at].tolist(), strings(b, x.raw[at], x.e[at])):
        out[p].append(line)
    return ["\n".join(v) for v in out]


def main_body(pages: DataFrame, key: str = "page_id", text: str = "content") -> DataFrame:
    """(key, body) of every page: its main-body lines in order, blank lines dropped.

    A null text gives a null body; a blank text or a page of furniture only
    gives an empty body.
    """
    m = model()
    kind = pages.schema[key].dataType.simpleString()

    def work(texts, rows, _):
        out = [None if t is None else v for t, v in zip(texts, bodies(texts, m))]
        yield pa.RecordBatch.from_arrays([rows.column(key), pa.array(out, pa.string())], names=[key, "body"])

    return pages.select(key, text).mapInArrow(by_blocks(text, work), f"`{key}` {kind}, body string")
