"""Ranked full-text search over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import occurrences, preview

#: Weights of a hit in the title (once), in the content and in the url (once).
TITLE, CONTENT, URL = 10, 1, 5


def search(pages: DataFrame, query: str, key: str = "page_id", url: str = "url", title: str = "title", content: str = "content") -> DataFrame:
    """(key, url, title, preview, relevance) of the pages that match, best first; ties keep the order of the key.

    Nulls match nothing.  The query must not be empty.
    """
    if not query.strip():
        raise ValueError("the query must not be empty")
    score = occurrences(F.col(title), query) * TITLE + occurrences(F.col(content), query) * CONTENT + occurrences(F.col(url), query) * URL
    out = pages.select(F.col(key), F.col(url), F.col(title), preview(F.col(content), query).alias("preview"), score.alias("relevance")).where("relevance > 0")
    return out.orderBy(F.desc("relevance"), F.asc(key))
