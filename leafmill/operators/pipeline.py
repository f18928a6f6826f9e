"""The whole way of a page: fetched HTML to clean Markdown, with its assets, links and place on disk; and crawls of many seeds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html, safety
from ..functions import url as U
from . import links as L
from . import markdown as M


def with_assets(pages: DataFrame, assets: DataFrame, key: str = "page_id", text: str = "html", url: str = "url") -> DataFrame:
    """Pages whose references to stored assets (url, content_type) are local paths; other references stay."""
    used = pages.select(F.col(key), F.explode(html.assets_udf(F.col(text), F.col(url))).alias("asset")).distinct()
    stored = assets.where(safety.is_allowed_mime(F.col("content_type")) & ~safety.is_private(F.col("url"))).select(F.col("url").alias("asset")).distinct()
    local = used.join(stored, "asset").groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("asset", F.concat(F.lit("assets/"), U.asset_path(F.col("asset")))))).alias("_local"))
    out = pages.join(local, key, "left")
    return out.withColumn(text, F.when(F.col("_local").isNull(), F.col(text)).otherwise(html.rewrite_udf(F.col(text), F.col(url), F.col("_local")))).drop("_local")


def convert(pages: DataFrame, config: L.CrawlConfig | None = None, key: str = "page_id", text: str = "html", url: str = "url", compat: bool = False) -> DataFrame:
    """(key, url, title, host, path, markdown, links) of HTML pages: content chosen, converted and cleaned; a null text gives null Markdown."""
    config = config or L.CrawlConfig()
    parsed = html.page_udf(config.content_selectors or None)(F.col(text), F.col(url))
    out = pages.select(F.col(key), F.col(url).alias("url"), parsed.alias("p")).select(key, "url", "p.title", F.col("p.markdown").alias("_md"), F.size("p.links").cast("bigint").alias("links"))
    return out.select(key, "url", "title", F.coalesce(U.host(F.col("url")), F.lit("unknown")).alias("host"), U.page_path(F.col("url")).alias("path"), M.clean(F.col("_md"), compat).alias("markdown"), "links")


@dataclass
class BatchState:
    """Where a batch stands; ``error`` holds the roll-up of failed children."""

    status: str = "queued"
    current_index: int = 0
    children: list[tuple[str, str, str | None]] = field(default_factory=list)

    @property
    def error(self) -> str | None:
        bad = [m or "unknown error" for _, s, m in self.children if s == "failed"]
        return f"{len(bad)} child failure{'' if len(bad) == 1 else 's'}:\n" + "\n".join(bad) if bad else None


def run_batch(urls: list[str], crawl_one: Callable[[str], object], on_failure: str = "continue", stop: Callable[[], bool] = lambda: False) -> BatchState:
    """Crawl the seeds of a batch one after the other.

    ``continue`` goes on after a failure and ends completed with an error
    text, ``stop`` ends failed at the first one; a stop request ends it
    cancelled.  More than 500 seeds are refused.
    """
    if not 1 <= len(urls) <= 500:
        raise ValueError("a batch has 1 to 500 urls")
    state = BatchState("running")
    for i, u in enumerate(urls):
        if stop():
            state.status = "cancelled"
            return state
        state.current_index = i
        try:
            crawl_one(u)
            state.children.append((u, "completed", None))
        except Exception as e:  # noqa: BLE001 - a failed child is a result
            state.children.append((u, "failed", str(e)))
            if on_failure == "stop":
                state.status = "failed"
                return state
    state.status = "completed"
    return state
