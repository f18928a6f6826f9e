"""Sitemaps: parsing, discovery, expansion, statistics."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from xml.etree.ElementTree import ParseError, XMLPullParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from ..plans.shared import forget, written

#: Bounds of an expansion (parameters of ``expand``): urls, sub-sitemaps, depth, bytes of a body.
URLS, SUBS, DEPTH, BYTES, WARN = 10_000, 50, 2, 50 * 1024 * 1024, 1000
_ENTRY = StructType([StructField("url", StringType()), StructField("lastmod", StringType()), StructField("priority", FloatType())])
SCHEMA = StructType([StructField("kind", StringType()), StructField("entries", ArrayType(_ENTRY)), StructField("subs", ArrayType(StringType())), StructField("error", StringType())])


def unpack(url: str, body: bytes | None, most: int = BYTES) -> bytes | None:
    """A body, gunzipped if it or its url says that it is compressed; None if it is larger than allowed."""
    if body is None or len(body) > most:
        return None
    if body[:2] == b"\x1f\x8b" or (url or "").lower().endswith(".gz"):
        d = zlib.decompressobj(31)
        out = d.decompress(body, most + 1)
        return None if len(out) > most else out
    return body


def parse_body(body: bytes | None) -> dict:
    """Kind, entries and sub-sitemaps; input that breaks off keeps its finished entries, an unknown root or no XML is an error."""
    out = {"kind": None, "entries": [], "subs": [], "error": None}
    if body is None:
        return out | {"error": "no body"}
    p = XMLPullParser(("start", "end"))
    name = lambda t: t.rsplit("}", 1)[-1].rsplit(":", 1)[-1].lower()
    text = lambda e: "".join(e.itertext()).strip()
    broken = None
    try:
        p.feed(body)
    except ParseError as e:
        broken = str(e)
    try:
        for what, el in p.read_events():
            tag = name(el.tag)
            if what == "start":
                if out["kind"] is None:
                    if tag not in ("urlset", "sitemapindex"):
                        return out | {"error": f"unknown root {tag}"}
                    out["kind"] = "urlset" if tag == "urlset" else "index"
                continue
            if tag == ("url" if out["kind"] == "urlset" else "sitemap"):
                got = {name(c.tag): text(c) for c in el}
                if got.get("loc"):
                    if out["kind"] == "index":
                        out["subs"].append(got["loc"])
                    else:
                        try:
                            pr = float(got["priority"]) if got.get("priority") else None
                        except ValueError:
                            pr = None
                        out["entries"].append({"url": got["loc"], "lastmod": got.get("lastmod") or None, "priority": pr})
                el.clear()
    except ParseError as e:
        broken = str(e)
    if out["kind"] is None:
        out["error"] = broken or "no root"
    elif broken and "no element" not in broken and not out["entries"] and not out["subs"]:
        out["error"] = broken
    return out


@F.pandas_udf(SCHEMA)
def parse(url: pd.Series, body: pd.Series) -> pd.DataFrame:
    rows = []
    for u, b in zip(url, body):
        try:
            rows.append(parse_body(unpack(u, b)))
        except zlib.error as e:
            rows.append({"kind": None, "entries": [], "subs": [], "error": str(e)})
    return pd.DataFrame(rows, columns=["kind", "entries", "subs", "error"])


def expand(bodies: DataFrame, roots: list[str], urls: int | None = URLS, subs: int | None = SUBS, depth: int = DEPTH, stop: Callable[[], bool] = lambda: False) -> tuple[DataFrame, DataFrame]:
    """(entries, sources) of sitemaps (url, body), index files followed to a depth.

    Entries are distinct by url; the first ``urls`` of them are kept, and
    ``truncated`` says in each row whether more were there.  At most ``subs``
    sub-sitemaps of a depth are followed (None: all).  ``sources`` has a row for
    each sitemap read with its depth and error, if any; one that fails leaves
    the others whole.  ``stop`` is asked before each depth; what was read until
    then comes out.
    """
    spark = bodies.sparkSession
    parsed = written(bodies.select("url", parse("url", "body").alias("p")).select("url", "p.*"))
    level = spark.createDataFrame([(r,) for r in roots], "url string")
    seen = written(parsed.join(level, "url").withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        if stop():
            break
        below = seen.where(F.col("depth") == d - 1).select(F.explode("subs").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        below = below if subs is None else below.orderBy("url").limit(subs)
        old, seen = seen, written(seen.unionByName(parsed.join(below, "url").withColumn("depth", F.lit(d))))
        forget(old)
    e = seen.select("depth", F.col("url").alias("source"), F.posexplode("entries").alias("pos", "e")).select("depth", "source", "pos", "e.*").where("url <> ''")
    first = e.groupBy("url").agg(F.min_by(F.struct("lastmod", "priority"), F.struct("depth", "source", "pos")).alias("v"), F.min(F.struct("depth", "source", "pos")).alias("o"))
    if urls is not None:
        first = written(first.orderBy("o", "url").limit(urls + 1))  # one more than is kept tells whether any were left out
        more = first.count() > urls
        first = first.orderBy("o", "url").limit(urls).withColumn("truncated", F.lit(more))
    else:
        first = first.withColumn("truncated", F.lit(False))
    return first.select("url", "v.lastmod", "v.priority", "truncated"), seen.select("url", "depth", "kind", "error")


def from_robots(robots: DataFrame) -> DataFrame:
    """(host, pos, sitemap) of the Sitemap lines of robots files (host, body)."""
    ls = robots.select("host", F.posexplode(F.split("body", r"\r?\n", -1)).alias("pos", "line"))
    return ls.select("host", "pos", F.trim(F.regexp_extract(F.trim("line"), r"(?i)^sitemap\s*:(.*)$", 1)).alias("sitemap")).where("sitemap <> ''")


def discover(robots: DataFrame, reachable: DataFrame) -> DataFrame:
    """(host, sitemap, pos): sitemaps named by robots files first, then the usual places that answer; the first of each is kept."""
    named = from_robots(robots).select("host", F.lit(0).alias("rank"), "pos", "sitemap")
    usual = robots.select("host", F.posexplode(F.array(F.lit("/sitemap.xml"), F.lit("/sitemap_index.xml"))).alias("pos", "p")).select("host", F.lit(1).alias("rank"), "pos", F.concat(F.lit("https://"), "host", "p").alias("sitemap")).join(reachable.select(F.col("url").alias("sitemap")), "sitemap", "left_semi")
    first = named.unionByName(usual).groupBy("host", "sitemap").agg(F.min(F.struct("rank", "pos")).alias("o"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("host").orderBy("o"))).select("host", "sitemap", "pos")


def totals(entries: DataFrame) -> DataFrame:
    """(sitemap_url, entries, urls, without_lastmod, odd_priority, many) of sitemap entries."""
    odd = ~F.coalesce(F.col("priority").between(0.0, 1.0), F.lit(True))
    return entries.groupBy("sitemap_url").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("url").alias("urls"), F.count_if(F.col("lastmod").isNull()).alias("without_lastmod"), F.count_if(odd).alias("odd_priority"), (F.count(F.lit(1)) >= WARN).alias("many"))


def shown(entries: DataFrame, most: int = 500) -> DataFrame:
    """The first entries by url, as a list shows them (a bounded report)."""
    return entries.orderBy("url").limit(most)


def pick(entries: DataFrame, text: str = "", prefix: str | None = None) -> DataFrame:
    """Entries whose url holds a text and whose path starts with a prefix."""
    from ..functions.url import path

    out = entries.where(F.lower("url").contains(text.lower())) if text else entries
    return out.where(path(F.col("url")).startswith(prefix)) if prefix else out
